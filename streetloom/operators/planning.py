"""Collection routes: clients from centroids, a capacitated routing heuristic, trips and loads."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions import exprs as X
from streetloom.functions import geo as G
from streetloom.operators import paths as P
from streetloom.operators.ranks import numbered
from streetloom.operators.stages import stage

UNREACHABLE = 999_999.0


@dataclass(frozen=True)
class Problem:
    """A fleet and its limits."""

    vehicles: int = 3
    capacity: int = 5_000
    reloads: int = 10
    rounds: int = 100

    def __post_init__(self) -> None:
        if min(self.vehicles, self.capacity, self.rounds) < 1 or self.reloads < 0:
            raise ValueError("a problem needs vehicles, capacity and rounds")


def snapped(points: DataFrame, nodes: DataFrame, cell: float = 0.006) -> DataFrame:
    """points(id, lon, lat) with the nearest node: candidates from the surrounding grid cells by an equi-join. Points
    whose best candidate is farther than a cell, or that have none, are asked again with cells twice as wide."""
    near = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    d = X.planar_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    known = lambda a, b: F.abs(F.col(a) + F.col(b)) < float("inf")
    left, nodes, done = points.where(known("lon", "lat")), nodes.where(known("x", "y")), None
    some = bool(nodes.take(1))
    while True:
        at = lambda c, cell=cell: F.floor(F.col(c) / cell)
        cells = nodes.select("node_id", "x", "y", at("x").alias("cx"), at("y").alias("cy"))
        asked = left.select("*", near.alias("dx")).select("*", near.alias("dy")).select("*", (at("lon") + F.col("dx")).alias("cx"), (at("lat") + F.col("dy")).alias("cy")).drop("dx", "dy")
        best = asked.join(cells, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(d.alias("km"), F.col("node_id").alias("node"))).alias("best"))
        # every node within one cell's width is among the candidates; a degree of longitude is the shorter one
        settled = stage(best.where(F.col("best.km") <= cell * 111.0 * 0.7).select("id", F.col("best.node").alias("node"), F.col("best.km").alias("km")))
        done = settled if done is None else done.unionByName(settled)
        left = stage(left.join(settled.select("id"), "id", "left_anti"))
        if not some or not left.take(1):
            return done
        cell *= 2


def clients(points: DataFrame, nodes: DataFrame, hull: list[tuple[float, float]], kg: float) -> DataFrame:
    """node, demand: points inside the hull, snapped, with their demand summed per node."""
    inside = points.where(G.in_ring(F.col("lon"), F.col("lat"), hull))
    at = snapped(inside.select("id", "lon", "lat"), nodes)
    return inside.join(at, "id").groupBy("node").agg(F.sum(X.demand_kg(F.col("count"), kg)).alias("demand"))


def with_depots(found: DataFrame, depots: DataFrame) -> DataFrame:
    """location, node, demand, is_depot, depot_id: depots first, clients at a depot's node left out."""
    own = depots.select("node", "depot_id", F.lit(0).cast("long").alias("demand"), F.lit(True).alias("is_depot"))
    rest = found.join(depots.select("node"), "node", "left_anti").select("node", F.lit(None).cast("int").alias("depot_id"), "demand", F.lit(False).alias("is_depot"))
    every = own.unionByName(rest)
    return numbered(every, [F.desc("is_depot"), F.col("depot_id"), F.col("node")], "location")


def visits(clients: DataFrame, problem: Problem, group: str = "waste_type") -> DataFrame:
    """clients(group, location, node, demand) with visit and area: demand above the capacity becomes several visits,
    and neighbouring locations share an area of so many visits as one fleet can serve even one a trip."""
    before = Window.partitionBy(group).orderBy("location").rowsBetween(Window.unboundedPreceding, -1)
    n = F.ceil(F.col("demand") / problem.capacity)
    counted = clients.withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn("visit", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)))
    size = problem.vehicles * (problem.reloads + 1)
    load = F.least(F.lit(problem.capacity).cast("long"), F.col("demand") - F.col("visit") * problem.capacity)
    return counted.select(group, F.floor((F.col("first") + F.col("visit")) / size).alias("area"), "location", "node", "visit", load.alias("demand"))


def _servable(matrix: np.ndarray, demand: np.ndarray, problem: Problem, c: int) -> bool:
    return max(matrix[0, c], matrix[c, 0]) < UNREACHABLE and demand[c] <= problem.capacity


def _moved(routes: list[list[int]], matrix: np.ndarray, demand: np.ndarray, capacity: int) -> bool:
    """Moves single clients to the place in another trip where that shortens the whole; empty trips go."""
    loads = [int(sum(demand[c] for c in t)) for t in routes]
    any_moved = False
    for k in range(len(routes)):
        for c in list(routes[k]):
            own = [0, *routes[k], 0]
            i = own.index(c, 1)
            gain = matrix[own[i - 1], c] + matrix[c, own[i + 1]] - matrix[own[i - 1], own[i + 1]]
            best = (1e-9, -1, 0)
            for m, t in enumerate(routes):
                if m == k or not t or loads[m] + demand[c] > capacity:
                    continue
                stops = np.array([0, *t, 0])
                costs = matrix[stops[:-1], c] + matrix[c, stops[1:]] - matrix[stops[:-1], stops[1:]]
                at = int(costs.argmin())
                if gain - costs[at] > best[0]:
                    best = (gain - costs[at], m, at)
            if best[1] >= 0:
                routes[k].remove(c)
                routes[best[1]].insert(best[2], c)
                loads[k] -= int(demand[c])
                loads[best[1]] += int(demand[c])
                any_moved = True
    routes[:] = [t for t in routes if t]
    return any_moved


def solve(matrix: np.ndarray, demand: np.ndarray, problem: Problem, depots: int = 1) -> list[list[list[int]]]:
    """Trips of each vehicle: merges by savings under the capacity, then 2-opt and moves of single clients
    until nothing improves (at most `rounds` sweeps); trips are dealt to the vehicles by length."""
    clients = [c for c in range(depots, len(demand)) if _servable(matrix, demand, problem, c)]
    trips = {c: [c] for c in clients}
    of = {c: c for c in clients}
    load = {c: int(demand[c]) for c in clients}
    savings = sorted(((matrix[a, 0] + matrix[0, b] - matrix[a, b], a, b) for a in clients for b in clients if a != b), reverse=True)
    for gain, a, b in savings:
        i, j = of[a], of[b]
        if gain <= 0:
            break
        if i != j and trips[i][-1] == a and trips[j][0] == b and load[i] + load[j] <= problem.capacity:
            trips[i] += trips[j]
            load[i] += load.pop(j)
            for c in trips.pop(j):
                of[c] = i
    routes = list(trips.values())
    length = lambda t: sum(matrix[x, y] for x, y in zip([0, *t], [*t, 0], strict=True))
    for _ in range(problem.rounds):
        better = False
        for k, t in enumerate(routes):
            for i in range(len(t) - 1):
                for j in range(i + 1, len(t)):
                    other = t[:i] + t[i : j + 1][::-1] + t[j + 1 :]
                    if length(other) < length(t) - 1e-9:
                        routes[k] = t = other
                        better = True
        better |= _moved(routes, matrix, demand, problem.capacity)
        if not better:
            break
    vehicles: list[list[list[int]]] = [[] for _ in range(problem.vehicles)]
    for t in sorted(routes, key=lambda t: (-length(t), t)):
        free = [v for v in vehicles if len(v) <= problem.reloads]
        if not free:
            raise ValueError("the fleet cannot serve all clients with so many reloads")
        min(free, key=lambda v: (sum(map(length, v)), vehicles.index(v))).append(t)
    return vehicles


def plan(locations: DataFrame, distances: DataFrame, problem: Problem, group: str = "waste_type") -> DataFrame:
    """route_id, trip_id, pos, location, demand per group: one bounded problem a task, depot first and last; clients
    that cannot be served have neither route nor trip. locations(group, location, demand), a location for each of
    its visits; distances(group, a, b, distance); missing arcs are unreachable."""

    names = ["route_id", "trip_id", "pos", "location", "demand"]

    def run(key, own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["location", "demand"], ascending=[True, False])
        places = own["location"].unique()
        index = {int(c): i for i, c in enumerate(places)}
        matrix = np.full((len(places), len(places)), UNREACHABLE)
        np.fill_diagonal(matrix, 0)
        for a, b, d in zip(arcs["a"], arcs["b"], arcs["distance"], strict=True):
            matrix[index[int(a)], index[int(b)]] = d
        at = [index[int(c)] for c in own["location"]]
        matrix = matrix[np.ix_(at, at)]
        demand = own["demand"].to_numpy()
        rows = []
        for r, trips in enumerate(solve(matrix, demand, problem)):
            for t, trip in enumerate(trips):
                for pos, at in enumerate([0, *trip, 0]):
                    rows.append((key[0], r, t, pos, int(own["location"].iloc[at]), int(demand[at])))
        rows += [(key[0], None, None, None, int(own["location"].iloc[c]), int(demand[c])) for c in range(1, len(own)) if not _servable(matrix, demand, problem, c)]
        return pd.DataFrame(rows, columns=[group, *names]).astype(dict.fromkeys(names, "Int64"))

    kind = dict(locations.dtypes)[group]
    distances = stage(distances)  # written once: searches are not repeated, and both sides stand alone
    return locations.groupBy(group).cogroup(distances.groupBy(group)).applyInPandas(run, f"{group} {kind}, route_id long, trip_id long, pos long, location long, demand long")


def nearest_depots(clients: DataFrame, distances: DataFrame) -> DataFrame:
    """clients(node, ...) with the depot that is nearest over the streets, and its distance: the fleet is split by depot.
    distances(depot, node, distance); clients that no depot reaches keep null."""
    best = distances.groupBy("node").agg(F.min(F.struct("distance", "depot")).alias("best"))
    return clients.join(best, "node", "left").select(*clients.columns, F.col("best.depot").alias("depot"), F.col("best.distance").alias("depot_distance"))


def reload_depots(stops: DataFrame, distances: DataFrame, policy: str = "home_only", home: int | None = None) -> DataFrame:
    """route_id, trip_id, last, depot: where the vehicle reloads after each trip: at home, or (all_depots) at the depot
    nearest to the trip's last client. stops(route_id, trip_id, pos, node, is_depot); distances(node, depot, distance)."""
    if policy not in ("home_only", "all_depots"):
        raise ValueError("the policy is home_only or all_depots")
    last = stops.where("NOT is_depot").groupBy("route_id", "trip_id").agg(F.max_by("node", "pos").alias("last"))
    if policy == "home_only":
        return last.withColumn("depot", F.lit(home).cast("long"))
    best = distances.groupBy(F.col("node").alias("last")).agg(F.min(F.struct("distance", "depot")).alias("best"))
    return last.join(best, "last", "left").select("route_id", "trip_id", "last", F.col("best.depot").cast("long").alias("depot"))


def routed_segments(legs: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """legs(route_id, trip_id, segment_id, origin, destination) with path and cost over the streets. Legs between equal
    nodes have a path of one node; legs without a way stay, with an empty path."""
    pairs = stage(legs.select("origin", "destination").distinct().withColumn("pair_id", F.xxhash64("origin", "destination")))
    found = P.shortest_paths(pairs, edges, weight).select("origin", "destination", "cost", "path")
    joined = legs.join(found, ["origin", "destination"], "left")
    here = F.col("origin") == F.col("destination")
    path = F.when(here, F.array("origin")).otherwise(F.coalesce("path", F.array().cast("array<long>")))
    return joined.withColumn("path", path).withColumn("cost", F.when(here, F.lit(0.0)).otherwise(F.col("cost")))


def readiness(clients: DataFrame, distances: DataFrame, problem: Problem, group: str = "waste_type") -> DataFrame:
    """What can be planned of each group: clients, demand, those that the depot reaches both ways, trips needed at least,
    and whether anything is ready to be solved. clients(group, node, demand); distances(node, distance, back)."""
    joined = clients.join(distances, "node", "left")
    can = F.col("distance").isNotNull() & F.col("back").isNotNull()
    summed = joined.groupBy(group).agg(F.count("*").alias("clients"), F.sum("demand").alias("demand"), F.count_if(can).alias("served"), F.coalesce(F.sum(F.when(can, F.col("demand"))), F.lit(0)).alias("kg"))
    return summed.select(group, "clients", "demand", "served", F.ceil(F.col("kg") / problem.capacity).alias("trips"), (F.col("served") > 0).alias("ready"))


def segments(stops: DataFrame) -> DataFrame:
    """route_id, trip_id, segment_id, a, b: the legs between consecutive stops."""
    trip = Window.partitionBy("route_id", "trip_id").orderBy("pos")
    return stops.withColumn("b", F.lead("location").over(trip)).where("b IS NOT NULL").select("route_id", "trip_id", F.col("pos").alias("segment_id"), F.col("location").alias("a"), "b")


def route_totals(stops: DataFrame) -> DataFrame:
    return stops.groupBy("route_id").agg(F.sum("demand").alias("delivered"), F.max("trip_id").alias("last_trip"), F.count_if(F.col("location") != 0).alias("stops")).withColumn("trips", F.col("last_trip") + 1).drop("last_trip")

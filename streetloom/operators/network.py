"""Relational operators on the road network: metrics, usage, modifications, impact.

Edge tables are joined by shuffle or broadcast as Spark's optimiser sees fit; only modification
lists, which users write by hand, are hinted small through a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions import exprs as X

#: Rows up to which a list of modifications is broadcast.
SMALL_LIST = 100_000
#: Edges up to which their metrics (40 bytes each) are broadcast, so that the steps of all routes need no shuffle.
SMALL_NETWORK = 1_000_000


def small(frame: DataFrame, most: int = SMALL_LIST) -> DataFrame:
    """frame with a broadcast hint if a bounded count shows that it is short."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def edge_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with time_s, gain_m, grade, co2_g and co2_per_km."""
    z = lambda name, key: nodes.select(F.col("node_id").alias(key), F.col("elevation").alias(name))
    joined = edges.join(z("z_u", "u"), "u", "left").join(z("z_v", "v"), "v", "left")
    speed = X.speed_or_default(F.col("speed_kph"))
    timed = joined.withColumn("time_s", X.free_flow_time(F.col("length_m"), speed)).withColumn("gain_m", F.coalesce(X.elevation_gain(F.col("z_u"), F.col("z_v")), F.lit(0.0)))
    timed = timed.withColumn("grade", F.when(F.col("length_m") > 0, (F.col("z_v") - F.col("z_u")) / F.col("length_m")))
    costed = timed.withColumn("co2_g", X.edge_co2(F.col("length_m").cast("double"), F.col("speed_kph"), F.col("gain_m"), F.col("time_s")))
    return costed.withColumn("co2_per_km", F.when(F.col("length_m") > 0, F.col("co2_g") / F.col("length_m") * 1000).otherwise(0.0)).drop("z_u", "z_v")


def route_edges(routes: DataFrame, path: str = "path") -> DataFrame:
    """route_id, seq, u, v: consecutive nodes of each path."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    steps = F.arrays_zip(F.slice(path, F.lit(1), n).alias("u"), F.slice(path, F.lit(2), n).alias("v"))
    return routes.select("route_id", F.posexplode(steps).alias("seq", "step")).select("route_id", "seq", "step.u", "step.v")


def usage(steps: DataFrame, n_routes: Column | int) -> DataFrame:
    """u, v, count, frequency."""
    total = F.lit(n_routes) if isinstance(n_routes, int) else n_routes
    return steps.groupBy("u", "v").agg(F.count("*").alias("count")).withColumn("frequency", F.when(total > 0, F.col("count") / total).otherwise(0.0))


def routes_of_edges(steps: DataFrame, most: int = 10_000) -> DataFrame:
    """u, v, chunk, routes: the routes over each edge in ascending order, an edge with very many in several lists."""
    sizes = steps.groupBy("u", "v").agg(F.ceil(F.count("*") / most).alias("chunks"))
    dealt = steps.select("u", "v", "route_id").join(sizes, ["u", "v"]).withColumn("chunk", F.pmod(F.xxhash64("route_id"), F.col("chunks")))
    return dealt.groupBy("u", "v", "chunk").agg(F.array_sort(F.collect_list("route_id")).alias("routes"))


def route_metrics(steps: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sums over each route's edges; a missing edge counts as nothing, a gain that is not positive is null."""
    own = small(metrics.where("key = 0").select("u", "v", "time_s", "length_m", "gain_m", "co2_g"), SMALL_NETWORK)
    joined = steps.join(own, ["u", "v"], "left")
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    summed = joined.groupBy("route_id").agg(total("time_s").alias("travel_time"), total("length_m").alias("distance"), total("gain_m").alias("gain"), total("co2_g").alias("co2"))
    return summed.withColumn("gain", F.when(F.col("gain") > 0, F.col("gain")))


def paired_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """u, v and the metrics of each edge in two states of the network: d0 t0 c0 and d1 t1 c1, distance, time and CO2."""
    own = lambda m, k: m.where("key = 0").select("u", "v", *[F.col(c).cast("double").alias(f"{n}{k}") for c, n in (("length_m", "d"), ("time_s", "t"), ("co2_g", "c"))])
    return own(before, 0).join(own(after, 1), ["u", "v"], "full_outer")


def paired_route_metrics(steps: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The metrics of each route on two states of the network, beside each other (d0 t0 c0 and d1 t1 c1, distance, time
    and CO2): the steps are read and summed once."""
    both = small(paired_metrics(before, after), SMALL_NETWORK)
    names = [f"{n}{k}" for k in (0, 1) for n in "dtc"]
    return steps.join(both, ["u", "v"], "left").groupBy("route_id").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])


def apply_modifications(edges: DataFrame, mods: DataFrame, least_change: float = 0.1) -> DataFrame:
    """edges after modifications: removals take all parallel edges, speeds change on key 0. A pure
    function, so nothing has to be restored."""
    mods = small(mods.select("u", "v", "action", F.col("speed_kph").alias("new_speed")))
    kept = edges.join(mods.where("action = 'remove'").select("u", "v"), ["u", "v"], "left_anti")
    slowed = kept.join(mods.where("action = 'modify'").select("u", "v", "new_speed"), ["u", "v"], "left")
    changes = (F.col("key") == 0) & F.col("new_speed").isNotNull() & (F.abs(F.col("new_speed") - F.col("speed_kph")) >= least_change)
    return slowed.withColumn("modified", F.coalesce(changes, F.lit(False))).withColumn("speed_kph", F.when(F.col("modified"), F.col("new_speed")).otherwise(F.col("speed_kph"))).drop("new_speed")


def affected_routes(steps: DataFrame, mods: DataFrame) -> DataFrame:
    """route_id of routes over a modified edge."""
    return steps.join(small(mods.select("u", "v")), ["u", "v"], "left_semi").select("route_id").distinct()


def first_modification(steps: DataFrame, mods: DataFrame) -> DataFrame:
    """Each affected route's first modified edge."""
    hit = steps.join(small(mods.select("u", "v", "action")), ["u", "v"])
    return hit.groupBy("route_id").agg(F.min_by(F.struct("u", "v", "action"), "seq").alias("m")).select("route_id", "m.u", "m.v", "m.action")


def maintained_counts(counts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Counts after some routes' steps go and others come: no other route is read again."""
    changes = counts.select("u", "v", F.col("count").alias("by")).unionByName(gone.select("u", "v", F.lit(-1).cast("long").alias("by"))).unionByName(come.select("u", "v", F.lit(1).cast("long").alias("by")))
    return changes.groupBy("u", "v").agg(F.sum("by").alias("count")).where("count <> 0")


def usage_deltas(new: DataFrame, old: DataFrame, n_routes: Column) -> DataFrame:
    """new counts beside the old ones; an edge without old count has its whole count as delta."""
    joined = new.join(old.select("u", "v", F.col("count").alias("before")), ["u", "v"], "left").crossJoin(n_routes)
    change = F.col("count") - F.coalesce("before", F.lit(0))
    return joined.select("u", "v", "count", change.alias("delta_count"), F.when(F.col("n") > 0, F.col("count") / F.col("n")).otherwise(0.0).alias("frequency"), F.when(F.col("n") > 0, change / F.col("n")).otherwise(0.0).alias("delta_frequency"))


def volume_deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """u, v, volume, delta over the edges of either table."""
    joined = new.select("u", "v", F.col("volume").alias("a")).join(old.select("u", "v", F.col("volume").alias("b")), ["u", "v"], "full_outer")
    return joined.select("u", "v", F.coalesce("a", F.lit(0.0)).alias("volume"), (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def impact(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of statistics over rerouted routes: a route counts as affected if its time or distance
    did not fall; falls do not enter the sums, percents average over those that are not null."""
    joined = old.select("route_id", F.col("distance").alias("d0"), F.col("travel_time").alias("t0"), F.col("co2").alias("c0")).join(new.select("route_id", F.col("distance").alias("d1"), F.col("travel_time").alias("t1"), F.col("co2").alias("c1")), "route_id")
    return paired_impact(joined)


def paired_impact(joined: DataFrame) -> DataFrame:
    """impact() of rows that hold both states: d0 t0 c0 and d1 t1 c1."""
    rows = joined.select(*[f(F.col(f"{k}0"), F.col(f"{k}1")).alias(f"{k}{s}") for k in "dtc" for s, f in (("x", X.delta), ("p", X.delta_percent))])
    hit = (F.col("dx") >= 0) | (F.col("tx") >= 0)
    up = lambda c: F.when(hit & (F.col(c) > 0), F.col(c))
    total = F.count_if(hit)
    out = [F.count("*").alias("rerouted"), total.alias("affected")]
    for k, name in (("d", "distance"), ("t", "time"), ("c", "co2")):
        out += [F.coalesce(F.sum(up(f"{k}x")), F.lit(0.0)).alias(f"{name}_increase"), F.coalesce(F.max(up(f"{k}x")), F.lit(0.0)).alias(f"max_{name}_increase"), F.when(total > 0, F.coalesce(F.sum(up(f"{k}x")), F.lit(0.0)) / total).otherwise(0.0).alias(f"avg_{name}_increase")]
        out.append(F.coalesce(F.avg(up(f"{k}p")), F.lit(0.0)).alias(f"avg_{name}_percent"))
    return rows.agg(*out)


def elastic_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals of the new routes minus the old ones, whichever routes these are."""
    names = ["distance", "travel_time", "co2"]
    a = old.agg(*[F.sum(c).alias(f"old_{c}") for c in names])
    b = new.agg(*[F.sum(c).alias(f"new_{c}") for c in names])
    return b.crossJoin(a).select(*[(F.coalesce(f"new_{c}", F.lit(0.0)) - F.coalesce(f"old_{c}", F.lit(0.0))).alias(f"{c}_change") for c in names])


def daily_volumes(counts: DataFrame, edges: DataFrame, daily_km: float) -> DataFrame:
    """Route counts scaled so that all vehicles together drive daily_km: u, v, volume."""
    used = counts.join(edges.where("key = 0").select("u", "v", "length_m"), ["u", "v"])
    total = used.agg(F.sum(F.col("count") * F.col("length_m")).alias("metres"))
    return used.crossJoin(F.broadcast(total)).select("u", "v", F.when(F.col("metres") > 0, F.col("count") * F.lit(daily_km * 1000.0) / F.col("metres")).otherwise(0.0).alias("volume"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The shortest of parallel edges, lowest key first."""
    return edges.groupBy("u", "v").agg(F.min_by("key", F.struct("length_m", "key")).alias("key"), F.min("length_m").alias("length_m"))


def intersections(edges: DataFrame, least: int = 3) -> DataFrame:
    """node_id, street_count of nodes where at least so many streets meet."""
    ends = edges.where("key = 0").select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(edges.where("key = 0").select("v", "u"))
    return ends.distinct().groupBy("node_id").agg(F.count("*").alias("street_count")).where(F.col("street_count") >= least)


def robust_max(frame: DataFrame, value: str, share: float = 0.98, positive: bool = True) -> DataFrame:
    """The value at index min(floor(n * share), n - 1) in ascending order."""
    rows = frame.where(F.col(value) > 0) if positive else frame.where(F.col(value).isNotNull())
    counted = rows.agg(F.count("*").alias("n"))
    # ranks come from counts of equal values, so only distinct values are ordered
    steps = rows.groupBy(value).agg(F.count("*").alias("own")).withColumn("upto", F.sum("own").over(Window.orderBy(value)))
    return steps.crossJoin(counted).where(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1)).agg(F.min(value).alias("robust_max"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """edges with has_reverse: whether the opposite edge exists."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct().withColumn("back", F.lit(True))
    return edges.join(back, ["u", "v"], "left").withColumn("has_reverse", F.coalesce("back", F.lit(False))).drop("back")


def segment_loads(stops: DataFrame) -> DataFrame:
    """stops(route_id, trip_id, pos, location, demand) with the load after each stop: deliveries add up
    along a trip and start anew at the depot, location 0."""
    trip = Window.partitionBy("route_id", "trip_id").orderBy("pos")
    phased = stops.withColumn("phase", F.sum(F.when((F.col("location") == 0) & (F.col("pos") > 0), 1).otherwise(0)).over(trip))
    own = F.when(F.col("location") == 0, 0).otherwise(F.col("demand"))
    run = Window.partitionBy("route_id", "trip_id", "phase").orderBy("pos")
    return phased.withColumn("load", F.sum(own).over(run)).drop("phase")


def edge_loads(steps: DataFrame, loads: DataFrame, edges: DataFrame, unit: str = "kg") -> DataFrame:
    """Load over each street: steps(route_id, trip_id, segment_id, u, v) carry the load at their segment's
    start to the shortest forward edge, else the shortest backward one, else nowhere. unit kg or kg_m."""
    at = loads.select("route_id", "trip_id", F.col("pos").alias("segment_id"), "load")
    return placed_loads(steps.join(at, ["route_id", "trip_id", "segment_id"], "left").withColumn("load", F.coalesce("load", F.lit(0))), edges, unit)


def placed_loads(carried: DataFrame, edges: DataFrame, unit: str = "kg") -> DataFrame:
    """edge_loads() of steps that have their load, or all steps' loads over a street at once."""
    best = first_edges(edges)
    forward = best.select("u", "v", F.col("key").alias("fk"), F.col("length_m").alias("fl"))
    back = best.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("key").alias("bk"), F.col("length_m").alias("bl"))
    found = carried.join(forward, ["u", "v"], "left").join(back, ["u", "v"], "left").where("fk IS NOT NULL OR bk IS NOT NULL")
    use = F.col("fk").isNotNull()
    factor = F.coalesce("fl", "bl") if unit == "kg_m" else F.lit(1)
    placed = found.select(F.when(use, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(use, F.col("v")).otherwise(F.col("u")).alias("v"), F.coalesce("fk", "bk").alias("key"), (F.col("load") * factor).alias("amount"))
    return placed.groupBy("u", "v", "key").agg(F.sum("amount").alias("load"))

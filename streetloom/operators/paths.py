"""Shortest paths, distance matrices and betweenness, one search per origin.

The network is packed into arrays (heads, offsets, weights) and sent once to every executor; a check
of its size guards that, and beyond it distances, paths and betweenness come from rounds of joins. Pairs are grouped by
origin, so one search serves all destinations of an origin; an origin with very many destinations is
dealt to several groups, each of which repeats the search rather than gather the pairs.

Ties between equally long paths go to the lowest predecessor.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a network that is sent whole to the executors (24 bytes each), and pairs of one group.
MOST_EDGES, GROUP_PAIRS = 20_000_000, 20_000
#: Edges of a packed piece, edges up to which a search reads lists (70 bytes an edge), and pairs that share a search
#: where they pass in a stream.
PIECE_EDGES, LIST_EDGES, STREAM_PAIRS = 500_000, 1_000_000, 1_000_000
#: Targets up to which a search stops once it has settled them all; more are met by a join.
MOST_GOALS = 100_000


class Network:
    """Edges as arrays, by tail; of parallel edges the one with the least weight. Further columns are kept beside them."""

    def __init__(self, edges: pd.DataFrame | dict[str, np.ndarray]):
        u, v, weight = np.asarray(edges["u"]), np.asarray(edges["v"]), np.asarray(edges["weight"], np.float64)
        order = np.lexsort((weight, v, u))
        order = order[np.r_[True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)][: len(order)]]
        u, v = u[order], v[order]
        self.ids = np.unique(np.concatenate([u, v]))
        self.tails, self.heads = np.searchsorted(self.ids, u).astype(np.int32), np.searchsorted(self.ids, v).astype(np.int32)
        del u, v
        self.weights = weight[order]
        del weight
        self.values = {c: np.asarray(edges[c], np.float64)[order] for c in edges if c not in ("u", "v", "weight")}
        self.offsets = np.searchsorted(self.tails, np.arange(len(self.ids) + 1))
        # plain sequences for the search, made once: reading an item of numpy's is several times slower
        if len(order) <= LIST_EDGES:
            self._heads, self._weights, self._offsets = self.heads.tolist(), self.weights.tolist(), self.offsets.tolist()
        else:
            self._heads, self._weights, self._offsets = array("i", self.heads.tobytes()), array("d", self.weights.tobytes()), array("q", self.offsets.tobytes())

    def index(self, node: int) -> int:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else -1

    def search(self, origin: int, targets: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Distances, predecessors (-1: none) and the order of settling; stops when all targets are settled."""
        n = len(self.ids)
        order: list[int] = []
        left = set(targets) if targets is not None else None
        heads, weights, offsets = self._heads, self._weights, self._offsets
        far, pre, done = [np.inf] * n, [-1] * n, bytearray(n)
        far[origin] = 0.0
        heap = [(0.0, origin)]
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = 1
            order.append(u)
            if left is not None:
                left.discard(u)
                if not left:
                    break
            for e in range(offsets[u], offsets[u + 1]):
                v, w = heads[e], d + weights[e]
                if w < far[v]:
                    far[v], pre[v] = w, u
                    heapq.heappush(heap, (w, v))
                elif w == far[v] and not done[v] and u < pre[v]:
                    pre[v] = u
        return np.array(far), np.array(pre), order

    def along(self, before: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The root of each node in the tree of predecessors, and the sums of the further columns from there to the node:
        ways double in length each round, so that no path is followed node by node."""
        n = len(self.ids)
        child = np.flatnonzero(before >= 0)
        at = np.searchsorted(self.tails.astype(np.int64) * n + self.heads, before[child] * n + child)
        sums = {c: np.zeros(n) for c in self.values}
        for c, own in self.values.items():
            sums[c][child] = own[at]
        root = np.where(before >= 0, before, np.arange(n))
        while True:
            above = root[root]
            if (above == root).all():
                return root, sums
            for c in sums:
                sums[c] += sums[c][root]
            root = above


_NETWORKS: dict[str, Network] = {}


class _Unpacked(dict):
    """Packed columns by name, each unpacked when it is asked for and not kept."""

    def __init__(self, columns: list[str], pieces: list[list[bytes]]):
        super().__init__((c, (np.int64 if k < 2 else np.float64, [p[k] for p in pieces])) for k, c in enumerate(columns))

    def __getitem__(self, column: str) -> np.ndarray:
        kind, own = super().__getitem__(column)
        return np.concatenate([np.frombuffer(zlib.decompress(p), kind) for p in own] or [np.empty(0, kind)])


def _network(broadcast) -> Network:
    """Built once per worker."""
    token, columns, pieces = broadcast.value
    if token not in _NETWORKS:
        _NETWORKS.clear()
        _NETWORKS[token] = Network(_Unpacked(columns, pieces))
    return _NETWORKS[token]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as compressed columns, one row for very many of them."""
    held: list[pa.RecordBatch] = []

    def piece() -> pa.RecordBatch:
        columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)]
        row = [zlib.compress(c.astype(np.int64 if k < 2 else np.float64).tobytes(), 1) for k, c in enumerate(columns)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.binary()))], ["columns"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE_EDGES:
            yield piece()
    if held:
        yield piece()


def sent(edges: DataFrame, weight: str, values: tuple[str, ...] = ()):
    """The network as a broadcast variable, or None if it is too large for one. The executors pack the edges, so that the
    driver holds no rows but a few compressed columns."""
    chosen = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col(weight).cast("double").alias("weight"), *[F.col(c).cast("double").alias(c) for c in values])
    if chosen.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        return None
    pieces = [[bytes(c) for c in r[0]] for r in chosen.mapInArrow(_packed, "columns array<binary>").collect()]
    return edges.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, chosen.columns, pieces))


def shortest_paths(pairs: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """pair_id, origin, destination, cost, path of every pair that has a path of at least one step."""
    network = sent(edges, weight)
    if network is None:
        return relaxed_paths(pairs, edges, weight)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        net = _network(network)
        origin = net.index(int(batch["origin"].iloc[0]))
        goals = [net.index(int(d)) for d in batch["destination"]]
        costs, paths = [], []
        if origin >= 0:
            far, before, _ = net.search(origin, {g for g in goals if g >= 0})
        for goal in goals:
            if origin < 0 or goal < 0 or goal == origin or not np.isfinite(far[goal]):
                costs.append(None)
                paths.append(None)
                continue
            path, at = [], goal
            while at >= 0:
                path.append(int(net.ids[at]))
                at = int(before[at])
            costs.append(float(far[goal]))
            paths.append(path[::-1])
        out = batch[["pair_id", "origin", "destination"]].copy()
        out["cost"], out["path"] = costs, paths
        return out[[p is not None for p in paths]]

    groups = pairs.groupBy("origin").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("groups"))
    dealt = pairs.join(groups, "origin").withColumn("part", F.pmod(F.xxhash64("pair_id"), F.col("groups"))).drop("groups")
    return dealt.groupBy("origin", "part").applyInPandas(run, "pair_id long, origin long, destination long, cost double, path array<long>")


def path_sums(pairs: DataFrame, edges: DataFrame, weight: str, values: DataFrame | None = None) -> DataFrame:
    """pair_id, origin, destination, cost, first, last of every pair that has a path of at least one step, and the sums of
    values(u, v, ...) over the steps of that path, nothing where a step has none. All are read from the tree of the
    origin's search, so no path is written out."""
    names = [c for c in values.columns if c not in ("u", "v")] if values is not None else []
    own = values.groupBy("u", "v").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names]) if names else None
    step = edges.groupBy("u", "v").agg(F.min(F.col(weight).cast("double")).alias("_weight"))
    step = step.join(own, ["u", "v"], "left").fillna(0.0, names) if names else step
    network = sent(step, "_weight", tuple(names))
    kinds = "pair_id long, origin long, destination long, cost double, first long, last long" + "".join(f", {c} double" for c in names)
    if network is None:
        found = relaxed_paths(pairs, edges, weight).withColumns({"first": F.get("path", F.lit(0)), "last": F.element_at("path", -1)})
        if not names:
            return found.drop("path")
        ends = F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("u"), F.expr("slice(path, 2, size(path) - 1)").alias("v")))
        steps = found.select(*found.drop("path").columns, ends.alias("s")).select("*", "s.u", "s.v").join(own, ["u", "v"], "left")
        return steps.groupBy(*found.drop("path").columns).agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, last = _network(network), None
        for batch in batches:
            for node, rows in batch.groupby("origin", sort=False):
                if (at := net.index(int(node))) < 0:
                    continue
                if at != last:
                    last = at
                    far, before, _ = net.search(at)
                    root, sums = net.along(before)
                goals = rows["destination"].to_numpy()
                to = np.minimum(np.searchsorted(net.ids, goals), len(net.ids) - 1)
                hit = (net.ids[to] == goals) & np.isfinite(far[to]) & (to != at)
                to = to[hit]
                out = rows.loc[hit, ["pair_id", "origin", "destination"]]
                yield out.assign(cost=far[to], first=net.ids[root[to]], last=net.ids[to], **{c: sums[c][to] for c in names})

    chosen = pairs.where("origin IS NOT NULL AND destination IS NOT NULL").select("pair_id", "origin", "destination")
    groups = chosen.groupBy("origin").agg(F.ceil(F.count("*") / STREAM_PAIRS).alias("groups"))
    dealt = chosen.join(groups, "origin").withColumn("part", F.pmod(F.xxhash64("pair_id"), F.col("groups"))).drop("groups")
    parts = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return dealt.repartition(parts, "origin", "part").sortWithinPartitions("origin").mapInPandas(run, kinds)


def failed_pairs(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs without a route."""
    return pairs.join(routes.select("pair_id"), "pair_id", "left_anti")


def distances(origins: DataFrame, edges: DataFrame, weight: str, targets: DataFrame | None = None) -> DataFrame:
    """origin, node, distance from each origin to every node it reaches (or to the targets)."""
    network = sent(edges, weight)
    if network is None:
        found = relaxed_distances(origins, edges, weight)
        return found if targets is None else found.join(targets.select("node").distinct(), "node", "left_semi")
    few = targets.select("node").where("node IS NOT NULL").distinct() if targets is not None else None
    goals = edges.sparkSession.sparkContext.broadcast(np.array([r[0] for r in few.collect()], np.int64)) if few is not None and few.limit(MOST_GOALS + 1).count() <= MOST_GOALS else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = _network(network)
        wanted = None if goals is None else np.isin(net.ids, goals.value)
        ends = None if goals is None else set(np.flatnonzero(wanted).tolist())
        for batch in batches:
            for node in batch["origin"]:
                if (at := net.index(int(node))) >= 0 and ends != set():
                    far, _, _ = net.search(at, ends)
                    hit = np.isfinite(far) if wanted is None else np.isfinite(far) & wanted
                    yield pd.DataFrame({"origin": int(node), "node": net.ids[hit], "distance": far[hit]})

    parts = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    found = origins.select("origin").distinct().repartition(parts, "origin").mapInPandas(run, "origin long, node long, distance double")
    return found if targets is None or goals is not None else found.join(targets.select("node").distinct(), "node", "left_semi")


def relaxed_distances(origins: DataFrame, edges: DataFrame, weight: str, rounds: int = 100_000) -> DataFrame:
    """The same by rounds of joins, for networks too large to send: only nodes that improved spread further."""
    from streetloom.operators.stages import stage

    step = edges.groupBy("u", "v").agg(F.min(F.col(weight).cast("double")).alias("w"))
    known = stage(origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("distance")).distinct())
    front = known
    for _ in range(rounds):
        reached = front.join(step, front["node"] == step["u"]).groupBy("origin", F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("reach"))
        better = stage(reached.join(known, ["origin", "node"], "left").where("distance IS NULL OR reach < distance").select("origin", "node", F.col("reach").alias("distance")))
        if better.isEmpty():
            break
        known = stage(known.unionByName(better).groupBy("origin", "node").agg(F.min("distance").alias("distance")))
        front = better
    return known


def _tight(known: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """origin, u, v of the edges that lie on shortest paths, given the distances from each origin."""
    step = edges.groupBy("u", "v").agg(F.min(F.col(weight).cast("double")).alias("w"))
    a = known.select("origin", F.col("node").alias("u"), F.col("distance").alias("du"))
    b = known.select("origin", F.col("node").alias("v"), F.col("distance").alias("dv"))
    return a.join(step, "u").join(b, ["origin", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("dv")) <= 1e-9 + 1e-12 * F.abs("dv")).select("origin", "u", "v")


def relaxed_paths(pairs: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """The rows of shortest_paths by joins: distances by relaxation, then all paths are followed back together, a
    step a round."""
    from streetloom.operators.stages import stage

    known = stage(relaxed_distances(pairs.select("origin").distinct(), edges, weight))
    before = stage(_tight(known, edges, weight).groupBy("origin", F.col("v").alias("node")).agg(F.min("u").alias("before")))
    goals = known.select("origin", F.col("node").alias("destination"), F.col("distance").alias("cost"))
    walks = stage(pairs.where("origin <> destination").join(goals, ["origin", "destination"]).select("pair_id", "origin", "destination", "cost", F.col("destination").alias("at"), F.array("destination").alias("path")))
    done = walks.limit(0)
    while True:
        arrived = walks.where("at = origin")
        done = stage(done.unionByName(arrived))
        open_ = walks.where("at <> origin")
        if open_.isEmpty():
            return done.select("pair_id", "origin", "destination", "cost", "path")
        step = before.select("origin", F.col("node").alias("at"), "before")
        walks = stage(open_.join(step, ["origin", "at"]).select("pair_id", "origin", "destination", "cost", F.col("before").alias("at"), F.concat(F.array("before"), F.col("path")).alias("path")))


def relaxed_betweenness(origins: DataFrame, edges: DataFrame, weight: str, targets: DataFrame | None = None) -> DataFrame:
    """The rows of betweenness by joins. Counts of shortest paths flow forward from each origin along the edges on
    shortest paths, a hop a round; then one unit flows back from every target, shared by those counts."""
    from streetloom.operators.stages import stage

    known = stage(relaxed_distances(origins.select("origin").distinct(), edges, weight))
    tight = stage(_tight(known, edges, weight))
    front = stage(origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("ways")).distinct())
    parts = front
    while not front.isEmpty():
        front = stage(front.join(tight, (front["origin"] == tight["origin"]) & (front["node"] == tight["u"])).groupBy(tight["origin"], tight["v"].alias("node")).agg(F.sum("ways").alias("ways")))
        parts = stage(parts.unionByName(front))
    ways = stage(parts.groupBy("origin", "node").agg(F.sum("ways").alias("ways")))
    at = lambda end: ways.select("origin", F.col("node").alias(end), F.col("ways").alias(f"ways_{end}"))
    shares = stage(tight.join(at("u"), ["origin", "u"]).join(at("v"), ["origin", "v"]).select("origin", "u", "v", (F.col("ways_u") / F.col("ways_v")).alias("share")))
    flow = known.where("node <> origin").select("origin", "node", F.lit(1.0).alias("amount"))
    flow = stage(flow if targets is None else flow.join(targets.select("node").distinct(), "node", "left_semi"))
    sums = None
    while not flow.isEmpty():
        moved = stage(flow.withColumnRenamed("node", "v").join(shares, ["origin", "v"]).select("origin", "u", "v", (F.col("amount") * F.col("share")).alias("amount")))
        own = moved.groupBy("u", "v").agg(F.sum("amount").alias("betweenness"))
        sums = stage(own if sums is None else sums.unionByName(own).groupBy("u", "v").agg(F.sum("betweenness").alias("betweenness")))
        flow = stage(moved.groupBy("origin", F.col("u").alias("node")).agg(F.sum("amount").alias("amount")))
    return sums if sums is not None else edges.select("u", "v", F.lit(0.0).alias("betweenness")).limit(0)


def betweenness(origins: DataFrame, edges: DataFrame, weight: str, targets: DataFrame | None = None) -> DataFrame:
    """u, v, betweenness over shortest paths from the origins (to the targets; all nodes if none): shares
    of equally short paths, one backward sweep per origin, partial sums added by Spark."""
    network = sent(edges, weight)
    chosen = None if targets is None else targets.select("node").distinct()
    if network is None or (chosen is not None and chosen.limit(MOST_EDGES + 1).count() > MOST_EDGES):
        return relaxed_betweenness(origins, edges, weight, targets)
    goals = None if chosen is None else edges.sparkSession.sparkContext.broadcast(np.array([r[0] for r in chosen.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = _network(network)
        n = len(net.ids)
        wanted = np.ones(n, bool) if goals is None else np.isin(net.ids, goals.value)
        tails, heads = net.tails, net.heads
        sums = np.zeros(len(heads))
        for batch in batches:
            for node in batch["origin"]:
                at = net.index(int(node))
                if at < 0:
                    continue
                far, _, order = net.search(at)
                tight = np.flatnonzero(np.isclose(far[tails] + net.weights, far[heads], rtol=1e-12, atol=1e-9) & np.isfinite(far[tails]))
                place = np.empty(n, np.int64)
                place[order] = np.arange(len(order))
                tight = tight[np.argsort(place[tails[tight]], kind="stable")]  # in the order in which tails were settled
                ways, share, give = [0.0] * n, [0.0] * n, wanted.astype(float)
                ways[at], give[at] = 1.0, 0.0
                steps, give = list(zip(tails[tight].tolist(), heads[tight].tolist(), strict=True)), give.tolist()
                for u, v in steps:
                    ways[v] += ways[u]
                part = [0.0] * len(steps)
                for k in range(len(steps) - 1, -1, -1):
                    u, v = steps[k]
                    part[k] = c = ways[u] / ways[v] * (share[v] + give[v])
                    share[u] += c
                sums[tight] += part
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"u": net.ids[tails[used]], "v": net.ids[heads[used]], "partial": sums[used]})

    parts = max(2, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    partial = origins.select("origin").distinct().repartition(parts, "origin").mapInPandas(run, "u long, v long, partial double")
    return partial.groupBy("u", "v").agg(F.sum("partial").alias("betweenness"))


def normalised(found: DataFrame, edges: DataFrame, daily_km: float) -> DataFrame:
    """Betweenness scaled to vehicles a day: sum of volume times kilometres is daily_km."""
    joined = found.join(edges.groupBy("u", "v").agg(F.min("length_m").alias("length_m")), ["u", "v"])
    total = joined.agg(F.sum(F.col("betweenness") * F.col("length_m")).alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("u", "v", F.when(F.col("total") > 0, F.col("betweenness") * daily_km * 1000 / F.col("total")).otherwise(0.0).alias("volume"))

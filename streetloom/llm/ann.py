"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced k-means over a bounded sample. Every vector of the table is indexed:
it goes to its nearest centroid's posting list and, if it lies near a boundary, to further lists
whose centroids are nearly as near and not hidden behind one already chosen. A list that is long
(the sample bounds the number of lists, not their length) is divided once more, by centroids of its
own, so what a query reads does not grow with the table. A query walks an in-memory neighbour graph
over the centroids, and reads the lists whose centroid is within a distance ratio of the nearest one,
and further ones until they hold enough vectors for an answer; in long lists likewise the divisions.
Exact cosines in double precision rank what is found.

Equal directions are one class, so a group of copies costs one entry; a class keeps the few smallest
vec_ids that an answer can need. Bounds: SAMPLE vectors for k-means, MOST_CENTROIDS centroids (sent
to all workers), LIST_LIMIT vectors of a list in a task.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null vec_id; very long and very short vectors
do, scaled by a power of two; repeated rows count once; an empty table gives none; other columns do
not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

SAMPLE, MOST_CENTROIDS, LIST_SIZE, LIST_LIMIT = 20_000, 4096, 256, 4096
#: A list of more vectors than this is divided, by centroids fitted to one of DIVIDE_EVERY of its vectors.
LONG, DIVIDE_EVERY = 1024, 16
#: Lists per vector at most, how much farther a further list may be, links per centroid, and the
#: ratio to the nearest centroid's distance up to which lists are read.
REPLICAS, BOUNDARY, LINKS, RATIO = 4, 1.08, 24, 1.22
_KEEP = 1  # an answer of k rows needs k + 1 of a class: the query's own row does not count


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means on the unit sphere in which a cluster's growth makes it seem farther."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    weight = np.zeros(k)
    for _ in range(rounds):
        nearest = np.argmin(2 - 2 * sample @ centroids.T + weight, axis=1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        centroids[full] = sums[full] / norms[full, None]
        centroids[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
        weight += 0.02 * (sizes - len(sample) / k) / (len(sample) / k)
    return centroids


def neighbour_graph(centroids: np.ndarray, links: int = LINKS, seed: int = 11) -> np.ndarray:
    """Each centroid's nearest ones, and two drawn at random so that the walk can cross the whole space."""
    k = len(centroids)
    rng = np.random.default_rng(seed)
    near = np.empty((k, min(links, k - 1)), np.int64)
    for a in range(0, k, 512):
        d = -centroids[a : a + 512] @ centroids.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + 512] = np.argsort(d, axis=1)[:, : near.shape[1]]
    return np.concatenate([near, rng.integers(0, k, (k, 2))], axis=1)


def walk(query: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
    """Centroids within ratio of the nearest one's distance, by best-first search from a few entries; then the next
    ones, until their lists hold `least` vectors (all lists, if they hold fewer)."""
    entries = list({0, len(centroids) // 3, 2 * len(centroids) // 3})
    far = lambda at: np.sqrt(np.maximum(2 - 2 * centroids[at] @ query, 0.0))
    seen = set(entries)
    heap = [(float(d), i) for d, i in zip(far(entries), entries, strict=True)]
    heapq.heapify(heap)
    best, visited = heap[0][0], []
    misses = held = 0
    while heap:
        d, i = heapq.heappop(heap)
        visited.append((d, i))
        best = min(best, d)
        held += 0 if sizes is None else int(sizes[i])
        misses = misses + 1 if d > best * ratio else 0
        if misses > 16 and held >= least:  # the frontier has left the ball for good
            break
        fresh = [j for j in dict.fromkeys(graph[i].tolist()) if j not in seen]
        if fresh:
            seen.update(fresh)
            for e, j in zip(far(fresh), fresh, strict=True):
                heapq.heappush(heap, (float(e), j))
    return _enough(sorted(visited), ratio, sizes, least) or list(range(len(centroids)))


def _enough(near: list[tuple[float, int]], ratio: float, sizes: np.ndarray | None, least: int) -> list[int] | None:
    """Of (distance, place), nearest first, those within the ratio and those needed for `least` vectors; None if all hold fewer."""
    out, held = [], 0
    for d, i in near:
        if d > near[0][0] * ratio and held >= least:
            return out
        out.append(i)
        held += 0 if sizes is None else int(sizes[i])
    return out if held >= least else None


def _unit(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), "<f8") for v in batch.column(at)])


@runtime.lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles, scaled by a power of two so that no square over- or underflows."""
    for batch in batches:
        keep, raw = [], []
        for i, v in enumerate(batch.column(1).to_pylist()):
            if v and None not in v:
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    keep.append(i)
                    raw.append((np.ldexp(x, -int(np.frexp(top)[1])) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], ["vec_id", "vector"])


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _choose(x: np.ndarray, centroids: np.ndarray, replicas: int, boundary: float) -> tuple[list[int], list[int]]:
    """The centroids of each unit vector, and the vector of each: its nearest, and others that are nearly as near
    and not hidden behind one already chosen."""
    d = np.sqrt(np.maximum(2 - 2 * x @ centroids.T, 0.0))
    order = np.argsort(d, axis=1)[:, : 4 * replicas]
    lists, rows = [], []
    for i in range(len(x)):
        chosen: list[int] = []
        for c in order[i].tolist():
            if chosen and (d[i, c] > boundary * d[i, chosen[0]] or len(chosen) == replicas):
                break
            if all(np.sqrt(max(2 - 2 * float(centroids[c] @ centroids[e]), 0.0)) >= d[i, c] for e in chosen):
                chosen.append(c)
        lists += chosen
        rows += [i] * len(chosen)
    return lists, rows


def _assign(centroids: np.ndarray, replicas: int, boundary: float):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lists, rows = _choose(_normal(_unit(batch, 1)), centroids, replicas, boundary)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["list", "class_id", "vector"])

    return run


def _route(centroids: np.ndarray, graph: np.ndarray, ratio: float, sizes: np.ndarray, least: int):
    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists, rows = [], []
            for i, q in enumerate(_normal(_unit(batch, 1))):
                found = walk(q, centroids, graph, ratio, sizes, least)
                lists += found
                rows += [i] * len(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["list", "class_id", "vector"])

    return run


def _fit_division(key: tuple, table: pa.Table) -> pa.Table:
    """Centroids of one long list, from a share of its vectors."""
    x = _normal(np.stack([np.frombuffer(v.as_py(), "<f8") for v in table.column("vector")]))
    k = max(1, len(x) * DIVIDE_EVERY // LIST_SIZE)
    return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "centroids": pa.array([balanced_centroids(x, min(k, len(x)), 5).tobytes()], pa.binary())})


_DIVIDED = "list int, sub int, class_id long, vector binary"


def _divide(width: int, ratio: float | None, least: int):
    """Runs of (list, salt), the list's centroids first: each vector with its divisions (ratio None), or each query with those to read."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centroids, sizes = None, None, None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            lists, salts = (batch.column(k).to_pylist() for k in (0, 1))
            n = len(batch)
            cuts = [0, *(i for i in range(1, n) if (lists[i], salts[i]) != (lists[i - 1], salts[i - 1])), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (lists[a], salts[a]) != at:
                    at, centroids = (lists[a], salts[a]), None
                if (raw := batch.column(4)[a].as_py()) is not None:
                    centroids = np.frombuffer(raw, "<f8").reshape(-1, width)
                    sizes = np.array(batch.column(5)[a].as_py() or [0] * len(centroids))
                    a += 1
                if a == b:
                    continue
                x = _unit(batch.slice(a, b - a), 3)
                if centroids is None:
                    subs, rows = [0] * len(x), list(range(len(x)))
                elif ratio is None:
                    subs, rows = _choose(_normal(x), centroids, 2, BOUNDARY)
                else:
                    d = np.sqrt(np.maximum(2 - 2 * _normal(x) @ centroids.T, 0.0))
                    picked = [_enough(sorted(zip(row.tolist(), range(len(row)), strict=True)), ratio, sizes, least) or list(range(len(row))) for row in d]
                    subs, rows = [s for p in picked for s in p], [i for i, p in enumerate(picked) for _ in p]
                out[0].extend([lists[a]] * len(subs))
                out[1].extend(subs)
                out[2].extend(batch.column(2)[a + i].as_py() for i in rows)
                out[3].extend(batch.column(3)[a + i].as_py() for i in rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["list", "sub", "class_id", "vector"])

    return run


def _rank(k: int):
    """Runs of (list, sub, piece), its vectors before its queries: each query's best classes there."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, matrix, norms = None, [], [], None, None
        names = ["query_class", "class_id", "score"]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for list_id, sub, piece, is_query, class_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (list_id, sub, piece) != at:
                    at, ids, vectors, matrix = (list_id, sub, piece), [], [], None
                x = np.frombuffer(raw, "<f8")
                if not is_query:
                    ids.append(class_id)
                    vectors.append(x)
                    continue
                if matrix is None:
                    matrix, keys = np.array(vectors), np.array(ids)
                    norms = np.linalg.norm(matrix, axis=1) if len(matrix) else None
                if not len(matrix):
                    continue
                scores = (matrix @ x) / (norms * np.linalg.norm(x))
                best = np.lexsort((keys, -scores))[: k + _KEEP]
                out[0].extend([class_id] * len(best))
                out[1].extend(keys[best].tolist())
                out[2].extend(scores[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, ratio: float = RATIO, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row (vec_id divisible by `every`).
    vectors has vec_id and embedding."""
    spark = vectors.sparkSession
    runtime.bounded_batches(spark)
    tables = runtime.Tables(spark)
    valid = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(_packed, "vec_id long, vector binary")
    rows = tables.write(valid, "vectors")
    length = rows.groupBy(F.octet_length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.octet_length("vector") == length["bytes"])
    classes = tables.write(rows.groupBy("vector").agg(F.min("vec_id").alias("class_id")), "classes")
    in_class = rows.join(classes, "vector").select("class_id", "vec_id").distinct()
    # the smallest ids of each class, in two steps so that a large class is not one task's work
    salted = in_class.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("class_id", "salt").orderBy("vec_id"))).where(F.col("n") <= k + _KEEP)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("class_id").orderBy("vec_id"))).where(F.col("n") <= k + _KEEP).select("class_id", "vec_id")

    drawn = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(sample).select("vector").collect()
    points = _normal(np.stack([np.frombuffer(r["vector"], "<f8") for r in drawn]))
    n_lists = int(min(MOST_CENTROIDS, max(1, classes.count() // LIST_SIZE), max(1, len(points) // 8)))
    centroids = balanced_centroids(points, n_lists)
    graph = neighbour_graph(centroids) if n_lists > 1 else np.zeros((1, 1), np.int64)

    postings = tables.write(classes.select("class_id", "vector").mapInArrow(_assign(centroids, REPLICAS, BOUNDARY), "list int, class_id long, vector binary"), "postings")
    sizes = np.zeros(n_lists, np.int64)
    for r in postings.groupBy("list").count().collect():  # one row per centroid
        sizes[r["list"]] = r["count"]
    # a class stands in REPLICAS lists at most, and in two divisions of each
    least = REPLICAS * (k + _KEEP)
    asked = in_class.where(F.col("vec_id") % every == 0)
    queries = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vector")
    routed = queries.mapInArrow(_route(centroids, graph, ratio, sizes, least), "list int, class_id long, vector binary")
    long = {int(c): int(n) for c, n in enumerate(sizes) if n > LONG}
    if long:
        postings, routed = _divided(postings, routed, long, length["bytes"] // 8, ratio, 2 * least, tables)
    else:
        postings, routed = (f.select("list", F.lit(0).alias("sub"), "class_id", "vector") for f in (postings, routed))
    place = ["list", "sub"]
    split = postings.groupBy(*place).agg(F.ceil(F.count("*") / (LIST_LIMIT // 2)).cast("int").alias("pieces"))
    entries = postings.join(split, place).select(*place, F.pmod(F.xxhash64("class_id"), F.col("pieces").cast("long")).cast("int").alias("piece"), F.lit(False).alias("is_query"), "class_id", "vector")
    seekers = routed.join(split, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("is_query"), "class_id", "vector")
    met = entries.union(seekers).repartition(runtime.parallelism(spark), *place, "piece").sortWithinPartitions(*place, "piece", "is_query", "class_id")
    found = met.mapInArrow(_rank(k), "query_class long, class_id long, score double").groupBy("query_class", "class_id").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id"))).where(F.col("n") <= k + _KEEP)
    answers = best.join(few, "class_id").select("query_class", "vec_id", "score")
    pairs = asked.select(F.col("class_id").alias("query_class"), F.col("vec_id").alias("query_id")).join(answers, "query_class").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return tables.last(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def _divided(postings: DataFrame, routed: DataFrame, long: dict[int, int], width: int, ratio: float, least: int, tables: runtime.Tables) -> tuple[DataFrame, DataFrame]:
    """postings and routed queries with the division of their list (sub; 0 in lists that are not long)."""
    spark = postings.sparkSession
    parts, in_long = runtime.parallelism(spark), F.col("list").isin(*long)
    share = postings.where(in_long & (F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(DIVIDE_EVERY)) == 0))
    fitted = tables.write(share.groupBy("list").applyInArrow(_fit_division, "list int, centroids binary"), "divisions")
    salts = F.broadcast(spark.createDataFrame([(c, max(1, n // LIST_LIMIT)) for c, n in long.items()], "list int, salts int"))
    none, no_sizes = F.lit(None).cast("binary"), F.lit(None).cast("array<long>")

    def dealt(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Every (list, salt) with the list's centroids first."""
        own = rows.where(in_long).join(salts, "list").select("list", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), "class_id", "vector", none.alias("centroids"), no_sizes.alias("sizes"))
        first = heads.join(salts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("class_id"), none.alias("vector"), "centroids", "sizes")
        return first.union(own).repartition(parts, "list", "salt").sortWithinPartitions("list", "salt", F.col("centroids").isNull())

    plain = lambda rows: rows.where(~in_long).select("list", F.lit(0).alias("sub"), "class_id", "vector")
    divided = tables.write(dealt(postings, fitted.withColumn("sizes", no_sizes)).mapInArrow(_divide(width, None, least), _DIVIDED), "divided")
    counts = divided.groupBy("list", "sub").count().groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("sub", "count"))).alias("counts"))
    heads = fitted.join(counts, "list").select("list", "centroids", F.transform(F.sequence(F.lit(0), (F.octet_length("centroids") / (8 * width) - 1).cast("int")), lambda i: F.coalesce(F.element_at("counts", i), F.lit(0).cast("long"))).alias("sizes"))
    return plain(postings).union(divided), plain(routed).union(dealt(routed, heads).mapInArrow(_divide(width, ratio, least), _DIVIDED))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    keys = ["query_id", "vec_id"]
    return found.join(exact.select(*keys), keys, "left_semi").count() / max(1, exact.count())

"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target number of words by its weight, at most `cap` times what it has; the
excess is shared again by weight (water filling). Within a source the documents stand in a
shuffled order that depends on doc_id alone. Every copy of a document has a virtual finish time,
the source's words up to its end divided by the source's target; all copies are sorted by it
over the whole corpus and cut at the total budget.

Running sums are made in two steps (inside range partitions, then over one total per partition
and source), so that no source is gathered in one task.

Defined results: a null or empty text has size 0 and takes nothing; the null source comes last and
weighs like any other; repeated rows count one by one; an empty table gives an empty mix; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
BROADCAST_ROWS = 500_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: its size, place and target. Water filling over the sources in the order
    in which they reach their caps."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    limit = F.lit(float(cap)) * F.col("source_size")
    full_first = Window.orderBy(limit / F.col("weight"), "place")
    before, every = full_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # the level of the water if exactly the sources before this one are full
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= limit)
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), limit).otherwise(F.col("weight") * water)
    return sources.select("source", "place", "source_size", target.alias("target"))


def _local_sums(group: int, value: int):
    """Appends the running sum of column value within runs of equal column group (all rows, if -1), and the partition."""

    @runtime.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.zeros(n, np.int64) if group < 0 else batch.column(group).to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            sums = np.cumsum(values)
            starts = np.flatnonzero(first)
            base = np.where(starts > 0, sums[starts - 1], 0)
            if carried is not None and keys[0] == carried:
                base[0] = -total
            sums = sums - np.repeat(base, np.diff(np.append(starts, n)))
            carried, total = keys[-1], int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(np.full(n, part, np.int32))], [*batch.schema.names, "local_sum", "part"])

    return run


def _few(frame: DataFrame) -> DataFrame:
    """frame, to be broadcast if a bounded count shows that it is short."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def running_sums(rows: DataFrame, order: list[str], value: str, tables: runtime.Tables, group: str | None = None) -> DataFrame:
    """rows with running_sum: the sum of value over the rows of the group up to this one, in the given order
    (which begins with the group). Range partitions, sums inside each, then one total per partition and group."""
    runtime.bounded_batches(rows.sparkSession)
    ordered = rows.repartitionByRange(runtime.parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    sums = tables.write(ordered.mapInArrow(_local_sums(rows.columns.index(group) if group else -1, rows.columns.index(value)), f"{kinds}, local_sum long, part int"), "running_sums")
    keys = [group] if group else []
    totals = sums.groupBy("part", *keys).agg(F.sum(value).alias("own"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as range partitions and groups together
    totals = tables.write(totals.select("part", *keys, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base")), "totals")
    return sums.join(_few(totals), ["part", *keys]).select(*rows.columns, (F.col("base") + F.col("local_sum")).alias("running_sum"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies (0 to cap), taken (copies times size)."""
    tables = runtime.Tables(docs.sparkSession)
    sizes = tables.write(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    targets = tables.write(source_targets(sizes, weights, share, cap), "targets")
    places = targets.select("source", "place", "source_size", "target")
    keyed = sizes.join(_few(places), sizes["source"].eqNullSafe(places["source"])).select("place", shuffle_key(F.col("doc_id"), seed).alias("key"), "doc_id", "size", "source_size", "target")
    queued = runtime.stage(running_sums(keyed, ["place", "key", "doc_id", "size"], "size", tables, "place"), "queued")
    finish = (F.col("round") * F.col("source_size") + F.col("running_sum")) / F.col("target")
    copies = queued.where("target > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).where(F.col("round") * F.col("source_size") < F.col("target"))
    moment = ["finish", "place", "round", "key", "doc_id"]
    copies = copies.select(finish.alias("finish"), "place", "round", "key", "doc_id", "size")
    budget = targets.agg((F.lit(float(share)) * F.sum("source_size")).alias("budget"))
    last = runtime.stage(running_sums(copies, moment, "size", tables).crossJoin(F.broadcast(budget)).where("running_sum <= budget").agg(F.max(F.struct(*moment)).alias("last")), "last")
    runtime.delete(docs.sparkSession, tables.folder)
    kept = sum((F.coalesce(F.struct(((F.lit(r) * F.col("source_size") + F.col("running_sum")) / F.col("target")).alias("finish"), F.col("place"), F.lit(r).alias("round"), F.col("key"), F.col("doc_id")) <= F.col("last"), F.lit(False)) & (F.lit(r) * F.col("source_size") < F.col("target"))).cast("int") for r in range(cap))
    kept = F.when((F.col("target") > 0) & (F.col("size") > 0), kept).otherwise(F.lit(0))
    return queued.crossJoin(F.broadcast(last)).select("doc_id", "size", "source_size", "target", kept.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the plan takes it; rows that share a doc_id share its most copies."""
    copies = plan.where("copies > 0").groupBy(F.col("doc_id").alias("planned")).agg(F.max("copies").alias("copies"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = whole.join(copies, F.col("doc.doc_id").eqNullSafe(F.col("planned")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")

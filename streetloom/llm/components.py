"""Connected components of a link table, without gathering it on the driver.

Each round every node looks at itself and its neighbours and follows the one that stands first in
an order drawn anew for the round; links are then contracted to whom their ends follow. The drawn
order makes long chains shrink by a constant factor a round. Every round is written to the shared
folder, which cuts the lineage, and replaces the tables of the round before. As soon as no more
than ONE_TASK links are left (16 bytes each), one task of an executor finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


#: Links that one task may hold.
ONE_TASK = 1_000_000


@runtime.lean
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of links that fit into one task: the least label spreads, labels jump to their own labels."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not held:
        return
    nodes, codes = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = codes.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def components(links: DataFrame, tables: runtime.Tables) -> DataFrame:
    """node, component (its smallest node) of all nodes of links(a, b); a link to itself only names a node."""
    few = lambda frame: frame.limit(ONE_TASK + 1).count() <= ONE_TASK
    finish = lambda frame: frame.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, component long")
    every = tables.write(links.select("a", "b").distinct(), "links")
    if few(every):
        found = tables.write(finish(every), "components")
        tables.drop(every)
        return found
    nodes = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
    member = tables.write(nodes.select("node", F.col("node").alias("leader")), "leaders")
    # the round is a column and no literal: all rounds are then one and the same compiled code
    edges, old = every.where("a <> b").withColumn("step", F.lit(0)), every
    while not few(edges):
        both = edges.union(edges.select("b", "a", "step"))
        rank = lambda c: F.struct(F.xxhash64("step", c).alias("rank"), F.col(c).alias("node"))
        follow = both.groupBy("a", "step").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["node"].alias("follows"))
        follow = tables.write(follow, "follow")
        left = edges.join(follow, edges["a"] == follow["node"]).select(F.col("follows").alias("x"), "b", "step")
        moved = left.join(follow, left["b"] == follow["node"]).select(F.least("x", "follows").alias("a"), F.greatest("x", "follows").alias("b"), (F.col("step") + 1).alias("step"))
        edges = tables.write(moved.where("a <> b").distinct(), "links")
        further = tables.write(member.join(follow.select(F.col("node").alias("leader"), "follows"), "leader", "left").select("node", F.coalesce("follows", "leader").alias("leader")), "leaders")
        tables.drop(old, member, follow)
        old, member = edges, further
    rest = tables.write(finish(edges), "rest")
    placed = member.join(rest.withColumnRenamed("node", "leader"), "leader", "left").select("node", F.coalesce("component", "leader").alias("leader"))
    least = placed.groupBy("leader").agg(F.min("node").alias("component"))
    found = tables.write(placed.join(least, "leader").select("node", "component"), "components")
    tables.drop(old, member, rest)
    return found

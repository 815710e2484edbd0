"""Weighted and uniform draws that depend on a seed and row keys only.

Every draw is a hash of (seed, keys), so it does not matter how rows are partitioned, and SQL can
make the same draws.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.functions import exprs as X
from streetloom.operators.ranks import numbered, running


@dataclass(frozen=True)
class Parameters:
    """Parameters of demand sampling, checked."""

    preprocessing_nodes: int = 1000
    n_origins: int = 400
    destinations_per_origin: int = 200
    daily_km: float = 250_000.0
    log_mu: float = X.LOG_MU
    log_sigma: float = X.LOG_SIGMA
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.preprocessing_nodes, self.n_origins, self.destinations_per_origin) < 1 or not (0 < self.daily_km < float("inf")) or not (0 < self.log_sigma < float("inf")):
            raise ValueError("sampling parameters must be positive")


def weighted_nodes(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of nodes(node_id, weight) without replacement: the smallest exponential clocks."""
    clock = -F.log(1 - X.uniform(seed, F.col("node_id"))) / F.col("weight")
    return nodes.where("weight > 0").withColumn("clock", clock).orderBy("clock", "node_id").limit(n).drop("clock")


def weighted_draws(choices: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """For each group, n draws with replacement from choices(group, item, weight): inverse of the running
    weight. Groups without weight give none."""
    shares = running(choices.where("weight > 0"), group, "item", "weight", "upto")
    totals = shares.groupBy(group).agg(F.max("upto").alias("total"))
    draws = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", X.uniform(seed, F.col(group), F.col("draw")) * F.col("total"))
    return located(draws, shares, group).select(group, "draw", "item")


def located(draws: DataFrame, shares: DataFrame, group: str, blocks: int = 1024) -> DataFrame:
    """draws(group, at) with the item whose span [upto_before, upto) holds at. Spans and draws meet in equal slices of
    the group's total, so a draw is compared with the few items of its slice and not with all of its group."""
    cell = lambda c: F.least(F.floor(F.col(c) / F.col("total") * blocks), F.lit(blocks - 1))
    sized = shares.join(draws.select(group, "total").distinct(), group)
    spread = sized.withColumn("cell", F.explode(F.sequence(cell("upto_before"), cell("upto")))).select(group, "cell", "item", "upto_before", "upto")
    return draws.withColumn("cell", cell("at")).join(spread, [group, "cell"]).where("at >= upto_before AND at < upto")


def radius_nodes(nodes: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Nodes within km of a point; all nodes if that leaves fewer than two."""
    near = nodes.where(X.planar_km(F.col("y"), F.col("x"), F.lit(lat), F.lit(lon)) <= km)
    return near if near.limit(2).count() == 2 else nodes


def random_pairs(nodes: DataFrame, n: int, seed: int, least_km: float = 0.3, tries: int = 10) -> DataFrame:
    """Up to n pairs of nodes at least least_km apart, each from at most `tries` draws."""
    ranked = numbered(nodes.select("node_id", "x", "y"), ["node_id"], "place")
    total = ranked.agg(F.count("*").alias("n"))
    spark = nodes.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "pair_id").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).crossJoin(F.broadcast(total))
    pick = lambda k: F.floor(X.uniform(seed, F.col("pair_id"), F.col("attempt"), F.lit(k)) * F.col("n"))
    draws = draws.withColumn("a", pick(0)).withColumn("b", pick(1))
    ends = lambda s: ranked.select(F.col("place").alias(s), F.col("node_id").alias(f"node_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    joined = draws.join(ends("a"), "a").join(ends("b"), "b").where(X.planar_km(F.col("y_a"), F.col("x_a"), F.col("y_b"), F.col("x_b")) >= least_km)
    return joined.groupBy("pair_id").agg(F.min_by(F.struct("node_a", "node_b"), "attempt").alias("p")).select("pair_id", F.col("p.node_a").alias("origin"), F.col("p.node_b").alias("destination"))


def distinct_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The first n different pairs, each at its first draw."""
    return pairs.groupBy("origin", "destination").agg(F.min("pair_id").alias("pair_id")).orderBy("pair_id").limit(n)


def subsample(frame: DataFrame, most: int, seed: int, key: str) -> DataFrame:
    """At most so many rows, drawn by hash of their key."""
    return frame.withColumn("_u", X.uniform(seed, F.col(key))).orderBy("_u", key).limit(most).drop("_u")


def destination_choices(times: DataFrame, weights: DataFrame, mu: float = X.LOG_MU, sigma: float = X.LOG_SIGMA) -> DataFrame:
    """times(origin, node, distance) and weights(node, weight) to choices(origin, item, weight)."""
    joined = times.where("origin <> node").join(weights, "node")
    return joined.select("origin", F.col("node").alias("item"), (F.col("weight") * X.lognormal_density(F.col("distance"), mu, sigma)).alias("weight"))

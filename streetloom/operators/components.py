"""Clusters: seed groups and connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.operators.stages import stage


def components(links: DataFrame) -> DataFrame:
    """node, component of links(a, b): the smallest node that can be reached. Each round a node takes the
    smallest label around it and then that label's own label, so labels jump and rounds stay few."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stage(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stage(least.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def seed_groups(habitats: DataFrame) -> DataFrame:
    """road_id, prefix, cluster of groups of one road and code prefix that have both sides."""
    sided = habitats.withColumn("prefix", F.substring("code", 1, 3)).withColumn("side", F.when(F.col("road_x") < F.col("area_x"), "left").otherwise("right"))
    both = sided.groupBy("road_id", "prefix").agg(F.count_distinct("side").alias("sides"), F.min("poly_id").alias("cluster")).where("sides = 2")
    return both.select("road_id", "prefix", "cluster")

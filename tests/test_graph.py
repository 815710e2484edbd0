"""Kernels against brute force: paths, betweenness, scenarios, planning, components."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streetloom.functions import exprs as X
from streetloom.operators import components, network, paths, planning, sampling, scenario
from streetloom.sources import fixtures

SF = "/root/testdata/sf0.001"


def random_edges(seed, n=14, m=45):
    rng = random.Random(seed)
    return pd.DataFrame([(rng.randrange(n) * 3, rng.randrange(n) * 3, rng.randint(1, 5)) for _ in range(m)], columns=["u", "v", "weight"]).query("u != v")


def all_pairs(edges):
    ids = sorted(set(edges.u) | set(edges.v))
    d = {(a, b): 0 if a == b else np.inf for a in ids for b in ids}
    for u, v, w in edges.itertuples(index=False):
        d[u, v] = min(d[u, v], w)
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return ids, d


@pytest.mark.parametrize("seed", range(5))
def test_search_matches_floyd_warshall(seed):
    edges = random_edges(seed)
    ids, want = all_pairs(edges)
    net = paths.Network(edges)
    for a in ids:
        far, before, _ = net.search(net.index(a))
        for b in ids:
            assert far[net.index(b)] == want[a, b]
            at, length = net.index(b), 0
            while before[at] >= 0:
                length += edges[(edges.u == net.ids[before[at]]) & (edges.v == net.ids[at])].weight.min()
                at = before[at]
            if np.isfinite(want[a, b]):
                assert length == want[a, b]


def test_distances_and_relaxation_agree(spark):
    edges = spark.createDataFrame(random_edges(9)).select("u", "v", F.col("weight").alias("w"))
    origins = spark.createDataFrame([(0,), (6,), (999,)], "origin long")
    a = {(r.origin, r.node): r.distance for r in paths.distances(origins, edges, "w").collect()}
    b = {(r.origin, r.node): r.distance for r in paths.relaxed_distances(origins, edges, "w").collect() if r.origin != 999}
    assert a == b


def test_networks_too_large_to_send_give_the_same(spark, monkeypatch):
    edges = spark.createDataFrame(random_edges(4)).select("u", "v", F.col("weight").alias("w"))
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(itertools.product((0, 6, 9), (3, 6, 15, 30, 999)))], "pair_id long, origin long, destination long")
    origins, goals = pairs.select("origin").distinct(), pairs.select(F.col("destination").alias("node"))
    rows = lambda: ({(r.pair_id, r.cost, tuple(r.path)) for r in paths.shortest_paths(pairs, edges, "w").collect()}, *({(r.u, r.v): pytest.approx(r.betweenness) for r in paths.betweenness(origins, edges, "w", t).collect() if r.betweenness} for t in (None, goals)))
    sent = rows()
    monkeypatch.setattr(paths, "MOST_EDGES", 2)
    assert paths.sent(edges, "w") is None
    for one, other in zip(sent, rows(), strict=True):
        assert one and (one == other if isinstance(one, set) else {k: v.expected for k, v in one.items()} == other)


def test_speeds_that_are_not_positive_are_missing(spark):
    edges = spark.createDataFrame([(1, 2, 0, 100.0, 0.0, 1), (2, 1, 0, 100.0, None, 1), (1, 3, 0, 100.0, -5.0, 1), (3, 1, 0, 0.0, 50.0, 1)], "u long, v long, key int, length_m double, speed_kph double, lanes int")
    nodes = spark.createDataFrame([(1, 400.0), (2, 400.0), (3, None)], "node_id long, elevation double")
    for r in network.edge_metrics(edges, nodes).collect():
        assert r.time_s == pytest.approx(12.0 if r.length_m else 0.0) and r.co2_g == pytest.approx(0.1 * 203.6 if r.length_m else 0.0)
    one = edges.limit(1).select(X.edge_co2(F.lit(100.0), F.lit(0.0), F.lit(0.0), F.lit(7.2)).alias("g"), X.free_flow_time(F.lit(5.0), F.lit(0.0)).alias("none")).first()
    assert one.g == pytest.approx(17.8) and one.none is None
    assert scenario.timed(edges).where("time_s IS NULL").count() == 0


def test_betweenness_matches_counting_all_shortest_paths(spark):
    edges = random_edges(3)
    ids, d = all_pairs(edges)
    best = edges.groupby(["u", "v"]).weight.min()
    ways = {}

    def count(a, b):
        if (a, b) not in ways:
            ways[a, b] = 1 if a == b else sum(count(a, u) for (u, v), w in best.items() if v == b and np.isfinite(d[a, u]) and d[a, u] + w == d[a, b] and d[a, u] < d[a, b])
        return ways[a, b]

    want = {}
    for s in ids[:6]:
        for t in ids:
            if s != t and np.isfinite(d[s, t]):
                for (u, v), w in best.items():
                    if np.isfinite(d[s, u]) and d[s, u] + w + d[v, t] == d[s, t]:
                        want[u, v] = want.get((u, v), 0) + count(s, u) * count(v, t) / count(s, t)
    frame = spark.createDataFrame(edges).withColumnRenamed("weight", "w")
    got = {(r.u, r.v): r.betweenness for r in paths.betweenness(spark.createDataFrame([(int(s),) for s in ids[:6]], "origin long"), frame, "w").collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_scenario_invariants(spark):
    edges, nodes, pairs = fixtures.road_edges(spark, SF), fixtures.road_nodes(spark, SF), fixtures.od_pairs(spark, SF).limit(60).cache()
    mods = fixtures.edge_mods(spark, SF)
    none = scenario.recalculate(pairs, edges, nodes, mods.limit(0))
    assert none["usage_after"].where("delta_count <> 0").count() == 0
    assert none["impact"].first()["rerouted"] == 0
    some = scenario.recalculate(pairs, edges, nodes, mods)
    steps = network.route_edges(some["routes"]).count()
    assert some["usage_after"].agg(F.sum("count")).first()[0] == steps
    once = network.apply_modifications(edges, mods)
    assert network.apply_modifications(once, mods).drop("modified").exceptAll(once.drop("modified")).count() == 0
    volumes = paths.normalised(paths.betweenness(pairs.select("origin").distinct(), edges, "length_m"), edges, 1000.0).join(network.first_edges(edges), ["u", "v"])
    assert volumes.agg(F.sum(F.col("volume") * F.col("length_m"))).first()[0] == pytest.approx(1_000_000)


def test_collection_plan_serves_everyone_once_within_capacity():
    rng = np.random.default_rng(1)
    at = rng.uniform(0, 100, (18, 2))
    matrix = np.linalg.norm(at[:, None] - at[None], axis=2)
    demand = np.array([0, *rng.integers(5, 40, 17)])
    problem = planning.Problem(vehicles=2, capacity=100)
    routes = planning.solve(matrix, demand, problem)
    served = [c for v in routes for t in v for c in t]
    assert sorted(served) == list(range(1, 18))
    assert all(demand[t].sum() <= 100 for v in routes for t in v)
    length = sum(sum(matrix[a, b] for a, b in zip([0, *t], [*t, 0])) for v in routes for t in v)
    assert length <= 2 * matrix[0, 1:].sum()


def test_components_of_long_chain_and_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_golden_emissions(spark):
    rows = spark.createDataFrame([(30.0,), (50.0,), (70.0,), (100.0,), (130.0,), (0.0,)], "v double")
    got = [round(r[0], 3) for r in rows.select(X.co2_per_km(F.col("v"))).collect()]
    assert got == [203.6, 178.0, 173.886, 184.0, 206.062, 2520.0]
    edge = rows.limit(1).select(X.edge_co2(F.lit(500.0), F.lit(50.0), F.lit(20.0), F.lit(None).cast("double")), X.edge_co2(F.lit(0.0), F.lit(50.0), F.lit(20.0), F.lit(1.0))).first()
    assert round(edge[0], 6) == 106.8 and edge[1] == 0


def test_draws_are_stable_and_weighted(spark):
    choices = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (0, 3, 0.0), (1, 9, 0.0)], "g int, item long, weight double")
    rows = sampling.weighted_draws(choices, "g", 4000, 5)
    counts = {r.item: r.n for r in rows.groupBy("item").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {1, 2} and sum(counts.values()) == 4000 and 0.7 < counts[2] / 4000 < 0.8
    assert rows.repartition(3).exceptAll(sampling.weighted_draws(choices.repartition(2), "g", 4000, 5)).count() == 0

"""Work that once grew with the steps of all routes, or gathered the network on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.operators import paths


def _grid(spark, side=6):
    rng = np.random.default_rng(5)
    ends = [(k, k + s) for k in range(side * side) for s in (1, side) if (s == side or k % side < side - 1) and k + s < side * side]
    rows = [(u, v, float(rng.integers(1, 9)), float(u + 2 * v)) for a, b in ends for u, v in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "u long, v long, w double, x double")


def test_the_driver_holds_no_rows_of_the_network(spark, monkeypatch):
    edges = _grid(spark)
    monkeypatch.setattr(type(edges), "toPandas", lambda self: pytest.fail("the network was gathered as rows"))
    monkeypatch.setattr(paths, "PIECE_EDGES", 7)
    token, columns, pieces = paths.sent(edges, "w").value
    assert columns == ["u", "v", "weight"] and pieces and all(isinstance(c, bytes) for p in pieces for c in p)
    origins = spark.createDataFrame([(0,), (17,)], "origin long")
    got = {(r.origin, r.node): r.distance for r in paths.distances(origins, edges, "w").collect()}
    assert got == {(r.origin, r.node): r.distance for r in paths.relaxed_distances(origins, edges, "w").collect()}


def test_searches_stop_at_the_targets(spark, monkeypatch):
    edges, origins, few = _grid(spark), spark.createDataFrame([(0,), (17,)], "origin long"), spark.createDataFrame([(3,), (8,), (99,)], "node long")
    want = {(r.origin, r.node): r.distance for r in paths.relaxed_distances(origins, edges, "w").where("node IN (3, 8)").collect()}
    for most in (100, 0):
        monkeypatch.setattr(paths, "MOST_GOALS", most)
        assert {(r.origin, r.node): r.distance for r in paths.distances(origins, edges, "w", few).collect()} == want


def test_sums_along_paths_without_the_paths(spark, monkeypatch):
    edges = _grid(spark).union(_grid(spark).where("u % 5 = 0").withColumn("w", F.col("w") + 1))
    pairs = spark.createDataFrame([(k, k % 4 * 9, (k * 7) % 38) for k in range(90)], "pair_id long, origin long, destination long")
    values = _grid(spark).where("u % 7 <> 3").select("u", "v", "x")
    x = {(r.u, r.v): r.x for r in values.collect()}
    want = {r.pair_id: (r.cost, r.path[0], r.path[-1], sum(x.get(s, 0.0) for s in zip(r.path, r.path[1:], strict=False))) for r in paths.shortest_paths(pairs, edges, "w").collect()}
    for most in (10**6, 2):
        monkeypatch.setattr(paths, "MOST_EDGES", most)
        got = {r.pair_id: (r.cost, r.first, r.last, r.x) for r in paths.path_sums(pairs, edges, "w", values).collect()}
        assert got == want and len(got) > 60


def _random_runs(spark, monkeypatch):
    from streetloom.operators import runs

    monkeypatch.setattr(runs, "BLOCK", 4)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        seq, at = 0, int(rng.integers(0, 400))
        for _ in range(int(rng.integers(1, 4))):
            stride, n = int(rng.choice([1, -1, 20, -20])), int(rng.integers(0, 25))
            rows.append((k, seq, at, stride, n))
            seq, at = seq + n, at + stride * n
    own = spark.createDataFrame(rows, "route_id long, seq long, start long, stride long, n long")
    made = own.select("route_id", runs.run(F.col("seq"), F.col("start"), F.col("stride"), F.col("n")).alias("r")).select("route_id", "r.*")
    steps = [(k, seq + i, at + i * s, at + (i + 1) * s) for k, seq, at, s, n in rows for i in range(n)]
    assert sorted(map(tuple, runs.steps(made).collect())) == sorted(steps)
    return runs, made, steps


def test_runs_count_like_their_steps(spark, monkeypatch):
    runs, made, steps = _random_runs(spark, monkeypatch)
    for found, kept in ((runs.counts(made), steps), (runs.every_other(made), [s for s in steps if s[1] % 2 == 0])):
        want = {}
        for _, _, u, v in kept:
            want[u, v] = want.get((u, v), 0) + 1
        got = found.collect()
        assert {(r.u, r.v): r["count"] for r in got} == want and len(got) == len(want)


def test_runs_give_the_extreme_routes(spark, monkeypatch):
    runs, made, steps = _random_runs(spark, monkeypatch)
    got = {(r.u, r.v): (r.first_route, r.last_route) for r in runs.extremes(made).collect()}
    want = {}
    for k, _, u, v in steps:
        lo, hi = want.get((u, v), (k, k))
        want[u, v] = (min(lo, k), max(hi, k))
    assert got == want


def test_runs_find_the_first_marked_step(spark, monkeypatch):
    runs, made, steps = _random_runs(spark, monkeypatch)
    marks = {(u, v) for _, _, u, v in steps if (u * 7 + v) % 11 == 0}
    found = runs.first_hits(made, spark.createDataFrame(sorted(marks), "u long, v long")).collect()
    want = {}
    for k, seq, u, v in steps:
        if (u, v) in marks and seq < want.get(k, (10**9,))[0]:
            want[k] = (seq, u, v)
    got = {}
    for r in found:
        got[r.route_id] = min(got.get(r.route_id, (10**9,)), (r.seq, r.u, r.v))
    assert got == want and len(want) > 5


def test_runs_add_up_what_their_steps_hold(spark, monkeypatch):
    runs, made, steps = _random_runs(spark, monkeypatch)
    x = {(u, v): 1e6 / 3 + u * 0.1 for _, _, u, v in steps if (u + v) % 5}
    got = {r.route_id: r.x for r in runs.sums(made, spark.createDataFrame([(*e, y) for e, y in x.items()], "u long, v long, x double")).collect()}
    want = {}
    for k, _, u, v in steps:
        want[k] = want.get(k, 0.0) + x.get((u, v), 0.0)
    assert got == pytest.approx(want, rel=1e-14) and len(got) == len(want)


def test_runs_carry_what_their_steps_carry(spark, monkeypatch):
    from streetloom.operators import network

    runs, made, steps = _random_runs(spark, monkeypatch)
    every, want, at_zero = 7, {}, sum(1 for s in steps if s[2] == 0)
    load = dict.fromkeys({s[0] for s in steps}, 0)
    for k, seq, u, v in sorted(steps):
        load[k] = 0 if u == 0 or seq % every == 0 else load[k] + u % 9
        want[u, v] = want.get((u, v), 0) + load[k]
    found = runs.loads(made, every, lambda u: F.pmod(u, F.lit(9))).collect()
    assert {(r.u, r.v): r.load for r in found} == want and len(found) == len(want) and at_zero
    edges = spark.createDataFrame([(1, 2, 0, 5), (1, 2, 1, 3), (4, 3, 0, 2)], "u long, v long, key int, length_m long")
    carried = spark.createDataFrame([(1, 2, 10), (3, 4, 7), (8, 9, 1)], "u long, v long, load long")
    assert sorted(map(tuple, network.placed_loads(carried, edges, "kg_m").collect())) == [(1, 2, 1, 30), (4, 3, 0, 14)]


def test_runs_are_stitched_like_their_nodes(spark, monkeypatch):
    from streetloom.functions import geo

    runs, made, steps = _random_runs(spark, monkeypatch)
    paths_of: dict[int, list[int]] = {}
    for k, _, u, v in sorted(steps):
        paths_of.setdefault(k, [u]).append(v)
    rows = spark.createDataFrame([(k, [p[:4], p[3:]] if len(p) > 4 else [p]) for k, p in paths_of.items()], "route_id long, parts array<array<long>>")
    lines = rows.select("route_id", geo.stitched(F.col("parts")).alias("line")).collect()
    want = {r.route_id: (len(r.line), sum(r.line)) for r in lines}
    assert {r.route_id: r.line for r in lines} == paths_of
    assert {r.route_id: (r.nodes, r.code) for r in runs.stitched(runs.cut(made, 3 - F.col("seq"))).collect()} == want


def test_no_query_writes_out_the_steps_of_long_ways(spark, monkeypatch):
    from streetloom.operators import network
    from streetloom.plans import catalog
    from streetloom.sources import fixtures as S

    grown = lambda *a: pytest.fail("the steps of all routes were written out")
    monkeypatch.setattr(network, "route_edges", grown)
    monkeypatch.setattr(S, "grid_routes", grown)
    for name in "g05_congested_co2 g16_removed_middles j03_usage_deltas j04_volume_deltas j05_affected_routes j06_first_modification j18_display_rows w01_route_steps a02_routes_of_edges a03_route_metrics a04_maintained_counts a06_impact a07_elastic_totals a08_daily_volumes a28_robust_max".split():
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_loads_are_added_up_without_the_steps_of_long_ways(spark, monkeypatch):
    from streetloom.operators import network
    from streetloom.plans import catalog
    from streetloom.sources import fixtures as S

    grown = lambda *a: pytest.fail("the steps of all routes were written out")
    monkeypatch.setattr(network, "route_edges", grown)
    monkeypatch.setattr(S, "grid_routes", grown)
    for name in ("a14_load_summary", "g17_edge_loads", "o04_top_loads"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_lines_are_stitched_without_their_nodes(spark, monkeypatch):
    from streetloom.plans import catalog
    from streetloom.sources import fixtures as S

    monkeypatch.setattr(S, "grid_routes", lambda *a: pytest.fail("the nodes of all routes were written out"))
    assert catalog.queries()["f16_stitched_paths"](spark, "/root/testdata/sf0.001").columns

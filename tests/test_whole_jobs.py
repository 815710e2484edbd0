"""Queries that once left out part of their input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.operators import network, planning, ranks, sampling
from streetloom.plans import catalog, routing
from streetloom.sources import fixtures as S

SF = "/root/testdata/sf0.001"


def test_collection_plan_covers_all_demand(spark):
    rows = routing.c06_collection_plan(spark, SF).collect()
    want = S.centroids(spark, SF).groupBy("waste_type", (F.col("centroid_id") * 7 % 199).alias("node")).agg(F.sum("count").alias("n")).collect()
    assert sum(r.demand for r in rows) == sum(10 * r.n for r in want)
    assert len({(r.waste_type, r.location) for r in rows if r.location}) == len(want)


def test_large_demand_becomes_visits_and_the_rest_is_named(spark):
    problem = planning.Problem(vehicles=1, capacity=10, reloads=2)
    clients = spark.createDataFrame([("A", 1, 1, 25), ("A", 2, 2, 4), ("A", 3, 3, 6)], "waste_type string, location long, node long, demand long")
    visits = planning.visits(clients, problem).collect()
    assert sorted((r.area, r.location, r.demand) for r in visits) == [(0, 1, 5), (0, 1, 10), (0, 1, 10), (1, 2, 4), (1, 3, 6)]
    places = spark.createDataFrame([("A", r.location, r.demand) for r in visits if r.area == 0] + [("A", 0, 0), ("A", 7, 5)], "waste_type string, location long, demand long")
    arcs = spark.createDataFrame([("A", 0, 1, 3.0), ("A", 1, 0, 3.0)], "waste_type string, a long, b long, distance double")
    rows = planning.plan(places, arcs, problem).collect()
    assert sorted(r.demand for r in rows if r.location == 1) == [5, 10, 10] and all(r.route_id == 0 for r in rows if r.location == 1)
    assert [(r.location, r.demand) for r in rows if r.route_id is None] == [(7, 5)]


def test_nearest_node_of_far_points(spark):
    rng = np.random.default_rng(3)
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([6.5, 46.5], [6.53, 46.53], (40, 2)))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([6.3, 46.3], [6.7, 46.7], (60, 2)))]
    found = planning.snapped(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(nodes, "node_id long, x double, y double")).collect()
    want = {i: min(((((lat - y) * 111.0) ** 2 + ((lon - x) * 77.7) ** 2) ** 0.5, n) for n, x, y in nodes) for i, lon, lat in points}
    assert {r.id: r.node for r in found} == {i: n for i, (_, n) in want.items()} and len(found) == 60


def test_connectivity_takes_every_polygon(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    sql = catalog.oracle_sql()["a24_connectivity"]
    want = dict(db.execute(sql).fetchall())
    got = {r.kind: r.pc for r in catalog.queries()["a24_connectivity"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-9) and len(got) == len(want)


def test_ranks_and_sums_in_two_steps(spark):
    rows = [(k % 3, (k * 37) % 101, float(1 + k % 5)) for k in range(101)]
    frame = spark.createDataFrame(rows, "g long, item long, weight double").repartition(5)
    assert [r.item for r in ranks.numbered(frame, ["item"], "place").orderBy("place").collect()] == sorted(item for _, item, _ in rows)
    got = {(r.g, r.item): (r.upto_before, r.upto) for r in ranks.running(frame, "g", "item", "weight", "upto").collect()}
    for g in range(3):
        total = 0.0
        for _, item, weight in sorted(r for r in rows if r[0] == g):
            assert got[g, item] == (total, total + weight)
            total += weight
    assert ranks.numbered(frame.limit(0), ["item"], "place").count() == ranks.running(frame.limit(0), "g", "item", "weight", "upto").count() == 0


def test_every_draw_meets_one_item(spark):
    choices = spark.createDataFrame([(1, k, 0.1 + (k % 7) * 0.3) for k in range(400)] + [(2, 5, 1e-9), (3, 1, 0.0)], "origin long, item long, weight double")
    drawn = sampling.weighted_draws(choices, "origin", 300, 11).groupBy("origin").count().collect()
    assert {r.origin: r["count"] for r in drawn} == {1: 300, 2: 300}


def test_reload_policies_and_unreachable_legs(spark):
    stops = spark.createDataFrame([("r", 0, 0, 9, True), ("r", 0, 1, 4, False), ("r", 0, 2, 5, False), ("r", 0, 3, 9, True), ("r", 1, 1, 77, False)], "route_id string, trip_id long, pos long, node long, is_depot boolean")
    far = spark.createDataFrame([(9, 5, 8.0), (2, 5, 3.0), (9, 4, 1.0)], "depot long, node long, distance double")
    find = lambda policy: {(r.trip_id, r.last): r.depot for r in planning.reload_depots(stops, far, policy, 9).collect()}
    assert find("home_only") == {(0, 5): 9, (1, 77): 9} and find("all_depots") == {(0, 5): 2, (1, 77): None}
    with pytest.raises(ValueError):
        planning.reload_depots(stops, far, "nowhere")
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0)], "u long, v long, w double")
    legs = spark.createDataFrame([("r", 0, 0, 1, 3), ("r", 0, 1, 3, 1), ("r", 0, 2, 2, 2)], "route_id string, trip_id long, segment_id long, origin long, destination long")
    found = {r.segment_id: (r.cost, r.path) for r in planning.routed_segments(legs, edges, "w").collect()}
    assert found == {0: (10.0, [1, 2, 3]), 1: (None, []), 2: (0.0, [2])}


def test_moves_of_single_clients_shorten_the_plan():
    matrix = np.abs(np.subtract.outer(*[np.array([0.0, 10, 11, 12, -10, -11])] * 2))
    routes = [[1, 4], [2, 3, 5]]
    length = lambda: sum(matrix[a, b] for t in routes for a, b in zip([0, *t], [*t, 0], strict=True))
    before = length()
    while planning._moved(routes, matrix, np.ones(6), 4):
        pass
    assert length() < before and sorted(c for t in routes for c in t) == [1, 2, 3, 4, 5] and all(len(t) <= 4 for t in routes)


def test_edge_lists_are_cut(spark):
    steps = spark.createDataFrame([(r, 1, 2) for r in range(50)] + [(7, 2, 3)], "route_id long, u long, v long")
    lists = network.routes_of_edges(steps, 20).collect()
    assert sorted(x for r in lists if r.u == 1 for x in r.routes) == list(range(50)) and len([r for r in lists if r.u == 1]) > 1

"""Queries on sources and sinks: each writes files to the shared folder, reads them back and is compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.functions import exprs as X
from streetloom.functions import geo as G
from streetloom.operators import network as N
from streetloom.operators import paths as P
from streetloom.operators.stages import shared_folder
from streetloom.plans.routing import _EDGES, _search
from streetloom.sources import fixtures as S
from streetloom.sources import readers, sinks

# Code lists of the data sets.
WASTE_NAMES = {"DV": "Organic Waste", "DI": "Household Waste", "PC": "Paper & Cardboard", "VE": "Glass"}
RED_LIST = {"CR": "Critically Endangered", "EN": "Endangered", "VU": "Vulnerable", "NT": "Near Threatened", "LC": "Least Concern", "DD": "Data Deficient", "NE": "Not Evaluated"}
ROUTE_COLOURS = {"subway": "#ef4444", "light_rail": "#8b5cf6", "tram": "#10b981", "trolleybus": "#f97316", "bus": "#3b82f6"}


def _graphml(spark, d):
    path = shared_folder(spark)
    sinks.write_graphml(S.road_nodes(spark, d).select("node_id", "x", "y", "elevation"), S.road_edges(spark, d), path)
    return readers.read_graphml(spark, path)


def k01_graphml_edges(spark, d):
    """The network as GraphML, written and read back with its attributes."""
    kinds = {"key": "int", "length_m": "bigint", "speed_kph": "double", "lanes": "bigint", "highway": "string", "name": "string"}
    edges = readers.attributes(_graphml(spark, d)[1], kinds)
    return edges.select(F.col("source").cast("long").alias("u"), F.col("target").cast("long").alias("v"), *kinds)


def s01_graphml_routes(spark, d):
    """A GraphML network read and routed: the cost of every pair."""
    edges = readers.attributes(_graphml(spark, d)[1], {"length_m": "bigint"}).select(F.col("source").cast("long").alias("u"), F.col("target").cast("long").alias("v"), "length_m")
    return P.path_sums(S.od_pairs(spark, d), edges, "length_m").select("pair_id", F.col("cost").cast("long").alias("cost"))


def g19_broken_edges(spark, d):
    """Edges whose attributes are not what their type asks for, by attribute."""
    raw = S.road_edges(spark, d).select("u", "v", F.create_map(F.lit("length_m"), F.when(F.col("u") % 31 == 0, "long").otherwise(F.col("length_m").cast("string")), F.lit("lanes"), F.when(F.col("v") % 37 != 0, F.col("lanes").cast("string"))).alias("attributes"))
    checked = readers.attributes(raw, {"length_m": "double", "lanes": "int"})
    return checked.agg(F.count("*").alias("edges"), F.count_if(F.col("length_m").isNull()).alias("without_length"), F.count_if(F.col("lanes").isNull()).alias("without_lanes"))


def k02_network_export(spark, d):
    """Nodes and edges as tables; S13: only the columns asked for are read."""
    path = shared_folder(spark)
    sinks.write_network(S.road_nodes(spark, d), S.road_edges(spark, d), path)
    nodes, edges = spark.read.parquet(f"{path}/nodes").select("node_id", "elevation"), spark.read.parquet(f"{path}/edges").select("u", "v", "length_m")
    return edges.join(nodes, edges["u"] == nodes["node_id"]).groupBy("elevation").agg(F.count("*").alias("edges"), F.sum("length_m").alias("metres"))


def k08_habitat_csv(spark, d):
    """Habitat area per road and code, as delimited text and back."""
    path = shared_folder(spark)
    sinks.write_csv(S.habitats(spark, d).groupBy("road_id", "code").agg(F.sum("area").alias("habitat_area_m2")), path)
    return readers.read_csv(spark, path, schema="road_id long, code string, habitat_area_m2 long")


def s10_semicolon_text(spark, d):
    """Grid cells as text with semicolons, its types found by the reader."""
    path = shared_folder(spark)
    S.grid_cells(spark, d).select("cell_id", "e", "n", "value").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, sep=";").select(F.col("cell_id").cast("long").alias("cell_id"), F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n"), F.col("value").cast("long").alias("value"))


def s11_data_arrays(spark, d):
    """JSON documents with an array named data, one per nation's suppliers."""
    path = shared_folder(spark)
    rows = S.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct((46.5 + F.col("s_suppkey") * 0.001).alias("lat"), (6.5 + F.col("s_nationkey") * 0.01).alias("lon"), F.col("s_suppkey").alias("value"))).alias("data"))
    rows.select("data").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_data_array(spark, path).select("value", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def s12_feature_collections(spark, d):
    """GeoJSON collections, one per nation, read as features."""
    path = shared_folder(spark)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(6.5 + F.col("s_nationkey") * 0.01, 46.5 + F.col("s_suppkey") * 0.001).alias("coordinates")).alias("geometry"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")).alias("properties"))
    S.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(feature).alias("features")).select(F.lit("FeatureCollection").alias("type"), "features").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_geojson(spark, path).select(F.col("id").cast("long").alias("id"), F.col("nation").cast("long").alias("nation"), F.round(F.col("geometry.coordinates")[1], 6).alias("lat"))


def s14_named_files(spark, d):
    """Files found by a glob; pair, measure and attribute come from their names."""
    path = shared_folder(spark)
    names = {0: "corr_income_noise_pearson_1_value", 1: "corr_income_heat_spearman_2_share", 2: "other_income_noise_pearson_3_value"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), (F.col("c_custkey") % 3).cast("int"))
    S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("file")).write.partitionBy("file").parquet(path)
    found = readers.read_named(spark, f"{path}/file=corr_*", r"file=corr_([a-z]+)_([a-z]+)_([a-z]+)_\d+_([a-z]+)/", ["first", "second", "measure", "attribute"])
    return found.select("id", "first", "second", F.concat_ws("-", "attribute", "measure").alias("label"))


def s16_flattened_coordinates(spark, d):
    """Lines with heights in Swiss metres become lines of longitude and latitude alone."""
    cell = S.grid_cells(spark, d).select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.array(F.col("e") + 50 * k, F.col("n") + 20 * k, F.lit(400.0) + k)).alias("line"))
    flat = cell.select("cell_id", F.transform("line", lambda p: F.array(*G.swiss_to_wgs84(p[0], p[1]))).alias("line"))
    return flat.select("cell_id", F.size(F.col("line")[0]).alias("dimensions"), F.round(F.col("line")[0][0], 8).alias("lon"), F.round(F.col("line")[0][1], 8).alias("lat"))


def s17_layer_addresses(spark, d):
    """Layers with the address of their source: below a base, or in full where they name one."""
    path = shared_folder(spark)
    layers = S.table(spark, d, "part").select(F.col("p_partkey").alias("layer"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://tiles.example/"), F.col("p_partkey"))).otherwise(F.concat(F.lit("/layer"), F.col("p_partkey"))).alias("source"))
    sinks.write_json(layers, path)
    full = F.when(F.col("source").rlike("^[a-z]+://"), F.col("source")).otherwise(F.concat(F.lit("https://data.example"), F.col("source")))
    return spark.read.json(path).select("layer", full.alias("address"))


def k04_tile_levels(spark, d):
    """Points per map tile, at all zoom levels from 6 to 20; tiles of a level stand in folders of their column."""
    path = shared_folder(spark)
    points = S.centroids(spark, d).select("lon", "lat", F.explode(F.sequence(F.lit(6), F.lit(20))).alias("zoom"))
    n = F.pow(F.lit(2.0), F.col("zoom"))
    row = (1 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / F.pi()) / 2 * n
    tiles = points.select("zoom", F.floor((F.col("lon") + 180) / 360 * n).alias("tile_x"), F.floor(row).alias("tile_y")).groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("points"))
    tiles.write.partitionBy("zoom").parquet(path)
    return spark.read.parquet(path).select(F.col("zoom").cast("int").alias("zoom"), "tile_x", "tile_y", "points")


def k07_centroid_collection(spark, d):
    """Collection points as GeoJSON lines with their properties, compressed and read back."""
    path = shared_folder(spark)
    sinks.write_features(sinks.point_features(S.centroids(spark, d), "lon", "lat", ("centroid_id", "waste_type", "count")), path)
    return readers.read_geojson_lines(spark, path).select("centroid_id", "waste_type", "count", F.round(F.col("geometry.coordinates")[0], 6).alias("lon"))


def k09_transit_colours(spark, d):
    """Transit lines with the colour of their type; unknown types are grey."""
    kind = F.element_at(F.array(*[F.lit(k) for k in (*ROUTE_COLOURS, "ferry")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return S.table(spark, d, "supplier").select("s_suppkey", kind.alias("route_type")).select("s_suppkey", "route_type", X.lookup(F.col("route_type"), ROUTE_COLOURS, F.lit("#888888")).alias("colour"))


def k10_compressed_json(spark, d):
    """Edges as compressed JSON and back."""
    path = shared_folder(spark)
    sinks.write_json(S.road_edges(spark, d).select("u", "v", "key", "highway"), path)
    return spark.read.json(path).groupBy("highway").agg(F.count("*").alias("edges"), F.sum("key").alias("keys"))


def k13_graph_dump(spark, d):
    """The counts of a network beside the points of its edges."""
    lines = sinks.edge_lines(S.road_edges(spark, d).withColumn("geometry", F.array().cast("array<array<double>>")), S.road_nodes(spark, d))
    nodes = S.road_nodes(spark, d).agg(F.count("*").alias("node_count"))
    return lines.agg(F.count("*").alias("edge_count"), F.sum(F.size("line")).alias("points"), F.round(F.sum(F.col("line")[0][0]), 4).alias("lon_sum")).crossJoin(nodes)


def p06_edge_lines(spark, d):
    """An edge's own geometry, else the straight segment."""
    own = F.when(F.col("u") % 4 == 0, F.array(F.array(F.lit(6.0), F.lit(46.0)), F.array(F.lit(6.1), F.lit(46.1)), F.array(F.lit(6.2), F.lit(46.0)))).when(F.col("u") % 4 == 1, F.array(F.array(F.lit(6.0), F.lit(46.0))))
    lines = sinks.edge_lines(S.road_edges(spark, d).withColumn("geometry", own), S.road_nodes(spark, d))
    return lines.select("u", "v", "key", F.size("line").alias("points"), F.round(F.col("line")[0][0], 6).alias("lon"), F.round(F.element_at("line", -1)[1], 6).alias("lat"))


def p05_grades(spark, d):
    """The grade of each edge and its absolute value."""
    return N.edge_metrics(S.road_edges(spark, d), S.road_nodes(spark, d)).select("u", "v", "key", F.round("grade", 9).alias("grade"), F.round(F.abs("grade"), 9).alias("grade_abs"))


def f05_congested_times(spark, d):
    """Congested seconds in three variants: by betweenness (a missing length is a metre), by volume (it is nothing), and
    with the free time where the road stands still."""
    e = S.road_edges(spark, d).select("u", "v", "key", F.when(F.col("u") % 5 != 0, F.col("length_m")).alias("length"), F.when(F.col("v") % 6 != 0, F.col("speed_kph")).otherwise(0.0).alias("speed"), "lanes", ((F.col("u") * 97 + F.col("v")) % 60_000).cast("double").alias("flow"))
    at = lambda **how: X.congested_time(F.col("length"), F.col("speed"), F.col("flow"), F.col("lanes"), **how)
    return e.select("u", "v", "key", F.round(at(missing_length=1.0), 6).alias("by_betweenness"), F.round(at(missing_length=0.0), 6).alias("by_volume"), F.round(at(standstill=F.lit(9.5)), 6).alias("or_free"))


def f13_polygon_measures(spark, d):
    """Area and centroid of the squares around grid cells."""
    ring = S.grid_cells(spark, d).select("cell_id", F.array(*[F.struct((F.col("e") - 2_500_000 + a).alias("x"), (F.col("n") - 1_100_000 + b).alias("y")) for a, b in ((0, 0), (100, 0), (100, 60), (0, 60), (0, 0))]).alias("ring"))
    x, y = G.ring_centroid(F.col("ring"))
    return ring.select("cell_id", F.round(G.ring_area(F.col("ring")), 3).alias("area"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def f19_code_lists(spark, d):
    """Names of waste types and red list classes, colours of route types; unknown codes keep their default."""
    code = lambda names: F.element_at(F.array(*[F.lit(k) for k in (*names, "??")]), (F.col("c_custkey") % (len(names) + 1) + 1).cast("int"))
    own = S.table(spark, d, "customer").select("c_custkey", code(WASTE_NAMES).alias("waste"), code(RED_LIST).alias("status"), code(ROUTE_COLOURS).alias("route"))
    return own.select("c_custkey", X.lookup(F.col("waste"), WASTE_NAMES, F.col("waste")).alias("waste"), X.lookup(F.col("status"), RED_LIST, F.lit("Unknown")).alias("status"), X.lookup(F.col("route"), ROUTE_COLOURS, F.lit("#888888")).alias("colour"))


def f29_extrusions(spark, d):
    """Heights of at least 2, by the five factors of the layers."""
    return S.grid_cells(spark, d).select("cell_id", *[F.round(X.extrusion(F.col("value"), k), 6).alias(f"height_{i}") for i, k in enumerate((1.0, 5.0, 2.0, 0.5, 0.2))])


def j13_polygon_geometry(spark, d):
    """Habitat pieces with the geometry of their polygon, where there is one, and the ends of their road."""
    shapes = S.table(spark, d, "part").select(F.col("p_partkey").alias("poly_id"), F.concat(F.lit("POINT("), F.col("p_size"), F.lit(" 1)")).alias("geometry")).where("poly_id % 3 <> 0")
    roads = N.first_edges(S.road_edges(spark, d)).where("u < v").groupBy(F.col("u").alias("road_id")).agg(F.min("v").alias("v"))
    pieces = S.habitats(spark, d).groupBy("poly_id", "road_id").agg(F.sum("area").alias("area"))
    return pieces.join(shapes, "poly_id", "left").join(roads, "road_id").select("poly_id", F.col("road_id").alias("u"), "v", "area", "geometry")


QUERIES = {f.__name__: f for f in (
    k01_graphml_edges, s01_graphml_routes, g19_broken_edges, k02_network_export, k08_habitat_csv, s10_semicolon_text, s11_data_arrays, s12_feature_collections, s14_named_files, s16_flattened_coordinates,
    s17_layer_addresses, k04_tile_levels, k07_centroid_collection, k09_transit_colours, k10_compressed_json, k13_graph_dump, p06_edge_lines, p05_grades, f05_congested_times, f13_polygon_measures, f19_code_lists,
    f29_extrusions, j13_polygon_geometry,
)}


def _coded(names: dict, column: str, default: str) -> str:
    code = f"[{', '.join(repr(k) for k in (*names, '??'))}][(c_custkey % {len(names) + 1} + 1)::INT]"
    return f"coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in names.items())}}}[{code}], {default.format(code=code)}) AS {column}"


SQL = {
    "k01_graphml_edges": "SELECT u, v, key, length_m, speed_kph, lanes, highway, name FROM road_edges",
    "s01_graphml_routes": f"{_search(_EDGES)} SELECT pair_id, r.d AS cost FROM od_pairs p JOIN r ON r.o = p.origin AND r.n = p.destination",
    "g19_broken_edges": "SELECT count(*) AS edges, count(*) FILTER (u % 31 = 0) AS without_length, count(*) FILTER (v % 37 = 0) AS without_lanes FROM road_edges",
    "k02_network_export": "SELECT elevation, count(*) AS edges, sum(length_m)::BIGINT AS metres FROM road_edges JOIN road_nodes ON node_id = u GROUP BY elevation",
    "k08_habitat_csv": "SELECT road_id, code, sum(area)::BIGINT AS habitat_area_m2 FROM habitats GROUP BY road_id, code",
    "s10_semicolon_text": "SELECT cell_id, e, n, value FROM grid_cells",
    "s11_data_arrays": "SELECT s_suppkey AS value, round(46.5::DOUBLE + s_suppkey * 0.001::DOUBLE, 6) AS lat, round(6.5::DOUBLE + s_nationkey * 0.01::DOUBLE, 6) AS lon FROM supplier",
    "s12_feature_collections": "SELECT s_suppkey AS id, s_nationkey::BIGINT AS nation, round(46.5::DOUBLE + s_suppkey * 0.001::DOUBLE, 6) AS lat FROM supplier",
    "s14_named_files": "SELECT c_custkey AS id, 'income' AS first, CASE c_custkey % 3 WHEN 0 THEN 'noise' ELSE 'heat' END AS second, CASE c_custkey % 3 WHEN 0 THEN 'value-pearson' ELSE 'share-spearman' END AS label FROM customer WHERE c_custkey % 3 < 2",
    "s16_flattened_coordinates": "WITH g AS (SELECT cell_id, (e - 2600000.0::DOUBLE) / 1000000.0::DOUBLE AS y, (n - 1200000.0::DOUBLE) / 1000000.0::DOUBLE AS x FROM grid_cells) SELECT cell_id, 2 AS dimensions, round((2.6779094::DOUBLE + 4.728982::DOUBLE * y + 0.791484::DOUBLE * y * x + 0.1306::DOUBLE * y * x * x - 0.0436::DOUBLE * y * y * y) * 100 / 36, 8) AS lon, round((16.9023892::DOUBLE + 3.238272::DOUBLE * x - 0.270978::DOUBLE * y * y - 0.002528::DOUBLE * x * x - 0.0447::DOUBLE * y * y * x - 0.0140::DOUBLE * x * x * x) * 100 / 36, 8) AS lat FROM g",
    "s17_layer_addresses": "SELECT p_partkey AS layer, CASE p_partkey % 4 WHEN 0 THEN 'https://tiles.example/' || p_partkey ELSE 'https://data.example/layer' || p_partkey END AS address FROM part",
    "k04_tile_levels": "SELECT zoom::INT AS zoom, floor((lon + 180) / 360 * (1 << zoom))::BIGINT AS tile_x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << zoom))::BIGINT AS tile_y, count(*) AS points FROM centroids, range(6, 21) z(zoom) GROUP BY ALL",
    "k07_centroid_collection": "SELECT centroid_id, waste_type, count, round(lon, 6) AS lon FROM centroids",
    "k09_transit_colours": f"SELECT s_suppkey, t AS route_type, coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in ROUTE_COLOURS.items())}}}[t], '#888888') AS colour FROM (SELECT s_suppkey, [{', '.join(repr(k) for k in (*ROUTE_COLOURS, 'ferry'))}][(s_suppkey % 6 + 1)::INT] AS t FROM supplier)",
    "k10_compressed_json": "SELECT highway, count(*) AS edges, sum(key)::BIGINT AS keys FROM road_edges GROUP BY highway",
    "k13_graph_dump": "SELECT count(*) AS edge_count, 2 * count(*) AS points, round(sum(x), 4) AS lon_sum, (SELECT count(*) FROM road_nodes) AS node_count FROM road_edges JOIN road_nodes ON node_id = u",
    "p06_edge_lines": "SELECT u, v, key, CASE u % 4 WHEN 0 THEN 3 ELSE 2 END AS points, round(CASE u % 4 WHEN 0 THEN 6.0 ELSE a.x END::DOUBLE, 6) AS lon, round(CASE u % 4 WHEN 0 THEN 46.0 ELSE b.y END::DOUBLE, 6) AS lat FROM road_edges JOIN road_nodes a ON a.node_id = u JOIN road_nodes b ON b.node_id = v",
    "p05_grades": "SELECT u, v, key, round((b.elevation - a.elevation) / length_m, 9) AS grade, round(abs((b.elevation - a.elevation) / length_m), 9) AS grade_abs FROM road_edges JOIN road_nodes a ON a.node_id = u JOIN road_nodes b ON b.node_id = v",
    "f05_congested_times": "WITH e AS (SELECT u, v, key, CASE WHEN u % 5 <> 0 THEN length_m END AS l, (CASE WHEN v % 6 <> 0 THEN speed_kph ELSE 30 END::DOUBLE) / (1 + ((u * 97 + v) % 60000)::DOUBLE / (lanes * 50000.0::DOUBLE)) / 3.6::DOUBLE AS s FROM road_edges) SELECT u, v, key, round(coalesce(l, 1) / s, 6) AS by_betweenness, round(coalesce(l, 0) / s, 6) AS by_volume, round(coalesce(l / s, 9.5::DOUBLE), 6) AS or_free FROM e",
    "f13_polygon_measures": "SELECT cell_id, 6000.0::DOUBLE AS area, round(e - 2500000 + 50, 3) AS x, round(n - 1100000 + 30, 3) AS y FROM grid_cells",
    "f19_code_lists": f"SELECT c_custkey, {_coded(WASTE_NAMES, 'waste', '{code}')}, {_coded(RED_LIST, 'status', chr(39) + 'Unknown' + chr(39))}, {_coded(ROUTE_COLOURS, 'colour', chr(39) + '#888888' + chr(39))} FROM customer",
    "f29_extrusions": f"SELECT cell_id, {', '.join(f'round(greatest(2.0::DOUBLE, value * {k}::DOUBLE), 6) AS height_{i}' for i, k in enumerate((1.0, 5.0, 2.0, 0.5, 0.2)))} FROM grid_cells",
    "j13_polygon_geometry": "WITH h AS (SELECT poly_id, road_id, sum(area)::BIGINT AS area FROM habitats GROUP BY poly_id, road_id), r AS (SELECT u AS road_id, min(v) AS v FROM road_edges WHERE u < v GROUP BY u) SELECT poly_id, h.road_id AS u, r.v, area, CASE WHEN poly_id % 3 <> 0 AND p_partkey IS NOT NULL THEN 'POINT(' || p_size || ' 1)' END AS geometry FROM h JOIN r ON r.road_id = h.road_id LEFT JOIN part ON p_partkey = poly_id",
}

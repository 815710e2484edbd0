"""Queries on geodata: preparation, spatial joins, windows, unions, geometry, tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.functions import exprs as X
from streetloom.functions import geo as G
from streetloom.sources import fixtures as S
from streetloom.sources import sinks

CELL = 500.0
_XY = (77000.0, 111000.0)


def _segments(spark, d):
    """Edges of the network in metres, one per street."""
    n = S.road_nodes(spark, d)
    at = lambda s, key: n.select(F.col("node_id").alias(key), (F.col("x") * _XY[0]).alias(f"x{s}"), (F.col("y") * _XY[1]).alias(f"y{s}"))
    edges = S.road_edges(spark, d).where("key = 0")
    return edges.select("u", "v", "highway").join(at(1, "u"), "u").join(at(2, "v"), "v")


def _lines(spark, d):
    """Transit lines: short segments in metres, with a line name and an operator."""
    s = F.col("s_suppkey")
    x, y = (F.lit(6.55) + (s * 37 % 140) * F.lit(0.001)) * _XY[0], (F.lit(46.5) + (s * 53 % 70) * F.lit(0.001)) * _XY[1]
    return S.table(spark, d, "supplier").select((s % 17).alias("ref"), F.when(s % 5 == 0, "Regional").otherwise("City").alias("network"), x.alias("lx1"), y.alias("ly1"), (x + 300.0).alias("lx2"), (y + 150.0).alias("ly2"))


def _near(spark, d, reach: float):
    """Edges and lines within reach: meeting in grid cells, then the exact distance."""
    lines = _lines(spark, d).where("network = 'City'").withColumn("cell", F.explode(G.cells_of(F.col("lx1"), F.col("ly1"), F.col("lx2"), F.col("ly2"), CELL, reach)))
    edges = _segments(spark, d).where(~F.col("highway").isin("motorway", "motorway_link")).withColumn("cell", F.explode(G.cells_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), CELL, 0.0)))
    away = G.segments_distance(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c) for c in ("lx1", "ly1", "lx2", "ly2")))
    return edges.join(lines, "cell").where(away <= reach).select("u", "v", "ref").distinct()


def j09_transit_edges(spark, d):
    """Lines within 8 m of each street: count and sorted names; 0 and "" where none."""
    found = _near(spark, d, 8.0).groupBy("u", "v").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("ref").cast("string"))), ",").alias("refs"))
    edges = S.road_edges(spark, d).where("key = 0").select("u", "v")
    return edges.join(found, ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0)).alias("bus_route_count"), F.coalesce("refs", F.lit("")).alias("bus_route_refs"))


def j10_osm_ways(spark, d):
    """Ways listed by several ids, joined to the streets that carry one of them."""
    edges = S.road_edges(spark, d).where("key = 0").select("u", "v", F.array(F.col("u") * 2, F.col("v") + 5).alias("osmid")).withColumn("way", F.explode("osmid"))
    ways = S.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("way"), (F.col("s_suppkey") % 9).alias("ref"))
    return edges.join(ways, "way").groupBy("u", "v").agg(F.array_join(F.array_sort(F.collect_set(F.col("ref").cast("string"))), ",").alias("refs"))


def j12_habitat_buffer(spark, d):
    """Square habitats within 10 m of a street: count and whole area per street."""
    s = F.col("s_suppkey")
    x, y = (F.lit(6.5513) + (s * 41 % 140) * F.lit(0.001)) * _XY[0], (F.lit(46.5011) + (s * 59 % 70) * F.lit(0.001)) * _XY[1]
    squares = S.table(spark, d, "supplier").select(s.alias("poly_id"), (x - 25.0).alias("a"), (y - 25.0).alias("b"), (x + 25.0).alias("c"), (y + 25.0).alias("e"))
    cells = squares.withColumn("cell", F.explode(G.cells_of(F.col("a"), F.col("b"), F.col("c"), F.col("e"), CELL, 10.0)))
    edges = _segments(spark, d).withColumn("cell", F.explode(G.cells_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), CELL, 0.0)))
    # one row per side keeps the distance expression small enough for code generation
    side = lambda *names: F.struct(*[F.col(n).alias(k) for n, k in zip(names, ("p", "q", "r", "t"), strict=True)])
    met = edges.join(cells, "cell").withColumn("side", F.explode(F.array(side("a", "b", "c", "b"), side("c", "b", "c", "e"), side("a", "e", "c", "e"), side("a", "b", "a", "e"))))
    away = G.segments_distance(tuple(F.col(k) for k in ("x1", "y1", "x2", "y2")), tuple(F.col(f"side.{k}") for k in ("p", "q", "r", "t")))
    pairs = met.where(away <= 10.0).select("u", "v", "poly_id").distinct()
    area = squares.select("poly_id", ((F.col("c") - F.col("a")) * (F.col("e") - F.col("b"))).alias("area"))
    return pairs.join(area, "poly_id").groupBy("u", "v").agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 2).alias("polygon_area_m2"))


def p11_habitat_density(spark, d):
    """Habitat area per street, 0 by default; density where positive."""
    area = S.habitats(spark, d).groupBy(F.col("road_id").alias("u")).agg(F.sum("area").alias("area"))
    edges = S.road_edges(spark, d).where("key = 0").join(area, "u", "left").withColumn("area", F.coalesce("area", F.lit(0)))
    return edges.where("area > 0").select("u", "v", "area", F.round(F.col("area") / F.col("length_m"), 6).alias("density"))


def p15_habitat_filter(spark, d):
    code = F.col("code")
    return S.habitats(spark, d).where(~(code.startswith("9") | code.startswith("8") | code.startswith("5") | code.startswith("STR")) & (code != "4.4") & (F.col("poly_id") != 77)).groupBy("code").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def p16_bounding_box(spark, d):
    return S.centroids(spark, d).where("lon BETWEEN 6.58 AND 6.64 AND lat BETWEEN 46.51 AND 46.55").select("centroid_id")


def a22_area_per_road(spark, d):
    """Habitat area dissolved by road."""
    return S.habitats(spark, d).groupBy("road_id").agg(F.sum("area").alias("area"), F.count_distinct("poly_id").alias("polygons"))


def w03_habitat_windows(spark, d):
    """Per road and code prefix: total and largest area, marginal gain, polygons in
    order; one row per polygon."""
    prefixed = S.habitats(spark, d).withColumn("prefix", F.substring("code", 1, 3)).withColumn("side", F.when(F.col("road_x") < F.col("area_x"), "left").otherwise("right"))
    rows = prefixed.groupBy("road_id", "prefix", "poly_id").agg(F.sum("area").alias("area"), F.min("side").alias("side"))
    group = Window.partitionBy("road_id", "prefix")
    first = Window.partitionBy("prefix", "poly_id").orderBy("road_id")
    with_all = rows.select(
        "*", F.sum("area").over(group).alias("total"), F.max("area").over(group).alias("largest"), F.size(F.collect_set("poly_id").over(group)).alias("polygons"),
        F.array_join(F.transform(F.array_sort(F.collect_set("poly_id").over(group)), lambda p: p.cast("string")), "-").alias("members"), F.row_number().over(first).alias("place"),
    )
    return with_all.where("place = 1").select("road_id", "prefix", "poly_id", "side", "total", "largest", F.round(F.col("total") / F.col("largest"), 6).alias("gain"), "polygons", "members")


def a24_connectivity(spark, d):
    """Probability of connectivity of each prefix: sum of a_i a_j exp(-d_ij / alpha) over the square of the area."""
    cells = S.habitats(spark, d).groupBy(F.substring("code", 1, 1).alias("kind"), "poly_id").agg(F.sum("area").alias("a"))
    other = cells.select("kind", F.col("poly_id").alias("q"), F.col("a").alias("b"))
    pairs = cells.join(other, "kind").select("kind", (F.col("a") * F.col("b") * F.exp(-F.abs(F.col("poly_id") - F.col("q")) * 100.0 / 500.0)).alias("term"))
    total = cells.groupBy("kind").agg(F.sum("a").alias("total"))
    return pairs.groupBy("kind").agg(F.sum("term").alias("s")).join(total, "kind").select("kind", F.round(F.col("s") / (F.col("total") * F.col("total")), 9).alias("pc"))


def _tracks(spark, d):
    return S.tracks(spark, d).where("lon IS NOT NULL AND lat IS NOT NULL")


def a18_track_lines(spark, d):
    """Points of a day and vehicle in order; lines of two or more."""
    points = _tracks(spark, d).groupBy("date", "vehicle").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p")).where("size(p) >= 2")
    return points.select("date", "vehicle", F.size("p").cast("long").alias("points"), F.col("p")[0]["seq"].alias("first_seq"), F.round(G.line_length(F.col("p")), 9).alias("length"))


def a19_track_statistics(spark, d):
    lines = a18_track_lines(spark, d)
    return lines.agg(F.count_distinct("date").alias("days"), F.count_distinct("vehicle").alias("vehicles"), F.round(F.avg("points"), 6).alias("mean_points"), F.round(F.sum("length"), 4).alias("length"))


def a20_distinct_values(spark, d):
    p = S.table(spark, d, "part")
    return p.agg(*[F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c) for c in ("p_brand", "p_type")])


def a21_value_counts(spark, d):
    return S.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))


def f09_reprojection(spark, d):
    lon, lat = G.swiss_to_wgs84(F.col("e"), F.col("n"))
    return S.grid_cells(spark, d).select("cell_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


def f10_grid_squares(spark, d):
    lon, lat = G.swiss_to_wgs84(F.col("e"), F.col("n"))
    at = S.grid_cells(spark, d).select("cell_id", lon.alias("lon"), lat.alias("lat"))
    ring = at.select("cell_id", G.square(F.col("lon"), F.col("lat"), 100.0).alias("ring"))
    return ring.select("cell_id", F.size("ring").alias("corners"), *[F.round(F.col("ring")[k][c], 8).alias(f"{c}{k}") for k in (0, 2) for c in "xy"])


def f11_mercator_squares(spark, d):
    lon, lat = G.swiss_to_wgs84(F.col("e"), F.col("n"))
    ring = S.grid_cells(spark, d).select("cell_id", G.mercator_square(lon, lat, 200.0).alias("ring"))
    cx, cy = G.ring_centroid(F.col("ring"))
    return ring.select("cell_id", F.round(G.ring_area(F.col("ring")), 1).alias("area"), F.round(F.col("ring")[0]["x"], 4).alias("x0"), F.round(F.col("ring")[0]["y"], 4).alias("y0"))


def f12_line_lengths(spark, d):
    """Each point with the one before it, so that no line has to be one array."""
    line = Window.partitionBy("year").orderBy("cell_id")
    step = F.hypot(F.col("e") - F.lag("e").over(line), F.col("n") - F.lag("n").over(line))
    return S.grid_cells(spark, d).select("year", step.alias("step")).groupBy("year").agg(F.round(F.sum("step"), 3).alias("metres"))


def f39_midpoints(spark, d):
    """The middle of a bent line, and the line moved 5 m aside."""
    c = S.centroids(spark, d)
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    lines = c.select("centroid_id", F.array(p(0.0, 0.0), p(0.003, 0.0), p(0.003, 0.001)).alias("line"))
    moved = lines.select("centroid_id", G.midpoint(F.col("line")).alias("m"), G.offset_line(F.col("line"), 5.0).alias("o"))
    return moved.select("centroid_id", F.round("m.x", 9).alias("mx"), F.round("m.y", 9).alias("my"), F.round(F.col("o")[0]["y"], 9).alias("oy"), F.round(F.col("o")[3]["x"], 9).alias("ox"))


def f42_wkt(spark, d):
    n = S.road_nodes(spark, d).select("node_id", F.array(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")), F.struct((F.col("gx") + 1).alias("x"), F.col("gy").alias("y"))).alias("line"))
    return n.select("node_id", G.wkt_line(F.col("line")).alias("wkt"))


def u01_union_of_files(spark, d):
    """Tables of one shape with columns parsed from a file name."""
    name = lambda s: F.lit(f"corr_income_noise_pearson_{s}_value.geojson")
    frames = [S.table(spark, d, t).select(F.col(k).cast("long").alias("id"), name(i).alias("file")) for i, (t, k) in enumerate((("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")))]
    whole = frames[0].unionByName(frames[1], allowMissingColumns=True).unionByName(frames[2], allowMissingColumns=True)
    part = lambda k: F.regexp_extract("file", r"^corr_([a-z]+)_([a-z]+)_([a-z]+)_\d+_([a-z]+)\.geojson$", k)
    return whole.select("id", part(1).alias("first"), part(2).alias("second"), part(3).alias("measure"), F.concat_ws("-", part(4), part(3)).alias("label"), F.substring("file", 1, 2).alias("prefix"))


def u05_distinct_nodes(spark, d):
    e = S.road_edges(spark, d)
    return e.select(F.col("u").alias("node")).union(e.select("v")).distinct()


def s04_network_union(spark, d):
    """Two overlapping extracts put together; an edge of both counts once."""
    e = S.road_edges(spark, d).select("u", "v", "key", "length_m")
    return e.where("u % 3 <> 0").unionByName(e.where("v % 2 = 0")).dropDuplicates(["u", "v", "key"])


def f19_code_names(spark, d):
    """names of codes; unknown codes stay null, or themselves, or Unknown."""
    code = F.col("waste_type")
    unknown = F.lit(None).cast("string")
    names = {"BU": "Building", "MA": "Machinery", "FU": "Furniture"}
    return S.centroids(spark, d).groupBy("waste_type").agg(F.count("*").alias("n")).select(X.lookup(code, names, unknown).alias("or_null"), X.lookup(code, names, code).alias("or_code"), X.lookup(code, names, F.lit("Unknown")).alias("or_unknown"), "n")


def s05_elevation(spark, d):
    """Nodes take the value of their raster cell; a share tells how many had one."""
    raster = S.table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("cx"), F.floor(F.col("s_suppkey") / 25).alias("cy"), (350 + F.col("s_suppkey") * 3 % 90).alias("z"))
    nodes = S.road_nodes(spark, d).select("node_id", F.floor(F.col("gx") / 2).alias("cx"), F.floor(F.col("gy") / 4).alias("cy"))
    return nodes.join(raster.groupBy("cx", "cy").agg(F.min("z").alias("z")), ["cx", "cy"], "left").select("node_id", "z")


def k04_tiles(spark, d):
    """Map tiles of the collection points, with means."""
    tx, ty = G.tile(F.col("lon"), F.col("lat"), 14)
    return S.centroids(spark, d).groupBy(tx.alias("tile_x"), ty.alias("tile_y")).agg(F.count("*").alias("points"), F.round(F.avg("count"), 6).alias("mean"))


def k06_densest_dropped(spark, d):
    """Per tile the five largest points stay."""
    tx, ty = G.tile(F.col("lon"), F.col("lat"), 14)
    own = S.centroids(spark, d).select("centroid_id", "count", tx.alias("tile_x"), ty.alias("tile_y"))
    place = F.row_number().over(Window.partitionBy("tile_x", "tile_y").orderBy(F.desc("count"), "centroid_id"))
    return own.withColumn("place", place).where("place <= 5").select("tile_x", "tile_y", "centroid_id")


def k03_geojson_features(spark, d):
    """One feature per street as JSON text, read again."""
    made = sinks.edge_features(S.road_edges(spark, d).where("key = 0"), S.road_nodes(spark, d))
    kind = "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<u:bigint,v:bigint,highway:string,length_m:bigint>>"
    back = made.select(F.from_json("feature", kind).alias("f"))
    return back.select("f.properties.u", "f.properties.v", "f.properties.highway", F.size("f.geometry.coordinates").alias("points"))


QUERIES = {f.__name__: f for f in (
    j09_transit_edges, j10_osm_ways, j12_habitat_buffer, p11_habitat_density, p15_habitat_filter, p16_bounding_box, a22_area_per_road, w03_habitat_windows, a24_connectivity, a18_track_lines, a19_track_statistics,
    a20_distinct_values, a21_value_counts, f09_reprojection, f10_grid_squares, f11_mercator_squares, f12_line_lengths, f39_midpoints, f42_wkt, u01_union_of_files, u05_distinct_nodes, s04_network_union, f19_code_names,
    s05_elevation, k04_tiles, k06_densest_dropped, k03_geojson_features,
)}


def _point(px, py, ax, ay, bx, by) -> str:
    t = f"least(greatest((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)), 0.0), 1.0)"
    return f"sqrt(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2))"


def _between(ax, ay, bx, by, cx, cy, dx, dy) -> str:
    turn = lambda px, py, qx, qy, rx, ry: f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"
    cross = f"{turn(ax, ay, bx, by, cx, cy)} * {turn(ax, ay, bx, by, dx, dy)} < 0 AND {turn(cx, cy, dx, dy, ax, ay)} * {turn(cx, cy, dx, dy, bx, by)} < 0"
    return f"CASE WHEN {cross} THEN 0.0 ELSE least({_point(ax, ay, cx, cy, dx, dy)}, {_point(bx, by, cx, cy, dx, dy)}, {_point(cx, cy, ax, ay, bx, by)}, {_point(dx, dy, ax, ay, bx, by)}) END"


_SEG = "seg AS (SELECT e.u, e.v, e.highway, a.x * 77000.0 AS x1, a.y * 111000.0 AS y1, b.x * 77000.0 AS x2, b.y * 111000.0 AS y2 FROM road_edges e JOIN road_nodes a ON a.node_id = e.u JOIN road_nodes b ON b.node_id = e.v WHERE e.key = 0)"
_SQ = [("a", "b", "c", "b"), ("c", "b", "c", "e"), ("a", "e", "c", "e"), ("a", "b", "a", "e")]
_SWISS = """loc AS (SELECT cell_id, (2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y) * 100 / 36 AS lon,
  (16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x) * 100 / 36 AS lat FROM (SELECT cell_id, (e - 2600000.0) / 1000000.0 AS y, (n - 1200000.0) / 1000000.0 AS x FROM grid_cells))"""
_TILE = "floor((lon + 180) / 360 * 16384)::BIGINT AS tile_x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::BIGINT AS tile_y"


def _corner(bearing: int) -> str:
    d, b = f"({100.0 / 2 * 1.4142!r} / 6371008.8)", f"radians({bearing})"
    lat2 = f"asin(sin(radians(lat)) * cos({d}) + cos(radians(lat)) * sin({d}) * cos({b}))"
    return f"round(lon + degrees(atan2(sin({b}) * sin({d}) * cos(radians(lat)), cos({d}) - sin(radians(lat)) * sin({lat2}))), 8) AS x{{k}}, round(degrees({lat2}), 8) AS y{{k}}"


_LINES = "lin AS (SELECT s_suppkey % 17 AS ref, (6.55::DOUBLE + (s_suppkey * 37 % 140) * 0.001::DOUBLE) * 77000.0 AS lx1, (46.5::DOUBLE + (s_suppkey * 53 % 70) * 0.001::DOUBLE) * 111000.0 AS ly1 FROM supplier WHERE s_suppkey % 5 <> 0)"
SQL = {
    "j09_transit_edges": f"WITH {_SEG}, {_LINES}, hit AS (SELECT DISTINCT u, v, ref FROM seg, lin WHERE highway NOT IN ('motorway', 'motorway_link') AND abs(lx1 + 150 - x1) < 1000 AND abs(ly1 + 75 - y1) < 1000 AND {_between('x1', 'y1', 'x2', 'y2', 'lx1', 'ly1', '(lx1 + 300.0)', '(ly1 + 150.0)')} <= 8.0) SELECT e.u, e.v, count(ref) AS bus_route_count, coalesce(string_agg(ref::VARCHAR, ',' ORDER BY ref::VARCHAR), '') AS bus_route_refs FROM road_edges e LEFT JOIN hit h ON h.u = e.u AND h.v = e.v WHERE e.key = 0 GROUP BY e.u, e.v",
    "j10_osm_ways": "WITH e AS (SELECT DISTINCT u, v, unnest([u * 2, v + 5]) AS way FROM road_edges WHERE key = 0), h AS (SELECT DISTINCT u, v, (s_suppkey % 9)::VARCHAR AS ref FROM e JOIN supplier ON way = s_suppkey * 3) SELECT u, v, string_agg(ref, ',' ORDER BY ref) AS refs FROM h GROUP BY u, v",
    "j12_habitat_buffer": f"WITH {_SEG}, sq AS (SELECT s_suppkey AS poly_id, x - 25.0 AS a, y - 25.0 AS b, x + 25.0 AS c, y + 25.0 AS e FROM (SELECT s_suppkey, (6.5513::DOUBLE + (s_suppkey * 41 % 140) * 0.001::DOUBLE) * 77000.0 AS x, (46.5011::DOUBLE + (s_suppkey * 59 % 70) * 0.001::DOUBLE) * 111000.0 AS y FROM supplier)) SELECT u, v, count(*) AS pieces, round(sum((c - a) * (e - b)), 2) AS polygon_area_m2 FROM seg, sq WHERE abs(a - x1) < 1000 AND abs(b - y1) < 1000 AND least({', '.join(_between('x1', 'y1', 'x2', 'y2', *s) for s in _SQ)}) <= 10.0 GROUP BY u, v",
    "p11_habitat_density": "WITH h AS (SELECT road_id, sum(area)::BIGINT AS area FROM habitats GROUP BY road_id) SELECT u, v, area, round(area::DOUBLE / length_m, 6) AS density FROM road_edges JOIN h ON road_id = u WHERE key = 0 AND area > 0",
    "p15_habitat_filter": "SELECT code, count(*) AS n, sum(area)::BIGINT AS area FROM habitats WHERE code NOT LIKE '9%' AND code NOT LIKE '8%' AND code NOT LIKE '5%' AND code NOT LIKE 'STR%' AND code <> '4.4' AND poly_id <> 77 GROUP BY code",
    "p16_bounding_box": "SELECT centroid_id FROM centroids WHERE lon BETWEEN 6.58 AND 6.64 AND lat BETWEEN 46.51 AND 46.55",
    "a22_area_per_road": "SELECT road_id, sum(area)::BIGINT AS area, count(DISTINCT poly_id) AS polygons FROM habitats GROUP BY road_id",
    "w03_habitat_windows": "WITH r AS (SELECT road_id, code[1:3] AS prefix, poly_id, sum(area)::BIGINT AS area, min(CASE WHEN road_x < area_x THEN 'left' ELSE 'right' END) AS side FROM habitats GROUP BY 1, 2, 3), g AS (SELECT road_id, prefix, sum(area)::BIGINT AS total, max(area) AS largest, count(*)::INT AS polygons, string_agg(poly_id::VARCHAR, '-' ORDER BY poly_id) AS members FROM r GROUP BY 1, 2) SELECT road_id, prefix, poly_id, side, total, largest, round(total::DOUBLE / largest, 6) AS gain, polygons, members FROM (SELECT *, row_number() OVER (PARTITION BY prefix, poly_id ORDER BY road_id) AS place FROM r) JOIN g USING (road_id, prefix) WHERE place = 1",
    "a24_connectivity": "WITH c AS (SELECT code[1:1] AS kind, poly_id, sum(area)::DOUBLE AS a FROM habitats GROUP BY 1, 2), t AS (SELECT kind, sum(a) AS total FROM c GROUP BY kind) SELECT kind, round(sum(x.a * y.a * exp(-abs(x.poly_id - y.poly_id) * 100.0 / 500.0)) / any_value(total * total), 9) AS pc FROM c x JOIN c y USING (kind) JOIN t USING (kind) GROUP BY kind",
    "a18_track_lines": "WITH p AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM tracks WHERE lon IS NOT NULL WINDOW w AS (PARTITION BY date, vehicle ORDER BY seq)) SELECT date, vehicle, count(*) AS points, min(seq) AS first_seq, round(sum(sqrt((px - lon) * (px - lon) + (py - lat) * (py - lat)) ORDER BY seq), 9) AS length FROM p GROUP BY date, vehicle HAVING count(*) >= 2",
    "a19_track_statistics": "WITH p AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM tracks WHERE lon IS NOT NULL WINDOW w AS (PARTITION BY date, vehicle ORDER BY seq)), l AS (SELECT date, vehicle, count(*) AS points, sum(sqrt((px - lon) * (px - lon) + (py - lat) * (py - lat))) AS length FROM p GROUP BY date, vehicle HAVING count(*) >= 2) SELECT count(DISTINCT date) AS days, count(DISTINCT vehicle) AS vehicles, round(avg(points), 6) AS mean_points, round(sum(length), 4) AS length FROM l",
    "a20_distinct_values": "SELECT (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) AS p_brand, (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT p_type AS b FROM part)) AS p_type",
    "a21_value_counts": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type",
    "f09_reprojection": f"WITH {_SWISS} SELECT cell_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM loc",
    "f10_grid_squares": f"WITH {_SWISS} SELECT cell_id, 5 AS corners, {_corner(45).replace('{k}', '0')}, {_corner(225).replace('{k}', '2')} FROM loc",
    "f11_mercator_squares": f"WITH {_SWISS} SELECT cell_id, 40000.0::DOUBLE AS area, round(radians(lon) * 6378137.0 - 100, 4) AS x0, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 - 100, 4) AS y0 FROM loc",
    "f12_line_lengths": "SELECT year, round(sum(sqrt(pow(e - pe, 2) + pow(n - pn, 2))), 3) AS metres FROM (SELECT *, lag(e) OVER w AS pe, lag(n) OVER w AS pn FROM grid_cells WINDOW w AS (PARTITION BY year ORDER BY cell_id)) GROUP BY year",
    "f39_midpoints": "SELECT centroid_id, round(lon + 0.002, 9) AS mx, round(lat, 9) AS my, round(lat - 5.0 / 111000.0, 9) AS oy, round(lon + 0.003 + 5.0 / 77000.0, 9) AS ox FROM centroids",
    "f42_wkt": "SELECT node_id, 'LINESTRING (' || gx || ' ' || gy || ', ' || (gx + 1) || ' ' || gy || ')' AS wkt FROM road_nodes",
    "u01_union_of_files": "SELECT id::BIGINT AS id, 'income' AS first, 'noise' AS second, 'pearson' AS measure, 'value-pearson' AS label, 'co' AS prefix FROM (SELECT n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT s_suppkey FROM supplier)",
    "u05_distinct_nodes": "SELECT u AS node FROM road_edges UNION SELECT v FROM road_edges",
    "s04_network_union": "SELECT u, v, key, length_m FROM road_edges WHERE u % 3 <> 0 OR v % 2 = 0",
    "f19_code_names": "SELECT CASE waste_type WHEN 'BU' THEN 'Building' WHEN 'MA' THEN 'Machinery' WHEN 'FU' THEN 'Furniture' END AS or_null, CASE waste_type WHEN 'BU' THEN 'Building' WHEN 'MA' THEN 'Machinery' WHEN 'FU' THEN 'Furniture' ELSE waste_type END AS or_code, CASE waste_type WHEN 'BU' THEN 'Building' WHEN 'MA' THEN 'Machinery' WHEN 'FU' THEN 'Furniture' ELSE 'Unknown' END AS or_unknown, count(*) AS n FROM centroids GROUP BY waste_type",
    "s05_elevation": "SELECT node_id, z FROM road_nodes LEFT JOIN (SELECT s_suppkey % 25 AS cx, s_suppkey // 25 AS cy, min(350 + s_suppkey * 3 % 90) AS z FROM supplier GROUP BY 1, 2) ON cx = gx // 2 AND cy = gy // 4",
    "k04_tiles": f"SELECT tile_x, tile_y, count(*) AS points, round(avg(count), 6) AS mean FROM (SELECT count, {_TILE} FROM centroids) GROUP BY tile_x, tile_y",
    "k06_densest_dropped": f"SELECT tile_x, tile_y, centroid_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY count DESC, centroid_id) AS place FROM (SELECT centroid_id, count, {_TILE} FROM centroids)) WHERE place <= 5",
    "k03_geojson_features": "SELECT u, v, highway, 2::INT AS points FROM road_edges WHERE key = 0",
}

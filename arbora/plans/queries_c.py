"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import labels
from arbora.operators import chips, matching, rasters, spatial
from arbora.plans.queries import query
from arbora.plans.standins import duck, load
from arbora.sources import sinks

_MEET = "{a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax"


@query(duck(f"SELECT tile_id FROM tiles AS t WHERE EXISTS (SELECT 1 FROM map_boxes AS m WHERE {_MEET.format(a='t', b='m')})", "tiles", "map_boxes"))
def c01_tiles_with_boxes(spark, d):
    return spatial.tiles_with_boxes(load(spark, d, "tiles"), load(spark, d, "map_boxes")).select("tile_id")


@query(duck("SELECT tile_id FROM tiles WHERE tile_id IN (SELECT concat('32_', 355 + l_suppkey % 40, '_', 6040 + l_linenumber) FROM lineitem)", "tiles"))
def c02_tile_semi_join(spark, d):
    seen = load(spark, d, "lineitem").select(F.concat(F.lit("32_"), (F.lit(355) + F.col("l_suppkey") % 40).cast("string"), F.lit("_"), (F.lit(6040) + F.col("l_linenumber")).cast("string")).alias("tile_id"))
    return load(spark, d, "tiles").join(seen, "tile_id", "left_semi").select("tile_id")


#: Four chips of 512 m (512 pixels of 1 m) for each tile, overlapping by 12 m.
T = (1.0, 0.0, 355000.0, 0.0, -1.0, 7000000.0)
_CHIPS = """SELECT concat(tile_id, '_', 2 * r + c) AS chip_id, CAST(7000000 - (ymax - r * 500) AS INTEGER) AS row0, CAST(xmin + c * 500 - 355000 AS INTEGER) AS col0, xmin + c * 500 AS xmin, ymax - r * 500 - 512 AS ymin, xmin + c * 500 + 512 AS xmax, ymax - r * 500 AS ymax
 FROM tiles, (SELECT unnest(range(2)) AS c), (SELECT unnest(range(2)) AS r)"""


def _chips(spark, d):
    axis = F.explode(F.array(F.lit(0), F.lit(1)))
    g = load(spark, d, "tiles").withColumn("r", axis).withColumn("c", axis)
    x, y = F.col("xmin") + F.col("c") * 500, F.col("ymax") - F.col("r") * 500
    name = F.concat(F.col("tile_id"), F.lit("_"), (2 * F.col("r") + F.col("c")).cast("string"))
    return g.select(name.alias("chip_id"), (7000000 - y).cast("int").alias("row0"), (x - 355000).cast("int").alias("col0"), x.alias("xmin"), (y - 512).alias("ymin"), (x + 512).alias("xmax"), y.alias("ymax"))


@query(duck(f"WITH chips AS ({_CHIPS}) SELECT chip_id, box_id FROM chips AS c JOIN map_boxes AS m ON m.xmin <= c.xmax + 0.01e0 AND c.xmin - 0.01e0 <= m.xmax AND m.ymin <= c.ymax + 0.01e0 AND c.ymin - 0.01e0 <= m.ymax", "tiles", "map_boxes"))
def c03_chip_boxes(spark, d):
    boxes = load(spark, d, "map_boxes").select("box_id", *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    return spatial.box_join(_chips(spark, d), boxes, 12.0, grow=0.01).select("chip_id", "box_id")


_LABEL = f"""WITH chips AS ({_CHIPS}), l AS (SELECT chip_id, box_id, class_id AS cls, ((m.xmin - 355000 - col0) / 512 + (m.xmax - 355000 - col0) / 512) / 2 AS xc,
 ((7000000 - m.ymin - row0) / 512 + (7000000 - m.ymax - row0) / 512) / 2 AS yc, (m.xmax - m.xmin) / 512 AS w, (m.ymax - m.ymin) / 512 AS h FROM chips AS c JOIN map_boxes AS m
 ON m.xmin <= c.xmax + 0.01e0 AND c.xmin - 0.01e0 <= m.xmax AND m.ymin <= c.ymax + 0.01e0 AND c.ymin - 0.01e0 <= m.ymax) SELECT chip_id, box_id, cls, round(xc, 6) AS xc, round(yc, 6) AS yc, round(w, 6) AS w, round(h, 6) AS h FROM l WHERE xc BETWEEN 0 AND 1 AND yc BETWEEN 0 AND 1"""


@query(duck(_LABEL, "tiles", "map_boxes"))
def b18_chip_labels(spark, d):
    found = chips.chip_labels(_chips(spark, d), load(spark, d, "map_boxes"), 512, T, 12.0, "class_id")
    return found.select("chip_id", "box_id", "cls", *[F.round(c, 6).alias(c) for c in ("xc", "yc", "w", "h")])


@query(duck("SELECT tree_id, tile_id FROM trees LEFT JOIN tiles ON x > xmin AND x < xmax AND y > ymin AND y < ymax", "trees", "tiles"))
def c04_point_in_tile(spark, d):
    return spatial.points_in_tiles(load(spark, d, "trees"), load(spark, d, "tiles")).select("tree_id", "tile_id")


@query(duck("SELECT p_partkey AS id, class_name, class_id FROM part JOIN classes ON p_partkey % 10 = class_id", "classes"))
def c05_class_lookup(spark, d):
    classes = load(spark, d, "classes")
    named = load(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).cast("int").alias("class_id")).join(classes, "class_id", "left")
    # And back: a name that is not in the table is an error.
    back = named.select("id", "class_name").join(classes, "class_name", "left")
    return back.select("id", "class_name", F.coalesce("class_id", F.raise_error(F.concat(F.lit("unknown class "), "class_name")).cast("int")).alias("class_id"))


@query(duck("SELECT o_orderkey, tree_id, canopyWidt FROM orders LEFT JOIN trees ON o_custkey = tree_id", "trees"))
def c06_canopy_width(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "trees"), F.col("o_custkey") == F.col("tree_id"), "left").select("o_orderkey", "tree_id", "canopyWidt")


@query(duck("SELECT image_path, c_acctbal AS m01 FROM image_paths LEFT JOIN customer ON split_part(split_part(image_path, '/', 5), '_', 1) = CAST(c_custkey AS VARCHAR)", "image_paths"))
def c07_image_features(spark, d):
    from arbora.functions.ids import image_index

    features = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("tree_id"), F.col("c_acctbal").alias("m01"))
    return image_index(load(spark, d, "image_paths")).join(features, "tree_id", "left").select("image_path", "m01")


_IOU = """SELECT p.image_id, pred_id, pred_cls, conf, gt_id, gt_cls, w * h / (pa + ga - w * h) AS iou FROM (SELECT p.*, gt_id, gt_cls, least(p.x2, g.x2) - greatest(p.x1, g.x1) AS w, least(p.y2, g.y2) - greatest(p.y1, g.y1) AS h,
 (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga FROM pred_boxes AS p JOIN gt_boxes AS g ON p.image_id = g.image_id) AS p WHERE w > 0 AND h > 0"""


@query(duck(f"SELECT pred_id, gt_id, round(iou, 6) AS iou FROM ({_IOU})", "pred_boxes", "gt_boxes"))
def c08_iou_pairs(spark, d):
    return matching.iou_pairs(load(spark, d, "pred_boxes"), load(spark, d, "gt_boxes")).select("pred_id", "gt_id", F.round("iou", 6).alias("iou"))


_EDGES = """SELECT a, b, w * h / (aa + ba - w * h) AS iou FROM (SELECT a.box_id AS a, b.box_id AS b, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS w, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS h,
 (a.xmax - a.xmin) * (a.ymax - a.ymin) AS aa, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS ba FROM map_boxes AS a JOIN map_boxes AS b ON a.box_id < b.box_id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax) AS p WHERE w * h / (aa + ba - w * h) > 0.3e0"""


@query(duck(f"SELECT a, b, round(iou, 6) AS iou FROM ({_EDGES})", "map_boxes"))
def c09_overlap_pairs(spark, d):
    return spatial.overlap_pairs(load(spark, d, "map_boxes"), "box_id", 12.0, 0.3).select("a", "b", F.round("iou", 6).alias("iou"))


_HEIGHT = "SELECT tile, row, col, height FROM heights WHERE tile % 3 > 0"
_STACK = """WITH h AS (SELECT tile, row, col, height FROM heights WHERE tile % 3 > 0), r AS (SELECT tile, min(height) AS a, max(height) AS b FROM h GROUP BY tile HAVING min(height) IS NOT NULL)
 SELECT tile, band, row, col, value FROM pixels WHERE band < 5 AND tile IN (SELECT tile FROM r) UNION ALL
 SELECT tile, CAST(5 AS INTEGER), row, col, CAST(CASE WHEN height IS NULL THEN NULL WHEN b = a THEN 0 ELSE floor(255 * (height - a) / (b - a)) END AS INTEGER) FROM h JOIN r USING (tile)"""


@query(duck(_STACK, "pixels", "heights"))
def c10_band_stack(spark, d):
    return rasters.stack(load(spark, d, "pixels"), load(spark, d, "heights").where("tile % 3 > 0"))


@query(duck("""SELECT a.tile, a.row, a.col, CASE WHEN a.height <> 5 AND b.height <> 3 THEN a.height - b.height END AS value FROM heights AS a LEFT JOIN (SELECT * FROM heights WHERE (tile + row) % 11 > 0) AS b
 ON b.tile = a.tile AND b.row = a.col AND b.col = a.row""", "heights"))
def c11_height_model(spark, d):
    h = load(spark, d, "heights")
    ground = h.where("(tile + row) % 11 > 0").select("tile", F.col("col").alias("row"), F.col("row").alias("col"), F.col("height").alias("value"))
    return rasters.height_model(h.withColumnRenamed("height", "value"), ground, ["tile", "row", "col"], 5.0, 3.0)


_SOURCE = """WITH n AS (SELECT tile, row, col, CASE WHEN tile % 4 = 1 THEN NULL ELSE height END AS value FROM heights WHERE tile % 4 < 2), c AS (SELECT tile, row, col, height + 1 AS value FROM heights WHERE tile % 4 IN (0, 1, 2)),
 s AS (SELECT tile, CASE WHEN tile IN (SELECT tile FROM n WHERE value IS NOT NULL) THEN 'ndom' WHEN tile IN (SELECT tile FROM c WHERE value IS NOT NULL) THEN 'chm' ELSE 'none' END AS source FROM (SELECT DISTINCT tile FROM heights)),
 p AS (SELECT *, 'ndom' AS source FROM n UNION ALL SELECT *, 'chm' FROM c) SELECT tile, source, row, col, value FROM s LEFT JOIN p USING (tile, source)"""


@query(duck(_SOURCE, "heights"))
def c12_height_source(spark, d):
    h = load(spark, d, "heights").withColumnRenamed("height", "value")
    ndom = h.where("tile % 4 < 2").withColumn("value", F.when(F.col("tile") % 4 != 1, F.col("value")))
    chm = h.where("tile % 4 < 3").withColumn("value", F.col("value") + 1)
    return rasters.choose_height(h.select("tile").distinct(), ndom, chm).select("tile", "source", "row", "col", "value")


@query("""WITH w AS (SELECT DISTINCT p_partkey % 40 AS x, p_size AS y FROM part), i AS (SELECT DISTINCT s_suppkey % 40 AS x, s_nationkey * 2 AS y FROM supplier), t AS (SELECT x, y, k, x + dx AS fx, y + dy AS fy FROM w, (VALUES (0, 0, 0), (1, 0, -1), (2, -1, 0), (3, -1, -1)) AS o(k, dx, dy)),
 f AS (SELECT t.x, t.y, k, concat('f_', fx, '_', fy) AS file FROM t JOIN i ON fx = i.x AND fy = i.y)
 SELECT w.x, CAST(w.y AS BIGINT) AS y, CASE WHEN k IS NULL THEN 'failed' ELSE 'success' END AS status, file, CAST(k AS INTEGER) AS fallback_index FROM w LEFT JOIN (SELECT x, y, min(k) AS k, min_by(file, k) AS file FROM f GROUP BY x, y) AS b ON b.x = w.x AND b.y = w.y""")
def c13_fallback_tile(spark, d):
    wanted = load(spark, d, "part").select((F.col("p_partkey") % 40).alias("x"), F.col("p_size").cast("bigint").alias("y")).distinct()
    there = load(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("x"), (F.col("s_nationkey") * 2).cast("bigint").alias("y")).distinct()
    there = there.withColumn("file", F.concat_ws("_", F.lit("f"), F.col("x").cast("string"), F.col("y").cast("string")))
    return sinks.first_available(wanted, there).select("x", "y", "status", "file", "fallback_index")


_ZONES = "SELECT gt_id AS det_id, image_id AS tile, CAST(x1 % 8 AS BIGINT) AS px1, CAST(y1 % 8 AS BIGINT) AS py1, CAST(least(8, x1 % 8 + 1 + gt_cls % 4) AS BIGINT) AS px2, CAST(least(8, y1 % 8 + gt_cls % 3) AS BIGINT) AS py2 FROM gt_boxes"
_ZONAL = f"SELECT det_id, value FROM ({_ZONES}) AS z JOIN (SELECT * FROM pixels WHERE band = 5) AS p ON p.tile = z.tile AND col >= px1 AND col < px2 AND row >= py1 AND row < py2"


def _zones(spark, d):
    g = load(spark, d, "gt_boxes")
    low = lambda c: (F.col(c) % 8).cast("bigint")
    most = F.lit(8).cast("bigint")
    return g.select(F.col("gt_id").alias("det_id"), F.col("image_id").alias("tile"), low("x1").alias("px1"), low("y1").alias("py1"), F.least(most, low("x1") + 1 + F.col("gt_cls") % 4).alias("px2"), F.least(most, low("y1") + F.col("gt_cls") % 3).alias("py2"))


@query(duck(_ZONAL, "gt_boxes", "pixels"))
def c14_zonal_join(spark, d):
    return spatial.pixels_in_boxes(_zones(spark, d), load(spark, d, "pixels").where("band = 5"), 4).select("det_id", "value")


@query(duck(f"SELECT det_id, max(value) AS value_max, min(value) AS value_min FROM ({_ZONES}) LEFT JOIN ({_ZONAL}) USING (det_id) GROUP BY det_id", "gt_boxes", "pixels"))
def d03_zonal_range(spark, d):
    zones = _zones(spark, d)
    return rasters.zonal_range(spatial.pixels_in_boxes(zones, load(spark, d, "pixels").where("band = 5"), 4), zones)


@query(duck("SELECT 'class' AS kind, genus AS name FROM (SELECT DISTINCT trim(genus) AS genus FROM trees WHERE trim(coalesce(genus, '')) <> '') WHERE genus NOT IN (SELECT class_name FROM classes) UNION ALL SELECT 'point', CAST(tree_id AS VARCHAR) FROM trees WHERE NOT EXISTS (SELECT 1 FROM tiles WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax)", "trees", "classes", "tiles"))
def c15_anti_joins(spark, d):
    trees = load(spark, d, "trees")
    genera = trees.select(labels.normalize_genus(F.col("genus")).alias("name")).where("name <> ''").distinct()
    unknown = genera.join(load(spark, d, "classes").select(F.col("class_name").alias("name")), "name", "left_anti").select(F.lit("class").alias("kind"), "name")
    inside = spatial.points_in_tiles(trees, load(spark, d, "tiles")).where("tile_id is not null").select("tree_id")
    outside = trees.join(inside, "tree_id", "left_anti").select(F.lit("point").alias("kind"), F.col("tree_id").cast("string").alias("name"))
    return unknown.unionByName(outside)


@query(duck("SELECT i.image_id, count(g.gt_id) AS n_boxes FROM (SELECT DISTINCT CAST(floor(l_orderkey / 16.0e0) AS BIGINT) AS image_id FROM lineitem) AS i LEFT JOIN gt_boxes AS g ON g.image_id = i.image_id GROUP BY i.image_id", "gt_boxes"))
def c16_images_without_labels(spark, d):
    images = load(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16.0).alias("image_id")).distinct()
    counts = load(spark, d, "gt_boxes").groupBy("image_id").agg(F.count("*").alias("n"))
    return images.join(counts, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_boxes"))


#: Tiles of 8 x 8 pixels at steps of 6: neighbours overlap by two pixels.
_WORLD = "SELECT tile, band, CAST(row + (tile // 10) * 6 AS INTEGER) AS wrow, CAST(col + (tile % 10) * 6 AS INTEGER) AS wcol, value FROM pixels"


@query(duck(f"SELECT band, CAST(wrow - 5 AS INTEGER) AS wrow, CAST(wcol - 10 AS INTEGER) AS wcol, value FROM (SELECT band, wrow, wcol, min_by(value, tile) AS value FROM ({_WORLD}) GROUP BY band, wrow, wcol) WHERE wcol >= 10 AND wcol < 30 AND wrow >= 5 AND wrow < 25", "pixels"))
def c17_mosaic_cut(spark, d):
    p = load(spark, d, "pixels")
    world = p.withColumns({"wrow": F.col("row") + (F.floor(F.col("tile") / 10) * 6).cast("int"), "wcol": F.col("col") + (F.col("tile") % 10 * 6).cast("int")})
    whole = chips.mosaic(world, "tile")
    return chips.cut(whole, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 10.4, -25.4, 30.4, -5.4)

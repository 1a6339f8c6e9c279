"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import geo, ids, labels, losses, raster
from arbora.operators import chips, scoring
from arbora.plans.queries import query
from arbora.plans.queries_a import BY_END, _label_rows
from arbora.plans.standins import duck, load

T = (0.2, 0.0, 355000.0, 0.0, -0.2, 6050000.0)  #: 20 cm pixels from the upper left corner


@query(duck("""SELECT raw, CASE k WHEN 3 THEN NULL ELSE concat('32_', x, '_', y) END AS tile_id FROM (SELECT *, CASE k WHEN 0 THEN concat(x, '-', y) WHEN 1 THEN concat(' ', x, '_', y) WHEN 2 THEN tile_id ELSE concat('t', x) END AS raw
 FROM (SELECT tile_id, CAST(split_part(tile_id, '_', 2) AS INT) % 4 AS k, split_part(tile_id, '_', 2) AS x, split_part(tile_id, '_', 3) AS y FROM tiles))""", "tiles"))
def b01_normalize_tile_id(spark, d):
    p = F.split("tile_id", "_")
    x, y = p[1], p[2]
    k = x.cast("int") % 4
    raw = F.when(k == 0, F.concat(x, F.lit("-"), y)).when(k == 1, F.concat(F.lit(" "), x, F.lit("_"), y)).when(k == 2, F.col("tile_id")).otherwise(F.concat(F.lit("t"), x))
    return load(spark, d, "tiles").select(raw.alias("raw")).withColumn("tile_id", ids.normalize_tile_id(F.col("raw")))


_BY_PLACE = "concat(substr(dop_kachel, 1, 2), '_', substr(dop_kachel, 3, 3), '_', substr(dop_kachel, 6, 4))"


@query(duck(f"SELECT dop_kachel, {BY_END.format(k='dop_kachel')} AS by_end, {_BY_PLACE} AS by_place, {BY_END.format(k='long_key')} AS long_end FROM (SELECT dop_kachel, concat(dop_kachel, '77') AS long_key FROM tiles)", "tiles"))
def b02_key_to_tile_id(spark, d):
    c = F.col("dop_kachel")
    return load(spark, d, "tiles").select(c, ids.key_to_tile_id(c).alias("by_end"), ids.key_to_tile_id_fixed(c).alias("by_place"), ids.key_to_tile_id(F.concat(c, F.lit("77"))).alias("long_end"))


@query(duck("SELECT split_part(tile_id, '_', 2) AS x, split_part(tile_id, '_', 3) AS y FROM tiles WHERE CAST(right(tile_id, 1) AS INT) <> 0", "tiles"))
def b03_parse_xy(spark, d):
    p = F.split("tile_id", "_")
    raw = F.when(F.right("tile_id", F.lit(1)).cast("int") == 0, p[1]).otherwise(F.concat(p[1], F.lit("-"), p[2]))
    return load(spark, d, "tiles").select(ids.parse_xy(raw).alias("p")).where("p is not null").select("p.*")


@query(duck("SELECT concat('rgbih_', tile_id) AS raster, tile_id AS parsed FROM tiles", "tiles"))
def b04_raster_name(spark, d):
    return load(spark, d, "tiles").select(ids.raster_name("RGBIH", F.col("tile_id")).alias("raster")).withColumn("parsed", ids.tile_id_of_stem(F.col("raster"), "RGBIH"))


@query(duck("SELECT tree_id, trim(genus) AS genus FROM trees WHERE trim(coalesce(genus, '')) <> ''", "trees"))
def b05_normalize_genus(spark, d):
    return load(spark, d, "trees").select("tree_id", labels.normalize_genus(F.col("genus")).alias("genus")).where("genus <> ''")


_CLASSED = """SELECT tree_id, g AS genus, CAST(CASE WHEN g IN ('Pinus', 'Picea') THEN 3 ELSE coalesce(class_id, 5) END AS INTEGER) AS training_class
 FROM (SELECT tree_id, trim(genus) AS g FROM trees WHERE trim(coalesce(genus, '')) <> '') LEFT JOIN classes ON g = class_name"""


@query(duck(_CLASSED, "trees", "classes"))
def b06_assign_class(spark, d):
    return labels.assign_classes(load(spark, d, "trees"), load(spark, d, "classes")).select("tree_id", "genus", "training_class")


@query(duck("SELECT tree_id, CAST(tree_id AS VARCHAR) AS kept, sha256(concat(CAST(tree_id AS VARCHAR), '|', coalesce(genus, ''))) AS made FROM trees", "trees"))
def b07_stable_id(spark, d):
    trees = load(spark, d, "trees")
    kept = labels.with_ids(trees, "tree_id", []).select("tree_id", F.col("uid").alias("kept"))
    return kept.join(labels.with_ids(trees, None, ["tree_id", "genus"]).select("tree_id", F.col("uid").alias("made")), "tree_id")


@query(duck("""SELECT tree_id, x - w / 2 AS xmin, y - w / 2 AS ymin, x + w / 2 AS xmax, y + w / 2 AS ymax FROM (SELECT tree_id, x, y, TRY_CAST(canopyWidt AS DOUBLE) AS w FROM trees) WHERE w > 0 AND w >= 2""", "trees"))
def b08_canopy_box(spark, d):
    return labels.canopy_boxes(load(spark, d, "trees"), min_width=2.0).select("tree_id", "xmin", "ymin", "xmax", "ymax")


_WIDE = "SELECT tile, row, col, max(CASE WHEN band = 1 THEN value END) AS red, max(CASE WHEN band = 4 THEN value END) AS nir, max(CASE WHEN band = 5 THEN value END) AS h FROM pixels GROUP BY tile, row, col"


def _wide(spark, d):
    pick = lambda b, n: F.max(F.when(F.col("band") == b, F.col("value"))).alias(n)
    return load(spark, d, "pixels").groupBy("tile", "row", "col").agg(pick(1, "red"), pick(4, "nir"), pick(5, "h"))


@query(duck(f"SELECT tile, row, col, round((nir - red) / (nir + red + 1e-6), 6) AS ndvi FROM ({_WIDE})", "pixels"))
def b09_ndvi(spark, d):
    return _wide(spark, d).select("tile", "row", "col", F.round(raster.ndvi(F.col("nir"), F.col("red")), 6).alias("ndvi"))


#: A tile may lack bands; what is not known is outside the masks.
@query(duck(f"SELECT tile, row, col, v AS veg, t AS tall, v AND t AS canopy, coalesce(h > 0, false) AS any_height FROM (SELECT *, coalesce((nir - red) / (nir + red + 1e-6) >= 0.05e0, false) AS v, coalesce(h / 10.0e0 >= 12, false) AS t FROM ({_WIDE}))", "pixels"))
def b10_masks(spark, d):
    h = F.col("h") / 10.0
    masks = raster.canopy_masks(raster.ndvi(F.col("nir"), F.col("red")), h, 0.05, 12.0)
    return _wide(spark, d).select("tile", "row", "col", *[c.alias(n) for n, c in masks.items()], raster.height_mask(h, 0).alias("any_height"))


_RANGE = "SELECT tile, CASE WHEN max(height) <= min(height) THEN 0 ELSE min(height) END AS vmin, CASE WHEN max(height) <= min(height) THEN 0 ELSE max(height) END AS vmax FROM heights GROUP BY tile"
_U8 = f"SELECT tile, row, col, vmin, vmax, CAST(CASE WHEN height IS NULL THEN NULL WHEN vmax = vmin THEN 0 ELSE floor(255 * (height - vmin) / (vmax - vmin)) END AS INTEGER) AS value FROM heights JOIN ({_RANGE}) USING (tile)"


def _u8(spark, d):
    from arbora.operators.rasters import height_range

    h = load(spark, d, "heights")
    return h.join(height_range(h), "tile").withColumn("value", raster.height_to_u8(F.col("height"), F.col("vmin"), F.col("vmax")))


@query(duck(f"SELECT tile, row, col, value FROM ({_U8})", "heights"))
def b11_height_to_u8(spark, d):
    return _u8(spark, d).select("tile", "row", "col", "value")


@query(duck(f"SELECT tile, row, col, round(value / 255.0e0 * (vmax - vmin) + vmin, 6) AS metres FROM ({_U8})", "heights"))
def b12_u8_to_height(spark, d):
    return _u8(spark, d).select("tile", "row", "col", F.round(raster.u8_to_height(F.col("value"), F.col("vmin"), F.col("vmax")), 6).alias("metres"))


@query(duck("SELECT gt_id, round(355000 + 0.2e0 * x1, 6) AS xmin, round(6050000 - 0.2e0 * (y2 + 1), 6) AS ymin, round(355000 + 0.2e0 * (x2 + 1), 6) AS xmax, round(6050000 - 0.2e0 * y1, 6) AS ymax FROM gt_boxes", "gt_boxes"))
def b13_pixel_to_map(spark, d):
    box = geo.box_to_map(T, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return load(spark, d, "gt_boxes").select("gt_id", *[F.round(c, 6).alias(n) for n, c in box.items()])


@query(duck("SELECT tree_id, CAST(floor((x - 355000) / 0.2e0 + 1e-7) AS BIGINT) AS col, CAST(floor((6050000 - y) / 0.2e0 + 1e-7) AS BIGINT) AS row FROM trees", "trees"))
def b14_map_to_pixel(spark, d):
    col, row = geo.map_to_pixel(T, F.col("x"), F.col("y"))
    return load(spark, d, "trees").select("tree_id", F.floor(col + 1e-7).alias("col"), F.floor(row + 1e-7).alias("row"))


@query(duck("SELECT box_id, xmin, ymin, xmax, ymax, (xmax - xmin) * (ymax - ymin) AS area, (xmax - xmin) * (ymax - ymin) AS ring_area, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM map_boxes", "map_boxes"))
def b15_geometry(spark, d):
    b = load(spark, d, "map_boxes").withColumn("ring", geo.box_ring())
    at = geo.crown_attributes()
    return b.select("box_id", *[c.alias(n) for n, c in geo.ring_bounds("ring").items()], geo.box_area().alias("area"), geo.ring_area("ring").alias("ring_area"), at["centroid_x"].alias("cx"), at["centroid_y"].alias("cy"))


@query(duck("""SELECT gt_id, CAST(greatest(0, floor(x1 / 3 + 100)) AS BIGINT) AS px1, CAST(greatest(0, floor(y1 / 3 - 50)) AS BIGINT) AS py1, CAST(least(250, ceil(x2 / 3 + 100)) AS BIGINT) AS px2, CAST(least(120, ceil(y2 / 3 - 50)) AS BIGINT) AS py2 FROM gt_boxes""", "gt_boxes"))
def b16_clip_box(spark, d):
    box = geo.clip_box(*[F.col(c) / 3 for c in ("x1", "y1", "x2", "y2")], F.lit(100), F.lit(-50), 250, 120)
    return load(spark, d, "gt_boxes").select("gt_id", *[c.alias(n) for n, c in box.items()])


@query(duck("SELECT box_id, round(sqrt((xmax - xmin) ** 2 + (ymax - ymin) ** 2), 6) AS diameter, (xmin + xmax) / 2 AS centroid_x, (ymin + ymax) / 2 AS centroid_y FROM map_boxes", "map_boxes"))
def b17_crown_attributes(spark, d):
    a = geo.crown_attributes()
    return load(spark, d, "map_boxes").select("box_id", F.round(a["diameter"], 6).alias("diameter"), a["centroid_x"].alias("centroid_x"), a["centroid_y"].alias("centroid_y"))


@query(duck("SELECT gt_id, CAST(gt_cls + 1 AS INTEGER) AS cls, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM gt_boxes", "gt_boxes"))
def b19_label_to_pixels(spark, d):
    box = chips.label_to_pixels(640, 640, offset=1)
    return _label_rows(spark, d).select("gt_id", *[(F.round(c, 6) if n != "cls" else c).alias(n) for n, c in box.items()])


@query(duck("SELECT doc_id, concat('/data/labels/', split_part(image_path, '/', 3), '/', replace(split_part(image_path, '/', 5), '.tif', '.txt')) AS label_path FROM image_paths", "image_paths"))
def b20_label_path(spark, d):
    p = F.split("image_path", "/")
    path = F.concat_ws("/", F.lit("/data/images"), p[2], p[4])
    return load(spark, d, "image_paths").select("doc_id", ids.label_path(path).alias("label_path"))


_IMAGES = "SELECT image_id, dense_rank() OVER (ORDER BY image_id) - 1 AS image FROM (SELECT image_id FROM gt_boxes UNION SELECT image_id FROM pred_boxes)"


@query(duck(f"""SELECT row_number() OVER (ORDER BY image, gt_id) AS id, image AS image_id, CAST(gt_cls + 1 AS INTEGER) AS category_id, x1 AS bx, y1 AS by_, x2 - x1 AS bw, y2 - y1 AS bh, (x2 - x1) * (y2 - y1) AS area
 FROM gt_boxes JOIN ({_IMAGES}) USING (image_id)""", "gt_boxes", "pred_boxes"))
def b21_coco_annotations(spark, d):
    a = scoring.coco_tables(load(spark, d, "gt_boxes"), load(spark, d, "pred_boxes"))["annotations"]
    return a.select("id", "image_id", "category_id", *[a["bbox"][k].alias(n) for k, n in enumerate(("bx", "by_", "bw", "bh"))], "area")


@query(duck(f"SELECT pred_id, image AS image_id, CAST(pred_cls + 1 AS INTEGER) AS category_id, x1 AS bx, x2 - x1 AS bw, conf AS score FROM pred_boxes JOIN ({_IMAGES}) USING (image_id) WHERE conf >= 0.05e0", "gt_boxes", "pred_boxes"))
def b21_coco_detections(spark, d):
    a = scoring.coco_tables(load(spark, d, "gt_boxes"), load(spark, d, "pred_boxes"), 0.05)["detections"]
    return a.select("pred_id", "image_id", "category_id", a["bbox"][0].alias("bx"), a["bbox"][2].alias("bw"), "score")


@query(duck("SELECT pred_id, conf FROM pred_boxes WHERE conf >= 0.25e0", "pred_boxes"))
def b22_confidence_filter(spark, d):
    return load(spark, d, "pred_boxes").where(F.col("conf") >= 0.25).select("pred_id", "conf")


@query(duck("SELECT tile, band, row, col, round(value / 255.0e0, 6) AS u8, round(least(value * 300 / 65535.0e0, 1), 6) AS f FROM pixels", "pixels"))
def b23_scale_to_unit(spark, d):
    p = load(spark, d, "pixels")
    keys = ["tile", "band", "row", "col"]
    a = raster.scale_to_unit(p, "uint8", ["tile"]).select(*keys, F.round("value", 6).alias("u8"))
    b = raster.scale_to_unit(p.withColumn("value", F.col("value") * 300.0), "float32", ["tile"]).select(*keys, F.round("value", 6).alias("f"))
    return a.join(b, keys)


@query(duck("SELECT tile, CAST(CASE band WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS band, row, col, value FROM pixels WHERE band IN (4, 1, 2)", "pixels"))
def b24_band_selection(spark, d):
    return raster.select_bands(load(spark, d, "pixels"), [4, 1, 2]).select("tile", "band", "row", "col", "value")


@query(duck("""SELECT tile, band, row, col, round((value / 255.0e0 - CASE band WHEN 1 THEN 0.3603e0 WHEN 2 THEN 0.3813e0 WHEN 3 THEN 0.3470e0 ELSE 0.6094e0 END)
 / CASE band WHEN 1 THEN 0.1393e0 WHEN 2 THEN 0.1402e0 WHEN 3 THEN 0.1255e0 ELSE 0.1900e0 END, 6) AS value FROM pixels WHERE band <= 4""", "pixels"))
def b25_standardize(spark, d):
    p = load(spark, d, "pixels").withColumn("value", F.col("value") / 255.0)
    return raster.standardize(p, 4).select("tile", "band", "row", "col", F.round("value", 6).alias("value"))


@query(duck("""SELECT tile, band, row, col, round(CASE WHEN b > a THEN least(greatest((value - a) / (b - a), 0), 1) ELSE 0 END, 10) AS value FROM pixels JOIN
 (SELECT tile, band, quantile_cont(CAST(value AS DOUBLE), 0.02) AS a, quantile_cont(CAST(value AS DOUBLE), 0.98) AS b FROM pixels GROUP BY tile, band) USING (tile, band)""", "pixels"))
def b26_percentile_stretch(spark, d):
    return raster.percentile_stretch(load(spark, d, "pixels"), ["tile", "band"]).select("tile", "band", "row", "col", F.round("value", 10).alias("value"))


@query(duck("SELECT gt_id, 640 - x2 AS x1, 640 - x1 AS x2, true AS flipped FROM gt_boxes", "gt_boxes"))
def b27_flip_boxes(spark, d):
    return raster.flip_boxes(load(spark, d, "gt_boxes"), 640.0, ["image_id"], p=1.0).select("gt_id", "x1", "x2", "flipped")


def _u(keys: str, seed: int, salt: str) -> str:
    """DuckDB's form of ``raster.draw``."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {keys}, {seed}, '{salt}')), 1, 8) AS BIGINT) / 4294967296.0e0)"


_HALF = _u("image_id", 3, "") + " < 0.5e0"


@query(duck(f"SELECT gt_id, CASE WHEN {_HALF} THEN 640e0 - x2 ELSE x1 END AS x1, CASE WHEN {_HALF} THEN 640e0 - x1 ELSE x2 END AS x2, {_HALF} AS flipped FROM gt_boxes", "gt_boxes"))
def b27_flip_boxes_half(spark, d):
    return raster.flip_boxes(load(spark, d, "gt_boxes"), 640.0, ["image_id"], seed=3).select("gt_id", "x1", "x2", "flipped")


_TURNED = f"""
g AS (SELECT tile, r, c, {_u("tile", 1, "crop")} < 0.5e0 AS cropped, floor({_u("tile", 1, "top")} * 3) AS t, floor({_u("tile", 1, "left")} * 3) AS l,
      CASE WHEN {_u("tile", 1, "turn")} < 0.5e0 THEN floor({_u("tile", 1, "angle")} * 4) ELSE 0 END AS turn, {_u("tile", 1, "v")} < 0.5e0 AS v, {_u("tile", 1, "h")} < 0.5e0 AS h
      FROM (SELECT DISTINCT tile FROM pixels), range(8) AS a(r), range(8) AS b(c)),
q AS (SELECT *, CASE turn WHEN 1 THEN c WHEN 2 THEN 7 - r WHEN 3 THEN 7 - c ELSE r END AS r1, CASE turn WHEN 1 THEN 7 - r WHEN 2 THEN 7 - c WHEN 3 THEN r ELSE c END AS c1 FROM g),
f AS (SELECT *, CASE WHEN v THEN 7 - r1 ELSE r1 END AS r2, CASE WHEN h THEN 7 - c1 ELSE c1 END AS c2 FROM q),
s AS (SELECT *, CASE WHEN cropped THEN least(greatest((r2 + 0.5e0) * 6 / 8 - 0.5e0, 0), 5) ELSE r2 END AS y, CASE WHEN cropped THEN least(greatest((c2 + 0.5e0) * 6 / 8 - 0.5e0, 0), 5) ELSE c2 END AS x FROM f),
w AS (SELECT s.tile, r, c, (CASE WHEN cropped THEN t ELSE 0 END) + least(floor(y) + dy, CASE WHEN cropped THEN 5 ELSE 7 END) AS pr, (CASE WHEN cropped THEN l ELSE 0 END) + least(floor(x) + dx, CASE WHEN cropped THEN 5 ELSE 7 END) AS pc,
      abs(1 - dy - (y - floor(y))) * abs(1 - dx - (x - floor(x))) AS w FROM s, range(2) AS a(dy), range(2) AS b(dx))
SELECT w.tile, band, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(sum(value * w), 6) AS value FROM w JOIN pixels AS p ON p.tile = w.tile AND p.row = pr AND p.col = pc GROUP BY ALL"""


@query(duck("WITH " + _TURNED.strip(), "pixels"))
def b28_augment_geometry(spark, d):
    return raster.augment_geometry(load(spark, d, "pixels"), 8, "tile", seed=1).withColumn("value", F.round("value", 6))


_PLACE = "tile, band, row, col"
_NOISE = f"sqrt(-2 * ln(1 - {_u(_PLACE, 1, 'a')})) * cos(2 * 3.141592653589793e0 * {_u(_PLACE, 1, 'b')}) AS z"
_UNIT = f"u AS (SELECT tile, band, row, col, value / 255e0 AS v, {_NOISE} FROM pixels)"
_IN = lambda e: f"least(greatest({e}, 0e0), 1e0)"
_ON = lambda salt, p: f"{_u('tile', 1, salt)} < {p}e0"


@query(duck(f"""WITH {_UNIT}, l AS (SELECT *, CASE WHEN {_ON("light", 0.5)} THEN {_IN("v * (1 - 0.2e0 + 0.4e0 * " + _u("tile", 1, "gain") + ")")} ELSE v END AS x FROM u)
SELECT tile, band, row, col, round(CASE WHEN band <= 4 THEN CASE WHEN {_ON("noise", 0.5)} THEN {_IN("x + 0.05e0 * z")} ELSE x END WHEN {_ON("height", 0.3)} THEN {_IN("v + 0.02e0 * z")} ELSE v END, 6) AS value FROM l""", "pixels"))
def b29_augment_light(spark, d):
    unit = raster.scale_to_unit(load(spark, d, "pixels"), "uint8", ["tile"])
    return raster.augment_light(unit, "tile", seed=1).select("tile", "band", "row", "col", F.round("value", 6).alias("value"))


@query(duck(f"""WITH {_UNIT}, a AS (SELECT *, CASE WHEN band = 4 AND {_ON("nir", 0.6)} THEN {_IN("v * (0.85e0 + 0.3e0 * " + _u("tile", 1, "nir_gain") + ")")}
 WHEN band = 5 AND {_ON("h", 0.6)} THEN {_IN("v * (0.95e0 + 0.1e0 * " + _u("tile", 1, "h_scale") + ") + 0.1e0 * (" + _u("tile", 1, "h_shift") + " - 0.5e0)")} ELSE v END AS x FROM u),
b AS (SELECT *, CASE WHEN band = 4 AND {_ON("nir_noise", 0.3)} THEN {_IN("x + (0.01e0 + 0.02e0 * " + _u("tile", 1, "nir_std") + ") * z")} WHEN band = 5 AND {_ON("h_noise", 0.25)} THEN {_IN("x + 0.01e0 * z")} ELSE x END AS y FROM a)
SELECT tile, band, row, col, round(CASE WHEN band = 4 AND {_ON("nir_drop", 0.03)} OR band = 5 AND {_ON("h_drop", 0.03)} THEN 0 ELSE y END, 6) AS value FROM b""", "pixels"))
def b29_augment_detector(spark, d):
    unit = raster.scale_to_unit(load(spark, d, "pixels"), "uint8", ["tile"])
    return raster.augment_detector(unit, "tile", seed=1).select("tile", "band", "row", "col", F.round("value", 6).alias("value"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE replace(trim(c_mktsegment || ' tree '), ' ', '_') END AS folder FROM customer")
def b30_class_folder(spark, d):
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat("c_mktsegment", F.lit(" tree ")))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), ids.class_folder(name).alias("folder"))


_LOGP = "SELECT sample_id, y, logits, [v - m - ln(list_sum([exp(u - m) FOR u IN logits])) FOR v IN logits] AS lp FROM (SELECT *, list_max(logits) AS m FROM logits)"


@query(duck(f"SELECT sample_id, round((-0.95e0 * (y + 1) * lp[y + 1] - 0.05e0 * list_sum([lp[i] * i FOR i IN range(1, 11)]) / 10), 6) AS loss, CAST(y + 1 AS DOUBLE) AS weight FROM ({_LOGP})", "logits"))
def b31_cross_entropy(spark, d):
    e = losses.cross_entropy(F.col("logits"), F.col("y"), 0.05, [float(k) for k in range(1, 11)])
    return load(spark, d, "logits").select("sample_id", F.round(e["loss"], 6).alias("loss"), e["weight"].alias("weight"))


@query(duck(f"SELECT round(avg(-0.25e0 * (1 - exp(lp[y + 1])) ** 2 * lp[y + 1]), 6) AS loss FROM ({_LOGP})", "logits"))
def b32_focal_loss(spark, d):
    rows = load(spark, d, "logits").select(losses.focal_loss(F.col("logits"), F.col("y"), 2.0, 0.25).alias("loss"))
    return losses.reduce_loss(rows, "loss").select(F.round("loss", 6).alias("loss"))


_ALPHA = [round(0.15 + 0.1 * k, 2) for k in range(10)]
_FOCAL = f"-CAST({_ALPHA} AS DOUBLE[])[y + 1] * (1 - exp(lp[y + 1])) ** 1.5e0 * lp[y + 1]"


def _focal_rows(spark, d):
    return load(spark, d, "logits").select("sample_id", losses.focal_loss(F.col("logits"), F.col("y"), 1.5, _ALPHA).alias("loss"))


@query(duck(f"SELECT sample_id, round({_FOCAL}, 6) AS loss FROM ({_LOGP})", "logits"))
def b32_focal_by_class(spark, d):
    """A weight for each class, and no reduction."""
    return losses.reduce_loss(_focal_rows(spark, d), "loss", "none").select("sample_id", F.round("loss", 6).alias("loss"))


@query(duck(f"SELECT round(sum({_FOCAL}), 4) AS loss FROM ({_LOGP})", "logits"))
def b32_focal_sum(spark, d):
    return losses.reduce_loss(_focal_rows(spark, d), "loss", "sum").select(F.round("loss", 4).alias("loss"))


@query(duck("SELECT avg(CAST(r <= 1 AS INT)) * 100 AS top1, avg(CAST(r <= 5 AS INT)) * 100 AS top5 FROM (SELECT 1 + len(list_filter(logits, lambda v: v > logits[y + 1])) AS r FROM logits)", "logits"))
def b33_top_k(spark, d):
    return losses.top_k_percent(load(spark, d, "logits"))


def _terms(coefficients: tuple[float, ...], form: str) -> str:
    return " + ".join(form.format(c=f"CAST({c!r} AS DOUBLE)", k=2 * k) for k, c in enumerate(coefficients, 1))


_UTM = f"CAST({geo._K0 * geo._RADIUS!r} AS DOUBLE)"  #: metres of a radian along the middle meridian
_LATLON = f"""SELECT *, 9 + degrees(atan2(sinh(eta), cos(xi))) AS lon, degrees(chi + {_terms(geo._DELTA, "{c} * sin({k} * chi)")}) AS lat FROM (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM (
 SELECT *, p - ({_terms(geo._BETA, "{c} * sin({k} * p) * cosh({k} * q)")}) AS xi, q - ({_terms(geo._BETA, "{c} * cos({k} * p) * sinh({k} * q)")}) AS eta FROM (SELECT *, y / {_UTM} AS p, (x - 500000) / {_UTM} AS q FROM trees)))"""


@query(duck(f"SELECT tree_id, x, y, round(x, 3) AS back_x, round(y, 3) AS back_y, lon BETWEEN 6 AND 8 AND lat BETWEEN 54 AND 55 AS plausible FROM ({_LATLON})", "trees"))
def b34_crs_round_trip(spark, d):
    trees = load(spark, d, "trees").select("tree_id", "x", "y")
    there = geo.align_crs(trees.withColumns({"lon": F.col("x"), "lat": F.col("y")}), 25832, 4326, ("lon", "lat"))
    back = geo.align_crs(there.withColumns({"back_x": F.col("lon"), "back_y": F.col("lat")}), 4326, 25832, ("back_x", "back_y"))
    ok = F.col("lon").between(6.0, 8.0) & F.col("lat").between(54.0, 55.0)
    return back.select("tree_id", "x", "y", F.round("back_x", 3).alias("back_x"), F.round("back_y", 3).alias("back_y"), ok.alias("plausible"))




# Another form of the projection than the library's: arc of the meridian by powers of the squared eccentricity, and a series in the distance from it.
_E = "0.006694380022903416e0"  #: squared eccentricity of GRS80
_ARC = f"""6378137e0 * ((1 - {_E} / 4 - 3 * {_E} ** 2 / 64 - 5 * {_E} ** 3 / 256 - 175 * {_E} ** 4 / 16384) * p - (3 * {_E} / 8 + 3 * {_E} ** 2 / 32 + 45 * {_E} ** 3 / 1024 + 105 * {_E} ** 4 / 4096) * sin(2 * p)
 + (15 * {_E} ** 2 / 256 + 45 * {_E} ** 3 / 1024 + 525 * {_E} ** 4 / 16384) * sin(4 * p) - (35 * {_E} ** 3 / 3072 + 175 * {_E} ** 4 / 12288) * sin(6 * p) + 315 * {_E} ** 4 / 131072 * sin(8 * p))"""
_SERIES = f"""SELECT tree_id, lon, lat, 500000 + 0.9996e0 * n * (w + (1 - t + c) * w ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * q) * w ** 5 / 120) AS x,
 0.9996e0 * (m + n * tan(p) * (w ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * w ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * q) * w ** 6 / 720)) AS y FROM (SELECT *, {_ARC} AS m, 6378137e0 / sqrt(1 - {_E} * sin(p) ** 2) AS n,
 tan(p) ** 2 AS t, q * cos(p) ** 2 AS c, radians(lon - 9) * cos(p) AS w FROM (SELECT *, radians(lat) AS p, {_E} / (1 - {_E}) AS q FROM points))"""
_LONLAT = "SELECT tree_id, 8.6e0 + (tree_id * 7919) % 800 / 1000e0 AS lon, 47.5e0 + (tree_id * 104729) % 7000 / 1000e0 AS lat FROM trees"


@query(duck(f"WITH points AS ({_LONLAT}) SELECT tree_id, lon, lat, round(x, 1) AS x, round(y, 1) AS y FROM ({_SERIES})", "trees"))
def b34_to_metres(spark, d):
    trees = load(spark, d, "trees").select("tree_id", (8.6 + (F.col("tree_id") * 7919) % 800 / 1000.0).alias("lon"), (47.5 + (F.col("tree_id") * 104729) % 7000 / 1000.0).alias("lat"))
    found = geo.align_crs(trees.withColumns({"x": F.col("lon"), "y": F.col("lat")}), 4326, 25832)
    return found.select("tree_id", "lon", "lat", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))

"""Sorts, samples and splits; streaming; scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arbora.functions import labels, raster
from arbora.functions.ids import image_index
from arbora.operators import chips, evaluate, rasters, scoring, spatial, splits
from arbora.plans.queries import query
from arbora.plans.queries_a import _TABULAR
from arbora.plans.standins import duck, load, over
from arbora.plans.workspace import shared_path, stored
from arbora.streaming.intake import intake


@query(duck("SELECT pred_id, conf, CAST(row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_id) AS INTEGER) AS place FROM pred_boxes", "pred_boxes"))
def f01_confidence_order(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "pred_id"))
    return load(spark, d, "pred_boxes").select("pred_id", "conf", place.alias("place"))


@query(duck("SELECT pred_id, conf FROM pred_boxes ORDER BY conf DESC, pred_id LIMIT 10", "pred_boxes"))
def f02_first_ten(spark, d):
    return load(spark, d, "pred_boxes").orderBy(F.desc("conf"), "pred_id").limit(10).select("pred_id", "conf")


@query(duck("SELECT * FROM image_paths ORDER BY md5(concat_ws('|', image_path, 7)), image_path LIMIT 12", "image_paths"))
def f03_preview(spark, d):
    return splits.preview(load(spark, d, "image_paths"), "image_path", 12, seed=7)


@query(duck("SELECT tile_id, CASE WHEN CAST(right(tile_id, 2) AS INT) % 7 = 1 THEN 'val' ELSE 'train' END AS split FROM tiles", "tiles"))
def f04_split_by_lists(spark, d):
    tiles = load(spark, d, "tiles").select("tile_id")
    k = F.right("tile_id", F.lit(2)).cast("int") % 7
    return splits.split_by_lists(tiles, tiles.where(k == 2), tiles.where(k == 1))


@query(duck("""WITH i AS (SELECT tile_id, row_number() OVER (ORDER BY md5(concat_ws('|', tile_id, 42)), tile_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT tile_id FROM tiles))
SELECT tile_id, CASE WHEN r <= round_even(n * 0.2e0, 0) THEN 'val' ELSE 'train' END AS split FROM i""", "tiles"))
def f05_split_random(spark, d):
    return splits.split_random(load(spark, d, "tiles"), 0.2, seed=42)


@query(duck("""WITH i AS (SELECT image_path, split_part(image_path, '/', 4) AS class_name FROM image_paths),
r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5(concat_ws('|', image_path, 42)), image_path) AS r, count(*) OVER (PARTITION BY class_name) AS n FROM i)
SELECT image_path, class_name, CASE WHEN r <= round_even(n * (1 - 0.2e0), 0) THEN 'train' ELSE 'val' END AS split FROM r""", "image_paths"))
def f06_split_stratified(spark, d):
    index = image_index(load(spark, d, "image_paths")).select("image_path", "class_name")
    return splits.split_stratified(index, "image_path", "class_name", 0.2, seed=42)


@query(duck("""WITH i AS (SELECT image_path, split_part(image_path, '/', 4) AS class_name FROM image_paths),
r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5(concat_ws('|', image_path, 1)), image_path) AS r FROM i),
k AS (SELECT class_name, count(*) AS n, row_number() OVER (ORDER BY class_name) - 1 AS c, count(*) OVER () AS m FROM i GROUP BY class_name),
h AS (SELECT id AS draw, CAST('0x' || substr(md5(concat_ws('|', id, 1, 'class')), 1, 15) AS BIGINT) AS x, CAST('0x' || substr(md5(concat_ws('|', id, 1, 'row')), 1, 15) AS BIGINT) AS y FROM range((SELECT count(*) FROM i)) AS t(id))
SELECT class_name, draw, image_path FROM h JOIN k ON c = x % m JOIN r USING (class_name) WHERE r = y % n + 1""", "image_paths"))
def f07_balanced_sample(spark, d):
    index = image_index(load(spark, d, "image_paths")).select("image_path", "class_name")
    return splits.balanced_sample(index, "class_name", index.count(), seed=1, key="image_path")


@query(duck("SELECT image_path, CASE split_part(image_path, '/', 3) WHEN 'train' THEN 'train' ELSE 'val' END AS split FROM image_paths", "image_paths"))
def f08_split_by_folder(spark, d):
    return splits.by_folder(image_index(load(spark, d, "image_paths"))).select("image_path", "split")


@query("SELECT CAST(e AS VARCHAR) AS tile_id FROM (SELECT DISTINCT concat('32_', 100 + event_id % 900, '_', 1000 + CAST(floor(event_id / 1800.0e0) AS BIGINT)) AS e FROM events WHERE event_id % 11 > 0)")
def h01_tile_intake(spark, d):
    """Two arrivals of tiles, with repeats and bad ids, taken in by two runs of the same stream."""
    source, out, rejects, memory = (shared_path(spark, n) for n in ("arrivals", "tiles", "rejects", "stream"))
    name = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.format_string("%d-%d", 100 + F.col("event_id") % 900, 1000 + F.floor(F.col("event_id") / 1800.0)))
    rows = load(spark, d, "events").select(name.alias("tile_id"), "event_id", "value")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        intake(spark, source, "tile_id string, event_id bigint, value double", out, rejects, memory)
    return spark.read.schema("tile_id string").option("recursiveFileLookup", True).parquet(out)


def _chips(spark, d):
    p = load(spark, d, "pixels").select("tile", "band", F.col("row").alias("r"), F.col("col").alias("c"), "value")
    return scoring.chips_of(p, ["tile"], 8)


_BOXES = "SELECT tile, min(col) AS x1, min(row) AS y1, max(col) + 1 AS x2, max(row) + 1 AS y2, avg(value / 255.0e0) AS conf FROM pixels WHERE band = 1 AND value / 255.0e0 >= 0.6e0 GROUP BY tile"


@query(duck(f"SELECT tile, CAST(0 AS INTEGER) AS det_no, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, round(conf, 6) AS conf, CAST(0 AS INTEGER) AS cls FROM ({_BOXES})", "pixels"))
def i01_chip_scoring(spark, d):
    found = scoring.detect(_chips(spark, d), scoring.threshold_scorer(0.6), ["tile"], 8)
    return found.withColumn("conf", F.round("conf", 6))


def band_means(x: np.ndarray) -> np.ndarray:
    """A stand-in for a classifier: the mean of each band is the logit of a class."""
    return np.round(x.mean(axis=2 if x.ndim == 3 else (2, 3)), 9)


@query(duck("SELECT tile, CAST(min_by(band, (-m, band)) - 1 AS INTEGER) AS p FROM (SELECT tile, band, round(avg(value / 255.0e0), 9) AS m FROM pixels GROUP BY tile, band) GROUP BY tile", "pixels"))
def i02_class_scoring(spark, d):
    return scoring.classify_chips(_chips(spark, d), band_means, ["tile"], 8).select("tile", "p")


@query(duck("SELECT gt_id, 640 - x2 AS x1, 640 - x1 AS x2 FROM gt_boxes WHERE gt_cls < 5", "gt_boxes"))
def i03_transform_hook(spark, d):
    hooks = [lambda df: df.where("gt_cls < 5"), lambda df: raster.flip_boxes(df, 640.0, ["image_id"], p=1.0)]
    boxes = load(spark, d, "gt_boxes")
    for hook in hooks:
        boxes = boxes.transform(hook)
    return boxes.select("gt_id", "x1", "x2")


@query()
def i04_two_stage(spark, d):
    """Detect, suppress duplicates, cut patches, classify them, and attach the class to the detection."""
    from arbora.operators.matching import suppress

    pixels = load(spark, d, "pixels")
    found = stored(scoring.detect(_chips(spark, d), scoring.threshold_scorer(0.6), ["tile"], 8).withColumn("det_id", F.col("tile") * 10 + F.col("det_no")))
    boxes = found.select("det_id", "conf", F.col("tile") * 6 + F.col("x1"), "y1", F.col("tile") * 6 + F.col("x2"), "y2").toDF("det_id", "conf", *spatial.BOX)
    kept = suppress(boxes, spatial.overlap_pairs(boxes, "det_id", 8.0, 0.3, extra=("conf",)), "det_id", checkpoint=stored)
    sizes = pixels.select("tile").distinct().withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    points = found.join(kept.select("det_id"), "det_id").select(F.col("det_id").alias("point_id"), "tile", F.lit("all").alias("split"), F.lit("tree").alias("class_name"), middle("x1", "x2").alias("col"), middle("y1", "y2").alias("row"))
    cut = chips.patch_chips(chips.patches(points, sizes, 4), pixels, 4)
    patch = cut.groupBy("point_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "chip"))), lambda x: F.transform(x["chip"], lambda v: v / 255.0)).alias("bands"))
    classes = scoring.classify_chips(patch.withColumnRenamed("point_id", "det_id"), band_means, ["det_id"], 4)
    return scoring.two_stage(kept.join(found.select("det_id", "tile"), "det_id"), classes).select("det_id", "tile", "conf", "class_id")


@query()
def i05_tabular_classifier(spark, d):
    rows = evaluate.impute_median(over(spark, d, _TABULAR), ["canopyWidt", "m02"], split="split", fit_on="train")
    model = scoring.fit_tabular(rows.where("split = 'train'"), ["canopyWidt", "M01", "m02"], n_classes=3, max_iter=20)
    return scoring.predict_tabular(model, rows).select("tree_id", "split", "y", "p")


@query(duck("""SELECT det_id, CAST(least(8, x2) - greatest(0, x1) AS DOUBLE) AS w, round(vmax / 255.0e0 * 30, 6) AS height FROM (SELECT tile * 10 AS det_id, b.*, (SELECT max(value) FROM pixels AS p WHERE p.tile = b.tile AND band = 5 AND col >= x1 AND col < x2 AND row >= y1 AND row < y2) AS vmax
 FROM (SELECT tile, min(col) AS x1, min(row) AS y1, max(col) + 1 AS x2, max(row) + 1 AS y2 FROM pixels WHERE band = 1 AND value / 255.0e0 >= 0.6e0 GROUP BY tile) AS b)""", "pixels"))
def i06_detections_to_features(spark, d):
    """Chip boxes to tile pixels, map size and zonal height: the inference plan from end to end."""
    from arbora.functions.geo import clip_box

    found = stored(scoring.detect(_chips(spark, d), scoring.threshold_scorer(0.6), ["tile"], 8).withColumn("det_id", F.col("tile") * 10 + F.col("det_no")))
    box = clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0), F.lit(0), 8, 8)
    placed = found.select("det_id", "tile", *[c.alias(n) for n, c in box.items()])
    zones = spatial.pixels_in_boxes(placed, load(spark, d, "pixels").where("band = 5"), 4)
    heights = rasters.zonal_range(zones, placed)
    metres = raster.u8_to_height(F.col("value_max"), F.lit(0.0), F.lit(30.0))
    return placed.join(heights, "det_id").select("det_id", (F.col("px2") - F.col("px1")).cast("double").alias("w"), F.round(metres, 6).alias("height"))


@query(duck("""SELECT tree_id, training_class, tile_id, round(xmax - xmin, 6) AS width FROM (SELECT tree_id, CAST(CASE WHEN g IN ('Pinus', 'Picea') THEN 3 ELSE coalesce(class_id, 5) END AS INTEGER) AS training_class, tile_id, x - w / 2 AS xmin, x + w / 2 AS xmax
 FROM (SELECT tree_id, trim(genus) AS g, TRY_CAST(canopyWidt AS DOUBLE) AS w, t.x, t.y, tile_id FROM trees AS t LEFT JOIN tiles AS b ON t.x > b.xmin AND t.x < b.xmax AND t.y > b.ymin AND t.y < b.ymax WHERE trim(coalesce(genus, '')) <> '') LEFT JOIN classes ON g = class_name WHERE w > 0)""", "trees", "tiles", "classes"))
def l02_training_labels(spark, d):
    """Inventory to labelled boxes with their tile: the labelling plan from end to end."""
    trees = labels.assign_classes(load(spark, d, "trees"), load(spark, d, "classes"))
    boxes = labels.canopy_boxes(trees)
    return spatial.points_in_tiles(boxes.select("tree_id", "training_class", "x", "y", (F.col("xmax") - F.col("xmin")).alias("width")), load(spark, d, "tiles")).select("tree_id", "training_class", "tile_id", F.round("width", 6).alias("width"))

"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import labels, losses
from arbora.operators import evaluate, matching, rasters, segment
from arbora.plans.queries import query
from arbora.plans.queries_a import _TABULAR
from arbora.plans.queries_c import _IOU
from arbora.plans.standins import duck, load, over

#: The matching as two ranks, confidence and IoU of at least 0.25.
_MATCH = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY conf DESC, pred_id) AS q FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) AS r
 FROM ({_IOU}) AS x WHERE conf >= 0.25e0) WHERE r = 1 AND iou >= 0.25e0) WHERE q = 1"""
_BOTH = ("pred_boxes", "gt_boxes")


def _sides(spark, d):
    p, g = load(spark, d, "pred_boxes"), load(spark, d, "gt_boxes")
    return p, g, matching.greedy_match(p, g, 0.25, 0.25)


@query(duck("""SELECT row, col, min(z) AS z FROM (SELECT CAST(floor((6041000 - y) / 2) AS INTEGER) AS row, CAST(floor((x - 355000) / 2) AS INTEGER) AS col, z FROM xyz) WHERE row >= 0 AND row < 500 AND col >= 0 AND col < 500 GROUP BY row, col""", "xyz"))
def d01_grid_min_z(spark, d):
    return rasters.grid_min_z(load(spark, d, "xyz"), (2.0, 0.0, 355000.0, 0.0, -2.0, 6041000.0), 500, 500)


@query(duck("SELECT tile, CASE WHEN max(height) <= min(height) THEN 0 ELSE min(height) END AS vmin, CASE WHEN max(height) <= min(height) THEN 0 ELSE max(height) END AS vmax FROM heights GROUP BY tile", "heights"))
def d02_height_range(spark, d):
    return rasters.height_range(load(spark, d, "heights"))


_COUNTS = f"SELECT tp, p - tp AS fp, g - tp AS fn FROM (SELECT (SELECT count(*) FROM ({_MATCH})) AS tp, (SELECT count(*) FROM pred_boxes WHERE conf >= 0.25e0) AS p, (SELECT count(*) FROM gt_boxes) AS g)"


@query(duck(_COUNTS, *_BOTH))
def d04_match_counts(spark, d):
    p, g, m = _sides(spark, d)
    return matching.match_counts(p, g, m, 0.25)


@query(duck(f"SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-9), 6) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM ({_COUNTS}))", *_BOTH))
def d05_precision_recall_f1(spark, d):
    p, g, m = _sides(spark, d)
    scores = matching.precision_recall(matching.match_counts(p, g, m, 0.25))
    return scores.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(duck(f"SELECT round(coalesce(avg(iou), 0), 6) AS mean_iou, count(*) AS n FROM ({_MATCH})", *_BOTH))
def d05_mean_match_iou(spark, d):
    return matching.mean_match_iou(_sides(spark, d)[2]).select(F.round("mean_iou", 6).alias("mean_iou"), "n")


@query(duck(f"""WITH m AS ({_MATCH}), c AS (SELECT pred_cls AS p, gt_cls AS g FROM m UNION ALL SELECT pred_cls, 10 FROM pred_boxes WHERE conf >= 0.25e0 AND pred_id NOT IN (SELECT pred_id FROM m)
 UNION ALL SELECT 10, gt_cls FROM gt_boxes WHERE gt_id NOT IN (SELECT gt_id FROM m)) SELECT CAST(a AS INTEGER) AS pred_cls, CAST(b AS INTEGER) AS gt_cls, count(p) AS n
 FROM (SELECT unnest(range(11)) AS a) JOIN (SELECT unnest(range(11)) AS b) ON true LEFT JOIN c ON p = a AND g = b GROUP BY a, b""", *_BOTH))
def d06_detection_confusion(spark, d):
    p, g, m = _sides(spark, d)
    return matching.detection_confusion(p, g, m, 10, 0.25)


_PRED = "SELECT sample_id, y, list_position(logits, list_max(logits)) - 1 AS p FROM logits"
_CELLS = f"SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS p, count(sample_id) AS n FROM (SELECT unnest(range(10)) AS a) JOIN (SELECT unnest(range(10)) AS b) ON true LEFT JOIN ({_PRED}) AS s ON s.y = a AND s.p = b GROUP BY a, b"


def _predicted(spark, d):
    return load(spark, d, "logits").select("sample_id", "y", losses.argmax(F.col("logits")).alias("p"))


@query(duck(_CELLS, "logits"))
def d07_class_confusion(spark, d):
    return evaluate.class_confusion(_predicted(spark, d), 10)


@query(duck(f"SELECT y, p, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y), 0), 0), 6) AS share FROM ({_CELLS})", "logits"))
def d08_row_normalized(spark, d):
    return evaluate.row_normalized(evaluate.class_confusion(_predicted(spark, d), 10)).select("y", "p", "n", F.round("share", 6).alias("share"))


_EACH = f"""SELECT y AS c, tp, support, CAST(coalesce(tp / nullif(predicted, 0), 0) AS DOUBLE) AS pr, CAST(coalesce(tp / nullif(support, 0), 0) AS DOUBLE) AS re FROM (SELECT y, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM cells GROUP BY y)
 JOIN (SELECT p, sum(n) AS predicted FROM cells GROUP BY p) ON p = y"""


@query(duck(f"""WITH cells AS ({_CELLS}), e AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM ({_EACH}))
 SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT CAST(c AS VARCHAR) AS label, pr AS precision, re AS recall, f AS f1, support FROM e
 UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support) FROM e UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM e
 UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM e)""", "logits"))
def d09_classification_report(spark, d):
    report = evaluate.classification_report(evaluate.class_confusion(_predicted(spark, d), 10))
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


@query(duck(f"SELECT avg(CAST(y = p AS INT)) AS accuracy FROM ({_PRED})", "logits"))
def d10_accuracy(spark, d):
    return evaluate.accuracy(_predicted(spark, d))


@query(duck("SELECT CAST(a AS INTEGER) AS y, round(r / avg(r) OVER (), 6) AS weight FROM (SELECT a, 1.0e0 / greatest(count(y), 1) AS r FROM (SELECT unnest(range(12)) AS a) LEFT JOIN logits ON y = a GROUP BY a)", "logits"))
def d11_class_weights(spark, d):
    return evaluate.class_weights(load(spark, d, "logits"), 12).select("y", F.round("weight", 6).alias("weight"))


@query(duck("SELECT epoch, split, round(sum(value * (1 + event_id % 8)) / sum(1 + event_id % 8), 6) AS mean_value, CAST(sum(1 + event_id % 8) AS BIGINT) AS n FROM history GROUP BY epoch, split", "history"))
def d13_epoch_rollup(spark, d):
    h = load(spark, d, "history").withColumn("n", 1 + F.col("event_id") % 8)
    return evaluate.epoch_rollup(h).select("epoch", "split", F.round("mean_value", 6).alias("mean_value"), "n")


@query(f"SELECT tree_id, round(coalesce(canopyWidt, median(canopyWidt) OVER (PARTITION BY split)), 6) AS canopyWidt, round(coalesce(m02, median(m02) OVER (PARTITION BY split)), 6) AS m02 FROM ({_TABULAR})")
def d14_median_imputation(spark, d):
    filled = evaluate.impute_median(over(spark, d, _TABULAR), ["canopyWidt", "m02"], split="split")
    return filled.select("tree_id", F.round("canopyWidt", 6).alias("canopyWidt"), F.round("m02", 6).alias("m02"))


@query()
def d15_average_precision(spark, d):
    dets = load(spark, d, "pred_boxes").select("image_id", F.col("pred_cls").alias("cls"), F.col("pred_id").alias("det_id"), F.col("conf").alias("score"), "x1", "y1", "x2", "y2")
    truths = load(spark, d, "gt_boxes").select("image_id", F.col("gt_cls").alias("cls"), "gt_id", "x1", "y1", "x2", "y2")
    return evaluate.average_precision(dets, truths).select("metric", F.round("value", 6).alias("value"))


@query(duck("SELECT band, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM pixels GROUP BY band", "pixels"))
def d16_channel_stats(spark, d):
    return evaluate.channel_stats(load(spark, d, "pixels")).select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(duck("SELECT tile, label, count(*) AS n_pixels, count(*) * 0.25e0 AS area, min(col) AS px1, min(row) AS py1, CAST(max(col) + 1 AS INTEGER) AS px2, CAST(max(row) + 1 AS INTEGER) AS py2 FROM (SELECT tile, row, col, value // 64 AS label FROM pixels WHERE band = 5) GROUP BY tile, label", "pixels"))
def d17_crown_table(spark, d):
    rows = load(spark, d, "pixels").where("band = 5").withColumn("label", F.floor(F.col("value") / 64).cast("int"))
    return segment.crown_table(rows, 0.25)


@query(duck("SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(genus, '')) = '') AS n_no_genus, count(*) FILTER (NOT coalesce(TRY_CAST(canopyWidt AS DOUBLE) >= 2, false)) AS n_bad_width FROM trees", "trees"))
def d18_drop_report(spark, d):
    return labels.drop_report(load(spark, d, "trees"), min_width=2.0)

"""Matching of detections to truth, and suppression of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.geo import iou
from arbora.plans.workspace import forget


def iou_pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Overlapping prediction and truth pairs of an image with their IoU."""
    p = pred.select("image_id", "pred_id", "pred_cls", "conf", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    g = truth.select("image_id", "gt_id", "gt_cls", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    meet = F.expr("p_x1 < g_x2 and g_x1 < p_x2 and p_y1 < g_y2 and g_y1 < p_y2")
    return p.join(g, "image_id").where(meet).withColumn("iou", iou("p_", "g_")).select("image_id", "pred_id", "pred_cls", "conf", "gt_id", "gt_cls", "iou")


def greedy_match(pred: DataFrame, truth: DataFrame, min_iou: float = 0.25, min_conf: float = 0.0) -> DataFrame:
    """``image_id, pred_id, pred_cls, gt_id, gt_cls, conf, iou`` of the matched pairs.

    By falling confidence each prediction looks only at its own best truth and takes it if it is free and the IoU
    suffices. As it never takes a second choice, the loop equals two ranks: the best truth of each prediction, then
    the most confident prediction of each truth. Ties go to the smaller id.
    """
    best = Window.partitionBy("image_id", "pred_id").orderBy(F.desc("iou"), "gt_id")
    taken = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("conf"), "pred_id")
    pairs = iou_pairs(pred.where(F.col("conf") >= min_conf), truth)
    own = pairs.withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("iou") >= min_iou))
    return own.withColumn("_r", F.row_number().over(taken)).where("_r = 1").select("image_id", "pred_id", "pred_cls", "gt_id", "gt_cls", "conf", "iou")


def match_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """One row: tp, fp, fn over all images."""
    part = lambda df, tp, p, g: df.select(F.lit(tp).alias("tp"), F.lit(p).alias("p"), F.lit(g).alias("g"))
    rows = part(matches, 1, 0, 0).unionByName(part(pred.where(F.col("conf") >= min_conf), 0, 1, 0)).unionByName(part(truth, 0, 0, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(total("tp").alias("tp"), (total("p") - total("tp")).alias("fp"), (total("g") - total("tp")).alias("fn"))


def mean_match_iou(matches: DataFrame) -> DataFrame:
    """One row: ``mean_iou`` of the matched pairs (0 without any) and their number ``n``."""
    return matches.agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.count("*").alias("n"))


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    both = counts.withColumn("precision", tp / (tp + fp + 1e-9)).withColumn("recall", tp / (tp + fn + 1e-9))
    return both.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9))


def detection_confusion(pred: DataFrame, truth: DataFrame, matches: DataFrame, n_classes: int, min_conf: float = 0.0) -> DataFrame:
    """``pred_cls, gt_cls, n`` for all (C + 1)^2 cells; class C is background."""
    used = pred.where(F.col("conf") >= min_conf)
    lone = used.join(matches.select("pred_id"), "pred_id", "left_anti").select("pred_cls", F.lit(n_classes).alias("gt_cls"))
    missed = truth.join(matches.select("gt_id"), "gt_id", "left_anti").select(F.lit(n_classes).alias("pred_cls"), "gt_cls")
    cells = matches.select("pred_cls", "gt_cls").unionByName(lone).unionByName(missed).groupBy("pred_cls", "gt_cls").agg(F.count("*").alias("n"))
    return dense(cells, "pred_cls", "gt_cls", n_classes + 1)


def dense(cells: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """All cells of a square matrix, absent ones with n = 0."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = cells.sparkSession.range(1).select(axis.alias(a)).withColumn(b, axis)
    return grid.join(cells, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def suppress(boxes: DataFrame, edges: DataFrame, id_col: str = "box_id", conf: str = "conf", checkpoint=None) -> DataFrame:
    """The boxes that remain when, by falling confidence, a box goes if one that stays overlaps it.

    ``edges``: a, b of overlapping boxes; if they bring ``a_conf`` and ``b_conf`` (of the column ``conf``), each once, nothing is joined to them. In each round every undecided box without a stronger undecided neighbour stays
    and its neighbours go, which decides the same as the loop. Ties in confidence go to the smaller id.
    ``checkpoint`` (a function of a DataFrame) cuts the lineage of each round.
    """
    cut = checkpoint or (lambda df: df.checkpoint())
    key = lambda c, i: F.struct((-F.col(c)).alias("c"), F.col(i).alias("i"))
    known = {f"a_{conf}", f"b_{conf}"} <= set(edges.columns)
    if known:
        ranked = edges.select("a", "b", key(f"a_{conf}", "a").alias("ka"), key(f"b_{conf}", "b").alias("kb"))
    else:
        rank = cut(boxes.select(F.col(id_col).alias("id"), key(conf, id_col).alias("key")))
        ranked = edges.select("a", "b").join(rank.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(rank.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
    # (weak, strong) pairs, one an edge: only a stronger neighbour can take a box away.
    a_first = F.col("ka") < F.col("kb")
    pairs = ranked.where("ka <> kb").select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("weak"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("strong"))
    pairs = cut(pairs if known else pairs.distinct())
    gone = []
    while True:
        # Who has no stronger neighbour left stays, and its neighbours go.
        dominated = pairs.select(F.col("weak").alias("strong")).distinct()
        lost = cut(pairs.join(dominated, "strong", "left_anti").select(F.col("weak").alias("id")).distinct())
        gone.append(lost)
        # Pairs of boxes that are gone decide nothing any more.
        left = pairs.join(lost.select(F.col("id").alias("weak")), "weak", "left_anti").join(lost.select(F.col("id").alias("strong")), "strong", "left_anti")
        left = cut(left)
        forget(pairs)
        pairs = left
        if left.isEmpty():
            break
    every = gone[0]
    for lost in gone[1:]:
        every = every.unionByName(lost)
    kept = cut(boxes.join(every.select(F.col("id").alias(id_col)), id_col, "left_anti"))
    forget(*([] if known else [rank]), pairs, *gone)
    return kept

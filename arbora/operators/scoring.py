"""Scoring of chips by a model that the user supplies, and a tabular classifier."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from arbora.plans.workspace import ranked

Scorer = Callable[[np.ndarray], list[tuple[float, float, float, float, float, int]]]


def threshold_scorer(least: float = 0.6, cls: int = 0) -> Scorer:
    """A deterministic stand-in for a detector: the box around all pixels of the first band above ``least``, by their mean."""

    def score(chip: np.ndarray):
        on = chip[0] >= least
        if not on.any():
            return []
        r, c = np.nonzero(on)
        return [(float(c.min()), float(r.min()), float(c.max() + 1), float(r.max() + 1), float(chip[0][on].mean()), cls)]

    return score


def chips_of(pixels: DataFrame, keys: list[str], size: int, scale: float = 255.0) -> DataFrame:
    """One row for each chip: ``bands`` as arrays of size x size values divided by ``scale``, in order of the bands.

    ``pixels``: the keys, band, r, c, value.
    """
    ordered = F.sort_array(F.collect_list(F.struct("r", "c", F.col("value").cast("double").alias("v"))))
    band = pixels.groupBy(*keys, "band").agg(F.transform(ordered, lambda x: x["v"] / scale).alias("values"))
    return band.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "values"))), lambda x: x["values"]).alias("bands"))


Boxes = list[list[tuple[float, float, float, float, float, int]]]


def _tensors(chips: DataFrame, size: int) -> tuple[list[Column], list[list[int] | None]]:
    """The chips' values as one array a row, as long as that of the chip of most bands, with the number of the chip's own bands; and their shapes.

    The functions that take them are called nondeterministic, lest a filter on what a model found runs the model again.
    """
    most = chips.agg(F.max(F.size("bands"))).first()[0] or 1
    n = F.size("bands")
    blank = F.array_repeat(F.lit(0.0), (most - n) * size * size)
    return [F.concat(F.flatten("bands"), blank), n], [[most, size, size], None]


def _by_bands(x: np.ndarray, n: np.ndarray, score: Callable) -> list:
    """What ``score`` gives for each chip; a call takes chips of as many bands, their own ones only."""
    out = [None] * len(x)
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        for i, found in zip(at.tolist(), score(x[at, : int(k)])):
            out[i] = found
    return out


def detect_batches(chips: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], Boxes]], keys: list[str], size: int, min_conf: float = 0.25, batch_size: int = 64) -> DataFrame:
    """``x1, y1, x2, y2, conf, cls`` in chip pixels, with the chip's keys and ``det_no``.

    ``make_scorer`` is called once a worker and returns what scores (chips, bands, size, size) arrays, so that a model is loaded once
    and sees batches; chips of fewer bands make batches of their own.
    """

    def make():
        score = make_scorer()

        def predict(x: np.ndarray, n: np.ndarray) -> np.ndarray:
            found = [[d for d in boxes if d[4] >= min_conf] for boxes in _by_bands(x, n, score)]
            out = np.full((len(x), 6 * max(1, max(map(len, found)))), np.nan)  # as wide as the most boxes of a chip
            for row, boxes in zip(out, found):
                row[: 6 * len(boxes)] = np.ravel(boxes)
            return out

        return predict

    values, shapes = _tensors(chips, size)
    numbers = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes).asNondeterministic()(*values)
    rows = chips.select(*keys, F.filter(numbers, lambda v: v.isNotNull() & ~F.isnan(v)).alias("_v")).where(F.size("_v") > 0)
    each = rows.select(*keys, "_v", F.explode(F.expr("sequence(0, cast(size(_v) / 6 as int) - 1)")).alias("det_no"))
    place = lambda k: F.get("_v", F.col("det_no") * 6 + k)
    return each.select(*keys, "det_no", *[place(k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2", "conf"))], place(5).cast("int").alias("cls"))


def detect(chips: DataFrame, scorer: Scorer, keys: list[str], size: int, min_conf: float = 0.25) -> DataFrame:
    """``detect_batches`` with a scorer of single chips."""
    return detect_batches(chips, lambda: lambda x: [scorer(chip) for chip in x], keys, size, min_conf)


def classify_chips(chips: DataFrame, model: Callable[[np.ndarray], np.ndarray], keys: list[str], size: int, batch_size: int = 64) -> DataFrame:
    """Apply a model (chips, bands, size, size) -> (chips, classes): ``logits`` and ``p``, the first largest class; chips of fewer bands make batches of their own."""
    from arbora.functions.losses import argmax

    def predict(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        found = [np.asarray(v, float) for v in _by_bands(x, n, model)]
        out = np.zeros((len(x), 1 + max(map(len, found))))  # the number of logits, then these
        for row, v in zip(out, found):
            row[0], row[1 : 1 + len(v)] = len(v), v
        return out

    values, shapes = _tensors(chips, size)
    numbers = predict_batch_udf(lambda: predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes).asNondeterministic()(*values)
    logits = F.slice("_v", F.lit(2), F.col("_v")[0].cast("int"))
    return chips.select(*keys, numbers.alias("_v")).select(*keys, logits.alias("logits")).withColumn("p", argmax(F.col("logits")))


def two_stage(detections: DataFrame, classes: DataFrame, id_col: str = "det_id") -> DataFrame:
    """Detections with the class that the second stage gave their patch; none is kept as unknown (-1)."""
    return detections.join(classes.select(id_col, F.col("p").alias("class_id")), id_col, "left").withColumn("class_id", F.coalesce("class_id", F.lit(-1)))


def fit_tabular(train: DataFrame, features: list[str], label: str = "y", layers: tuple[int, ...] = (16,), n_classes: int | None = None, weight: str | None = None, seed: int = 0, max_iter: int = 50):
    """A multilayer perceptron on standardised features, or a weighted logistic regression if ``weight`` names a column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = n_classes or int(train.agg(F.max(label)).first()[0]) + 1
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    if weight:
        stages.append(LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, maxIter=max_iter))
    else:
        stages.append(MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(features), *layers, n], seed=seed, maxIter=max_iter))
    return Pipeline(stages=stages).fit(train)


def predict_tabular(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", F.col("prediction").cast("int")).drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, partition: str | None = None) -> DataFrame:
    """Sequential numbers in ``order``, within each ``partition`` or over all rows.

    Over all rows, ranges count on their own and are shifted by the sizes of those before them.
    """
    if partition:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1 + start).cast("bigint"))
    return ranked(df, order, "_place").withColumn(name, F.col("_place") - 1 + start).drop("_place")


def coco_tables(truth: DataFrame, dets: DataFrame, min_score: float = 0.05) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``detections`` of an export: image ids from 0, annotation ids and categories from 1."""
    images = numbered(truth.select("image_id").unionByName(dets.select("image_id")).distinct(), ["image_id"], "id")
    xywh = lambda: F.array("x1", "y1", F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0)))
    of = images.select("image_id", F.col("id").alias("image"))
    ann = numbered(truth.join(of, "image_id"), ["image", "gt_id"], "id", start=1)
    ann = ann.withColumn("bbox", xywh()).select("id", F.col("image").alias("image_id"), (F.col("gt_cls") + 1).alias("category_id"), "bbox", (F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), F.lit(0).alias("iscrowd"))
    found = dets.where(F.col("conf") >= min_score).join(of, "image_id").select("pred_id", F.col("image").alias("image_id"), (F.col("pred_cls") + 1).alias("category_id"), xywh().alias("bbox"), F.col("conf").alias("score"))
    return {"images": images.select("id", F.concat(F.col("id").cast("string"), F.lit(".tif")).alias("file_name")), "annotations": ann, "detections": found}

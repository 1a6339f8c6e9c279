"""Values at ranks, percentiles, and splits by them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import raster
from arbora.operators import ranks, splits


def groups(rng):
    return {1: [rng.gauss(0, 1) for _ in range(700)], 2: [float(rng.randrange(5)) for _ in range(600)], 3: [7.0] * 300, 4: [2.5], 5: [1e-300 * k for k in range(200)] + [1e300] * 3, 6: [-1.0, float(2**60)] + [0.1] * 250}


@pytest.mark.parametrize("most, bins", [(10, 8), (1, 3), (10_000, 4096)])
def test_values_at_all_ranks(spark, monkeypatch, most, bins):
    monkeypatch.setattr(ranks, "MOST", most)
    monkeypatch.setattr(ranks, "BINS", bins)
    rng = random.Random(3)
    data = groups(rng)
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [(1, None), (1, float("nan"))], "k int, value double").repartition(3)
    wanted = [(k, t, r) for k, vs in data.items() for t, r in enumerate(sorted({0, len(vs) // 3, len(vs) // 2, len(vs) - 1}))]
    found = ranks.values_at(rows, spark.createDataFrame([*wanted, (4, 9, 1), (9, 0, 0)], "k int, target int, rank int"), ["k"])
    assert sorted((r["k"], r["target"], r["found"]) for r in found.collect()) == sorted((k, t, sorted(data[k])[r]) for k, t, r in wanted)


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MOST", 20)
    data = groups(random.Random(4))
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k int, value double")
    for r in ranks.percentiles(rows, ["k"], [0.02, 0.5, 0.98]).collect():
        wanted = np.percentile(data[r["k"]], [2, 50, 98])
        assert np.allclose([r["p0"], r["p1"], r["p2"]], wanted, rtol=1e-12, atol=0) and (r["low"], r["high"]) == (min(data[r["k"]]), max(data[r["k"]]))


def test_stretch_of_a_flat_image_and_of_unknown_pixels(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, None), (3, 0.0), (3, None), (3, 10.0)], "tile int, value double")
    found = sorted((r["tile"], -1.0 if r["value"] is None else r["value"]) for r in raster.percentile_stretch(rows, ["tile"], 0.0, 1.0).collect())
    assert found[:2] == [(1, 0.0), (1, 0.0)] and (3, 0.0) in found and (3, 1.0) in found and len(found) == 6


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_random_split_is_the_order_of_hashes(spark, share):
    ids = spark.range(501).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tile_id"))
    found = splits.split_random(ids, share, seed=4)
    val = {r["tile_id"] for r in found.where("split = 'val'").collect()}
    order = [r["tile_id"] for r in ids.orderBy(F.expr("md5(concat_ws('|', tile_id, 4))")).collect()]
    assert val == set(order[: round(501 * share)]) and found.count() == 501
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Broadcast" not in plan and "TakeOrdered" not in plan

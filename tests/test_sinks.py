"""Files of tiles: their number, what a read skips, and tiles that are written again."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from arbora.sources import sinks


def raster(spark, tiles, value, side=20):
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    return spark.range(tiles).select(F.col("id").alias("tile")).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("row", axis()).withColumn("col", axis()).withColumn("value", F.lit(value))


def test_files_follow_rows_not_tiles(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "few")
    sinks.write_raster(raster(spark, 60, 7), path)
    assert len(glob.glob(f"{path}/rows/**/*.parquet", recursive=True)) <= 4
    monkeypatch.setattr(sinks, "FILE_ROWS", 5_000)
    more = str(tmp_path / "more")
    sinks.write_raster(raster(spark, 60, 7), more)
    assert 10 <= len(glob.glob(f"{more}/rows/**/*.parquet", recursive=True)) <= 14
    # A tile lies in one file or two, so its read can skip the others.
    files = sinks.read_tiled(spark, more, "tile").where("tile = 31").select(F.input_file_name()).distinct().count()
    assert files <= 2 and sinks.read_tiled(spark, more, "tile").where("tile = 31").count() == 800
    plan = sinks.read_tiled(spark, more, "tile").where("tile = 31")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tile,31)" in plan


def test_tiles_written_again_replace_themselves_only(spark, tmp_path):
    path = str(tmp_path / "raster")
    sinks.write_raster(raster(spark, 6, 1), path)
    sinks.write_raster(raster(spark, 3, 2, side=5), path)
    found = {r["tile"]: (r["n"], r["v"]) for r in sinks.read_tiled(spark, path, "tile").groupBy("tile").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert found == {t: (50, 2) if t < 3 else (800, 1) for t in range(6)}
    # A write that did not end has no list of tiles and is not read; the next one takes its place.
    raster(spark, 6, 9).write.parquet(f"{path}/rows/gen=2")
    assert sinks.read_tiled(spark, path, "tile").agg(F.max("value")).first()[0] == 2
    sinks.write_raster(raster(spark, 1, 3, side=4), path)
    assert sinks.read_tiled(spark, path, "tile").where("value = 3").count() == 32
    with pytest.raises(ValueError):
        sinks.read_tiled(spark, str(tmp_path / "none"), "tile")


def test_interleaved(spark):
    rows = spark.range(16).select(F.floor(F.col("id") / 4).alias("y"), (F.col("id") % 4).alias("x"))
    got = {(r["y"], r["x"]): r["k"] for r in rows.withColumn("k", sinks.interleaved(F.col("y"), F.col("x"))).collect()}
    assert got[0, 0] == 0 and got[0, 1] == 1 and got[1, 0] == 2 and got[3, 3] == 15 and sorted(got.values()) == list(range(16))

"""Results that the findings of round 4 asked for."""

from __future__ import annotations

import glob
import os

from arbora.operators import chips
from arbora.plans.queries import QUERIES, SQL
from tests.compare import connect, rows_of_spark, rows_of_sql


def folder_of(spark, tmp_path, name: str, df) -> str:
    """A folder with one table of one file."""
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (file,) = glob.glob(str(tmp_path / "in" / "*.parquet"))
    os.link(file, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_chips_have_all_bands(spark, tmp_path):
    """A band without pixels is 0 in the chips of its tile: here the vector is null (tile 0, band 2) or absent (all bands of tile 1 but the third)."""
    vectors = [(k, None if k == 1 else [k / 10 + p / 1000 for p in range(64)]) for k in (0, 1, 2, 3, 4, 7)]
    folder = folder_of(spark, tmp_path, "embeddings", spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"))
    want = {}
    for tile in (0, 1):
        for window, (row0, col0) in enumerate([(0, 0), (0, 3), (3, 0), (3, 3)]):
            for band in range(1, 6):
                v = dict(vectors).get(5 * tile + band - 1)
                want |= {(tile, window, band, r, c): v and (v[(row0 + r) * 8 + col0 + c] + 1) * 127.5 for r in range(5) for c in range(5)}
    found = QUERIES["e04_chip_pixels"](spark, folder)
    made = {(r["tile"], r["window_id"], r["band"], r["r"], r["c"]): r["value"] for r in found.collect()}
    assert len(want) == 1000 and made.keys() == want.keys()
    assert all(abs(made[k] - v) <= 0.51 if v is not None else made[k] == 0 for k, v in want.items())
    assert rows_of_spark(found) == rows_of_sql(connect(folder), SQL["e04_chip_pixels"])


def test_chips_of_named_bands(spark):
    pixels = spark.createDataFrame([(1, 1, 0, 0, 7), (1, 2, 0, 0, 8), (2, 2, 0, 0, 9)], "tile int, band int, row int, col int, value int")
    windows = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0)], "tile int, window_id int, row0 int, col0 int")
    rows = lambda df: sorted((r["tile"], r["band"], r["value"]) for r in df.collect())
    assert rows(chips.chip_pixels(windows, pixels, 1, bands=[1, 2])) == [(1, 1, 7), (1, 2, 8), (2, 1, 0), (2, 2, 9)]
    assert rows(chips.chip_pixels(windows, pixels, 1)) == [(1, 1, 7), (1, 2, 8), (2, 2, 9)]

"""Raster headers and warping against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arbora.functions import geo
from arbora.operators import grids, rasters

HEADER = "tile bigint, a double, b double, c double, d double, e double, f double, n_rows int, n_cols int, srid int"


def headers(spark, rows):
    return grids.headers(spark.createDataFrame(rows, HEADER))


def pixels_of(spark, arrays):
    rows = [(t, r, c, float(v)) for t, a in arrays.items() for (r, c), v in np.ndenumerate(a) if not np.isnan(v)]
    return spark.createDataFrame(rows, "tile bigint, row int, col int, value double")


def warp_by_hand(arrays, sources, target):
    """Value of each pixel of ``target`` (a header row) from sources in order, pixel by pixel."""
    t, (n_rows, n_cols, t_srid) = target[1:7], target[7:]

    def moved(s, col, row):
        x, y = geo.pixel_to_map(t, col, row)
        x, y = geo.converted(t_srid, s[9], np.float64(x), np.float64(y), np)
        return geo.map_to_pixel(s[1:7], x, y)

    out = {}
    for row in range(n_rows):
        for col in range(n_cols):
            out[row, col] = None
            for s in sources:
                x, y = moved(s, col + 0.5, row + 0.5)
                if not (0 <= x <= s[8] and 0 <= y <= s[7]):
                    continue
                (x0, y0), (x1, y1), (x2, y2) = (moved(s, n_cols / 2 + i, n_rows / 2 + j) for i, j in ((0, 0), (1, 0), (0, 1)))
                rx, ry = max(1, math.hypot(x1 - x0, x2 - x0)), max(1, math.hypot(y1 - y0, y2 - y0))
                near = [((1 - abs(x - 0.5 - c) / rx) * (1 - abs(y - 0.5 - r) / ry), v) for (r, c), v in np.ndenumerate(arrays[s[0]]) if abs(x - 0.5 - c) < rx and abs(y - 0.5 - r) < ry and not np.isnan(v)]
                total = sum(w for w, _ in near)
                if total > 1e-12:
                    out[row, col] = sum(w * v for w, v in near) / total
                    break
    return out


@pytest.fixture(scope="module")
def world():
    """Sources of several sizes, resolutions and origins, one of them turned, with holes."""
    rng = np.random.default_rng(4)
    rows = [(1, 1.0, 0.0, 500.0, 0.0, -1.0, 900.0, 40, 37, 25832), (2, 1.0, 0.0, 537.0, 0.0, -1.0, 900.0, 40, 20, 25832), (3, 0.8, 0.3, 505.0, 0.3, -0.8, 880.0, 25, 31, 25832), (4, 1.0, 0.0, 9000.0, 0.0, -1.0, 900.0, 5, 5, 25832)]
    arrays = {r[0]: rng.normal(size=r[7:9]) for r in rows}
    for a in arrays.values():
        a[rng.random(a.shape) < 0.1] = np.nan
    arrays[1][:20, :16] = np.nan  # a block without any known pixel
    return rows, arrays


@pytest.mark.parametrize("target", [(9, 0.45, 0.0, 497.3, 0.0, -0.45, 902.1, 70, 150, 25832), (9, 3.1, 0.0, 495.0, 0.0, -2.3, 905.0, 21, 24, 25832), (9, 0.7, -0.4, 520.0, -0.4, -0.7, 890.0, 33, 40, 25832), (9, 30.0, 0.0, 480.0, 0.0, -30.0, 930.0, 4, 5, 25832)])
def test_warp_equals_the_plain_sums(spark, monkeypatch, world, target):
    """Several blocks on both sides, several sources that overlap: the first that knows a pixel gives it."""
    monkeypatch.setattr(grids, "BLOCK", 16)
    monkeypatch.setattr(grids, "WINDOW", 24)
    rows, arrays = world
    sources, targets = headers(spark, rows), headers(spark, [target])
    pairs = grids.overlapping(targets, sources, cell=20.0)
    assert sorted(tuple(r) for r in pairs.collect()) == [(9, 1), (9, 2), (9, 3)]
    found = {(r["row"], r["col"]): r["value"] for r in grids.warp(pixels_of(spark, arrays), sources, targets, pairs).collect()}
    wanted = warp_by_hand(arrays, [r for r in rows if r[0] < 4], target)
    assert found.keys() == wanted.keys()
    assert all((found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9) for k, v in wanted.items())
    assert any(v is None for v in wanted.values()) and any(v is not None for v in wanted.values())


def test_warp_between_coordinate_systems(spark, monkeypatch):
    monkeypatch.setattr(grids, "BLOCK", 16)
    rng = np.random.default_rng(5)
    source = (1, 10.0, 0.0, 500000.0, 0.0, -10.0, 5500400.0, 40, 40, 25832)
    lon, lat = geo.utm32_to_lonlat(np.float64(499950.0), np.float64(5500450.0), np)
    target = (1, 1e-4, 0.0, float(lon), 0.0, -1e-4, float(lat), 45, 66, 4326)
    arrays = {1: rng.normal(size=(40, 40))}
    found = {(r["row"], r["col"]): r["value"] for r in grids.warp(pixels_of(spark, arrays), headers(spark, [source]), headers(spark, [target])).collect()}
    wanted = warp_by_hand(arrays, [source], target)
    assert found.keys() == wanted.keys() and sum(v is not None for v in wanted.values()) > 1000
    assert all((found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-6) for k, v in wanted.items())


def test_warp_without_any_source_pixel(spark, world):
    rows, arrays = world
    found = grids.warp(pixels_of(spark, arrays), headers(spark, rows), headers(spark, [(7, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 2, 3, 25832), (4, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1, 2, 25832)]))
    assert sorted((r["tile"], r["row"], r["col"], r["value"]) for r in found.collect()) == [(4, 0, 0, None), (4, 0, 1, None), *[(7, r, c, None) for r in range(2) for c in range(3)]]


@pytest.mark.parametrize("wrong", [(1, 1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 5, 5, None), (1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0, 5, None), (1, 1.0, 0.0, None, 0.0, -1.0, 0.0, 5, 5, None)])
def test_unusable_headers(spark, wrong):
    with pytest.raises(PySparkException):
        headers(spark, [wrong]).collect()


def test_headers_without_coordinate_system(spark):
    bare = headers(spark, [(1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 5, 5, None)]).first()
    assert bare["srid"] == 25832 and bare["nodata"] is None


@pytest.mark.parametrize("make", [rasters.smooth_gaussian, rasters.smooth_median, rasters.sobel])
def test_filters_over_tiles_of_their_own_sizes(spark, monkeypatch, make):
    """The same as tile by tile, with blocks that cut the larger ones."""
    monkeypatch.setattr(rasters, "BLOCK", 16)
    rng = np.random.default_rng(6)
    arrays = {1: rng.normal(size=(40, 21)), 2: rng.normal(size=(9, 33)), 3: rng.normal(size=(1, 4))}
    arrays[1][3:6, 2:9] = np.nan
    sizes = spark.createDataFrame([(t, *a.shape) for t, a in arrays.items()], "tile bigint, n_rows int, n_cols int")
    rows = pixels_of(spark, arrays)
    value = lambda df: sorted((r["tile"], r["row"], r["col"], -1e9 if r["value"] is None else round(r["value"], 9)) for r in df.collect())
    each = [value(make(rows.where(F.col("tile") == t), *a.shape)) for t, a in arrays.items()]
    assert value(make(rows, sizes)) == [r for part in each for r in part]


def test_points_and_boxes_of_turned_rasters(spark):
    heads = headers(spark, [(1, 0.6, 0.8, 100.0, 0.8, -0.6, 50.0, 10, 12, 25832)])
    rows = [(1, 3.5, 4.25), (1, 11.99, 9.99), (1, -0.01, 5.0), (1, 3.5, 10.01), (2, 1.0, 1.0)]
    points = spark.createDataFrame([(t, *geo.pixel_to_map((0.6, 0.8, 100.0, 0.8, -0.6, 50.0), c, r)) for t, c, r in rows], "tile bigint, x double, y double")
    found = sorted((r["col"], r["row"], r["inside"]) for r in grids.points_to_pixels(points, heads).collect())
    assert found == [(-1, 5, False), (3, 4, True), (3, 10, False), (11, 9, True)]

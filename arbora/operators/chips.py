"""Windows over rasters, chips with labels, patches around points, mosaics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.geo import Affine, map_to_pixel
from arbora.operators.spatial import box_join

INT = "int"


def inference_starts(length: Column, patch: int, stride: int) -> Column:
    """0, stride, ... below length - patch, then length - patch; a raster smaller than the patch has one window at 0."""
    last = length - patch
    return F.when(last > 0, F.array_union(F.sequence(F.lit(0), last - 1, F.lit(stride)), F.array(last))).otherwise(F.array(F.lit(0)))


def chip_starts(length: Column, size: int, stride: int, full: bool) -> Column:
    """Starts of chips. ``full``: the last one ends at the raster's edge, and a small raster has one chip; else only chips that fit."""
    if not full:
        return F.when(length >= size, F.sequence(F.lit(0), length - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    last = length - size
    plain = F.sequence(F.lit(0), last - 1, F.lit(stride))
    more = F.when(F.array_max(plain) + size < length, F.array_append(plain, last)).otherwise(plain)
    return F.when(last > 0, more).otherwise(F.array(F.lit(0)))


def windows(rasters: DataFrame, size: int, stride: int | None = None, overlap: float = 0.0, kind: str = "chips", full: bool = True) -> DataFrame:
    """``tile, window_id, row0, col0`` of each raster (tile, width, height), numbered by rows from 0."""
    step = stride or max(1, int(size * (1 - overlap)))
    starts = (lambda n: inference_starts(n, size, step)) if kind == "inference" else (lambda n: chip_starts(n, size, step, full))
    grid = rasters.withColumn("row0", F.explode(starts(F.col("height").cast(INT)))).withColumn("col0", F.explode(starts(F.col("width").cast(INT))))
    place = F.row_number().over(Window.partitionBy("tile").orderBy("row0", "col0")) - 1
    return grid.select("tile", place.alias("window_id"), "row0", "col0")


def chip_pixels(chips: DataFrame, pixels: DataFrame, size: int, bands: Sequence[int] | None = None) -> DataFrame:
    """Every pixel of every chip and band, in chip places; 0 outside the raster.

    ``bands``: those of all rasters, 0 where one has no pixels; else a raster has the bands that its pixels show.
    """
    axis = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    if bands is None:
        each = chips.join(pixels.select("tile", "band").distinct(), "tile")
    else:  # spread before the pixels are listed, as the few bytes of the chips may lie in one task
        each = chips.withColumn("band", F.explode(F.array(*map(F.lit, bands)))).repartition("tile", "band")
    grid = each.withColumn("r", axis).withColumn("c", axis).withColumn("row", F.col("row0") + F.col("r")).withColumn("col", F.col("col0") + F.col("c"))
    return grid.join(pixels, ["tile", "band", "row", "col"], "left").select("tile", "window_id", "band", "r", "c", F.coalesce("value", F.lit(0)).alias("value"))


def chip_labels(chips: DataFrame, boxes: DataFrame, size: int, t: Affine, cell: float, label: str | None = None, grow: float = 0.01) -> DataFrame:
    """Normalised labels ``cls, xc, yc, w, h`` of the boxes that meet a chip (grown by ``grow`` metres) and have their centre on it.

    ``chips``: chip_id, row0, col0 and map box; ``t``: the raster's transform.
    """
    b = boxes.select(*[F.col(c).alias(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")], *(["box_id"] if "box_id" in boxes.columns else []), (F.coalesce(F.col(label).try_cast("int"), F.lit(0)) if label else F.lit(0)).alias("cls"))
    met = box_join(chips, b, cell, grow=grow)
    x0, y0 = map_to_pixel(t, F.col("r_xmin"), F.col("r_ymin"))
    x1, y1 = map_to_pixel(t, F.col("r_xmax"), F.col("r_ymax"))
    rel = lambda v, o: (v - F.col(o)) / size
    met = met.withColumns({"xc": (rel(x0, "col0") + rel(x1, "col0")) / 2, "yc": (rel(y0, "row0") + rel(y1, "row0")) / 2, "w": F.abs(x1 - x0) / size, "h": F.abs(y1 - y0) / size})
    return met.where("xc between 0 and 1 and yc between 0 and 1")


def six_places(c: Column) -> Column:
    """A number of [0, 8) with six places, rounded half to even on its exact binary value, as C prints it.

    Java's formatter rounds the shortest decimal form half up, which differs where that form ends in a 5.
    """
    # c * 10**6 as the sum of its nearest double and what that lacks, which Veltkamp's split of c makes exact.
    product = c * 1e6
    t = c * 134217729.0
    upper = t - (t - c)
    lacks = (upper * 1e6 - product) + (c - upper) * 1e6
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lacks > 0) | ((lacks == 0) & (whole % 2 == 1))))
    digits = (whole + up.cast("bigint") + 10_000_000).cast("string")
    return F.when((c >= 0) & (c < 8), F.concat(F.substring(digits, 2, 1), F.lit("."), F.substring(digits, 3, 6))).otherwise(F.format_string("%.6f", c))


def label_line() -> Column:
    return F.concat_ws(" ", F.col("cls").cast("string"), *[six_places(F.col(c)) for c in ("xc", "yc", "w", "h")])


def label_to_pixels(width: float, height: float, offset: int = 0) -> dict[str, Column]:
    """Normalised label to pixel corners."""
    xc, yc, w, h = (F.col(c) for c in ("xc", "yc", "w", "h"))
    return {"x1": (xc - w / 2) * width, "y1": (yc - h / 2) * height, "x2": (xc + w / 2) * width, "y2": (yc + h / 2) * height, "cls": F.col("cls") + offset}


def patches(points: DataFrame, rasters: DataFrame, size: int) -> DataFrame:
    """A window around each point of a tile (point_id, tile, split, class_name, col, row), if it lies within the raster.

    One patch for each (split, class, id), the one in the smallest tile.
    """
    half = size // 2
    p = points.join(rasters, "tile").withColumns({"row0": F.col("row") - half, "col0": F.col("col") - half})
    p = p.where((F.col("row0") >= 0) & (F.col("col0") >= 0) & (F.col("row0") + size <= F.col("height")) & (F.col("col0") + size <= F.col("width")))
    first = F.row_number().over(Window.partitionBy("split", "class_name", "point_id").orderBy("tile", "row0", "col0"))
    return p.withColumn("_n", first).where("_n = 1").drop("_n", "width", "height")


def patch_chips(patches_: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """The pixels of each patch as one array a band, row by row."""
    rng = F.sequence(F.lit(0), F.lit(size - 1))
    grid = patches_.select("point_id", "tile", "row0", "col0").withColumn("row", F.explode(F.transform(rng, lambda i: F.col("row0") + i)))
    joined = grid.join(pixels, ["tile", "row"]).where((F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col0") + size))
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    return joined.groupBy("point_id", "tile", "band").agg(F.transform(ordered, lambda x: x["value"]).alias("chip"))


def mosaic(pixels: DataFrame, order: str) -> DataFrame:
    """World pixels (band, wrow, wcol) of overlapping rasters; the source that comes first by ``order`` wins."""
    return pixels.groupBy("band", "wrow", "wcol").agg(F.min_by("value", order).alias("value"))


def cut(pixels: DataFrame, t: Affine, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The pixels of a map box, its corner offsets rounded half to even."""
    a, _, c, _, e, f = t
    cols, rows = sorted(((xmin - c) / a, (xmax - c) / a)), sorted(((ymin - f) / e, (ymax - f) / e))
    col0, row0, n_col, n_row = round(cols[0]), round(rows[0]), round(cols[1] - cols[0]), round(rows[1] - rows[0])
    inside = (F.col("wcol") >= col0) & (F.col("wcol") < col0 + n_col) & (F.col("wrow") >= row0) & (F.col("wrow") < row0 + n_row)
    return pixels.where(inside).withColumns({"wcol": F.col("wcol") - col0, "wrow": F.col("wrow") - row0})

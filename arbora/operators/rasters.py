"""Raster operators over long pixel tables: gridding, height models, stacks, zonal statistics, filters, resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.geo import Affine, map_to_pixel
from arbora.functions.raster import height_to_u8
from arbora.operators.batches import by_many, stacks


def grid_min_z(points: DataFrame, t: Affine, width: int, height: int) -> DataFrame:
    """``row, col, z``: the lowest point of each pixel; points outside the raster are dropped, never clipped."""
    col, row = map_to_pixel(t, F.col("x"), F.col("y"))
    placed = points.where("z is not null and not isnan(z)").select(F.floor(row).cast("int").alias("row"), F.floor(col).cast("int").alias("col"), "z")
    return placed.where(f"row >= 0 and row < {height} and col >= 0 and col < {width}").groupBy("row", "col").agg(F.min("z").alias("z"))


def height_model(dom: DataFrame, dgm: DataFrame, keys: list[str], dom_nodata: float | None = None, dgm_nodata: float | None = None) -> DataFrame:
    """Surface minus ground where both are valid, else null; not clamped at 0."""
    valid = lambda c, nodata: F.when(~F.isnan(c) & ((F.col(c) != nodata) if nodata is not None else F.lit(True)), F.col(c))
    top = dom.select(*keys, valid("value", dom_nodata).alias("_dom"))
    ground = dgm.select(*keys, valid("value", dgm_nodata).alias("_dgm"))
    return top.join(ground, keys, "left").select(*keys, (F.col("_dom") - F.col("_dgm")).alias("value"))


def choose_height(tiles: DataFrame, ndom: DataFrame, chm: DataFrame) -> DataFrame:
    """Pixels of each tile from its nDOM if that has any value, else from the height model; ``source`` says which (none: one row without pixel)."""
    usable = lambda df: df.where("value is not null").select("tile").distinct()
    by = tiles.select("tile").join(usable(ndom).withColumn("_n", F.lit(True)), "tile", "left").join(usable(chm).withColumn("_c", F.lit(True)), "tile", "left")
    source = by.select("tile", F.when(F.col("_n"), "ndom").when(F.col("_c"), "chm").otherwise("none").alias("source"))
    pixels = ndom.select("tile", "row", "col", "value", F.lit("ndom").alias("source")).unionByName(chm.select("tile", "row", "col", "value", F.lit("chm").alias("source")))
    return source.join(pixels, ["tile", "source"], "left")


def height_range(heights: DataFrame, key: str = "tile", value: str = "height") -> DataFrame:
    """``vmin, vmax`` of each tile over its known heights (null if there are none); a flat tile is (0, 0)."""
    v = F.when(~F.isnan(value), F.col(value))
    stats = heights.groupBy(key).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"))
    flat = F.col("vmax") <= F.col("vmin")
    return stats.select(key, F.when(flat, 0.0).otherwise(F.col("vmin")).alias("vmin"), F.when(flat, 0.0).otherwise(F.col("vmax")).alias("vmax"))


def stack(bands: DataFrame, heights: DataFrame, height_band: int = 5) -> DataFrame:
    """Bands with the scaled height as one more band; a tile without heights gives none. ``bands``: tile, band, row, col, value."""
    ranges = height_range(heights).where("vmin is not null")
    scaled = heights.join(ranges, "tile").select("tile", F.lit(height_band).alias("band"), "row", "col", height_to_u8(F.col("height"), F.col("vmin"), F.col("vmax")).alias("value"))
    kept = bands.where(F.col("band") < height_band).join(ranges.select("tile"), "tile", "left_semi")
    return kept.select("tile", "band", "row", "col", "value").unionByName(scaled)


#: Side of the blocks of pixels that one task filters at a time.
BLOCK = 512

_PIXELS = "row int, col int, value double"


#: Rows of all tiles, with ``n_cols``, or a table ``tile, n_rows, n_cols`` (headers) of each tile's own size.
Rows = int | DataFrame


def _filtered(pixels: DataFrame, n_rows: Rows, n_cols: int | None, radius: int, along) -> DataFrame:
    """``along`` applied to every block of a tile, which also gets the pixels up to ``radius`` around it, mirrored at the tile's edges.

    Tiles are of one size or, with a table of sizes, each of its own. ``along(values)`` takes stacked arrays with a margin of ``radius`` (nan: unknown or absent) and returns them without it.
    Only pixels that exist give a row. A block is at most ``BLOCK + 2 * radius`` pixels wide, whatever the tile's size.
    """
    if radius > BLOCK:
        raise ValueError(f"a filter may reach {BLOCK} pixels at most, not {radius}")
    last = lambda n: F.floor((F.col(n) - 1) / BLOCK)
    reach = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - radius) / BLOCK), F.lit(0)), F.least(F.floor((F.col(c) + radius) / BLOCK), last(n))))
    sizes = n_rows.select("tile", F.col("n_rows").alias("_nr"), F.col("n_cols").alias("_nc")) if isinstance(n_rows, DataFrame) else None
    sized = pixels.join(sizes, "tile") if sizes is not None else pixels.withColumns({"_nr": F.lit(n_rows), "_nc": F.lit(n_cols)})
    inside = sized.where("row between 0 and _nr - 1 and col between 0 and _nc - 1").select("tile", "row", "col", F.col("value").cast("double").alias("value"), "_nr", "_nc")
    dealt = inside.withColumn("_br", reach("row", "_nr")).withColumn("_bc", reach("col", "_nc"))

    def blocks(px: dict[str, np.ndarray], starts: np.ndarray):
        n_rows, n_cols, y0, x0 = (px[c][starts].astype(np.int64) for c in ("_nr", "_nc", "_br", "_bc"))
        y0, x0 = y0 * BLOCK, x0 * BLOCK
        sizes = [np.minimum(BLOCK, n_rows - y0) + 2 * radius, np.minimum(BLOCK, n_cols - x0) + 2 * radius]
        for (h, w, n_rows, n_cols, y0, x0), first, rows, slot in stacks(starts, len(px["row"]), np.stack([*sizes, n_rows, n_cols, y0, x0], axis=1)):
            r, c = px["row"][rows] - y0 + radius, px["col"][rows] - x0 + radius
            known, here = np.full((len(first), h, w), np.nan), np.zeros((len(first), h, w), bool)
            near = (r < h) & (c < w)
            at = slot[near], r[near], c[near]
            known[at], here[at] = px["value"][rows][near], True
            # Places of the margin beyond the tile take the pixel that mirrors them; it lies in the block or its margin.
            mirror = lambda o, size, n: np.where((k := (np.arange(size) - radius + o) % (2 * n)) >= n, 2 * n - 1 - k, k) - o + radius
            out = along(known[:, mirror(y0, h, n_rows)[:, None], mirror(x0, w, n_cols)])
            n, y, x = np.nonzero(here[:, radius : h - radius, radius : w - radius])
            yield first[n], {"row": (y + y0).astype(np.int32), "col": (x + x0).astype(np.int32), "value": out[n, y, x]}

    made = by_many(dealt, ["tile", "_br", "_bc"], blocks, _PIXELS)
    return made.select("tile", "row", "col", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _weighted(values: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sum of neighbours along the last axis or the one before (-2), unknown ones counting as 0; nan where none is known."""
    n = values.shape[axis] - len(weights) + 1
    part = lambda a, k: a[..., k : k + n, :] if axis == -2 else a[..., k : k + n]
    filled, known = np.nan_to_num(values, nan=0.0), ~np.isnan(values)
    total, any_ = sum(w * part(filled, k) for k, w in enumerate(weights)), np.logical_or.reduce([part(known, k) for k in range(len(weights))])
    return np.where(any_, total, np.nan)


def smooth_gaussian(pixels: DataFrame, n_rows: Rows, n_cols: int | None = None, sigma: float = 1.5, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian of ``tile, row, col, value``, edges mirrored; unknown pixels count as 0, and one without a known neighbour is null."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]
    return _filtered(pixels, n_rows, n_cols, radius, lambda v: _weighted(_weighted(v, weights, -2), weights, -1))


def smooth_median(pixels: DataFrame, n_rows: Rows, n_cols: int | None = None, size: int = 3) -> DataFrame:
    """Median of the known pixels of a square of odd ``size``, edges mirrored; null where none is known."""
    r = size // 2

    def along(values: np.ndarray) -> np.ndarray:
        h, w = values.shape[-2] - 2 * r, values.shape[-1] - 2 * r
        near = np.sort(np.stack([values[..., i : i + h, j : j + w] for i in range(2 * r + 1) for j in range(2 * r + 1)]), axis=0)  # nan last
        n = (~np.isnan(near)).sum(axis=0)
        at = lambda k: np.take_along_axis(near, np.clip(k, 0, len(near) - 1)[None], axis=0)[0]
        return (at((n - 1) // 2) + at(n // 2)) / 2

    return _filtered(pixels, n_rows, n_cols, r, along)


def smooth(pixels: DataFrame, n_rows: Rows, n_cols: int | None = None, method: str = "gaussian") -> DataFrame:
    if method == "none":
        return pixels
    if method not in ("gaussian", "median"):
        raise ValueError(f"unknown smoothing {method!r}")
    return (smooth_gaussian if method == "gaussian" else smooth_median)(pixels, n_rows, n_cols)


def sobel(pixels: DataFrame, n_rows: Rows, n_cols: int | None = None) -> DataFrame:
    """Gradient magnitude: root of the mean square of both directions, weights (1, 2, 1) / 4 and (1, 0, -1) / 2, edges mirrored."""
    smoother, slope = [0.25, 0.5, 0.25], [-0.5, 0.0, 0.5]

    def along(values: np.ndarray) -> np.ndarray:
        down, across = (_weighted(_weighted(values, first, -2), second, -1) for first, second in ((slope, smoother), (smoother, slope)))
        return np.sqrt((down * down + across * across) / 2)

    return _filtered(pixels, n_rows, n_cols, 1, along)


#: Columns whose nearest rows one task finds at a time.
STRIPE = 32


def _lowest(f: np.ndarray) -> np.ndarray:
    """For each column of ``f`` and each row r: the least of ``f[s] + (r - s) ** 2`` over the rows s.

    The least s that attains it never falls as r grows, so rows are settled from the middle of what is open, each searching only
    between the finds of the settled rows around it: n log n steps a column, all rows of a round and all columns at once.
    """
    n, m = f.shape
    arg = np.zeros((n + 2, m), np.int64)  # shifted by one: bounds above the first and below the last row
    arg[n + 1] = n - 1
    best = np.empty((n, m), f.dtype)
    step = 1 << max(n.bit_length(), 1)
    columns = np.arange(m)
    while step >= 1:
        rows = np.arange(step, n + 1, 2 * step)
        if len(rows):
            low, high = arg[rows - step], arg[np.minimum(rows + step, n + 1)]
            sizes = (high - low + 1).ravel()
            starts = np.cumsum(sizes) - sizes
            s = np.arange(sizes.sum()) - np.repeat(starts - low.ravel(), sizes)
            cost = f[s, np.repeat(np.tile(columns, len(rows)), sizes)] + (s - np.repeat(np.repeat(rows - 1, m), sizes)) ** 2
            least = np.minimum.reduceat(cost, starts)
            hit = np.flatnonzero(cost == np.repeat(least, sizes))
            first = hit[np.searchsorted(hit, starts)]
            arg[rows], best[rows - 1] = s[first].reshape(-1, m), least.reshape(-1, m)
        step //= 2
    return best


def distance_to_background(mask: DataFrame) -> DataFrame:
    """Euclidean distance from each pixel of ``tile, row, col, on`` to the nearest one that is off; null where a tile has none.

    First along the rows, by stripes of ``STRIPE`` rows, then along the columns, by stripes of as many columns.
    """
    far = np.int64(1) << 30  # a row that knows no background

    def grids(px: dict[str, np.ndarray], starts: np.ndarray, values: np.ndarray, fill):
        """Stacks of the groups' arrays, and where their rows lie in them."""
        low = {c: np.minimum.reduceat(px[c], starts) for c in ("row", "col")}
        kinds = np.stack([np.maximum.reduceat(px[c], starts) + 1 - low[c] for c in ("row", "col")], axis=1).astype(np.int64)
        sizes = np.diff(np.append(starts, len(values)))
        r, c = (px[k] - np.repeat(low[k], sizes) for k in ("row", "col"))
        for (h, w), first, rows, slot in stacks(starts, len(values), kinds):
            out, at = np.full((len(first), h, w), fill, np.int64), (slot, r[rows], c[rows])
            out[at] = values[rows]
            yield out, at, rows, {"row": px["row"][rows], "col": px["col"][rows], "on": px["on"][rows].astype(bool)}

    def along(px: dict[str, np.ndarray], starts: np.ndarray):
        for off, at, rows, same in grids(px, starts, ~px["on"].astype(bool), 0):
            col = np.arange(off.shape[-1])
            left = np.maximum.accumulate(np.where(off, col, -far), axis=-1)
            right = np.minimum.accumulate(np.where(off, col, 2 * far)[..., ::-1], axis=-1)[..., ::-1]
            yield rows, {**same, "d": np.minimum(np.minimum(col - left, right - col), far)[at]}

    def stripe(px: dict[str, np.ndarray], starts: np.ndarray):
        for f, at, rows, same in grids(px, starts, px["d"] ** 2, far**2):
            # Columns do not depend on each other, so those of a stack lie side by side.
            square = _lowest(f.transpose(1, 0, 2).reshape(f.shape[1], -1)).reshape(f.shape[1], f.shape[0], -1).transpose(1, 0, 2)[at]
            yield rows, {**same, "distance": np.where(square < far, np.sqrt(square), np.nan)}

    rows = mask.select("tile", F.floor(F.col("row") / STRIPE).alias("_stripe"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "on")
    rows = by_many(rows, ["tile", "_stripe"], along, "row int, col int, on boolean, d bigint")
    made = by_many(rows.withColumn("_stripe", F.floor(F.col("col") / STRIPE)), ["tile", "_stripe"], stripe, "row int, col int, on boolean, distance double")
    return made.select("tile", "row", "col", "on", F.when(~F.isnan("distance"), F.col("distance")).alias("distance"))


def resample_bilinear(pixels: DataFrame, n_rows: int, n_cols: int, scale: float) -> DataFrame:
    """Pixels of a grid ``scale`` times as fine (size rounded half to even), from the 4 nearest source pixels that are known.

    Each source pixel goes to the target pixels that draw on it, so there is no join, and sums begin where the source lies.
    """

    def drawing(c: str, n: int, size: int) -> Column:
        """The target places along an axis that draw on place ``c``, with its weight there; places beyond the first and last centre draw on those alone."""
        low = F.when(F.col(c) == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(c) - 0.5) * size / n - 0.5)))
        high = F.when(F.col(c) == n - 1, size - 1).otherwise(F.least(F.lit(size - 1), F.ceil((F.col(c) + 1.5) * size / n - 0.5)))
        at = lambda t: F.least(F.greatest((t + 0.5) * n / size - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        places = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda t: F.struct(t.alias("to"), (1 - F.abs(at(t) - F.col(c))).alias("w")))
        return F.explode(F.filter(places, lambda p: p["w"] > 0))

    v = F.col("value").cast("double")
    known = pixels.select("tile", "row", "col", v.alias("v")).where(f"v is not null and not isnan(v) and row between 0 and {n_rows - 1} and col between 0 and {n_cols - 1}")
    spread = known.withColumn("_r", drawing("row", n_rows, round(n_rows * scale))).withColumn("_c", drawing("col", n_cols, round(n_cols * scale)))
    weighted = spread.select("tile", F.col("_r.to").alias("row"), F.col("_c.to").alias("col"), "v", (F.col("_r.w") * F.col("_c.w")).alias("_w"))
    return weighted.groupBy("tile", "row", "col").agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("value"))


def resample_area(pixels: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """Means of blocks of ``factor`` x ``factor`` pixels."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy(*keys, block("row"), block("col")).agg(F.avg("value").alias("value"))


def zonal_range(pixels_in_boxes: DataFrame, boxes: DataFrame, key: str = "det_id") -> DataFrame:
    """``value_max, value_min`` of each box; null for a box without pixels."""
    stats = pixels_in_boxes.groupBy(key).agg(F.max("value").alias("value_max"), F.min("value").alias("value_min"))
    return boxes.select(key).join(stats, key, "left")

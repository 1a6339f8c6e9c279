"""Marker flooding of rasters of any size by blocks of pixels that only exchange their rims.

The flood takes, of all pixels it has reached, the one of lowest level next, where a pixel's level is never below that of the way to it; then the
smallest marker, then row and column; a pixel belongs to the marker whose flood reaches it first. That has a form without an order:

* ``reach`` of a pixel is the least, over all ways from a marker, of the highest level on the way, its own included.
* A pixel is first reached from those neighbours whose reach is least. In going from neighbour to neighbour like this, it can come
  to one or more markers, and of these the smallest has it: floods of one level go by marker, each over all that it can get.

Both are least fixed points. So blocks may be settled in any order, again whenever the rim of a neighbour has changed, until
none changes: first reach, then markers. A task holds one block and its neighbours' rims; a round only takes the blocks beside a change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute in tasks)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.plans.workspace import forget, settings

BLOCK = 256  #: side of a block
CELLS = 1 << 21  #: pixels settled side by side, about: many small blocks, or one large one
NONE = np.iinfo(np.int64).max

KEYS = ("tile", "br", "bc")
SIDES = ("up", "down", "left", "right")
_AT = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}  #: where the neighbour on that side lies
_BACK = {"up": "down", "down": "up", "left": "right", "right": "left"}


def _spread(values: np.ndarray, passes) -> None:
    """Sweeps over rows and columns, both ways, until nothing falls; ``passes(values, at, before)`` lowers line ``at`` from the line before it."""
    n_rows, n_cols = values.shape[1] - 2, values.shape[2] - 2
    while True:
        old = values.copy()
        for i in range(1, n_rows + 1):
            passes(values, np.s_[:, i], np.s_[:, i - 1], "up")
        for i in range(n_rows, 0, -1):
            passes(values, np.s_[:, i], np.s_[:, i + 1], "down")
        for j in range(1, n_cols + 1):
            passes(values, np.s_[:, :, j], np.s_[:, :, j - 1], "left")
        for j in range(n_cols, 0, -1):
            passes(values, np.s_[:, :, j], np.s_[:, :, j + 1], "right")
        if np.array_equal(old, values):
            return


def reached(level: np.ndarray, marker: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """Reach of stacked blocks with a margin: ``level`` is inf outside the mask, ``halo`` holds the neighbours' reach in the margin and inf inside."""
    reach = np.where(marker > 0, level, halo)

    def lower(values, at, before, _):
        np.minimum(values[at], np.maximum(values[before], level[at]), out=values[at])

    _spread(reach, lower)
    return reach


def owned(level: np.ndarray, marker: np.ndarray, reach: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """The marker that has each pixel (``NONE``: none), of stacked blocks with a margin; ``halo`` holds the neighbours' markers in the margin."""
    owner = np.where(marker > 0, marker, halo)
    inner = np.s_[:, 1:-1, 1:-1]
    beside = {"up": reach[:, :-2, 1:-1], "down": reach[:, 2:, 1:-1], "left": reach[:, 1:-1, :-2], "right": reach[:, 1:-1, 2:]}
    least = np.minimum.reduce(list(beside.values()))
    free = np.isfinite(level[inner]) & (marker[inner] == 0) & np.isfinite(least)
    way = {}
    for side, values in beside.items():
        way[side] = np.zeros(level.shape, bool)
        way[side][inner] = free & (values == least)

    def lower(values, at, before, side):
        np.minimum(values[at], np.where(way[side][at], values[before], NONE), out=values[at])

    _spread(owner, lower)
    return owner


def _stacks(batch: pa.RecordBatch, side: int):
    """(rows, level, marker) of a batch's blocks, stacked with a margin, so many as make ``CELLS`` pixels, like sizes together."""
    lists = batch.column("px")
    flat, sizes = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    pos, value, mark = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "level", "marker"))
    starts = np.cumsum(sizes) - sizes
    height = np.maximum.reduceat(pos // side, starts) + 1
    width = np.maximum.reduceat(pos % side, starts) + 1
    order = np.lexsort((width, height))
    at = 0
    while at < len(order):
        most, k = (0, 0), at
        while k < len(order):
            h, w = max(most[0], int(height[order[k]]) + 2), max(most[1], int(width[order[k]]) + 2)
            if k > at and (k + 1 - at) * h * w > CELLS:
                break
            most, k = (h, w), k + 1
        rows = order[at:k]
        level, marker = np.full((len(rows), *most), np.inf), np.zeros((len(rows), *most), np.int64)
        own = np.arange(sizes[rows].sum()) + np.repeat(starts[rows] - (np.cumsum(sizes[rows]) - sizes[rows]), sizes[rows])
        place = np.repeat(np.arange(len(rows)), sizes[rows]), pos[own] // side + 1, pos[own] % side + 1
        # The mask is where the level is finite, so one that is not, or unknown, is the highest there is.
        level[place] = np.nan_to_num(value[own], nan=np.finfo(float).max)
        marker[place] = mark[own]
        yield rows, level, marker
        at = k


def _margin(batch: pa.RecordBatch, rows: np.ndarray, shape: tuple, prefix: str, kind, empty, block: int) -> np.ndarray:
    """The neighbours' rims, where they came, in the margin of stacked blocks."""
    out = np.full(shape, empty, kind)
    h, w = shape[1] - 2, shape[2] - 2
    for side in SIDES:
        if f"{prefix}{side}" in batch.schema.names:
            column = batch.column(f"{prefix}{side}")
            for n in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)[rows]).tolist():
                rim = np.frombuffer(column[int(rows[n])].as_py(), kind)
                if side in ("up", "down"):
                    # The lower neighbour only touches a block that is as high as blocks are.
                    if side == "up" or h == block:
                        out[n, 0 if side == "up" else h + 1, 1 : w + 1] = rim[:w]
                elif side == "left" or w == block:
                    out[n, 1 : h + 1, 0 if side == "left" else w + 1] = rim[:h]
    return out


def _rims(values: np.ndarray, empty, block: int) -> dict[str, np.ndarray]:
    """The outermost lines of each stacked block, as long as a block's side."""
    n, h, w = values.shape[0], values.shape[1] - 2, values.shape[2] - 2
    out = {side: np.full((n, block), empty, values.dtype) for side in SIDES}
    out["up"][:, :w], out["left"][:, :h] = values[:, 1, 1:-1], values[:, 1:-1, 1]
    if h == block:
        out["down"][:, :w] = values[:, h, 1:-1]
    if w == block:
        out["right"][:, :h] = values[:, 1:-1, w]
    return out


def _settled(blocks: DataFrame, markers: bool, block: int) -> DataFrame:
    """Rims of the blocks as they settle with the rims around them, and whether they differ from ``old_...``; of reach, or of markers where reach is known."""
    kind, empty, prefix = (np.int64, NONE, "m_") if markers else (float, np.inf, "r_")

    def run(iterator):
        for batch in iterator:
            for rows, level, marker in _stacks(batch, block) if batch.num_rows else ():
                reach = reached(level, marker, _margin(batch, rows, level.shape, "r_", float, np.inf, block))
                values = owned(level, marker, reach, _margin(batch, rows, level.shape, "m_", np.int64, NONE, block)) if markers else reach
                rims = _rims(values, empty, block)
                made = {s: [v.tobytes() for v in rims[s]] for s in SIDES}
                at = pa.array(rows)
                blank = np.full(block, empty, kind).tobytes()
                old = {s: batch.column(f"old_{s}").take(at).to_pylist() if f"old_{s}" in batch.schema.names else [blank] * len(rows) for s in SIDES}
                changed = [any(made[s][n] != old[s][n] for s in SIDES) for n in range(len(rows))]
                columns = [batch.column(k).take(at) for k in KEYS] + [pa.array(made[s], pa.binary()) for s in SIDES] + [pa.array(changed)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, *[f"{prefix}{s}" for s in SIDES], "changed"])

    tile = blocks.schema["tile"].dataType.simpleString()
    return blocks.mapInArrow(run, f"tile {tile}, br bigint, bc bigint, " + ", ".join(f"{prefix}{s} binary" for s in SIDES) + ", changed boolean")


def _beside(rims: DataFrame, prefix: str) -> DataFrame:
    """The rims that lie next to each block: ``up`` is the lower rim of the block above."""
    messages = []
    for side in SIDES:
        dy, dx = _AT[side]
        rim = [F.col(f"{prefix}{_BACK[side]}").alias(f"{prefix}{s}") if s == side else F.lit(None).cast("binary").alias(f"{prefix}{s}") for s in SIDES]
        messages.append(rims.select("tile", (F.col("br") - dy).alias("br"), (F.col("bc") - dx).alias("bc"), *rim))
    union = messages[0]
    for m in messages[1:]:
        union = union.unionByName(m)
    return union.groupBy(*KEYS).agg(*[F.max(f"{prefix}{s}").alias(f"{prefix}{s}") for s in SIDES])


def _exchanged(blocks: DataFrame, markers: bool, block: int, cut) -> DataFrame:
    """The final rims of ``blocks``, whose rows hold the final reach around them if it is the ``markers``' turn."""
    prefix, keys = "m_" if markers else "r_", list(KEYS)
    rims = cut(_settled(blocks, markers, block))
    while True:
        moved = rims.where("changed")
        if moved.isEmpty():
            return rims.drop("changed")
        near = None
        for dy, dx in _AT.values():
            side = moved.select("tile", (F.col("br") + dy).alias("br"), (F.col("bc") + dx).alias("bc"))
            near = side if near is None else near.unionByName(side)
        old = rims.select(*keys, *[F.col(f"{prefix}{s}").alias(f"old_{s}") for s in SIDES])
        active = blocks.join(near.distinct(), keys, "left_semi").join(_beside(rims, prefix), keys).join(old, keys)
        again = cut(_settled(active, markers, block))
        after = cut(rims.join(again, keys, "left_anti").withColumn("changed", F.lit(False)).unionByName(again))
        forget(rims, again)
        rims = after


def flood(canopy: DataFrame, checkpoint=None, min_pixels: int = 0) -> DataFrame:
    """``tile, row, col, label`` of the pixels ``tile, row, col, level, marker`` (0: none) that a marker has; see the module. Tiles of fewer pixels than ``min_pixels`` are left out."""
    cut, block = checkpoint or (lambda df: df.checkpoint()), BLOCK
    place = ((F.col("row") % block) * block + F.col("col") % block).cast("int").alias("pos")
    at = [F.floor(F.col(c) / block).cast("bigint").alias(k) for c, k in (("row", "br"), ("col", "bc"))]
    pixel = F.struct(place, F.coalesce(F.col("level").cast("double"), F.lit(float("nan"))).alias("level"), F.col("marker").cast("bigint").alias("marker"))

    def labels(iterator):
        for batch in iterator:
            for rows, level, marker in _stacks(batch, block) if batch.num_rows else ():
                reach = reached(level, marker, _margin(batch, rows, level.shape, "r_", float, np.inf, block))
                owner = owned(level, marker, reach, _margin(batch, rows, level.shape, "m_", np.int64, NONE, block))
                n, y, x = np.nonzero(np.isfinite(level) & (owner < NONE))
                br, bc = (batch.column(k).to_numpy()[rows[n]] for k in ("br", "bc"))
                columns = [batch.column("tile").take(pa.array(rows[n])), pa.array((br * block + y - 1).astype(np.int32)), pa.array((bc * block + x - 1).astype(np.int32)), pa.array(owner[n, y, x].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["tile", "row", "col", "label"])

    keys = list(KEYS)
    # What is to be known of a tile is counted from its written blocks: the pixels come from filters that are not to run twice.
    written = cut(canopy.select("tile", *at, pixel.alias("px")).groupBy(*KEYS).agg(F.collect_list("px").alias("px"), F.max("px.marker").alias("_m")))
    tiles = written.groupBy("tile").agg(F.count("*").alias("_b"), F.sum(F.size("px")).alias("_n"), F.max("_m").alias("_m")).where((F.col("_n") >= min_pixels) & (F.col("_m") > 0))
    blocks, largest = written.drop("_m"), written.agg(F.max(F.size("px"))).first()[0] or 1
    # A batch of large blocks must not fill a worker; small ones go many at a time.
    batch = min(max(64 * BLOCK * BLOCK // largest, 64), 4096)
    with settings(canopy.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}):
        lone = blocks.join(tiles.where("_b = 1").select("tile"), "tile", "left_semi")
        joined = blocks.join(tiles.where("_b > 1").select("tile"), "tile", "left_semi")
        reach = _exchanged(joined, False, block, cut)
        known = joined.join(_beside(reach, "r_"), keys, "left")
        owners = _exchanged(known, True, block, cut)
        rows = lone.unionByName(known.join(_beside(owners, "m_"), keys, "left"), allowMissingColumns=True)
        result = cut(rows.mapInArrow(labels, f"tile {canopy.schema['tile'].dataType.simpleString()}, row int, col int, label int"))
    forget(written, reach, owners)
    return result

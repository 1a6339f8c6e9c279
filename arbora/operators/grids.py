"""Raster headers as a table that plans join, so that each raster has its own transform, size, coordinate system and nodata value; warping.

Rows of all rasters go through one plan: a header is one small row a raster, joined by ``tile``, and its columns take the place of
constants in the expressions of ``functions.geo``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import geo
from arbora.operators.batches import by_groups
from arbora.operators.spatial import box_join
from arbora.sources.scans import SRID, require

AFFINE = ("a", "b", "c", "d", "e", "f")
SIZE = ("n_rows", "n_cols")
_HEADER = (*AFFINE, *SIZE, "srid")


def headers(df: DataFrame) -> DataFrame:
    """``tile, a .. f, n_rows, n_cols, srid, nodata`` (25832 and null where absent); a transform without inverse or an empty raster is an error."""
    df = require(df, ["tile", *AFFINE, *SIZE])
    absent = {"srid": F.lit(None).cast("int"), "nodata": F.lit(None).cast("double")}
    df = df.withColumns({c: v for c, v in absent.items() if c not in df.columns})
    number = lambda c: F.col(c).cast("double")
    sound = F.coalesce((number("a") * number("e") - number("b") * number("d") != 0) & (F.col("n_rows") > 0) & (F.col("n_cols") > 0) & (number("c") + number("f")).isNotNull(), F.lit(False))
    tile = F.when(sound, F.col("tile")).otherwise(F.raise_error(F.concat(F.lit("no usable header: raster "), F.col("tile").cast("string"))).cast(df.schema["tile"].dataType))
    return df.select(tile.alias("tile"), *[number(c).alias(c) for c in AFFINE], *[F.col(c).cast("int").alias(c) for c in SIZE], F.coalesce(F.col("srid").cast("int"), F.lit(SRID)).alias("srid"), number("nodata").alias("nodata"))


def transform(prefix: str = "_h_") -> geo.Affine:
    return tuple(F.col(f"{prefix}{c}") for c in AFFINE)


def with_header(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` with their raster's header in columns ``_h_...``; rows of rasters without a header go."""
    return rows.join(heads.select("tile", *[F.col(c).alias(f"_h_{c}") for c in (*_HEADER, "nodata")]), "tile")


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_h_{c}" for c in (*_HEADER, "nodata")])


def boxes_to_map(boxes: DataFrame, heads: DataFrame) -> DataFrame:
    """Pixel boxes ``tile, x1, y1, x2, y2`` with their map box ``xmin .. ymax`` and its ``srid``."""
    found = with_header(boxes, heads)
    return _plain(found.withColumns(geo.box_to_map(transform(), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])).withColumn("srid", F.col("_h_srid")))


def points_to_pixels(points: DataFrame, heads: DataFrame) -> DataFrame:
    """Map points ``tile, x, y`` with the ``row, col`` they fall on, and whether that is ``inside`` the raster."""
    col, row = geo.map_to_pixel(transform(), F.col("x"), F.col("y"))
    found = with_header(points, heads).withColumns({"row": F.floor(row), "col": F.floor(col)})
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("_h_n_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("_h_n_cols"))
    return _plain(found.withColumn("inside", inside))


def clip_boxes(boxes: DataFrame, heads: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Chip boxes ``tile, x1 .. y2``, moved by (``dx``, ``dy``), as whole pixels ``px1 .. py2`` of their raster."""
    box = geo.clip_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], dx, dy, F.col("_h_n_cols"), F.col("_h_n_rows"))
    return _plain(with_header(boxes, heads).withColumns(box))


def grid_min_z(points: DataFrame, heads: DataFrame) -> DataFrame:
    """``tile, row, col, z``: the lowest of the points ``tile, x, y, z`` of each pixel; points outside their raster are dropped."""
    placed = points_to_pixels(points.where("z is not null and not isnan(z)"), heads).where("inside")
    return placed.groupBy("tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.min("z").alias("z"))


def valid_pixels(pixels: DataFrame, heads: DataFrame) -> DataFrame:
    """The pixels within their raster's size, nodata values as null."""
    found = with_header(pixels, heads).where("row >= 0 and row < _h_n_rows and col >= 0 and col < _h_n_cols")
    return _plain(found.withColumn("value", F.when(F.col("_h_nodata").isNull() | (F.col("value") != F.col("_h_nodata")), F.col("value"))))


def window_boxes(windows: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """Windows ``tile, row0, col0`` of ``size`` pixels with the bounds ``xmin .. ymax`` of their four corners on the map."""
    found = with_header(windows, heads)
    corners = [geo.pixel_to_map(transform(), F.col("col0") + i, F.col("row0") + j) for i in (0, size) for j in (0, size)]
    edge = lambda pick, k: pick(*[c[k] for c in corners])
    return _plain(found.withColumns({"xmin": edge(F.least, 0), "ymin": edge(F.least, 1), "xmax": edge(F.greatest, 0), "ymax": edge(F.greatest, 1)}))


def window_labels(windows: DataFrame, heads: DataFrame, boxes: DataFrame, size: int, cell: float, grow: float = 0.01) -> DataFrame:
    """``tile, window_id, box_id, xc, yc, w, h``: boxes that meet a window (grown by ``grow``) and have their centre on it, in shares of the window."""
    chips = window_boxes(windows, heads, size)
    met = with_header(box_join(chips, boxes.select("box_id", *[F.col(c).alias(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), cell, grow=grow), heads)
    corner = [geo.map_to_pixel(transform(), F.col(f"r_{x}"), F.col(f"r_{y}")) for x, y in (("xmin", "ymin"), ("xmax", "ymax"))]
    share = lambda k, o: [(c[k] - F.col(o)) / size for c in corner]
    (x0, x1), (y0, y1) = share(0, "col0"), share(1, "row0")
    met = met.withColumns({"xc": (x0 + x1) / 2, "yc": (y0 + y1) / 2, "w": F.abs(x1 - x0), "h": F.abs(y1 - y0)})
    return met.where("xc between 0 and 1 and yc between 0 and 1").select("tile", "window_id", "box_id", "xc", "yc", "w", "h")


# --- warping ---------------------------------------------------------------------------------------------------------

BLOCK = 256  #: side of a block of source pixels, and the most of a block of target pixels
WINDOW = 2048  #: source pixels along a side that a block of target pixels may need, about
_POINTS = 5  #: points along a side of the lattice by which a block's place in the other raster is found


def _numbers(row, prefix: str) -> tuple[geo.Affine, int, int, int]:
    get = lambda c: getattr(row, f"{prefix}{c}")
    return tuple(get(c) for c in AFFINE), int(get("n_rows")), int(get("n_cols")), int(get("srid"))


def _moved(one, other, col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (col, row) of one raster as places of the other."""
    x, y = geo.pixel_to_map(one[0], col, row)
    return geo.map_to_pixel(other[0], *geo.converted(one[3], other[3], x, y, np))


def _reach(target, source) -> tuple[float, float]:
    """How far a target pixel reaches in source pixels across and down: its size there where it is coarser, else one."""
    _, n_rows, n_cols, _ = target
    y, x = n_rows / 2, n_cols / 2
    cols, rows = _moved(target, source, np.array([x, x + 1, x]), np.array([y, y, y + 1]))
    return max(1.0, math.hypot(*(cols[1:] - cols[0]))), max(1.0, math.hypot(*(rows[1:] - rows[0])))


def _bounds(one, other, rows: tuple[int, int], cols: tuple[int, int]) -> tuple[float, float, float, float]:
    """(low row, high row, low col, high col) in ``other`` of a block of ``one``, and some more, as its sides may be bent there."""
    y, x = np.meshgrid(np.linspace(*rows, _POINTS), np.linspace(*cols, _POINTS))
    c, r = _moved(one, other, x, y)
    bend = 0.0 if one[3] == other[3] else 0.05
    more = lambda v: (v.min() - 1 - bend * np.ptp(v), v.max() + 1 + bend * np.ptp(v))
    return *more(r), *more(c)


def _needed(pairs: DataFrame) -> DataFrame:
    """Which blocks of source pixels each block of target pixels may draw on."""
    names = [*[f"t_{c}" for c in _HEADER], *[f"s_{c}" for c in _HEADER]]

    def blocks(iterator):
        for pdf in iterator:
            out = []
            for row in pdf.itertuples(index=False):
                target, source, side = _numbers(row, "t_"), _numbers(row, "s_"), int(row.side)
                across, down = _reach(target, source)
                low_r, high_r, low_c, high_c = _bounds(source, target, (0, source[1]), (0, source[2]))
                span = lambda low, high, n, k: range(max(0, math.floor(low / k)), min(math.ceil(n / k), math.floor(high / k) + 1))
                for br in span(low_r, high_r, target[1], side):
                    for bc in span(low_c, high_c, target[2], side):
                        box = _bounds(target, source, (br * side, min(target[1], (br + 1) * side)), (bc * side, min(target[2], (bc + 1) * side)))
                        rows = span(box[0] - down, box[1] + down, source[1], BLOCK)
                        cols = span(box[2] - across, box[3] + across, source[2], BLOCK)
                        if len(rows) and len(cols):
                            out += [(row.tile, br, bc, row.source, y, x, rows[0], rows[-1], cols[0], cols[-1], *row[3:]) for y in rows for x in cols]
            yield pd.DataFrame(out, columns=["tile", "br", "bc", "source", "sr", "sc", "r0", "r1", "c0", "c1", *names]) if out else pd.DataFrame({c: [] for c in ["tile", "br", "bc", "source", "sr", "sc", "r0", "r1", "c0", "c1", *names]})

    kind = lambda c: pairs.schema[c].dataType.simpleString()
    schema = f"tile {kind('tile')}, br int, bc int, source {kind('source')}, sr int, sc int, r0 int, r1 int, c0 int, c1 int, " + ", ".join(f"{n} {kind(n)}" for n in names)
    return pairs.select("tile", "source", "side", *names).mapInPandas(blocks, schema)


def _source_blocks(pixels: DataFrame) -> DataFrame:
    """One row for each block of source pixels: the smallest box around its known values, as doubles row by row."""

    def dense(px: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r, c = px["row"], px["col"]
        box = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        box[r - r.min(), c - c.min()] = px["value"]
        return {"row0": r.min(keepdims=True), "col0": c.min(keepdims=True), "width": np.array([box.shape[1]]), "values": np.array([box.tobytes()], object)}

    known = pixels.select(F.col("tile").alias("source"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    known = known.withColumns({"sr": F.floor(F.col("row") / BLOCK).cast("int"), "sc": F.floor(F.col("col") / BLOCK).cast("int")})
    made = by_groups(known, ["source", "sr", "sc"], dense, "row0 bigint, col0 bigint, width bigint, values binary")
    return made.select("source", "sr", "sc", *[F.col(n).cast("int").alias(n) for n in ("row0", "col0", "width")], "values")


def _sampled(target, source, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, row0: int, col0: int) -> np.ndarray:
    """Bilinear values at the centres of target pixels from source ``values``, whose first pixel is (``row0``, ``col0``); nan where none is known."""
    x, y = _moved(target, source, cols + 0.5, rows + 0.5)
    inside = (x >= 0) & (x <= source[2]) & (y >= 0) & (y <= source[1])
    u, v = x - 0.5, y - 0.5
    across, down = _reach(target, source)
    total, weight = np.zeros(rows.shape), np.zeros(rows.shape)
    taps = lambda r: range(1 - math.ceil(r), math.ceil(r) + 1)
    for j in taps(down):
        r = np.floor(v) + j
        wy = np.maximum(0.0, 1 - np.abs(v - r) / down)
        for i in taps(across):
            c = np.floor(u) + i
            w = wy * np.maximum(0.0, 1 - np.abs(u - c) / across)
            use = inside & (w > 0) & (r >= 0) & (r < source[1]) & (c >= 0) & (c < source[2])
            at_r, at_c = r[use].astype(int) - row0, c[use].astype(int) - col0
            if len(at_r) and (min(at_r.min(), at_c.min()) < 0 or at_r.max() >= values.shape[0] or at_c.max() >= values.shape[1]):
                raise ValueError("a target block reaches beyond the source blocks that were brought to it")
            found = values[at_r, at_c]
            known = ~np.isnan(found)
            places = np.flatnonzero(use)[known]
            np.add.at(total.reshape(-1), places, (w[use] * found)[known])
            np.add.at(weight.reshape(-1), places, w[use][known])
    return np.divide(total, weight, out=np.full(rows.shape, np.nan), where=weight > 1e-12)


def warp(pixels: DataFrame, sources: DataFrame, targets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``tile, row, col, value`` for every pixel of the ``targets``' grids: source ``pixels`` at their centres, null where none is known.

    ``sources`` and ``targets`` are headers; ``pairs`` (``tile, source``) says which sources a target draws on, else it is the one of its
    own tile. Where several know a pixel the first by ``source`` gives it. A value is the mean of the nearest source pixels that are known, weighted
    by a tent as wide as a source pixel on each side (bilinear), or as a target pixel where that is coarser; beyond a source's edge nothing is known. Coordinate systems may differ
    (4326 and 25832). Target grids are cut into blocks, smaller ones where a target pixel covers many source pixels, and only the
    blocks of source pixels that one may draw on are brought to it.
    """
    heads = lambda df, p, key: df.select(F.col("tile").alias(key), *[F.col(c).alias(f"{p}{c}") for c in _HEADER])
    pairs = targets.select("tile", F.col("tile").alias("source")) if pairs is None else pairs.select("tile", "source").distinct()
    pairs = pairs.join(heads(targets, "t_", "tile"), "tile").join(heads(sources, "s_", "source"), "source")

    def coarse(*columns: pd.Series) -> pd.Series:
        return pd.Series([max(_reach(_numbers(r, "t_"), _numbers(r, "s_"))) for r in pd.concat(columns, axis=1, keys=[f"{p}{c}" for p in ("t_", "s_") for c in _HEADER]).itertuples(index=False)], dtype=float)

    reach = F.pandas_udf(coarse, "double")(*[F.col(f"{p}{c}") for p in ("t_", "s_") for c in _HEADER])
    sides = pairs.select("tile", reach.alias("_reach")).groupBy("tile").agg(F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(WINDOW / F.max("_reach")))).cast("int").alias("side"))
    needed = _needed(pairs.join(sides, "tile"))
    brought = needed.join(_source_blocks(pixels), ["source", "sr", "sc"], "left")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / F.col("side")).cast("int")))
    sized = heads(targets, "t_", "tile").join(sides, "tile", "left").withColumn("side", F.coalesce("side", F.lit(BLOCK)))
    every = sized.withColumn("br", axis("t_n_rows")).withColumn("bc", axis("t_n_cols")).select("tile", "br", "bc", "side", F.col("t_n_rows").alias("_rows"), F.col("t_n_cols").alias("_cols"))

    def block(px: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        head = int(np.flatnonzero(~np.isnan(px["side"].astype(float)))[0])
        side, br, bc = int(px["side"][head]), int(px["br"][0]), int(px["bc"][0])
        rows, cols = (g.astype(int) for g in np.meshgrid(np.arange(br * side, min(int(px["_rows"][head]), (br + 1) * side)), np.arange(bc * side, min(int(px["_cols"][head]), (bc + 1) * side)), indexing="ij"))
        out = np.full(rows.shape, np.nan)
        parts: dict = {}
        for i, box in enumerate(px["values"]):
            if box is not None:
                parts.setdefault(px["source"][i], []).append(i)
        for source in sorted(parts):
            at = parts[source]
            raster = lambda p: (tuple(px[f"{p}{c}"][at[0]] for c in AFFINE), int(px[f"{p}n_rows"][at[0]]), int(px[f"{p}n_cols"][at[0]]), int(px[f"{p}srid"][at[0]]))  # noqa: B023, E731
            r0, r1, c0, c1 = (int(px[c][at[0]]) for c in ("r0", "r1", "c0", "c1"))
            values = np.full(((r1 + 1 - r0) * BLOCK, (c1 + 1 - c0) * BLOCK), np.nan)
            for i in at:
                box = np.frombuffer(px["values"][i]).reshape(-1, int(px["width"][i]))
                y, x = int(px["row0"][i]) - r0 * BLOCK, int(px["col0"][i]) - c0 * BLOCK
                values[y : y + len(box), x : x + box.shape[1]] = box
            found = _sampled(raster("t_"), raster("s_"), rows, cols, values, r0 * BLOCK, c0 * BLOCK)
            out = np.where(np.isnan(out), found, out)
        return {"row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32), "value": out.ravel()}

    rows = brought.unionByName(every, allowMissingColumns=True)
    made = by_groups(rows, ["tile", "br", "bc"], block, "row int, col int, value double").select("tile", "row", "col", "value")
    return made.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def overlapping(targets: DataFrame, sources: DataFrame, cell: float = 1000.0) -> DataFrame:
    """``tile, source`` of the rasters of one coordinate system whose extents meet; for ``warp``."""
    corners = lambda: [geo.pixel_to_map(transform(), x, y) for x in (F.lit(0), F.col("_h_n_cols")) for y in (F.lit(0), F.col("_h_n_rows"))]
    edges = lambda: {n: pick(*[c[k] for c in corners()]) for n, pick, k in (("xmin", F.least, 0), ("ymin", F.least, 1), ("xmax", F.greatest, 0), ("ymax", F.greatest, 1))}
    whole = lambda df: with_header(df.select("tile"), df).withColumns(edges()).select("tile", F.col("_h_srid").alias("srid"), *edges())
    right = whole(sources).select(F.col("tile").alias("source"), "srid", *[F.col(c).alias(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return box_join(whole(targets), right, cell, keys=["srid"], strict=True).select("tile", "source")

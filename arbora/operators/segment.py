"""Tree crowns: mask cleaning, height peaks, marker watershed, crown tables and outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.batches import by_groups, by_many, stacks
from arbora.operators.flood import flood

#: Side of the blocks of pixels whose components one task finds at a time.
BLOCK = 256


def _joined(row: np.ndarray, col: np.ndarray, value: np.ndarray | None, diagonal: bool) -> np.ndarray:
    """For each pixel of a block the place of the first pixel, by row and column, of its component."""
    order = np.lexsort((col, row))
    r, c = row[order] - row.min(), col[order] - col.min()
    place = np.full((r.max() + 2, c.max() + 3), -1)  # a margin for neighbours that are not there
    place[r, c + 1] = np.arange(len(r))
    ends = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if diagonal else 2]:
        other = place[r + dy, c + 1 + dx]
        a = np.flatnonzero(other >= 0)
        b = other[a]
        if value is not None:
            same = (value[order][a] == value[order][b]) & pd.notna(value[order][a])
            a, b = a[same], b[same]
        ends.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*ends))
    root = np.arange(len(r))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while not np.array_equal(further := after[after], after):
            after = further
        if (after == root).all():
            break
        root = after
    out = np.empty(len(r), np.int64)
    out[order] = order[root]
    return out


def label_components(pixels: DataFrame, diagonal: bool = True, equal: str | None = None, checkpoint=None) -> DataFrame:
    """Add ``comp`` to the pixels ``tile, row, col``: connected ones of a tile (8 or 4 neighbours, of equal ``equal``; null equals nothing) share a number.

    The number is that of the component's first pixel, ``row << 32 | col``. Components are found block by block; only where they
    touch at a block's side are they joined to each other, by rounds in which the smallest number spreads and jumps ahead.
    """
    cut = checkpoint or (lambda df: df.checkpoint())
    extra = [equal] if equal else []
    block = [F.floor(F.col(c) / BLOCK).alias(f"_b{c}") for c in ("row", "col")]

    def inside(px: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r, c = px["row"].astype(np.int64), px["col"].astype(np.int64)
        first = _joined(r, c, px[equal] if equal else None, diagonal)
        return {**{k: px[k] for k in (*extra, "row", "col")}, "part": r[first] << 32 | c[first]}

    kept = pixels.select("tile", *block, *extra, "row", "col")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[3:])
    parts = cut(by_groups(kept, ["tile", "_brow", "_bcol"], inside, f"{schema}, part bigint").drop("_brow", "_bcol"))
    # Pixels at the sides of blocks, and their neighbours in other blocks.
    side = lambda c: (F.col(c) % BLOCK).isin(0, BLOCK - 1)
    rim = parts.where(side("row") | side("col"))
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if diagonal else 2]]))
    out = rim.withColumn("_s", steps).select("tile", *extra, "row", "col", F.col("part").alias("a"), (F.col("row") + F.col("_s.y")).alias("_r"), (F.col("col") + F.col("_s.x")).alias("_c"))
    crossing = (F.floor(F.col("row") / BLOCK) != F.floor(F.col("_r") / BLOCK)) | (F.floor(F.col("col") / BLOCK) != F.floor(F.col("_c") / BLOCK))
    there = rim.select("tile", *extra, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("part").alias("b"))
    down = out.where(crossing).join(there, ["tile", *extra, "_r", "_c"]).select("tile", "a", "b").distinct()
    both = cut(down.union(down.select("tile", F.col("b").alias("a"), F.col("a").alias("b"))))
    if both.isEmpty():
        return parts.withColumnRenamed("part", "comp")
    labels = both.select("tile", F.col("a").alias("part")).distinct().withColumn("comp", F.col("part"))
    while True:
        near = both.join(labels.withColumnRenamed("part", "b"), ["tile", "b"]).groupBy("tile", "a").agg(F.min("comp").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "part"), ["tile", "part"]).select("tile", "part", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = lower.select("tile", F.col("part").alias("comp"), F.col("comp").alias("further"))
        after = cut(lower.join(jump, ["tile", "comp"]).select("tile", "part", "old", F.col("further").alias("comp")))
        labels = after.select("tile", "part", "comp")
        if after.where("comp <> old").isEmpty():
            break
    return parts.join(labels, ["tile", "part"], "left").select("tile", *extra, "row", "col", F.coalesce("comp", "part").alias("comp"))


def clean_mask(mask: DataFrame, min_area: int = 10, checkpoint=None) -> DataFrame:
    """The pixels of ``tile, row, col`` whose 8-connected component has ``min_area`` pixels or more (1 or less keeps all)."""
    if min_area <= 1:
        return mask.select("tile", "row", "col")
    labelled = label_components(mask, checkpoint=checkpoint)
    large = labelled.groupBy("tile", "comp").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_area).select("tile", "comp")
    return labelled.join(large, ["tile", "comp"], "left_semi").select("tile", "row", "col")


def local_maxima(heights: DataFrame, min_distance: int = 2, least: float | None = None) -> DataFrame:
    """Pixels inside the canopy (tile, row, col, height, canopy) that no neighbour within the square exceeds.

    The moving maximum is separable: along the rows, then along the columns. Heights outside the canopy count as 0.
    """
    h = F.when(F.col("canopy"), F.col("height")).otherwise(0.0)
    across = Window.partitionBy("tile", "row").orderBy("col").rangeBetween(-min_distance, min_distance)
    down = Window.partitionBy("tile", "col").orderBy("row").rangeBetween(-min_distance, min_distance)
    peaks = heights.withColumn("h", h).withColumn("_m", F.max("h").over(across)).withColumn("_m", F.max("_m").over(down))
    if least is not None:
        peaks = peaks.withColumn("_floor", F.lit(least))
    else:
        peaks = peaks.join(peaks.groupBy("tile").agg(F.min("h").alias("_floor")), "tile")
    return peaks.where((F.col("h") == F.col("_m")) & (F.col("h") > F.col("_floor")) & F.col("canopy")).select("tile", "row", "col", F.col("h").alias("height"))


def space_peaks(peaks: DataFrame, min_distance: int = 2, checkpoint=None) -> DataFrame:
    """Of peaks within the square of each other only the highest stays (ties: smaller row, then column), numbered from 1 by height."""
    from arbora.operators.matching import suppress

    p = peaks.withColumn("box_id", F.struct("tile", "row", "col")).withColumn("conf", F.col("height"))
    cell = min_distance + 1
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = p.select("tile", F.col("box_id").alias("a"), F.col("conf").alias("a_conf"), F.col("row").alias("r"), F.col("col").alias("c")).withColumn("_x", F.floor(F.col("c") / cell)).withColumn("_y", F.floor(F.col("r") / cell))
    b = p.select("tile", F.col("box_id").alias("b"), F.col("conf").alias("b_conf"), "row", "col").withColumn("_i", around).withColumn("_j", around)
    b = b.withColumns({"_x": F.floor(F.col("col") / cell) + F.col("_i"), "_y": F.floor(F.col("row") / cell) + F.col("_j")})
    near = (F.abs(F.col("r") - F.col("row")) <= min_distance) & (F.abs(F.col("c") - F.col("col")) <= min_distance)
    edges = a.join(b, ["tile", "_x", "_y"]).where(near & (F.col("a") < F.col("b"))).select("a", "b", "a_conf", "b_conf")
    kept = suppress(p, edges, checkpoint=checkpoint)
    order = Window.partitionBy("tile").orderBy(F.desc("height"), "row", "col")
    return kept.select("tile", F.row_number().over(order).alias("marker"), "row", "col", "height")


def _reached(free: np.ndarray) -> np.ndarray:
    """The free pixels of stacked arrays that a path of free neighbours (side by side) joins to the border: whole runs at a time, by rows and columns in turn."""
    out = np.zeros_like(free)
    for edge in (np.s_[:, [0, -1]], np.s_[:, :, [0, -1]]):
        out[edge] = free[edge]
    while True:
        before = int(out.sum())
        for axes in ((0, 1, 2), (0, 2, 1)):
            f, o = free.transpose(axes), out.transpose(axes)
            lines = np.arange(f.shape[0] * f.shape[1]).reshape(f.shape[0], f.shape[1], 1)
            runs = np.cumsum(np.diff(f, axis=2, prepend=False), axis=2) + lines * (f.shape[2] + 2)
            hit = np.zeros(int(runs.max()) + 1, bool)
            hit[runs[o]] = True
            o |= f & hit[runs]
        if int(out.sum()) == before:
            return out


def fill_holes(labels: DataFrame) -> DataFrame:
    """``tile, row, col, label`` with the holes of each label filled, each label as it stands in the input.

    A label is filled within its own bounding box, so crowns are spread over the tasks; where fillings and labels meet, the largest
    label stays, as if they had been filled in ascending order.
    """

    def fill(px: dict[str, np.ndarray], starts: np.ndarray):
        y0, x0 = (np.minimum.reduceat(px[c], starts) for c in ("row", "col"))
        sizes = np.diff(np.append(starts, len(px["row"])))
        r, c = px["row"] - np.repeat(y0, sizes), px["col"] - np.repeat(x0, sizes)
        # Arrays a little too large, so that many crowns are of one size; what is free there joins the border.
        step = lambda n: np.where(n <= 64, -(-n // 4) * 4, -(-n // 32) * 32)
        kinds = np.stack([step(np.maximum.reduceat(v, starts).astype(np.int64) + 1) for v in (r, c)], axis=1)
        for (h, w), first, rows, slot in stacks(starts, len(r), kinds):
            own = np.zeros((len(first), h, w), bool)
            own[slot, r[rows], c[rows]] = True
            n, y, x = np.nonzero(~_reached(~own))
            group = np.searchsorted(starts, first)[n]
            yield first[n], {"row": (y + y0[group]).astype(np.int32), "col": (x + x0[group]).astype(np.int32)}

    filled = by_many(labels.select("tile", "label", "row", "col"), ["tile", "label"], fill, "row int, col int")
    return filled.groupBy("tile", "row", "col").agg(F.max("label").alias("label"))


def watershed(pixels: DataFrame, min_pixels: int = 10, fill: bool = True, checkpoint=None) -> DataFrame:
    """``tile, row, col, label`` of the crowns of each tile, by a marker watershed within the canopy (see ``flood``).

    ``pixels``: tile, row, col, level (flooded from low to high), canopy, marker (0 or null: none). Plateaus go by level, then marker, then row and
    column. Parts of the canopy without a marker give no row; nor does a tile with fewer canopy pixels than ``min_pixels``.
    """
    canopy = pixels.where("canopy").select("tile", "row", "col", "level", F.coalesce("marker", F.lit(0)).cast("int").alias("marker"))
    labels = flood(canopy, checkpoint, min_pixels)
    return fill_holes(labels) if fill else labels


def crown_table(labels: DataFrame, pixel_area: float = 1.0) -> DataFrame:
    """Area and pixel bounds (exclusive upper ones) of each crown."""
    return labels.groupBy("tile", "label").agg(
        F.count("*").alias("n_pixels"), (F.count("*") * F.lit(float(pixel_area))).alias("area"),
        F.min("col").alias("px1"), F.min("row").alias("py1"), (F.max("col") + 1).alias("px2"), (F.max("row") + 1).alias("py2"),
    )


def outlines(labels: DataFrame, checkpoint=None) -> DataFrame:
    """One row for each 4-connected part of a crown: ``tile, label, part, n_pixels`` and its outline as ordered corner points.

    A pixel's side is on the outline if the neighbour there belongs to another part; the sides of a part are
    chained into rings by following corner to corner (outer ring first, then holes).
    """
    parts = label_components(labels, diagonal=False, equal="label", checkpoint=checkpoint).withColumnRenamed("comp", "part")
    # Every side as a directed step with the pixel on its right; steps that two pixels of a part share go.
    r, c = F.col("row"), F.col("col")
    step = lambda y0, x0, y1, x1: F.struct(y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))
    sides = F.explode(F.array(step(r, c, r, c + 1), step(r, c + 1, r + 1, c + 1), step(r + 1, c + 1, r + 1, c), step(r + 1, c, r, c)))
    steps = parts.select("tile", "label", "part", sides.alias("s")).select("tile", "label", "part", "s.*")
    line = [F.least("y0", "y1").alias("ly"), F.least("x0", "x1").alias("lx"), (F.col("y0") == F.col("y1")).alias("flat")]
    outer = steps.groupBy("tile", "label", "part", *line).agg(F.count("*").alias("k"), F.first(F.struct("y0", "x0", "y1", "x1")).alias("s")).where("k = 1")
    lists = outer.groupBy("tile", "label", "part").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    sizes = parts.groupBy("tile", "label", "part").agg(F.count("*").alias("n_pixels"))

    def chain(iterator):
        for pdf in iterator:
            rings = []
            for steps_ in pdf["steps"]:
                after: dict = {}
                for s in steps_:
                    after.setdefault((s["y0"], s["x0"]), []).append((s["y1"], s["x1"]))
                found = []
                while after:
                    at = start = min(after)
                    ring, came = [], None
                    while True:
                        ring.append(at)
                        ways = after[at]
                        # At a corner where two pixels meet, turn right: the ring stays with its own pixel.
                        if len(ways) > 1 and came is not None:
                            d = (at[0] - came[0], at[1] - came[1])
                            ways.sort(key=lambda w: (w[0] - at[0], w[1] - at[1]) != (d[1], -d[0]))  # noqa: B023
                        nxt = ways.pop(0)
                        if not ways:
                            del after[at]
                        came, at = at, nxt
                        if at == start:
                            break
                    found.append([{"y": int(y), "x": int(x)} for y, x in ring])
                rings.append(found)
            yield pdf.drop(columns="steps").assign(rings=rings)

    joined = lists.join(sizes, ["tile", "label", "part"]).select("tile", "label", "part", "n_pixels", "steps")
    return joined.mapInPandas(chain, "tile bigint, label int, part bigint, n_pixels bigint, rings array<array<struct<y:int,x:int>>>")

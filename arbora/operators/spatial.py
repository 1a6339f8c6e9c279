"""Spatial joins as equality joins on grid cells with an exact residual condition.

Each box belongs to the level whose cells are as large as it or, at most, ``STEP`` times as large, so it touches four of them at most, whether it is a crown
or a country, and a cell holds no more boxes than lie that near to each other. Two boxes are compared in the cells of the coarser one's level: the coarser
is listed there as it is, the finer also in the cells of those coarser levels that the other side has. A pair is kept
only in the first cell that both have (the larger of the two lower corners), so no distinct step is needed.

The joins are by sorted shuffles and say so: the size that Spark expects of boxes listed in cells is that of the boxes before, by which it would send millions
of rows to the driver and every executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
STEP = 8
LOWEST, HIGHEST = -8, 12  #: levels; the cells of level n are STEP**n times the given size


def _levelled(df: DataFrame, cell: float, box: tuple[str, str, str, str], grow: float) -> DataFrame:
    """The rows with a whole box, with their level ``_l``."""
    size = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])).cast("double") + 2 * grow
    level = F.when(size > 0, F.least(F.greatest(F.ceil(F.log2(size / cell) / math.log2(STEP) - 1e-9), F.lit(LOWEST)), F.lit(HIGHEST))).otherwise(F.lit(LOWEST))
    whole = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in box]) == 0)
    return whole.withColumn("_l", level.cast("int"))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: twenty-one at most."""
    return sorted(r[0] for r in df.select("_l").distinct().collect())


def _first(cell: float, c: str, by: float) -> Column:
    """The first cell along an axis, at level ``_cl``, of a box that begins at ``c``, moved by ``by``."""
    return F.floor((F.col(c) + by) / (F.lit(float(cell)) * F.pow(F.lit(float(STEP)), F.col("_cl"))))


def _cells(df: DataFrame, cell: float, box: tuple[str, str, str, str], grow: float, levels: list[int] | None, coarser: bool = False) -> DataFrame:
    """``df`` in each cell that a box touches: of its own level, or of all ``levels`` that are as coarse (``coarser``: that are coarser)."""
    if levels is None:
        at = df.withColumn("_cl", F.col("_l"))
    else:
        at = df.withColumn("_cl", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: (n > F.col("_l")) if coarser else (n >= F.col("_l")))))
    span = lambda low, high: F.explode(F.sequence(_first(cell, low, -grow), _first(cell, high, grow)))
    at = at.withColumn("_cx", span(box[0], box[2])).withColumn("_cy", span(box[1], box[3]))
    return at.drop("_l")


_CELL = ["_cl", "_cx", "_cy"]


def _sides(a: DataFrame, b: DataFrame, cell: float, a_box, b_box, grow: float, same: bool = False) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables to join on ``_CELL``: the left boxes in their own cells with right ones as fine or finer, and finer left ones with the right ones' own cells.

    Where both hold the same boxes, those of one level are joined on their own cells, so that both tables are one plan under other names, shuffled once.
    """
    a, b = _levelled(a, cell, a_box, grow), _levelled(b, cell, b_box, 0.0)
    own = _levels(a)
    if same and not grow:
        at, below = (lambda df, box: _cells(df, cell, box, 0.0, None)), (lambda df, box: _cells(df, cell, box, 0.0, own, True))
        sides = [(at(a, a_box), at(b, b_box))]
        return sides if len(own) < 2 else [*sides, (at(a, a_box), below(b, b_box)), (below(a, a_box), at(b, b_box))]
    other = own if same else _levels(b)
    sides = [(_cells(a, cell, a_box, grow, None), _cells(b, cell, b_box, 0.0, own or [0]))]
    if own and other and max(other) > min(own):
        sides.append((_cells(a, cell, a_box, grow, other, True), _cells(b, cell, b_box, 0.0, None)))
    return sides


def box_join(left: DataFrame, right: DataFrame, cell: float, left_box=BOX, right_box=tuple(f"r_{c}" for c in BOX), keys: list[str] | None = None, grow: float = 0.0, strict: bool = False, condition: Column | None = None, same: bool = False) -> DataFrame:
    """Pairs whose boxes meet (touching counts, unless ``strict``); the sides have no column names in common but ``keys``.

    ``grow`` widens the left boxes on all sides before the test; ``keys`` must be equal besides. ``cell`` is a unit of length; levels fit the cells to the boxes.
    ``same``: both sides hold the same boxes.
    """
    low_cell = lambda k: F.greatest(_first(cell, left_box[k], -grow), _first(cell, right_box[k], 0.0))
    first = (F.col("_cx") == low_cell(0)) & (F.col("_cy") == low_cell(1))
    l, r = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    low = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    meet = low(l[0] - grow, r[2]) & low(r[0], l[2] + grow) & low(l[1] - grow, r[3]) & low(r[1], l[3] + grow)
    if condition is not None:
        meet = meet & condition
    out = None
    for a, b in _sides(left, right, cell, left_box, right_box, grow, same):
        pairs = a.join(b.hint("merge"), [*(keys or []), *_CELL]).where(meet & first).drop(*_CELL)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def tiles_with_boxes(tiles: DataFrame, boxes: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Semi join: the tiles that at least one box meets."""
    right = boxes.select(*[F.col(c).alias(f"r_{c}") for c in BOX])
    meet = F.expr("l._cl = r._cl and l._cx = r._cx and l._cy = r._cy and l.xmin <= r_xmax and r_xmin <= l.xmax and l.ymin <= r_ymax and r_ymin <= l.ymax")
    out = None
    for a, b in _sides(tiles, right, cell, BOX, tuple(right.columns), 0.0):
        # Each cell of a tile asks on its own; a tile is kept if one of them finds a box.
        kept = a.alias("l").join(b.alias("r").hint("merge"), meet, "left_semi").select(*tiles.columns)
        out = kept if out is None else out.unionByName(kept)
    return out.distinct()


def points_in_tiles(points: DataFrame, tiles: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Left join of points to the tiles they lie strictly inside; a point on an edge has no tile, one in two tiles two rows."""
    box = tuple(f"t_{c}" for c in BOX)
    levelled = _levelled(tiles.select("tile_id", *[F.col(c).alias(f"t_{c}") for c in BOX]), cell, box, 0.0)
    levels = _levels(levelled) or [0]
    out, left = None, points
    for n in levels:
        # One level after the other, as a rule there is one.
        cells = _cells(levelled.where(F.col("_l") == n), cell, box, 0.0, None).hint("merge")
        side = cell * float(STEP) ** n
        inside = (F.floor(F.col("x") / side) == F.col("_cx")) & (F.floor(F.col("y") / side) == F.col("_cy")) & F.expr("x > t_xmin and x < t_xmax and y > t_ymin and y < t_ymax")
        found = points.join(cells, inside, "left" if len(levels) == 1 else "inner").select(*points.columns, "tile_id")
        out = found if out is None else out.unionByName(found)
        if len(levels) > 1:
            left = left.join(cells, inside, "left_anti")
    return out if len(levels) == 1 else out.unionByName(left.withColumn("tile_id", F.lit(None).cast(tiles.schema["tile_id"].dataType)))


def overlap_pairs(boxes: DataFrame, id_col: str, cell: float, min_iou: float, box=BOX, extra: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, iou`` of the pairs a < b of a table whose IoU is above ``min_iou``; of each column in ``extra`` also ``a_...`` and ``b_...``, its values for both."""
    from arbora.functions.geo import iou

    left, right = (boxes.select(F.col(id_col).alias(i), *[F.col(c).alias(f"{side}_{k}") for c, k in zip(box, BOX)], *[F.col(c).alias(f"{i}_{c}") for c in extra]) for i, side in (("a", "l"), ("b", "r")))
    pairs = box_join(left, right, cell, tuple(f"l_{c}" for c in BOX), condition=F.col("a") < F.col("b"), strict=True, same=True)
    pairs = pairs.withColumn("iou", iou("l_", "r_", BOX))
    return pairs.where(F.col("iou") > min_iou).select("a", "b", "iou", *[f"{i}_{c}" for c in extra for i in "ab"])


def pixels_in_boxes(boxes: DataFrame, pixels: DataFrame, block: int = 64) -> DataFrame:
    """Zonal join: the pixels of the box's tile with px1 <= col < px2 and py1 <= row < py2, by blocks of pixels."""
    axis = lambda low, high: F.when(F.col(high) > F.col(low), F.sequence(F.floor(F.col(low) / block), F.floor((F.col(high) - 1) / block)))
    b = boxes.withColumn("_bx", F.explode(axis("px1", "px2"))).withColumn("_by", F.explode(axis("py1", "py2")))
    p = pixels.withColumn("_bx", F.floor(F.col("col") / block)).withColumn("_by", F.floor(F.col("row") / block))
    return b.join(p, ["tile", "_bx", "_by"]).where("col >= px1 and col < px2 and row >= py1 and row < py2").drop("_bx", "_by")

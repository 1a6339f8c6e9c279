"""Rasters by their headers: each with its own transform, size and nodata value."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import chips, grids, rasters
from arbora.plans.queries import query
from arbora.plans.standins import duck, load


def _headers(spark, d):
    return grids.headers(load(spark, d, "headers"))


def _values(spark, d):
    return grids.valid_pixels(load(spark, d, "heights").withColumnRenamed("height", "value"), _headers(spark, d))


_VALID = "SELECT tile, row, col, CASE WHEN nodata IS NULL OR height <> nodata THEN height END AS value, n_rows, n_cols FROM heights JOIN headers USING (tile) WHERE row < n_rows AND col < n_cols"


@query(duck(f"SELECT tile, row, col, value FROM ({_VALID})", "heights", "headers"))
def a05_raster_headers(spark, d):
    return _values(spark, d)


@query(duck("""SELECT gt_id, tile, srid, round(least(l, r), 6) AS xmin, round(least(t, u), 6) AS ymin, round(greatest(l, r), 6) AS xmax, round(greatest(t, u), 6) AS ymax FROM (
 SELECT gt_id, tile, srid, a * x1 + b * y1 + c AS l, d * x1 + e * y1 + f AS t, a * (x2 + 1) + b * (y2 + 1) + c AS r, d * (x2 + 1) + e * (y2 + 1) + f AS u FROM gt_boxes JOIN headers ON image_id = tile)""", "gt_boxes", "headers"))
def b13_boxes_by_header(spark, d):
    found = grids.boxes_to_map(load(spark, d, "gt_boxes").withColumnRenamed("image_id", "tile"), _headers(spark, d))
    return found.select("gt_id", "tile", "srid", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_PLACED = """SELECT gt_id, tile, z, CAST(floor((a * (y - f) - d * (x - c)) / (a * e - b * d)) AS BIGINT) AS row, CAST(floor((e * (x - c) - b * (y - f)) / (a * e - b * d)) AS BIGINT) AS col, n_rows, n_cols
 FROM raster_points JOIN headers USING (tile)"""


@query(duck(f"SELECT gt_id, tile, row, col, row >= 0 AND row < n_rows AND col >= 0 AND col < n_cols AS inside FROM ({_PLACED})", "raster_points", "headers"))
def b14_points_by_header(spark, d):
    return grids.points_to_pixels(load(spark, d, "raster_points"), _headers(spark, d)).select("gt_id", "tile", "row", "col", "inside")


@query(duck("""SELECT gt_id, tile, CAST(greatest(0, floor(x1 / 90 + 2)) AS BIGINT) AS px1, CAST(greatest(0, floor(y1 / 90 - 1)) AS BIGINT) AS py1, CAST(least(n_cols, ceil(x2 / 90 + 2)) AS BIGINT) AS px2, CAST(least(n_rows, ceil(y2 / 90 - 1)) AS BIGINT) AS py2
 FROM gt_boxes JOIN headers ON image_id = tile""", "gt_boxes", "headers"))
def b16_clip_by_header(spark, d):
    boxes = load(spark, d, "gt_boxes").withColumnRenamed("image_id", "tile").withColumns({c: F.col(c) / 90 for c in ("x1", "y1", "x2", "y2")})
    return grids.clip_boxes(boxes, _headers(spark, d), F.lit(2), F.lit(-1)).select("gt_id", "tile", "px1", "py1", "px2", "py2")


_WINDOWS = """SELECT h.*, row0, col0, row_number() OVER (PARTITION BY tile ORDER BY row0, col0) - 1 AS window_id FROM headers AS h, (SELECT unnest([0, 3]) AS r), (SELECT unnest([0, 3]) AS q),
 LATERAL (SELECT least(r, n_rows - 5) AS row0, least(q, n_cols - 5) AS col0)"""
_CORNERS = ", ".join(f"a * (col0 + {i}) + b * (row0 + {j}) + c AS x{i}{j}, d * (col0 + {i}) + e * (row0 + {j}) + f AS y{i}{j}" for i in (0, 5) for j in (0, 5))
_CHIPS = f"SELECT *, least(x00, x05, x50, x55) AS xmin, least(y00, y05, y50, y55) AS ymin, greatest(x00, x05, x50, x55) AS xmax, greatest(y00, y05, y50, y55) AS ymax FROM (SELECT *, {_CORNERS} FROM ({_WINDOWS}))"
_COL, _ROW = "(e * (m.{x} - c) - b * (m.{y} - f)) / (a * e - b * d)", "(a * (m.{y} - f) - d * (m.{x} - c)) / (a * e - b * d)"
_AT = ", ".join(f"({p.format(x='x' + k, y='y' + k)} - {o}) / 5 AS {n}{k}" for n, p, o in (("u", _COL, "col0"), ("v", _ROW, "row0")) for k in ("min", "max"))


@query(duck(f"""WITH chips AS MATERIALIZED ({_CHIPS}), l AS (SELECT tile, window_id, box_id, {_AT} FROM chips AS w JOIN map_boxes AS m ON m.xmin <= w.xmax + 0.01e0 AND w.xmin - 0.01e0 <= m.xmax AND m.ymin <= w.ymax + 0.01e0 AND w.ymin - 0.01e0 <= m.ymax)
 SELECT tile, CAST(window_id AS INTEGER) AS window_id, box_id, round((umin + umax) / 2, 6) AS xc, round((vmin + vmax) / 2, 6) AS yc, round(abs(umax - umin), 6) AS w, round(abs(vmax - vmin), 6) AS h FROM l WHERE (umin + umax) / 2 BETWEEN 0 AND 1 AND (vmin + vmax) / 2 BETWEEN 0 AND 1""", "headers", "map_boxes"))
def c03_window_labels_by_header(spark, d):
    heads = _headers(spark, d)
    sizes = heads.select("tile", F.col("n_cols").alias("width"), F.col("n_rows").alias("height"))
    found = grids.window_labels(chips.windows(sizes, 5, stride=3), heads, load(spark, d, "map_boxes"), 5, 10.0)
    return found.select("tile", "window_id", "box_id", *[F.round(c, 6).alias(c) for c in ("xc", "yc", "w", "h")])


@query(duck(f"SELECT tile, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, min(z) AS z FROM ({_PLACED}) WHERE row >= 0 AND row < n_rows AND col >= 0 AND col < n_cols GROUP BY tile, row, col", "raster_points", "headers"))
def d01_min_z_by_header(spark, d):
    return grids.grid_min_z(load(spark, d, "raster_points"), _headers(spark, d))


def _filled(spark, d):
    return _values(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))


_MIRROR = "CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} > {n} - 1 THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
_AROUND = f"""v AS MATERIALIZED (SELECT tile, row, col, coalesce(value, 0) AS v, n_rows, n_cols FROM ({_VALID})), near AS (SELECT t.tile, t.row, t.col, i, j, s.v FROM v AS t, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)
 JOIN v AS s ON s.tile = t.tile AND s.row = {_MIRROR.format(i='t.row + i', n='t.n_rows')} AND s.col = {_MIRROR.format(i='t.col + j', n='t.n_cols')})"""
_GAUSS = f"""WITH v AS MATERIALIZED (SELECT tile, row, col, coalesce(value, 0) AS v, n_rows, n_cols FROM ({_VALID})), k AS (SELECT k, exp(-k * k / 4.5e0) / sum(exp(-k * k / 4.5e0)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k)),
 p AS MATERIALIZED (SELECT t.tile, t.row, t.col, t.n_cols, sum(w * s.v) AS v FROM v AS t, k JOIN v AS s ON s.tile = t.tile AND s.col = t.col AND s.row = {_MIRROR.format(i='t.row + k', n='t.n_rows')} GROUP BY t.tile, t.row, t.col, t.n_cols)
 SELECT t.tile, t.row, t.col, round(sum(w * s.v), 6) AS value FROM p AS t, k JOIN p AS s ON s.tile = t.tile AND s.row = t.row AND s.col = {_MIRROR.format(i='t.col + k', n='t.n_cols')} GROUP BY t.tile, t.row, t.col"""


@query(duck(_GAUSS, "heights", "headers"))
def e07_gaussian_by_header(spark, d):
    return rasters.smooth(_filled(spark, d), _headers(spark, d)).withColumn("value", F.round("value", 6))


@query(duck(f"WITH {_AROUND} SELECT tile, row, col, median(v) AS value FROM near GROUP BY tile, row, col", "heights", "headers"))
def e07_median_by_header(spark, d):
    return rasters.smooth(_filled(spark, d), _headers(spark, d), method="median")


@query(duck(f"""WITH {_AROUND} SELECT tile, row, col, round(sqrt((gy * gy + gx * gx) / 2), 6) AS value FROM (SELECT tile, row, col, sum(v * i / 2.0e0 * CASE j WHEN 0 THEN 0.5e0 ELSE 0.25e0 END) AS gy, sum(v * j / 2.0e0 * CASE i WHEN 0 THEN 0.5e0 ELSE 0.25e0 END) AS gx
 FROM near GROUP BY tile, row, col)""", "heights", "headers"))
def e08_sobel_by_header(spark, d):
    return rasters.sobel(_filled(spark, d), _headers(spark, d)).withColumn("value", F.round("value", 6))


@query(duck(f"""WITH m AS (SELECT tile, row, col, coalesce(value >= 2, false) AS on_ FROM ({_VALID})) SELECT p.tile, p.row, p.col, round(sqrt(min(CASE WHEN q.on_ THEN NULL ELSE (p.row - q.row) ** 2 + (p.col - q.col) ** 2 END)), 6) AS distance
 FROM m AS p JOIN m AS q ON p.tile = q.tile GROUP BY p.tile, p.row, p.col""", "heights", "headers"))
def e09_distance_by_header(spark, d):
    mask = _values(spark, d).select("tile", "row", "col", F.coalesce(F.col("value") >= 2.0, F.lit(False)).alias("on"))
    return rasters.distance_to_background(mask).select("tile", "row", "col", F.round("distance", 6).alias("distance"))


#: Source places of the centres of target pixels, the reach of a target pixel, and a tent of that width around them.
_WARP = f"""WITH t AS (SELECT tile, a, b, c, d, e, f, row, col, a * (col + 0.5e0) + b * (row + 0.5e0) + c AS x, d * (col + 0.5e0) + e * (row + 0.5e0) + f AS y FROM (SELECT *, unnest(range(n_cols)) AS col FROM (SELECT *, unnest(range(n_rows)) AS row FROM grids))),
 p AS MATERIALIZED (SELECT t.tile, t.row, t.col, s.n_rows, s.n_cols, (s.e * (x - s.c) - s.b * (y - s.f)) / (s.a * s.e - s.b * s.d) AS u, (s.a * (y - s.f) - s.d * (x - s.c)) / (s.a * s.e - s.b * s.d) AS v,
  greatest(1, sqrt((s.e * t.a - s.b * t.d) ** 2 + (s.e * t.b - s.b * t.e) ** 2) / abs(s.a * s.e - s.b * s.d)) AS rx, greatest(1, sqrt((s.a * t.d - s.d * t.a) ** 2 + (s.a * t.e - s.d * t.b) ** 2) / abs(s.a * s.e - s.b * s.d)) AS ry FROM t JOIN headers AS s USING (tile)),
 w AS (SELECT p.tile, p.row, p.col, h.value, (1 - abs(u - 0.5e0 - h.col) / rx) * (1 - abs(v - 0.5e0 - h.row) / ry) AS w FROM p JOIN ({_VALID}) AS h ON h.tile = p.tile AND abs(u - 0.5e0 - h.col) < rx AND abs(v - 0.5e0 - h.row) < ry
  WHERE h.value IS NOT NULL AND u >= 0 AND u <= p.n_cols AND v >= 0 AND v <= p.n_rows)
 SELECT p.tile, CAST(p.row AS INTEGER) AS row, CAST(p.col AS INTEGER) AS col, round(s.value, 5) AS value FROM p LEFT JOIN (SELECT tile, row, col, sum(w * value) / sum(w) AS value FROM w GROUP BY tile, row, col HAVING sum(w) > 1e-12) AS s ON s.tile = p.tile AND s.row = p.row AND s.col = p.col"""


@query(duck(_WARP, "heights", "headers", "grids"))
def e15_warp(spark, d):
    """Heights on another grid than their own."""
    return grids.warp(_values(spark, d), _headers(spark, d), grids.headers(load(spark, d, "grids"))).withColumn("value", F.round("value", 5))

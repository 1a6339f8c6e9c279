"""Windows, neighbourhoods and iterative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import chips, evaluate, matching, rasters, scoring, segment, spatial
from arbora.plans.queries import query
from arbora.plans.queries_c import _EDGES
from arbora.plans.queries_d import _BOTH, _MATCH
from arbora.plans.standins import duck, load
from arbora.plans.workspace import forget, stored


@query(duck(f"SELECT pred_id, gt_id, round(iou, 6) AS iou FROM ({_MATCH})", *_BOTH))
def e01_greedy_match(spark, d):
    m = matching.greedy_match(load(spark, d, "pred_boxes"), load(spark, d, "gt_boxes"), 0.25, 0.25)
    return m.select("pred_id", "gt_id", F.round("iou", 6).alias("iou"))


def _suppression(source: str, rounds: int) -> str:
    """Rounds of ``suppress`` over ``pairs`` (weak, strong); an error if any pair were left after them."""
    steps = [f"""l{i} AS MATERIALIZED (SELECT DISTINCT weak AS id FROM p{i} WHERE strong NOT IN (SELECT weak FROM p{i})),
 p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} WHERE weak NOT IN (SELECT id FROM l{i}) AND strong NOT IN (SELECT id FROM l{i}))""" for i in range(rounds)]
    gone = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(rounds))
    return f"WITH p0 AS MATERIALIZED ({source}), {', '.join(steps)}, gone AS (SELECT id FROM ({gone}) WHERE CASE WHEN (SELECT count(*) FROM p{rounds}) = 0 THEN true ELSE error('pairs are left') END)"


_PAIRS = f"SELECT CASE WHEN first THEN b ELSE a END AS weak, CASE WHEN first THEN a ELSE b END AS strong FROM (SELECT e.a, e.b, p.conf > q.conf OR p.conf = q.conf AND e.a < e.b AS first FROM ({_EDGES}) AS e JOIN map_boxes AS p ON p.box_id = e.a JOIN map_boxes AS q ON q.box_id = e.b)"


@query(duck(_suppression(_PAIRS, 14) + " SELECT box_id FROM map_boxes WHERE box_id NOT IN (SELECT id FROM gone)", "map_boxes"))
def e02_suppress(spark, d):
    boxes = stored(load(spark, d, "map_boxes").select("box_id", *spatial.BOX, "conf"))  # read several times
    edges = spatial.overlap_pairs(boxes, "box_id", 12.0, 0.3, extra=("conf",))
    kept = matching.suppress(boxes.select("box_id", "conf"), edges, checkpoint=stored)
    forget(boxes)
    return kept.select("box_id")


def _rasters(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("tile"), (F.col("p_size") * 60).cast("int").alias("width"), (F.col("p_partkey") % 40 * 70 + 300).cast("int").alias("height"))


_RASTERS = "SELECT p_partkey AS tile, p_size * 60 AS width, p_partkey % 40 * 70 + 300 AS height FROM part"
_AXIS_I = "CASE WHEN {n} > 640 THEN list_distinct(list_append(range(0, {n} - 640, 512), {n} - 640)) ELSE [0] END"


@query(f"""SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY row0, col0) - 1 AS INTEGER) AS window_id, CAST(row0 AS INTEGER) AS row0, CAST(col0 AS INTEGER) AS col0 FROM (SELECT tile, row0, unnest({_AXIS_I.format(n='width')}) AS col0
 FROM (SELECT tile, width, unnest({_AXIS_I.format(n='height')}) AS row0 FROM ({_RASTERS})))""")
def e03_inference_windows(spark, d):
    return chips.windows(_rasters(spark, d), 640, stride=512, kind="inference")


_AXIS_F = "CASE WHEN {n} > 640 THEN CASE WHEN range(0, {n} - 640, 480)[-1] + 640 < {n} THEN list_append(range(0, {n} - 640, 480), {n} - 640) ELSE range(0, {n} - 640, 480) END ELSE [0] END"
_AXIS_P = "CASE WHEN {n} >= 640 THEN range(0, {n} - 639, 480) ELSE CAST([] AS BIGINT[]) END"


def _chip_sql(axis):
    return f"""SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY row0, col0) - 1 AS INTEGER) AS window_id, CAST(row0 AS INTEGER) AS row0, CAST(col0 AS INTEGER) AS col0 FROM (SELECT tile, row0, unnest({axis.format(n='width')}) AS col0
 FROM (SELECT tile, width, unnest({axis.format(n='height')}) AS row0 FROM ({_RASTERS})))"""


@query(_chip_sql(_AXIS_F))
def e04_chip_windows(spark, d):
    return chips.windows(_rasters(spark, d), 640, overlap=0.25)


@query(_chip_sql(_AXIS_P))
def e04_chip_windows_plain(spark, d):
    return chips.windows(_rasters(spark, d), 640, overlap=0.25, full=False)


@query(duck("""WITH w AS (SELECT tile, row0, col0, row_number() OVER (PARTITION BY tile ORDER BY row0, col0) - 1 AS id FROM (SELECT DISTINCT tile FROM pixels), (SELECT unnest([0, 3]) AS row0), (SELECT unnest([0, 3]) AS col0))
 SELECT w.tile, CAST(id AS INTEGER) AS window_id, b.band, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce(value, 0) AS value FROM w, (SELECT unnest(range(5)) AS r), (SELECT unnest(range(5)) AS c), (SELECT unnest([1, 2, 3, 4, 5]) AS band) AS b
 LEFT JOIN pixels AS p ON p.tile = w.tile AND p.band = b.band AND p.row = row0 + r AND p.col = col0 + c""", "pixels"))
def e04_chip_pixels(spark, d):
    p = load(spark, d, "pixels")
    sizes = p.select("tile").distinct().withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    # Tiles are rasters of five bands (RGBIH), as they are of 8 x 8 pixels, whichever of them have pixels.
    return chips.chip_pixels(chips.windows(sizes, 5, stride=5), p, 5, bands=(1, 2, 3, 4, 5)).select("tile", "window_id", "band", "r", "c", "value")


#: Components by spreading the smallest pixel number; 8 x 8 tiles need few rounds.
def _components(diagonal: bool, source: str, extra: str = "") -> str:
    near = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if diagonal else "abs(a.row - b.row) + abs(a.col - b.col) = 1"
    return f"""WITH RECURSIVE m AS MATERIALIZED ({source}), e AS MATERIALIZED (SELECT a.tile, a.row * 8 + a.col AS p, b.row * 8 + b.col AS q FROM m AS a JOIN m AS b ON a.tile = b.tile AND {near}{extra}),
 r AS (SELECT tile, row * 8 + col AS p, row * 8 + col AS q FROM m UNION SELECT r.tile, r.p, e.q FROM r JOIN e ON e.tile = r.tile AND e.p = r.q), c AS (SELECT tile, p, min(q) AS comp FROM r GROUP BY tile, p)"""


@query(duck(_components(True, "SELECT tile, row, col FROM heights WHERE height >= 5.5e0") + " SELECT tile, CAST(p // 8 AS INTEGER) AS row, CAST(p % 8 AS INTEGER) AS col FROM (SELECT *, count(*) OVER (PARTITION BY tile, comp) AS n FROM c) WHERE n >= 4", "heights"))
def e05_clean_mask(spark, d):
    return segment.clean_mask(load(spark, d, "heights").where("height >= 5.5"), 4, stored)


def _canopy(spark, d):
    return load(spark, d, "heights").withColumn("canopy", F.coalesce(F.col("height") >= 2.0, F.lit(False)))


_H = "SELECT tile, row, col, CASE WHEN height >= 2 THEN height ELSE 0 END AS h, coalesce(height >= 2, false) AS canopy FROM heights"


@query(duck(f"SELECT a.tile, a.row, a.col, a.h AS height FROM ({_H}) AS a JOIN ({_H}) AS b ON a.tile = b.tile AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.canopy AND a.h > 3 GROUP BY a.tile, a.row, a.col, a.h HAVING a.h = max(b.h)", "heights"))
def e06_local_maxima(spark, d):
    return segment.local_maxima(_canopy(spark, d), 1, 3.0)


_TOPS = f"SELECT a.tile, a.row, a.col, a.h FROM ({_H}) AS a JOIN ({_H}) AS b ON a.tile = b.tile AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 WHERE a.canopy AND a.h > 3 GROUP BY a.tile, a.row, a.col, a.h HAVING a.h = max(b.h)"
_PEAKS = f"""SELECT (weak.tile, weak.row, weak.col) AS weak, (strong.tile, strong.row, strong.col) AS strong FROM ({_TOPS}) AS weak JOIN ({_TOPS}) AS strong ON weak.tile = strong.tile AND abs(weak.row - strong.row) <= 2
 AND abs(weak.col - strong.col) <= 2 AND (strong.h > weak.h OR strong.h = weak.h AND (strong.row, strong.col) < (weak.row, weak.col))"""


@query(duck(_suppression(_PEAKS, 10) + f" SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY h DESC, row, col) AS INTEGER) AS marker, row, col, h AS height FROM ({_TOPS}) WHERE (tile, row, col) NOT IN (SELECT id FROM gone)", "heights"))
def e06_height_peaks(spark, d):
    return segment.space_peaks(segment.local_maxima(_canopy(spark, d), 2, 3.0), 2, stored)


def _filled(spark, d):
    return load(spark, d, "heights").select("tile", "row", "col", F.coalesce("height", F.lit(0.0)).alias("value"))


_MIRROR = "CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} > 7 THEN 15 - ({i}) ELSE {i} END"
_NEAR = f"""SELECT t.tile, t.row, t.col, i, j, coalesce(s.height, 0) AS v FROM heights AS t, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) JOIN heights AS s ON s.tile = t.tile AND s.row = {_MIRROR.format(i='t.row + i')} AND s.col = {_MIRROR.format(i='t.col + j')}"""


#: Weights of sigma 1.5 cut at 4 sigma, then a sum along the rows and one along the columns.
_GAUSS = f"""WITH k AS (SELECT k, exp(-k * k / 4.5e0) / sum(exp(-k * k / 4.5e0)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k)),
 a AS (SELECT t.tile, t.row, t.col, sum(w * coalesce(s.height, 0)) AS v FROM heights AS t, k JOIN heights AS s ON s.tile = t.tile AND s.col = t.col AND s.row = {_MIRROR.format(i='t.row + k')} GROUP BY t.tile, t.row, t.col)
 SELECT t.tile, t.row, t.col, round(sum(w * s.v), 6) AS value FROM a AS t, k JOIN a AS s ON s.tile = t.tile AND s.row = t.row AND s.col = {_MIRROR.format(i='t.col + k')} GROUP BY t.tile, t.row, t.col"""


@query(duck(_GAUSS, "heights"))
def e07_smooth_gaussian(spark, d):
    return rasters.smooth(_filled(spark, d), 8, 8, "gaussian").withColumn("value", F.round("value", 6))


@query(duck(f"SELECT tile, row, col, median(v) AS value FROM ({_NEAR}) GROUP BY tile, row, col", "heights"))
def e07_smooth_median(spark, d):
    return rasters.smooth(_filled(spark, d), 8, 8, "median")


@query(duck(f"""SELECT tile, row, col, round(sqrt((gy * gy + gx * gx) / 2), 6) AS value FROM (SELECT tile, row, col, sum(v * i / 2.0e0 * CASE j WHEN 0 THEN 0.5e0 ELSE 0.25e0 END) AS gy, sum(v * j / 2.0e0 * CASE i WHEN 0 THEN 0.5e0 ELSE 0.25e0 END) AS gx
 FROM ({_NEAR}) GROUP BY tile, row, col)""", "heights"))
def e08_sobel(spark, d):
    return rasters.sobel(_filled(spark, d), 8, 8).withColumn("value", F.round("value", 6))


@query(duck("""WITH m AS (SELECT tile, row, col, coalesce(height >= 2, false) AS on_ FROM heights) SELECT a.tile, a.row, a.col, round(sqrt(min(CASE WHEN b.on_ THEN NULL ELSE (a.row - b.row) ** 2 + (a.col - b.col) ** 2 END)), 6) AS distance
 FROM m AS a JOIN m AS b ON a.tile = b.tile GROUP BY a.tile, a.row, a.col""", "heights"))
def e09_distance(spark, d):
    mask = load(spark, d, "heights").select("tile", "row", "col", F.coalesce(F.col("height") >= 2.0, F.lit(False)).alias("on"))
    return rasters.distance_to_background(mask).select("tile", "row", "col", F.round("distance", 6).alias("distance"))


def _crowns(spark, d, fill: bool, gradient: bool = False):
    canopy = _canopy(spark, d)
    peaks = segment.space_peaks(segment.local_maxima(canopy, 2, 3.0), 2, stored).select("tile", "row", "col", "marker")
    if gradient:
        level = rasters.sobel(rasters.smooth(_filled(spark, d), 8, 8), 8, 8).withColumn("level", F.round("value", 9))
    else:
        distance = rasters.distance_to_background(canopy.select("tile", "row", "col", F.col("canopy").alias("on")))
        level = distance.withColumn("level", -F.coalesce("distance", F.lit(0.0)))
    rows = canopy.join(level.select("tile", "row", "col", "level"), ["tile", "row", "col"]).join(peaks, ["tile", "row", "col"], "left")
    return segment.watershed(rows.select("tile", "row", "col", "level", "canopy", "marker"), fill=fill, checkpoint=stored)


@query()
def e10_watershed(spark, d):
    return _crowns(spark, d, False)


@query()
def e10_watershed_gradient(spark, d):
    return _crowns(spark, d, False, True)


@query()
def e11_fill_holes(spark, d):
    return _crowns(spark, d, True)


_LABELLED = "SELECT tile, row, col, CAST(value // 64 AS INTEGER) AS label FROM pixels WHERE band = 5"


@query(duck(_components(False, _LABELLED, " AND a.label = b.label") + """ SELECT c.tile, label, count(*) AS n_pixels, CAST(sum(5 - k) AS BIGINT) AS n_sides, CAST(count(*) AS DOUBLE) AS ring_area FROM c JOIN m ON m.tile = c.tile AND m.row * 8 + m.col = p
 JOIN (SELECT tile, p, count(*) AS k FROM (SELECT tile, p, q FROM e UNION SELECT tile, row * 8 + col, row * 8 + col FROM m) GROUP BY tile, p) AS near ON near.tile = c.tile AND near.p = c.p GROUP BY c.tile, label, comp""", "pixels"))
def e12_outlines(spark, d):
    """With the rings' sides and the area that they enclose, holes taken off."""
    rows = load(spark, d, "pixels").where("band = 5").select("tile", "row", "col", F.floor(F.col("value") / 64).cast("int").alias("label"))
    crowns = segment.outlines(rows, stored)
    sides = F.expr("aggregate(rings, 0L, (n, ring) -> n + size(ring))")
    # Shoelace sums over the rings; outer rings and holes run in opposite directions.
    area = F.expr("""abs(aggregate(rings, 0L, (s, ring) -> s + aggregate(sequence(0, size(ring) - 1), 0L,
        (a, i) -> a + ring[i].x * ring[(i + 1) % size(ring)].y - ring[(i + 1) % size(ring)].x * ring[i].y))) / 2""")
    return crowns.select("tile", "label", "n_pixels", sides.alias("n_sides"), area.alias("ring_area"))


@query(duck("SELECT split, min_by(epoch, (-m, epoch)) AS best_epoch, max(m) AS best_value FROM (SELECT epoch, split, round(avg(value), 6) AS m FROM history GROUP BY epoch, split) WHERE split = 'click' GROUP BY split", "history"))
def e14_best_epoch(spark, d):
    h = load(spark, d, "history").groupBy("epoch", "split").agg(F.round(F.avg("value"), 6).alias("m")).where("split = 'click'")
    return evaluate.best_epoch(h, "m").select(F.lit("click").alias("split"), "best_epoch", "best_value").where("best_epoch is not null")


@query(duck("SELECT epoch, split, max(m) OVER (PARTITION BY split ORDER BY epoch) AS best_so_far FROM (SELECT epoch, split, round(avg(value), 6) AS m FROM history GROUP BY epoch, split)", "history"))
def e14_running_best(spark, d):
    h = load(spark, d, "history").groupBy("epoch", "split").agg(F.round(F.avg("value"), 6).alias("m"))
    return evaluate.running_best(h, "m", ["split"]).select("epoch", "split", "best_so_far")


_BILINEAR = """WITH t AS (SELECT tile, r, c, (r + 0.5e0) / 2 - 0.5e0 AS y, (c + 0.5e0) / 2 - 0.5e0 AS x FROM (SELECT DISTINCT tile FROM heights), (SELECT unnest(range(16)) AS r), (SELECT unnest(range(16)) AS c)),
 n AS (SELECT tile, r, c, least(greatest(floor(y) + i, 0), 7) AS sr, least(greatest(floor(x) + j, 0), 7) AS sc, (1 - abs(y - floor(y) - i)) * (1 - abs(x - floor(x) - j)) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
 SELECT n.tile, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(sum(height * w) / sum(w), 6) AS value FROM n JOIN heights AS h ON h.tile = n.tile AND h.row = sr AND h.col = sc WHERE w > 0 AND height IS NOT NULL GROUP BY n.tile, r, c"""


@query(duck(_BILINEAR, "heights"))
def e15_resample_bilinear(spark, d):
    h = load(spark, d, "heights").withColumnRenamed("height", "value")
    return rasters.resample_bilinear(h, 8, 8, 2.0).withColumn("value", F.round("value", 6))


@query(duck("SELECT tile, band, CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, avg(value) AS value FROM pixels GROUP BY ALL", "pixels"))
def e15_resample_area(spark, d):
    return rasters.resample_area(load(spark, d, "pixels"), 2, ["tile", "band"])


@query(duck("SELECT image_path, row_number() OVER (ORDER BY image_path) - 1 AS image_id FROM image_paths", "image_paths"))
def e16_sequential_ids(spark, d):
    return scoring.numbered(load(spark, d, "image_paths").select("image_path").distinct(), ["image_path"], "image_id")


def _points(spark, d):
    g = load(spark, d, "gt_boxes")
    return g.select(F.floor(F.col("gt_id") / 3.0).alias("point_id"), F.col("image_id").alias("tile"), F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("c"), (F.col("gt_cls") % 2).cast("string")).alias("class_name"), (F.col("x1") % 8).cast("int").alias("col"), (F.col("y1") % 8).cast("int").alias("row"))


_PATCHES = """SELECT point_id, tile, split, class_name, row0, col0 FROM (SELECT *, row_number() OVER (PARTITION BY split, class_name, point_id ORDER BY tile, row0, col0) AS n FROM (SELECT CAST(floor(gt_id / 3.0e0) AS BIGINT) AS point_id, image_id AS tile,
 CASE WHEN image_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, concat('c', gt_cls % 2) AS class_name, CAST(y1 % 8 AS INTEGER) - 2 AS row0, CAST(x1 % 8 AS INTEGER) - 2 AS col0 FROM gt_boxes) WHERE row0 >= 0 AND col0 >= 0 AND row0 <= 4 AND col0 <= 4) WHERE n = 1"""


def _patches(spark, d):
    sizes = load(spark, d, "pixels").select("tile").distinct().withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    return chips.patches(_points(spark, d).join(sizes.select("tile"), "tile"), sizes, 4)


@query(duck(_PATCHES.replace("FROM gt_boxes)", "FROM gt_boxes WHERE image_id IN (SELECT tile FROM pixels))"), "gt_boxes", "pixels"))
def e17_patches(spark, d):
    return _patches(spark, d).select("point_id", "tile", "split", "class_name", "row0", "col0")


@query(duck("""SELECT p.point_id, p.tile, x.band, sum(x.value) :: BIGINT AS total, count(*) AS n FROM (SELECT DISTINCT point_id, tile, row0, col0 FROM (""" + _PATCHES.replace("FROM gt_boxes)", "FROM gt_boxes WHERE image_id IN (SELECT tile FROM pixels))") + """) WHERE split = 'val' AND class_name = 'c0') AS p JOIN pixels AS x ON x.tile = p.tile
 AND x.row >= row0 AND x.row < row0 + 4 AND x.col >= col0 AND x.col < col0 + 4 GROUP BY p.point_id, p.tile, x.band""", "gt_boxes", "pixels"))
def e17_patch_chips(spark, d):
    wanted = _patches(spark, d).where("split = 'val' and class_name = 'c0'")
    c = chips.patch_chips(wanted, load(spark, d, "pixels"), 4)
    return c.select("point_id", "tile", "band", F.expr("aggregate(chip, 0L, (s, v) -> s + v)").alias("total"), F.size("chip").cast("bigint").alias("n"))

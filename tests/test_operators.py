"""Edge cases, properties and brute-force comparisons of the operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arbora.functions import geo, ids, labels, losses, raster
from arbora.operators import chips, evaluate, flood, matching, rasters, scoring, segment, spatial, splits
from arbora.plans.workspace import stored
from arbora.sources import scans, sinks


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def values(df):
    return [tuple(r) for r in df.collect()]


# --- scans ---------------------------------------------------------------------------------------------------------


def test_xyz_skips_bad_lines(spark):
    got = values(scans.xyz_points(lines(spark, "1 2 3", "1 2", "a 2 3", "1 2 nan", "", " 4  5 6 ", "1 2 3 4")))
    assert sorted(got) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    with pytest.raises(ValueError):
        scans.not_empty(scans.xyz_points(lines(spark, "x y z")), "points")


def test_label_lines(spark):
    src = lines(spark, "1 0.5 0.5 0.1 0.2", "1 0.5 0.5 0.1", "1 0.5 0.5 0.1 0.2 0.9", "t a b c d", "  ")
    assert values(scans.label_lines(src)) == [(1, 0.5, 0.5, 0.1, 0.2)]
    with pytest.raises(PySparkException):
        scans.label_lines(src, strict=True).collect()


def test_sidecars(spark):
    src = lines(spark, '{"tile": 1, "height_channel": {"stats_m": [0.5, 9.0]}}', '{"tile": 2, "height_channel": {"stats_m": [0.5]}}', '{"tile": 3, "raw_height_stats": {"min": 1, "max": 2}}')
    assert sorted(values(scans.sidecar_ranges(src)), key=lambda r: r[0]) == [(1, 0.5, 9.0, 5, 1), (2, None, None, 5, None), (3, 1.0, 2.0, 5, 2)]


def test_class_table_headers(spark):
    df = spark.createDataFrame([(1, "a")], "FID int, Genus string")
    assert values(scans.class_table(df)) == [(1, "a")]
    with pytest.raises(ValueError):
        scans.class_table(spark.createDataFrame([(1,)], "x int"))


def test_tile_grid_errors(spark):
    with pytest.raises(ValueError):
        scans.tile_grid(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        scans.tile_grid(spark.createDataFrame([], "tile_id string"))


def test_tabular_columns():
    assert scans.tabular_columns(["m02", "x", "canopyHeig", "M01", "canopyWidt", "m13"]) == ["canopyHeig", "canopyWidt", "M01", "m02"]


def test_tile_ids(spark):
    df = spark.createDataFrame([("355-6048",), ("355_6048",), (" 32_355_6048 ",), ("355",), (None,), ("a-b-c",)], "s string")
    got = [r[0] for r in df.select(ids.normalize_tile_id(F.col("s"))).collect()]
    assert got == ["32_355_6048"] * 3 + [None] * 3
    with pytest.raises(PySparkException):
        df.select(ids.normalize_tile_id(F.col("s"), strict=True)).collect()


def test_product_pick_and_manifest(spark):
    with pytest.raises(ValueError):
        sinks.manifest(spark.createDataFrame([("32_1_2",)], "tile_id string"), "XYZ", "u")
    got = values(sinks.manifest(spark.createDataFrame([("32_1_2",)], "tile_id string"), "rgb", "u").select("file_name", "url"))
    assert got == [("dop20rgb_32_1_2_2_bw.zip", "u/dop20/dop20rgb_32_1_2_2_bw.zip")]


# --- labels and geometry -------------------------------------------------------------------------------------------


def test_missing_group_class(spark):
    trees = spark.createDataFrame([("Acer",)], "genus string")
    with pytest.raises(ValueError):
        labels.assign_classes(trees, spark.createDataFrame([(0, "Acer")], "class_id int, class_name string"))


def test_class_table_names(spark):
    """Names of the table are stripped as those of the trees are; of a name that stands twice the last row counts."""
    table = spark.createDataFrame([(7, "Acer"), (1, " Coniferous "), (2, "Other Deciduous"), (3, "Acer\t"), (0, "Tilia")], "class_id int, class_name string")
    trees = spark.createDataFrame([(" Acer",), ("Pinus",), ("Malus",), ("Tilia ",)], "genus string")
    assert sorted((r["genus"], r["training_class"]) for r in labels.assign_classes(trees, table).collect()) == [("Acer", 3), ("Malus", 2), ("Pinus", 1), ("Tilia", 0)]


def test_boxes_need_a_metric_system(spark):
    df = spark.createDataFrame([("2", 0.0, 0.0), ("0", 0.0, 0.0), ("-1", 0.0, 0.0), ("x", 0.0, 0.0), (None, 0.0, 0.0)], "canopyWidt string, x double, y double")
    assert values(labels.canopy_boxes(df).select("xmin", "ymin", "xmax", "ymax")) == [(-1.0, -1.0, 1.0, 1.0)]
    for srid in (None, 4326):
        with pytest.raises(ValueError):
            labels.canopy_boxes(df, srid=srid)


def test_crs(spark):
    df = spark.createDataFrame([(9.0, 48.0), (8.4, 49.0)], "x double, y double")
    (x0, y0), (x1, y1) = values(geo.align_crs(df, 4326, 25832).select("x", "y"))
    # On the central meridian the easting is 500 km, and the northing is the meridian's arc times the scale.
    assert abs(x0 - 500000) < 1e-6 and abs(y0 - 5316300.482) < 2.0
    assert abs(x1 - 456115.0) < 100 and y1 > y0
    with pytest.raises(ValueError):
        geo.align_crs(df, None, 25832)
    with pytest.raises(ValueError):
        geo.align_crs(df, 3857, 25832)


def test_affine_round_trip(spark):
    t = (0.2, 0.0, 355000.0, 0.0, -0.2, 6050000.0)
    df = spark.range(50).select((F.col("id") * 7).alias("c"), (F.col("id") * 3).alias("r"))
    x, y = geo.pixel_to_map(t, F.col("c"), F.col("r"))
    c, r = geo.map_to_pixel(t, F.col("x"), F.col("y"))
    assert all(abs(a) < 1e-6 and abs(b) < 1e-6 for a, b in values(df.select("*", x.alias("x"), y.alias("y")).select(c - F.col("c"), r - F.col("r"))))


def test_height_scaling_round_trip(spark):
    df = spark.createDataFrame([(float(h), 1.0, 31.0) for h in range(1, 32)] + [(None, 1.0, 31.0), (5.0, 5.0, 5.0)], "h double, lo double, hi double")
    u8 = raster.height_to_u8(F.col("h"), F.col("lo"), F.col("hi"))
    rows = values(df.withColumn("u", u8).withColumn("m", raster.u8_to_height(F.col("u"), F.col("lo"), F.col("hi"))))
    assert all(abs(h - m) <= 30 / 255 + 1e-9 for h, lo, hi, u, m in rows if h is not None and hi > lo)
    assert rows[-2][3:] == (None, None) and rows[-1][3:] == (0, 0.0)


# --- spatial joins -------------------------------------------------------------------------------------------------


def random_boxes(n, seed, span=60.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, span), rng.uniform(0, span)
        out.append((i, x, y, x + rng.uniform(0, 9), y + rng.uniform(0, 9)))
    return out


BOX_SCHEMA = "id int, xmin double, ymin double, xmax double, ymax double"


@pytest.mark.parametrize("cell", [3.0, 10.0, 200.0])
def test_box_join_equals_all_pairs(spark, cell):
    a, b = random_boxes(60, 1), random_boxes(60, 2)
    right = spark.createDataFrame(b, BOX_SCHEMA).select(F.col("id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    got = sorted(values(spatial.box_join(spark.createDataFrame(a, BOX_SCHEMA), right, cell).select("id", "b")))
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    assert got == sorted((p[0], q[0]) for p in a for q in b if meet(p, q))


def test_points_on_edges_match_nothing(spark):
    tiles = spark.createDataFrame([("t", 0.0, 0.0, 1000.0, 1000.0), ("u", 1000.0, 0.0, 2000.0, 1000.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double")
    points = spark.createDataFrame([(1, 500.0, 500.0), (2, 1000.0, 500.0), (3, 5000.0, 5.0)], "id int, x double, y double")
    assert sorted(values(spatial.points_in_tiles(points, tiles).select("id", "tile_id"))) == [(1, "t"), (2, None), (3, None)]


# --- matching ------------------------------------------------------------------------------------------------------


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return w * h / (area(p) + area(q) - w * h)


def test_greedy_match_equals_the_loop(spark):
    rng = random.Random(4)
    pred = [(i % 5, i, 0, *b[1:], round(rng.random(), 2)) for i, b in enumerate(random_boxes(120, 5, 30))]
    truth = [(i % 5, i, 0, *b[1:]) for i, b in enumerate(random_boxes(80, 6, 30))]
    p = spark.createDataFrame(pred, "image_id int, pred_id int, pred_cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    g = spark.createDataFrame(truth, "image_id int, gt_id int, gt_cls int, x1 double, y1 double, x2 double, y2 double")
    got = sorted(values(matching.greedy_match(p, g, 0.2).select("pred_id", "gt_id")))
    want = []
    for image in range(5):
        used = set()
        for a in sorted((a for a in pred if a[0] == image), key=lambda a: (-a[7], a[1])):
            best = max(((iou(a[3:7], t[3:7]), -t[1]) for t in truth if t[0] == image), default=(0, 0))
            if best[0] >= 0.2 and -best[1] not in used:
                used.add(-best[1])
                want.append((a[1], -best[1]))
    assert got == sorted(want)
    counts = matching.match_counts(p, g, matching.greedy_match(p, g, 0.2)).first()
    assert tuple(counts) == (len(want), len(pred) - len(want), len(truth) - len(want))
    cells = matching.detection_confusion(p, g, matching.greedy_match(p, g, 0.2), 2)
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == counts["tp"] + counts["fp"] + counts["fn"]


def test_match_without_predictions(spark):
    p = spark.createDataFrame([], "image_id int, pred_id int, pred_cls int, x1 double, y1 double, x2 double, y2 double, conf double")
    g = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 1.0, 1.0)], "image_id int, gt_id int, gt_cls int, x1 double, y1 double, x2 double, y2 double")
    scores = matching.precision_recall(matching.match_counts(p, g, matching.greedy_match(p, g))).first()
    assert (scores["tp"], scores["fp"], scores["fn"], scores["f1"]) == (0, 0, 1, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    boxes = [(*b, round(rng.random(), 1)) for b in random_boxes(150, seed, 35)]
    df = spark.createDataFrame(boxes, BOX_SCHEMA + ", conf double").withColumnRenamed("id", "box_id")
    edges = spatial.overlap_pairs(df, "box_id", 8.0, 0.2)
    got = sorted(r[0] for r in matching.suppress(df, edges, checkpoint=stored).select("box_id").collect())
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(b[1:5], k[1:5]) <= 0.2 for k in kept):
            kept.append(b)
    assert got == sorted(b[0] for b in kept)


# --- rasters and crowns --------------------------------------------------------------------------------------------


def pixels(spark, array, tile=1, name="value"):
    return spark.createDataFrame([(tile, r, c, float(v)) for r, row in enumerate(array) for c, v in enumerate(row)], f"tile bigint, row int, col int, {name} double")


def grown(mask, diagonal):
    """Components of a mask by a stack."""
    seen, found = set(), []
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        stack, part = [start], []
        while stack:
            r, c = stack.pop()
            if (r, c) in seen:
                continue
            seen.add((r, c))
            part.append((int(r), int(c)))
            for y in (-1, 0, 1):
                for x in (-1, 0, 1):
                    if (diagonal or not (x and y)) and 0 <= r + y < mask.shape[0] and 0 <= c + x < mask.shape[1] and mask[r + y, c + x]:
                        stack.append((r + y, c + x))
        found.append(part)
    return found


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_equal_the_stack(spark, diagonal):
    mask = np.random.default_rng(3).random((14, 14)) < 0.45
    df = pixels(spark, mask).where("value > 0").drop("value")
    got = {}
    for r in segment.label_components(df, diagonal, checkpoint=stored).collect():
        got.setdefault(r["comp"], set()).add((r["row"], r["col"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, grown(mask, diagonal)))


def test_clean_mask_drops_small_parts(spark):
    mask = np.zeros((6, 6))
    mask[0, :3] = 1
    mask[5, 5] = 1
    df = pixels(spark, mask).where("value > 0").drop("value")
    assert sorted(values(segment.clean_mask(df, 3, stored).select("row", "col"))) == [(0, 0), (0, 1), (0, 2)]
    assert segment.clean_mask(df, 1).count() == 4


def test_outline_of_a_ring(spark):
    mask = np.ones((3, 3))
    mask[1, 1] = 0
    df = pixels(spark, mask).where("value > 0").select("tile", "row", "col", F.lit(1).alias("label"))
    row = segment.outlines(df, stored).first()
    assert row["n_pixels"] == 8 and [len(r) for r in row["rings"]] == [12, 4]


def test_outline_of_diagonal_contact_is_two_parts(spark):
    df = pixels(spark, np.eye(2)).where("value > 0").select("tile", "row", "col", F.lit(1).alias("label"))
    assert segment.outlines(df, stored).count() == 2


def test_watershed_splits_two_hills(spark):
    level = -np.array([[1, 3, 1, 3, 1]] * 3, float)
    marker = np.zeros((3, 5))
    marker[1, 1], marker[1, 3] = 1, 2
    df = pixels(spark, level, name="level").join(pixels(spark, marker, name="marker"), ["tile", "row", "col"]).withColumn("canopy", F.lit(True))
    got = {(r["row"], r["col"]): r["label"] for r in segment.watershed(df).collect()}
    assert len(got) == 15 and got[0, 0] == 1 and got[2, 4] == 2
    assert segment.watershed(df.withColumn("marker", F.lit(0.0))).count() == 0
    assert segment.watershed(df.where("col < 2"), min_pixels=10).count() == 0


def brute_filled(labels):
    """Each label's holes by a flood from outside, one pixel at a time, on the labels as they came."""
    n, m = labels.shape
    out = labels.copy()
    for label in sorted(set(labels.ravel().tolist()) - {0}):
        seen, stack = set(), [(r, c) for r in range(-1, n + 1) for c in (-1, m)] + [(r, c) for r in (-1, n) for c in range(-1, m + 1)]
        while stack:
            r, c = stack.pop()
            if (r, c) in seen or not (-1 <= r <= n and -1 <= c <= m) or (0 <= r < n and 0 <= c < m and labels[r, c] == label):
                continue
            seen.add((r, c))
            stack += [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
        for r in range(n):
            for c in range(m):
                if (r, c) not in seen:
                    out[r, c] = label
    return out


def test_fill_holes_keeps_nested_crowns(spark):
    nested = np.ones((5, 5), int)
    nested[2, 2] = 2
    ring = np.ones((300, 300), int)
    ring[5:-5, 5:-5] = 0
    rng = np.random.default_rng(3)
    tiles = [nested, ring]
    for k in range(60):
        tiles.append(rng.integers(0, 4, (rng.integers(1, 12), rng.integers(1, 12))) if k % 2 else np.repeat(np.repeat(rng.integers(0, 3, (4, 5)), 3, 0), 2, 1))
    rows = [(t, r, c, int(v)) for t, a in enumerate(tiles) for r, line in enumerate(a) for c, v in enumerate(line) if v]
    got = [np.zeros_like(a) for a in tiles]
    for t, r, c, v in values(segment.fill_holes(spark.createDataFrame(rows, "tile bigint, row int, col int, label int")).select("tile", "row", "col", "label")):
        got[t][r, c] = v
    assert (got[0] == nested).all() and (got[1] == 1).all()
    for found, a in zip(got[2:], tiles[2:]):
        assert (found == brute_filled(a)).all()


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("side", [1, 3, 5])
def test_components_across_blocks(spark, monkeypatch, diagonal, side):
    monkeypatch.setattr(segment, "BLOCK", side)
    mask = np.random.default_rng(side).random((13, 17)) < (0.42 if diagonal else 0.6)
    df = pixels(spark, mask).where("value > 0").drop("value")
    got = {}
    for r in segment.label_components(df, diagonal, checkpoint=stored).collect():
        got.setdefault(r["comp"], []).append((r["row"], r["col"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, grown(mask, diagonal)))
    assert all(k == min(v)[0] << 32 | min(v)[1] for k, v in got.items())


def test_components_of_equal_value_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(segment, "BLOCK", 4)
    kinds = np.random.default_rng(8).integers(0, 2, (11, 11))
    df = pixels(spark, kinds, name="kind")
    got = {}
    for r in segment.label_components(df, False, equal="kind", checkpoint=stored).collect():
        got.setdefault(r["comp"], set()).add((r["row"], r["col"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, grown(kinds == 0, False) + grown(kinds == 1, False)))


def brute_flood(levels, markers, mask):
    """The flood as stated: of all open pixels the one of lowest level goes next, then smallest marker, row and column."""
    labels, open_ = {}, []
    for r, c in zip(*np.nonzero(mask)):
        if markers[r, c]:
            labels[r, c] = markers[r, c]
            open_.append((levels[r, c], markers[r, c], r, c))
    while open_:
        at = min(open_)
        open_.remove(at)
        level, label, r, c = at
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and (y, x) not in labels:
                labels[y, x] = label
                open_.append((max(level, levels[y, x]), label, y, x))
    return {(int(r), int(c)): int(v) for (r, c), v in labels.items()}


@pytest.mark.parametrize("seed", range(4))
def test_watershed_equals_the_stated_flood(spark, monkeypatch, seed):
    monkeypatch.setattr(flood, "BLOCK", 5)
    rng = np.random.default_rng(seed)
    mask, level = rng.random((14, 19)) < 0.7, rng.integers(0, 3 + seed, (14, 19)).astype(float)
    marker = np.where(rng.random((14, 19)) < 0.06, rng.permutation(14 * 19).reshape(14, 19) + 1, 0)
    df = pixels(spark, level, name="level").join(pixels(spark, marker, name="marker"), ["tile", "row", "col"])
    df = df.join(pixels(spark, mask, name="on"), ["tile", "row", "col"]).withColumn("canopy", F.col("on") > 0)
    got = {(r["row"], r["col"]): r["label"] for r in segment.watershed(df, fill=False, checkpoint=stored).collect()}
    assert got == brute_flood(level, marker, mask)


def mirrored(i, n):
    k = i % (2 * n)
    return 2 * n - 1 - k if k >= n else k


@pytest.mark.parametrize("shape", [(1, 1), (3, 20), (9, 7), (17, 16)])
def test_filters_equal_the_plain_sums(spark, monkeypatch, shape):
    """Blocks of 8 with their margins against sums over mirrored places; a tenth of the pixels is unknown, some are absent."""
    monkeypatch.setattr(rasters, "BLOCK", 8)
    rng = np.random.default_rng(shape[1])
    v = rng.normal(size=shape)
    v[rng.random(shape) < 0.1] = np.nan
    df = pixels(spark, v).where("not (row = 2 and col = 3)")
    if v.shape[0] > 2:
        v[2, 3] = np.nan
    n, m = shape

    def brute(weight, reach, median=False):
        out = {}
        for r in range(n):
            for c in range(m):
                if (r, c) == (2, 3):
                    continue
                near = [(weight(i, j), v[mirrored(r + i, n), mirrored(c + j, m)]) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
                near = [(w, x) for w, x in near if not np.isnan(x)]
                out[r, c] = None if not near else float(np.median([x for _, x in near])) if median else sum(w * x for w, x in near)
        return out

    def same(df, wanted):
        got = {(r["row"], r["col"]): r["value"] for r in df.collect()}
        assert set(got) == set(wanted)
        for at, x in wanted.items():
            assert (got[at] is None) == (x is None) and (x is None or abs(got[at] - x) < 1e-9)

    norm = sum(np.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7))
    same(rasters.smooth_gaussian(df, n, m), brute(lambda i, j: np.exp(-0.5 * (i * i + j * j) / 2.25) / norm**2, 6))
    same(rasters.smooth_median(df, n, m), brute(lambda i, j: 1, 1, True))
    smooth = (0.25, 0.5, 0.25)
    a, b = brute(lambda i, j: i / 2 * smooth[j + 1], 1), brute(lambda i, j: j / 2 * smooth[i + 1], 1)
    same(rasters.sobel(df, n, m), {k: None if a[k] is None else ((a[k] ** 2 + b[k] ** 2) / 2) ** 0.5 for k in a})


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_distance_equals_the_nearest_of_all(spark, monkeypatch, share):
    monkeypatch.setattr(rasters, "STRIPE", 4)
    off = np.random.default_rng(2).random((23, 19)) < share
    df = pixels(spark, ~off).withColumn("on", F.col("value") > 0).drop("value")
    ys, xs = np.nonzero(off)
    for r in rasters.distance_to_background(df).collect():
        wanted = None if not len(ys) else float(np.sqrt(((ys - r["row"]) ** 2 + (xs - r["col"]) ** 2).min()))
        assert r["distance"] == wanted


def test_peaks_keep_their_distance(spark):
    h = np.array([[5, 1, 5, 0, 0, 9]] * 1, float)
    df = pixels(spark, h, name="height").withColumn("canopy", F.lit(True))
    got = values(segment.space_peaks(segment.local_maxima(df, 2), 2, stored).select("marker", "row", "col"))
    assert sorted(got) == [(1, 0, 5), (2, 0, 0)]


def test_gaussian_keeps_a_constant_and_the_mean(spark):
    flat = rasters.smooth_gaussian(pixels(spark, np.full((6, 6), 3.0)), 6, 6)
    assert all(abs(r["value"] - 3) < 1e-9 for r in flat.collect())
    spot = np.zeros((6, 6))
    spot[2, 3] = 36.0
    assert abs(rasters.smooth_gaussian(pixels(spark, spot), 6, 6).agg(F.avg("value")).first()[0] - 1) < 1e-9


def test_flat_tile_has_no_range(spark):
    df = pixels(spark, np.full((2, 2), 4.0), name="height")
    assert values(rasters.height_range(df)) == [(1, 0.0, 0.0)]
    none = df.withColumn("height", F.lit(None).cast("double"))
    assert values(rasters.height_range(none)) == [(1, None, None)]


def test_small_rasters_have_one_window(spark):
    df = spark.createDataFrame([(1, 300, 300), (2, 640, 640)], "tile int, width int, height int")
    for kind in ("chips", "inference"):
        assert chips.windows(df, 640, kind=kind).count() == 2
    assert chips.windows(df, 640, full=False).count() == 1


def test_six_places(spark):
    rng = random.Random(8)
    xs = [rng.random() * 2 for _ in range(500)] + [k / 640 for k in range(641)] + [0.0, 0.0000005, 7.9999999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(chips.six_places(F.col("x"))).collect()]
    assert got == [f"{x:.6f}" for x in xs]


def test_labels_round_trip(spark):
    df = spark.createDataFrame([(1, 0.25, 0.5, 0.1, 0.2)], "cls int, xc double, yc double, w double, h double")
    box = df.select(*[c.alias(n) for n, c in chips.label_to_pixels(100, 200).items()]).first()
    assert [round(box[c], 9) for c in ("x1", "y1", "x2", "y2")] == [20.0, 80.0, 30.0, 120.0]


# --- splits --------------------------------------------------------------------------------------------------------


def test_list_splits(spark):
    tiles = spark.createDataFrame([(f"t{k}",) for k in range(6)], "tile_id string")
    one, two = tiles.where("tile_id < 't2'"), tiles.where("tile_id < 't3'")
    assert sorted(values(splits.split_by_lists(tiles, val=one)))[:3] == [("t0", "val"), ("t1", "val"), ("t2", "train")]
    assert splits.split_by_lists(tiles, train=one).where("split = 'val'").count() == 4
    with pytest.raises(ValueError):
        splits.split_by_lists(tiles, one, two)
    with pytest.raises(ValueError):
        splits.split_by_lists(tiles, val=spark.createDataFrame([("x",)], "tile_id string"))


def test_random_splits_have_exact_sizes(spark):
    tiles = spark.createDataFrame([(f"t{k}",) for k in range(25)], "tile_id string")
    a = splits.split_random(tiles, 0.1, 3)
    assert a.where("split = 'val'").count() == 2 and a.count() == 25  # 2.5 rounds to even
    assert sorted(values(a)) == sorted(values(splits.split_random(tiles.repartition(7), 0.1, 3)))


def test_stratified_split(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "id int, c string")
    got = splits.split_stratified(rows, "id", "c", 0.2).groupBy("c").agg(F.count_if(F.col("split") == "val").alias("n"))
    assert sorted(values(got)) == [("a", 2), ("b", 2)]
    lone = rows.union(spark.createDataFrame([(99, "z")], "id int, c string"))
    assert splits.split_stratified(lone, "id", "c", 0.2).where("split = 'val'").count() == 4


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(k, "a" if k else "b") for k in range(50)], "id int, c string")
    counts = dict(values(splits.balanced_sample(rows, "c", 1000, seed=1).groupBy("c").count()))
    assert sum(counts.values()) == 1000 and 400 < counts["b"] < 600


# --- metrics -------------------------------------------------------------------------------------------------------


def test_losses(spark):
    z, y = [2.0, -1.0, 0.5], 0
    df = spark.createDataFrame([(z, y)], "logits array<double>, y int")
    logp = np.array(z) - np.log(np.exp(z).sum())
    assert abs(df.select(losses.cross_entropy(F.col("logits"), F.col("y"))["loss"]).first()[0] + logp[0]) < 1e-12
    assert abs(df.select(losses.focal_loss(F.col("logits"), F.col("y"), 2.0, 7.0)).first()[0] + (1 - np.exp(logp[0])) ** 2 * logp[0]) < 1e-12
    assert df.select(losses.hit_at(F.col("logits"), F.lit(2), 1), losses.hit_at(F.col("logits"), F.lit(2), 2)).first()[:] == (False, True)


def test_class_weights_modes(spark):
    y = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    w = dict(values(evaluate.class_weights(y, 3)))
    assert abs(sum(w.values()) / 3 - 1) < 1e-12 and abs(w[1] / w[0] - 2) < 1e-12 and w[1] == w[2]
    assert set(dict(values(evaluate.class_weights(y, 3, "none"))).values()) == {None}
    assert set(dict(values(evaluate.class_weights(y, 3, "scalar", 0.5))).values()) == {0.5}


def test_average_precision(spark):
    box = "x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 0.0, 0.0, 40.0, 40.0)], f"image_id bigint, cls int, gt_id bigint, {box}")
    exact = truth.select("image_id", "cls", F.col("gt_id").alias("det_id"), F.lit(0.9).alias("score"), "x1", "y1", "x2", "y2")
    got = dict(values(evaluate.average_precision(exact, truth)))
    assert got["AP"] == 1.0 and got["AR100"] == 1.0 and got["AP_small"] == 1.0 and got["AP_large"] is None
    # One true and, before it, one false detection: precision 1/2 at all recall points up to 1/2.
    false = exact.limit(1).withColumns({"score": F.lit(0.95), "det_id": F.lit(9).cast("bigint"), "x1": F.lit(500.0), "x2": F.lit(510.0)})
    worse = evaluate.average_precision(exact.where("image_id = 0").unionByName(false), truth)
    assert abs(dict(values(worse))["AP50"] - 51 * 0.5 / 101) < 1e-9
    none = dict(values(evaluate.average_precision(exact.limit(0), truth)))
    assert len(none) == 12 and set(none.values()) == {None}


def test_imputation_from_train(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (None, "val"), (float("nan"), "train")], "v double, s string")
    assert sorted(r["v"] for r in evaluate.impute_median(df, ["v"], "s", "train").collect()) == [1.0, 2.0, 2.0, 3.0]


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("k"))
    for parts in (1, 7):
        assert all(k == n for k, n in values(scoring.numbered(df.repartition(parts), ["k"], "n").select("k", "n")))


def test_augmentation_keeps_pixels(spark):
    chip = pixels(spark, np.arange(16).reshape(4, 4)).withColumn("band", F.lit(1))
    out = raster.augment_geometry(chip, 4, "tile", seed=5)
    assert out.count() == 16
    light = raster.augment_light(raster.scale_to_unit(chip, "uint8", ["tile"]), "tile", seed=2)
    assert light.where("value < 0 or value > 1").count() == 0


def brute_precision(dets, truths, cls, low, high, limit):
    """AP of one class, area range and threshold by the loop over falling score and the 101 points of the interpolated curve."""
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (size(a) + size(b) - inter) if inter else 0.0

    judged = []
    for image in {d[0] for d in dets}:
        mine = sorted([d for d in dets if d[0] == image and d[1] == cls], key=lambda d: (-d[3], d[2]))[:100]
        real = [t for t in truths if t[0] == image and t[1] == cls]
        used = set()
        for place, d in enumerate(mine):
            ways = [(low <= size(t[3:]) <= high, over(d[4:], t[3:]), j) for j, t in enumerate(real) if j not in used and over(d[4:], t[3:]) >= limit]
            if ways:
                counts, _, j = max(ways)
                used.add(j)
                if counts:
                    judged.append((-d[3], image, place, 1))
            elif low <= size(d[4:]) <= high:
                judged.append((-d[3], image, place, 0))
    n = sum(1 for t in truths if t[1] == cls and low <= size(t[3:]) <= high)
    if not n:
        return None
    tp, curve = 0, []
    for k, (*_, hit) in enumerate(sorted(judged), 1):
        tp += hit
        curve.append((tp / n, tp / k))
    return sum(max((p for r, p in curve if r * 100 + 1e-9 >= point), default=0.0) for point in range(101)) / 101


def test_average_precision_equals_the_loop(spark):
    rng = random.Random(5)
    box = lambda s: (x := rng.uniform(0, 200), y := rng.uniform(0, 200), x + s, y + s)
    truths = [(i, c, 100 * i + 10 * c + k, *box(rng.choice([10, 20, 50, 120]))) for i in range(12) for c in range(2) for k in range(5)]
    dets = []
    for k, t in enumerate(truths):
        for j in range(rng.choice([0, 1, 2])):
            dets.append((t[0], t[1], 2 * k + j, round(rng.random(), 1), *[v + rng.uniform(-3, 3) for v in t[3:]]))
    dets += [(rng.randrange(12), rng.randrange(2), 1000 + k, round(rng.random(), 1), *box(rng.choice([8, 40]))) for k in range(60)]
    d = spark.createDataFrame(dets, "image_id bigint, cls int, det_id bigint, score double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truths, "image_id bigint, cls int, gt_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = dict(values(evaluate.average_precision(d, t)))

    def mean(area, ious):
        found = [brute_precision(dets, truths, c, *evaluate.AREAS[area], v) for c in range(2) for v in ious]
        found = [v for v in found if v is not None]
        return sum(found) / len(found) if found else None

    wanted = {"AP": mean("all", evaluate.IOUS), "AP50": mean("all", [0.5]), "AP75": mean("all", [0.75]), **{f"AP_{a}": mean(a, evaluate.IOUS) for a in ("small", "medium", "large")}}
    for name, v in wanted.items():
        assert abs(got[name] - v) < 1e-9, name


def test_medians_by_rank(spark):
    rows = [("a", 3.0, None), ("a", 1.0, 5.0), ("a", None, float("nan")), ("a", 2.0, 6.0), ("b", None, None), ("b", 4.0, None), (None, None, 7.0), (None, 8.0, None)]
    df = spark.createDataFrame(rows, "s string, v double, w double")
    got = values(evaluate.impute_median(df, ["v", "w"], "s"))
    assert sorted(map(str, got)) == sorted(map(str, [("a", 3.0, 5.5), ("a", 1.0, 5.0), ("a", 2.0, 5.5), ("a", 2.0, 6.0), ("b", 4.0, None), ("b", 4.0, None), (None, 8.0, 7.0), (None, 8.0, 7.0)]))
    assert {r["v"] for r in evaluate.impute_median(df.where("v is null"), ["v"]).collect()} == {None}


def test_boxes_of_all_sizes_and_many_in_one_cell(spark):
    """From 1 m to 100 km in one join, and 100,000 boxes of a metre in what is one cell of the unit given."""
    rng = random.Random(9)
    box = lambda i, s: (i, x := rng.uniform(0, 100_000), y := rng.uniform(0, 100_000), x + s, y + s)
    a = [box(i, rng.choice([0, 1, 1, 30, 1_000, 30_000, 100_000])) for i in range(150)]
    b = [box(i, rng.choice([1, 5, 700, 20_000, 100_000])) for i in range(150)]
    right = lambda df: df.select(F.col("id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    got = sorted(values(spatial.box_join(spark.createDataFrame(a, BOX_SCHEMA), right(spark.createDataFrame(b, BOX_SCHEMA)), 100.0).select("id", "b")))
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    grid = spark.range(100_000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 400 * 2.0).alias("xmin"), (F.floor(F.col("id") / 400) * 2.0).alias("ymin")).withColumns({"xmax": F.col("xmin") + 1, "ymax": F.col("ymin") + 1})
    pairs = spatial.box_join(grid, right(grid), 1000.0, same=True)
    assert pairs.where("id = b").count() == 100_000 == pairs.count()
    large = spark.createDataFrame([(1, -5.0, -5.0, 5_000.0, 5_000.0)], BOX_SCHEMA)
    assert spatial.box_join(grid, right(large), 1000.0).count() == 100_000 == spatial.box_join(large, right(grid), 1000.0).count()


def test_points_and_tiles_of_several_sizes(spark):
    tiles = [("a", 0.0, 0.0, 10.0, 10.0), ("b", 5.0, 5.0, 4000.0, 4000.0), ("c", 20.0, 20.0, 50.0, 60.0)]
    points = [(i, 2.5 * i, 2.5 * i) for i in range(40)] + [(99, 9000.0, 1.0)]
    found = spatial.points_in_tiles(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(tiles, "tile_id string, xmin double, ymin double, xmax double, ymax double"), 100.0)
    wanted = []
    for i, x, y in points:
        own = [t[0] for t in tiles if t[1] < x < t[3] and t[2] < y < t[4]]
        wanted += [(i, t) for t in own] or [(i, "")]
    assert sorted((r["id"], r["tile_id"] or "") for r in found.collect()) == sorted(wanted)


def test_a_scorer_sees_batches_and_is_made_once_a_worker(spark, tmp_path):
    chips = spark.range(40).select(F.col("id"), F.array(*[F.array(*[F.col("id") * 1.0 + k for k in range(4)]) for _ in range(3)]).alias("bands")).repartition(2)
    seen = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(seen, f"made-{uuid.uuid4()}"), "w").close()

        def score(x):
            open(os.path.join(seen, f"batch-{len(x)}-{uuid.uuid4()}"), "w").close()
            assert x.shape[1:] == (3, 2, 2)
            return [[(0.0, 0.0, 1.0, 2.0, 0.9, int(chip[0, 0, 0]))] * (int(chip[0, 0, 0]) % 3) + [(0.0, 0.0, 1.0, 1.0, 0.1, 5)] for chip in x]

        return score

    got = sorted((r["id"], r["det_no"], r["y2"], r["cls"]) for r in scoring.detect_batches(chips, make, ["id"], 2, batch_size=8).collect())
    assert got == sorted((i, n, 2.0, i) for i in range(40) for n in range(i % 3))
    import os

    names = os.listdir(seen)
    assert sum(n.startswith("made") for n in names) <= 4 and max(int(n.split("-")[1]) for n in names if n.startswith("batch")) == 8


def test_intake_goes_on_past_a_failing_tile(spark, tmp_path):
    """Twenty runs: a tile is taken once, one that fails is a reject with its error and taken when it comes again and works."""
    from arbora.streaming.intake import intake

    source, out, rejects, memory, flag = (str(tmp_path / n) for n in ("in", "out", "rejects", "memory", "flag"))

    def step(row):
        import os

        if row["value"] < 0 and not os.path.exists(flag):
            raise OSError(f"no file for {row['tile_id']}")
        return f"{row['tile_id']}.tif"

    read = lambda p: spark.read.option("recursiveFileLookup", True).parquet(p)
    for n in range(20):
        rows = [(f"{n}-{k}", -1.0 if k == 2 else 1.0) for k in range(3)] + [("0-0", 1.0), ("nonsense here", 1.0)] + [(f"{n - 1}-2", 1.0)] * (n % 2)
        spark.createDataFrame(rows, "tile_id string, value double").coalesce(1).write.mode("append").parquet(source)
        if n == 19:
            open(flag, "w").close()
        intake(spark, source, "tile_id string, value double", out, rejects, memory, step)
    done = sorted(r["tile_id"] for r in read(out).collect())
    assert len(done) == len(set(done)) == 2 * 20 + 10 + 1 and read(out).where("result = concat(tile_id, '.tif')").count() == len(done)
    assert sorted(r["error"] for r in read(rejects).where("tile_id is not null").collect()) == sorted(f"OSError: no file for 32_{n}_2" for n in range(19))
    assert read(rejects).where("tile_id is null").count() == 20
    assert not (tmp_path / "memory" / "state").exists()


@pytest.mark.parametrize("weight", [None, "w"])
def test_tabular_classifier_learns_what_separates(spark, weight):
    rng = np.random.default_rng(2)
    centre = {0: (0.0, 0.0), 1: (6.0, 0.0), 2: (0.0, 6.0)}
    rows = [(i, int(i % 3), *(np.array(centre[i % 3]) + 0.4 * rng.normal(size=2)).tolist(), 100.0, 1.0 + i % 2, "train" if i % 4 else "val") for i in range(240)]
    df = spark.createDataFrame(rows, "tree_id bigint, y int, a double, b double, constant double, w double, split string")
    model = scoring.fit_tabular(df.where("split = 'train'"), ["a", "b", "constant"], n_classes=3, weight=weight, max_iter=60)
    found = scoring.predict_tabular(model, df).where("split = 'val'")
    assert found.count() == 60 and found.where("p = y").count() >= 58

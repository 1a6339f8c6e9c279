"""Plans and results that the findings of round 3 asked for."""

from __future__ import annotations

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import batches, matching, rasters, scoring, segment, spatial
from arbora.plans.queries import QUERIES, SQL
from arbora.plans.workspace import stored
from arbora.sources import sinks
from tests.compare import connect, rows_of_spark, rows_of_sql

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, prefix: str, name: str):
    return spark.range(50).select(F.col("id").alias(name), *[(F.col("id") * 3 + k).cast("double").alias(f"{prefix}{c}") for c, k in (("xmin", 0), ("ymin", 0), ("xmax", 4), ("ymax", 4))])


def test_cells_are_not_broadcast(spark):
    """Listed in cells, boxes are many more than the table that they come from, by whose size Spark would send them to everyone."""
    left, right = boxes(spark, "", "tile_id"), boxes(spark, "r_", "b")
    points = spark.range(50).select("id", (F.col("id") + 0.5).alias("x"), (F.col("id") + 0.5).alias("y"))
    for df in (spatial.box_join(left, right, 12.0), spatial.points_in_tiles(points, left, 10.0), spatial.tiles_with_boxes(left, right.select(*[F.col(f"r_{c}").alias(c) for c in spatial.BOX]))):
        assert "Broadcast" not in plan(df)
        assert df.count() >= 50


@pytest.mark.parametrize("scale", [2.0, 0.5, 1.3])
def test_bilinear_without_join(spark, scale):
    """Each target pixel of a grid with gaps, one by one; and no join, whose exploded side would be sent to everyone."""
    n, m = 6, 5
    grid = {(r, c): float(r * r + 3 * c) for r in range(n) for c in range(m) if (r + 2 * c) % 5}
    df = spark.createDataFrame([(1, r, c, v) for (r, c), v in grid.items()] + [(1, 0, 0, None)], "tile int, row int, col int, value double")
    made = rasters.resample_bilinear(df, n, m, scale)
    assert "Join" not in plan(made)
    want, (h, w) = {}, (round(n * scale), round(m * scale))
    for r in range(h):
        for c in range(w):
            y, x = (r + 0.5) * n / h - 0.5, (c + 0.5) * m / w - 0.5
            taps = [(min(max(math.floor(y) + i, 0), n - 1), min(max(math.floor(x) + j, 0), m - 1), (1 - abs(y - math.floor(y) - i)) * (1 - abs(x - math.floor(x) - j))) for i in (0, 1) for j in (0, 1)]
            used = [(grid[a, b], k) for a, b, k in taps if (a, b) in grid and k > 0]
            if used:
                want[r, c] = pytest.approx(sum(v * k for v, k in used) / sum(k for _, k in used))
    assert {(r["row"], r["col"]): r["value"] for r in made.collect()} == want


def test_label_lines_make_few_files(spark, tmp_path):
    """Files follow the lines, not the chips; each chip's own file can be had from them."""
    path, folder = str(tmp_path / "lines"), str(tmp_path / "labels")
    rows = spark.range(900).select(F.lit("train").alias("split"), (F.col("id") % 300).alias("chip_id"), F.col("id"))
    sinks.write_label_lines(rows, path, F.col("id").cast("string"))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 4
    lines = sinks.read_label_lines(spark, path)
    assert sorted((r["chip_id"], int(r["value"])) for r in lines.collect()) == sorted((k % 300, k) for k in range(900))
    sinks.export_label_files(sinks.label_files(lines), folder)
    assert len(os.listdir(f"{folder}/train")) == 300
    with open(f"{folder}/train/7.txt") as f:
        assert f.read() == "307\n607\n7\n"


def test_chips_of_fewer_bands(spark):
    """A chip that lacks bands is scored with its own; no model sees bands that it has not."""
    df = spark.createDataFrame([(1, [[0.0, 0.9], [0.1, 0.2], [0.5, 0.6]]), (2, [[0.8, 0.7]]), (3, [[0.9, 0.1], [0.3, 0.9], [0.7, 0.8]])], "id int, bands array<array<double>>")
    df = df.withColumn("bands", F.transform("bands", lambda b: F.concat(b, b)))  # 2 x 2
    found = scoring.detect(df, scoring.threshold_scorer(0.6), ["id"], 2)
    assert sorted((r["id"], r["x1"], r["x2"], round(r["conf"], 6)) for r in found.collect()) == [(1, 1.0, 2.0, 0.9), (2, 0.0, 2.0, 0.75), (3, 0.0, 1.0, 0.9)]
    made = scoring.classify_chips(df, lambda x: x.mean(axis=(2, 3)), ["id"], 2)
    assert {r["id"]: (len(r["logits"]), r["p"]) for r in made.collect()} == {1: (3, 2), 2: (1, 0), 3: (3, 2)}


def grown(spark, tmp_path, **tables) -> str:
    """A folder with the smallest tables, some of them replaced."""
    for name in ("part", "customer", "embeddings"):
        df = tables.get(name) or spark.read.parquet(f"{DATA}/{name}.parquet")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        (file,) = glob.glob(str(tmp_path / "in" / name / "*.parquet"))
        os.link(file, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, folder: str, name: str) -> None:
    assert rows_of_spark(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), SQL[name])


@pytest.mark.parametrize("name", ["a01_tile_grid", "b02_key_to_tile_id"])
def test_grid_keys_of_ten_characters(spark, tmp_path, name):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    same_as_sql(spark, grown(spark, tmp_path, part=part.withColumn("p_partkey", F.col("p_partkey") + 100_000)), name)


@pytest.mark.parametrize("name", ["e04_chip_pixels", "b10_masks", "i01_chip_scoring", "i02_class_scoring", "i06_detections_to_features"])
def test_tiles_that_lack_bands(spark, tmp_path, name):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    same_as_sql(spark, grown(spark, tmp_path, embeddings=vectors.where("vec_id < 101")), name)


def test_points_beyond_the_plausible_range(spark, tmp_path):
    trees = spark.read.parquet(f"{DATA}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") * 6007)
    folder = grown(spark, tmp_path, customer=trees)
    same_as_sql(spark, folder, "b34_crs_round_trip")
    assert {r[0] for r in QUERIES["b34_crs_round_trip"](spark, folder).select("plausible").collect()} == {True, False}


def test_warp_takes_many_blocks_at_a_time(spark):
    """No exchange with pandas for each block, and as many tasks as the session asks for, however few bytes the rasters have."""
    made = QUERIES["e15_warp"](spark, DATA)
    assert "FlatMapGroupsInPandas" not in plan(made) and "REPARTITION_BY_NUM" in plan(made)


def test_suppression_shuffles_boxes_once(spark):
    """Listed in cells, boxes are shuffled once for both sides of the join and bring their confidence, so neither they nor the edges are shuffled again for it."""
    sizes = F.when(F.col("id") % 50 == 0, 90.0).when(F.col("id") % 7 == 0, 1.0).otherwise(9.0)
    df = spark.range(400).select(F.col("id").alias("box_id"), (F.col("id") * 37 % 101).cast("double").alias("xmin"), (F.col("id") * 53 % 97).cast("double").alias("ymin"), (F.col("id") * 31 % 19 / 20).alias("conf"), sizes.alias("s"))
    df = stored(df.selectExpr("box_id", "xmin", "ymin", "xmin + s as xmax", "ymin + s as ymax", "conf"))
    for boxes_, levels in ((df.where("xmax - xmin = 9"), 1), (df, 3)):
        edges = spatial.overlap_pairs(boxes_, "box_id", 12.0, 0.1, extra=("conf",))
        rows = {r["box_id"]: r for r in boxes_.collect()}
        want = {}
        for a, p in rows.items():
            for b, q in rows.items():
                w, h = min(p["xmax"], q["xmax"]) - max(p["xmin"], q["xmin"]), min(p["ymax"], q["ymax"]) - max(p["ymin"], q["ymin"])
                if a < b and w > 0 and h > 0 and (iou := w * h / ((p["xmax"] - p["xmin"]) ** 2 + (q["xmax"] - q["xmin"]) ** 2 - w * h)) > 0.1:
                    want[a, b] = (pytest.approx(iou), p["conf"], q["conf"])
        found = edges.collect()
        assert len(found) == len(want) and {(r["a"], r["b"]): (r["iou"], r["a_conf"], r["b_conf"]) for r in found} == want
        # A self-join a level, and each level's finer boxes against its own both ways; two listings to shuffle, at most.
        final = plan(edges).split("Initial Plan")[0]
        shuffles = final.count("Exchange hashpartitioning") - final.count("ReusedExchange")
        assert "ReusedExchange" in final and shuffles <= min(levels, 2)
        kept = matching.suppress(boxes_.select("box_id", "conf"), edges, checkpoint=stored)
        plain = matching.suppress(boxes_, edges.select("a", "b"), checkpoint=stored)
        gone, stay = set(), []
        for k in sorted(rows, key=lambda k: (-rows[k]["conf"], k)):
            if k not in gone:
                stay.append(k)
                gone |= {b if a == k else a for a, b in want if k in (a, b)}
        assert sorted(r[0] for r in kept.collect()) == sorted(r["box_id"] for r in plain.collect()) == sorted(stay)


def test_watershed_reads_its_pixels_once(spark):
    """What makes the levels may be long, so it must not run again to count the pixels of a tile."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(3 * 36).selectExpr("id div 36 as tile", "cast(id % 36 div 6 as int) as row", "cast(id % 6 as int) as col", "cast(id * 7 % 11 as double) as level", "id % 36 <> 20 and (id < 72 or id % 36 < 8) as canopy", "if(id in (0, 17, 37, 72), cast(id % 36 + 1 as int), 0) as marker")
    df = df.mapInPandas(counted, df.schema)
    labels = {t: set() for t in range(3)}
    for r in segment.watershed(df, fill=False, checkpoint=stored).collect():
        labels[r["tile"]].add((r["row"], r["col"], r["label"]))
    assert seen.value == 108
    # The last tile has too few pixels.
    assert len(labels[0]) == len(labels[1]) == 35 and not labels[2]
    assert {x[2] for x in labels[0]} == {1, 18} and {x[2] for x in labels[1]} == {2}


def test_small_tiles_are_filtered_together(monkeypatch):
    """300 tiles of two sizes, some with gaps, take two stacks, and each has what it has alone."""
    rng, calls, made = np.random.default_rng(3), [], []
    weighted = rasters._weighted
    monkeypatch.setattr(rasters, "_weighted", lambda *a: calls.append(1) or weighted(*a))
    monkeypatch.setattr(rasters, "_filtered", lambda pixels, n_rows, n_cols, radius, along: made.append(along))
    rasters.smooth_gaussian(None, 9)
    rasters.smooth_median(None, 9)
    rasters.sobel(None, 9)
    values = np.where(rng.random((300, 20, 21)) < 0.1, np.nan, rng.random((300, 20, 21)))
    for along in made:
        calls.clear()
        together = along(values)
        assert len(calls) <= 4
        np.testing.assert_array_equal(together, np.stack([along(v[None])[0] for v in values]))
    sizes = rng.integers(1, 9, 300)
    starts = np.cumsum(sizes) - sizes
    kinds = np.where(np.arange(300) % 3 == 0, 5, 8)[:, None] * np.ones(2, int)
    found = list(batches.stacks(starts, int(sizes.sum()), kinds))
    assert [k for k, *_ in found] == [[5, 5], [8, 8]]
    for (h, _), first, rows, slot in found:
        assert (first == starts[kinds[:, 0] == h]).all()
        assert rows.tolist() == [i for a, n in zip(starts, sizes) for i in range(a, a + n) if kinds[np.searchsorted(starts, a), 0] == h]
        assert (np.searchsorted(starts, rows, "right") - 1 == np.searchsorted(starts, first)[slot]).all()
    monkeypatch.setattr(batches, "CELLS", 640)
    assert [len(first) for _, first, *_ in batches.stacks(starts, int(sizes.sum()), kinds)] == [25] * 4 + [10] * 20


def test_tiles_of_all_sizes_beside_each_other(spark, monkeypatch):
    """Filters over tiles of many sizes with gaps, in blocks, give each what it has alone."""
    monkeypatch.setattr(rasters, "BLOCK", 6)
    rng = np.random.default_rng(4)
    tiles = {t: (int(rng.integers(1, 15)), int(rng.integers(1, 15))) for t in range(12)}
    rows = [(t, r, c, None if (r * 5 + c + t) % 13 == 0 else float(rng.random())) for t, (h, w) in tiles.items() for r in range(h) for c in range(w) if (r + 3 * c + t) % 7]
    df = stored(spark.createDataFrame(rows, "tile int, row int, col int, value double"))
    headers = spark.createDataFrame([(t, h, w) for t, (h, w) in tiles.items()], "tile int, n_rows int, n_cols int")
    for made in (rasters.smooth_gaussian, rasters.smooth_median, rasters.sobel):
        found = {(r["tile"], r["row"], r["col"]): r["value"] for r in made(df, headers).collect()}
        assert len(found) == len(rows)
        radius = {rasters.smooth_gaussian: 6, rasters.smooth_median: 1, rasters.sobel: 1}[made]
        along = []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(rasters, "_filtered", lambda pixels, n_rows, n_cols, radius, f: along.append(f))
            made(None, 1)
        for t, (h, w) in tiles.items():
            grid = np.full((h, w), np.nan)
            for k, r, c, v in rows:
                if k == t and v is not None:
                    grid[r, c] = v
            want = along[0](np.pad(grid, radius, mode="symmetric")[None])[0]
            for k, r, c, _ in rows:
                if k == t:
                    assert found[t, r, c] is None if np.isnan(want[r, c]) else found[t, r, c] == pytest.approx(want[r, c])


def test_small_crowns_and_stripes_go_together(spark, monkeypatch):
    """Crowns of several sizes are filled in a few stacks, and each as it is alone; stripes of small tiles are settled as one."""
    rng, calls, made = np.random.default_rng(5), [], []
    reached, lowest = segment._reached, rasters._lowest
    monkeypatch.setattr(segment, "_reached", lambda free: calls.append(1) or reached(free))
    monkeypatch.setattr(rasters, "_lowest", lambda f: calls.append(1) or lowest(f))
    for module in (segment, rasters):
        monkeypatch.setattr(module, "by_many", lambda df, keys, make, schema: made.append(make) or df.select(*keys).crossJoin(spark.createDataFrame([], schema)))
    pixels = spark.createDataFrame([], "tile int, row int, col int, on boolean, label int")
    segment.fill_holes(pixels)
    rasters.distance_to_background(pixels)
    fill, along, stripe = made
    pixels, want = [], set()
    for g in range(200):
        h, w = rng.integers(1, 9, 2).tolist()
        own = rng.random((h, w)) < 0.7
        own[0, 0] = own[-1, -1] = True
        y0, x0 = rng.integers(0, 50, 2).tolist()
        pixels += [(g, y0 + r, x0 + c) for r, c in np.argwhere(own).tolist()]
        outside, todo = set(), [(r, c) for r in range(-1, h + 1) for c in range(-1, w + 1) if r in (-1, h) or c in (-1, w)]
        while todo:
            r, c = todo.pop()
            if (r, c) not in outside and -1 <= r <= h and -1 <= c <= w and not (0 <= r < h and 0 <= c < w and own[r, c]):
                outside.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        want |= {(g, y0 + r, x0 + c) for r in range(h) for c in range(w) if (r, c) not in outside}
    group, row, col = np.array(pixels).T
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    found = [x for first, out in fill({"label": group, "row": row, "col": col}, starts) for x in zip(group[first].tolist(), out["row"].tolist(), out["col"].tolist())]
    assert len(found) == len(want) and set(found) == want and len(want) > len(pixels)
    assert len(calls) <= 4  # sizes up to 4 or 8
    calls.clear()
    on = rng.random((100, 7, 6)) < 0.8
    g, r, c = (x.ravel() for x in np.indices(on.shape))
    px, at = {"row": r.astype(np.int32), "col": c.astype(np.int32), "on": on.ravel()}, np.arange(100) * 42
    ((rows, first),) = along(px, at)
    assert (rows == np.arange(4200)).all()
    ((rows, second),) = stripe(first, at)
    for n in range(100):
        off = np.argwhere(~on[n])
        for i in range(n * 42, n * 42 + 42):
            assert second["distance"][i] == pytest.approx(min(math.hypot(r[i] - y, c[i] - x) for y, x in off.tolist()))
    assert len(calls) == 1

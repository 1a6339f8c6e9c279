"""Classification and detection metrics, class weights, roll-ups and imputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.geo import iou
from arbora.operators.matching import dense
from arbora.plans.workspace import ranked, stored


def class_confusion(rows: DataFrame, n_classes: int, truth: str = "y", pred: str = "p") -> DataFrame:
    """``y, p, n`` for every pair of classes."""
    cells = rows.groupBy(F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    return dense(cells, "y", "p", n_classes)


def row_normalized(cells: DataFrame, row: str = "y") -> DataFrame:
    """``share`` of each cell in its row; an empty row has 0."""
    total = F.sum("n").over(Window.partitionBy(row))
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)))


def classification_report(cells: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` per class, then macro avg, weighted avg and accuracy; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    by_truth = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    each = by_truth.join(by_pred, "c").select("c", "tp", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    each = each.withColumn("f1", ratio(2 * p * r, F.nullif(p + r, F.lit(0.0))))
    names = ("precision", "recall", "f1")
    rows = each.select(F.col("c").cast("string").alias("label"), *names, "support")
    total = F.sum("support")
    macro = each.agg(*[F.avg(n).alias(n) for n in names], total.alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = each.agg(*[ratio(F.sum(F.col(n) * F.col("support")), total).alias(n) for n in names], total.alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    accuracy = each.agg(ratio(F.sum("tp"), total).alias("a"), total.alias("support")).select(F.lit("accuracy").alias("label"), *[F.col("a").alias(n) for n in names], "support")
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def accuracy(rows: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))


def class_weights(labels: DataFrame, n_classes: int, mode: str = "inverse", alpha: float | None = None, column: str = "y") -> DataFrame:
    """``y, weight`` of every class: 1 / max(count, 1) over the mean of those, one number for all, or null for none."""
    if mode not in ("none", "scalar", "inverse"):
        raise ValueError(f"unknown weight mode {mode!r}")
    counts = labels.groupBy(F.col(column).alias("y")).agg(F.count("*").alias("n"))
    grid = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("y"))
    if mode != "inverse":
        return grid.withColumn("weight", F.lit(None if mode == "none" else float(alpha)).cast("double"))
    raw = grid.join(counts, "y", "left").withColumn("raw", 1.0 / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    # One row for each class, so the window over all of them is as small as the class table.
    return raw.select("y", (F.col("raw") / F.avg("raw").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def epoch_rollup(batches: DataFrame, value: str = "value", size: str = "n") -> DataFrame:
    """Means of batch values by epoch and split, weighted by batch size."""
    return batches.groupBy("epoch", "split").agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("mean_value"), F.sum(size).alias("n"))


def impute_median(df: DataFrame, columns: list[str], split: str | None = None, fit_on: str | None = None) -> DataFrame:
    """Fill null and NaN with the column's exact median, of the row's own split, or of the split ``fit_on`` for all."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
    grouped = bool(split) and not fit_on
    basis = clean.where(F.col(split) == fit_on) if fit_on else clean
    which = F.col(split) if grouped else F.lit(0)
    long = basis.select(F.explode(F.array(*[F.struct(which.alias("s"), F.lit(k).alias("c")) for k in range(len(columns))])).alias("_key"), *columns)
    long = long.select("_key", F.get(F.array(*[F.col(c).cast("double") for c in columns]), F.col("_key.c")).alias("_v")).where("_v is not null")
    # The middle of the values by rank over ranges: no task holds a column.
    places = stored(ranked(long, ["_v"], "_k", "_key"), "ranked-values")
    sizes = places.groupBy("_key").agg(F.max("_k").alias("_n"))
    middle = places.join(sizes, "_key").where("_k = floor((_n + 1) / 2) or _k = floor(_n / 2) + 1").groupBy("_key").agg(F.avg("_v").alias("_m"))
    medians = middle.groupBy(F.col("_key.s").alias("_s")).agg(*[F.max(F.when(F.col("_key.c") == k, F.col("_m"))).alias(f"_m_{c}") for k, c in enumerate(columns)])
    if grouped:
        joined = clean.join(medians, which.eqNullSafe(F.col("_s")), "left")
    else:
        row = medians.first()  # one row, or none where no value is known
        joined = clean.withColumns({f"_m_{c}": F.lit(row[f"_m_{c}"] if row else None).cast("double") for c in columns})
    return joined.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).select(*df.columns)


def channel_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def best_epoch(history: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The epoch with the best metric, the first on ties."""
    key = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), "epoch")
    return history.agg(F.min_by("epoch", key).alias("best_epoch"), F.min_by(metric, key).alias("best_value"))


def running_best(history: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    return history.withColumn("best_so_far", F.max(metric).over(Window.partitionBy(*keys).orderBy("epoch")))


# --- average precision ---------------------------------------------------------------------------------------------

# IoU thresholds, area limits in square pixels and detection limits of the usual twelve figures.
IOUS = [0.5 + 0.05 * k for k in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
LIMITS = (1, 10, 100)


N_BITS = len(AREAS) * len(IOUS)  #: bit ``10 * area + threshold`` of a number stands for one of all settings


def _bits(over: np.ndarray) -> np.ndarray:
    """The thresholds that each overlap reaches, as bits."""
    return sum((over >= min(limit, 1 - 1e-10)).astype(np.int64) << t for t, limit in enumerate(IOUS))


def _in_areas(size: np.ndarray, bits: np.ndarray, inside: bool) -> np.ndarray:
    """``bits`` in the place of each area range that ``size`` lies in, or does not."""
    return sum((((size >= low) & (size <= high)) == inside).astype(np.int64) * (bits << n * len(IOUS)) for n, (low, high) in enumerate(AREAS.values()))


def _ordinals(starts: np.ndarray) -> np.ndarray:
    """For each row its place from 0 since the last start."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def match_bits(group: np.ndarray, det: np.ndarray, truth: np.ndarray, over: np.ndarray, truth_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy matching in all settings at once; per detection the settings in which it is a hit, and those in which it hit a truth that does not count.

    Rows are pairs of a detection (numbers from 0 in order; its groups follow each other) and a truth it overlaps, by falling
    overlap. In each setting a detection takes the first of its truths that nobody has and that counts, else the first that does not count. All groups take a step together.
    """
    n_det = int(det[-1]) + 1 if len(det) else 0
    hits, ignored = np.zeros(n_det, np.int64), np.zeros(n_det, np.int64)
    if not len(det):
        return hits, ignored
    new_det = np.diff(det, prepend=-1) > 0
    slot = _ordinals(new_det)
    first = np.flatnonzero(new_det)
    turn = _ordinals(np.diff(group[first], prepend=group[0] - 1) != 0)[np.cumsum(new_det) - 1]
    _, place = np.unique(np.stack([group, truth]), axis=1, return_inverse=True)
    place = place.ravel()
    reach = _bits(over)
    ways = (_in_areas(truth_size, reach, True), _in_areas(truth_size, reach, False))
    used = np.zeros(int(place.max()) + 1, np.int64)
    order = np.lexsort((slot, turn))
    steps = np.flatnonzero(np.diff(turn[order], prepend=-1, append=-1))
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        mine = order[a:b]
        edges = np.flatnonzero(np.diff(slot[mine], prepend=-1, append=-1)).tolist()
        for counts, bits in zip((True, False), ways):
            for low, high in zip(edges[:-1], edges[1:]):
                at = mine[low:high]
                new = bits[at] & ~used[place[at]] & ~hits[det[at]]
                used[place[at]] |= new
                hits[det[at]] |= new
                if not counts:
                    ignored[det[at]] |= new
    return hits, ignored


_MATCHED = "image_id bigint, cls int, det_id bigint, score double, place int, hits bigint, skips bigint"


def _matched(iterator):
    """``_MATCHED`` rows of pairs in order of image, class, place, falling overlap; detections without a pair have one row without truth."""
    kept = None
    for batch in _and_end(iterator):
        rows = pa.Table.from_batches([x for x in (kept, batch) if x is not None]).combine_chunks() if batch is not None or kept is not None else None
        kept = None
        if rows is None or not rows.num_rows:
            continue
        number = lambda c: rows.column(c).to_numpy()  # noqa: B023, E731
        image, cls = number("image_id"), number("cls")
        fresh = np.ones(len(image), bool)
        fresh[1:] = (image[1:] != image[:-1]) | (cls[1:] != cls[:-1])
        if batch is not None:
            # The last group may go on in the next batch.
            end = int(np.flatnonzero(fresh)[-1])
            kept = rows.slice(end).combine_chunks().to_batches()[0]
            rows, image, cls, fresh = rows.slice(0, end), image[:end], cls[:end], fresh[:end]
            if not end:
                continue
        place = number("place")
        new = fresh.copy()
        new[1:] |= place[1:] != place[:-1]
        det, first = np.cumsum(new) - 1, np.flatnonzero(new)
        over = rows.column("over").fill_null(-1.0).to_numpy()
        pair = over >= min(IOUS)
        names, own = np.unique(det[pair], return_inverse=True)
        hits, skips = np.zeros(len(first), np.int64), _in_areas(number("size")[first], np.full(len(first), (1 << len(IOUS)) - 1), False)
        if len(names):
            hits[names], ignored = match_bits(np.cumsum(fresh)[pair], own, rows.column("gt_id").fill_null(-1).to_numpy()[pair], over[pair], rows.column("gt_size").fill_null(0.0).to_numpy()[pair])
            skips[names] = skips[names] & ~hits[names] | ignored
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(at) for c in ("image_id", "cls", "det_id", "score", "place")], pa.array(hits), pa.array(skips)], names=[c.split()[0] for c in _MATCHED.split(", ")])


def _and_end(iterator):
    yield from iterator
    yield None


_COUNTED = "total boolean, cls int, bit int, tp bigint, k bigint, h1 bigint, h10 bigint"


def _counted(iterator):
    """Along rows of falling score: for each class and setting the hits with the numbers of hits and of rows so far, and at the end the totals."""
    sums: dict[int, np.ndarray] = {}  # class: hits, rows, hits at place 1, up to 10
    shifts = np.arange(N_BITS)
    for batch in iterator:
        out = []
        cls, place = batch.column("cls").to_numpy(), batch.column("place").to_numpy()
        shown = (batch.column("skips").to_numpy()[:, None] >> shifts & 1) == 0
        hit = ((batch.column("hits").to_numpy()[:, None] >> shifts & 1) == 1) & shown
        for c in np.unique(cls).tolist():
            own = cls == c
            before = sums.setdefault(c, np.zeros((4, N_BITS), np.int64))
            tp, k = np.cumsum(hit[own], axis=0) + before[0], np.cumsum(shown[own], axis=0) + before[1]
            row, bit = np.nonzero(hit[own])
            out.append((np.full(len(row), c), bit, tp[row, bit], k[row, bit]))
            sums[c] = np.stack([tp[-1], k[-1], *[before[n + 2] + (hit[own] & (place[own] <= LIMITS[n])[:, None]).sum(0) for n in range(2)]])
        if out:
            c, bit, tp, k = (np.concatenate(x) for x in zip(*out))
            none = np.zeros(len(c), np.int64)
            yield _counts(False, c, bit, tp, k, none, none)
    for c, found in sums.items():
        yield _counts(True, np.full(N_BITS, c), shifts, *found)


def _counts(total: bool, cls, bit, *numbers) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(cls), total)), pa.array(cls.astype(np.int32)), pa.array(bit.astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in numbers]]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COUNTED.split(", ")])


def average_precision(dets: DataFrame, truths: DataFrame) -> DataFrame:
    """``metric, value``: AP at IoU .5:.95, .5 and .75 and by size, AR with 1, 10, 100 detections and by size; null where nothing counts,
    and all of them without any detection.

    ``dets``: image_id, cls, det_id, score, x1..y2; ``truths``: image_id, cls, gt_id, x1..y2. Images and classes are matched
    each on its own, whole batches of them side by side, from pairs that Spark has joined. The curves run along ranges of falling score, each shifted by the sums of those
    before it, so no task sorts a whole class.
    """
    box = ["x1", "y1", "x2", "y2"]
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    place = F.row_number().over(Window.partitionBy("image_id", "cls").orderBy(F.desc("score"), "det_id"))
    d = dets.select("image_id", "cls", "det_id", "score", *box, place.alias("place")).where(F.col("place") <= LIMITS[-1]).withColumn("size", area(""))
    # Names of its own, as both sides may come from one table.
    g = truths.select(F.col("image_id").alias("g_image"), F.col("cls").alias("g_cls"), "gt_id", *[F.col(c).alias(f"g_{c}") for c in box]).withColumn("gt_size", area("g_"))
    over = iou("", "g_")
    # Only truths that reach the lowest threshold can be hit.
    pairs = d.join(g, (F.col("image_id") == F.col("g_image")) & (F.col("cls") == F.col("g_cls")) & (over >= min(IOUS)), "left")
    pairs = pairs.select("image_id", "cls", "det_id", "score", "place", "size", "gt_id", "gt_size", F.when(F.col("gt_id").isNotNull(), over).alias("over"))
    ordered = pairs.repartition("image_id", "cls").sortWithinPartitions("image_id", "cls", "place", F.desc("over"), F.desc("gt_id"))
    matched = stored(ordered.select(*[F.col(c).cast(k) for c, k in (("image_id", "bigint"), ("cls", "int"), ("det_id", "bigint"), ("score", "double"), ("place", "int"), ("size", "double"), ("gt_id", "bigint"), ("gt_size", "double"), ("over", "double"))]).mapInArrow(_matched, _MATCHED), "matched")
    none = matched.isEmpty()
    ranged = matched.repartitionByRange(F.desc("score"), "image_id", "place").sortWithinPartitions(F.desc("score"), "image_id", "place", "det_id")
    counted = stored(ranged.select("cls", "place", "hits", "skips").mapInArrow(_counted, _COUNTED).withColumn("_pid", F.spark_partition_id()), "counted")
    size = area("")
    inside = F.filter(F.array(*[F.when((size >= low) & (size <= high), F.lit(n)) for n, (low, high) in enumerate(AREAS.values())]), lambda n: n.isNotNull())
    counts = truths.select(F.col("cls").cast("int").alias("cls"), F.explode(inside).alias("area")).groupBy("cls", "area").agg(F.count("*").alias("n_truth"))
    counts = counts.select("cls", "n_truth", F.explode(F.expr(f"sequence(area * {len(IOUS)}, area * {len(IOUS)} + {len(IOUS) - 1})")).alias("bit"))
    keys = ["cls", "bit"]
    totals = counted.where("total")
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("_pid", *keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("tp", "k")])
    # Between hits recall stands still and precision falls, so the hits alone make the curve; those before have a recall of one hit less.
    curve = counted.where("not total").join(sums, ["_pid", *keys]).withColumns({"tp": F.col("tp") + F.col("_tp"), "k": F.col("k") + F.col("_k")}).join(counts, keys)
    curve = curve.select("_pid", *keys, "k", (F.col("tp") / F.col("n_truth")).alias("recall"), ((F.col("tp") - 1) / F.col("n_truth")).alias("before"), (F.col("tp") / F.col("k")).alias("precision"))
    curve = stored(curve, "curve")
    later = Window.partitionBy(*keys).orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    peaks = curve.groupBy("_pid", *keys).agg(F.max("precision").alias("_p")).select("_pid", *keys, F.max("_p").over(later).alias("_later"))
    back = Window.partitionBy("_pid", *keys).orderBy(F.desc("k"))
    curve = curve.withColumn("precision", F.max("precision").over(back)).join(peaks, ["_pid", *keys]).withColumn("precision", F.greatest("precision", "_later"))
    # At each of 101 recall points: the precision at the first place of that recall or more.
    low = F.when(F.col("before") > 0, F.col("before")).otherwise(-1.0)
    spans = curve.withColumn("_low", F.greatest(F.floor(low * 100 + 1e-9) + 1, F.lit(0))).withColumn("_high", F.floor(F.col("recall") * 100 + 1e-9))
    points = spans.where("_high >= _low").groupBy(*keys).agg((F.sum((F.col("_high") - F.col("_low") + 1) * F.col("precision")) / 101).alias("ap"))
    hits = totals.groupBy(*keys).agg(*[F.sum(c).alias(f"r{n}") for c, n in zip(("h1", "h10", "tp"), LIMITS)])
    each = counts.join(points, keys, "left").join(hits, keys, "left")
    each = each.select((F.expr(f"bit div {len(IOUS)}")).alias("area"), (F.col("bit") % len(IOUS)).alias("t"), F.coalesce("ap", F.lit(0.0)).alias("ap"), *[(F.coalesce(f"r{n}", F.lit(0)) / F.col("n_truth")).alias(f"r{n}") for n in LIMITS])
    names = list(AREAS)
    wanted = [("AP", "ap", "all", None), ("AP50", "ap", "all", 0), ("AP75", "ap", "all", 5), *[(f"AP_{n}", "ap", n, None) for n in names[1:]], *[(f"AR{k}", f"r{k}", "all", None) for k in LIMITS], *[(f"AR_{n}", "r100", n, None) for n in names[1:]]]
    mean = lambda c, n, t: F.avg(F.when((F.col("area") == names.index(n)) & (F.lit(True) if t is None else F.col("t") == t), F.col(c)))
    row = each.agg(*[mean(c, n, t).alias(m) for m, c, n, t in wanted])
    figures = row.unpivot([], row.columns, "metric", "value")
    return figures.withColumn("value", F.lit(None).cast("double")) if none else figures

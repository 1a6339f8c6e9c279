"""Values at given ranks by narrowing histograms: no task sorts or holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.plans.workspace import forget, stored

BINS = 4096
MOST = 10_000  #: values of a bin that one task may sort


def values_at(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str = "value", checkpoint=None) -> DataFrame:
    """``wanted`` (``keys, target, rank``; ranks from 0) with ``found``: the value of that rank among the known values of its group.

    Each round counts the values between a target's bounds in ``BINS`` bins and keeps the bin that holds the rank, with its least and
    largest value as new bounds, until few values or equal ones are left.
    """
    cut = checkpoint or stored
    v = F.col(value)
    known = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    spans = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    state = cut(wanted.select(*keys, "target", F.col("rank").cast("bigint").alias("rank")).join(spans, keys).where("rank >= 0 and rank < _n").withColumn("_skip", F.lit(0).cast("bigint")))
    narrow = (F.col("_n") > MOST) & (F.col("_lo") < F.col("_hi"))
    inside = F.expr("_v between _lo and _hi")
    while not state.where(narrow).isEmpty():
        share = (F.col("_v").cast("double") - F.col("_lo").cast("double")) / (F.col("_hi").cast("double") - F.col("_lo").cast("double"))
        # Rounding keeps the order; the ends are told apart whatever it does.
        place = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * (BINS - 2)) + 1, F.lit(BINS - 2))).cast("int")
        met = known.join(state.where(narrow), keys).where(inside).withColumn("_bin", place)
        bins = met.groupBy(*keys, "target", "rank", "_skip", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # At most BINS rows a target.
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "target").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_skip")
        hit = bins.withColumn("_before", before).where("_before <= rank and rank < _before + _c")
        after = cut(state.where(~narrow).unionByName(hit.select(*keys, "target", "rank", "_lo", "_hi", F.col("_c").alias("_n"), F.col("_before").alias("_skip"))))
        forget(state)
        state = after
    few = known.join(state.where("_lo < _hi"), keys).where(inside).groupBy(*keys, "target", "rank", "_skip").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    few = few.select(*keys, "target", "rank", F.get("_vs", (F.col("rank") - F.col("_skip")).cast("int")).alias("found"))
    return state.where("_lo >= _hi").select(*keys, "target", "rank", F.col("_lo").alias("found")).unionByName(few)


def percentiles(rows: DataFrame, keys: list[str], shares: list[float], value: str = "value", checkpoint=None) -> DataFrame:
    """``keys, p0, p1, ...``: exact percentiles of each group's known values, between two ranks by their distance; and ``low, high``, the least and largest."""
    v = F.col(value).cast("double")
    known = rows.select(*keys, v.alias("value")).where("value is not null and not isnan(value)")
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("value").alias("low"), F.max("value").alias("high"))
    targets = F.explode(F.array(*[F.struct(F.lit(2 * i + j).alias("target"), (F.ceil if j else F.floor)((F.col("_n") - 1) * p).alias("rank")) for i, p in enumerate(shares) for j in (0, 1)])).alias("_t")
    found = values_at(known, sizes.select(*keys, targets).select(*keys, "_t.target", "_t.rank"), keys, checkpoint=checkpoint)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == k, F.col("found"))).alias(f"_v{k}") for k in range(2 * len(shares))])

    def between(i: int, p: float):
        at = (F.col("_n") - 1) * p
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return sizes.join(wide, keys).select(*keys, "low", "high", *[between(i, p).alias(f"p{i}") for i, p in enumerate(shares)])

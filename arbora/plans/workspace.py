"""Places for intermediate files: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def local_folder() -> str:
    """One temporary folder of this process, for sessions in local mode without a shared one."""
    return tempfile.mkdtemp(prefix="arbora-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` and read it back: a cut of the lineage that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; for when nothing will read them again."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs that run within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ranked(df: DataFrame, order: list[str], name: str, by: str | None = None) -> DataFrame:
    """Add ``name``: the row's place from 1 in ``order`` (a total one), within each ``by`` or over all rows.

    The rows are range-sorted and written; each partition counts on its own and is shifted by those before it, so no task
    sees more than its range, however frequent a value of ``by`` is.
    """
    keys = [by] if by else []
    ranged = stored(df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_pid", F.spark_partition_id()), "ranked")
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    # One row for each partition and value.
    sizes = ranged.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_{c}") for c in keys], F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_pid") == F.col("_p")
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(sizes, on).withColumn(name, (F.col("_k") + F.col("_before")).cast("bigint")).select(*df.columns, name)

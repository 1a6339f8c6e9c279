"""Spark helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute in tasks)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id bigint, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators need; any others, whatever their names, go."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


@cache
def local_folder() -> str:
    """One temporary folder of this process, for sessions in local mode without a shared one."""
    return tempfile.mkdtemp(prefix="arbora-")


#: Folders that ``shared_dir`` gave out and nobody has dropped yet.
_given: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent, a temporary folder takes its place in local mode, where there is one machine only; on a
    cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders() -> list[str]:
    """The shared folders in use: what results not yet written elsewhere are read from."""
    return list(_given)


def release(spark: SparkSession, keep: list[str] = ()) -> None:
    """Delete the shared folders in use but for ``keep``; for when the results that are read from them are written elsewhere."""
    drop_paths(spark, *[p for p in _given if p not in keep])


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Delete folders of tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _given:
            _given.remove(path)


class Scratch:
    """The intermediate tables of one operator, in one shared folder that goes once its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_dir(spark, name)

    def written(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        drop_paths(self.spark, self.path)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 4 << 20):
    """Writes within send Arrow batches of at most ``most_bytes`` (or one row) to Python: for tables of large binaries."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def batches(iterator, most_bytes: int = 1 << 20, column: str = "text"):
    """Arrow batches cut so that ``column`` holds at most ``most_bytes`` a piece, or one row."""
    for batch in iterator:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([batch])
        sizes = pa.compute.binary_length(table_.column(column)).fill_null(0).to_numpy()
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most_bytes:
                yield table_.slice(start, i - start).combine_chunks()
                start, total = i, 0
            total += n
        yield table_.slice(start).combine_chunks()


def strings(column) -> pa.Array:
    """One Arrow string array without nulls (null is the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    return pa.compute.fill_null(column.cast(pa.large_string()), "")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, label`` of about ``most`` labelled rows at most, chosen by hashes, written to the shared folder.

    Labels other than 0 and 1 and null ids are left out, of an id that is labelled several times the largest label counts,
    rows that repeat an id and a text are one, and so are the texts under one id weighed like others.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = lambda n, key: F.expr(f"pmod(xxhash64({key}), 1000000) < {int(1e6 * min(1.0, most / max(n, 1)))}")
    # About ``most`` rows of two numbers: small enough to send to every task, whatever the input.
    rows = docs.join(F.broadcast(known.where(share(known.count(), "doc_id"))), "doc_id").select("doc_id", "text", "label").dropDuplicates(["doc_id", "text"])
    rows = written(rows, "sample")
    return rows.where(share(rows.count(), "doc_id, text"))


def global_prefix(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order`` (which must be a total order).

    The rows are range-partitioned and sorted, each partition sums on its own, and only one total per
    partition meets in one place; so no task sees more rows than its range.
    """
    narrow = df.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(c) for c in order])
    narrow = narrow.sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    schema = pa_schema_ddl(narrow) + f", `{out}` bigint"

    def local(iterator):
        before = 0
        for batch in iterator:
            values = pa.compute.fill_null(batch.column(value), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            ends = values.cumsum() + before
            if len(ends):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - values)], names=[*batch.schema.names, out])

    kept = written(narrow.mapInArrow(local, schema), "prefix")
    totals = kept.groupBy("_pid").agg(F.sum(value).alias("_n"))
    # One row for each partition, so the totals are as few as the tasks.
    bases = totals.selectExpr("_pid", "coalesce(sum(_n) over (order by _pid rows between unbounded preceding and 1 preceding), 0L) as _base")
    joined = kept.join(F.broadcast(bases), "_pid")
    return joined.select(*df.columns, (F.col(out) + F.col("_base")).alias(out))


def pa_schema_ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

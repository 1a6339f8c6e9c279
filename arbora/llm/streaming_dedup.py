"""Exact deduplication by Structured Streaming with disk-backed keyed state, in DataFrame and SQL functions only.

1. A stateless stream reads the files of a table and appends one narrow row for each of theirs to a log: id, locator (file and
   row in it) and SHA-256 of the text in its equal form (runs of white space are one space).
2. A second stream reads the log into keyed state in RocksDB: for each digest the smallest id so far with its locator, and
   the number of rows. State never expires. Rows of one digest meet as partial aggregates, so a digest that a third of all rows
   share is one row a task.
3. The state is read as a table and joined to the log. Every hit, a row whose digest another row stands for, has its full text
   compared with the text at the locator in the state; only texts of repeated digests are compared, and only they
   travel by digest. Texts that differ under one digest are grouped by their bytes.

Both streams keep their checkpoints under ``home``: a later call with the same ``home`` reads new files only and
goes on from the state. They run in micro-batches of bounded size and restart where they stopped.

Defined cases: null texts count as empty, empty texts equal each other; a text of any length is one row and is
compared whole; of equal texts the row with the smallest id stays, of rows that repeat that id the one whose
file and place come first, and rows without an id only where no row has one (``keep_id`` is null then); other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, shared_dir, written

LOG = "doc_id bigint, path string, row bigint, sha binary"
STATE = "digest binary, keep_id bigint, keep_path string, keep_row bigint, n bigint"
#: State on the executors' disks with its changes and snapshots in the checkpoint; memory is bounded for all partitions of an executor together.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each state partition takes several MB of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
BATCH_BYTES = 64 << 30  #: of files in a micro-batch, about


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def equal_form(text: Column) -> Column:
    """``text`` with each run of ``[\\x20\\x09-\\x0D]`` as one space; null is the empty text."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    # The regular expression costs most, so only texts that need it meet it.
    return F.when(F.instr(plain, "  ") > 0, F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def _located(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    at = F.col("_metadata")
    return table.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), at["file_path"].alias("path"), at["row_index"].alias("row"))


def append_log(spark: SparkSession, table_path: str, home: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> None:
    """Append the rows of the files of ``table_path`` (one Parquet file or a folder of them) that the log does not have yet."""
    path = table_path.rstrip("/")
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    # A glob, as the path may be a single file. No file is too old: by default those a week older than the newest are passed over.
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _located(source, id_col, text_col).select("doc_id", "path", "row", F.unhex(F.sha2(equal_form(F.col("text")), 256)).alias("sha"))
    _drain(rows.writeStream.format("parquet").option("path", f"{home}/log").option("checkpointLocation", f"{home}/log-progress"))


def update_state(spark: SparkSession, home: str, digest_bytes: int = 32, batch_bytes: int = BATCH_BYTES) -> None:
    """Bring the keyed state up to the log. The number of state partitions is ``spark.sql.shuffle.partitions`` at the first call."""
    log = spark.readStream.schema(LOG).option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d").parquet(f"{home}/log")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "path", "row")).alias("first")
    state = log.withColumn("digest", F.substring("sha", 1, digest_bytes)).groupBy("digest").agg(first, F.count("*").alias("n"))
    with settings(spark, ROCKSDB):
        _drain(state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{home}/state"))


def _drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def state_table(spark: SparkSession, home: str) -> DataFrame:
    """The state as rows of ``STATE``: a digest, the smallest id under it, where that row's text is, and how many rows there are."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/state/commits/0")
    if not commits.getFileSystem(spark._jsc.hadoopConfiguration()).exists(commits):  # no file has come yet
        return spark.createDataFrame([], STATE)
    first = F.col("value.min")
    kept = spark.read.format("statestore").load(f"{home}/state")
    # A key that is an expression has a name of Spark's own, so the fields are taken by place.
    key = kept.schema["key"].dataType[0].name
    return kept.select(F.col("key")[key].alias("digest"), first["doc_id"].alias("keep_id"), first["path"].alias("keep_path"), first["row"].alias("keep_row"), F.col("value.count").alias("n"))


def texts_at(table: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``places`` (with ``path, row``) and ``body``, the equal form of the text that stands there."""
    found = _located(table, id_col, text_col).select("path", "row", "text").join(places, ["path", "row"])
    return found.withColumn("body", equal_form(F.col("text"))).drop("text")


def deduplicate(spark: SparkSession, table_path: str, home: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row that the table at ``table_path`` has or had in an earlier call.

    ``home`` is a shared folder for log, state and progress; without one, a fresh folder serves this call. ``digest_bytes`` bytes
    of the digest are the state's key; with fewer than 32 more texts meet under one, and the comparison of bytes tells them apart.
    """
    home = home or shared_dir(spark, "streaming-dedup")
    append_log(spark, table_path, home, id_col, text_col, batch_bytes)
    update_state(spark, home, digest_bytes, batch_bytes)
    scratch = Scratch(spark, "dedup")
    table = spark.read.parquet(table_path)
    state = state_table(spark, home)
    log = spark.read.schema(LOG).parquet(f"{home}/log").withColumn("digest", F.substring("sha", 1, digest_bytes))
    stands = (F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row"))
    rows = scratch.written(log.join(state, "digest").withColumn("kept", stands), "decided")

    repeated = texts_at(table, rows.where("n > 1").select("path", "row", "digest", "kept"), id_col, text_col)
    # One write of the repeated texts, so that the two sides of the comparison do not read all texts again.
    repeated = scratch.written(repeated, "repeated")
    standing = repeated.where("kept").select("digest", F.col("body").alias("keep_body"))
    hits = repeated.where("not kept").join(standing, "digest").select("path", "row", "digest", (F.col("body") == F.col("keep_body")).alias("same"))
    differ = scratch.written(hits.where("not same").select("path", "row", "digest"), "differ")
    out = rows.select("doc_id", "path", "row", "digest", "sha", "keep_id", F.col("n").alias("group_size"), "kept")
    if not differ.isEmpty():
        gone = differ.groupBy("digest").agg(F.count("*").alias("gone"))
        own = out.join(differ, ["path", "row", "digest"], "left_anti").join(gone, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).drop("gone")
        bodies = scratch.written(repeated.join(differ, ["path", "row", "digest"], "left_semi").select("path", "row", "digest", "body").join(rows.select("path", "row", "doc_id", "sha"), ["path", "row"]), "bodies")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "path", "row")).alias("first")
        groups = bodies.groupBy("digest", "body").agg(first, F.count("*").alias("group_size"))
        regrouped = bodies.join(groups, ["digest", "body"])
        kept = (F.col("path") == F.col("first.path")) & (F.col("row") == F.col("first.row"))
        out = own.unionByName(regrouped.select("doc_id", "path", "row", "digest", "sha", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept")))
    result = written(out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")), "dedup")
    scratch.drop()
    return result


def op13_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body) USING (body)
"""

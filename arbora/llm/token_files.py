"""Token-id files: Parquet list columns in id order, with dictionary or delta encoding, row groups and page indexes.

Each row is one document: ``doc_id``, ``n_tokens``, ``ids``. Files are range-partitioned and sorted by ``doc_id``, rows of
one ``doc_id`` by their place in the input (so they may fill several files), and the index follows the files' order. So a filter on ``doc_id`` skips files and row groups by their statistics and pages by the page index, and
a read of ``doc_id, n_tokens`` never touches the ids.

Defined cases: a null text is the empty text and still gets its end id; a null ``doc_id`` sorts first; repeated
``doc_id`` rows are kept as rows of their own; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, global_prefix, id_text, shared_dir, shuffle_partitions, table, written
from arbora.llm.tokens import crc32_ids, default_tokenizer, encoder

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` in ascending ``doc_id`` order over the partitions."""
    rows = id_text(docs, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place")

    def encode(iterator):
        for t in batches(iterator, 4 << 20):
            ids, offsets = encoder(tokenizer).encode(t.column("text"))
            n = len(offsets) - 1
            ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
            offsets = offsets + np.arange(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), lists], names=["doc_id", "n_tokens", "ids"])

    return ordered.mapInArrow(encode, FILE_SCHEMA)


def write_token_files(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 1 << 18, page_rows: int = 2000) -> None:
    """``encoding``: "dictionary" (bit-packed codes of the ids in use) or "delta" (binary-packed differences)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
    }
    tokens.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens``; the column of ids is not read."""
    return spark.read.schema("doc_id bigint, n_tokens bigint").parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Whole rows, of all documents or of those from ``first`` to ``last``; files, row groups and pages outside are skipped."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def checked_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: where each document stands in the stream of all ids."""

    def sums(iterator):
        for batch in iterator:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [crc32_ids(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "row")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    # Files are numbered by the partition that wrote them; a row's place in its file is known to the reader.
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint").alias("file")
    rows = read_tokens(spark, path).select("doc_id", "ids", number, F.col("_metadata.row_index").alias("row"))
    rows = rows.mapInArrow(sums, "doc_id bigint, file bigint, row bigint, n_tokens bigint, ids_crc32 bigint")
    rows = written(rows, "token-index")  # a few numbers a document: sorting them must not decode the ids again
    return global_prefix(rows, ["file", "row"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_token_files(encode_documents(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2), path)
    return checked_index(spark, path)

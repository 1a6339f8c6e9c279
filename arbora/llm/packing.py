"""Pack documents along a space-filling curve.

Each document becomes a vector of signed word-hash counts, projected to a few dimensions; its Hilbert key places
it on a curve along which near keys mean similar documents. Ids are laid out in key order and cut at every
``length`` ids, so only the last sequence can need padding.

Defined cases: a null text is the empty text (its separator alone is packed); repeated rows are packed as rows of
their own, in an order fixed by a row number; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, global_prefix, id_text, table, written
from arbora.llm._text import NOT_SPACE, words_of
from arbora.llm.tokens import default_tokenizer, encoder

DIMENSIONS, BITS = 4, 15


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points of shape (n, dimensions), each in [0, 2**bits); dimensions * bits <= 63.

    Follows the transpose form of Skilling, "Programming the Hilbert curve" (2004), over whole columns at once.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(column, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hashed word counts projected by random signs, scaled by the document's length, on an integer grid."""
    words = words_of(column, NOT_SPACE)
    doc = words.doc_of_word()
    n = words.n_docs
    counts = np.maximum(np.bincount(doc, minlength=n), 1)
    points = np.empty((n, dimensions), np.int64)
    for k in range(dimensions):
        signs = ((words.hashes >> np.uint64(k)) & np.uint64(1)).astype(np.float64) * 2 - 1
        mean = np.bincount(doc, weights=signs, minlength=n) / counts
        # The mean of n signs spreads as 1 / sqrt(n); arctan keeps all of it on the grid.
        place = np.arctan(mean * np.sqrt(counts)) / np.pi + 0.5
        points[:, k] = np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return points


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, hilbert_key``; ``ids`` is uint32 binary."""

    def encode(iterator):
        for t in batches(iterator, 4 << 20):
            ids, offsets = encoder(tokenizer).encode(t.column("text"))
            keys = np.concatenate([hilbert_key(document_points(part.column("text")), BITS) for part in batches(t.to_batches())])
            wide = np.uint32 if len(ids) and int(ids.max()) > 65535 else np.uint16
            blobs = [np.append(ids[a:b], separator).astype(wide).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(keys), pa.array(np.diff(offsets) + 1), pa.array(blobs, pa.binary())], names=["doc_id", "hilbert_key", "doc_tokens", "blob"])

    coded = id_text(docs, id_col, text_col).mapInArrow(encode, "doc_id bigint, hilbert_key bigint, doc_tokens bigint, blob binary")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    # The ids travel along, so that pieces come out in the order of the stream but for where a file begins.
    placed = global_prefix(coded, ["hilbert_key", "doc_id", "row"], "doc_tokens", "at").select("doc_id", "hilbert_key", "doc_tokens", "blob", "at")

    def cut(iterator):
        for batch in iterator:
            rows = batch.to_pydict()
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "hilbert_key")}
            for doc, key, n, blob, at in zip(rows["doc_id"], rows["hilbert_key"], rows["doc_tokens"], rows["blob"], rows["at"]):
                ids = np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype("<u4")
                begin = 0
                while begin < n:
                    offset = (at + begin) % length
                    size = min(length - offset, n - begin)
                    for name, value in zip(out, (doc, begin, size, ids[begin : begin + size].tobytes(), n, (at + begin) // length, offset, key)):
                        out[name].append(value)
                    begin += size
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    return placed.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, hilbert_key bigint")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` for ``ids``; Spark's crc32 is unsigned already."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "hilbert_key")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(pack(table(spark, sf_dir, "documents"), default_tokenizer()))

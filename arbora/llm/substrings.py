"""Removal of word sequences that repeat across documents, found level by level.

A level has a window length; its candidates are looked up by hash in all documents, and only where windows repeat are the
windows of the next length, at most twice as long, candidates. The first level takes windows of half the target length, and
of those only the one with the smallest hash within each window of the target length (equal windows choose the
same one). The level of the target length decides which words go: those covered by a window whose words also start in a
document with a smaller id. Longer levels, each twice the last, go on until no candidate survives; they tell how long the
repeats are.

How a level runs: documents lie in blocks (one row of a written table each, compressed). A block sends its distinct
hashes, sorted and cut into buckets by range; a bucket meets the hashes of all blocks and answers each with one bit
a hash: whether another block holds it (at the target level with one more: in a document with a smaller id). The bits go back to the block,
which drops its finished documents and writes those with candidates for the next level. A sequence that
thousands of documents share is one hash a block, so it weighs no more than a rare one, and nothing is capped. A level has
a row for each block and bucket that share a hash, so never more rows than hashes.

Windows at the target level are compared by 96 bits (a false match is expected once in 10**15 candidate
windows against 10**14 others); other levels only narrow the search or report lengths and use 64.

Defined cases: a null text has no words; texts shorter than the target lose nothing; an id that is repeated is not
smaller than itself, so equal ids take nothing from each other; a null id counts as larger than all others; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, batches, drop_paths, id_text, shared_dir, shuffle_partitions, small_batches, table
from arbora.llm._text import NOT_SPACE, U, Words, flat_ranges, least_in_window, mix, words_of

NO_ID = np.iinfo(np.int64).max
#: Marks of the level's positions and lengths travel with a block under these names, which no input column can have.
_IDS, _TEXT, _LONGEST, _CANDIDATES = "\0id", "\0text", "\0longest", "\0candidates"


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ...: sorted numbers compress well this way."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Level:
    """The windows of one block at one level, and what their hashes are."""

    def __init__(self, t: pa.Table, length: int, target: int):
        self.words = words = words_of(t.column(_TEXT), NOT_SPACE)
        self.ids = t.column(_IDS).to_numpy()
        self.length, self.target = length, target
        self.exact = length == target
        if length < target:
            # The window with the smallest hash among those in each window of the target length.
            first, _ = words.runs(target)
            if len(first):
                grams = words.run_hash(np.arange(len(words.starts) - length + 1), length)
                self.chosen = least_in_window(grams, first, target - length + 1)
                self.first, self.places = first, np.unique(self.chosen)
                # Least hashes crowd at the low end; mixed again they fill the buckets evenly.
                self.hash = mix(grams[self.places] + U(1))
            else:
                self.first = self.chosen = self.places = first
                self.hash = np.zeros(0, U)
        else:
            lists = t.column(_CANDIDATES).combine_chunks() if isinstance(t.column(_CANDIDATES), pa.ChunkedArray) else t.column(_CANDIDATES)
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(lists.offsets.to_numpy())
            places = own + np.repeat(words.offsets[:-1], n)
            self.places = places
            self.hash = words.run_hash(places, length)
        self.doc = np.searchsorted(words.offsets, self.places, "right") - 1
        more = (words.run_hash(self.places, length, lane=1) >> U(32)).astype(np.uint32) if self.exact else np.zeros(len(self.places), np.uint32)
        order = np.lexsort((self.doc, self.ids[self.doc], more, self.hash)) if self.exact else np.lexsort((self.doc, self.hash))
        h, e = self.hash[order], more[order]
        new = np.append(True, (h[1:] != h[:-1]) | (e[1:] != e[:-1])) if len(h) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.key, self.extra = h[heads], e[heads]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group
        self.least = self.ids[self.doc[order[heads]]]
        last = order[np.append(heads[1:], len(order)) - 1] if len(heads) else order
        self.several = self.doc[last] != self.doc[order[heads]]

    def bounds(self, buckets: int) -> np.ndarray:
        """Where each bucket's range begins among the sorted keys."""
        place = ((self.key >> U(32)) * U(buckets)) >> U(32)
        return np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))

    def repeated(self, bits: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """By window: whether it repeats in another document, and (at the target level) in one with a smaller id."""
        bounds = self.bounds(buckets)
        elsewhere, smaller = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        for b, blob in bits.items():
            part = slice(bounds[b], bounds[b + 1])
            n = int(bounds[b + 1] - bounds[b])
            packed = np.frombuffer(blob, np.uint8)
            elsewhere[part] = np.unpackbits(packed, count=n).astype(bool)
            if self.exact:
                smaller[part] = np.unpackbits(packed[(n + 7) // 8 :], count=n).astype(bool)
        again = (elsewhere | self.several)[self.of]
        return again, smaller[self.of] | (self.least[self.of] < self.ids[self.doc]) if self.exact else again


def _requests(length: int, target: int, buckets: int):
    def run(iterator):
        for batch in iterator:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                level = Level(_unpacked(blob.as_py()), length, target)
                bounds = level.bounds(buckets)
                full = np.flatnonzero(np.diff(bounds))
                cut = lambda v: [_planes(v[bounds[b] : bounds[b + 1]]) for b in full.tolist()]  # noqa: B023, E731
                none = [None] * len(full)
                cols = [pa.array(full), pa.array([block] * len(full), pa.int64()), pa.array(cut(level.key), pa.binary()), pa.array(cut(level.extra) if level.exact else none, pa.binary()), pa.array(cut(level.least) if level.exact else none, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "hashes", "extras", "least"])

    return run


def _answer(rows: list[tuple], exact: bool) -> tuple[list, list[bytes]]:
    """For each block one bit a hash: whether another block has it; at the target level then one more: with a smaller id."""
    parts = [_from_planes(r[1], U) for r in rows]
    sizes = np.array([len(p) for p in parts])
    h = np.concatenate(parts)
    e = np.concatenate([_from_planes(r[2], np.uint32) for r in rows]) if exact else None
    order = np.lexsort((e, h)) if exact else np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    if exact:
        e = e[order]
        same &= e[1:] == e[:-1]
    bits = [np.empty(len(h), bool)]
    bits[0][order] = np.append(False, same) | np.append(same, False)
    if exact:
        least = np.concatenate([_from_planes(r[3], np.int64) for r in rows])
        new = np.append(True, ~same)
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        bits.append(np.empty(len(h), bool))
        bits[1][order] = lowest[np.cumsum(new) - 1] < least[order]
    ends = np.cumsum(sizes)
    return [r[0] for r in rows], [b"".join(np.packbits(bit[a:b]).tobytes() for bit in bits) for a, b in zip(ends - sizes, ends)]


def _replies(exact: bool):
    def run(iterator):
        key, rows = None, []

        def done():
            blocks, bits = _answer(rows, exact)
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([key] * len(blocks), pa.int64()), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

        for batch in iterator:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "hashes", "extras", "least"))):
                if bucket != key and rows:
                    yield done()
                    rows = []
                key = bucket
                rows.append(row)
        if rows:
            yield done()

    return run


def _kept(gone: np.ndarray | None, text: bytes) -> bytes:
    if gone is None:
        return b" ".join(text.split())
    return b" ".join(compress(text.split(), (~gone).tolist()))


def _advance(length: int, following: int | None, target: int, buckets: int, digest: bool):
    """Blocks and their bits to (kind, block, blob): kind 0 results, 1 results of the target level, 2 the next level's blocks."""

    def results(t: pa.Table, words: Words, docs: np.ndarray, gone: np.ndarray) -> bytes:
        texts = t.column(_TEXT)
        n_words, n_removed, kept = [], [], []
        for d in docs.tolist():
            a, b = int(words.offsets[d]), int(words.offsets[d + 1])
            lost = int(gone[a:b].sum())
            n_words.append(b - a)
            n_removed.append(lost)
            if digest:
                kept.append(hashlib.sha256(_kept(gone[a:b] if lost else None, (texts[d].as_py() or "").encode())).hexdigest())
            else:
                kept.append(_kept(gone[a:b], texts[d].as_py().encode()).decode() if lost else texts[d].as_py())
        out = t.drop_columns([c for c in (_IDS, _TEXT, _LONGEST, _CANDIDATES) if c in t.column_names]).take(pa.array(docs))
        counts = [("\0n_words", n_words, pa.int64()), ("\0n_removed", n_removed, pa.int64())] if digest else []
        for name, values, kind in (*counts, ("\0kept", kept, pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        return _packed(out)

    def run(iterator):
        for batch in iterator:
            for block, blob, replies in zip(batch.column("block").to_pylist(), batch.column("blob"), batch.column("replies").to_pylist()):
                t = _unpacked(blob.as_py())
                level = Level(t, length, target)
                words = level.words
                hit, lost = level.repeated({r["bucket"]: r["bits"] for r in replies or []}, buckets)
                gone = np.zeros(len(words.starts), bool)
                rows = []
                if level.length < target:
                    good = np.zeros(len(words.starts), bool)
                    good[level.places[hit]] = True
                    following_places = level.first[good[level.chosen]]
                    doc = np.searchsorted(words.offsets, following_places, "right") - 1
                    open_ = np.unique(doc)
                    closed = np.setdiff1d(np.arange(words.n_docs), open_)
                    if len(closed):
                        rows.append((0, results(t, words, closed, gone)))
                else:
                    if level.exact:
                        gone[flat_ranges(level.places[lost], np.full(int(lost.sum()), length))] = True
                        rows.append((0, results(t, words, np.arange(words.n_docs), gone)))
                    longest = level.ids[np.unique(level.doc[hit])]
                    if len(longest):
                        rows.append((1, _packed(pa.table({"doc_id": pa.array(longest, pa.int64()), "longest": pa.array(np.full(len(longest), length))}))))
                    following_places = doc = np.zeros(0, np.int64)
                    if following:
                        # A window of the next length needs both its halves; overlapping ones if it is less than twice as long.
                        good = np.zeros(len(words.starts) + following, bool)
                        good[level.places[hit]] = True
                        at = np.flatnonzero(good)
                        at = at[good[at + following - length]]
                        d = np.searchsorted(words.offsets, at, "right") - 1
                        fits = at + following <= words.offsets[d + 1]
                        following_places, doc = at[fits], d[fits]
                    open_ = np.unique(doc)
                if following and len(open_):
                    n = np.bincount(doc, minlength=words.n_docs)[open_]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array((following_places - words.offsets[doc]).astype(np.int32)))
                    part = t.drop_columns([c for c in (_CANDIDATES,) if c in t.column_names]).take(pa.array(open_))
                    rows.append((2, _packed(part.append_column(_CANDIDATES, lists))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "block", "blob"])

    return run


def remove_repeats(docs: DataFrame, target: int = 13, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(every row of ``docs`` without its repeated words, lengths of the repeats).

    The first has the columns of ``docs`` with the kept text, unchanged where nothing went; with ``digest``,
    ``doc_id, n_words, n_removed, kept_sha256``. The second has ``doc_id, longest`` for documents with a window that
    repeats in another document: the largest of ``target``, twice the target, four times ... of which that holds.
    """
    spark = docs.sparkSession
    columns = docs.columns
    plain = [f"c{k}" for k in range(len(columns))]
    source = docs.select(*[docs[c].alias(p) for c, p in zip(columns, plain)], docs[text_col].cast("string").alias("text"), docs[id_col].cast("bigint").alias("id"))
    # The text travels once, as what is searched.
    keep = [] if digest else [p for c, p in zip(columns, plain) if c != text_col]
    source = source.select(*keep, "text", "id")

    def blocks(iterator):
        for t in batches(iterator, block_bytes):
            ids = pa.compute.fill_null(t.column("id"), NO_ID)
            texts = t.column("text").cast(pa.large_string())
            names = keep + (["id"] if digest else [])
            packed = pa.table([*(t.column(c) for c in names), ids, texts], names=[*names, _IDS, _TEXT])
            yield pa.RecordBatch.from_arrays([pa.array([_packed(packed)], pa.binary()), pa.array([int(pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0)], pa.int64())], names=["blob", "n_bytes"])

    scratch = Scratch(spark, "blocks")
    stored = scratch.written(source.mapInArrow(blocks, "blob binary, n_bytes bigint").withColumn("block", F.monotonically_increasing_id()), "blocks", "uncompressed")
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    # About a million hashes a bucket, and at least as many buckets as tasks.
    buckets = int(max(shuffle_partitions(spark), total // 6 // 1_000_000))

    done, repeats = [], []
    length, state, origin = (target + 1) // 2, stored.select("block", "blob"), scratch.path
    while True:
        following = target if length < target else 2 * length
        asked = state.mapInArrow(_requests(length, target, buckets), "bucket bigint, block bigint, hashes binary, extras binary, least binary")
        asked = asked.repartition(F.col("bucket")).sortWithinPartitions("bucket")
        replies = asked.mapInArrow(_replies(length == target), "block bigint, bucket bigint, bits binary")
        gathered = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
        moved = state.join(gathered, "block", "left").select("block", "blob", "replies").mapInArrow(_advance(length, following, target, buckets, digest), "kind int, block bigint, blob binary")
        path = shared_dir(spark, f"level-{length}")
        with small_batches(spark):
            moved.write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
        # What led to this level will not be read again.
        drop_paths(spark, origin)
        level = spark.read.schema("block bigint, blob binary, kind int").parquet(path)
        if length <= target:
            done.append(level.where("kind = 0").select("blob"))
        if length >= target:
            repeats.append(level.where("kind = 1").select("blob"))
        state, origin = level.where("kind = 2").select("block", "blob"), f"{path}/kind=2"
        if length >= target and state.isEmpty():
            break
        length = following
    drop_paths(spark, origin)

    def unpack(names):
        def run(iterator):
            for batch in iterator:
                for blob in batch.column("blob"):
                    yield from _unpacked(blob.as_py()).rename_columns(names).to_batches()

        return run

    results = done[0]
    for d in done[1:]:
        results = results.unionByName(d)
    if digest:
        cleaned = results.mapInArrow(unpack(["doc_id", "n_words", "n_removed", "kept_sha256"]), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    else:
        schema = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, columns) if p in keep)
        cleaned = results.mapInArrow(unpack([*keep, "kept"]), f"{schema}, kept string" if keep else "kept string")
        cleaned = cleaned.select(*[(F.col("kept") if c == text_col else F.col(p)).alias(c) for c, p in zip(columns, plain)])
    lengths = repeats[0]
    for part in repeats[1:]:
        lengths = lengths.unionByName(part)
    lengths = lengths.mapInArrow(unpack(["doc_id", "longest"]), "doc_id bigint, longest bigint")
    return cleaned, lengths.where(F.col("doc_id") < NO_ID).groupBy("doc_id").agg(F.max("longest").alias("longest"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, lengths = remove_repeats(id_text(table(spark, sf_dir, "documents")), target=13, digest=True)
    return cleaned.join(lengths, "doc_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("bigint")))


def _longest_sql(levels: int = 12) -> str:
    """CTEs r0, r1, ...: the windows of 13, 26, ... words by a hash of their halves, in texts that have a repeated one."""
    text = "h0 AS (SELECT doc_id, p, hash(g) AS h FROM p)"
    for k in range(levels):
        text += f", r{k} AS MATERIALIZED (SELECT doc_id, p, h FROM h{k} WHERE h IN (SELECT h FROM h{k} GROUP BY h HAVING count(DISTINCT doc_id) > 1))"
        text += f", h{k + 1} AS (SELECT a.doc_id, a.p, hash(a.h, b.h) AS h FROM r{k} AS a JOIN r{k} AS b ON a.doc_id = b.doc_id AND b.p = a.p + {13 << k})"
    return text + ", z AS (SELECT doc_id, max(n) AS longest FROM (" + " UNION ALL ".join(f"SELECT doc_id, {13 << k} AS n FROM r{k}" for k in range(levels)) + ") GROUP BY doc_id)"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM p JOIN m USING (g) WHERE low < doc_id),
k AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
{_longest_sql()},
f AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x,
      CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM f LEFT JOIN z USING (doc_id)
"""

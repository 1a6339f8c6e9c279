"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams the one with the smallest hash (the rightmost on ties) is a fingerprint, in
documents and in benchmark items alike, so a shared span of ``window`` words or more always shares a fingerprint
at the same relative place. Matching fingerprints are extended word by word in both directions, on the words
themselves; the extended span counts when it is at least ``window`` words long. An item of fewer words than the
window is one window of its own and is looked up by the hash of all its words.

A benchmark of at most ``max_broadcast_bytes`` of text is sent to every task. A larger one is joined by shuffles, with the same
rows as a result: fingerprints tell which documents share one with any item; of those the windows around the shared
fingerprints are joined with the items' distinct windows, and overlapping hits extend each other. No item's text
travels, and a window that many items share is one row a document until the items are listed.

Defined cases: null and empty texts have no words (n_words 0, not contaminated; an item without words is skipped);
repeated rows are judged each on its own; items repeated under one id count once, items with a null id hit words but
are not listed; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, id_text, table, written
from arbora.llm._text import ALNUM, U, Words, least_in_window, words_of

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<bigint>, spans array<struct<first:bigint,length:bigint>>"


def fingerprints(words: Words, window: int, k: int) -> np.ndarray:
    """Word places whose k-gram is a fingerprint of its document, ascending."""
    n = len(words.starts)
    if n < window:
        return np.zeros(0, np.int64)
    grams = words.run_hash(np.arange(n - k + 1), k)
    wide = window - k + 1
    first, _ = words.runs(window)
    return np.unique(least_in_window(grams, first, wide, last=True))


class Benchmark:
    """An index of items: fingerprints of the long ones, whole hashes of the short ones."""

    def __init__(self, ids: list, texts: pa.Array, window: int, k: int):
        self.ids, self.window, self.k = ids, window, k
        self.words = words_of(texts, ALNUM, lower=True)
        counts = self.words.counts()
        doc = self.words.doc_of_word()
        places = fingerprints(self.words, window, k)
        keys = self.words.run_hash(places, k) if len(places) else np.zeros(0, U)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places, self.items = keys[order], places[order], doc[places][order]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((counts > 0) & (counts < window)).tolist():
            at = self.words.offsets[i : i + 1]
            self.short[int(counts[i])][int(self.words.run_hash(at, int(counts[i]))[0])].append(i)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys >> U(48)).astype(np.int64)] = True

    def spans(self, words: Words) -> dict[int, set[tuple[int, int, int]]]:
        """By document: (first word in the batch, length, item) of every hit span."""
        found: dict[int, set] = defaultdict(set)
        if len(self.keys):
            places = fingerprints(words, self.window, self.k)
            h = words.run_hash(places, self.k) if len(places) else np.zeros(0, U)
            some = self.seen[(h >> U(48)).astype(np.int64)]
            places, h = places[some], h[some]
            left, right = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
            hit = right > left
            docs = np.searchsorted(words.offsets, places, "right") - 1
            done: set = set()
            for p, d, a, b in zip(places[hit].tolist(), docs[hit].tolist(), left[hit].tolist(), right[hit].tolist()):
                for j in range(a, b):
                    self._extend(words, p, d, int(self.places[j]), int(self.items[j]), found[d], done)
        for n, by_hash in self.short.items():
            first, docs = words.runs(n)
            h = words.run_hash(first, n)
            hit = np.isin(h, np.fromiter(by_hash, U, len(by_hash)))
            for p, d, key in zip(first[hit].tolist(), docs[hit].tolist(), h[hit].tolist()):
                for i in by_hash[key]:
                    at = int(self.words.offsets[i])
                    if all(words.word(p + x) == self.words.word(at + x) for x in range(n)):
                        found[d].add((p, n, i))
        return found

    def _extend(self, words: Words, p: int, d: int, q: int, i: int, out: set, done: set) -> None:
        low, high = int(words.offsets[d]), int(words.offsets[d + 1])
        item_low, item_high = int(self.words.offsets[i]), int(self.words.offsets[i + 1])
        if any((i, p - q, x) in done for x in range(p, p + self.k)):
            return
        a, b = p, p
        while b < high and q + b - p < item_high and words.word(b) == self.words.word(q + b - p):
            b += 1
        while a > low and q + a - 1 - p >= item_low and words.word(a - 1) == self.words.word(q + a - 1 - p):
            a -= 1
        if b > a:
            done.update((i, p - q, x) for x in range(a, b))
        if b - a >= self.window:
            out.add((a, b - a, i))

    def judge(self, t: pa.Table) -> pa.RecordBatch:
        words = words_of(t.column("text"), ALNUM, lower=True)
        found = self.spans(words)
        counts = words.counts()
        hit, ids, spans, shas = np.zeros(len(counts), np.int64), [[]] * len(counts), [[]] * len(counts), [hashlib.sha256(b"").hexdigest()] * len(counts)
        for d, hits in found.items():
            base = int(words.offsets[d])
            mark = np.zeros(int(counts[d]) + 2, np.int8)
            for a, n, _ in hits:
                mark[a - base + 1 : a - base + n + 1] = 1
            hit[d] = int(mark.sum())
            ids[d] = sorted({self.ids[i] for *_, i in hits} - {None}, key=str)
            shas[d] = hashlib.sha256(",".join(map(str, ids[d])).encode()).hexdigest()
            edges = np.flatnonzero(np.diff(mark)).reshape(-1, 2)
            spans[d] = [{"first": a, "length": b - a} for a, b in edges.tolist()]
        span = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
        cols = [t.column("doc_id").combine_chunks(), pa.array(counts.astype(np.int64)), pa.array(hit), pa.array([len(x) for x in ids], pa.int64()), pa.array(shas), pa.array(hit > 0), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"])


def _broadcast_items(benchmark: DataFrame, most_bytes: int):
    """(items, their broadcast): the broadcast is None where the texts are larger than ``most_bytes``."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > most_bytes:
        return items, None
    rows = items.orderBy("item_id", "text").collect()
    return items, benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))


def _pairs_of_hashes(words: Words, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return words.run_hash(first, length).view(np.int64), words.run_hash(first, length, lane=1).view(np.int64)


def _item_windows(window: int, k: int):
    """Task function: the windows of items by 128 bits of hash, with the keys of their fingerprints (null but at one window each)."""

    def run(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            counts = words.counts()
            ids = t.column("item_id").combine_chunks()
            for n in [window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()]:
                first, doc = words.runs(n)
                if n < window:
                    first, doc = first[counts[doc] == n], doc[counts[doc] == n]
                x, y = _pairs_of_hashes(words, first, n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(len(first), n)), pa.array(x), pa.array(y)], names=["item_id", "n", "x", "y"])

    return run


def _item_keys(window: int, k: int):
    """Task function: (words, key) of every fingerprint and of every short item as a whole."""

    def run(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            counts = words.counts()
            places = fingerprints(words, window, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), window)), pa.array(words.run_hash(places, k).view(np.int64))], names=["n", "key"])
            for n in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
                first = words.offsets[:-1][counts == n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n)), pa.array(words.run_hash(first, n).view(np.int64))], names=["n", "key"])

    return run


def _shared(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """``doc_id, text_key`` and the columns of ``RESULT`` by shuffled joins."""
    docs = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    item_keys = items.mapInArrow(_item_keys(window, k), "n bigint, key bigint").distinct()
    item_keys = written(item_keys, "item-keys")
    lengths = [r["n"] for r in item_keys.select("n").distinct().collect()]  # at most ``window`` numbers
    short = sorted(n for n in lengths if n < window)

    def keys(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            places = fingerprints(words, window, k)
            parts = [(np.searchsorted(words.offsets, places, "right") - 1, words.run_hash(places, k))]
            for n in short:
                first, d = words.runs(n)
                parts.append((d, words.run_hash(first, n)))
            doc, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(doc) else np.zeros(0, bool)
            doc, key = doc[new], key[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(t.num_rows + 1)).astype(np.int32)), pa.array(key))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("text_key").combine_chunks(), pa.array(words.counts().astype(np.int64)), lists], names=["doc_id", "text_key", "n_words", "keys"])

    # Equal texts meet the benchmark once, whatever their ids.
    counted = written(docs.mapInArrow(keys, "doc_id bigint, text_key string, n_words bigint, keys array<bigint>"), "doc-keys")
    met = counted.select("text_key", F.explode("keys").alias("key")).distinct().join(item_keys.select("key").distinct(), "key")
    met = met.groupBy("text_key").agg(F.collect_set("key").alias("keys"))

    def windows(iterator):
        for t in batches(iterator):
            words = words_of(t.column("text"), ALNUM, lower=True)
            own = t.column("keys").combine_chunks()
            wanted = np.unique(own.flatten().to_numpy(zero_copy_only=False)).view(U)
            places = fingerprints(words, window, k)
            places = places[np.isin(words.run_hash(places, k), wanted)]
            near = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(near, np.maximum(places - (window - k), 0), 1)
            np.add.at(near, places + 1, -1)
            at, doc = words.runs(window)
            some = np.cumsum(near)[at] > 0
            found = [(at[some], doc[some], window)]
            for n in short:
                at, doc = words.runs(n)
                some = np.isin(words.run_hash(at, n), wanted)
                found.append((at[some], doc[some], n))
            for at, doc, n in found:
                x, y = _pairs_of_hashes(words, at, n)
                yield pa.RecordBatch.from_arrays([t.column("text_key").combine_chunks().take(pa.array(doc)), pa.array(at - words.offsets[doc]), pa.array(np.full(len(at), n)), pa.array(x), pa.array(y)], names=["text_key", "place", "n", "x", "y"])

    item_windows = written(items.mapInArrow(_item_windows(window, k), "item_id bigint, n bigint, x bigint, y bigint").distinct(), "item-windows")
    candidates = docs.join(met, "text_key").mapInArrow(windows, "text_key string, place bigint, n bigint, x bigint, y bigint")
    hits = written(candidates.join(item_windows.select("n", "x", "y").distinct(), ["n", "x", "y"]).distinct(), "hits")
    marks = hits.groupBy("text_key").agg(F.expr("array_sort(array_distinct(flatten(transform(collect_set(struct(place, n)), v -> sequence(v.place, v.place + v.n - 1)))))").alias("w"))
    # A word that no hit word precedes begins a span, one that none follows ends it.
    runs = "filter(w, (v, i) -> i = 0 or w[i - 1] <> v - 1)"
    ends = "filter(w, (v, i) -> i = size(w) - 1 or w[i + 1] <> v + 1)"
    marks = marks.select("text_key", F.size("w").cast("bigint").alias("n_hit"), F.expr(f"zip_with({runs}, {ends}, (a, b) -> struct(a as first, b - a + 1 as length))").alias("spans"))
    named = hits.select("text_key", "n", "x", "y").distinct().join(item_windows.where("item_id is not null"), ["n", "x", "y"]).select("text_key", "item_id").distinct()
    named = named.groupBy("text_key").agg(F.expr("array_sort(collect_set(item_id), (a, b) -> case when cast(a as string) < cast(b as string) then -1 when a = b then 0 else 1 end)").alias("item_ids"))
    joined = counted.drop("keys").join(marks.join(named, "text_key", "left"), "text_key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), ids.alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,length:bigint>>")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Hits of benchmark windows in every document; see ``RESULT`` for the columns, ``spans`` are the runs of hit words."""
    docs = id_text(docs)
    items, kept = _broadcast_items(benchmark, max_broadcast_bytes)
    if kept is None:
        return _shared(docs, items, window, k).drop("text_key")

    def judge(iterator):
        index = Benchmark(kept.value[0], pa.array(kept.value[1], pa.string()), window, k)
        for t in batches(iterator):
            yield index.judge(t)

    return docs.mapInArrow(judge, RESULT)


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, max_broadcast_bytes: int = 32 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window of the benchmark hits."""
    columns = docs.columns
    plain = [f"c{n}" for n in range(len(columns))]
    # Inner names that no column of the input has.
    rows = docs.select(*[docs[c].alias(p) for c, p in zip(columns, plain)], docs[text_col].cast("string").alias("text"))
    items, kept = _broadcast_items(benchmark, max_broadcast_bytes)
    if kept is not None:
        rows = rows.drop(plain[columns.index(text_col)])
        names = [p for p in plain if p in rows.columns]

        def keep(iterator):
            index = Benchmark(kept.value[0], pa.array(kept.value[1], pa.string()), window, k)
            for t in batches(iterator):
                clean = pa.compute.invert(index.judge(pa.table({"doc_id": pa.nulls(t.num_rows, pa.int64()), "text": t.column("text")})).column("contaminated"))
                yield from t.filter(clean).to_batches()

        clean = rows.select(*names, "text").mapInArrow(keep, rows.select(*names, "text").schema)
        return clean.select(*[F.col("text" if c == text_col else p).alias(c) for c, p in zip(columns, plain)])
    found = _shared(rows.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), items, window, k)
    bad = found.where("contaminated").select("text_key").distinct()
    clean = rows.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")))).join(bad, "text_key", "left_anti")
    return clean.select(*[F.col(p).alias(c) for c, p in zip(columns, plain)])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, list(item_id ORDER BY CAST(item_id AS VARCHAR)) AS item_ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(item_ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

"""Conversation trie, vector codes and streaming deduplication: brute force, edge cases, several shards, batches and calls."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import conversation_trie, streaming_dedup, vector_codes
from arbora.llm._spark import shared_dir
from tests.compare import connect, rows_of_spark, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# The trie.


def rebuilt_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    turns = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - int(np.fmod(c, 20)), [])[: h[c]] + own[h[c] :] for c, own in turns.items()}


def trie_by_hand(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[q] for q in below), saved, sha(",".join(map(str, sorted(ends[p]))))))
    return sorted(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def collected(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def talk():
    """Shared starts, whole copies, a long conversation, absent donors, nulls, ties, repeated rows, negative ids."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 90), *range(105, 119), -3, -20, -27, 1000]:
        for i in range(rng.randrange(1, 6)):
            rows.append((c, i, "user" if i % 2 == 0 else "assistant", " ".join(rng.choice("ab") for _ in range(rng.randrange(4)))))
    rows += [(c, i, "user", "same  old\tstory") for c in range(200, 260) for i in range(4)]
    rows += [(300, i, "x", "long " * (i % 3)) for i in range(150)]
    rows += [(301, None, None, None), (301, None, "a", None), (301, 3, None, "x"), (301, 3, "b", "y"), (301, 3, "b", "y"), (None, 1, "user", "of nobody"), (302, 1, "user", "word " * 200_000)]
    rng.shuffle(rows)
    return rows


def test_trie_by_brute_force(spark, talk):
    clash = {c: F.lit("x") for c in ("words", "path", "shard", "k1", "depth", "first")}
    frame = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string").withColumns(clash).repartition(3)
    paths = conversation_trie.rebuilt(conversation_trie.paths_of(frame))
    assert collected(conversation_trie.trie(paths).fillna(-1, "parent_conv_id"), TRIE) == [(*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in trie_by_hand(rebuilt_by_hand(talk))]


def test_trie_over_many_shards(spark, talk, monkeypatch):
    """A shard of a few turns: copies, the root and shared starts span shards, which fold in several rounds."""
    monkeypatch.setattr(conversation_trie, "FAN", 3)
    frame = spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")
    paths = conversation_trie.rebuilt(conversation_trie.paths_of(frame))
    found = conversation_trie.trie(paths, shard_turns=30).fillna(-1, "parent_conv_id")
    assert collected(found, TRIE) == [(*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in trie_by_hand(rebuilt_by_hand(talk))]


def test_trie_hashes_anew_after_a_clash(spark, talk, monkeypatch):
    right = conversation_trie.prefixes

    def weak(t1, t2, lengths, seed):
        k1, k2, depth = right(t1, t2, lengths, seed)
        return (k1, k2, depth) if seed else (k1 & np.uint64(7), k2 & np.uint64(1), depth)

    few = [r for r in talk if r[0] is not None and 0 <= r[0] < 90]
    frame = spark.createDataFrame(few, "conv_id bigint, turn bigint, role string, text string")
    paths = conversation_trie.paths_of(frame)
    wanted = collected(conversation_trie.trie(paths).fillna(-1, "parent_conv_id"), TRIE)
    monkeypatch.setattr(conversation_trie, "prefixes", weak)
    assert collected(conversation_trie.trie(paths).fillna(-1, "parent_conv_id"), TRIE) == wanted


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([(None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.paths_of(frame))).count() == 0
    assert conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.paths_of(frame.limit(0)))).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    index = conversation_trie.PerfectHash(a, b)
    assert sorted(index.slots(a, b).tolist()) == list(range(20_000))
    assert (index.slots(a[:0], b[:0]) == []).all() and conversation_trie.PerfectHash(a[:0], b[:0]).size == 0


def test_op11_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(conversation_trie.op11_conversation_trie(spark, folder)) == rows_of_sql(connect(folder), conversation_trie.OP11_SQL)


# Vector codes.


def codes_by_hand(vectors, n_parts, n_entries, rounds):
    """``vectors`` are (id, integers) in order of id."""
    wide = len(vectors[0][1]) // n_parts
    parts = [[v[s * wide : (s + 1) * wide] for s in range(n_parts)] for _, v in vectors]
    books = [[p[s] for p in parts[:n_entries]] for s in range(n_parts)]
    apart = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    for k in range(rounds + 1):
        found = [[min((apart(p[s], e), i) for i, e in enumerate(books[s])) for s in range(n_parts)] for p in parts]
        if k < rounds:
            for s in range(n_parts):
                for i in range(len(books[s])):
                    own = [p[s] for p, f in zip(parts, found) if f[s][1] == i]
                    if own:
                        books[s][i] = [sum(x) // len(own) for x in zip(*own)]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(v[0], "".join("%02x" % i for _, i in f), sum(d for d, _ in f), digest) for v, f in zip(vectors, found)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    return rows + [(300 + i, rows[7][1]) for i in range(40)] + [(340 + i, [0.0] * 8) for i in range(5)]


@pytest.mark.parametrize("n_entries, n_pivots", [(256, 8), (16, 3), (64, 1)])
def test_codes_by_brute_force(spark, vectors, n_entries, n_pivots):
    bad = [(None, None), (1, None), (2, [1.0, None] * 4), (3, [float("nan")] * 8), (4, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, None if i is None or i % 3 == 0 else i % 2) for i, v in vectors + bad], "vec_id bigint, embedding array<float>, label int")
    frame = frame.withColumns({c: F.lit("x") for c in ("x", "part", "entry", "code", "error", "same")}).repartition(3)
    codes = vector_codes.with_label_error(vector_codes.encode(vector_codes.integer_vectors(frame), 2, n_entries, 3, n_pivots))
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    wanted = codes_by_hand(whole, 2, n_entries, 3)
    assert collected(codes, ("vec_id", "code", "error", "codebooks_sha256")) == wanted
    sums = Counter()
    for i, _, error, _ in wanted:
        sums[None if i % 3 == 0 else i % 2] += error
    assert {r["vec_id"]: r["label_error"] for r in codes.collect()} == {i: sums[None if i % 3 == 0 else i % 2] for i, *_ in wanted}


@pytest.mark.parametrize("scale", [1, 1 << 18])
def test_pivots_prune_and_change_nothing(scale):
    """Parts around a few centres; large ones are compared in integers of 64 bits."""
    rng = np.random.default_rng(8)
    parts = (rng.integers(-600, 600, (12, 16))[rng.integers(0, 12, 6000)] + rng.integers(-30, 30, (6000, 16))) * scale
    parts[100:200] = parts[:100]
    entries = parts[:256].copy()  # with ties
    pivots = vector_codes.far_apart(entries, 8)
    index, error, evaluated = vector_codes.nearest(parts, vector_codes.to_pivots(parts, pivots), entries, pivots)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    assert evaluated < 0.5 * d.size


def test_codes_of_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(5, [0.5, -0.5, 1.0, 0.0], "a"), (5, [0.25, -0.5, 1.0, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], None)], "vec_id bigint, embedding array<double>, label string")
    found = collected(vector_codes.encode(vector_codes.integer_vectors(frame), rounds=0).where("vec_id is not null"), ("code", "error"))
    assert found == [("00000000", 0), ("01000000", 0)]
    assert vector_codes.encode(vector_codes.integer_vectors(frame)).count() == 3
    assert vector_codes.with_label_error(vector_codes.encode(vector_codes.integer_vectors(frame.limit(0)))).count() == 0


@pytest.mark.parametrize("wrong", [[1.0] * 5, [1.0] * 8, [1e30] * 4, []])
def test_vectors_that_cannot_be_coded(spark, wrong):
    frame = spark.createDataFrame([(1, [1.0] * 4, 1), (2, wrong, 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError):
        vector_codes.encode(vector_codes.integer_vectors(frame))


def test_op12_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(vector_codes.op12_vector_codes(spark, folder)) == rows_of_sql(connect(folder), vector_codes.OP12_SQL)


# Streaming deduplication.

DEDUP = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup_by_hand(rows):
    """Of rows that repeat the smallest id one is kept, so those are told apart by their number only."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), k == ids.index(keep), sha(body)) for k, i in enumerate(ids)]
    return Counter(out)


def texts():
    rng = random.Random(2)
    base = [" ".join(rng.choice(["a", "b", "ü漢", "long"]) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(150)] + [(200 + i, "hot  text") for i in range(90)]
    rows += [(300, None), (301, ""), (302, " "), (303, "\n\t\x0b \x0c\r"), (None, "hot text"), (None, "only here"), (None, None), (5, "hot\ttext"), (5, "hot text"), (310, "w " * 3_000_000), (311, "w\n" * 3_000_000)]
    return rows + [(320, "a\x00b"), (321, "a b"), (322, "a b"), (323, "a\x1fb")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_dedup_by_brute_force(spark, digest_bytes):
    """With one byte of digest nearly all texts share their key with others, and the bytes decide."""
    clash = {c: F.lit("x") for c in ("path", "row", "digest", "keep_id", "n", "body", "kept")}
    path = shared_dir(spark, "dedup-rows")
    spark.createDataFrame(texts(), "doc_id bigint, text string").withColumns(clash).repartition(5).write.parquet(path)
    assert Counter(collected_any(streaming_dedup.deduplicate(spark, path, digest_bytes=digest_bytes))) == dedup_by_hand(texts())


def collected_any(df):
    return [tuple(r) for r in df.select(*DEDUP).collect()]


def test_dedup_goes_on_from_its_state(spark):
    """Small micro-batches, and later files: state, log and progress are those of the calls before."""
    path, home = shared_dir(spark, "dedup-rows"), shared_dir(spark, "dedup-home")
    rows = [r for r in texts() if r[0] not in (310, 311)]
    spark.createDataFrame(rows[100:], "doc_id bigint, text string").repartition(4).write.parquet(path)
    first = streaming_dedup.deduplicate(spark, path, home, batch_bytes=1)
    assert Counter(collected_any(first)) == dedup_by_hand(rows[100:])
    spark.createDataFrame(rows[:100], "doc_id bigint, text string").repartition(2).write.mode("append").parquet(path)
    second = streaming_dedup.deduplicate(spark, path, home, batch_bytes=1)
    assert Counter(collected_any(second)) == dedup_by_hand(rows)
    assert streaming_dedup.state_table(spark, home).agg(F.sum("n")).first()[0] == len(rows)
    assert Counter(collected_any(streaming_dedup.deduplicate(spark, path, home))) == dedup_by_hand(rows)


def test_dedup_of_nothing_and_of_one_file(spark):
    path = shared_dir(spark, "dedup-rows")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(path)
    assert streaming_dedup.deduplicate(spark, path).count() == 0
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(streaming_dedup.op13_streaming_dedup(spark, folder)) == rows_of_sql(connect(folder), streaming_dedup.OP13_SQL)

"""Trie of the prefixes of conversations, as minimal-perfect-hash node tables with flat arrays.

1. A turn is a digest of role and text and its number of words; texts go no further. A conversation is the list of its
   turns' digests in order, one row.
2. Conversations are sorted by their lists of digests over ranges, so that a prefix's conversations are neighbours; a range is a
   shard. Copies of one conversation are told apart by their ids, so any number of them is cut into ranges like others.
3. A shard enumerates its prefixes as 128-bit hashes and builds a minimal perfect hash over the distinct ones. Each slot keeps its
   prefix's hash, last turn and parent, and every occurrence is compared with them; by induction equal slots have
   equal turns all the way. Should one differ, all is hashed anew with another seed.
4. Counts are scattered into flat arrays by slot, and sums over subtrees go from slot to parent slot, deepest first.
5. Only prefixes of a shard's first or last conversation can go on in a neighbour. These few rows of partial counts are folded in the same way, ``FAN``
   neighbouring shards at a time, then so many of the results, until one is left. All others are final in their shard.

A shard is bounded by ``SHARD_TURNS`` turns or one conversation (about 150 bytes a turn), a fold by the turns of ``2 * FAN`` conversations. The list of ids whose
conversation is one and the same whole prefix is hashed in its shard, or, where it spans shards, from a piece a shard (8 bytes an id or so).

Defined cases: rows without ``conv_id`` belong to no conversation; null roles and texts are empty; turns of one number go by role, then by
SHA-256 of role and text; a repeated row is a turn each time; other columns are ignored; an empty table gives no nodes, not even a root; a text of any
length counts in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, shuffle_partitions, table, written
from arbora.llm._text import mix, powers

U = np.uint64
SHARD_TURNS = 1 << 20
FAN = 32
SEEDS = 8
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

KEY = ("k1", "k2")
PARENT = ("p1", "p2")
SAME = ("p1", "p2", "depth", "words", "t1", "t2")  #: equal in all occurrences of a prefix
ADDED = ("n", "kids", "leaves", "saved")
COUNTS = (*KEY, *SAME, *ADDED, "conv")
NODE = ", ".join(f"{c} bigint" for c in (*COUNTS, "shard", "parent")) + ", first boolean, last boolean, open boolean, sound boolean, ends string, piece string"


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct pairs of 64-bit keys: levels of bits, where a key has the first bit that it alone falls on."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, before = [], 0
        while len(a):
            bits = np.zeros(2 * len(a), bool)
            at = self._place(a, b, len(self.levels), len(bits))
            alone = np.bincount(at, minlength=len(bits))[at] == 1
            bits[at[alone]] = True
            rank = before + np.cumsum(bits) - 1
            self.levels.append((bits, rank))
            before += int(alone.sum())
            a, b = a[~alone], b[~alone]
        self.size = before

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + U(level * 0x2545F4914F6CDD1D & (1 << 64) - 1))) % U(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of keys; those of other pairs are any slot or -1, so the caller compares what the slot keeps."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def fold(rows: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray, whole: bool) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """The distinct nodes of occurrences ``rows`` (``COUNTS``), and each row's slot; None if two prefixes share a hash.

    A node that lies on the ``first`` or ``last`` path is open unless this is the ``whole`` trie: its counts go on. The others get their
    counts over subtrees: what came with the rows, and what nodes add that are final now.
    """
    a, b = (rows[c].view(U) for c in KEY)
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    index = PerfectHash(a[order][fresh], b[order][fresh])
    slot = index.slots(a, b)
    one = np.empty(index.size, np.int64)
    one[slot[::-1]] = np.arange(len(slot))[::-1]
    nodes = {c: rows[c][one] for c in (*KEY, *SAME)}
    root = nodes["depth"] == 0
    parent = index.slots(*(nodes[c].view(U) for c in PARENT))
    parent[root] = -1
    sound = all((nodes[c][slot] == rows[c]).all() for c in (*KEY, *SAME)) and (parent[~root] >= 0).all()
    if not sound or not all((nodes[k][parent[~root]] == nodes[p][~root]).all() for k, p in zip(KEY, PARENT)):
        return None
    for c in ADDED:
        nodes[c] = np.zeros(index.size, np.int64)
        np.add.at(nodes[c], slot, rows[c])
    nodes["conv"] = np.full(index.size, np.iinfo(np.int64).max)
    np.minimum.at(nodes["conv"], slot, rows["conv"])
    for name, flags in (("first", first), ("last", last)):
        nodes[name] = np.zeros(index.size, bool)
        nodes[name][slot[flags]] = True
    nodes["open"] = (nodes["first"] | nodes["last"]) & (not whole)
    done = ~nodes["open"]
    np.add.at(nodes["kids"], parent[done & ~root], 1)
    leaves = (done & (nodes["kids"] == 0)).astype(np.int64)
    saved = np.where(done, (nodes["n"] - 1) * nodes["words"], 0)
    by_depth = np.argsort(nodes["depth"], kind="stable")
    edges = np.searchsorted(nodes["depth"][by_depth], np.arange(int(nodes["depth"].max(initial=0)) + 2))
    for d in range(len(edges) - 2, 0, -1):
        at = by_depth[edges[d] : edges[d + 1]]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    nodes["leaves"] += leaves
    nodes["saved"] += saved
    # A parent that is still open does not know its smallest member yet.
    nodes["known"] = ~root & done & ~nodes["open"][parent]
    nodes["parent"] = nodes["conv"][parent]
    return nodes, slot


def _batch(nodes: dict[str, np.ndarray], shard: int, ends: list, pieces: list) -> pa.RecordBatch:
    n = len(nodes["n"])
    columns = {c: pa.array(nodes[c]) for c in COUNTS} | {"shard": pa.array(np.full(n, shard, np.int64)), "parent": pa.array(nodes["parent"], mask=~nodes["known"])}
    columns |= {c: pa.array(nodes[c]) for c in ("first", "last", "open")} | {"sound": pa.array(np.ones(n, bool)), "ends": pa.array(ends, pa.string()), "piece": pa.array(pieces, pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def _clash(shard: int) -> pa.RecordBatch:
    numbers = {c: pa.array([0], pa.int64()) for c in COUNTS} | {"shard": pa.array([shard], pa.int64()), "parent": pa.array([None], pa.int64())}
    return pa.RecordBatch.from_pydict(numbers | {c: pa.array([False]) for c in ("first", "last", "open", "sound")} | {c: pa.array([None], pa.string()) for c in ("ends", "piece")})


def prefixes(t1: np.ndarray, t2: np.ndarray, lengths: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each prefix, the empty one first, of consecutive lists with these ``lengths``, and the prefixes' lengths."""
    depth = np.arange(int((lengths + 1).sum())) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    out = []
    for base, turn in zip(_BASES, (t1, t2)):
        values = np.zeros(len(depth), U)
        values[depth > 0] = mix(turn + U(seed))
        values *= powers(U(base), int(depth.max(initial=0)))[depth]
        sums = np.cumsum(values)
        start = np.flatnonzero(depth == 0)
        out.append(mix(sums - np.repeat(sums[start], lengths + 1) + depth.astype(U) * U(0xA0761D6478BD642F)))
    return *out, depth


def shards(paths: DataFrame, seed: int) -> DataFrame:
    """``NODE`` rows of each partition of ``conv_id, path`` rows, which are in order of path, then id, over all partitions."""

    def run(iterator):
        ids, lengths, turns, words, shard = [], [], [], [], 0
        for batch in iterator:
            if batch.num_rows:
                path = batch.column("path")
                flat = path.flatten()
                digest = pa.concat_arrays([flat.field("digest").cast(pa.binary(16))])
                turns.append(np.frombuffer(digest.buffers()[1] or b"", ">u8", 2 * len(digest), 16 * digest.offset).astype(U).reshape(-1, 2))
                words.append(flat.field("words").to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(pa.compute.list_value_length(path).to_numpy(zero_copy_only=False).astype(np.int64))
                ids.append(batch.column("conv_id").to_numpy(zero_copy_only=False))
                shard = batch.column("shard")[0].as_py()
        if not ids:
            return
        ids, lengths, turns, words = (np.concatenate(x) for x in (ids, lengths, turns, words))
        k1, k2, depth = prefixes(turns[:, 0], turns[:, 1], lengths, seed)
        inner = depth > 0
        rows = {"k1": k1.view(np.int64), "k2": k2.view(np.int64), "depth": depth}
        for c, values in (("words", words), ("t1", turns[:, 0].view(np.int64)), ("t2", turns[:, 1].view(np.int64)), ("p1", rows["k1"][:-1][inner[1:]]), ("p2", rows["k2"][:-1][inner[1:]])):
            rows[c] = np.zeros(len(depth), np.int64)
            rows[c][inner] = values
        rows |= {c: np.full(len(depth), int(c == "n"), np.int64) for c in ADDED} | {"conv": np.repeat(ids, lengths + 1)}
        at = np.arange(len(depth))
        found = fold(rows, at <= lengths[0], at >= len(depth) - 1 - lengths[-1], False)
        if found is None:
            yield _clash(shard)
            return
        nodes, slot = found
        # Conversations that are one whole prefix stand together, in order of their ids.
        full = slot[np.cumsum(lengths + 1) - 1]
        edges = np.flatnonzero(np.diff(full, prepend=-1, append=-1))
        ends, pieces = [hashlib.sha256(b"").hexdigest()] * len(nodes["n"]), [None] * len(nodes["n"])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text, k = ",".join(map(str, ids[low:high].tolist())), int(full[low])
            if nodes["open"][k]:
                pieces[k] = text
            else:
                ends[k] = hashlib.sha256(text.encode()).hexdigest()
        yield _batch(nodes, shard, ends, pieces)

    return paths.withColumn("shard", F.spark_partition_id()).mapInArrow(run, NODE)


def folded(open_nodes: DataFrame, whole: bool) -> DataFrame:
    """``NODE`` rows of the open nodes of ``FAN`` neighbouring shards at a time."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        number = lambda c: got.column(c).to_numpy().astype(np.int64)
        rows, shard = {c: number(c) for c in COUNTS}, number("shard")
        flag = lambda c: got.column(c).to_numpy(zero_copy_only=False).astype(bool)
        found = fold(rows, flag("first") & (shard == shard.min()), flag("last") & (shard == shard.max()), whole)
        none = [None] * len(found[0]["n"]) if found else []
        return pa.Table.from_batches([_batch(found[0], key[0].as_py(), none, none) if found else _clash(key[0].as_py())])

    rows = open_nodes.drop("piece", "ends").withColumn("unit", F.expr(f"shard div {FAN}"))
    return rows.groupBy("unit").applyInArrow(run, NODE)


def paths_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: of each conversation the 16-byte digests and numbers of words of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("at"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("at")).select("conv_id", F.expr("transform(at, t -> struct(t.digest as digest, t.words as words))").alias("path"))


def rebuilt(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation begins with up to ``most - 1`` turns, so many as its id's CRC says, of the conversation of the next lower multiple of ``every``."""
    donors = paths.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("donor"), F.expr(f"slice(path, 1, {most - 1})").alias("start"))
    own = paths.select("conv_id", "path", F.expr(f"conv_id - conv_id % {every}").alias("donor"), F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)").alias("h"))
    joined = own.join(donors, "donor", "left")
    return joined.select("conv_id", F.expr("concat(coalesce(slice(start, 1, h), slice(path, 1, 0)), slice(path, h + 1, size(path)))").alias("path"))


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node of the trie of ``conv_id, path`` rows; ``conv_id`` is the node's smallest member."""
    spark = paths.sparkSession
    scratch = Scratch(spark, "trie")
    paths = scratch.written(paths, "paths")
    turns = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-turns // shard_turns))
    for seed in range(SEEDS):
        ordered = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
        levels = [scratch.written(shards(ordered, seed), "nodes")]
        count = (levels[0].agg(F.max("shard")).first()[0] or 0) + 1
        sound = levels[0].where("not sound").isEmpty()
        while sound:
            count = -(-count // FAN)
            levels.append(scratch.written(folded(levels[-1].where("open"), count == 1), "folded"))
            sound = levels[-1].where("not sound").isEmpty()
            if count == 1:
                break
        if sound:
            break
    else:
        raise RuntimeError(f"prefixes share hashes under each of {SEEDS} seeds")
    inner = levels[0].where("not open")
    upper = levels[1].where("not open")
    for level in levels[2:]:
        upper = upper.unionByName(level.where("not open"))
    # What spans shards: ids that end there come in a piece a shard.
    pieces = levels[0].where("piece is not null").groupBy(*KEY).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shard", "piece"))), lambda x: x["piece"]), ","), 256).alias("ends"))
    upper = upper.drop("ends").join(pieces, list(KEY), "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256)))
    upper = scratch.written(upper.select(*KEY, *PARENT, "parent", "conv", "depth", "n", "kids", "leaves", "saved", "ends"), "upper")
    nodes = inner.select(*upper.columns).unionByName(upper)
    asking = nodes.where("parent is null and depth > 0").drop("parent")
    names = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    nodes = nodes.where("parent is not null or depth = 0").unionByName(asking.join(names, list(PARENT)))
    counts = [F.col(a).alias(b) for a, b in (("conv", "conv_id"), ("depth", "depth"), ("parent", "parent_conv_id"), ("n", "n_convs"), ("kids", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"), ("ends", "ends_sha256"))]
    result = written(nodes.select(*counts), "trie")
    scratch.drop()
    return result


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths_of(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha) AS i, sha, words FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, sha, words FROM (
  SELECT c.conv_id, 0 AS own, i, sha, words FROM convs AS c JOIN turns AS t ON t.conv_id = c.donor AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, sha, words FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND i > h)),
places AS MATERIALIZED (SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM convs UNION ALL
  SELECT conv_id, depth, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM rebuilt),
lengths AS (SELECT conv_id, max(depth) AS depth FROM places GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT key, any_value(p.depth) AS depth, left(key, greatest(length(key) - 64, 0)) AS up, min(p.conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '')) AS ends_sha256 FROM places AS p JOIN lengths AS l USING (conv_id) GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
own AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sums AS (SELECT left(key, 64 * d) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * words) AS saved_tokens FROM own, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, parents.conv_id AS parent_conv_id, own.n AS n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (key) LEFT JOIN nodes AS parents ON parents.key = own.up AND own.depth > 0
"""

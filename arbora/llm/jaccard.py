"""Join of documents whose sets of word 5-grams have a Jaccard similarity of at least 0.8, with Bayesian pruning.

1. Each text gets its set of shingles (64-bit hashes of five consecutive words; a text of one to four words is one
   shingle), a MinHash signature and two hashes of the whole set. Texts with equal sets are one entry with a count.
2. Signatures are cut into bands; entries that share a band are joined by a star around the band's smallest
   entry. The stars' connected components only say which entries are brought together; candidates are the pairs that share a
   band. With 32 bands of 4 rows a pair of similarity 0.8 shares none with probability 5e-8.
3. A component is cut into blocks of bounded size, and an entry goes to those pairs of blocks in which an entry of the other block shares a band
   with it. There, MinHash values of the candidates are compared 16 at a time, dropping a pair as soon as the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below ``tolerance``; the pairs that remain are
   verified exactly on the shingle sets.
4. A pair of blocks gives each entry's number of links and the smallest of its connected entries, never the pairs; these
   join to classes, named by the smallest ``doc_id`` among their entries.

No component needs to fit in one task, and no bucket, component or list of partners is capped. Among m texts that all share bands with each
other the work is the square of m, as each of their links is counted, but the rows moved are m times its number of blocks.

Defined cases: null texts and texts without words link to nothing and are classes of their own; a null
``doc_id`` is returned with a null class and no links; repeated rows are copies of each other, and other texts
under the same ``doc_id`` are documents of their own; an empty table
gives an empty result; other columns are ignored.
``keep_one_of_each`` keeps, of each class, the row of smallest ``doc_id`` (of smallest hash of the text, if that id has several texts
of the class), and of rows that repeat its id and text the first by their other columns; rows with a null ``doc_id`` stay.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, batches, id_text, small_batches, table, written
from arbora.llm._text import NOT_SPACE, U, mix, words_of
from arbora.llm.components import look_up, star_components

SHINGLE, BANDS, ROWS, STEP = 5, 32, 4, 16
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, offsets of the texts)."""
    words = words_of(column, NOT_SPACE)
    first, doc = words.runs(size)
    h = words.run_hash(first, size)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = [words.run_hash(words.offsets[i : i + 1], int(counts[i]))[0] for i in short.tolist()]
    h, doc = np.append(h, np.array(extra, U)), np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(words.n_docs + 1))


def set_hashes(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    for salt in (U(0x9E6C63D0876A9A47), U(0xC3A5C85C97CB3127)):
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ salt), out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, HASHES) MinHash values as uint32; a text without shingles has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[full]
        for k in range(HASHES):
            v = ((h ^ _ADD[k]) * _MULTIPLY[k]) >> U(32)
            out[full, k] = np.minimum.reduceat(v.astype(np.uint32), starts)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands; those of different bands differ."""
    rows = sigs.reshape(-1, BANDS, ROWS)
    keys = np.full(rows.shape[:2], U(1))
    for r in range(ROWS):
        keys = mix(keys * U(31) + rows[:, :, r])
    return mix(keys + np.arange(BANDS, dtype=U)[None])


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n MinHash values, the fewest equal ones that leave P(similarity >= threshold) at ``tolerance`` or more.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail is that of a binomial.
    """
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


class Block:
    def __init__(self, ids, copies, sigs, sets):
        self.ids, self.copies = np.array(ids, np.int64), np.array(copies, np.int64)
        self.sigs = sigs
        self.bands = band_keys(sigs)
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def part(self, which: np.ndarray) -> Block:
        return Block(self.ids[which], self.copies[which], self.sigs[which], [self.sets[k] for k in which.tolist()])


def similar(a: Block, b: Block, threshold: Fraction, least: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of the verified pairs; i < j if both are the same block."""
    alive = np.zeros((len(a.ids), len(b.ids)), bool)
    for k in range(BANDS):
        alive |= a.bands[:, None, k] == b.bands[None, :, k]
    small, large = np.minimum(a.sizes[:, None], b.sizes[None]), np.maximum(a.sizes[:, None], b.sizes[None])
    alive &= small * threshold.denominator >= large * threshold.numerator
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(i):
            return i, j
        part = slice(n - STEP, n)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            matches[s] += (a.sigs[i[s], part] == b.sigs[j[s], part]).sum(1)
        keep = matches >= least[n]
        i, j, matches = i[keep], j[keep], matches[keep]
    if not len(i):
        return i, j
    if len(i) > 2000:
        common = _common(a, b, same)[i, j]
    else:
        common = np.array([len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    p, q = threshold.numerator, threshold.denominator
    keep = common * (p + q) >= p * (a.sizes[i] + b.sizes[j])
    return i[keep], j[keep]


def _common(a: Block, b: Block, same: bool, wide: int = 2048) -> np.ndarray:
    """Sizes of all intersections at once, as products of 0/1 matrices over slices of the shingles that several entries have."""
    every = [*a.sets, *([] if same else b.sets)]
    names, code, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    shared = np.cumsum(n > 1) - 1
    several = (n > 1)[code]
    code, row = shared[code[several]], row[several]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((len(a.ids), len(b.ids)), np.float32)  # exact up to 2**24 shingles a product
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
        x, y = np.searchsorted(code, [low, low + wide])
        m = np.zeros((len(every), wide), np.float32)
        m[row[x:y], code[x:y] - low] = 1
        total += m[: len(a.ids)] @ (m if same else m[len(a.ids) :]).T
    return total.astype(np.int64)


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id connected to each place by the pairs (i, j)."""
    root = ids.copy()
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        if (least == root).all():
            break
        root = least
    return root


def _compare(group: pa.Table, a_no: int, b_no: int, threshold: Fraction, least: dict) -> pa.RecordBatch | None:
    """Links and connected entries within one pair of blocks; an entry that the table repeats counts once."""
    ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    block = group.column("block").to_numpy()
    whole = Block(ids, group.column("copies").to_numpy(), sigs, [np.frombuffer(s, U) for s in group.column("shingles").to_pylist()])
    left, right = np.flatnonzero(block == a_no), np.flatnonzero(block == b_no)
    if not len(left) or not len(right):
        return None
    a = whole.part(left)
    b = a if a_no == b_no else whole.part(right)
    i, j = similar(a, b, threshold, least, a is b)
    i, j = left[i], right[j]
    links = np.bincount(i, weights=whole.copies[j], minlength=len(ids)) + np.bincount(j, weights=whole.copies[i], minlength=len(ids))
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(_roots(ids, i, j)[some])], names=["id", "links", "root"])


def _groups(iterator, keys: list[str]):
    """(key, table) for each run of rows with equal ``keys`` over all batches."""
    key, parts = None, []
    for batch in iterator:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        edges = np.flatnonzero(np.append(True, (values[:, 1:] != values[:, :-1]).any(0)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
            own = tuple(values[:, a].tolist())
            if own != key and parts:
                yield key, pa.Table.from_batches(parts).combine_chunks()
                parts = []
            key = own
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts).combine_chunks()


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, block_entries: int = 1024, block_shingles: int = 1_000_000, detail: bool = False) -> DataFrame:
    """``doc_id, class_id, n_links``: the smallest id of the connected documents, and how many documents are linked directly.

    ``detail`` adds ``text_key``, a hash of the text, and ``leads``: whether the row has the smallest id, and of that id's texts in the
    class the one with the smallest hash.
    """
    docs = id_text(docs).withColumn("text_key", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    exact = Fraction(threshold).limit_denominator(10_000)
    least = least_matches(threshold, tolerance)

    def sign(iterator):
        for t in batches(iterator):
            h, offsets = shingle_sets(t.column("text"))
            x, y = set_hashes(h, offsets)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), t.num_rows, [None, pa.py_buffer(signatures(h, offsets))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "text_key")), pa.array(np.diff(offsets)), pa.array(x), pa.array(y), rows], names=["doc_id", "text_key", "n", "set_x", "set_y", "sig"])

    signed = scratch.written(docs.mapInArrow(sign, "doc_id bigint, text_key bigint, n bigint, set_x bigint, set_y bigint, sig binary"), "signatures")
    usable = signed.where("doc_id is not null and n > 0")
    # One entry for each set, which any of its rows describes; its text is found again by its smallest id.
    heads = usable.groupBy("set_x", "set_y").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    heads = scratch.written(heads.select(F.monotonically_increasing_id().alias("id"), "head.*", "set_x", "set_y", "copies", "n", "sig"), "entries")

    def bands_of(iterator):
        for batch in iterator:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(band_keys(sigs).reshape(-1).view(np.int64))], names=["id", "key"])

    bands = scratch.written(heads.select("id", "sig").mapInArrow(bands_of, "id bigint, key bigint"), "bands")
    # Both sides aggregate before they shuffle, and the join's large side can be split where a key is frequent.
    centres = bands.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("other")).where("centre < other").select("key", "centre")
    clusters = star_components(bands.join(centres, "key").select("id", "centre"), scratch)

    members = heads.join(clusters, "id")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("m") / block_entries), F.ceil(F.col("w") / block_shingles)).cast("bigint")).select("root", "blocks")
    members = look_up(members, sizes, "root").withColumn("block", F.expr("pmod(xxhash64(id, 3), blocks)")).select("id", "doc_id", "text_key", "set_x", "set_y", "copies", "sig", "root", "blocks", "block")
    members = scratch.written(members, "members")
    # Blocks in which some entry shares a band with this one.
    placed = bands.join(members.select("id", "block"), "id")
    meets = placed.join(placed.groupBy("key").agg(F.collect_set("block").alias("others")), "key")
    members = members.join(meets.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")), "id")

    def shingles(iterator):
        kept = ["id", "copies", "sig", "root", "block", "others"]
        seen: set = set()  # rows that repeat an entry's text stand together after the join
        for t in batches(iterator):
            h, offsets = shingle_sets(t.column("text"))
            x, y = set_hashes(h, offsets)
            # A doc_id that is repeated with another text of the same hash does not match its entry's set.
            right = np.flatnonzero((x == t.column("set_x").to_numpy()) & (y == t.column("set_y").to_numpy())).tolist()
            ids = t.column("id").to_pylist()
            right = [k for k in right if not (ids[k] in seen or seen.add(ids[k]))]
            blobs = pa.array([h[offsets[k] : offsets[k + 1]].tobytes() for k in right], pa.binary())
            rest = t.select(kept).take(pa.array(right, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in rest.columns), blobs], names=[*kept, "shingles"])

    full = docs.join(members, ["doc_id", "text_key"]).mapInArrow(shingles, "id bigint, copies bigint, sig binary, root bigint, block bigint, others array<bigint>, shingles binary")
    # The pair of blocks is the group.
    dealt = full.withColumn("with", F.explode("others"))
    dealt = dealt.select("root", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "id", "copies", "sig", "shingles")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def compare(iterator):
        for (_, x, y), group in _groups(iterator, ["root", "x", "y"]):
            out = _compare(group, x, y, exact, least)
            if out is not None and out.num_rows:
                yield out

    with small_batches(docs.sparkSession):
        found = scratch.written(dealt.mapInArrow(compare, "id bigint, links bigint, root bigint"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = star_components(found.select("id", F.col("root").alias("centre")), scratch)
    first = F.struct("doc_id", "text_key")
    names = heads.select("id", "doc_id", "text_key").join(classes, "id").groupBy("root").agg(F.min(first).alias("first"))
    named = look_up(classes, names, "root").select("id", "first")
    resolved = heads.select("id", first.alias("own"), "set_x", "set_y", "copies").join(links, "id", "left").join(named, "id", "left")
    resolved = resolved.select("set_x", "set_y", F.coalesce("first", "own").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    judged = usable.select("doc_id", "text_key", "set_x", "set_y").join(resolved, ["set_x", "set_y"])
    judged = judged.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "n_links", (F.col("first") == first).alias("leads"))
    alone = signed.where("doc_id is null or n = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("leads"))
    result = judged.unionByName(alone)
    result = written(result if detail else result.select("doc_id", "class_id", "n_links"), "classes")
    scratch.drop()
    return result


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each class; rows of null id stay (see the module's defined cases)."""
    columns = docs.columns
    plain = [f"c{k}" for k in range(len(columns))]
    # Inner names that no column of the input has.
    rows = docs.select(*[docs[c].alias(p) for c, p in zip(columns, plain)], docs[id_col].cast("bigint").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("key"))
    judged = jaccard_classes(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), threshold, detail=True).where("doc_id is not null")
    fates = judged.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg((~F.bool_and("leads")).alias("loses"), F.count("*").alias("n"))
    fates = written(fates.where("loses or n > 1"), "fates")
    left = rows.join(fates.where("loses").select("id", "key"), ["id", "key"], "left_anti")
    repeated = fates.where("not loses").select("id", "key")
    if not repeated.isEmpty():
        others = F.to_json(F.struct(*[p for c, p in zip(columns, plain) if c != text_col]))
        several = left.join(repeated, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by(F.struct(*plain), others).alias("row")).select("row.*")
        left = left.join(repeated, ["id", "key"], "left_anti").select(*plain).unionByName(several)
    return left.select(*[F.col(p).alias(c) for c, p in zip(columns, plain)])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 9 * c >= 4 * (na.n + nb.n)),
r AS (SELECT doc_id AS v, doc_id AS u FROM w UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT w.doc_id, (SELECT min(u) FROM r WHERE r.v = w.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = w.doc_id) AS n_links FROM w
"""

"""Exact k nearest binary codes by incremental multi-index hashing.

Codes are cut into segments. Two codes within distance d agree in some segment up to d // segments bits, so once all
segments were looked up at radius r every code closer than segments * (r + 1) has been seen. The index is a written table of
blocks of codes, which stay where they are: packets of queries, of bounded size, are broadcast to them with their kth distance so far. In a block, the
segments' values at a radius are enumerated and looked up, and what is found is verified. After each round a query is closed
if its kth verified distance over all blocks is covered; for the others the radius grows. Segments have about as many bits as a full block has codes in
binary digits, so the first radii meet few codes; when the next one would enumerate more than a share of a block, one pass over
all codes finishes the queries that are still open, and covers every distance.

Equal codes are one entry with its k + 1 smallest distinct ids, each as often as it stands there, and equal query codes are answered once.
There is no cap on candidates.

Defined cases: null vectors are left out (neither queries nor answers); null elements count as 0; vectors may have any number of
dimensions, the same in all rows, else it is an error; an id that is repeated with
other vectors is several entries; ties in distance go to the smaller id; a query finds rows of other ids only;
a row that is repeated is an answer as often as it stands there; the rows of a query's id, repeated or with other vectors,
share k answers, the nearest of all their pairs; fewer than k other rows give fewer answers; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, shuffle_partitions, table, written

BLOCK = 1 << 15  #: codes in a block, about
LEAST = 1 << 10  #: and at least, however many tasks there are
PACKET = 1 << 16  #: queries in a packet, about: a few MB
WIDTH = 16  #: bits of a segment
ROUNDS = ((0, 1, 2), (3,))  #: radii looked up a round; those after them would enumerate over a fifth of a block's codes
PAIRS = 1 << 21  #: distances computed at a time
CODE = "array<bigint>"  #: 64 dimensions a number


def sign_codes(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, code``: one bit for each dimension, set where the value is above 0, 64 to a number (the last padded with unset bits)."""
    signs = f"transform(`{vector_col}`, v -> coalesce(cast(v as double), 0D) > 0)"
    words = f"transform(sequence(0, cast(ceil(size(`{vector_col}`) / 64.0) as int) - 1), w -> aggregate(slice({signs}, w * 64 + 1, 64), 0L, (a, v) -> shiftleft(a, 1) | if(v, 1L, 0L)))"
    code = F.when(F.size(vector_col) > 0, F.expr(words)).otherwise(F.array().cast(CODE))
    return embeddings.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), code.alias("code"), F.size(vector_col).alias("dimensions"))


def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with exactly ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _segments(codes: np.ndarray) -> np.ndarray:
    """(codes, segments) values of the segments of (codes, words) unsigned numbers; those of a word from its low bits on."""
    return np.ascontiguousarray(codes).view("<u2").reshape(len(codes), -1)


def lookup(codes: np.ndarray, queries: np.ndarray, s: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, codes) places whose values in segment ``s`` differ in exactly ``radius`` bits; both are (n, segments)."""
    own, asked = np.ascontiguousarray(codes[:, s]), np.ascontiguousarray(queries[:, s])
    if comb(WIDTH, radius) >= len(own):
        found = [np.nonzero(np.bitwise_count(asked[k : k + 256, None] ^ own[None]) == radius) for k in range(0, len(asked), 256)]
        return np.concatenate([q + 256 * k for k, (q, _) in enumerate(found)]), np.concatenate([c for _, c in found])
    order = np.argsort(own, kind="stable")
    values, starts, counts = np.unique(own[order], return_index=True, return_counts=True)
    at = np.full(1 << WIDTH, -1)
    at[values] = np.arange(len(values))
    q_found, c_found = [], []
    for mask in _masks(WIDTH, radius).tolist():
        k = at[asked ^ np.uint16(mask)]
        q = np.flatnonzero(k >= 0)
        n = counts[k[q]]
        q_found.append(np.repeat(q, n))
        c_found.append(order[np.repeat(starts[k[q]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(q_found), np.concatenate(c_found)


def nearest_of(distance: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Places of the nearest entries that hold ``least`` rows, with all that are as far as the last of them."""
    order = np.argsort(distance, kind="stable")
    last = int(np.searchsorted(np.cumsum(weight[order]), least))
    return order if last >= len(order) else order[: int(np.searchsorted(distance[order], distance[order[last]], "right"))]


def _grouped(q: np.ndarray, c: np.ndarray, d: np.ndarray, query: np.ndarray, name: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """``FOUND`` rows of pairs of places ``q`` (ascending) and ``c`` with their distances."""
    edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1)) if len(q) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (name[c], d, weight[c])]
    return pa.RecordBatch.from_arrays([pa.array(query[q[edges[:-1]]]), *lists], names=["query", "entries", "distances", "weights"])


def looked_up(own: np.ndarray, ask: np.ndarray, bound: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of the pairs within ``bound`` whose nearest segments are as far apart as one of ``radii``; both are (n, segments)."""
    q, c = (np.concatenate(x) for x in zip(*[lookup(own, ask, s, r) for s in range(own.shape[1]) for r in radii]))
    key = np.unique(q * len(own) + c)
    q, c = key // len(own), key % len(own)
    apart = np.bitwise_count(ask[q] ^ own[c])
    d = apart.sum(1, dtype=np.int64)
    # What has a nearer segment was found in an earlier round.
    keep = (d <= bound[q]) & (apart.min(1) >= radii[0])
    return q[keep], c[keep], d[keep]


def scanned(own: np.ndarray, ask: np.ndarray, bound: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of the ``least`` nearest codes of each query within ``bound``, ties included; both are (n, words)."""
    out = []
    step = max(1, PAIRS // len(own))
    for low in range(0, len(ask), step):
        part = slice(low, low + step)
        d = sum(np.bitwise_count(ask[part, None, w] ^ own[None, :, w]).astype(np.uint16) for w in range(own.shape[1]))
        far = bound[part]
        k = int(least[part].max())
        if k < len(own):
            far = np.minimum(far, np.partition(d, k - 1, axis=1)[:, k - 1])
        q, c = np.nonzero(d <= far[:, None])
        out.append((q + low, c, d[q, c].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


FOUND = "query bigint, entries array<bigint>, distances array<bigint>, weights array<bigint>"


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``vec_id, rank, neighbor_id, distance`` of the k rows of ``codes`` nearest to each id of ``queries``."""
    spark = codes.sparkSession
    scratch = Scratch(spark, "topk")
    sizes = codes.agg(F.min("dimensions").alias("low"), F.max("dimensions").alias("high")).first()
    asked_for = queries.agg(F.min("dimensions").alias("low"), F.max("dimensions").alias("high")).first()
    if len({x for x in (*sizes, *asked_for) if x is not None}) > 1:
        raise ValueError(f"search takes codes of one number of dimensions, not of {sizes['low']} to {sizes['high']} and {asked_for['low']} to {asked_for['high']}")
    n_segments = -(-(sizes["high"] or 64) // 64) * 64 // WIDTH
    # Of one code and id at most k rows are ever answers, and without a query's own id k of k + 1 distinct ids are left.
    counted = codes.groupBy("code", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    # The k + 1 smallest ids of each code: the window keeps that many in each task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    entries = counted.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("times"))))).alias("ids"))
    entries = scratch.written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    # Rows of a query's own id do not count: k and as many rows as that id has are enough, or all there are.
    own_rows = counted.groupBy("vec_id").agg(F.sum("times").alias("own"))
    asking = scratch.written(queries.groupBy("vec_id", "code").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")), "asking")
    held = entries.agg(F.sum(F.size("ids")).alias("rows"), F.count("*").alias("codes")).first()
    every = held["rows"] or 0
    asked = asking.select("vec_id", "code").join(own_rows, "vec_id", "left").groupBy("code").agg(F.least(k + F.max(F.coalesce("own", F.lit(0))), F.lit(every)).alias("least"))
    asked = scratch.written(asked.withColumn("query", F.monotonically_increasing_id()), "asked")
    tasks = shuffle_partitions(spark)
    n_blocks = max(1, -(-held["codes"] // BLOCK), min(tasks, held["codes"] // LEAST))
    block = entries.select(F.expr(f"pmod(xxhash64(entry), {n_blocks})").alias("block"), "entry", "code", F.size("ids").cast("bigint").alias("weight"))
    # Files of a few blocks each: a round reads each of them where it lies.
    index = block.repartition(min(n_blocks, 8 * tasks), "block").groupBy("block").agg(F.collect_list(F.struct("entry", "code", "weight")).alias("codes"))
    index = scratch.written(index.select("codes"), "index")

    def met(radii: tuple[int, ...] | None):
        """Pairs of a block and a packet, looked up at ``radii``, or all of them."""

        def run(iterator):
            codes_of = lambda x: x.field("code").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype("<i8").view("<u8")
            for batch in iterator:
                for row in range(batch.num_rows):
                    own, ask = batch.column("codes")[row].values, batch.column("queries")[row].values
                    if not len(ask):
                        continue
                    name, weight = own.field("entry").to_numpy(zero_copy_only=False), own.field("weight").to_numpy(zero_copy_only=False)
                    query, least, bound = (ask.field(c).to_numpy(zero_copy_only=False) for c in ("query", "least", "bound"))
                    own, ask = codes_of(own), codes_of(ask)
                    for low in range(0, len(query), 1 << 12):
                        part = slice(low, low + (1 << 12))
                        if radii is None:
                            found = scanned(own, ask[part], bound[part], least[part])
                        else:
                            found = looked_up(_segments(own), _segments(ask[part]), bound[part], radii)
                        if len(found[0]):
                            yield _grouped(*found, query[part], name, weight)

        return run

    def merge(iterator):
        for batch in iterator:
            n, entries, distances, weights, bounds = [0], [], [], [], []
            least = batch.column("least").to_numpy(zero_copy_only=False)
            lists = [batch.column(c) for c in ("entries", "distances", "weights")]
            for row in range(batch.num_rows):
                e, d, w = (x[row].values.to_numpy(zero_copy_only=False) if x[row].is_valid else np.zeros(0, np.int64) for x in lists)
                keep = nearest_of(d, w, int(least[row]))
                for into, x in zip((entries, distances, weights), (e, d, w)):
                    into.append(x[keep])
                n.append(n[-1] + len(keep))
                # The kth distance so far: what is farther is no answer.
                bounds.append(int(d[keep[-1]]) if len(keep) and w[keep].sum() >= least[row] else farthest)
            made = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))) for x in (entries, distances, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("query"), *made, pa.array(bounds, pa.int64()), pa.array(least.astype(np.int64))], names=["query", "entries", "distances", "weights", "bound", "least"])

    farthest = n_segments * WIDTH
    none = F.array().cast(CODE)
    state = asked.select("query", none.alias("entries"), none.alias("distances"), none.alias("weights"), F.lit(farthest).cast("bigint").alias("bound"), "least")
    done = []
    for radii in (*ROUNDS, None):
        n_packets = -(-state.count() // PACKET)
        open_ = scratch.written(state.select("query", "bound", "least").join(asked.select("query", "code"), "query").withColumn("packet", F.expr(f"pmod(xxhash64(query), {max(1, n_packets)})")), "open")
        found = None
        for p in range(n_packets):
            packet = open_.where(F.col("packet") == p).agg(F.collect_list(F.struct("query", "code", "bound", "least")).alias("queries"))
            # One row of about PACKET queries, whatever their number.
            part = index.crossJoin(F.broadcast(packet)).mapInArrow(met(radii), FOUND)
            found = part if found is None else found.unionByName(part)
        if found is None:
            break
        if radii is not None:
            # The pass over all codes finds what was found before as well.
            found = found.unionByName(state.select("query", "entries", "distances", "weights"))
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("entries", "distances", "weights")]
        state = scratch.written(state.select("query", "least").join(found.groupBy("query").agg(*flat), "query", "left").mapInArrow(merge, f"{FOUND}, bound bigint, least bigint"), "state")
        if radii is None:
            done.append(state)
            break
        covered = n_segments * (radii[-1] + 1) - 1  # every code at most this far was seen
        done.append(state.where(F.col("bound") <= covered))
        state = state.where(F.col("bound") > covered)
    if not done:
        done.append(state)
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    pairs = best.select("query", "least", F.explode(F.arrays_zip("entries", "distances")).alias("x")).select("query", "least", F.col("x.entries").alias("entry"), F.col("x.distances").alias("distance"))
    rows = pairs.join(entries.select("entry", "ids"), "entry").select("query", "distance", "least", F.explode("ids").alias("neighbor_id"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))).where("n <= least")
    lists = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    lists = lists.join(asked.select("query", "code"), "query").drop("query")
    own = asking.join(lists, "code").select("vec_id", "times", F.explode(F.expr(f"slice(filter(near, x -> x.neighbor_id <> vec_id), 1, {k})")).alias("x"))
    pairs = own.select("vec_id", F.explode(F.expr("array_repeat(x, times)")).alias("x")).select("vec_id", "x.neighbor_id", "x.distance")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    result = written(pairs.withColumn("rank", place).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "distance"), "neighbours")
    scratch.drop()
    return result


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return search(codes, codes.where("vec_id % 20 = 0"), k=10)


OP5_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: coalesce(v, 0) > 0) AS code FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL)
SELECT vec_id, rank, neighbor_id, distance FROM (
  SELECT vec_id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id, c.vec_id AS neighbor_id, CAST(len(list_filter(list_zip(q.code, c.code), lambda x: x[1] <> x[2])) AS BIGINT) AS distance
    FROM c AS q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0))
WHERE rank <= 10
"""

"""Compression of vectors to codes (product quantisation) with LAESA pivots, in exact integers.

1. Components become integers, vectors are cut into equal parts, and each part position gets a codebook.
2. A few entries of each first codebook, far from each other, are that position's pivots and stay so. The distances of every part to its
   pivots are computed once and written with the parts.
3. In each round only pivots and entries are measured against each other. By the triangle inequality, the difference of a part's and an
   entry's distance to a pivot is never more than their own distance. Parts near the same pivot, at like distances, form a small group, whose
   largest difference over the pivots bounds an entry's distance to all of them and orders the entries. Those of the least bounds are evaluated first, in
   integers; entries are left out for the parts whose best distance so far is below the bound, and the rest of them once that is so for all
   parts of the group. Bounds are lowered by more than their rounding error, so the result is that of evaluating all.
4. A task sums its parts by entry and sends one row an entry; the driver gets the codebooks, whose size is fixed by
   the parameters, and sends them out with the next round.

Defined cases: vectors that are null or hold null or non-finite components are left out; rows with a null id are coded, but are no
first entries; rows that repeat an id are coded each, and of them the least vector is first among the first entries; with fewer vectors than entries
each codebook has as many entries as there are vectors; null labels are one label; other columns are ignored; an empty table gives an empty result. Vectors of several
lengths, of a length that the parts do not divide, or with components so large that squared distances leave 64 bits are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch, table, written

SCALE = 1024
GROUP = 256  #: parts with one set of bounds
STEP = 64  #: entries evaluated between two looks at the bounds


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x``: the vectors without null or non-finite components, each as ``floor(scale * component)``."""
    # Beyond 2**52 a double is whole, and ``vector_codes`` refuses it anyway.
    whole = f"transform(`{vector_col}`, v -> cast(greatest(least(floor(cast(v as double) * {scale}D), 1e17D), -1e17D) as bigint))"
    sound = f"`{vector_col}` is not null and forall(`{vector_col}`, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    return embeddings.where(sound).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.expr(whole).alias("x"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, in integers."""
    apart = a - b
    return np.einsum("...d,...d->...", apart, apart)


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the entries: the first, then always the one farthest from those chosen (of several, the first)."""
    chosen = entries[:1]
    near = squared(entries, chosen[0])
    while len(chosen) < min(n, len(entries)):
        k = int(near.argmax())
        chosen = np.concatenate([chosen, entries[k : k + 1]])
        near = np.minimum(near, squared(entries, entries[k]))
    return chosen


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(parts[:, None], pivots[None]).astype(float))


def nearest(parts: np.ndarray, to_pivot: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each part the nearest entry (of several, the first), the squared distance, and in all the number of distances evaluated."""
    between = to_pivots(entries, pivots)
    slack = 1e-12 * (1 + max(to_pivot.max(initial=0), between.max(initial=0)))
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # Doubles hold these integers exactly below 2**53, and their products are far quicker than those of integers.
    kind = float if 4 * reach**2 * parts.shape[1] < 1 << 53 else np.int64
    x, e = parts.astype(kind), entries.astype(kind)
    x_norm, e_norm = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", e, e)
    index, error, evaluated = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), 0
    close = to_pivot.argmin(1) if len(parts) else np.zeros(0, np.int64)
    order = np.lexsort((to_pivot[np.arange(len(parts)), close], close))
    for at in range(0, len(parts), GROUP):
        rows = order[at : at + GROUP]
        own = to_pivot[rows]
        low = np.maximum(between - own.max(0), own.min(0) - between).max(1) - slack
        by_bound = np.argsort(low, kind="stable")
        best, least = np.full(len(rows), len(entries)), np.full(len(rows), np.iinfo(np.int64).max)
        for k in range(0, len(entries), STEP):
            left = np.flatnonzero(np.sqrt(least.astype(float)) + slack >= low[by_bound[k]])
            if not len(left):
                break
            columns = np.sort(by_bound[k : k + STEP])
            d = x_norm[rows[left], None] - 2 * (x[rows[left]] @ e[columns].T) + e_norm[columns]
            evaluated += d.size
            nearest_k = d.argmin(1)
            d = d[np.arange(len(left)), nearest_k].astype(np.int64)
            nearest_k = columns[nearest_k]
            better = (d < least[left]) | (d == least[left]) & (nearest_k < best[left])
            best[left[better]], least[left[better]] = nearest_k[better], d[better]
        index[rows], error[rows] = best, least
    return index, error, evaluated


def _numbers(column, kind) -> np.ndarray:
    """An Arrow list column, whose lists are of one length, as rows of a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def encode(vectors: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, n_pivots: int = 8) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of each row of ``vec_id, label, x`` (see the module).

    ``code`` has two hex digits a part, so there are at most 256 entries.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    vectors = scratch.written(vectors, "vectors")
    largest = F.max(F.greatest(F.coalesce(F.array_max("x"), F.lit(0)), -F.coalesce(F.array_min("x"), F.lit(0))))
    size = vectors.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), largest.alias("largest")).first()
    if size["low"] != size["high"] or (size["high"] or n_parts) % n_parts or size["high"] == 0:
        raise ValueError(f"vectors are of one length that {n_parts} divides, not of {size['low']} to {size['high']}")
    wide = (size["high"] or n_parts) // n_parts
    if 4 * (size["largest"] or 0) ** 2 * wide >= 1 << 62:
        raise ValueError(f"components up to {size['largest']} are too large for squared distances in 64 bits")
    # As many rows as a codebook has entries.
    first = vectors.where("vec_id is not null").orderBy("vec_id", "x").limit(n_entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), n_parts, wide).transpose(1, 0, 2)
    if not len(first) and not vectors.isEmpty():
        raise ValueError("no vector has an id, so there are no first entries")
    pivots = [far_apart(b, n_pivots) for b in books] if len(first) else []

    def measured(iterator):
        for batch in iterator:
            if batch.num_rows:
                x = _numbers(batch.column("x"), np.int64).reshape(-1, n_parts, wide)
                apart = np.concatenate([to_pivots(x[:, s], pivots[s]) for s in range(n_parts)], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, apart.size + 1, apart.shape[1]).astype(np.int32)), pa.array(apart.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "apart"])

    kind = vectors.schema["label"].dataType.simpleString()
    vectors = scratch.written(vectors.mapInArrow(measured, f"vec_id bigint, label {kind}, x array<bigint>, apart array<double>"), "measured")

    def assigned(batch, books):
        """(index, squared distance) of each row and part, and the integer parts."""
        x = _numbers(batch.column("x"), np.int64).reshape(-1, n_parts, wide)
        apart = _numbers(batch.column("apart"), float).reshape(len(x), n_parts, -1)
        found = [nearest(x[:, s], apart[:, s], books[s], pivots[s]) for s in range(n_parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), x

    def sums_of(books):
        def run(iterator):
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in iterator:
                if batch.num_rows:
                    index, _, x = assigned(batch, books)
                    for s in range(n_parts):
                        count[s] += np.bincount(index[:, s], minlength=books.shape[1])
                        np.add.at(total[s], index[:, s], x[:, s])
            s, k = np.nonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s) * wide + 1, wide).astype(np.int32)), pa.array(total[s, k].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(count[s, k]), lists], names=["part", "entry", "n", "total"])

        return run

    for _ in range(rounds if len(first) else 0):
        # A task sends a row an entry; what comes together here and on the driver is the size of the codebooks.
        sums = vectors.select("x", "apart").mapInArrow(sums_of(books), "part bigint, entry bigint, n bigint, total array<bigint>")
        added = F.expr(f"aggregate(collect_list(total), array_repeat(0L, {wide}), (a, t) -> zip_with(a, t, (p, q) -> p + q))").alias("total")
        books = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), added).collect():
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]

    def coded(iterator):
        for batch in iterator:
            if batch.num_rows:
                index, error, _ = assigned(batch, books)
                codes = [bytes(row).hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"])

    rows = vectors.mapInArrow(coded, f"vec_id bigint, label {kind}, code string, error bigint")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    result = written(rows.withColumn("codebooks_sha256", F.lit(digest)), "codes")
    scratch.drop()
    return result


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over equal labels; a label that very many rows share is summed in each task first."""
    sums = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("same"))).drop("same")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = encode(integer_vectors(table(spark, sf_dir, "embeddings")))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def sql(n_parts: int = 4, n_entries: int = 256, rounds: int = 4) -> str:
    # Products of integers of this size are exact in doubles.
    apart = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, s, best // {n_entries} AS d, best % {n_entries} AS k FROM (SELECT r, p.s, min(CAST({apart} AS BIGINT) * {n_entries} + k) AS best FROM p JOIN c{i} AS c ON c.s = p.s GROUP BY r, p.s))")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT s, k, list(CAST(mean AS DOUBLE) ORDER BY pos) AS x FROM (SELECT a.s, k, pos, floor(sum(x[pos]) / count(*)) AS mean FROM a{i} AS a JOIN p USING (r, s), unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY a.s, k, pos) GROUP BY s, k),
c{i + 1} AS MATERIALIZED (SELECT s, k, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (s, k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, e) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
p AS MATERIALIZED (SELECT r, s, e[s * (len(e) // {n_parts}) + 1 : (s + 1) * (len(e) // {n_parts})] AS x FROM v, unnest(range({n_parts})) AS u(s)),
c0 AS MATERIALIZED (SELECT s, k, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM v WHERE vec_id IS NOT NULL QUALIFY k < {n_entries}) USING (r)),
{(',' + chr(10)).join(steps)},
o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY s) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda z: CAST(CAST(z AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY s, k)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h
"""


OP12_SQL = sql()

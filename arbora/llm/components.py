"""Connected components by smallest labels with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm._spark import Scratch

SALTS = 16  #: a root that very many ids share is looked up in so many places


def look_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` (with an ``id``) joined from the left with ``found``, one row a ``key``; a key that very many ids share is dealt to several tasks."""
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    salted = rows.withColumn("salt", F.expr(f"pmod(xxhash64(id), {SALTS})"))
    return salted.join(found.withColumn("salt", salts), [key, "salt"], "left").drop("salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for every id in ``a, b`` edges; ``root`` is the smallest id of its component."""
    written = scratch.written
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = written(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root")), "lower")
        # Jump: a root's own root is at least as small; only roots that have moved are looked up.
        moved = lower.where("id <> root").select(F.col("id").alias("root"), F.col("root").alias("further"))
        jump = look_up(lower, moved.join(lower.select("root").distinct(), "root"), "root")
        labels = written(jump.select("id", "old", F.coalesce("further", "root").alias("root")), "labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("id", "root")
        labels = labels.select("id", "root")


def star_components(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` for ``id, centre`` rows, where centres are ids too and have rows of their own.

    An id needs one edge, to its least centre; that its other centres belong there is an edge between centres, of which
    the many ids of a large component share a few. So only centres take part in the rounds.
    """
    stars = scratch.written(stars.groupBy("id").agg(F.min("centre").alias("least"), F.collect_set("centre").alias("centres")), "stars")
    between = stars.select(F.explode(F.array_remove("centres", F.col("least"))).alias("a"), F.col("least").alias("b")).distinct()
    roots = components(between, scratch).select(F.col("id").alias("least"), "root")
    found = look_up(stars.select("id", "least"), roots, "least")
    return scratch.written(found.select("id", F.coalesce("root", "least").alias("root")), "roots")

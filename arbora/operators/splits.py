"""Train and validation splits, sampling and previews; every draw is a hash of the row's key, so runs repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.ranks import values_at
from arbora.plans.workspace import ranked, stored


def _draw(key: str, seed: int):
    return F.expr(f"md5(concat_ws('|', {key}, {seed}))")


def split_by_lists(tiles: DataFrame, train: DataFrame | None = None, val: DataFrame | None = None) -> DataFrame:
    """``tile_id, split`` from lists of tile ids: they must be disjoint and known; one list alone implies the other; the rest is train."""
    ids = tiles.select("tile_id").distinct()
    for name, part in (("train", train), ("val", val)):
        if part is not None and (unknown := [r[0] for r in part.select("tile_id").subtract(ids).orderBy("tile_id").limit(10).collect()]):
            raise ValueError(f"tiles of the {name} list that are not in the grid: {unknown}")
    if train is not None and val is not None:
        both = [r[0] for r in train.select("tile_id").intersect(val.select("tile_id")).orderBy("tile_id").limit(10).collect()]
        if both:
            raise ValueError(f"tiles in both lists: {both}")
    if val is not None:
        chosen = val.select("tile_id").distinct()
    elif train is not None:
        chosen = ids.subtract(train.select("tile_id"))
    else:
        raise ValueError("a list is needed")
    return ids.subtract(chosen).withColumn("split", F.lit("train")).unionByName(chosen.withColumn("split", F.lit("val")))


def split_random(tiles: DataFrame, val_frac: float, seed: int = 0, key: str = "tile_id") -> DataFrame:
    """round-half-even(n * val_frac) ids to val, by the order of their hashes.

    The last hash that belongs to val is found by counting; ids are then split by comparing with it.
    """
    ids = stored(tiles.select(key).distinct().withColumn("_h", _draw(key, seed)).withColumn("_n", F.expr("cast(conv(substr(_h, 1, 15), 16, 10) as bigint)")), "ids")
    n_val = round(ids.count() * val_frac)
    if not n_val:
        return ids.select(key, F.lit("train").alias("split"))
    one = ids.withColumn("_all", F.lit(0))
    wanted = ids.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(0).alias("target"), F.lit(n_val - 1).alias("rank"))
    last = values_at(one, wanted, ["_all"], "_n").first()["found"]
    val = F.col("_n") <= last
    spare = ids.where(val).count() - n_val
    if spare:
        # Ids whose numbers are the same, as good as never: the whole hash decides.
        out = [r[key] for r in ids.where(F.col("_n") == last).orderBy(F.desc("_h"), F.desc(key)).limit(spare).collect()]
        val &= ~F.col(key).isin(out)
    return ids.select(key, F.when(val, "val").otherwise("train").alias("split"))


def split_stratified(rows: DataFrame, key: str, label: str, val_frac: float, seed: int = 0) -> DataFrame:
    """``split`` by class where there are several classes and each has two rows or more, else over all rows."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    facts = sizes.agg(F.count("*").alias("k"), F.min("_n").alias("least")).first()  # one row
    if facts["k"] > 1 and facts["least"] >= 2:
        placed = ranked(rows.withColumn("_h", _draw(key, seed)), ["_h", key], "_r", by=label).join(sizes, label)
        train = F.col("_r") <= F.bround(F.col("_n") * (1 - val_frac))
        return placed.withColumn("split", F.when(train, "train").otherwise("val")).drop("_h", "_r", "_n")
    return rows.join(split_random(rows, val_frac, seed, key), key)


def balanced_sample(rows: DataFrame, label: str, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` draws with replacement, every class equally likely and every row of a class as well.

    A draw picks a class and a place within it, so it meets its row by an equality join.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    classes = [(r[label], r["_n"]) for r in sizes.orderBy(label).collect()]  # one row for each class
    if not classes:
        return rows.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    names = F.array(*[F.lit(c) for c, _ in classes])
    counts = F.array(*[F.lit(m) for _, m in classes])
    number = lambda what: f"cast(conv(substr(md5(concat_ws('|', id, {seed}, '{what}')), 1, 15), 16, 10) as bigint)"
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.expr(f"{number('class')} % {len(classes)}").cast("int").alias("_c"), F.expr(number("row")).alias("_h"))
    draws = draws.select("draw", F.get(names, F.col("_c")).alias(label), (F.pmod("_h", F.get(counts, F.col("_c"))) + 1).alias("_r"))
    placed = ranked(rows.withColumn("_h", _draw(key, seed)), ["_h", key], "_r", by=label).drop("_h")
    return draws.join(placed, [label, "_r"]).drop("_r")


def preview(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(_draw(key, seed), key).limit(n)


def by_folder(index: DataFrame) -> DataFrame:
    """Rows of an image index whose folder names a split; an error unless both splits occur."""
    found = {r[0] for r in index.select("split").where("split in ('train', 'val')").distinct().collect()}
    if found != {"train", "val"}:
        raise ValueError(f"folders name only {sorted(found)}")
    return index.where("split in ('train', 'val')")

"""Sinks for features, labels, sidecars, reports and rasters, and the bookkeeping of what exists."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Products of a mode and the folder each product lies in.
PRODUCTS = {"RGB": ["dop20rgb"], "RGBI": ["dop20rgbi"], "RGBIH": ["dop20rgbi", "ndom1", "dom1", "dgm1"]}
FOLDERS = {"dgm1": "dgm", "dop20rgbi": "dop20", "dop20rgb": "dop20", "ndom1": "ndom1"}


def box_wkt() -> Column:
    x0, y0, x1, y1 = (F.col(c).cast("string") for c in ("xmin", "ymin", "xmax", "ymax"))
    pair = lambda x, y: F.concat(x, F.lit(" "), y)
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pair(x0, y0), pair(x1, y0), pair(x1, y1), pair(x0, y1), pair(x0, y0)), F.lit("))"))


#: Rows of a file at most; how many there are follows from the data, not from the number of tiles.
FILE_ROWS = 1 << 23
BLOCK = 256  #: side of the blocks of pixels that lie together in a file


def interleaved(y: Column, x: Column, bits: int = 12) -> Column:
    """A key in which neighbours lie near each other: the low bits of two whole numbers in turn."""
    out = F.lit(0)
    for k in range(bits):
        bit = lambda c, to: F.shiftleft(F.shiftright(c.cast("int"), k).bitwiseAND(F.lit(1)), to)  # noqa: B023, E731
        out = out.bitwiseOR(bit(x, 2 * k)).bitwiseOR(bit(y, 2 * k + 1))
    return out


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The writes under ``path`` that were finished."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tiles")
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(home)] if files.exists(home) else []
    done = [n for n in names if n.startswith("gen=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tiles/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("gen=")) for n in done)


def write_tiled(df: DataFrame, path: str, tile: str, place: Column, order: tuple[str, ...] = ()) -> None:
    """Rows of any number of tiles in files of bounded size, by ranges of tile and ``place``, each sorted so that row groups can be skipped.

    A write is a generation beside the earlier ones; it counts once the list of its tiles is there, and replaces these tiles only.
    """
    spark = df.sparkSession
    number = max(_generations(spark, path), default=-1) + 1
    rows = df.withColumn("_place", place)
    ranged = rows.repartitionByRange(tile, "_place").sortWithinPartitions(tile, "_place", *order).drop("_place")
    ranged.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/rows/gen={number}")
    spark.read.schema(df.schema).parquet(f"{path}/rows/gen={number}").select(tile).distinct().write.mode("overwrite").parquet(f"{path}/tiles/gen={number}")


def read_tiled(spark: SparkSession, path: str, tile: str) -> DataFrame:
    """What ``write_tiled`` has written: each tile as of its last write. A condition on the tile reaches the scan."""
    found = _generations(spark, path)
    if not found:
        raise ValueError(f"nothing has been written to {path}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/gen={n}" for n in found])
    if len(found) > 1:
        tiles = spark.read.option("basePath", f"{path}/tiles").parquet(*[f"{path}/tiles/gen={n}" for n in found])
        rows = rows.join(tiles.groupBy(tile).agg(F.max("gen").alias("gen")), [tile, "gen"])
    return rows.drop("gen")


def write_features(df: DataFrame, path: str, key: str = "tile_id") -> None:
    """Features by tile and place, boxes also as WKT; tiles written anew replace their older rows only (``read_tiled``)."""
    cell = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0.0)) / BLOCK) % 4096
    write_tiled(df.withColumn("wkt", box_wkt()), path, key, interleaved(cell("ymin"), cell("xmin")), ("ymin", "xmin"))


def write_label_lines(df: DataFrame, path: str, line: Column, by: tuple[str, ...] = ("split", "chip_id")) -> None:
    """Label lines in files of bounded size by ranges of ``by``, the lines of a chip next to each other: millions of chips make no file each.

    ``label_files`` has the text of each chip's file, and ``export_label_files`` writes these for trainers.
    """
    rows = df.select(*by, line.alias("value"))
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def label_files(lines: DataFrame, by: tuple[str, ...] = ("split", "chip_id")) -> DataFrame:
    """``by, file_name, text``: what a trainer's label file of each chip is called (``<split>/<chip_id>.txt``) and holds, its lines in order."""
    name = F.concat(F.concat_ws("/", *[F.col(c).cast("string") for c in by]), F.lit(".txt"))
    text = F.concat(F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("\n"))
    return lines.groupBy(*by).agg(text.alias("text")).select(*by, name.alias("file_name"), "text")


def export_label_files(files: DataFrame, folder: str) -> None:
    """Write ``file_name, text`` as one file each under a ``folder`` that all executors share; every task writes its own."""

    def save(rows) -> None:
        for row in rows:
            target = os.path.join(folder, row["file_name"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="") as out:
                out.write(row["text"])

    files.select("file_name", "text").foreachPartition(save)


def sidecar_json() -> Column:
    """Sidecar of a tile (tile, mode, vmin, vmax, source) in the first dialect."""
    channel = F.struct(F.lit(5).alias("band_index_1based"), F.array("vmin", "vmax").alias("stats_m"), F.col("source").alias("source"))
    return F.to_json(F.struct("tile", "mode", channel.alias("height_channel")))


def write_sidecars(df: DataFrame, path: str) -> None:
    df.select(sidecar_json().alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_raster(pixels: DataFrame, path: str) -> None:
    """Long pixels by tile and block, within a block by band and place; tiles written anew replace their older pixels only (``read_tiled``)."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    write_tiled(pixels, path, "tile", interleaved(block("row"), block("col")), ("band", "row", "col"))


def pending(wanted: DataFrame, rasters: DataFrame, sidecars: DataFrame, key: str = "tile_id", overwrite: bool = False) -> DataFrame:
    """Of the wanted (tile, mode) rows those still to do: RGBIH is done with raster and sidecar, other modes with the raster."""
    if overwrite:
        return wanted
    both = rasters.join(sidecars, key, "left_semi").select(key, "mode")
    done = rasters.where("mode <> 'RGBIH'").select(key, "mode").unionByName(both.where("mode = 'RGBIH'"))
    return wanted.join(done, [key, "mode"], "left_anti")


def manifest(tiles: DataFrame, mode: str, base_url: str) -> DataFrame:
    """``tile_id, product, file_name, url`` for each product of the mode; tile ids ``32_x_y``."""
    if mode.upper() not in PRODUCTS:
        raise ValueError(f"unsupported mode {mode!r}")
    parts = F.split("tile_id", "_")
    rows = tiles.select("tile_id", F.explode(F.array(*map(F.lit, PRODUCTS[mode.upper()]))).alias("product"))
    folder = F.coalesce(F.create_map(*[F.lit(v) for kv in FOLDERS.items() for v in kv])[F.col("product")], F.lit("dom1"))
    rows = rows.withColumn("file_name", F.format_string("%s_32_%s_%s_2_bw.zip", "product", parts[1], parts[2]))
    return rows.withColumn("url", F.concat_ws("/", F.lit(base_url), folder, "file_name"))


def pick_product(files: DataFrame, product: str, suffix: str) -> DataFrame:
    """``tile_id, path``: for each tile the file with its own stub, else one of the product, else any; by name within those."""
    parts = F.split("tile_id", "_")
    name = F.element_at(F.split("path", "/"), -1)
    stub = F.concat(F.lit(f"{product}_32_"), parts[1], F.lit("_"), parts[2], F.lit(f"_2_bw{suffix}"))
    rank = F.when(name == stub, 0).when(name.startswith(f"{product}_") & name.endswith(suffix), 1).when(name.endswith(suffix), 2)
    ranked = files.withColumn("_k", rank).where("_k is not null")
    return ranked.groupBy("tile_id").agg(F.min_by("path", F.struct("_k", "path")).alias("path"))


def first_available(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """``x, y, status, file, fallback_index``: the tile itself, else the one below, to the left, or both."""
    tries = F.posexplode(F.array(*[F.struct((F.col("x") + dx).alias("fx"), (F.col("y") + dy).alias("fy")) for dx, dy in ((0, 0), (0, -1), (-1, 0), (-1, -1))]))
    asked = wanted.select("x", "y", tries.alias("pos", "at")).select("x", "y", "pos", "at.*")
    found = asked.join(inventory.select(F.col("x").alias("fx"), F.col("y").alias("fy"), "file"), ["fx", "fy"])
    best = found.groupBy("x", "y").agg(F.min_by("file", "pos").alias("file"), F.min("pos").alias("fallback_index"))
    return wanted.join(best, ["x", "y"], "left").withColumn("status", F.when(F.col("file").isNull(), "failed").otherwise("success"))

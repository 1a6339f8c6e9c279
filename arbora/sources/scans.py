"""Scans of tile grids, inventories, class tables, point clouds, sidecars, label lines, lists and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.ids import key_to_tile_id, key_to_tile_id_fixed
from arbora.functions.labels import strip

SRID = 25832


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")
    return df


def tile_grid(df: DataFrame, for_download: bool = False) -> DataFrame:
    """The grid with ``tile_id``, which is derived from ``dop_kachel`` where absent; an empty grid is an error."""
    if for_download:
        df = require(df, ["dop_kachel"]).withColumn("tile_id", key_to_tile_id_fixed(F.col("dop_kachel").cast("string")))
    elif "tile_id" not in df.columns:
        df = require(df, ["dop_kachel"]).withColumn("tile_id", key_to_tile_id(F.col("dop_kachel").cast("string")))
    if df.isEmpty():
        raise ValueError("the tile grid is empty")
    return df


def tree_inventory(df: DataFrame, genus: str = "genus", width: str = "canopyWidt") -> DataFrame:
    return require(df, [genus, width, "x", "y"])


# Headers of class tables, in order of preference.
_ID_NAMES, _CLASS_NAMES = ("id", "class_id", "label_id", "fid"), ("class_name", "genus", "label")


def class_table(df: DataFrame) -> DataFrame:
    """``class_id, class_name`` whatever the headers' case and variant."""
    lower = {c.strip().lower(): c for c in df.columns}
    ids, names = ([lower[n] for n in wanted if n in lower] for wanted in (_ID_NAMES, _CLASS_NAMES))
    if not ids or not names:
        raise ValueError(f"no id and name columns among {df.columns}")
    return df.select(F.col(ids[0]).cast("int").alias("class_id"), F.col(names[0]).cast("string").alias("class_name"))


def name_to_id(classes: DataFrame, ordinal: str) -> DataFrame:
    """One id for each name, the last one by ``ordinal`` if a name is repeated."""
    return classes.groupBy("class_name").agg(F.max_by("class_id", ordinal).alias("class_id"))


def xyz_points(lines: DataFrame) -> DataFrame:
    """``x, y, z`` of lines of three space-separated numbers; other lines are skipped."""
    parts = F.split(strip(F.col("value")), r"\s+")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    rows = lines.where(F.size(parts) == 3).select(number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    return rows.where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no usable rows: {what}")
    return df


def raster_band(headers: DataFrame, pixels: DataFrame, band: int) -> DataFrame:
    """Pixels of one band with the raster's coordinate system (25832 if it names none); nodata becomes null."""
    head = headers.select("tile", F.coalesce("srid", F.lit(SRID)).alias("srid"), *(["nodata"] if "nodata" in headers.columns else []))
    rows = pixels.where(F.col("band") == band).join(head, "tile")
    if "nodata" in headers.columns:
        rows = rows.withColumn("value", F.when(F.col("nodata").isNull() | (F.col("value") != F.col("nodata")), F.col("value"))).drop("nodata")
    return rows.select("tile", "row", "col", "value", "srid")


_SIDECAR = "tile bigint, height_channel struct<band_index_1based:int, stats_m:array<double>>, raw_height_stats struct<min:double, max:double>"


def sidecar_ranges(lines: DataFrame) -> DataFrame:
    """``tile, vmin, vmax, band, dialect`` from sidecar JSON of either dialect; a list that has not two numbers is no statistic (dialect null)."""
    s = lines.select(F.from_json("value", _SIDECAR).alias("s")).select("s.*")
    first = F.size("height_channel.stats_m") == 2
    second = F.col("raw_height_stats.min").isNotNull() & F.col("raw_height_stats.max").isNotNull()
    pick = lambda a, b: F.when(first, a).when(second, b)
    stats = F.col("height_channel.stats_m")
    return s.select("tile", pick(F.get(stats, F.lit(0)), F.col("raw_height_stats.min")).alias("vmin"), pick(F.get(stats, F.lit(1)), F.col("raw_height_stats.max")).alias("vmax"), F.coalesce("height_channel.band_index_1based", F.lit(5)).alias("band"), pick(F.lit(1), F.lit(2)).alias("dialect"))


def label_lines(lines: DataFrame, strict: bool = False, source: str | None = None) -> DataFrame:
    """``cls, xc, yc, w, h`` of label lines; others than five numbers are skipped, or an error if ``strict``."""
    parts = F.split(strip(F.col("value")), r"\s+")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    rows = lines.where(strip(F.col("value")) != "").withColumns({"_n": F.size(parts), "_c": number(1), "xc": number(2), "yc": number(3), "w": number(4), "h": number(5)})
    good = (F.col("_n") == 5) & F.col("_c").isNotNull() & F.col("xc").isNotNull() & F.col("yc").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    if strict:
        rows = rows.withColumn("_c", F.when(good, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), F.col("value"))).cast("double")))
    else:
        rows = rows.where(good)
    return rows.select(*([source] if source else []), F.col("_c").cast("int").alias("cls"), "xc", "yc", "w", "h")


def id_list(lines: DataFrame) -> DataFrame:
    return lines.select(strip(F.col("value")).alias("tile_id")).where("tile_id <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def tabular_columns(columns: list[str]) -> list[str]:
    """Canopy width and height columns as they come, then m01 to m12 in order."""
    canopy = [c for c in columns if c.lower() in ("canopywidt", "canopywidth", "canopyheigt", "canopyheight", "canopyheig")]
    return canopy + sorted((c for c in columns if re.fullmatch(r"m(0[1-9]|1[0-2])", c.lower())), key=str.lower)


def tabular(df: DataFrame, key: str = "tree_id") -> DataFrame:
    found = tabular_columns(df.columns)
    if not found:
        raise ValueError(f"no canopy or month columns among {df.columns}")
    return require(df, [key]).select(key, *found)

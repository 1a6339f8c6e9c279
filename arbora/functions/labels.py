"""Training labels from a tree inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Genera labelled as conifers.
CONIFERS = [
    "Abies", "Araucaria", "Calocedrus", "Cedrus", "Chamaecyparis", "Cupressus", "Hesperocyparis", "Juniperus", "Larix", "Metasequoia",
    "Picea", "Pinus", "Platycladus", "Pseudotsuga", "Sequoia", "Sequoiadendron", "Taxodium", "Taxus", "Thuja", "Tsuga", "Wollemia",
]
CONIFER_CLASS, OTHER_CLASS = "Coniferous", "Other Deciduous"


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's ``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_genus(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def assign_classes(trees: DataFrame, classes: DataFrame, genus: str = "genus") -> DataFrame:
    """Add ``training_class``; rows without a genus go. ``classes``: class_id, class_name, with both group classes.

    A conifer genus is labelled as conifer, another one by its own class, the rest as other deciduous.
    """
    # Names as those of the trees; of a name that stands twice the last row counts.
    classes = classes.select(normalize_genus(F.col("class_name")).alias("class_name"), "class_id", F.monotonically_increasing_id().alias("_place"))
    groups = classes.where(F.col("class_name").isin(CONIFER_CLASS, OTHER_CLASS)).groupBy("class_name").agg(F.max_by("class_id", "_place").alias("class_id")).collect()
    ids = {r["class_name"]: r["class_id"] for r in groups}  # two rows at most
    missing = {CONIFER_CLASS, OTHER_CLASS} - set(ids)
    if missing:
        raise ValueError(f"classes missing from the table: {sorted(missing)}")
    named = trees.withColumn(genus, normalize_genus(F.col(genus))).where(F.col(genus) != "")
    group = F.when(F.col(genus).isin(CONIFERS), CONIFER_CLASS).otherwise(F.col(genus))
    unique = classes.groupBy("class_name").agg(F.max_by("class_id", "_place").alias("training_class"))
    found = named.withColumn("_group", group).join(unique.withColumnRenamed("class_name", "_group"), "_group", "left")
    return found.withColumn("training_class", F.coalesce("training_class", F.lit(ids[OTHER_CLASS]))).drop("_group")


def with_ids(trees: DataFrame, id_col: str | None, keys: list[str]) -> DataFrame:
    """``uid``: the stable id where there is one, else a hash of ``keys`` (the same in every run, unlike a UUID)."""
    if id_col and id_col in trees.columns:
        return trees.withColumn("uid", F.col(id_col).cast("string"))
    return trees.withColumn("uid", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256))


def canopy_boxes(trees: DataFrame, width: str = "canopyWidt", min_width: float = 0.0, srid: int | None = 25832) -> DataFrame:
    """A square around each point, as wide as the canopy; rows whose width is not a positive number of at least ``min_width`` go."""
    if srid is None:
        raise ValueError("the points have no coordinate system")
    if srid == 4326:
        raise ValueError("boxes in metres need a metric coordinate system")
    w = F.col("_w")
    kept = trees.withColumn("_w", F.col(width).try_cast("double")).where((w > 0) & (w >= min_width) & ~F.isnan(w))
    half = w / 2
    return kept.withColumns({"xmin": F.col("x") - half, "ymin": F.col("y") - half, "xmax": F.col("x") + half, "ymax": F.col("y") + half}).drop("_w")


def drop_report(trees: DataFrame, genus: str = "genus", width: str = "canopyWidt", min_width: float = 0.0) -> DataFrame:
    """One row: how many rows there are, lack a genus, lack a usable width."""
    w = F.col(width).try_cast("double")
    return trees.agg(
        F.count("*").alias("n_rows"),
        F.count_if(normalize_genus(F.col(genus)) == "").alias("n_no_genus"),
        F.count_if(~F.coalesce((w > 0) & (w >= min_width), F.lit(False))).alias("n_bad_width"),
    )

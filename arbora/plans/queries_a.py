"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions.ids import image_index
from arbora.plans.queries import query
from arbora.plans.standins import duck, load, over
from arbora.plans.workspace import shared_path
from arbora.sources import scans, sinks


def _lines(spark, df, name):
    path = shared_path(spark, name)
    df.write.text(path)
    return scans.read_lines(spark, path)


#: The rule of grid keys, also for those of more than nine characters: two, three, and the last four.
BY_END = "CASE WHEN length({k}) >= 9 THEN concat(substr({k}, 1, 2), '_', substr({k}, 3, 3), '_', right({k}, 4)) END"


@query(duck(f"SELECT {BY_END.format(k='dop_kachel')} AS tile_id, xmin, ymin, xmax, ymax FROM tiles", "tiles"))
def a01_tile_grid(spark, d):
    return scans.tile_grid(load(spark, d, "tiles").drop("tile_id")).select("tile_id", "xmin", "ymin", "xmax", "ymax")


@query(duck("SELECT tree_id, genus, canopyWidt, x, y FROM trees", "trees"))
def a02_tree_inventory(spark, d):
    return scans.tree_inventory(load(spark, d, "trees"))


@query("SELECT class_name, CAST(max(n_nationkey) AS INTEGER) AS class_id FROM (SELECT n_nationkey, substr(n_name, 1, 1) AS class_name FROM nation) GROUP BY class_name")
def a03_class_table(spark, d):
    path = shared_path(spark, "classes")
    # The file's order is that of the ids, which stand for the line number.
    over(spark, d, "SELECT n_nationkey AS LABEL_ID, substr(n_name, 1, 1) AS Genus FROM nation").write.option("header", True).csv(path)
    return scans.name_to_id(scans.class_table(spark.read.option("header", True).csv(path)), "class_id")


_XYZ_LINES = """SELECT CASE WHEN l_linenumber = 6 THEN concat(x, ' ', y) WHEN l_linenumber = 7 THEN concat('abc ', y, ' ', z) WHEN l_linenumber = 5 THEN concat(x, ' ', y, ' nan')
 ELSE concat(x, ' ', y, ' ', z) END AS value FROM (SELECT l_linenumber, 355000e0 + (l_orderkey * 7919) % 1100 AS x, 6040000e0 + (l_partkey * 31 + l_suppkey * 17) % 1100 AS y, l_extendedprice / 1000 AS z FROM lineitem) AS t"""


@query("SELECT 355000e0 + (l_orderkey * 7919) % 1100 AS x, 6040000e0 + (l_partkey * 31 + l_suppkey * 17) % 1100 AS y, l_extendedprice / 1000 AS z FROM lineitem WHERE l_linenumber < 5")
def a04_xyz_scan(spark, d):
    return scans.not_empty(scans.xyz_points(_lines(spark, over(spark, d, _XYZ_LINES), "xyz")), "points")


@query(duck("SELECT tile, row, col, value, CAST(CASE WHEN tile % 3 = 0 THEN 25832 ELSE 4326 END AS INTEGER) AS srid FROM pixels WHERE band = 4", "pixels"))
def a05_raster_band(spark, d):
    pixels = load(spark, d, "pixels")
    headers = pixels.select("tile").distinct().withColumn("srid", F.when(F.col("tile") % 3 != 0, 4326))
    return scans.raster_band(headers, pixels, 4)


@query(duck("""SELECT tile, CASE tile % 4 WHEN 3 THEN NULL ELSE low END AS vmin, CASE tile % 4 WHEN 3 THEN NULL ELSE high END AS vmax, CAST(5 AS INTEGER) AS band,
 CAST(CASE tile % 4 WHEN 3 THEN NULL WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS dialect FROM (SELECT tile, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high FROM pixels WHERE band = 5 GROUP BY tile)""", "pixels"))
def a06_sidecar_json(spark, d):
    ranges = load(spark, d, "pixels").where("band = 5").groupBy("tile").agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    kind = F.col("tile") % 4
    first = F.to_json(F.struct("tile", F.struct(F.lit(5).alias("band_index_1based"), F.when(kind == 3, F.array("low")).otherwise(F.array("low", "high")).alias("stats_m")).alias("height_channel")))
    second = F.to_json(F.struct("tile", F.struct(F.col("low").alias("min"), F.col("high").alias("max")).alias("raw_height_stats")))
    return scans.sidecar_ranges(_lines(spark, ranges.select(F.when(kind == 2, second).otherwise(first).alias("value")), "sidecars"))


_LABELS = "SELECT image_id, gt_id, gt_cls AS cls, (x1 + x2) / 2 / 640 AS xc, (y1 + y2) / 2 / 640 AS yc, (x2 - x1) / 640 AS w, (y2 - y1) / 640 AS h FROM gt_boxes"
_PRINTED = "SELECT {} CAST(cls AS INTEGER) AS cls, CAST(printf('%.6f', xc) AS DOUBLE) AS xc, CAST(printf('%.6f', yc) AS DOUBLE) AS yc, CAST(printf('%.6f', w) AS DOUBLE) AS w, CAST(printf('%.6f', h) AS DOUBLE) AS h FROM (" + _LABELS + ") AS t"


def _label_rows(spark, d):
    x = load(spark, d, "gt_boxes")
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2 / 640
    return x.select("image_id", "gt_id", F.col("gt_cls").alias("cls"), mid("x1", "x2").alias("xc"), mid("y1", "y2").alias("yc"), ((F.col("x2") - F.col("x1")) / 640).alias("w"), ((F.col("y2") - F.col("y1")) / 640).alias("h"))


@query(duck(_PRINTED.format("") + " WHERE gt_id % 7 > 2", "gt_boxes"))
def a07_label_lines(spark, d):
    from arbora.operators.chips import label_line

    k = F.col("gt_id") % 7
    line = F.when(k == 0, F.lit("1 0.5 0.5 0.1")).when(k == 1, F.concat(label_line(), F.lit(" 0.9"))).when(k == 2, F.lit("tree a b c d")).otherwise(label_line())
    return scans.label_lines(_lines(spark, _label_rows(spark, d).select(line.alias("value")), "labels"))


@query(duck(_PRINTED.format(""), "gt_boxes"))
def a07_label_lines_strict(spark, d):
    from arbora.operators.chips import label_line

    return scans.label_lines(_lines(spark, _label_rows(spark, d).select(label_line().alias("value")), "labels"), strict=True)


@query(duck("""SELECT image_path, split_part(split_part(image_path, '/', 5), '_', 1) AS tree_id, split_part(image_path, '/', 4) AS class_name,
 CASE split_part(image_path, '/', 3) WHEN 'train' THEN 'train' ELSE 'val' END AS split FROM image_paths""", "image_paths"))
def a08_image_index(spark, d):
    return image_index(load(spark, d, "image_paths"))


@query(duck("SELECT tile_id FROM tiles WHERE CAST(right(tile_id, 1) AS INTEGER) % 3 > 0", "tiles"))
def a09_id_list(spark, d):
    k = F.right("tile_id", F.lit(1)).cast("int") % 3
    return scans.id_list(_lines(spark, load(spark, d, "tiles").select(F.when(k == 0, "  ").otherwise(F.concat(F.lit(" "), "tile_id", F.lit("\t"))).alias("value")), "list"))


_TABULAR = """SELECT c_custkey AS tree_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 13 + 0.5e0 END AS canopyWidt, c_acctbal AS other, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 10000 END AS m02,
 CAST(c_nationkey AS DOUBLE) / 25 AS M01, CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, CAST(c_nationkey % 3 AS INT) AS y FROM customer"""


@query("SELECT tree_id, canopyWidt, M01, m02 FROM (" + _TABULAR + ")")
def a10_tabular(spark, d):
    return scans.tabular(over(spark, d, _TABULAR))


@query(duck("SELECT concat(label, '') AS tile_id, count(*) AS n, sum(CAST(xmax - xmin AS BIGINT)) :: BIGINT AS width FROM (SELECT class_id AS label, xmin, xmax FROM map_boxes) GROUP BY label", "map_boxes"))
def a11_feature_sink(spark, d):
    path = shared_path(spark, "features")
    sinks.write_features(load(spark, d, "map_boxes").withColumn("tile_id", F.col("class_id").cast("string")), path)
    back = sinks.read_tiled(spark, path, "tile_id").where(F.col("wkt").startswith("POLYGON"))
    return back.groupBy(F.col("tile_id").cast("string").alias("tile_id")).agg(F.count("*").alias("n"), F.sum((F.col("xmax") - F.col("xmin")).cast("bigint")).alias("width"))


@query(duck("SELECT CASE gt_id % 5 WHEN 0 THEN 'val' ELSE 'train' END AS split, image_id AS chip_id, printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h) AS value FROM (" + _LABELS + ") AS t", "gt_boxes"))
def a12_label_sink(spark, d):
    from arbora.operators.chips import label_line

    path = shared_path(spark, "label-lines")
    rows = _label_rows(spark, d).withColumn("split", F.when(F.col("gt_id") % 5 == 0, "val").otherwise("train")).withColumn("chip_id", F.col("image_id"))
    sinks.write_label_lines(rows, path, label_line())
    return sinks.read_label_lines(spark, path)


@query(duck("SELECT tile, CAST(min(value) AS DOUBLE) AS vmin, CAST(max(value) AS DOUBLE) AS vmax, CAST(5 AS INTEGER) AS band, CAST(1 AS INTEGER) AS dialect FROM pixels WHERE band = 5 GROUP BY tile", "pixels"))
def a13_sidecar_sink(spark, d):
    path = shared_path(spark, "sidecars")
    rows = load(spark, d, "pixels").where("band = 5").groupBy("tile").agg(F.min("value").cast("double").alias("vmin"), F.max("value").cast("double").alias("vmax"))
    sinks.write_sidecars(rows.withColumn("mode", F.lit("RGBIH")).withColumn("source", F.lit("ndom")), path)
    return scans.sidecar_ranges(scans.read_lines(spark, path))


@query(duck("SELECT CAST(epoch AS INTEGER) AS epoch, split, count(*) AS n FROM history GROUP BY epoch, split", "history"))
def a14_csv_sink(spark, d):
    path = shared_path(spark, "report")
    sinks.write_csv(load(spark, d, "history").groupBy("epoch", "split").agg(F.count("*").alias("n")), path)
    return spark.read.schema("epoch int, split string, n bigint").option("header", True).csv(path)


@query(duck("SELECT tile, band, row, col, CAST(CASE WHEN value >= 128 THEN 255 ELSE 0 END AS INTEGER) AS value FROM pixels WHERE band = 5", "pixels"))
def a15_raster_sink(spark, d):
    from arbora.functions.raster import encode_mask

    path = shared_path(spark, "raster")
    mask = load(spark, d, "pixels").withColumn("value", encode_mask(F.col("value") >= 128, "0255"))
    sinks.write_raster(mask, path)
    return sinks.read_tiled(spark, path, "tile").where("band = 5")


_MODES = "SELECT tile_id, CASE WHEN CAST(right(tile_id, 1) AS INT) % 2 = 0 THEN 'RGBIH' ELSE 'RGB' END AS mode FROM tiles"


@query(duck(f"""WITH w AS ({_MODES}), r AS (SELECT * FROM w WHERE CAST(right(tile_id, 2) AS INT) % 3 > 0), s AS (SELECT tile_id FROM w WHERE CAST(right(tile_id, 2) AS INT) % 5 > 1)
 SELECT tile_id, mode FROM w WHERE NOT (tile_id IN (SELECT tile_id FROM r) AND (mode <> 'RGBIH' OR tile_id IN (SELECT tile_id FROM s)))""", "tiles"))
def a16_pending(spark, d):
    tiles = load(spark, d, "tiles")
    wanted = tiles.select("tile_id", F.when(F.right("tile_id", F.lit(1)).cast("int") % 2 == 0, "RGBIH").otherwise("RGB").alias("mode"))
    end = F.right("tile_id", F.lit(2)).cast("int")
    return sinks.pending(wanted, wanted.where(end % 3 > 0), wanted.where(end % 5 > 1).select("tile_id"))


@query(duck("""SELECT tile_id, product, file_name, concat('https://example.org/', CASE product WHEN 'dgm1' THEN 'dgm' WHEN 'dop20rgbi' THEN 'dop20' WHEN 'ndom1' THEN 'ndom1' ELSE 'dom1' END, '/', file_name) AS url
 FROM (SELECT tile_id, product, concat(product, '_', tile_id, '_2_bw.zip') AS file_name FROM tiles, (VALUES ('dop20rgbi'), ('ndom1'), ('dom1'), ('dgm1')) AS p(product))""", "tiles"))
def a17_manifest(spark, d):
    return sinks.manifest(load(spark, d, "tiles"), "RGBIH", "https://example.org")


@query(duck("""SELECT tile_id, CASE k WHEN 0 THEN concat('/z/ndom1_', tile_id, '_2_bw.tif') WHEN 1 THEN '/b/ndom1_9.tif' WHEN 2 THEN '/a/other.tif' END AS path
 FROM (SELECT tile_id, CAST(right(tile_id, 2) AS INT) % 4 AS k FROM tiles) WHERE k < 3""", "tiles"))
def a18_product_pick(spark, d):
    k = F.right("tile_id", F.lit(2)).cast("int") % 4
    own, some, other = F.concat(F.lit("/z/ndom1_"), "tile_id", F.lit("_2_bw.tif")), F.lit("/b/ndom1_9.tif"), F.lit("/a/other.tif")
    files = F.when(k == 0, F.array(other, some, own)).when(k == 1, F.array(other, some)).when(k == 2, F.array(other)).otherwise(F.array(F.lit("/c/x.xyz")))
    return sinks.pick_product(load(spark, d, "tiles").select("tile_id", F.explode(files).alias("path")), "ndom1", ".tif")

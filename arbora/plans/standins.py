"""Stand-in inputs: tiles, trees, boxes, pixels and so on, as SQL over the driver tables.

The text is the same in Spark and DuckDB unless a pair is given (Spark, DuckDB). A world of 1000 m tiles, 20 wide and as long
as the tables are large; every stand-in takes all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, tuple[str, str]] = {}


def _both(name: str, sql: str, duck: str | None = None) -> None:
    SQL[name] = (sql, duck or sql)


_both("tiles", """
SELECT concat('32_', 355 + p_partkey % 20, '_', 6040 + CAST(floor(p_partkey / 20.0e0) AS BIGINT)) AS tile_id,
       concat('32', 355 + p_partkey % 20, 6040 + CAST(floor(p_partkey / 20.0e0) AS BIGINT)) AS dop_kachel,
       CAST(355000 + (p_partkey % 20) * 1000 AS DOUBLE) AS xmin, 6040000e0 + floor(p_partkey / 20.0e0) * 1000 AS ymin,
       CAST(356000 + (p_partkey % 20) * 1000 AS DOUBLE) AS xmax, 6041000e0 + floor(p_partkey / 20.0e0) * 1000 AS ymax
FROM part""")
_both("trees", """
SELECT c_custkey AS tree_id,
       CASE c_nationkey % 12 WHEN 0 THEN 'Acer' WHEN 1 THEN ' Tilia ' WHEN 2 THEN 'Pinus' WHEN 3 THEN NULL WHEN 4 THEN '   '
            WHEN 5 THEN 'Malus' WHEN 6 THEN 'Quercus' WHEN 7 THEN 'Picea' WHEN 8 THEN 'acer' WHEN 9 THEN 'Fagus'
            WHEN 10 THEN 'Coniferous' ELSE 'Prunus' END AS genus,
       CASE WHEN c_custkey % 17 = 0 THEN 'n/a' WHEN c_custkey % 19 = 0 THEN NULL ELSE concat(c_custkey % 13, '.5') END AS canopyWidt,
       355000e0 + (c_custkey * 7919) % 20500 + 0.5e0 AS x, 6040000e0 + (c_custkey * 104729) % 10250 + floor(c_custkey / 1500.0e0) * 10000 + 0.25e0 AS y
FROM customer""")
_both("classes", """
SELECT CAST(o AS INT) AS class_id, g AS class_name FROM (VALUES (0, 'Acer'), (1, 'Aesculus'), (2, 'Carpinus'), (3, 'Coniferous'), (4, 'Fagus'),
 (5, 'Other Deciduous'), (6, 'Platanus'), (7, 'Prunus'), (8, 'Quercus'), (9, 'Tilia')) AS t(o, g)""")
_both("gt_boxes", """
SELECT CAST(floor(o_orderkey / 20.0e0) AS BIGINT) AS image_id, o_orderkey AS gt_id, CAST(o_custkey % 10 AS INT) AS gt_cls,
       CAST((o_orderkey * 7919) % 640 AS DOUBLE) AS x1, CAST((o_orderkey * 104729) % 640 AS DOUBLE) AS y1,
       CAST((o_orderkey * 7919) % 640 + 20 + o_custkey % 60 AS DOUBLE) AS x2, CAST((o_orderkey * 104729) % 640 + 20 + o_custkey % 40 AS DOUBLE) AS y2
FROM orders""")
_both("pred_boxes", """
SELECT image_id, pred_id, pred_cls, x1, y1, x2, y2, conf FROM (
  SELECT CAST(floor(l_orderkey / 20.0e0) AS BIGINT) AS image_id, l_orderkey * 10 + l_linenumber AS pred_id, CAST(l_partkey % 10 AS INT) AS pred_cls,
         CAST((l_orderkey * 7919) % 640 + l_linenumber * 2 AS DOUBLE) AS x1, CAST((l_orderkey * 104729) % 640 + l_linenumber AS DOUBLE) AS y1,
         CAST((l_orderkey * 7919) % 640 + l_linenumber * 2 + 20 + l_suppkey % 60 AS DOUBLE) AS x2,
         CAST((l_orderkey * 104729) % 640 + l_linenumber + 20 + l_suppkey % 40 AS DOUBLE) AS y2,
         (1 + (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000) / 1000.0e0 AS conf,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
  FROM lineitem) AS t
WHERE rn = 1""")
_both("xyz", """
SELECT 355000e0 + (l_orderkey * 7919) % 1100 AS x, 6040000e0 + (l_partkey * 31 + l_suppkey * 17) % 1100 AS y, l_extendedprice / 1000 AS z FROM lineitem""")
_both("pixels", """
SELECT CAST(floor(vec_id / 5.0e0) AS BIGINT) AS tile, CAST(vec_id % 5 + 1 AS INT) AS band, CAST(floor(pos / 8.0e0) AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CAST(round((CAST(v AS DOUBLE) + 1) * 127.5e0) AS INT) AS value
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""", """
SELECT CAST(floor(vec_id / 5.0e0) AS BIGINT) AS tile, CAST(vec_id % 5 + 1 AS INT) AS band, CAST(floor(pos / 8.0e0) AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CAST(round((CAST(v AS DOUBLE) + 1) * 127.5e0) AS INT) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) AS t""")
#: A band of 8 x 8 pixels for each vector: heights in half metres, with holes.
_both("heights", """
SELECT vec_id AS tile, CAST(floor(pos / 8.0e0) AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CASE WHEN (vec_id + pos) % 23 = 0 THEN NULL ELSE round((CAST(v AS DOUBLE) + 0.4e0) * 20) / 2 END AS height
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""", """
SELECT vec_id AS tile, CAST(floor(pos / 8.0e0) AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CASE WHEN (vec_id + pos) % 23 = 0 THEN NULL ELSE round((CAST(v AS DOUBLE) + 0.4e0) * 20) / 2 END AS height
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) AS t""")
_both("logits", """
SELECT vec_id AS sample_id, CAST(label % 10 AS INT) AS y, transform(slice(embedding, 1, 10), v -> CAST(v AS DOUBLE) * 10) AS logits FROM embeddings""", """
SELECT vec_id AS sample_id, CAST(label % 10 AS INT) AS y, [CAST(v AS DOUBLE) * 10 FOR v IN embedding[1:10]] AS logits FROM embeddings""")
_both("history", """
SELECT CAST(extract(day FROM ts) AS INT) AS epoch, event_type AS split, event_id, value FROM events""")
_both("image_paths", """
SELECT doc_id, concat('/data/', CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'valid' ELSE 'train' END, '/',
       CASE doc_id % 5 WHEN 0 THEN 'Acer' WHEN 1 THEN 'Tilia' WHEN 2 THEN 'Quercus' WHEN 3 THEN 'Fagus' ELSE 'Prunus' END,
       '/', doc_id, '_', n_chars, '.tif') AS image_path
FROM documents""")
#: Crown boxes on the map, about two for each tree of usable width, with a confidence.
_both("map_boxes", """
SELECT l_orderkey * 10 + l_linenumber AS box_id, CAST(l_partkey % 10 AS INT) AS class_id, 355000e0 + x AS xmin, 6040000e0 + y AS ymin,
       355000e0 + x + 3 + l_suppkey % 9 AS xmax, 6040000e0 + y + 3 + l_suppkey % 7 AS ymax, (1 + (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000) / 1000.0e0 AS conf
FROM (SELECT *, (l_orderkey * 7919) % 2000 + l_linenumber AS x, (l_orderkey * 104729) % 2000 + floor(l_orderkey / 6000.0e0) * 2000 + l_linenumber AS y,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
      FROM lineitem) AS t
WHERE rn = 1""")

#: A header for each raster of ``heights``: origins, resolutions and sizes of their own, every fifth turned, some with a nodata value.
_both("headers", """
SELECT vec_id AS tile, 0.5e0 + 0.25e0 * (vec_id % 3) AS a, CASE WHEN vec_id % 5 = 0 THEN 0.125e0 ELSE 0e0 END AS b, 355000e0 + (vec_id * 37) % 2000 AS c,
       CASE WHEN vec_id % 5 = 0 THEN 0.125e0 ELSE 0e0 END AS d, -0.5e0 - 0.25e0 * (vec_id % 3) AS e, 6040000e0 + (vec_id * 53) % 2000 + floor(vec_id / 2000.0e0) * 2000 AS f,
       CAST(8 - vec_id % 2 AS INT) AS n_rows, CAST(8 - vec_id % 3 AS INT) AS n_cols, CAST(25832 AS INT) AS srid, CASE WHEN vec_id % 4 = 0 THEN 5e0 END AS nodata
FROM embeddings""")
#: And a grid of another origin, resolution and size for each of them.
_both("grids", """
SELECT vec_id AS tile, 0.3e0 + 0.4e0 * (vec_id % 4) AS a, 0e0 AS b, 354999.65314159e0 + (vec_id * 37) % 2000 AS c, 0e0 AS d, -0.3e0 - 0.4e0 * (vec_id % 4) AS e,
       6040000.15871828e0 + (vec_id * 53) % 2000 + floor(vec_id / 2000.0e0) * 2000 AS f, CAST(6 + vec_id % 3 AS INT) AS n_rows, CAST(5 + vec_id % 4 AS INT) AS n_cols, CAST(25832 AS INT) AS srid
FROM embeddings""")
#: Points on and beside the raster of each truth box's image.
_both("raster_points", f"""
SELECT gt_id, tile, a * (x1 / 60) + b * (y1 / 60) + c AS x, d * (x1 / 60) + e * (y1 / 60) + f AS y, CAST((gt_id * 31) % 977 AS DOUBLE) / 10 AS z
FROM ({SQL['gt_boxes'][0]}) AS g JOIN ({SQL['headers'][0]}) AS h ON image_id = tile""")

_BASES = ("part", "customer", "nation", "orders", "lineitem", "events", "embeddings", "documents", "supplier")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame, or a driver table of that name."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return over(spark, sf_dir, SQL[name][0])


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the driver tables, without registering views."""
    import re

    used = [t for t in _BASES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` with the named stand-ins as common table expressions."""
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in names)
    if not names:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"

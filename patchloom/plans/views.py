"""Views of the driver's tables in the shapes the operators take. Fractions are of grids, so both engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.session import table

#: Side of the grid boxes and cells lie on, and of the 64 numbers of an embedding seen as patches.
GRID, PATCHES = 24, 8

BOXES_SQL = """
cells AS (
  SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS ord,
         l_partkey % 16 AS c0, 1 + CAST(l_quantity AS BIGINT) % 8 AS cw, l_suppkey % 16 AS r0, 1 + (l_partkey + l_suppkey) % 8 AS rh,
         l_extendedprice AS score, l_linenumber AS line
  FROM lineitem),
boxes AS (
  SELECT image, ord, line, score, CAST(2 * c0 + cw AS DOUBLE) / CAST(48 AS DOUBLE) AS x, CAST(2 * r0 + rh AS DOUBLE) / CAST(48 AS DOUBLE) AS y,
         CAST(cw AS DOUBLE) / CAST(24 AS DOUBLE) AS w, CAST(rh AS DOUBLE) / CAST(24 AS DOUBLE) AS h
  FROM cells),
images AS (SELECT o_orderkey AS image, CAST(320 + 80 * (o_custkey % 5) AS DOUBLE) AS width, CAST(240 + 120 * (o_orderkey % 3) AS DOUBLE) AS height FROM orders)
"""

IOU_SQL = """greatest(CAST(0 AS DOUBLE), least({a}x + {a}w / 2, {b}x + {b}w / 2) - greatest({a}x - {a}w / 2, {b}x - {b}w / 2))
  * greatest(CAST(0 AS DOUBLE), least({a}y + {a}h / 2, {b}y + {b}h / 2) - greatest({a}y - {a}h / 2, {b}y - {b}h / 2))"""


def iou_sql(a: str, b: str) -> str:
    shared = "(" + IOU_SQL.format(a=a, b=b) + ")"
    return f"({shared} / ({a}w * {a}h + {b}w * {b}h - {shared}))"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """image, ord, line, score, x, y, w, h: a box a lineitem, images are orders."""
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    c0, cw = F.col("l_partkey") % 16, 1 + F.col("l_quantity").cast("bigint") % 8
    r0, rh = F.col("l_suppkey") % 16, 1 + (F.col("l_partkey") + F.col("l_suppkey")) % 8
    over = lambda c, n: c.cast("double") / F.lit(float(n))
    return li.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(w).alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("score"),
        over(2 * c0 + cw, 48).alias("x"), over(2 * r0 + rh, 48).alias("y"), over(cw, 24).alias("w"), over(rh, 24).alias("h"),
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("image"), (320 + 80 * (F.col("o_custkey") % 5)).cast("double").alias("width"), (240 + 120 * (F.col("o_orderkey") % 3)).cast("double").alias("height")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, cls, vec: embeddings as pooled features; every fifth is a support vector, the rest are queries."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("embedding").alias("vec"), (F.col("vec_id") % 5 == 0).alias("is_support"))


def grid_features(spark: SparkSession, d: str) -> DataFrame:
    """image, rows, cols, r, c, patch, vec: 64 successive embeddings are the patches of an image; the last may be incomplete."""
    patch = (F.col("vec_id") % 64).cast("int")
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("image"), F.lit(PATCHES).alias("rows"), F.lit(PATCHES).alias("cols"),
        F.floor(patch / PATCHES).cast("int").alias("r"), (patch % PATCHES).alias("c"), patch.alias("patch"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )


#: An image of 64 successive embeddings with a planted object: a block of 4 x 4 patches, of another direction than the rest.
PLANTED_SQL = """planted AS (SELECT vec_id // 64 AS image, CAST(vec_id % 64 // 8 AS INT) AS r, CAST(vec_id % 8 AS INT) AS c, 1 + vec_id // 64 % 3 AS r0, 1 + vec_id // 192 % 3 AS c0 FROM embeddings)"""


def planted(spark: SparkSession, d: str) -> DataFrame:
    """As `grid_features`, each embedding added to a long vector that tells object from background: (0.6, 0.8) or (1, 0) of its first numbers."""
    f = grid_features(spark, d)
    r0, c0 = 1 + F.col("image") % 3, 1 + F.floor(F.col("image") / 3) % 3
    inside = F.col("r").between(r0, r0 + 3) & F.col("c").between(c0, c0 + 3)
    base = lambda i: F.when(i == 0, F.when(inside, 0.6).otherwise(1.0)).when(i == 1, F.when(inside, 0.8).otherwise(0.0)).otherwise(0.0)
    return f.withColumn("vec", F.transform("vec", lambda v, i: base(i) * 1000 + v)).withColumn("planted", inside)


def records(spark: SparkSession, d: str) -> DataFrame:
    """image_id, path, relative, size, mtime_ns: each image record once."""
    return table(spark, d, "image_records").select("image_id", "path", "relative", "size", "mtime_ns").distinct()


def detections(spark: SparkSession, d: str) -> DataFrame:
    """image, ord, class_id, confidence: lineitems as detections."""
    b = boxes(spark, d)
    return b.select("image", "ord", ((F.col("line") + F.col("image")) % 4).cast("int").alias("class_id"), (F.col("score") % 1000 / 1000).alias("confidence"))

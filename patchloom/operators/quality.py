"""Quality of labels: boxes per image and fixed-edge histograms of area and aspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of the histograms. Intervals are half open; the last one holds its upper edge.
AREA_EDGES = [0.0, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 1.000001]
ASPECT_EDGES = [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 10.0, 1000000.0]


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """bin, low, high, n of every interval, empty ones too; values outside are not counted. One partial aggregate."""
    last = len(edges) - 2
    inside = lambda i: (value >= edges[i]) & ((value <= edges[i + 1]) if i == last else (value < edges[i + 1]))
    sums = df.agg(*[F.count(F.when(inside(i), 1)).alias(f"n{i}") for i in range(last + 1)])
    rows = [F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("low"), F.lit(edges[i + 1]).alias("high"), F.col(f"n{i}").alias("n")) for i in range(last + 1)]
    return sums.select(F.inline(F.array(*rows)))


def counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image, n_boxes; images without boxes count with 0. `boxes` are counted before the join."""
    n = boxes.groupBy("image").agg(F.count(F.lit(1)).alias("n_boxes"))
    return images.select("image").join(n, "image", "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))


def frequencies(per_image: DataFrame) -> DataFrame:
    """n_boxes, n_images."""
    return per_image.groupBy("n_boxes").agg(F.count(F.lit(1)).alias("n_images"))


def summary(freq: DataFrame) -> DataFrame:
    """Images, boxes, mean, exact median and share of images without boxes, from the frequencies; all 0 when empty."""
    n, k = F.col("n_images"), F.col("n_boxes")
    median = F.percentile("n_boxes", F.lit(0.5), F.col("n_images"))
    out = freq.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("valid_images"), F.coalesce(F.sum(n * k), F.lit(0)).alias("total_boxes"), median.alias("m"), F.coalesce(F.sum(F.when(k == 0, n)), F.lit(0)).alias("zero")
    )
    share = lambda a: F.coalesce(F.try_divide(F.col(a), F.col("valid_images")), F.lit(0.0))
    return out.select("valid_images", "total_boxes", share("total_boxes").alias("mean_boxes"), F.coalesce("m", F.lit(0.0)).alias("median_boxes"), share("zero").alias("zero_box_ratio"))


def split_counts(per_image: DataFrame) -> DataFrame:
    """split, images, zero_box, boxes. `per_image`: split, n_boxes."""
    return per_image.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count(F.when(F.col("n_boxes") == 0, 1)).alias("zero_box"), F.sum("n_boxes").alias("boxes"))


def method_totals(runs: DataFrame) -> DataFrame:
    """method, images, boxes, mean_seconds, zero_box: totals of each method. `runs`: method, image, n_boxes, seconds."""
    return runs.groupBy("method").agg(F.count(F.lit(1)).alias("images"), F.sum("n_boxes").alias("boxes"), F.avg("seconds").alias("mean_seconds"), F.count(F.when(F.col("n_boxes") == 0, 1)).alias("zero_box"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same images under two settings side by side: image, a_boxes, b_boxes, change."""
    left, right = a.select("image", F.col("n_boxes").alias("a_boxes")), b.select("image", F.col("n_boxes").alias("b_boxes"))
    return left.join(right, "image").withColumn("change", F.col("b_boxes") - F.col("a_boxes"))

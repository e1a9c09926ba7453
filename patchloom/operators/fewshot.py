"""Few-shot matching: class prototypes of support vectors, cosine scores, an unknown gate, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.vectors import dot, unit
from patchloom.session import beside, cut

UNKNOWN = "unknown"


def prototypes(support: DataFrame) -> DataFrame:
    """cls, vec: the mean of each class's unit vectors, at length 1. `support`: cls, vec.

    Positions are averaged map-side, so a hot class shuffles sums and not vectors.
    """
    long = support.select("cls", F.posexplode(unit(F.col("vec"))).alias("i", "x"))
    mean = long.groupBy("cls", "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))
    return whole.select("cls", unit(F.col("vec")).alias("vec"))


def _compared(queries: DataFrame, protos: DataFrame, block: int) -> tuple[DataFrame, int]:
    """id, r: each query's (negated cosine, class) for each block of classes; and the number of blocks."""
    met, n_blocks = beside(queries.select("id", unit(F.col("vec")).alias("vec")), cut(protos.select("cls", "vec"), "prototypes"), "protos", block)
    clipped = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    each = F.transform("protos", lambda p: F.struct((-clipped(dot(F.col("vec"), p["vec"]))).alias("c"), p["cls"].alias("cls")))
    return met.select("id", each.alias("r")), n_blocks


def ranked(queries: DataFrame, protos: DataFrame, block: int = 1000, keep: int | None = None) -> DataFrame:
    """id, r: each query's (negated cosine, class) of all classes, or the best `keep`, best first.

    Up to `block` classes go to every task as one array: one pass over the queries, no shuffle. More are compared block by
    block and each query's blocks are put together, of each no more than the best `keep`. Query ids are distinct.
    """
    best = lambda r: F.slice(F.sort_array(r), 1, keep) if keep else F.sort_array(r)
    each, n_blocks = _compared(queries, protos, block)
    each = each.select("id", best("r").alias("r"))
    return each if n_blocks == 1 else each.groupBy("id").agg(best(F.flatten(F.collect_list("r"))).alias("r"))


def scores(queries: DataFrame, protos: DataFrame, block: int = 1000) -> DataFrame:
    """id, cls, cosine of each query (id, vec) with each class."""
    return _compared(queries, protos, block)[0].select("id", F.inline("r")).select("id", "cls", (-F.col("c")).alias("cosine"))


def match(scored: DataFrame, threshold: float = -1.0, min_margin: float = 0.0) -> DataFrame:
    """id, top1, cosine, margin, label: the best class (ties to the least name), unknown below threshold or margin.

    `scored` is what `ranked` gives, or a table of id, cls, cosine, which is grouped first. The margin of a single class is 2.
    """
    if not -1 <= threshold <= 1 or not 0 <= min_margin <= 2:
        raise ValueError("threshold must lie in [-1, 1] and margin in [0, 2]")
    best = scored
    if "r" not in scored.columns:
        best = scored.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "cls"))).alias("r"))
    second = F.get("r", F.lit(1))["c"]
    cosine = -F.get("r", F.lit(0))["c"]
    out = best.select("id", F.get("r", F.lit(0))["cls"].alias("top1"), cosine.alias("cosine"), F.coalesce(cosine + second, F.lit(2.0)).alias("margin"))
    known = (F.col("cosine") >= threshold) & (F.col("margin") >= min_margin)
    return out.withColumn("label", F.when(known, F.col("top1").cast("string")).otherwise(UNKNOWN))


def tally(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """cls, total, found, correct, recall of each true class. `matched`: id, label; `truth`: id, cls; unmatched count as misses."""
    joined = truth.join(matched.select("id", "label"), "id", "left")
    right = F.coalesce(F.col("label") == F.col("cls").cast("string"), F.lit(False))
    return joined.groupBy("cls").agg(F.count(F.lit(1)).alias("total"), F.count("label").alias("found"), F.sum(right.cast("bigint")).alias("correct")).withColumn("recall", F.col("correct") / F.col("total"))


def overall(by_class: DataFrame) -> DataFrame:
    """total, correct, recall and the mean of the class recalls."""
    return by_class.agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.try_divide(F.sum("correct"), F.sum("total")).alias("recall"), F.avg("recall").alias("macro_recall")
    )


def photos(detections: DataFrame, queries: DataFrame, class_id: int) -> DataFrame:
    """image, has_candidate, top1 detection's ord: the most confident of one class; ties to the first. Images without count.

    `detections`: image, ord, class_id, confidence.
    """
    w = Window.partitionBy("image").orderBy(F.desc("confidence"), "ord")
    top = detections.where(F.col("class_id") == class_id).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return queries.join(top.select("image", F.col("ord").alias("top_ord"), "confidence"), "image", "left").withColumn("has_candidate", F.col("top_ord").isNotNull())


def first_of_class(support: DataFrame) -> DataFrame:
    """cls, id: the least id of each class. Combines map-side."""
    return support.groupBy("cls").agg(F.min("id").alias("id"))


def photo_tally(photos: DataFrame, truth: DataFrame, labels: DataFrame) -> DataFrame:
    """cls, photos, with_candidate, correct of each true class: photos that have a candidate, and whose top one is labelled right.

    `photos`: as of `photos`; `truth`: image, cls; `labels`: image, ord, label of detections.
    """
    x = truth.join(photos, "image", "left").join(labels.select("image", F.col("ord").alias("top_ord"), "label"), ["image", "top_ord"], "left")
    one = lambda c: F.count(F.when(c, 1))
    return x.groupBy("cls").agg(F.count(F.lit(1)).alias("photos"), one(F.col("has_candidate")).alias("with_candidate"), one(F.col("label") == F.col("cls").cast("string")).alias("correct"))


def confident(detections: DataFrame, least: float, class_ids: list[int] | None = None) -> DataFrame:
    keep: Column = F.col("confidence") >= least
    if class_ids is not None:
        keep = keep & F.col("class_id").isin(class_ids)
    return detections.where(keep)

"""Greedy suppression of overlapping boxes within each image, in a given order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.functions.geometry import iou, keeps
from patchloom.session import cut, join_small


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As geometry.iou, of arrays whose last axis is x, y, w, h."""
    low, high = a[..., :2] - a[..., 2:] / 2, a[..., :2] + a[..., 2:] / 2
    other_low, other_high = b[..., :2] - b[..., 2:] / 2, b[..., :2] + b[..., 2:] / 2
    shared = np.prod(np.maximum(0.0, np.minimum(high, other_high) - np.maximum(low, other_low)), axis=-1)
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - shared
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(union <= 0, 0.0, shared / union)


def keep_in_order(boxes: np.ndarray, starts: np.ndarray, max_iou: float) -> np.ndarray:
    """Which boxes stay, of images that begin at `starts`. Images of like numbers of boxes are done side by side."""
    ends = np.r_[starts[1:], len(boxes)]
    sizes = ends - starts
    kept = np.ones(len(boxes), bool)
    widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for width in np.unique(widths[sizes > 1]):
        mine = np.flatnonzero((widths == width) & (sizes > 1))
        for some in np.array_split(mine, max(1, len(mine) * width // 200_000)):
            at = np.minimum(starts[some, None] + np.arange(width), len(boxes) - 1)
            there = np.arange(width) < sizes[some, None]
            b, stays = boxes[at], there.copy()
            for j in range(1, width):
                clear = (_iou(b[:, j, None], b[:, :j]) <= max_iou) | ~stays[:, :j]
                stays[:, j] &= clear.all(axis=1)
            kept[at[there]] = stays[there]
    return kept


def suppress(boxes: DataFrame, order: list[Column], max_iou: float) -> DataFrame:
    """Keep a box if it overlaps no kept box of its image by more than `max_iou`; boxes are taken in `order`, then by ord.

    `boxes`: image, ord, x, y, w, h. One shuffle by image; sorted rows stream through Arrow batches, and only the boxes of
    the picture that a batch ends in are held over.
    """
    schema = T.StructType([boxes.schema[n] for n in ("image", "ord", "x", "y", "w", "h")])
    arrow = to_arrow_schema(schema)
    sort = {f"_o{i}": o for i, o in enumerate(order)}
    rows = boxes.withColumns(sort).repartition("image").sortWithinPartitions("image", *sort, "ord", "x", "y", "w", "h").select("image", "ord", "x", "y", "w", "h")

    def decided(table: pa.Table, ends: np.ndarray) -> pa.Table:
        numbers = np.stack([table.column(k).to_numpy() for k in ("x", "y", "w", "h")], axis=1).astype(float)
        return table.filter(pa.array(keep_in_order(numbers, np.r_[0, ends[:-1]].astype(int), max_iou)))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not table.num_rows:
                continue
            ends = pc.run_end_encode(table.column("image").combine_chunks()).run_ends.to_numpy()
            whole = int(ends[-2]) if len(ends) > 1 else 0
            if whole:
                yield from decided(table.slice(0, whole), ends[:-1]).cast(arrow).to_batches()
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield from decided(held, np.array([held.num_rows])).cast(arrow).to_batches()

    return rows.mapInArrow(run, schema)


def filtered(boxes: DataFrame, images: DataFrame, min_area: float, max_area: float, max_aspect: float) -> DataFrame:
    """The geometric filter alone; `images`: image, width, height."""
    b = F.struct("x", "y", "w", "h")
    return boxes.join(images, "image").where(keeps(b, F.col("width"), F.col("height"), min_area, max_area, max_aspect))


def mask_boxes(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Box of each mask from its cells (image, mask, r, c): least to largest cell, half open. Combines map-side."""
    edge = cells.groupBy("image", "mask").agg(F.min("c").alias("c0"), (F.max("c") + 1).alias("c1"), F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"))
    x0, x1, y0, y1 = F.col("c0") / cols, F.col("c1") / cols, F.col("r0") / rows, F.col("r1") / rows
    return edge.select("image", "mask", ((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def algebra(cells: DataFrame, first: str, second: str) -> DataFrame:
    """op, image, r, c of the union (or), intersection (and) and difference (and_not) of two masks of each image.

    `cells`: image, mask, r, c; repeated cells count once. One shuffle for all three.
    """
    has = lambda mask: F.coalesce(F.bool_or(F.col("mask") == mask), F.lit(False))
    both = cells.groupBy("image", "r", "c").agg(has(first).alias("a"), has(second).alias("b"))
    ops = F.array_compact(F.array(F.when(F.expr("a OR b"), F.lit("or")), F.when(F.expr("a AND b"), F.lit("and")), F.when(F.expr("a AND NOT b"), F.lit("and_not"))))
    return both.select(F.explode(ops).alias("op"), "image", "r", "c")


#: Pairs of boxes of one image that are compared one by one; beyond, boxes meet in the cells of a grid.
MANY_PAIRS = 1 << 16


def candidates(left: DataFrame, right: DataFrame, least: float, cells: int = 8, many: int = MANY_PAIRS) -> DataFrame:
    """Pairs of boxes of one image with IoU of at least `least`: image, p, r, iou. `left`, `right`: image, ord, x, y, w, h.

    Boxes meet by image. In images of more than `many` pairs, which are counted, they meet only in a cell of a grid that
    both touch, each pair in the first such cell, and the cells are shuffled.
    """
    side = lambda df, n: df.select("image", "ord", F.struct("x", "y", "w", "h").alias("b"), F.lit(n).alias("side"))
    both = cut(side(left, 0).unionByName(side(right, 1)), "boxes")
    count = lambda n: F.count(F.when(F.col("side") == n, 1))
    large = cut(both.groupBy("image").agg(count(0).alias("p"), count(1).alias("r")).where(F.col("p") * F.col("r") > many).select("image"), "large")
    mine = lambda df, n, name: df.where(F.col("side") == n).select("image", F.col("ord").alias(name), F.col("b").alias(f"b_{name}"))
    matched = lambda met: met.withColumn("iou", iou(F.col("b_p"), F.col("b_r"))).where(F.col("iou") >= least).select("image", "p", "r", "iou")
    if large.isEmpty():
        return matched(mine(both, 0, "p").join(mine(both, 1, "r"), "image"))
    few, dense = both.join(large, "image", "left_anti"), join_small(both, large, ["image"], "left_semi")
    at = lambda p, s, sign: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(f"b.{p}") + sign * F.col(f"b.{s}") / 2) * cells).cast("int")))
    dense = dense.withColumns({"i": at("x", "w", -1), "j": at("y", "h", -1), "i1": at("x", "w", 1), "j1": at("y", "h", 1)})
    dense = dense.withColumn("gi", F.explode(F.sequence("i", "i1"))).withColumn("gj", F.explode(F.sequence("j", "j1")))
    cell = lambda n, name: dense.where(F.col("side") == n).select("image", "gi", "gj", F.col("ord").alias(name), F.col("b").alias(f"b_{name}"), F.col("i").alias(f"i_{name}"), F.col("j").alias(f"j_{name}"))
    met = cell(0, "p").join(cell(1, "r"), ["image", "gi", "gj"])
    first = (F.col("gi") == F.greatest("i_p", "i_r")) & (F.col("gj") == F.greatest("j_p", "j_r"))
    return matched(mine(few, 0, "p").join(mine(few, 1, "r"), "image")).unionByName(matched(met.where(first)))

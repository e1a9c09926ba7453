"""Pooling of dense patch features inside boxes, weighted by how much of each cell a box covers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def pool(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """image, ord, vec: mean feature of each box. An image without boxes has no row.

    `features`: image, rows, cols, r, c, vec (a row a patch); `boxes`: image, ord, x, y, w, h. A box not finite, without
    size, or off the image is an error. Cells outside a box's range are dropped before vectors are multiplied.
    """
    c = F.col
    bad = ~(c("w") > 0) | ~(c("h") > 0) | F.isnan(c("x") + c("y") + c("w") + c("h")) | (F.abs(c("x") + c("y") + c("w") + c("h")) == float("inf"))
    w = F.when(bad, F.raise_error(F.lit("box is not finite or has no size")).cast("double")).otherwise(c("w"))
    ranges = boxes.select(
        "image", "ord",
        F.greatest(F.lit(0.0), c("x") - w / 2).alias("x0"), F.least(F.lit(1.0), c("x") + w / 2).alias("x1"),
        F.greatest(F.lit(0.0), c("y") - c("h") / 2).alias("y0"), F.least(F.lit(1.0), c("y") + c("h") / 2).alias("y1"),
    )
    span = lambda at, n, lo, hi: F.greatest(F.lit(0.0), F.least(c(at) + 1.0, c(hi) * c(n)) - F.greatest(c(at).cast("double"), c(lo) * c(n)))
    met = features.join(ranges, "image").withColumn("weight", span("c", "cols", "x0", "x1") * span("r", "rows", "y0", "y1")).where("weight > 0")
    parts = _sums(met.select("image", "ord", "weight", F.col("vec").cast("array<double>").alias("vec")))
    entries = F.collect_list(F.struct("vec", "weight"))  # a sum a batch that a box's cells came in
    total = F.aggregate(F.slice("e", 2, F.size("e")), F.get("e", F.lit(0))["vec"], lambda acc, x: F.zip_with(acc, x["vec"], lambda a, b: a + b))
    weight = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["weight"])
    return parts.groupBy("image", "ord").agg(entries.alias("e")).select("image", "ord", F.transform(total, lambda v: v / weight).alias("vec"))


def _sums(met: DataFrame) -> DataFrame:
    """image, ord, vec, weight: the weighted sums of a batch's rows (image, ord, weight, vec), whole vectors at a time."""
    schema = T.StructType([met.schema[n] for n in ("image", "ord", "vec", "weight")])
    arrow = to_arrow_schema(schema)

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        image, ord_ = (batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        code = image * (batch.num_rows + 1) + ord_
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        weight = batch.column(2).to_numpy()
        vectors = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
        sums = np.add.reduceat(vectors[order] * weight[order, None], first, axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        at = pa.array(order[first])
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists.cast(arrow.field("vec").type), pa.array(np.add.reduceat(weight[order], first))], schema=arrow)

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(3))
            for size in pc.unique(sizes):  # one, unless images of several models meet
                yield summed(batch.filter(pc.equal(sizes, size)))

    return met.mapInArrow(run, schema)


def require_overlap(boxes: DataFrame, pooled: DataFrame) -> DataFrame:
    """Fail if a box of an image met no cell."""
    if boxes.join(pooled, ["image", "ord"], "left_anti").limit(1).count():
        raise ValueError("a box does not meet its image")
    return pooled

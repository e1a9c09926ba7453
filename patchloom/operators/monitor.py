"""Rates over time: rolling and average rate and time left, from cumulative samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.scalars import clock


def training_eta(steps: DataFrame) -> DataFrame:
    """`steps` with the share done and the time left of a training, `?` before any progress.

    `steps`: elapsed (seconds since it started), start_epoch, epoch (from 0), epochs, batch, batches (an epoch), ended (whether
    the epoch is over). Progress counts whole epochs and the batches of the current one, since the start.
    """
    c = F.col
    total = c("epochs") - c("start_epoch")
    part = F.when(c("ended"), 1.0).otherwise(F.least(F.lit(1.0), c("batch") / F.greatest(F.lit(1), c("batches"))))
    done = F.least(total.cast("double"), F.greatest(F.lit(0.0), c("epoch") - c("start_epoch") + part))
    left = F.when(done > 0, F.greatest(F.lit(0.0), c("elapsed").cast("double")) * (total - done) / done)
    return steps.where(total > 0).withColumn("share", (c("start_epoch") + done) / c("epochs")).withColumn("eta", F.coalesce(clock(left), F.lit("?")))


def rolling(samples: DataFrame, window_us: int, keys: list[str] | None = None, total: int | None = None) -> DataFrame:
    """base_t, base_n, rolling and average rate a second of each sample. `samples`: keys, t_us BIGINT, n (cumulative).

    The base of a sample is the latest one strictly before its window, or the first of all: an as-of lookup, done as a range
    frame, so that it needs neither a join nor all samples in memory. Spans of zero have rate 0.
    """
    by = Window.partitionBy(*(keys or [])).orderBy("t_us")
    before = by.rangeBetween(Window.unboundedPreceding, -(window_us + 1))
    point = F.struct("t_us", "n")
    base = F.coalesce(F.max(point).over(before), F.min(point).over(by.rangeBetween(Window.unboundedPreceding, 0)))
    first = F.min(point).over(by.rangeBetween(Window.unboundedPreceding, 0))
    x = samples.withColumn("_b", base).withColumn("_f", first)
    rate = lambda p: F.coalesce(F.try_divide((F.col("n") - F.col(p)["n"]) * F.lit(1e6), F.col("t_us") - F.col(p)["t_us"]), F.lit(0.0))
    x = x.withColumn("base_t", F.col("_b")["t_us"]).withColumn("base_n", F.col("_b")["n"]).withColumn("rolling_rate", rate("_b")).withColumn("average_rate", rate("_f"))
    if total is not None:
        left = F.try_divide(F.lit(total) - F.col("n"), F.when(F.col("average_rate") > 0, F.col("average_rate")))
        x = x.withColumn("eta", F.coalesce(clock(left), F.lit("?")))
    return x.drop("_b", "_f")

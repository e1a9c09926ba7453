"""Percentiles of very large numeric columns by merging centroid digests, with the rank error counted exactly.

Values of a group are sorted and cut into clusters that are equally long under k(q) = delta * (asin(2q - 1) / pi + 1/2):
clusters are small near both ends and hold at most about pi / (2 delta) of the rows in the middle. A cluster is kept as a
centroid (mean, weight, least, largest). Digests of separate tasks, days or partitions are merged by clustering their
centroids again. Each clustering may move a rank by about a cluster, so digests hold clusters FINE times finer than the
bound stated, and an estimate is the mean of the centroid that holds the rank: a value between two centroids could lie
beside one that a tenth of the rows share, and so far off in rank. `certify` then counts, in a second pass over the values, how many lie below and at each estimate; the
`rank_error` it states is exact, is 0 where the estimate is a correct percentile, and is compared with the `bound` stated.

Defined results. Null, NaN, infinite, zero and negative values are no measurements and are left out; a group without any
has no row. Null group keys form a group of their own. Whole rows repeated under one id count once. Ties are counted as a
range of ranks, so an estimate within a run of equal values has no error. Empty input gives empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import cut, join_small

DELTA = 200
#: A day's digest is clustered three times and a model's twice more, each time within a cluster; one more is spare.
FINE = 6
#: Rows a task takes in beside its centroids before it clusters them.
BUFFER = 400_000
#: Digests merged by one task of the first level.
FAN_IN = 64


def cluster(code, mean, weight, low, high, delta: int = DELTA):
    """Cluster centroids of all groups at once. Returns the same arrays, shorter, sorted by group and mean."""
    if not len(code):
        return code, mean, weight, low, high
    order = np.lexsort((mean, code))
    code, mean, weight, low, high = code[order], mean[order], weight[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[first, len(code)])
    cum = np.cumsum(weight)
    before = np.repeat(np.r_[0.0, cum[first[1:] - 1]], sizes)
    total = np.repeat(np.add.reduceat(weight, first), sizes)
    q = np.clip((cum - before - weight / 2) / total, 0, 1)
    k = np.floor(delta * (np.arcsin(2 * q - 1) / np.pi + 0.5))
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (k[1:] != k[:-1])])
    w = np.add.reduceat(weight, start)
    low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
    return code[start], np.clip(np.add.reduceat(weight * mean, start) / w, low, high), w, low, high


def digest_type(keys: list[T.StructField]) -> T.StructType:
    number, numbers = T.DoubleType(), T.ArrayType(T.DoubleType())
    rest = [("n", number), ("means", numbers), ("weights", numbers), ("lows", numbers), ("highs", numbers), ("piece", T.IntegerType())]
    return T.StructType([*keys, *[T.StructField(n, t) for n, t in rest]])


def _fold(df: DataFrame, keys: list[str], delta: int) -> DataFrame:
    """One digest a group and task, of rows (keys, mean, weight, low, high), streaming: memory follows the groups of a task."""
    schema = digest_type([df.schema[k] for k in keys])
    arrow = to_arrow_schema(schema)

    def run(batches):
        known: dict[tuple, int] = {}
        held, rows, most = [], 0, BUFFER

        def settle():
            nonlocal held, rows, most
            if held:
                held = [cluster(*[np.concatenate(x) for x in zip(*held)], delta * FINE)]
                rows = len(held[0][0])
                most = BUFFER + rows

        for batch in batches:
            columns = [c.dictionary_encode() for c in batch.columns[: len(keys)]]
            code = np.zeros(batch.num_rows, np.int64)
            for c in columns:
                code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
            _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
            names = zip(*[c.take(pa.array(at)).to_pylist() for c in columns])
            codes = np.array([known.setdefault(k, len(known)) for k in names], np.int64)[inverse]
            held.append((codes, *[c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]]))
            rows += batch.num_rows
            if rows > most:
                settle()
        settle()
        if not rows:
            return
        code, *numbers = held[0]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        offsets = pa.array(np.r_[first, len(code)].astype(np.int32))
        names = list(known)
        columns = [pa.array([names[c][i] for c in code[first]], arrow.field(k).type) for i, k in enumerate(keys)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).cast(arrow.field("means").type) for x in numbers]
        n, piece = pa.array(np.add.reduceat(numbers[1], first)), pa.array(np.full(len(first), TaskContext.get().partitionId(), np.int32))
        table = pa.Table.from_arrays([*columns, n, *lists, piece], schema=arrow)
        yield from table.to_batches(max_chunksize=2_000)

    return df.select(*keys, *[F.col(c).cast("double") for c in ("mean", "weight", "low", "high")]).mapInArrow(run, schema)


def merge(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Digests of the groups of `keys` (any of the digests' keys), by clustering centroids again.

    Two levels, so that no task reads more than FAN_IN digests of a group at the first and one in FAN_IN at the second.
    """
    if not keys:
        digests, keys = digests.withColumn("everything", F.lit("all")), ["everything"]
    for level in (F.floor(F.col("piece") / FAN_IN), F.lit(0)):
        spread = digests.withColumn("_level", level).repartition(*keys, "_level")
        long = spread.select(*keys, F.inline(F.arrays_zip("means", "weights", "lows", "highs")))
        digests = _fold(long.toDF(*keys, "mean", "weight", "low", "high"), keys, delta)
    return digests


def build(values: DataFrame, keys: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """Digest of each group: made in each task first, so a hot group shuffles centroids and not its rows."""
    v = F.col(value)
    rows = measured(values, value).select(*keys, v.alias("mean"), F.lit(1.0).alias("weight"), v.alias("low"), v.alias("high"))
    return merge(_fold(rows, keys, delta), keys, delta)


def measured(values: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return values.where(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))


def estimate(digests: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """keys, n and the values at `ps`: the mean of the centroid that holds the rank."""
    schema = T.StructType([*[digests.schema[k] for k in keys], T.StructField("n", T.DoubleType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    arrow, targets = to_arrow_schema(schema), np.array(ps)

    def run(batches):
        for batch in batches:
            lists = [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) + 1 :]]
            out = []
            for means, weights in zip(*lists):
                cum = np.cumsum(weights)
                out.append(means[np.searchsorted(cum, targets * cum[-1])])
            values = pa.array([x.tolist() for x in out], arrow.field("values").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], values], schema=arrow)

    return digests.select(*keys, "n", "means", "weights").mapInArrow(run, schema)


def bound(p: Column, n: Column, delta: int = DELTA) -> Column:
    """The rank error stated for the percentile p of n values: the share of rows of one cluster of `delta` there, and of one row."""
    return math.pi / delta * F.sqrt(p * (1 - p)) + 1 / n


def certify(values: DataFrame, levels: list[tuple[list[str], DataFrame]], value: str, ps: list[float], delta: int = DELTA) -> list[DataFrame]:
    """Of each level: keys, p, value, n, rank_error, bound, within_bound. `levels`: keys and estimates, the finest first.

    The second pass over the values counts those below and at each estimate, for all levels at once; the keys of a coarser
    level are some of the finest, so its counts are sums. rank_error is the distance from p to the range of ranks (as
    shares of n) that the estimate holds; it is counted, not estimated.
    """
    finest = levels[0][0]
    known, whole = None, None
    for k, (keys, estimates) in enumerate(levels):
        one = estimates.select(F.struct(*keys).alias(f"_k{k}"), F.col("values").alias(f"_v{k}"))  # structs compare null-safe
        if known is None:
            known = one.select("*", *[F.col("_k0")[x].alias(x) for x in finest])
        else:
            known = known.withColumn(f"_k{k}", F.struct(*keys)).join(one, f"_k{k}")
    known = cut(known.drop(*finest), "levels")
    left = measured(values, value).select(F.struct(*finest).alias("_k0"), F.col(value).alias("_v"))
    joined = join_small(left, known, ["_k0"])
    n_of = lambda cond: F.count(F.when(cond, 1))
    at = [(k, i, F.col(f"_v{k}")[i]) for k in range(len(levels)) for i in range(len(ps))]
    sums = [f(F.col("_v"), x).alias(f"{name}{k}_{i}") for k, i, x in at for name, f in (("lt", lambda v, x: n_of(v < x)), ("le", lambda v, x: n_of(v <= x)))]
    counted = joined.groupBy("_k0").agg(F.count(F.lit(1)).alias("n"), *sums)
    counted = cut(counted.join(known, "_k0"), "counted") if len(levels) > 1 else counted.join(known, "_k0")

    def level(k: int) -> DataFrame:
        total = lambda c: F.sum(c).alias(c)
        mine = [total(f"{name}{k}_{i}") for i in range(len(ps)) for name in ("lt", "le")]
        x = counted.groupBy(f"_k{k}", f"_v{k}").agg(total("n"), *mine) if k else counted

        def row(i: int, p: float) -> Column:
            low, high = F.col(f"lt{k}_{i}") / F.col("n"), F.col(f"le{k}_{i}") / F.col("n")
            error = F.greatest(F.lit(0.0), F.lit(p) - high, low - F.lit(p))
            return F.struct(F.lit(p).alias("p"), F.col(f"_v{k}")[i].alias("value"), error.alias("rank_error"), bound(F.lit(p), F.col("n"), delta).alias("bound"))

        out = x.select(f"_k{k}.*", "n", F.explode(F.array(*[row(i, p) for i, p in enumerate(ps)])).alias("r"))
        return out.select(*levels[k][0], "r.p", "r.value", "n", "r.rank_error", "r.bound", (F.col("r.rank_error") <= F.col("r.bound")).alias("within_bound"))

    return [level(k) for k in range(len(levels))]

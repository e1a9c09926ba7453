"""A reproducible sample that stays as the data grow: permanent random numbers.

Each identifier gets one uniform number in [0, 1) when it is first seen, persisted in a store by an anti-join insert. A
seed's sample starts at the seed's own point of the circle and takes the numbers that follow, up to its share: select u if
(u - start(seed)) mod 1 < share. Equal seeds give nested samples; the share of a seed never falls, as the store keeps the
largest it has had. Neither reruns, nor partitioning, nor order or size of later arrivals change a number, so members stay
members. The store lies in buckets by identifier: an arrival is shuffled to them, and what is stored stays where it is.
One writer at a time holds the claim of a store; another gets a `Conflict`.

Defined results. A null identifier is never selected; an identifier seen again keeps its number; a null seed counts as
seed 0; a null share selects nothing, a share above 1 everything; any number of configurations is taken. Empty arrivals
change nothing.
"""

from __future__ import annotations

import contextlib
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.session import beside, cut, filesystem

#: A uniform number has this many bits, as many as fit a double exactly.
BITS = 52


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << BITS))


def start_of(seed: Column) -> Column:
    return uniform(F.concat(F.lit("start:"), F.coalesce(seed, F.lit(0)).cast("string")))


class Conflict(RuntimeError):
    """Another writer holds the store."""


class PermanentNumbers:
    """The store at `path`, which outlives the session: numbers (id, u, first_seen) and shares (seed, share), only appended to."""

    SCHEMA = "id STRING, u DOUBLE, first_seen BIGINT"
    SHARES = "seed BIGINT, share DOUBLE"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """`buckets` of a new store: as many as a shuffle has partitions unless given. That of an old one stays."""
        self.spark, self.path = spark, path.rstrip("/")
        fs, mark = filesystem(spark, f"{self.path}/buckets")
        if fs.exists(mark):
            buckets = int(next(x.getPath().getName() for x in fs.listStatus(mark)))
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            fs.mkdirs(filesystem(spark, f"{self.path}/buckets/{buckets}")[1])
        self.buckets = buckets
        self.table = f"numbers_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{self.path}/numbers'"
        )

    @contextlib.contextmanager
    def _claim(self):
        fs, claim = filesystem(self.spark, f"{self.path}/claim")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise Conflict(f"{self.path} is being written to") from e
        try:
            yield
        finally:
            fs.delete(claim, False)

    def release(self) -> None:
        """Take the claim from a writer that is known to be dead. What it had not committed is not in the store."""
        fs, claim = filesystem(self.spark, f"{self.path}/claim")
        fs.delete(claim, False)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def insert(self, arrivals: DataFrame, identifier: str, arrival: str) -> None:
        """Give a number to each identifier of `arrivals` that has none. `arrival` orders them: the least is kept."""
        seen = arrivals.select(F.col(identifier).alias("id"), F.col(arrival).cast("bigint").alias("first_seen")).where("id IS NOT NULL")
        first = seen.groupBy("id").agg(F.min("first_seen").alias("first_seen")).repartition(self.buckets, "id")
        with self._claim():
            new = first.join(self.read().select("id"), "id", "left_anti")
            new.select("id", uniform(F.concat(F.lit("id:"), "id")).alias("u"), "first_seen").write.insertInto(self.table)

    def shares(self) -> DataFrame:
        """seed, share: the largest share each seed has had."""
        fs, path = filesystem(self.spark, f"{self.path}/shares")
        found = self.spark.read.schema(self.SHARES).parquet(f"{self.path}/shares") if fs.exists(path) else self.spark.createDataFrame([], self.SHARES)
        return found.groupBy("seed").agg(F.max("share").alias("share"))

    def thresholds(self, configs: DataFrame, order: str) -> DataFrame:
        """config_id, start and threshold: the largest share the seed has had, kept ones and those of `configs` in the order of `order`.

        The shares of `configs` are kept from now on, so the threshold of a later, lesser share is the same.
        """
        seed = F.coalesce("seed", F.lit(0)).alias("seed")
        w = Window.partitionBy("seed").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        now = configs.select("config_id", order, seed, "sample_share") if order != "config_id" else configs.select("config_id", seed, "sample_share")
        with self._claim():
            known = now.join(self.shares(), "seed", "left")
            limits = cut(known.select("config_id", "seed", start_of(F.col("seed")).alias("start"), F.greatest("share", F.max("sample_share").over(w)).alias("threshold")), "limits")
            limits.where("threshold IS NOT NULL").groupBy("seed").agg(F.max("threshold").alias("share")).write.mode("append").parquet(f"{self.path}/shares")
        return limits.drop("seed")


def select(numbers: DataFrame, limits: DataFrame, block: int = 1000) -> DataFrame:
    """config_id and id of all members: each row of `limits` (config_id, start, threshold) tested against each number.

    Up to `block` limits go along as one array, so no join is needed; more are taken in blocks. `limits` is cut from its lineage.
    """
    met, _ = beside(numbers.select("id", "u"), limits.where("threshold > 0").select("config_id", "start", "threshold"), "limits", block)
    past = lambda x: F.col("u") - x["start"] + F.when(F.col("u") < x["start"], 1.0).otherwise(0.0)
    member = F.transform(F.filter("limits", lambda x: past(x) < x["threshold"]), lambda x: x["config_id"].cast("bigint"))
    return met.select(F.explode(member).alias("config_id"), "id")

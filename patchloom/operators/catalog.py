"""Catalogs of image records: scans, manifests, selections and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions.scalars import first_part, is_image, label_key, subset_rank
from patchloom.session import cut, filesystem
from patchloom.sources import manifests


#: A file in a root that names the images to take, one path a line.
SELECTION = "selection.txt"


def scan(spark: SparkSession, root: str, selection: str = SELECTION) -> DataFrame:
    """path, relative, size, mtime_ns and key of each image below `root`. Files are listed, not read.

    The root may be one image. If it has a file of the name `selection`, just the images it names, in its order. Modification times are exact to the microsecond. An empty folder gives an empty catalog; see `require_rows`.
    """
    root = root.rstrip("/")
    fs, place = filesystem(spark, root)
    if fs.exists(place) and not fs.getFileStatus(place).isDirectory():
        folder, _, name = root.rpartition("/")
        return scan(spark, folder or "/", "").where(F.col("relative") == name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^file:/*", "/")
    base = root.removeprefix("file://")
    relative = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    out = files.where(is_image(F.col("path"))).select(
        plain.alias("path"), relative.alias("relative"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    )
    out = out.withColumn("key", label_key(F.col("relative")))
    listed = filesystem(spark, f"{root}/{selection or SELECTION}")[1]
    if not selection or not fs.exists(listed):
        return out
    named = require_rows(manifests.selection(spark, f"{root}/{selection}").where("relative <> ''"), f"{selection} names no image")
    return from_manifest(out, named).drop("ord")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail, when there is none, instead of giving an empty result."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def collisions(records: DataFrame) -> DataFrame:
    """Keys that more than one path would write to: key, n."""
    return records.select(label_key(F.col("relative")).alias("key"), "relative").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def from_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records a manifest (ord, relative) names, in its order; an error for a path unsafe, missing, or named twice."""
    r = F.col("relative")
    unsafe = r.startswith("/") | F.array_contains(F.split(r, "/"), "..") | ~is_image(r)
    named = manifest.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(label_key(r)))).withColumn("_unsafe", unsafe)
    joined = named.join(records.withColumn("_found", F.lit(True)), "relative", "left")
    problem = F.when(F.col("_unsafe"), "unsafe path: ").when(F.col("_n") > 1, "named twice: ").when(F.col("_found").isNull(), "missing: ")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, r)).cast("string")).otherwise(r)
    return joined.withColumn("relative", checked).drop("_n", "_unsafe", "_found").orderBy("ord")


def lookup(wanted: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted row with its sample by all of `keys`, say an id and a version; an error for one that has none, or several."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    met = wanted.join(samples.withColumn("_n", n), keys, "left")
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    wrong = F.when(F.col("_n").isNull(), F.lit("no sample of ")).when(F.col("_n") > 1, F.lit("several samples of "))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, name)).cast("boolean")).otherwise(True)
    return met.where(checked).drop("_n")


def deterministic_subset(records: DataFrame, n: int, seed: int) -> DataFrame:
    """The `n` records of least hash, with their rank; the same whatever the order of rows. A top-k, never a full sort."""
    least = records.withColumn("_h", subset_rank(seed, F.col("relative"))).orderBy("_h", "relative").limit(n)
    return least.withColumn("rank", F.row_number().over(Window.orderBy("_h", "relative"))).drop("_h")


def subset_digest(subset: DataFrame) -> DataFrame:
    """One hash of the subset's paths in the order of rank. `subset` is a limited one."""
    paths = F.transform(F.sort_array(F.collect_list(F.struct("rank", "relative"))), lambda x: x["relative"])
    return subset.agg(F.sha2(F.array_join(paths, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def prefix_subsets(subset: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row a record and subset that holds it; the subsets are prefixes of one order."""
    names = F.array_compact(F.array(*[F.when(F.col("rank") <= n, F.lit(name)) for name, n in sizes.items()]))
    return subset.select("relative", "rank", F.explode(names).alias("subset"))


def first_per_group(rows: DataFrame, group: Column, order: list, n: int) -> DataFrame:
    """The first `n` rows of each group, with rank and whether the group has as many. Each task keeps n rows a group only."""
    rows = rows.withColumn("grp", group)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.withColumn("complete", F.max("rank").over(Window.partitionBy("grp")) >= n)


def preview(records: DataFrame, n_boxes: str, order: list, n: int) -> DataFrame:
    """What a preview shows: boxed records first, then unboxed, in order, `n` in all."""
    return records.orderBy(F.col(n_boxes) == 0, *order).limit(n)


def _ranged(rows: DataFrame, order: list, value: Column) -> tuple[DataFrame, Column, DataFrame, int]:
    """`rows` sorted by ranges and stored with a number, `_m`, that ascends; its range; what lies before each range; the total.

    No task ever holds all rows. The driver gets a sum a range, that is a task.
    """
    held = cut(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sums = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).collect())
    before, total = [], 0
    for number, n in sums:
        before.append((number, total))
        total += n
    return held, part, rows.sparkSession.createDataFrame(before, "_part BIGINT, _start BIGINT"), total


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """`rows` with their position in an order, from 0, and n."""
    held, part, offsets, total = _ranged(rows, order, F.lit(1))
    out = held.join(F.broadcast(offsets), part == F.col("_part"))  # a row a task
    return out.withColumn("position", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).withColumn("n", F.lit(total)).drop("_m", "_part", "_start")


def running(rows: DataFrame, order: list, value: str, done: str, whole: str) -> DataFrame:
    """`rows` with the running total of a whole number in an order, and its total. A null counts as 0."""
    held, part, offsets, total = _ranged(rows, order, F.col(value))
    out = held.join(F.broadcast(offsets), part == F.col("_part"))  # a row a task
    w = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0))
    return out.withColumn(done, so_far).withColumn(whole, F.lit(total).cast("bigint")).drop("_m", "_part", "_start")


def probes(rows: DataFrame, order: list) -> DataFrame:
    """First, middle and last row of an order, with their position."""
    at = F.col("position")
    return numbered(rows, order).where((at == 0) | (at == F.floor(F.col("n") / 2)) | (at == F.col("n") - 1)).drop("n")


def route(relative: Column, routes: dict[str, str]) -> Column:
    """Split a record goes to by its first path part; an error for any other."""
    part = first_part(relative)
    out = None
    for name, split in routes.items():
        out = F.when(part == name, split) if out is None else out.when(part == name, split)
    return out.otherwise(F.raise_error(F.concat(F.lit("no split for "), relative)).cast("string"))


def image_bytes(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.count(F.lit(1)).alias("n_files"))


def split_complete(records: DataFrame, expected: dict[str, int]) -> DataFrame:
    """split, n, expected, complete: a split is complete if as many files are there as expected."""
    spark = records.sparkSession
    want = spark.createDataFrame(list(expected.items()), "split STRING, expected BIGINT")
    have = records.groupBy(first_part(F.col("relative")).alias("split")).agg(F.countDistinct("relative").alias("n"))
    out = want.join(have, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("complete", F.col("n") == F.col("expected"))

"""Compaction of partitions that hold too many small files, under snapshot versions and conflict checks.

A `SnapshotTable` is a parquet directory partitioned by one column and, below it, by generation: what one change wrote to a
partition. Generations are never touched again. A version is a small table of the live generations of each partition, and
is committed by creating `versions/n` exclusively: a reader sees the old version or the new one, and an old one can be read
as long as it is kept. Compaction counts the small files of each partition of a version, rewrites the partitions that
exceed the count (dynamic overwrite of just their new generation) and commits on top of the version it counted. If others
have committed meanwhile, their changes must leave the rewritten partitions alone; else it is a `Conflict` and nothing has
happened. Appends commute with everything and are committed on whatever version there is.

A partition is marked clean while it is known to hold no record twice: after its rewriting, and after appends of records
that are new. All state of partitions is tables; the driver holds counts. Exclusive creation is atomic on HDFS and local
disks; an object store must offer it.

Defined results. An empty table compacts to nothing; partitions within bounds are not touched; a null partition value is a
partition of its own; repeated records (equal in `identity`) of a rewritten partition are merged into one, where of other
columns the largest value stands. A writer that dies leaves at most files no version names; `sweep` removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.session import cut, filesystem, join_small

LIVE = "part STRING, gen STRING, clean BOOLEAN"


class Conflict(RuntimeError):
    """Another writer has changed what this change is based on."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str):
        """`schema`: DDL of all columns, the partition column among them. A column named `gen` is taken."""
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition
        self.data, self.log, self.manifests = f"{self.path}/data", f"{self.path}/versions", f"{self.path}/manifests"

    def versions(self) -> list[int]:
        fs, log = filesystem(self.spark, self.log)
        found = sorted(int(x.getPath().getName()) for x in fs.listStatus(log)) if fs.exists(log) else []
        return [v for v in found if v < found[-1] or self._entry(v)]  # the last may be on its way

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict | None:
        """What was committed; nothing if its writer has not finished the entry."""
        fs, path = filesystem(self.spark, f"{self.log}/{version}")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def live(self, version: int | None = None) -> DataFrame:
        """part, gen, clean of a version, the latest unless given."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], LIVE)
        return self.spark.read.schema(LIVE).parquet(f"{self.manifests}/{self._entry(version)['manifest']}")

    def _commit(self, version: int, live: DataFrame, kind: str) -> None:
        """Become version `version`, or fail with a Conflict if there is one."""
        token = uuid.uuid4().hex
        live.write.parquet(f"{self.manifests}/{token}")
        fs, path = filesystem(self.spark, f"{self.log}/{version}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} exists") from e
        stream.write(bytearray((json.dumps({"kind": kind, "manifest": token}) + "\n").encode()))
        stream.close()

    def _write(self, df: DataFrame) -> DataFrame:
        """Write rows as a new generation of each partition they fall into. Returns part and gen of these."""
        gen = uuid.uuid4().hex
        out = df.withColumn("gen", F.lit(gen))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition, "gen").parquet(self.data)
        return self.files(gen).select("part", "gen").distinct()

    def files(self, gen: str = "*") -> DataFrame:
        """part, gen, path and length of each data file, of any version or one generation; contents are not read."""
        fs, _ = filesystem(self.spark, self.data)
        if not fs.globStatus(filesystem(self.spark, f"{self.data}/*/gen={gen}")[1]):
            return self.spark.createDataFrame([], "part STRING, gen STRING, path STRING, length BIGINT")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.data}/*/gen={gen}")
        at = lambda i: F.regexp_extract("path", f"/{self.partition}=([^/]*)/gen=([^/]*)/[^/]*$", i)
        part = F.url_decode(F.replace(at(1), F.lit("+"), F.lit("%2B")))
        return found.select(part.alias("part"), at(2).alias("gen"), "path", "length")

    def census(self, small_bytes: int, version: int | None = None) -> DataFrame:
        """Of each partition of a version: files, files below `small_bytes`, bytes, and whether it is clean."""
        counted = self.files().join(self.live(version), ["part", "gen"]).groupBy("part").agg(
            F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("length") < small_bytes, 1)).alias("n_small"), F.sum("length").alias("n_bytes"), F.bool_and("clean").alias("clean")
        )
        return counted

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless given: those of its generations, whatever is written meanwhile."""
        return self._rows(self.live(version)).select(*T.StructType.fromDDL(self.schema).names)

    def _rows(self, live: DataFrame) -> DataFrame:
        fs, data = filesystem(self.spark, self.data)
        if not fs.exists(data):
            return self.spark.createDataFrame([], f"{self.schema}, gen STRING, _part STRING")
        rows = self.spark.read.schema(f"{self.schema}, gen STRING").parquet(self.data)
        value = F.coalesce(F.col(self.partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        keys = live.select(F.col("part").alias("_part"), "gen").distinct()
        return join_small(rows.withColumn("_part", value), keys, ["_part", "gen"])  # prunes the partitions read

    def append(self, df: DataFrame, identity: list[str] | None = None) -> int:
        """Add rows as they come, without a shuffle; each task writes a file a partition. Returns the version.

        With `identity` only records are added that are not there yet, each once, and the partitions stay clean. Whether a
        record is there is then decided on one version; if another writer commits meanwhile it is a Conflict.
        """
        base = self.version()
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(self.schema)])
        if identity:
            df = self._new(df, identity, base)
        fresh = cut(self._write(df).withColumn("clean", F.lit(bool(identity))), "fresh")
        while True:
            try:
                # a partition stays clean only if what is added to it is new
                self._commit(base + 1, self.live(base).unionByName(fresh), "append")
                return base + 1
            except Conflict:
                if identity:
                    raise
                base = self.version()

    def _new(self, df: DataFrame, identity: list[str], base: int) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity]
        rest = [c for c in df.columns if c not in identity]
        once = cut(df.groupBy(*identity).agg(*[F.max(c).alias(c) for c in rest]), "arrivals")
        hit = once.select(F.coalesce(F.col(self.partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("part")).distinct()
        there = self._rows(self.live(base).join(hit, "part", "left_semi")).select(*[F.col(c).alias(f"_{c}") for c in identity])
        n = once.count()
        if n <= 50_000:  # few arrivals: those that are there are found by a scan, without moving what is stored
            keys = once.select(*identity)
            known = there.join(F.broadcast(keys), [a for a in same], "inner").select(*identity).distinct()
            there = known.select(*[F.col(c).alias(f"_{c}") for c in identity])
        return once.join(there, [a for a in same], "left_anti").select(*df.columns)

    def compact(self, identity: list[str], max_small: int, target_bytes: int, small_bytes: int | None = None) -> dict:
        """Rewrite the partitions of more than `max_small` files below `small_bytes`, and those not clean, into files of about `target_bytes`."""
        base = self.version()
        small = small_bytes or target_bytes // 2
        is_due = (F.col("n_small") > max_small) | ~F.col("clean")
        pieces = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / target_bytes)).cast("int")
        census = cut(self.census(small, base).withColumn("due", is_due).withColumn("_pieces", pieces), "census")
        of_due = lambda c: F.coalesce(F.sum(F.when(F.col("due"), c)), F.lit(0))
        facts = census.agg(F.count(F.lit(1)).alias("n"), of_due(F.lit(1)).alias("due"), of_due(F.col("n_files")).alias("files"), of_due(F.col("_pieces")).alias("pieces")).head()
        done = {"version": base, "partitions": facts["due"], "untouched": facts["n"] - facts["due"], "files_before": facts["files"]}
        if not facts["due"]:
            return done
        due = census.where("due")
        pieces = due.select(F.col("part").alias("_part"), "_pieces")
        live = self.live(base)
        rows = join_small(self._rows(live.join(due, "part", "left_semi")), pieces, ["_part"])
        rest = [c for c in rows.columns if c not in identity and c not in (self.partition, "gen", "_part", "_pieces")]
        slot = F.pmod(F.xxhash64(*identity), F.col("_pieces")).cast("int")
        # the one shuffle: a task for each file to come, and the aggregate below keeps to it
        spread = rows.withColumn("_slot", slot).repartition(2 * facts["pieces"], "_part", "_slot")
        once = spread.groupBy("_part", "_slot", self.partition, *identity).agg(*[F.max(c).alias(c) for c in rest]).drop("_part", "_slot")
        written = self._write(once).withColumn("clean", F.lit(True))
        parts = due.select("part")
        replaced = cut(live.join(parts, "part", "left_anti").unionByName(written), "manifest")
        while True:
            try:
                self._commit(base + 1, replaced, "compact")
                return done | {"version": base + 1}
            except Conflict:
                now = self.version()
                before, after = self.live(base), self.live(now)
                changed = after.exceptAll(before).unionByName(before.exceptAll(after))
                if not changed.join(parts, "part", "left_semi").isEmpty():
                    raise Conflict("changed since they were counted: partitions to be rewritten") from None
                base, replaced = now, cut(after.join(parts, "part", "left_anti").unionByName(written), "manifest")

    def sweep(self, keep: int = 1) -> int:
        """Remove the generations that none of the last `keep` versions names, and an entry broken off. Only while no one writes.

        They come to the driver one at a time. Returns their number.
        """
        fs, log = filesystem(self.spark, self.log)
        known = self.versions()
        for x in fs.listStatus(log) if fs.exists(log) else []:
            if int(x.getPath().getName()) not in known:
                fs.delete(x.getPath(), False)
        for version in known[:-keep]:
            fs.delete(filesystem(self.spark, f"{self.log}/{version}")[1], False)
        kept = [self.live(v).select("part", "gen") for v in known[-keep:]]
        named = kept[0] if kept else self.spark.createDataFrame([], "part STRING, gen STRING")
        for other in kept[1:]:
            named = named.union(other)
        dead = self.files().join(named.distinct(), ["part", "gen"], "left_anti").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
        n = 0
        for r in dead.toLocalIterator():
            fs.delete(filesystem(self.spark, r["folder"])[1], True)
            n += 1
        return n

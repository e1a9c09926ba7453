"""What every operator needs of the running session: tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted to hold no more rows than this.
BROADCAST_ROWS = 50_000
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a context: they need not have it installed, nor run in its folder."""
    sc = spark.sparkContext
    if getattr(sc, "_patchloom_shipped", False):
        return
    package = Path(__file__).parent
    code = Path(tempfile.mkdtemp(prefix="patchloom-code-")) / "patchloom_code.zip"
    with zipfile.ZipFile(code, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(code))
    sc._patchloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The application's folder in the one all executors share, `spark.checkpoint.dir`; it is removed when the JVM ends.

    Where the setting is missing, a local session gets a folder of its own, and a cluster an error. Within `scratch`, its folder.
    """
    ship(spark)
    if inner := _SCRATCH.get():
        return inner
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder; executors of a cluster need one")
        root = tempfile.mkdtemp(prefix="patchloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
    own = f"{root.rstrip('/')}/patchloom/{sc.applicationId}"
    if getattr(sc, "_patchloom_folder", None) != own:
        fs, folder = filesystem(spark, own)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)  # results may be read as long as the session lives
        sc._patchloom_folder = own
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends here, and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """The JVM file system of `path`, and the path as the JVM's own object."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def beside(rows: DataFrame, table: DataFrame, name: str, block: int = 1000, salts: int = 64) -> tuple[DataFrame, int]:
    """Each row of `rows` once for every block of `table`, whose sorted rows stand in the array `name`; and the number of blocks.

    `table` is cut from its lineage. Up to `block` rows are one array that goes to every task, an empty one if there are none.
    More are split into blocks by hash; both sides are then salted and shuffled, so that no task gets a block's every row.
    """
    n_blocks = -(-table.count() // block)
    entry = F.sort_array(F.collect_list(F.struct(*table.columns))).alias(name)
    if n_blocks <= 1:
        return rows.join(F.broadcast(table.agg(entry))), 1  # one row of at most `block` entries
    number = F.pmod(F.xxhash64(table.columns[0]), F.lit(n_blocks))
    blocks = table.groupBy(number.alias("_block")).agg(entry).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(rows.columns[0]), F.lit(salts)).cast("int"))
    spread = spread.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    return spread.join(blocks, ["_block", "_salt"]).drop("_block", "_salt"), n_blocks


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str):
    """A folder in the shared one that takes all tables cut meanwhile, and is removed with them."""
    path = shared_path(spark, label)
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        fs, folder = filesystem(spark, path)
        fs.delete(folder, True)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join with a side expected to be small: broadcast if a count proves it, else both sides are salted and shuffled.

    `how` may be inner, left, left_semi. Null keys match nothing. Salting spreads a hot key of `big` over `salts` tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith("map")]), F.lit(salts)).cast("int")
    return big.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")

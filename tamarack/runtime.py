"""Session-level helpers shared by the operators: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of files, up to which a table whose size was looked up may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Setting by which a statement's shuffle files go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table `name` below `directory`."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Only a session that runs in one process may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tamarack-")
    return _local[context.applicationId]


#: Paths to be deleted, innermost scope last; those outside of any scope go when the process ends.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def path_of(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _forget(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        spark, path = paths.pop()
        try:
            fs, p = path_of(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(lambda: [_forget(paths) for paths in reversed(_scopes)])


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What is written for the plans made inside goes when it ends; use their results inside."""
    _scopes.append([])
    try:
        yield
    finally:
        _forget(_scopes.pop())


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder that goes with the scope, or with `keep` when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[0 if keep else -1].append((spark, path))
    return path


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, gives exact row counts.

    The files go with the scope, or when the process ends. Nothing is kept on an executor: what was shuffled is deleted
    as soon as the table is written.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most so many rows and bytes, else as it is (the planner then shuffles).

    Give tables from `cut` or plain scans: their files' sizes are known, and counting them reads footers only.
    """
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if told <= size and df.count() <= rows else df


def salted_pairs(a: DataFrame, b: DataFrame, key: str, spread: str, part: int = 2000) -> DataFrame:
    """Inner join of `a` and `b` on `key`, with the keys of which `b` has more than `part` rows met in several tasks.

    Rows of such a key on the side of `b` are dealt out by the hash of `spread`, a column of `b`, over so many parts that
    each holds `part` about; the rows of `a` go to every part. Keys are counted with partial sums first.
    """
    hot = cut(b.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part).select(key, F.ceil(F.col("__n") / part).cast("int").alias("__parts")))
    if hot.isEmpty():
        return a.join(b, key)
    dealt = b.join(small(hot), key, "left").withColumn("__salt", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int")).otherwise(0)).drop("__parts")
    every = a.join(small(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return every.join(dealt, [key, "__salt"]).drop("__salt")


def met_in_cells(held: DataFrame, asked: DataFrame, held_key: str, asked_key: str, block: int, part: int, *order: str) -> DataFrame:
    """Every row of `asked` beside every row of `held`, in cells of about `block` rows of `held` and `part` of `asked`.

    A partition is a cell: first its rows of `held`, then those of `asked` (column `asked` true), each sorted by `order`.
    Columns that one side lacks are null. Give tables from `cut`: they are counted.
    """
    spark = held.sparkSession
    blocks = max(1, -(-held.count() // block))
    parts = max(1, -(-asked.count() // part), -(-cores(spark) // blocks))
    of = lambda c, n: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = held.withColumns({"__b": of(held_key, blocks), "asked": F.lit(False)}).withColumn("__s", every(parts))
    rows = rows.unionByName(asked.withColumns({"__s": of(asked_key, parts), "asked": F.lit(True)}).withColumn("__b", every(blocks)), allowMissingColumns=True)
    cells = rows.withColumn("__cell", F.col("__s") * blocks + F.col("__b")).drop("__s", "__b")
    return cells.repartitionById(parts * blocks, "__cell").sortWithinPartitions("asked", *order).drop("__cell")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of all executors, wherever it lies on the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tamarack-"), "tamarack.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tamarack", os.path.relpath(full, package)))
    context.addPyFile(target)  # served to executors by the driver
    _shipped.add(context.applicationId)

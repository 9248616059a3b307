"""Small helpers shared by the operators: lineage cuts, size checks, global row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest lookup (rows) that is shipped to every executor.  Anything above takes
# the shuffle route of the operator that asked.
BROADCAST_ROWS = 500_000

# File bytes for each part of an input that `spread` deals out.
SPREAD_BYTES = 8 * 1024 * 1024


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files; what is read later must be read from these tables."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from `spark.checkpoint.dir`.

    Only a local session without one gets a folder of its own; on a cluster that would not be
    shared, so it is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="wordloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by writing it to the checkpoint folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """`checkpoint` of `df` in `n` partitions by `keys`, which later joins on these keys know of and do not shuffle.

    An adaptive plan hides how its result is partitioned, so this one step, an exchange, is planned without.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name, None)
    conf.set(name, "false")
    try:
        return checkpoint(df.repartition(n, *keys))
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def release(df: DataFrame) -> None:
    """Delete the files of a table from `checkpoint` that nothing will read again."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stage_folder(spark: SparkSession) -> str:
    """A new folder for Parquet files in the checkpoint folder, deleted when the session ends."""
    name = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def write_stage(df: DataFrame) -> DataFrame:
    """Write a large table once, as Parquet in the checkpoint folder, and read it from there.

    The files are deleted when the session ends.
    """
    spark = df.sparkSession
    name = _stage_folder(spark)
    df.write.parquet(name)
    return spark.read.schema(df.schema).parquet(name)


def write_stage_by(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """`write_stage` of `df` in `n` buckets by `key`, sorted by it and `order`; joins on the key do not shuffle it."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order)
    writer.option("path", _stage_folder(spark)).saveAsTable(name, format="parquet")
    return spark.table(name)


def release_stage(df: DataFrame) -> None:
    """Delete the files of a table from `write_stage` or `write_stage_by` that nothing will read again."""
    spark = df.sparkSession
    relation = df._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
    if relation.catalogTable().isDefined():
        spark.sql(f"DROP TABLE {relation.catalogTable().get().identifier().quotedString()}")
    for path in relation.relation().location().rootPaths().mkString("\n").split("\n"):
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; stops reading soon after the bound."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def most_frequent(df: DataFrame, max_rows: int = BROADCAST_ROWS, count: str = "cnt") -> DataFrame:
    """The rows of `df` from some count upwards, as many as stay within `max_rows`.

    The cut is a power of two, found from one row per power.
    """
    power = F.floor(F.log2(F.col(count))).alias("power")
    rows, lowest = 0, None
    for r in df.groupBy(power).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect():
        rows += r.n
        if rows > max_rows:
            break
        lowest = r.power
    return df.where(F.col(count) >= 2**lowest) if lowest is not None else df.where(F.lit(False))


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Add a dense global row number in the given total order, without a one-task sort.

    The rows are range-partitioned and sorted, the sorted table is written so the
    partition boundaries are frozen, and each row gets its place inside its partition
    plus the number of rows in the partitions before it.  Only one (partition, count)
    row per partition goes through a single task.
    """
    ordered = write_stage(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id: partition index in the upper bits, row index in the lower 33.
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        # one row per partition of the sort above
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (inside + F.col("_before") + F.lit(start)).cast("long"))
        .drop("_place", "_part", "_before")
    )


def file_bytes(df: DataFrame) -> int | None:
    """Size of the files that `df` reads, all columns, or None if the plan does not know it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length()))
    return total if total < 1 << 60 else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of an input over all cores when its files give too few splits.

    Meant for the step from scan to text work; an input with enough splits is left alone.  The
    number of parts grows with the files, so that a task does not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, -(-(file_bytes(df) or 0) // SPREAD_BYTES)), key)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

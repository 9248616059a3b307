"""Tables written between the steps of an operator, in the shared folder of the session.

A written table cuts the lineage, survives a lost executor and is read by every executor.
The folder is `spark.checkpoint.dir`; only a local session without one gets its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wordloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Lists that note the folders made at present, see `collected`.
_NOTED: list[list] = []


@contextmanager
def collected(made: list) -> Iterator[None]:
    """Note in `made` the scratch folders that are made inside."""
    _NOTED.append(made)
    try:
        yield
    finally:
        _NOTED.remove(made)


def drop_unread(made: list, docs: DataFrame) -> None:
    """Delete the folders of `made` of which `docs` reads no file, and take them from the list."""
    files = docs.inputFiles()
    for scratch in list(made):
        if not any(scratch.name in f for f in files):
            scratch.drop("")
            made.remove(scratch)


class Scratch:
    """A folder of tables for one run of an operator.

    `drop` deletes tables that no later step reads; the rest goes when the session ends,
    because the result that the caller holds may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"llm-{name}-{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        for made in _NOTED:
            made.append(self)
        path = self._path(self.folder)
        fs = self._fs(path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return it as read from the files.

        The shuffle files behind it are deleted when it is written; nothing reads them again.
        """
        schema, before = df.schema, self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.folder}/{name}")
            self._fs(path).delete(path, True)

"""Cutting lineage: tables written to the folder that spark.checkpoint.dir names, and read again.

A table that was cut costs a lost executor no recomputation.  `Scratch.drop`
removes a table once nothing reads it any more; `scope` removes all that were
written inside; what is left goes when the Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: A table whose rows have a known bound goes to files of about so many rows.
ROWS_PER_FILE = 50_000

_open: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster; one of our own only where that is unset (tests on a local master)."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandflow-')}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """Tables of one computation, in a folder of their own."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.n = spark, 0
        self.base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _open.append(self)

    def cut(self, df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
        """Write `df` and read it again.

        With `most_rows`, a bound of its rows, partitions that would be tiny
        files are written together, without a shuffle.
        """
        self.n += 1
        if most_rows is not None:
            df = df.coalesce(max(1, -(-most_rows // ROWS_PER_FILE)))
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._files.delete(self._path(df._scratch_path), True)

    def close(self) -> None:
        self._files.delete(self._path(self.base), True)
        _open.remove(self)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Scratch tables that are made inside go when the block ends."""
    before = len(_open)
    try:
        yield
    finally:
        for scratch in _open[before:]:
            scratch.close()


@atexit.register
def _close_all() -> None:
    for scratch in list(_open):
        with contextlib.suppress(Exception):  # the JVM may be gone
            scratch.close()

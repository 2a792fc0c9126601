"""Reading the input tables, and bounds of Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import Scratch, scope

__all__ = ["Scratch", "bounded_batches", "keyed", "scope", "set_bounded_batches", "table"]

#: Bounds of an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_BOUNDS = (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, text) of the rows, and the type of doc_id, which is kept as it is."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def set_bounded_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows and about BATCH_BYTES bytes of whole texts be one Arrow batch, from now on in this session.

    Spark reads the settings when a plan runs.  Smaller plain numbers of the session's own are kept.
    """
    for key, most in _BOUNDS:
        found = spark.conf.get(key).rstrip("b")
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs inside the block; the session's own settings hold again after it."""
    before = {key: spark.conf.get(key) for key, _ in _BOUNDS}
    set_bounded_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def sampled_ids(labels: DataFrame, label: str, per_class: dict[int, int], keep: Column) -> DataFrame:
    """(doc_id, label) of about per_class[v] rows of each label v that `keep` admits; the greatest label of an id holds.

    The rows are those with the least hashes, so that the choice depends on
    nothing but the ids.  Null ids and labels are left out.
    """
    return sample(labels, label, per_class, keep)[0]


def sample(labels: DataFrame, label: str, per_class: dict[int, int], keep: Column) -> tuple[DataFrame, dict[int, float]]:
    """The rows of `sampled_ids`, and the rate at which each label that occurs was sampled."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    counts = {r[label]: r["n"] for r in known.where(F.col(label).isin(*per_class)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    some, rates = F.lit(False), {}
    for value, most in per_class.items():
        if counts.get(value):
            bound = int(scale * min(1.0, most / counts[value]))
            rates[value] = bound / scale
            some = some | ((F.col(label) == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < bound))
    return known.where(some), rates

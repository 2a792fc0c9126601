"""The corpus pipeline: five stages from raw documents to tokens, each a step of strandflow.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes
as Parquet to the shared folder and reads again as the next stage's docs.  All
but the last return the columns of documents.

All stages take null and repeated ids, null, empty and very long texts, repeated
rows, empty tables and extra columns, which they keep.  Null texts aren't toxic,
nobody's copy, not contaminated, hold no personal data, and have null ids.  The
stages bound the Arrow batches of the session that they run in, and leave that
setting, since Spark reads it when the returned plan runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import decontam, neardup, pii, spm, toxicity
from strandflow.llm._labels import remainder
from strandflow.llm._store import Scratch, scope, set_bounded_batches, table
from strandflow.llm.queries import SPM_FILE, tokenizer_path

#: Five-word shingles and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    set_bounded_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked, one with the least id stays, and rows without words do; each row goes by its own text, whatever rows share its id."""
    return neardup.deduplicated(spark, docs, SHINGLE_WORDS, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go, whether or not the item has an id."""
    set_bounded_batches(spark)
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text."""
    set_bounded_batches(spark)
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number and digests, and whether decoding gave the text back."""
    set_bounded_batches(spark)
    return spm.encoded(docs, tokenizer_path(SPM_FILE), digests=True, keep_nulls=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]

#: SQL can express neither the label model nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of the documents that all stages keep; tables between the stages go as soon as the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scope():
            out = scratch.cut(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(docs)
        docs = out
    return docs

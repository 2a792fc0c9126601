"""Queries over the operators of reads: overlaps and their layout, anchors and their chains, alignments of text pairs, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..lineage import Scratch
from ..operators import chains, minimizers, overlaps
from . import catalogue as cat
from .registry import register, table

#: Letters of a slice, from one slice to the next, and of the strings that slices meet by.
SLICE, STEP, MEET = 400, 100, 64


@register(f"""WITH g AS (SELECT doc_id, text, substr(text, i, {MEET}) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - {MEET - 2})) AS i FROM documents WHERE length(text) > {SLICE})),
once AS (SELECT doc_id FROM g GROUP BY doc_id HAVING count(*) = count(DISTINCT s))
SELECT doc_id, md5(text) AS contig_md5, CAST((length(text) - {SLICE} + {STEP - 1}) // {STEP} + 1 AS INTEGER) AS n_reads FROM documents SEMI JOIN once USING (doc_id)""")
def assemble_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut into overlapping slices, which the overlap graph lays out again: those in which no {MEET} letters repeat, as a layout is unique for no others."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") > SLICE)
    # steps are found in one walk over a text, before slices are rows; a substring would walk to its place from the first letter
    d = texts.where(~minimizers.has_repeat("text", MEET)).withColumn("steps", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0)))
    at = F.explode(F.sequence(F.lit(0), F.ceil((F.length("text") - SLICE) / STEP).cast("int") * STEP, F.lit(STEP)))
    cut = d.select("doc_id", "steps", at.alias("at")).select("doc_id", F.xxhash64("doc_id", "at").alias("seg_id"), F.array_join(F.slice("steps", (F.col("at") / STEP).cast("int") + 1, SLICE // STEP), "").alias("seq"))
    letters = texts.groupBy("doc_id").agg(F.sum((F.length("text") / STEP + 1) * SLICE).alias("_letters"))
    laid = overlaps.layout(cut, ["doc_id"], 2, Scratch(spark, "slices"), k=MEET, min_overlap=MEET, letters=letters)
    return laid.select("doc_id", F.md5("laid").alias("contig_md5"), F.col("n_reads").cast("int").alias("n_reads"))


_CHAINED = f"""WITH RECURSIVE {cat.KMER}, a AS (SELECT DISTINCT doc_id, item_id, g.p AS q, h.p AS t FROM g JOIN h USING (gram)),
l AS (SELECT doc_id, item_id, list({{'q': q, 't': t}} ORDER BY q, t) AS l FROM a GROUP BY doc_id, item_id),
s(doc_id, item_id, i, r) AS (
  SELECT doc_id, item_id, 0, CAST([] AS STRUCT(f BIGINT, n BIGINT, q0 BIGINT, t0 BIGINT, q BIGINT, t BIGINT)[]) FROM l
  UNION ALL
  SELECT doc_id, item_id, i + 1, list_append(r, CASE WHEN b IS NULL THEN {{'f': {chains.WEIGHT}, 'n': 1, 'q0': x.q, 't0': x.t, 'q': x.q, 't': x.t}}
    ELSE {{'f': b.k + {chains.WEIGHT}, 'n': b.n + 1, 'q0': b.q0, 't0': b.t0, 'q': x.q, 't': x.t}} END)
  FROM (SELECT doc_id, item_id, i, r, x, list_max(list_filter(list_transform(list_filter(r, lambda y: y.q < x.q AND y.t < x.t),
          lambda y: {{'k': y.f - {chains.COST} * (x.q - y.q + x.t - y.t), 'n': y.n, 'q0': y.q0, 't0': y.t0}}), lambda z: z.k > 0)) AS b
        FROM (SELECT s.*, l[i + 1] AS x FROM s JOIN l USING (doc_id, item_id) WHERE i < len(l)))),
e AS (SELECT s.doc_id, s.item_id, list_max(r) AS m FROM s JOIN l USING (doc_id, item_id) WHERE i = len(l))
SELECT doc_id, item_id, m.f AS score, m.n AS n_anchors, m.q0 AS q_lo, m.q AS q_hi, m.t0 AS t_lo, m.t AS t_hi FROM e"""


@register(_CHAINED)
def collinear_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chain of shared word strings of each document and benchmark item; SQL compares all pairs of anchors."""
    found = cat.seeds(spark, sf_dir).select("doc_id", "item_id", F.col("p").alias("q_pos"), F.col("ip").alias("t_pos"))
    return chains.chains(found, ["doc_id", "item_id"], all_chains=False)


@register(None)
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of benchmark items to the documents that share minimizers with them; tests hold them against a plain program."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q_seq")).where("q_seq is not null")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("t_id"), F.col("text").alias("t_seq")).where("t_seq is not null")
    found = chains.align(items, docs, k=24, w=8, min_anchors=4, min_score=60, both_strands=False)
    return found.select(F.col("q_id").cast("long").alias("item_id"), F.col("t_id").cast("long").alias("doc_id"), "score", "q_start", "q_end", "t_start", "t_end", "cigar", "nm")


#: Three boosted trees over features of event clusters, as a model file has them.
TREES = [
    {"feature": ["n", "entropy", None, None, None], "threshold": [3, 0.5, None, None, None], "left": [1, 3, None, None, None], "right": [2, 4, None, None, None], "value": [None, None, 0.9, -1.25, -0.5]},
    {"feature": ["mean_value", None, "n", None, None], "threshold": [50.0, None, 6, None, None], "left": [1, None, 3, None, None], "right": [2, None, 4, None, None], "value": [None, 0.25, None, -0.75, 0.5]},
    {"feature": ["balance_ratio", None, None], "threshold": [0.25, None, None], "left": [1, None, None], "right": [2, None, None], "value": [None, -0.125, 0.375]},
]


def as_case(tree: dict, node: int = 0) -> str:
    """A tree as nested CASE; a null goes right."""
    if tree["feature"][node] is None:
        return str(tree["value"][node])
    return f"CASE WHEN {tree['feature'][node]} <= {tree['threshold'][node]} THEN {as_case(tree, tree['left'][node])} ELSE {as_case(tree, tree['right'][node])} END"


@register(f"WITH {cat.EV}, {cat.GC}, {cat.FEAT} SELECT user_id, idx, round(1 / (1 + exp(-(-0.5 + {' + '.join(map(as_case, TREES))}))), 6) AS probability FROM fx")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.Forest(TREES, bias=-0.5)
    return scoring.scored(cat.featured(spark, sf_dir), model, ["user_id", "idx"], model.features).select("user_id", "idx", F.round("probability", 6).alias("probability"))

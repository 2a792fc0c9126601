"""The registered queries of the ten operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, gif, langid, neardup, pii, quality, repair, rules, spm, tokencount, toxicity
from ._store import Scratch, table

#: Files of public tokenizers; the folder is a parameter of the functions below.
BPE_FILE, SPM_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(gif.store_texts(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    return chat.formatted(rows.unionByName(extra))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2)


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), path or tokenizer_path(BPE_FILE))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return spm.digest(table(spark, sf_dir, "documents"), path or tokenizer_path(SPM_FILE))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repairs(rows, Scratch(spark, "repair"), times)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), Scratch(spark, "rules"))


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op12's base rule alone, which SQL can say."""
    return rules.counted(table(spark, sf_dir, "documents")).select("doc_id", *rules.FEATURES[:5], rules.base_failed().alias("base_failed"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"), Scratch(spark, "divergence"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_media, op3_quality, op4_chat, op5_pii, op6_language, op7_toxicity, op8_neardup, op9_token_counts, op10_sentencepiece, op11_conversation_repair, op12_quality_rules, quality_rule_counts, op13_divergence, pipeline)
}

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"regexp_extract_all(" + _FOLD.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLE_WORDS = r"regexp_extract_all(" + _FOLD.format("text") + r", '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[p:p + k - 1], ' ') AS gram
        FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dp AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT dp.doc_id, dp.k, dp.p, win.item FROM dp JOIN win ON dp.k = win.k AND dp.gram = win.gram),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('### ') + length(replace(replace(role, '\', '\\'), ':', '\:')) + length(': ')
           + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length(' </turn>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_neardup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM d),
c AS (SELECT min(doc_id) AS rep, s FROM s WHERE len(s) > 0 GROUP BY s),
pair AS (SELECT a.rep AS u, b.rep AS v, len(list_intersect(a.s, b.s)) AS m, len(a.s) + len(b.s) AS n
         FROM c a JOIN c b ON a.rep < b.rep AND 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))),
link AS (SELECT u, v FROM pair WHERE 100 * m >= 80 * (n - m)),
e AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND s.s = c.s LEFT JOIN k ON c.rep = k.rep""",
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS v FROM range(256) b(n))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM conversations),
k AS (SELECT src.* EXCLUDE (b), xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 20 AS kind FROM src, crc),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
flt AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f FROM pos),
adj AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM flt),
one AS (SELECT conv_id, list({'c': c, 'm': f IN ('b', 'd'), 't': CASE WHEN f = 't' THEN 3 ELSE 0 END} ORDER BY i) AS l, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM adj GROUP BY conv_id),
step(conv_id, i, s0, a0, s1, a1, s2, a2, s3, a3) AS (
  SELECT conv_id, 0, 0, '', 1000000000, '', 1000000000, '', 1000000000, '' FROM one
  UNION ALL
  SELECT conv_id, i + 1, n0.s, n0.a, n1.s, n1.a, n2.s, n2.a, n3.s, n3.a FROM (
    SELECT conv_id, i, {'s': q0.s + 4, 'a': q0.a || 'D'} AS n0,
      list_min([{'s': q1.s + 4, 'a': q1.a || 'D'}] || CASE WHEN NOT r.m AND r.c = 's' THEN [{'s': q0.s + r.t, 'a': q0.a || 'K'}] ELSE [] END) AS n1,
      list_min([{'s': q2.s + 4, 'a': q2.a || 'D'}] || CASE WHEN NOT r.m THEN [{'s': q0.s + r.t + 3, 'a': q0.a || 'R'}, {'s': q1.s + r.t + 3, 'a': q1.a || 'R'}, {'s': q3.s + r.t + 3, 'a': q3.a || 'R'}] ELSE [] END
        || CASE WHEN NOT r.m AND r.c = 'u' THEN [{'s': q0.s + r.t, 'a': q0.a || 'K'}, {'s': q1.s + r.t, 'a': q1.a || 'K'}, {'s': q3.s + r.t, 'a': q3.a || 'K'}] ELSE [] END) AS n2,
      list_min([{'s': q3.s + 4, 'a': q3.a || 'D'}] || CASE WHEN NOT r.m THEN [{'s': q2.s + r.t + 3, 'a': q2.a || 'R'}] ELSE [] END || CASE WHEN NOT r.m AND r.c = 'a' THEN [{'s': q2.s + r.t, 'a': q2.a || 'K'}] ELSE [] END) AS n3
    FROM (SELECT *, list_min([p2, {'s': q3.s + 3, 'a': q3.a || 'I'}]) AS q2 FROM (
      SELECT *, list_min([{'s': s3, 'a': a3}, {'s': p2.s + 3, 'a': p2.a || 'I'}]) AS q3 FROM (
        SELECT step.*, l[i + 1] AS r, {'s': s0, 'a': a0} AS q0, {'s': s1, 'a': a1} AS q1,
               list_min([{'s': s2, 'a': a2}, {'s': s0 + 3, 'a': a0 || 'I'}, {'s': s1 + 3, 'a': a1 || 'I'}, {'s': s3 + 3, 'a': a3 || 'I'}]) AS p2
        FROM step JOIN one ON step.conv_id IS NOT DISTINCT FROM one.conv_id WHERE i < len(l)))))),
fin AS (SELECT step.conv_id, list_min([{'s': s0, 'a': a0}, {'s': s3, 'a': a3}, {'s': s2 + 3, 'a': a2 || 'I'}, {'s': s1 + 6, 'a': a1 || 'II'}]) AS x FROM step JOIN one ON step.conv_id IS NOT DISTINCT FROM one.conv_id WHERE i = len(l)),
ops AS (SELECT conv_id, j, substr(x.a, j, 1) AS op, length(replace(left(x.a, j), 'I', '')) AS i FROM (SELECT conv_id, x, unnest(range(1, length(x.a) + 1)) AS j FROM fin)),
lines AS (SELECT o.conv_id, o.j, o.op, p.role, p.text, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.j) AS m FROM ops o LEFT JOIN pos p ON o.op <> 'I' AND o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i WHERE o.op <> 'D'),
sys AS (SELECT conv_id, CAST(bool_or(m = 1 AND op = 'K' AND left(role, 1) = 's') AS INTEGER) AS s FROM lines GROUP BY conv_id),
txt AS (SELECT lines.conv_id, string_agg(CASE op WHEN 'K' THEN role ELSE CASE WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
        FROM lines JOIN sys ON lines.conv_id IS NOT DISTINCT FROM sys.conv_id GROUP BY lines.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(x.s, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN one ON o.conv_id IS NOT DISTINCT FROM one.conv_id LEFT JOIN fin ON o.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN txt ON o.conv_id IS NOT DISTINCT FROM txt.conv_id""",
    "quality_rule_counts": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) > 4)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM hit) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed
FROM n LEFT JOIN rep USING (r)""",
    "op13_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, k.c, coalesce(own.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)),
total AS (SELECT lang, source, sum(n) AS n FROM grid GROUP BY ALL),
p AS (SELECT grid.lang, source, term, grid.n, CAST(1 + (1000000000::HUGEINT * (grid.n + 2)) // CAST(total.n + 2 * v AS HUGEINT) AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (c + 2)) // CAST(l.n + 2 * v AS HUGEINT) AS BIGINT) AS q
      FROM grid JOIN total USING (lang, source) JOIN l USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
           UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked""",
}

import corpus_pipeline
import duckdb
import pytest
from test_other_operators import components

from strandflow.llm import decontam, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The tables between the stages."""
    at = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(at / name))
        out.append(spark.read.parquet(str(at / name)))
    return out


def test_stages_keep_the_columns(steps):
    assert [len(corpus_pipeline.STAGES), *(s.columns == steps[0].columns for s in steps[:-1])] == [5, True, True, True, True, True]


def test_decisions_take_effect(spark, steps):
    raw, polite, single, clean, private, last = steps
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(single) == {r[0] for r in components([(r.doc_id, r.text) for r in polite.collect()], 5) if r[3]}  # brute force
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in decontam.brute_force([(r.doc_id, r.text) for r in single.collect()], bench) if r[-1]}
    assert hit and ids(clean) == ids(single) - hit
    for r in private.collect():
        assert pii.brute_force(r.text)[0] == [0, 0, 0, 0] and r.n_chars == len(r.text)
    assert ids(last) == ids(private) and all(r.round_trip for r in last.collect())
    assert ids(polite) <= ids(raw)


def test_run_equals_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "sentencepiece":
                assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_chat", "op8_neardup"])
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    own = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert own == sorted((tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES if n != "quality_rule_counts"] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]

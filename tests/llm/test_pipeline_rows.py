import corpus_pipeline

from strandflow.llm import decontam


def test_rows_are_judged_by_their_own_text(spark, odd_docs, no_docs):
    docs = odd_docs.limit(0).unionByName(odd_docs)
    item = spark.createDataFrame([(1, "no id AT all"), (2, None), (None, "same text here twice over"), (3, "...")], "item_id long, text string")
    kept = decontam.uncontaminated(docs, item).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert sorted(map(repr, decontam.uncontaminated(docs, item.where("1 = 0")).collect())) == sorted(map(repr, docs.collect()))
    assert decontam.uncontaminated(no_docs, item).collect() == []


def test_blocks_of_items_find_what_one_automaton_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = ids(decontam.uncontaminated(docs, bench))
    assert ids(decontam.contamination(spark, docs, bench).where("n_hit = 0")) == one
    assert ids(decontam.uncontaminated(docs, bench, block_bytes=4_000)) == one


def test_the_stage_uses_items_without_an_id(spark, odd_docs, tmp_path):
    rows = [(None, "same text here twice over"), (None, "no id AT all"), (None, None), (1, "!!")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [0, 1, 2, 3, 6, 7, 8]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, odd_docs, str(tmp_path)).collect()) == left
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in decontam.uncontaminated(odd_docs, bench, block_bytes=10, unnamed=True).collect()) == left

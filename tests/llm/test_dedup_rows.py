import corpus_pipeline

A = "one two three four five six seven eight nine ten eleven twelve"
B = "quite another text that no other row of this table has at all"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_a_row_goes_by_its_own_text(spark):
    assert kept(spark, [(3, A), (7, A.upper()), (7, B), (7, "")]) == [(3, A), (7, ""), (7, B)]
    assert kept(spark, [(5, A), (5, A), (5, B)]) == sorted([(5, A), (5, B)])
    assert kept(spark, [(9, A), (2, A), (2, B), (4, B), (1, "alone")]) == sorted([(1, "alone"), (2, A), (2, B)])
    assert len(kept(spark, [(5, A), (5, A + "  "), (5, A.upper()), (6, A)])) == 1


def test_null_ids_that_are_copies_go(spark):
    assert kept(spark, [(None, A), (4, A), (None, B), (None, B), (None, None), (None, "")]) == sorted([(4, A), (None, B), (None, None), (None, "")], key=repr)
    assert kept(spark, [(None, A), (4, A)]) == [(4, A)]


def test_one_row_of_each_set_of_odd_documents(spark, odd_docs, no_docs):
    out = corpus_pipeline.drop_near_duplicates(spark, odd_docs, "")
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([0, 1, 2, 3, 4, None, 6, 7, 8], key=repr)
    rows = {repr(r) for r in odd_docs.collect()}
    assert all(repr(r) in rows for r in out.collect())
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").count() == 0

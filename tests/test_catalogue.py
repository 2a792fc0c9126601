import os

import pytest

from strandflow.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def shown(rows, names):
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in (r[names.index(n)] for n in sorted(names))) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(rel.fetchall(), rel.columns)


def test_equal_annotations_of_different_items_stay(spark, tmp_path):
    """Items 500 parts and 80 suppliers apart are annotated alike; one part of one supplier on two lines is one element."""
    import duckdb

    rows = [(1, 36, 17, 3), (1, 536, 97, 7), (1, 40, 18, 1), (1, 40, 18, 2), (1, 40, 18, 5), (2, 7, 9, 4), (2, 507, 89, 8), (2, 507, 89, 4), (2, 60, 30, 2), (3, 5, 5, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("region_strings", "structure_flags", "outer_elements"):
        df, rel = catalogue.queries()[name](spark, str(tmp_path)), c.sql(catalogue.oracle_sql()[name])
        assert shown([tuple(r) for r in df.collect()], df.columns) == shown(rel.fetchall(), rel.columns), name
        assert name != "region_strings" or {r.k: r.target_region.count("Poly") for r in df.collect()} == {1: 2, 2: 2, 3: 1}


def test_scoring_run_matches_a_plain_fold(spark):
    """The same runs from a fold that keeps every prefix in sight."""

    def fold(seq):
        out, start = [], 0
        while start < len(seq):
            score = top = miss = 0
            best, end = start - 1, len(seq)
            for i in range(start, len(seq)):
                score += {"A": 1, "T": -1}.get(seq[i], -3)
                miss += seq[i] != "A"
                if score > top:
                    top, best = score, i
                if score < 0 or miss > 10:
                    end = i + 1
                    break
            size, n = best - start + 1, len(seq)
            if size >= 5 and (n - size + 1) * 0.25**size <= 0.01:
                out.append((best, size))
            start = end
        return out

    got = {}
    for r in catalogue.scoring_run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.run, r.end, r.len))
    table = str.maketrans("aeiouthnrsd ,.", "AAAAAAAAAAATTT")
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert [x[1:] for x in sorted(got.get(r.doc_id, []))] == fold(r.text.lower().translate(table))


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["user_id", "idx", "n", "probability", "n_ref", "frequency", "genotype"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

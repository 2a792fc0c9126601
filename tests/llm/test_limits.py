"""What grows without a bound in the text, the languages, the items or the columns."""

import random
import re
import time

from strandflow.llm import decontam, gif, langid, neardup, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_many_languages_are_all_learned(spark):
    rng = random.Random(1)
    roots = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(700)]
    rows = [(i, f"{roots[i % 700]} {roots[i % 700]}a {roots[i % 700]}", f"l{i % 700:03d}", "x") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bound string")
    model = langid.train(docs, langid.F.lit(True))
    assert len(model.languages) == 700 and model.weights is not None
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs.where("doc_id < 700"), model).collect()}
    assert len(got) == 700 and set(got.values()) <= set(model.languages)


def test_few_languages_stay_right(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "der hund lief zum haus ") * 3 + str(i), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs, langid.train(docs, langid.F.col("doc_id") < 150)).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(150, 200))


def test_long_runs_cost_their_length():
    texts = ["a" * 500_000 + " " + "b" * 500_000 + "@x.yz", ("a" * 500 + "@") * 2000, "1" * 1_000_000, "a." * 500_000 + "@x.yz", "1." * 500_000, ("+1" + "(" * 1000) * 1000, "AB12" * 250_000]
    for t in texts:
        start = time.perf_counter()
        pii.find_spans(t)
        assert time.perf_counter() - start < 20, t[:20]
    assert pii.emails(texts[0]) == [(500_001, 1_000_006)]


def test_base_patterns_are_theirs():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1.@- é+2") for _ in range(rng.randrange(70)))
        assert pii.emails(t) == [m.span() for m in EMAIL.finditer(t)], t
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in IP.finditer(t)], t


def test_helper_columns_may_clash(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (2, long + " more", "b"), (2, "another text altogether, of its own words " * 3, "c"), (3, "third one " * 9, "d")]
    names = ("_id", "_cls", "set", "SET_", "heir_id", "heir_cls", "row", "_row")
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = neardup.deduplicated(spark, docs)
    assert got.columns == docs.columns and sorted(r.source for r in got.collect()) == ["a", "c", "d"]


def test_one_huge_item_is_cut_too(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(9_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "only five words are here"), (3, " ".join(words[100:110])), (4, "...")], "item_id long, text string")
    docs = [(0, " ".join(words[4990:5020])), (1, "x " + " ".join(words[1995:2010]) + " y"), (2, " ".join(words[8985:]) + " z"), (3, "we say only five words are here today"), (4, " ".join(words[:9])), (5, " ".join(words)), (6, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontam.digest(decontam.contamination(spark, frame, bench)).collect())
    one = found()
    sizes = []
    build = decontam.Automaton.__init__
    monkeypatch.setattr(decontam.Automaton, "__init__", lambda self, items, window=10: (build(self, items, window), sizes.append(len(self.depth)))[0])
    monkeypatch.setattr(decontam, "MOST_STATES", 30_000)
    monkeypatch.setattr(decontam, "PIECE", 500)
    assert found() == one and len(sizes) > 2 and max(sizes) <= 30_000
    want = {0: 30, 1: 15, 2: 15, 3: 5, 4: 0, 5: 9_000, 6: 0}
    assert {r[0]: r[2] for r in one} == want


def test_frames_keep_the_type_of_ids(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, text string")
    got = gif.frames_of(gif.store_texts(docs)).collect()
    assert {r.doc_id for r in got} == {"a", "b"} and all(r.error is None and sum(r.histogram) == r.width * r.height for r in got if r.histogram)

"""Conversation repair, quality rules and source divergence against plain versions, and their odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from strandflow.llm import divergence, queries, repair, rules
from strandflow.llm._slices import group_slices, slices, xxh64
from strandflow.llm._store import Scratch

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def sql(name, **tables):
    con = duckdb.connect()
    for k, df in tables.items():
        con.register(k, df)
    return con.sql(queries.ORACLES[name])


def rows_of(found):
    """Rows of a Spark frame or a relation, with columns by name."""
    rows, cols = (found.fetchall(), found.columns) if hasattr(found, "fetchall") else (found.collect(), found.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


# --- slices


def test_xxh64_equals_the_library_and_collisions_are_split():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 150))) for _ in range(500)] + [b"", b"a", b"a" * 31, b"a" * 32, b"a" * 5000]
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    words = [rng.choice([b"one", b"two", b"six", b"three", b"seven"]) for _ in range(300)]
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    for hashed in (xxh64, lambda d, a, b: (b - a).astype(np.uint64), lambda d, a, b: np.zeros(len(a), np.uint64)):
        of, first = group_slices(data, starts, ends, hashed)
        assert len(first) == 5 and [words[first[i]] for i in of] == words
    assert slices(data, starts[:2], ends[:2]).to_pylist() == [w.decode() for w in words[:2]]


# --- op11


def every_repair(rows, most=2):
    """(cost, audit) by trying all edits with at most `most` insertions in a row."""
    found = repair.faults(rows)
    best = None
    for ops in itertools.product("KRD", repeat=len(rows)):
        if any(o != "D" and f in ("blank", "duplicate") for o, f in zip(ops, found, strict=True)):
            continue
        for ins in itertools.product(range(most + 1), repeat=len(rows) + 1):
            slots = []  # what each output may be: a fixed letter, or either
            audit, cost = "", 0
            for i, o in enumerate([*ops, ""]):
                audit += "I" * ins[i] + o
                cost += 3 * ins[i]
                slots += ["ua"] * ins[i]
                if o in ("K", "R"):
                    slots.append(rows[i][1][:1] if o == "K" else "ua")
                    cost += (3 if o == "R" else 0) + (3 if found[i] == "truncated" else 0)
                elif o == "D":
                    cost += 4
            for want in ("ua" * (len(slots) // 2), "s" + "ua" * (len(slots) // 2)):
                if len(want) == len(slots) and want != "s" and all(s and w in s for w, s in zip(want, slots, strict=True)):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_search_equals_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", " ", "Well.", "Hm!"])) for i in range(rng.randrange(0, 4))]
        assert repair.cheapest([r[1][:1] for r in rows], repair.faults(rows)) == every_repair(rows), rows


def conversations(rng, n, longest):
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            turn = rng.choice([t, t, t, None, t + 2])
            out.append((c if c else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", " ", "Well then.\n", "Hm!", "ok " * rng.randrange(1, 4) + ".", None])))
    return out


@pytest.mark.parametrize("rows_a_block", [1024, 3, 1])
def test_repair_equals_sql_whatever_the_blocks(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", rows_a_block)
    rows = conversations(random.Random(rows_a_block), 25, 14)
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t % 40}" + ".!?,"[t % 4]) for t in range(400)]  # most of all rows, over all partitions
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")  # names that the operator makes too
    damaged, times = repair.damaged(df)
    got = repair.repairs(damaged, Scratch(spark, "test"), times)
    want = sql("op11_conversation_repair", conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows_of(got) == rows_of(want)


def test_repair_of_odd_conversations(spark):
    schema = "conv_id string, turn int, role string, text string, cost string, audit string"
    long = "word " * 400_000 + "."
    rows = [("a", 1, "user", long), ("a", 2, "assistant", "Yes."), ("b", None, "user", "Same."), ("b", None, "user", "Same."), ("c", 5, "system", "Only this.")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {r.conv_id: r for r in repair.repairs(df, Scratch(spark, "test")).collect()}
    assert got["a"].audit == "KK" and got["a"].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()
    assert (got["b"].audit, got["b"].duplicate, got["b"].cost, got["b"].gaps) == ("DKI", 1, 7, 0) or got["b"].audit == "KDI"
    assert (got["c"].audit, got["c"].cost) == ("D", 4) and got["c"].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert repair.repairs(df.where("1 = 0"), Scratch(spark, "test")).count() == 0


# --- op12


def plain_counts(t):
    w = re.findall(rf"[^{SPACE}]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(rf"[^{SPACE}]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "cé ", "# ", "\n", "日 ", "\r\n", ". "]) for _ in range(rng.randrange(0, 80))) for _ in range(400)]
    texts += ["a b c d e " * 30_000, "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in rules.counted(df).collect():
        assert tuple(r)[1:6] == plain_counts(texts[r.doc_id]), r


def test_windows_are_confirmed_by_words(monkeypatch):
    monkeypatch.setattr(rules, "mix", lambda h: np.zeros(len(h), np.uint64))  # every hash collides
    of, doc = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5]), np.array([0] * 12 + [1] * 5)
    assert rules.repeated(of, doc).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 6


def test_rates_are_found_without_labels():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    hit = np.array([0.5, 0.6, 0.4, 0.5])
    votes = np.where(good[:, None], np.where(rng.random((20_000, 4)) < 0.02, -1, rng.integers(0, 2, (20_000, 4))), np.where(rng.random((20_000, 4)) < hit, -1, 0))
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    share, on_bad, on_good = rules.estimate(pattern, n.astype(float))
    assert abs(share - 0.8) < 0.03 and np.allclose(on_bad[:, 0], hit, atol=0.05) and (on_good[:, 0] < 0.04).all()
    share, on_bad, on_good = rules.estimate(np.zeros((0, 4)), np.zeros(0))
    assert share == 0.8 and np.allclose(on_bad[0], rules.ON_BAD)


def test_rules_keep_clean_texts_and_find_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality_rules(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    clean, junk = got[(got.quality == 1) & ~got.base_failed], got[(got.quality == 0) & ~got.base_failed]
    assert clean.kept.mean() > 0.99 and (~junk.kept).mean() > 0.9
    assert not got[got.base_failed].kept.any() and (got.kept | got.base_failed | (got.score < 0.5)).all()


def test_base_counts_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.quality_rule_counts(spark, sf)
    assert rows_of(got) == rows_of(sql("quality_rule_counts", documents=pd.read_parquet(f"{sf}/documents.parquet")))


def test_rules_of_odd_documents(spark, odd_docs, no_docs):
    got = rules.judged(odd_docs, Scratch(spark, "test")).collect()
    assert len(got) == odd_docs.count() and {r.doc_id for r in got if r.base_failed} >= {0, 1, 2, 4, 5, 6, 7, 8}
    assert [r.n_words for r in got if r.doc_id == 0] == [0] and not any(r.kept for r in got if r.base_failed)
    assert rules.judged(no_docs, Scratch(spark, "test")).count() == 0


# --- op13


def test_divergence_equals_sql(spark, monkeypatch):
    rng = random.Random(9)
    names = ["ant", "Bee", "cät", "dog", "eel", "日本", "x" * 40, "rare"]
    docs = [(i, " ".join(rng.choice(names[: rng.randrange(2, 8)]) for _ in range(rng.randrange(0, 30))) if i % 17 else None, rng.choice(["en", "de", "", None]), rng.choice(["a", "B", "é", "", None, "hot", "hot", "hot"])) for i in range(500)]
    docs += [(900, "", "fr", "s"), (901, "alone", "fr", "t"), (902, None, "it", "only")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id int, text string, lang string, source string, p int, term string")
    want = rows_of(sql("op13_divergence", documents=pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"])))
    assert rows_of(divergence.divergences(df, Scratch(spark, "test"))) == want
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 3)
    monkeypatch.setattr(divergence, "TABLE_ROWS", 5)
    assert rows_of(divergence.divergences(df.repartition(5), Scratch(spark, "test"))) == want
    assert divergence.divergences(df.where("1 = 0"), Scratch(spark, "test")).count() == 0


def test_pair_sums_equal_dense_ones():
    rng = np.random.default_rng(4)
    for s, v in ((1, 3), (2, 0), (5, 40), (9, 7)):
        base = rng.integers(1, 1000, s)
        dense = np.where(rng.random((s, v)) < 0.4, rng.integers(1, 10**9, (s, v)), 0)
        row, col = np.nonzero(dense)
        a, b, got = divergence.pair_sums(row, col, dense[row, col], base, v)
        full = np.where(dense > 0, dense, base[:, None])
        assert got.tolist() == [sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(full[i], full[j], strict=True)) for i, j in zip(a, b, strict=True)]


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 9_000_000_000_000_001, 9_100_000_000_000_007, 123
    got = spark.sql(f"select {n}L n, {total}L t, {v}L v").select(divergence._share(*(divergence.F.col(c) for c in "ntv"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)

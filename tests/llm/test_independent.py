"""Results against plain versions that share no code with the operators."""

import bisect
import hashlib
import math
import os
import random
import struct
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import chat, decontam, gif, langid, neardup, pii, quality, spm, toxicity
from strandflow.llm._labels import remainder
from strandflow.llm.queries import SPM_FILE, tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# ---- media


def plain_lzw(stream, size, pixels):
    """Bit by bit, with a dictionary of tuples."""
    bits, at = "".join(f"{b:08b}"[::-1] for b in stream), 0
    clear, end = 1 << size, (1 << size) + 1
    width, table, last, out = size + 1, {}, None, []
    while len(out) < pixels:
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == end:
            break
        if code == clear:
            width, table, last = size + 1, {i: (i,) for i in range(clear)}, None
            continue
        entry = table[code] if code in table else (*last, last[0])
        out += entry
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = (*last, entry[0])
        last = entry
        if len(table) + 2 == 1 << width and width < 12:
            width += 1
    return bytes(out)


def plain_payload(raw):
    """Colour numbers of all images of a GIF with one colour table, read block by block."""
    at, out = 13 + 3 * (2 << (raw[10] & 7)), b""

    def blocks(at):
        parts = []
        while raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        return b"".join(parts), at + 1

    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            _, at = blocks(at + 2)
        else:
            w, h = struct.unpack_from("<HH", raw, at + 5)
            stream, end = blocks(at + 11)
            out, at = out + plain_lzw(stream, raw[at + 10], w * h), end
    return out


def test_media_are_what_a_plain_decoder_reads():
    rng = random.Random(2)
    texts = ["", "a", "x" * 5_000, "".join(chr(rng.randrange(32, 0x300)) for _ in range(30_000)), "ab" * 30_000, "".join(rng.choice("ab") for _ in range(60_000))]
    for t in texts:
        payload = gif.padded(t.encode())
        assert plain_payload(gif.encode(payload)) == payload == gif.payload_of(gif.decode(gif.encode(payload)))


def late_clear(data, size):
    """A code stream of an encoder that goes on with a full table and sends no second clear code."""
    clear = 1 << size
    table, word, codes, widths = {(i,): i for i in range(clear)}, (), [clear], [size + 1]
    width = size + 1

    def put(code):
        codes.append(code)
        widths.append(width)

    for b in data:
        if (*word, b) in table:
            word = (*word, b)
            continue
        put(table[word])
        if len(table) + 2 < 4096:
            table[(*word, b)] = len(table) + 2
            if len(table) + 2 > 1 << width and width < 12:
                width += 1
        word = (b,)
    put(table[word])
    if len(table) + 2 == 1 << width and width < 12:  # the reader has added an entry meanwhile
        width += 1
    put(clear + 1)
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in zip(codes, widths, strict=True))
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [2, 5, 8])
def test_streams_with_a_full_table(size):
    rng = random.Random(size)
    for n in (1, 2, 40, 9_000, 60_000):
        for letters in (1, 2, 1 << size):
            data = bytes(rng.randrange(letters) for _ in range(n))
            stream = late_clear(data, size)
            assert plain_lzw(stream, size, n) == data == gif.lzw_decode(stream, size, n)


def test_null_and_broken_media_have_a_row(spark):
    good = gif.encode(gif.padded(b"text"))
    df = spark.createDataFrame([(1, 4, good, "x"), (2, 0, None, "x"), (3, 9, b"GIF89a no", "x"), (4, 4, good[:-40], "x"), (4, 4, good, "x")], "doc_id long, n_bytes long, media binary, feature string")
    rows = sorted(gif.digest(df).collect(), key=lambda r: (r.doc_id, r.error or ""))
    assert [r.error is None for r in rows] == [True, True, False, True, False]
    assert rows[0].payload_bytes == 192 and rows[1].media_bytes is None and rows[2].media_sha256 == hashlib.sha256(b"GIF89a no").hexdigest() and rows[2].feature is None


# ---- classifiers


def test_quality_scores_are_sums_of_looked_up_bins():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, rounds=10, pair_rounds=5)
    assert model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.8
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        z = model.intercept
        for f, v in enumerate(row):
            z += model.tables[f][bisect.bisect_right(list(model.edges[f]), v)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[bisect.bisect_right(list(model.coarse[a]), row[a])][bisect.bisect_right(list(model.coarse[b]), row[b])]
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def plain_ngrams(text):
    raw = f" {text.lower()} ".encode()
    norm = [b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    out = []
    for size in langid.SIZES:
        for i in range(len(norm) - size + 1):
            g = norm[i : i + size]
            if all(c == 32 for c in g[:-1]):
                continue
            h = g[0] * int(langid._MULTIPLIERS[0]) & 0xFFFFFFFF
            for j in range(1, size):
                h ^= ((h >> 15) + g[j] * int(langid._MULTIPLIERS[j])) & 0xFFFFFFFF
                h = h * 0x2C1B3C6D & 0xFFFFFFFF
            out.append(h >> 17)
    return out


def test_language_scores_are_plain_means_of_ngrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, remainder(5) != 0)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["x", "Straße 12 é"]
    for text, row in zip(texts, model.scores(pa.array(texts)), strict=True):
        grams = plain_ngrams(text)
        z = sum(model.table[g].astype(float) for g in grams) / len(grams) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert np.allclose(row, e / e.sum(), atol=1e-4)


def test_signs_that_are_no_letters_have_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, remainder(5) != 0)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½", "①", "Ⅷ", "12 !?", "é", "_"])], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in sorted(langid.identified(rows, model).collect())] == [True] * 5 + [False, True]


def test_toxicity_finds_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_text_ids_are_kept(spark):
    rows = spark.createDataFrame([("a-1", "some text of five words"), ("b", "some text of five words"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark, rows, 2).collect()} == {("a-1", "a-1"), ("b", "a-1"), (None, None)}
    assert {r.doc_id for r in pii.pii_spans(rows).collect()} == {r.doc_id for r in gif.store_texts(rows).collect()} == {"a-1", "b", None}


# ---- personal data


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)]


KEY = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71"


@pytest.mark.parametrize("text", [f'token = "{KEY}" the shall', f'token = "{KEY}" edshat', f"accessToken: {KEY}", f"border key {KEY} locally"])
def test_context_words_are_whole_words(text):
    assert ("secret", KEY) in kinds(text)


def test_words_inside_others_dont_raise():
    assert not kinds(f"monkey {KEY}") and not kinds(f"keyed {KEY}") and not kinds("ssnow 123-45-6789")


def test_added_spans_stay_beside_base_spans():
    rng = random.Random(8)
    seen = 0
    for _ in range(3000):
        body = "".join(rng.choice("0123456789") for _ in range(12))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "BE00")) % 97
        iban = f"BE{check:02d}{body}"
        found = kinds(f"bank account {iban} in it")
        assert ("iban", iban) in found
        seen += len(found) > 1
    assert seen > 50


def test_all_planted_kinds_are_found(spark):
    import re

    docs = [r.text for r in spark.read.parquet(f"{LARGE}/documents.parquet").select("text").collect()]
    planted = [(m[1], t) for t in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
    assert len(planted) > 100 and sum(("secret", k) in kinds(t) for k, t in planted) == len(planted)


# ---- chat


def test_deep_conversations_stay_small(spark):
    pack, node = chat._Pack(), None
    for i in range(20_000):
        node = pack.add(node, ("user", "assistant")[i % 2], str(i))
        assert len(node["ancestors"]) <= 1
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3_000)]
    other = [*turns[:1_500], ("user", "another way")]
    rows = [(c, i, r, t) for c, own in ((1, turns), (2, other), (3, turns)) for i, (r, t) in enumerate(own)]
    out = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    for c, own in ((1, turns), (2, other), (3, turns)):
        loss = "".join(t for r, t in own if r == "assistant")
        assert out[c].n_turns == len(own) and out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ---- decontamination and near-duplicates in small parts


def test_parts_of_a_benchmark_are_one(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "B", "c", "é", "d1"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(20)]
    docs = [(i, " ,".join(word() for _ in range(rng.choice([0, 3, 40, 700])))) for i in range(40)]
    want = sorted(decontam.brute_force(docs, items))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (4_000_000, 500):
        monkeypatch.setattr(decontam, "MOST_STATES", most)
        assert sorted(tuple(r) for r in decontam.digest(decontam.contamination(spark, d, b)).collect()) == want
        assert {r.doc_id for r in decontam.uncontaminated(d, b).collect()} == {x[0] for x in want if not x[-1]}


def test_workers_need_no_module_of_the_package(tmp_path):
    """From a folder of its own, the package is on the driver's path alone."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from strandflow.llm import decontam, neardup
docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x y"), (3, "x y")], "doc_id long, text string")
bench = spark.createDataFrame([(7, "b c d e f g h i j k l")], "item_id long, text string")
print([r.n_hit for r in decontam.contamination(spark, docs, bench).orderBy("doc_id").collect()], decontam.uncontaminated(docs, bench).count(), neardup.near_duplicates(spark, docs, 2).where("kept").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    assert out.returncode == 0, out.stderr[-500:]
    assert out.stdout.split("\n")[-2] == "[10, 0, 0] 2 2"


@pytest.mark.parametrize("block", [1 << 20, 2_000])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    from test_other_operators import components, near_copies

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 150, 40, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.near_duplicates(spark, df, 2).collect()), key=repr) == components(rows, 2)


def test_session_settings_and_tables_are_left_as_they_were(spark):
    from strandflow import lineage

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with lineage.scope():
        neardup.near_duplicates(spark, spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
        assert lineage._open
        base = lineage._open[-1]
    assert spark.conf.get(key) == before and base not in lineage._open and not base._files.exists(base._path(base.base))


# ---- pieces and memory


def test_null_texts_and_unknown_ids(spark):
    path = tokenizer_path(SPM_FILE)
    rows = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id long, text string")
    ids = spm.encoded(rows, path, keep_nulls=True)
    assert {r.doc_id: r.text for r in spm.decoded(ids, path).collect()} == {1: "two words", 2: None, 3: ""}
    odd = ids.where("doc_id = 1").select("doc_id", F.concat("ids", F.array(F.lit(10**8), F.lit(-1), F.lit(None).cast("int"))).alias("ids"))
    assert spm.decoded(odd, path).first().text == "two words" + "�" * 3


def test_a_worker_stays_small():
    """The signing and encoding loops over 30 MB of texts, a very long one among them, in a process of their own."""
    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import pyarrow as pa, pyarrow.dataset as ds
from strandflow.llm import neardup, spm
from strandflow.llm.queries import SPM_FILE, tokenizer_path
t = ds.dataset('{LARGE}/documents.parquet').to_table(columns=['doc_id', 'text']).to_batches(max_chunksize=1000)
t = t + [pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(['many words of a long text ' * 100_000])], ['doc_id', 'text'])]
for run in (neardup._sign(5, 40, 5), spm._batches(tokenizer_path(SPM_FILE), 'auto', True, True)):
    for _ in run(iter(t)):
        pass
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-500:]
    assert int(out.stdout.split()[-1]) < 900

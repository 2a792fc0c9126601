import hashlib
import random

import numpy as np
import pytest

from strandflow.llm import chat, gif, langid, neardup, quality, toxicity
from strandflow.llm._labels import remainder
from strandflow.llm._text import NOT_SPACE, Rolling, hash_bytes, word_bounds

SF = "/root/testdata/sf0.01"


# ---- near-duplicates


def components(rows, k, percent=80):
    """By comparing all pairs."""
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * m >= percent * (len(sets[i]) + len(sets[j]) - m):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), c, doc == c))
    return sorted(out, key=repr)


def near_copies(rng, n=120, words=40, edits=5):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):  # a large group whose members are near the base, but not all near each other
        t = list(base)
        for _ in range(rng.randrange(0, edits)):
            t[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(t))
    for _ in range(40):  # chains
        t = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randrange(1, 6)):
            out.append(" ".join(t))
            t = list(t)
            t[rng.randrange(words)] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_all_pairs(spark, odd_docs, k):
    rng = random.Random(k)
    texts = near_copies(rng)
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows = [(1000 + i, t) for i, t in rows] + [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 3] + [(3, "one"), (4000, "ONE"), (4001, "one two")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cls int")
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark, df, k).collect()), key=repr)
    assert got == components(rows, k)


def test_no_documents_no_components(spark, no_docs):
    assert neardup.near_duplicates(spark, no_docs, 2).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    small = rng.integers(0, 2**63, 3).astype(np.uint64)
    h = np.concatenate([a, b, small])
    d = np.repeat([0, 1, 3], [300, 300, 3])
    s = neardup.sketches(h, d, 4, 200)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[[0, 1, 3]] != full).all() and (s[2] == full).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15
    assert (neardup.sketches(a, np.zeros(300, int), 1, 200)[0] == s[0]).all()


def test_rolling_hashes_and_words():
    data = np.frombuffer(b"ab ab\ncd" + b" x", np.uint8)
    off = np.array([0, 4, 4, 8, 10])
    s, e, d = word_bounds(data, off, NOT_SPACE)
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"a", b"b", b"cd", b"x"] and d.tolist() == [0, 0, 2, 2, 3]
    assert (Rolling(data).of(s, e) == hash_bytes([b"ab", b"a", b"b", b"cd", b"x"])).all()


# ---- media


def test_gif_round_trip():
    rng = np.random.default_rng(2)
    for raw in (b"", b"a", b"abc" * 5000, rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes(), bytes(200_000)):
        p = gif.padded(raw)
        assert len(p) % 192 == 0 and p and gif.payload_of(gif.decode(gif.encode(p))) == p
        assert sum(f.histogram().sum() for f in gif.decode(gif.encode(p))) == 192 * min(len(p) // 192, 256) * len(gif.decode(gif.encode(p)))


def frame(x, y, w, h, pixels, disposal=0, delay=0, clear=None, interlace=False, palette=None):
    """An image block with codes of 9 bits, each literal behind a clear code now and then."""
    import struct

    bits = "".join(format(c, "09b")[::-1] for i, p in enumerate(pixels) for c in ([256, p] if i % 200 == 0 else [p])) + format(257, "09b")[::-1]
    raw = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    blocks = b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"
    head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
    local = bytes(v for c in palette for v in c) if palette else b""
    flags = (0x40 if interlace else 0) | (0x80 | (len(palette).bit_length() - 2) if palette else 0)
    return head + struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + local + b"\x08" + blocks


def movie(w, h, *frames):
    import struct

    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]) + b"".join(frames) + b";"


def test_disposal_transparency_palettes_and_interlace():
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    f = gif.decode(movie(2, 2, frame(0, 0, 2, 2, [0, 0, 0, 0], 1, 10), frame(1, 0, 1, 2, [1, 3], 2, 20, clear=3), frame(0, 1, 1, 1, [2], 3, 5), frame(1, 1, 1, 1, [0], 0, 0, palette=[(7, 8, 9), (1, 1, 1)])))
    assert [(x.start_ms, x.delay_ms) for x in f] == [(0, 100), (100, 200), (300, 50), (350, 0)]
    assert f[1].canvas.tolist() == [[red, green], [red, red]]  # index 3 is transparent
    assert f[2].canvas.tolist() == [[red, [0, 0, 0, 0]], [blue, [0, 0, 0, 0]]]  # the frame before was cleared
    assert f[3].canvas.tolist() == [[red, [0, 0, 0, 0]], [red, [7, 8, 9, 255]]]  # and this one's was put back
    rows = gif.decode(movie(1, 8, frame(0, 0, 1, 8, [0, 0, 1, 1, 2, 2, 3, 3], interlace=True)))[0].canvas[:, 0, 0].tolist()
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    want = [None] * 8
    for i, r in enumerate(order):
        want[r] = [255, 255, 0, 0, 0, 0, 9, 9][i]
    assert rows == want


def test_bad_media_are_rows_with_an_error(spark):
    good = gif.encode(gif.padded(b"x" * 60_000))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-300])), (3, bytearray(b"no")), (4, None)], "doc_id long, media binary")
    rows = gif.frames_of(df).collect()
    assert sorted((r.doc_id, r.frame, r.error is None) for r in rows if r.doc_id == 1) == [(1, 0, True), (1, 1, True)]
    assert sorted(r.doc_id for r in rows if r.error) == [2, 3]


def test_media_columns(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in gif.digest(gif.store_texts(odd_docs)).collect()}
    for d in odd_docs.collect():
        raw = (d.text or "").encode()
        r = got[(d.doc_id, len(raw))]
        assert r.payload_sha256 == hashlib.sha256(gif.padded(raw)).hexdigest() and r.payload_bytes == len(gif.padded(raw))
    assert gif.digest(gif.store_texts(no_docs)).count() == 0


# ---- chat


def conversations():
    rng = random.Random(3)
    bad = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", bad), (-7, 1, "assistant", bad)]
    for c in range(60):
        texts = ["hello", "###", "\\", "</turn>", "a\\\\</turn>", "### user: x </turn>\n", "é😀", "", None]
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant", "system:x", "a\\b", None][min(4, t % 2 + 3 * (rng.random() < 0.2))], texts[0] if t == 0 and c % 3 else rng.choice(texts)))
    return rows + [(5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "assistant", "first"), (None, 0, "user", "nobody's")]


@pytest.mark.parametrize("pack", [1, 40, 1 << 18])
def test_chat_reads_back(spark, pack):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    convs = chat.conversations(df)
    packed = chat.packs(convs, pack)
    got = {r.conv_id: r for r in convs.select("conv_id", "path").join(chat.read_back(packed), "path").collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.segment(r, t)[0]) for r, t in turns)


def test_shared_turns_are_emitted_once_and_positions_follow_the_path(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "shared" if t < 2 else f"own {c}") for c in range(5) for t in range(4)]
    packed = chat.with_positions(chat.packs(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), partitions=1)).collect()
    assert len(packed) == 1 and len(packed[0].nodes) == 2 + 5 * 2
    text, ids = "".join(map(chr, packed[0].tokens)), packed[0].position_ids
    assert text.count("shared") == 2 and len(ids) == len(text)
    for leaf in packed[0].leaves:
        node = packed[0].nodes[leaf.node]
        spans = [(a.start, a.end) for a in node.ancestors] + [(node.start, node.end)]
        assert [i for a, b in spans for i in ids[a:b]] == list(range(sum(b - a for a, b in spans)))


def test_no_conversations(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- classifiers


def test_language_query(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in out)
    model = langid.train(docs, remainder(5) != 0)
    und = {r.doc_id: r for r in langid.identified(odd_docs, model).collect()}
    assert all(und[i].lang_pred == "und" and und[i].score == 0 and und[i].rejected for i in (0, 1, 2, 8)) and und[3].lang_pred == "en"
    assert langid.language_query(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identified(odd_docs, None).collect()} == {"und"}


def test_quality_query(spark, odd_docs, no_docs, no_labels):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    odd = quality.quality_query(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert quality.quality_query(no_docs, labels).count() == 0 and quality.quality_query(odd_docs, no_labels).count() == odd_docs.count()


def test_quality_scores_keep_the_share_of_all_labels(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "'the same text' text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 > 0) quality")
    for most in (10_000, 500):  # the second is below both counts, 4,000 and 1,000
        model = quality.train(docs, labels, remainder(3).isNotNull(), most)
        row = quality.scored(docs.limit(1), model).first()
        assert abs(row.score - 0.8) < 0.04 and row.predicted == 1


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=20)
    assert (0, 1) in m.pairs and (((m.scores(x) >= 0.5) == y).mean()) > 0.95


def test_toxicity_query(spark, odd_docs, no_docs, no_labels):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    english = spark.createDataFrame([(1, "you stupid worthless idiot go away " * 3), (2, "a calm and friendly line of text " * 3)], "doc_id long, text string")
    for model in (toxicity.train(docs, labels, remainder(4) != 2), toxicity.train(docs, no_labels, remainder(4) != 2)):
        assert [r.predicted for r in toxicity.scored(english, model).orderBy("doc_id").collect()] == [1, 0]
        assert [r.doc_id for r in toxicity.accepted(english, model).collect()] == [2]
    assert len(toxicity.toxicity_query(odd_docs, labels).collect()) == odd_docs.count() and toxicity.toxicity_query(no_docs, labels).count() == 0


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.2
    say = lambda right, wrong: np.where(rng.random(4000) < np.where(y, right, wrong), 1, 0)
    first = say(0.6, 0.01)
    v = np.stack([first, first, say(0.5, 0.02), say(0.4, 0.02), say(0.3, 0.25)], 1).astype(np.int8)
    post, theta, weight = toxicity.label_model(v, 0.2)
    assert ((post > 0.5) == y).mean() > 0.88 and weight[0] < 0.7 and weight[2] > 0.7
    assert theta[1, 2, 2] / theta[0, 2, 2] > 5 > theta[1, 4, 2] / theta[0, 4, 2]

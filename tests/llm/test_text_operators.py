import hashlib
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.llm import decontam, pii, spm, tokencount

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- decontamination


def test_contamination_equals_brute_force(spark, odd_docs):
    rng = random.Random(1)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "the", "of"]
    items = [(1, "the OF the"), (2, "Alpha"), (3, ""), (4, None), (5, "!!"), (10, " ".join(rng.choice(words) for _ in range(14))), (11, " ".join(rng.choice(words) for _ in range(10))), (11, "the of, the of. the"), (12, "same text here")]
    docs = [(i, ", ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, "so: " + items[5][1].upper().replace("É", "é") + " end"), (101, "pre " + items[6][1] + " post")]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect()]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(*i, 0) for i in [*items, (None, "beta")]], "item_id long, text string, words int")
    want = sorted(decontam.brute_force(docs, items), key=repr)
    for block in (1 << 20, 25):  # one automaton, and several
        got = decontam.digest(decontam.contamination(spark, df, bench, block_bytes=block)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_hits_map_to_the_original(spark):
    text = "Vorwort – (The  Quick, brown\nfox): jumps over the lazy dog Then rests. été"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog then")], "item_id long, text string")
    r = decontam.contamination(spark, df, bench).first()
    assert [text[c.start : c.end] for c in r.chars] == ["The  Quick, brown\nfox): jumps over the lazy dog Then"] and r["items"] == ["7"]


def test_contamination_of_and_by_nothing(spark, no_docs, odd_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(spark, no_docs, empty).count() == 0
    assert {r.n_hit for r in decontam.contamination(spark, odd_docs, empty).collect()} == {0}


# ---- personal data

PIECES = ["@", "a.b", "x@y.com", "..", "192.168.1.1", "999.1.1.1", "0004.5.6.7", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+49-30-1234567", "é", " ", "-", "%", "12", "DE89370400440532013000", "😀", "token = ", "0123456789abcdef0123456789abcdef"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_spans_equal_brute_force(text):
    spans = [s for s in pii.find_spans(text) if s[0] in pii.BASE]
    n, digest = pii.brute_force(text)
    assert [sum(s[0] == k for s in spans) for k in pii.BASE] == n
    assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest() == digest


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("account DE89370400440532013000.") == ["iban"] and kinds("DE88370400440532013000") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("part no 123-45-6789") == []
    assert kinds('token = "0b9b3c6a43eb78aa99cbd7049c572391524f37a8"') == ["secret"] and kinds("commit 0b9b3c6a43eb78aa99cbd7049c572391524f37a8") == []
    assert kinds("1" * 5000 + ".1.1.1") == [] and kinds("a" * 50_000 + "@b.c") == ["email"]
    plain, near = pii.find_spans("10.0.0.1")[0][3], pii.find_spans("server 10.0.0.1")[0][3]
    assert near > plain
    text = "call +1 (555) 010-9999 or a@b.cd"
    assert pii.redact(text, pii.find_spans(text)) == "call [PHONE] or [EMAIL]"


def test_lowering_words_are_whole_words_and_an_introduced_key_counts():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    key = "0b9b3c6a43eb78aa99cbd7049c572391524f37a8"
    for t in (f"shared token {key}", f"thesha edshat token = {key}", f"token {key} shall", f"token {key} " + "x" * 35 + " shared", "e" * 18 + f"sha thirty-odd letters on token {key}", f'the digest of it; token = "{key}"', f"api_key: {key} (sha256 below)"):
        assert kinds(t) == ["secret"], t
    for t in (f"token commit {key}", f"key sha256:{key}", f"key SHA-1 {key}", f"token commit_id={key}", f"checksum key: {key}", f"{key} is the token's digest", f"key {key} sha256sum"):
        assert kinds(t) == [], t
    assert kinds("border SSN 123-45-6789") == ["ssn"] and kinds("order SSN 123-45-6789") == []


def test_ibans_beside_other_groups():
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947"):
        for before, after in (("IBAN ", " BIC COBADEFFXXX"), ("", " 2024"), ("", " EUR 12"), ("", " Bank"), ("AB12 ", ""), ("REF AB12 ", " BIC"), ("", ", BIC"), ("", "")):
            text = before + iban + after
            assert [s[:3] for s in pii.find_spans(text) if s[0] == "iban"] == [("iban", len(before), len(before) + len(iban))], text
    two = "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 X"
    assert pii.redact(two, pii.find_spans(two)) == "[IBAN] [IBAN] X"
    assert pii.ibans("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX") == [] == pii.ibans("DE89 3704 0044 0532 0130 00x")


def test_pii_columns(spark, odd_docs, no_docs):
    rows = pii.digest(pii.pii_spans(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and {r.spans for r in rows} == {""} and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_spans(no_docs).count() == 0
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, odd_docs.collect()), key=repr)


# ---- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["'s", "'re", " ", "  ", "\n", "\x1c", "\x85", "　", "​", "<|endoftext|>", "<|end", "日", "😀", "½"]), st.text(max_size=6)), max_size=12).map("".join))
def test_counts_equal_the_library(library, text):
    assert tokencount.PieceCounter(BPE, table_size=20).count([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_token_count_columns(spark, odd_docs, no_docs, library):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in tokencount.token_counts(odd_docs, BPE).collect()}
    for d in odd_docs.collect():
        n = len(library.encode(d.text or "", add_special_tokens=False))
        assert got[(d.doc_id, len((d.text or "").encode()))] == (n, n > 1024)
    assert tokencount.token_counts(no_docs, BPE).count() == 0


# ---- SentencePiece


def plain_viterbi(v, word):
    known = {v.pieces[i]: i for i, t in enumerate(v.types) if t == spm.NORMAL}
    best = [(0.0, 0, -1)]
    for end in range(1, len(word) + 1):
        top = None
        for size in range(min(end, v.longest), 0, -1):
            i = known.get(word[end - size : end], -1)
            if i < 0 and size > 1:
                continue
            score = best[end - size][0] + (v.scores[i] if i >= 0 else v.unknown)
            if top is None or score > top[0]:
                top = (score, size, i)
        best.append(top)
    out, end = [], len(word)
    while end:
        _, size, i = best[end]
        c = word[end - 1]
        out[:0] = [i] if i >= 0 else [v.byte[b] for b in (spm.GAP if ord(c) == spm.STAND_IN else c).encode()]
        end -= size
    return out


@pytest.fixture(scope="module")
def vocabularies(tmp_path_factory):
    with open(MODEL, "rb") as f:
        raw = f.read()
    at = raw.index(b"tok_v0") + 6  # the trainer's fields: its model type comes next
    assert raw[at : at + 2] == b"\x18\x02"
    path = tmp_path_factory.mktemp("spm") / "unigram.model"
    path.write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    return spm.Vocabulary(MODEL), spm.Vocabulary(str(path)), str(path)


def test_segmentation_is_the_best_one(vocabularies):
    rng = random.Random(2)
    words = ["".join(rng.choice(["▁", "a", "b", "the", "é", "日", "😀", "\n", chr(spm.STAND_IN), "ing", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    words += ["x" * 600, "the" * 300, "▁" * 40]
    for v in vocabularies[:2]:
        assert [x.tolist() for x in v.segment(words)] == [plain_viterbi(v, w) for w in words]


def test_never_below_the_library_on_a_unigram_file(vocabularies):
    import sentencepiece

    library, v = sentencepiece.SentencePieceProcessor(model_file=vocabularies[2]), vocabularies[1]
    encoder = spm.Encoder(v)
    for word in "The quick brown fox jumps over lazy dogs; misunderstanding internationalisation Straße".split():
        own, other = encoder.encode([word])[0], library.encode(word)
        assert sum(float(v.scores[i]) for i in own) >= sum(float(v.scores[i]) for i in other) - 1e-3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(vocabularies, text):
    v = vocabularies[0]
    assert v.decode(spm.Encoder(v, cache_words=5).encode([text])[0].tolist()) == text


def test_sentencepiece_columns(spark, odd_docs, no_docs):
    rows = spm.digest(odd_docs, MODEL).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    ids = spm.encoded(odd_docs.where("doc_id is not null"), MODEL)
    back = {r.doc_id: r.text for r in spm.decoded(ids, MODEL).collect()}
    assert back == {d.doc_id: d.text or "" for d in odd_docs.where("doc_id is not null").collect()}
    assert spm.digest(no_docs, MODEL).count() == 0


def test_pretoken_pattern_has_only_classes_of_unicode():
    assert re.search(r"\\s", tokencount.PRETOKEN) is None

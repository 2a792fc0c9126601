"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

The base kinds (email, ip, card, phone) are kept whenever pattern and check
hold.  The method adds kinds that need more evidence: `iban` (mod-97),
`secret` (a long key that a word such as token or password introduces) and
`ssn` (groups of 3-2-4 digits, only beside words that speak of it).  Each span
has a score: prior of its kind, raised or lowered by context words within
`CONTEXT` characters.  Added kinds need ADD_SCORE.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keyed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
CONTEXT, ADD_SCORE = 40, 0.6

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A run of digits is tried from its first one only: what fails there fails from any later one.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

#: Prior score of a confirmed span by kind, and words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.4, "ssn": 0.4}
RAISE = {
    "email": r"e-?mails?|contacts?|write|mailto", "ip": r"ip|hosts?|servers?|address(?:es)?", "card": r"(?:kredit|bank)?karten?|cards?|visa|credit|payments?|cartes?|tarjetas?",
    "phone": r"(?:tele)?phones?|calls?|tel|mobile|fax", "iban": r"ibans?|accounts?|banks?|konto(?:nummer)?|comptes?|cuentas?",
    "secret": r"tokens?|secrets?|passwords?|passwd|api[_-]?keys?|keys?|bearer|credentials?", "ssn": r"ssn|social security|tax id",
}
LOWER = {
    "email": r"example\.", "ip": r"versions?|releases?|v\.", "card": r"orders?|invoices?|isbn|serials?", "phone": r"isbn|serials?", "iban": r"serials?|part no",
    "secret": r"sha(?:-?[0-9]+)?(?:sums?)?|commits?|checksums?|digests?", "ssn": r"part no|serials?|orders?",
}
#: These are whole words: no letter goes before or follows, as in 'shared', 'border' or 'ghost'; a sign such as '_' may.
_BEGIN, _END = r"(?<![^\W\d_])", r"(?![^\W\d_])"
#: A word that introduces a key may also begin at a capital within a name, as in 'accessToken'.
_BEGIN_NAME = rf"(?:{_BEGIN}|(?-i:(?<=[a-z])(?=[A-Z])))"
_RAISE = {k: re.compile((_BEGIN_NAME if k == "secret" else _BEGIN) + rf"(?:{v}){_END}", re.I) for k, v in RAISE.items()}
_LOWER = {k: re.compile(rf"{_BEGIN}(?:{v})" + ("" if k == "email" else _END), re.I) for k, v in LOWER.items()}
#: 'token = "' right before a key: only a lowering word right before that ('checksum key:') still counts.
_INTRODUCED = re.compile(rf"{_BEGIN_NAME}(?:{RAISE['secret']})[\"']?\s*(?:=>|:=|=|:)\s*[\"'`]?\Z", re.I)
_SAID_OF = re.compile(rf"{_BEGIN}(?:{LOWER['secret']})[\s_-]*\Z", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """From each place where one may start, the longest run of whole groups for which mod-97 holds; what follows it is searched again."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == " ")]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            out.append((m.start(), end))
        at = end or m.start() + 1
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """What a leftmost search for local@domain finds: each run of local characters is walked once, back from its sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at > done and text[at - 1] in LOCAL else None
        if m:
            hi, step = at, 64
            while hi > done:  # piece by piece, each stripped at the speed of C
                left = max(done, hi - step)
                rest = len(text[left:hi].rstrip(LOCAL))
                hi, step = left + rest, step * 4
                if rest:
                    break
            out.append((hi, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.3 * _within(_RAISE[kind], text, start, end) - 0.3 * _lowered(kind, text, start, end))), 2)


def _within(words: re.Pattern, text: str, start: int, end: int) -> bool:
    """Whether such a word lies wholly within the context; the letters beyond its ends are looked at too."""
    right = end + CONTEXT
    return bool(words.search(text, max(0, start - CONTEXT), start)) or any(m.end() <= right for m in words.finditer(text, end, right + 1))


def _lowered(kind: str, text: str, start: int, end: int) -> bool:
    left = max(0, start - CONTEXT)
    if kind == "secret" and (m := _INTRODUCED.search(text, left, start)):
        return bool(_SAID_OF.search(text, left, m.start()))
    return _within(_LOWER[kind], text, start, end)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, by start and then kind; spans of different kinds may overlap."""
    hits: list[tuple[str, int, int]] = []
    if "@" in text:
        hits += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        hits += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    hits.append(("card", *m.span()))
        if "+" in text:
            hits += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
        hits += [("iban", *s) for s in ibans(text)]
        hits += [("ssn", *m.span()) for m in SSN.finditer(text)]
        hits += [("secret", *m.span()) for m in SECRET.finditer(text) if DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])]
    out = [(k, a, b, _score(k, text, a, b)) for k, a, b in hits]
    return sorted((x for x in out if x[0] in BASE or x[3] >= ADD_SCORE), key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, one replacement covers all."""
    out, done = [], 0
    i = 0
    while i < len(spans):
        kind, a, b, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its spans; null and empty texts have none.

    Very long texts are searched whole, in time that grows with their length.
    Repeated rows are searched each; other columns are ignored.
    """
    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(_find, f"doc_id {kind}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind and of all spans, a digest of the base spans and all spans as text; rows without spans have zeros and empty texts, null spans count as none."""
    found = found.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_pii"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; null texts stay null.

    Repeated rows are redacted each, long texts whole; an empty table stays empty.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (s := t.as_py()) is None else redact(s, f) if (f := find_spans(s)) else s for t in batch.column(at)]
            cols = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def brute_force(text: str | None) -> tuple[list[int], str]:
    """Counts by kind and the base digest by searching the plain patterns; for tests."""
    text = text or ""
    found = {k: [] for k in BASE}
    found["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    spans = sorted((a, BASE.index(k), b) for k in BASE for a, b in found[k])
    return [len(found[k]) for k in BASE], hashlib.sha256(",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()

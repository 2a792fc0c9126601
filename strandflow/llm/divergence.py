"""How far the sources of a language diverge from each other and from the language, over exact term counts.

A byte-level tokenizer cuts the concatenated UTF-8 buffer of a batch by a numpy
lookup table; slices are grouped by XXH64, computed for all slices at once, and
each is compared byte by byte with the first of its group, so that a collision
is split and never counted together.  A task sums its counts in a bounded table
before they are shuffled once, by (lang, term).

Divergences are sums over kept terms.  Entries of a language are dealt into
blocks of terms, each a CSR matrix of sources by terms; pairs are summed block
by block with reduceat over the entries that occur, and terms which neither of a
pair has are one product.  All arithmetic is of integers.

Null texts, languages and sources count as empty; a text without terms, and one
that is empty, still makes its group occur.  Repeated rows and ids count as
often as they are there, ties are broken by the item's bytes, an empty table
gives no rows, a long text is cut as it is, and other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._slices import group_slices, slices
from ._text import LOWER, chunks, word_bounds

#: Documents of its language in which a term has to occur; ranks of the terms of a group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Rows of a task's table of counts; beyond, it goes to the shuffle and a new one begins.
TABLE_ROWS = 400_000
#: Entries of a block of terms, about.
BLOCK_ENTRIES = 200_000
#: Letters of A-Z and a-z, and all bytes of other characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
COUNTS = "lang string, source string, term string, n long, docs long"


def _chunk_counts(data: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a chunk."""
    data = LOWER[data]
    starts, ends, doc = word_bounds(data, off, IS_TERM)
    of, first = group_slices(data, starts, ends)
    u = max(len(first), 1)
    pair, n = np.unique(doc * u + of, return_counts=True)
    key = group[pair // u] * u + pair % u
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.append(head, len(key)))
    terms = slices(data, starts[first], ends[first])
    return key[head] // u, terms.take(pa.array(key[head] % u)), np.add.reduceat(n, head) if len(head) else n, docs


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, source, text) to COUNTS; a row with a null term for each group that occurs."""
    parts: list[pa.Table] = []
    rows = 0
    names = ["lang", "source", "term", "n", "docs"]

    def summed() -> pa.Table:
        whole = pa.concat_tables(parts).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return whole.rename_columns([c.removesuffix("_sum") for c in whole.column_names]).select(names)

    for batch in batches:
        lang, source = (batch.column(i).cast(pa.string()) for i in (0, 1))
        for lo, hi, data, off in chunks(batch.column(2)):
            a, b = (c.slice(lo, hi - lo).dictionary_encode() for c in (lang, source))
            code = a.indices.to_numpy().astype(np.int64) * max(len(b.dictionary), 1) + b.indices.to_numpy()
            seen, group = np.unique(code, return_inverse=True)
            of_a, of_b = a.dictionary.take(pa.array(seen // max(len(b.dictionary), 1))), b.dictionary.take(pa.array(seen % max(len(b.dictionary), 1)))
            g, terms, n, docs = _chunk_counts(data, off, group)
            none = np.zeros(len(seen), np.int64)
            g = pa.array(np.concatenate([g, np.arange(len(seen))]))
            term = pa.concat_arrays([terms, pa.nulls(len(seen), pa.string())])
            parts.append(pa.table([of_a.take(g), of_b.take(g), term, np.concatenate([n, none]), np.concatenate([docs, none])], names=names))
            rows += len(g)
            if rows > TABLE_ROWS:
                parts = [summed()]
                rows = len(parts[0])
                if rows > TABLE_ROWS // 2:  # mostly new terms: the table starts anew
                    yield from parts[0].combine_chunks().to_batches()
                    parts, rows = [], 0
    if parts:
        yield from summed().combine_chunks().to_batches()


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _row_sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of CSR rows, 0 for an empty one."""
    return np.where(ptr[1:] > ptr[:-1], np.add.reduceat(np.append(x, 0), ptr[:-1]), 0) if len(ptr) > 1 else np.zeros(0, np.int64)


def pair_sums(row: np.ndarray, col: np.ndarray, p: np.ndarray, base: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of f over the terms) for a < b: entries (row, col, p) sorted by row, and each row's p where it has no entry."""
    s_n = len(base)
    ptr = np.searchsorted(row, np.arange(s_n + 1))
    out = []
    for s in range(s_n - 1):
        lo, own = ptr[s + 1], slice(ptr[s], ptr[s + 1])
        dense, has = np.full(n_terms, base[s]), np.zeros(n_terms, bool)
        dense[col[own]], has[col[own]] = p[own], True
        c, others = col[lo:], base[s + 1 :]
        tail = ptr[s + 1 :] - lo
        met = has[c]
        both = _row_sums(met.astype(np.int64), tail)
        theirs = _row_sums(_f(dense[c], p[lo:]), tail)
        again = _row_sums(np.where(met, _f(dense[c], base[row[lo:]]), 0), tail)
        mine = np.zeros(len(others), np.int64)
        step = max(1, (1 << 20) // max(len(others), 1))
        for at in range(ptr[s], ptr[s + 1], step):
            mine += _f(p[at : min(at + step, ptr[s + 1]), None], others[None, :]).sum(axis=0)
        neither = n_terms - (ptr[s + 1] - ptr[s]) - np.diff(tail) + both
        out.append(theirs + mine - again + neither * _f(base[s], others))
    a, b = np.triu_indices(s_n, 1)
    return a, b, np.concatenate(out) if out else np.zeros(0, np.int64)


def _block(part: pa.Table) -> pa.Table:
    """(lang, a, b, value) of one block of terms: rows without a term are the sources and their p of a term that doesn't occur."""
    is_entry = part.column("term").is_valid()
    entries, groups = part.filter(is_entry), part.filter(pc.invert(is_entry))
    names = np.array(sorted(x.encode() for x in groups.column("source").to_pylist()), dtype=object)
    place = {x: i for i, x in enumerate(names.tolist())}
    base = np.zeros(len(names), np.int64)
    base[[place[x.encode()] for x in groups.column("source").to_pylist()]] = groups.column("p").to_numpy()
    source = entries.column("source").combine_chunks().dictionary_encode()
    term = entries.column("term").combine_chunks().dictionary_encode()
    known = np.array([place[x.encode()] for x in source.dictionary.to_pylist()], np.int64)
    row, col, p = known[source.indices.to_numpy()] if len(entries) else np.zeros(0, np.int64), term.indices.to_numpy().astype(np.int64), entries.column("p").to_numpy()
    order = np.lexsort((col, row))
    a, b, value = pair_sums(row[order], col[order], p[order], base, len(term.dictionary))
    name = pa.array([x.decode() for x in names.tolist()], pa.string())
    lang = pa.array([part.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table([lang, name.take(pa.array(a)), name.take(pa.array(b)), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * terms)) in decimals, as products pass 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def divergences(docs: DataFrame, scratch, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: a source against each other one of its language, and its `top` terms over the language's share.

    `scratch` (lineage.Scratch) holds the one table that is read several times,
    the kept terms of each group with their counts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(text("lang"), text("source"), text("text")).mapInArrow(counts, COUNTS)
    # one shuffle: sums by source and the window over all sources of a term have the same partitioning
    by_term = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    seen = by_term.withColumns({"of_lang": F.sum("n").over(over), "in_docs": F.sum("docs").over(over), "lead": (F.row_number().over(over.orderBy("source")) == 1).cast("long")})
    kept = scratch.cut(seen.where(F.col("term").isNull() | (F.col("in_docs") >= least)).drop("docs", "in_docs"), "terms")

    is_term = F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(F.coalesce(F.sum(F.when(is_term, F.col("lead"))), F.lit(0)).alias("v"), F.coalesce(F.sum(F.when(is_term, F.col("n"))), F.lit(0)).alias("n_lang"), F.count("term").alias("entries"))
    groups = kept.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(is_term, F.col("n"))), F.lit(0)).alias("n_group")).join(langs, "lang")
    blocks = F.greatest(F.ceil(F.col("entries") / BLOCK_ENTRIES), F.lit(1)).cast("int")
    groups = scratch.cut(groups.select("lang", "source", "n_group", "v", "n_lang", blocks.alias("blocks"), F.when(F.col("v") > 0, _share(F.lit(0), F.col("n_group"), F.col("v"))).otherwise(1).cast("long").alias("p")), "groups")

    entries = kept.where(is_term).join(groups.drop("p"), ["lang", "source"])
    entries = entries.select("lang", "source", "term", "blocks", _share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), _share(F.col("of_lang"), F.col("n_lang"), F.col("v")).alias("q"))
    f = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = entries.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f.alias("value"))
    terms = terms.select("*", rank).where(F.col("rank") <= top)

    dealt = entries.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    each = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "p")
    sums = dealt.unionByName(each).groupBy("lang", "block").applyInArrow(_block, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.select("*", rank).unionByName(terms)

"""Near-duplicate detection by fast similarity sketches, banding and exact verification.

Sketch.  A document's set of word shingles is thrown into t bins in rounds:
round i puts every element into one hashed bin with value i + (hash in [0,1));
a bin keeps its least value.  Rounds stop once every bin of the document is
filled, and rounds t..2t-1 address bin i-t with all elements, so that every
coordinate fills and the number of agreeing coordinates is concentrated about
the Jaccard similarity.

Candidates.  t = bands x rows; documents that agree in all rows of a band meet
in a bucket.  With 40 bands of 5 rows a pair of similarity 0.8 is missed with
probability (1 - 0.8^5)^40 = 1.2e-7.

Verification.  Rows with equal sets collapse to one class first, so that copies
never multiply.  Each bucket has a pivot p, the member that meets most others,
and every member m is compared with it on full sets: D(m), the symmetric
difference of m and p, says whether they are linked.  Members of p's buckets of
which some lie apart from p are settled by their differences alone, since
|s ^ m| = |D(s)| + |D(m)| - 2 |D(s) & D(m)|.  With up = 100 + percent and
x(s) = up |D(s)| - (100 - percent) |s|, s and m are linked if and only if
x(s) + x(m) <= 2 up |D(s) & D(m)|.  No pair becomes a row: members are dealt to
blocks of bounded size, and a task gets a block of members apart with a block
of all members, drops those whose shared elements can't reach a link with
anyone (again and again, as elements stop being shared), and multiplies the
rest as matrices.  It gives out a spanning forest of the links that it finds,
at most one row for each member of the block.  No bucket is capped, and the way
is the same at all sizes.

Components.  A member that is linked with pivots follows the least of them, so
that stars shrink to graphs of their pivots; these are joined by alternating
large-star and small-star steps, written to the shared folder after each.
Nothing but counters reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._store import Scratch, bounded_batches, keyed
from ._text import LOWER, NOT_SPACE, U64, Rolling, chunks, distinct, mix, shingles, word_bounds

BANDS, ROWS = 40, 5
#: The weight of a block: elements of its difference lists, and so many more for each list.
BLOCK, LIST_WEIGHT = 1 << 20, 512
#: Columns of a block that are multiplied at once.
COLUMNS = 2_048
#: Ids up to so many go to the executors by broadcast (a hashed relation of about 16 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: A row of sets counts as so many rows when files are laid out.
SET_WEIGHT = 10


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted by document and hash."""
    low = LOWER[data]
    starts, ends, doc = word_bounds(low, off, NOT_SPACE)
    return distinct(*shingles(Rolling(low).of(starts, ends), doc, len(off) - 1, k))


def fingerprints(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, 16-byte fingerprints of whole sets)."""
    size = np.bincount(d, minlength=n_docs) if len(d) else np.zeros(n_docs, np.int64)
    out = np.zeros((n_docs, 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        out[full, 0] = np.add.reduceat(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), first)
        out[full, 1] = np.bitwise_xor.reduceat(mix(h + U64(0x632BE59BD9B4E019)), first)
    return size, out


def sketches(h: np.ndarray, d: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """Fast similarity sketches, n_docs x t; documents without elements keep the largest value."""
    none = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * t, none, np.uint64)
    hh, dd = h, d
    for i in range(t):
        if not len(hh):
            break
        z = mix(hh + U64(((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        b = ((z >> U64(32)) * U64(t)) >> U64(32)
        v = (U64(i) << U64(55)) | (mix(z + U64(0x2545F4914F6CDD1D)) >> U64(9))
        np.minimum.at(out, dd * t + b.astype(np.int64), v)
        full = (out.reshape(n_docs, t) != none).all(1)
        left = ~full[dd]
        hh, dd = hh[left], dd[left]
    if len(hh):  # small sets: address each bin that is still empty with all elements
        docs, first = np.unique(dd, return_index=True)
        grid = out.reshape(n_docs, t)
        for b in range(t):
            i = t + b
            z = mix(hh + U64(((i + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            v = np.minimum.reduceat((U64(i) << U64(55)) | (z >> U64(9)), first)
            grid[docs, b] = np.where(grid[docs, b] == none, v, grid[docs, b])
    return out.reshape(n_docs, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        acc = mix(acc * U64(31) + sketch[:, r::rows] + U64(r + 1))
    return mix(acc + np.arange(bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in chunks(batch.column(1)):
                h, d = shingle_sets(data, off, k)
                size, fp = fingerprints(h, d, hi - lo)
                b = band_hashes(sketches(h, d, hi - lo, bands * rows), bands, rows).astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands), pa.int32()), pa.array(b))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size.astype(np.int64)), _binary(fp), lists], ["doc_id", "n_shingles", "cls", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(0)):
                h, d = shingle_sets(data, off, k)
                size, fp = fingerprints(h, d, hi - lo)
                ends = np.concatenate([[0], np.cumsum(size)]) * 8
                sets = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([_binary(fp), sets], ["cls", "elements"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p, c, n, pn, k, d and alone: the symmetric difference of both sets and its size; without the list where nobody else can need it."""
    for batch in batches:
        lists, sizes = [], []
        for alone, x, y in zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6), strict=True):
            z = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            z.sort(kind="stable")
            same = z[1:] == z[:-1]
            once = np.ones(len(z), bool)
            once[1:] &= ~same
            once[:-1] &= ~same
            sizes.append(int(once.sum()))
            lists.append(z[:0] if alone else z[once])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sizes, pa.int64()), column, batch.column(4)], ["p", "c", "n", "pn", "k", "d", "alone"])


def forest(c: np.ndarray, x: np.ndarray, near: np.ndarray, in_s: np.ndarray, in_m: np.ndarray, e: np.ndarray, of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of S and members of M of one block, as few as keep everything together that they link.

    By member: class, x, whether it is linked with the pivot, whether it is in S
    or M; then all elements of the lists, and the number of the member of each.
    """
    up, alive = 100 + percent, in_s | in_m
    while True:
        _, at, n = np.unique(e, return_inverse=True, return_counts=True)
        shared = n[at] > 1
        e, of = e[shared], of[shared]
        reach = 2 * up * np.bincount(of, minlength=len(c)) - x
        s, m = in_s & alive, in_m & alive
        if not s.any() or not m.any():
            return []
        still = (s & (reach >= x[m].min())) | (m & (reach >= x[s].min()))
        if (still == alive).all():
            break
        alive = still
        e, of = e[alive[of]], of[alive[of]]
    rows, cols = np.flatnonzero(s), np.flatnonzero(m)
    _, e = np.unique(e, return_inverse=True)
    order = np.argsort(e, kind="stable")
    e, of = e[order], of[order]
    row_of, col_of = np.full(len(c), -1), np.full(len(c), -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    both = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(e[-1]) + 1 if len(e) else 0, COLUMNS):
        a, b = np.searchsorted(e, [lo, lo + COLUMNS])
        part = []
        for where, count in ((row_of, len(rows)), (col_of, len(cols))):
            own = where[of[a:b]]
            grid = np.zeros((count, COLUMNS), np.float32)
            grid[own[own >= 0], e[a:b][own >= 0] - lo] = 1
            part.append(grid)
        both += part[0] @ part[1].T
    linked = (x[rows][:, None] + x[cols][None] <= 2 * up * both) & (rows[:, None] != cols[None])
    label = np.arange(len(c))
    label[near] = len(c)  # the pivot holds these together
    out = []
    for i, r in enumerate(rows.tolist()):
        found = cols[linked[i]]
        for j, first in zip(*np.unique(label[found], return_index=True), strict=True):
            if j != label[r]:
                out.append((int(c[r]), int(c[found[first]])))
                label[label == j] = label[r]
    return out


def _settle(percent: int):
    def run(block: pa.Table) -> pa.Table:
        c, first, inverse = np.unique(block["c"].to_numpy(), return_index=True, return_inverse=True)
        role = block["in_s"].to_numpy(zero_copy_only=False)
        in_s, in_m = np.zeros(len(c), bool), np.zeros(len(c), bool)
        in_s[inverse[role]], in_m[inverse[~role]] = True, True
        lists = block["d"].combine_chunks().take(pa.array(first))
        of = np.repeat(np.arange(len(c)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        links = forest(c, block["x"].to_numpy()[first], block["near"].to_numpy(zero_copy_only=False)[first], in_s, in_m, pc.list_flatten(lists).to_numpy(), of, percent)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def _among(scratch: Scratch, diffs: DataFrame, percent: int, most: int) -> DataFrame:
    """(u, v): links between members of one pivot of which at least one isn't linked with it."""
    up, down = 100 + percent, 100 - percent
    x = F.col("k") * up - F.col("n") * down
    lists = diffs.where("not alone").select("p", "c", "d", x.alias("x"), (F.col("k") * up + F.col("n") * down).alias("most"), (x <= F.col("pn") * down).alias("near"), (F.col("k") + LIST_WEIGHT).alias("weight"))
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    bounds = lists.groupBy("p").agg(
        F.min(F.when(~F.col("near"), F.col("x"))).alias("least_apart"), F.min("x").alias("least"), F.count(F.lit(1)).alias("members"),
        blocks(F.coalesce(F.sum(F.when(~F.col("near"), F.col("weight"))), F.lit(0))).alias("n_s"), blocks(F.sum("weight")).alias("n_m"),
    )
    bounds = scratch.cut(bounds.where("least_apart is not null and members > 1").drop("members"), "bounds", most)
    own = lists.join(bounds, "p").select("p", "c", "d", "x", "near", "most", "least", "least_apart", "n_s", "n_m")
    spread = lambda n, seed: F.pmod(F.xxhash64("c", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    s = own.where("not near and most >= least").select("p", spread(F.col("n_s"), 1).alias("b_s"), every(F.col("n_m")).alias("b_m"), "c", "x", "near", F.lit(True).alias("in_s"), "d")
    m = own.where("most >= least_apart").select("p", every(F.col("n_s")).alias("b_s"), spread(F.col("n_m"), 2).alias("b_m"), "c", "x", "near", F.lit(False).alias("in_s"), "d")
    return s.unionByName(m).groupBy("p", "b_s", "b_m").applyInArrow(_settle(percent), "u long, v long")


def components(scratch: Scratch, edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """(c, root) of all nodes that aren't their component's root; edges (u, v) lead to few v, such as pivots."""
    e = scratch.cut(edges.where("u <> v").distinct(), "edges", most_rows)
    most = e.count()
    follow = scratch.cut(e.groupBy("u").agg(F.min("v").alias("f")), "follow", most)
    hubs = e.select(F.col("v").alias("u")).distinct()
    # every v of a node is joined with the one that the node follows; nodes that others lead to stay nodes
    left = e.join(follow, "u").select(F.col("f").alias("u"), "v").unionByName(follow.join(hubs, "u", "left_semi").select("u", F.col("f").alias("v")))
    stars, seen = scratch.cut(left.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", 2 * most), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.cut(small, "stars", 2 * most)
        now = new.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        scratch.drop(stars)
        stars = new
        if now == seen:
            break
        seen = now
    roots = new.select(F.col("u").alias("f"), F.col("v").alias("r"))
    members = follow.join(roots, "f", "left").select(F.col("u").alias("c"), F.coalesce("r", "f").alias("root"))
    hubs = new.select(F.col("u").alias("c"), F.col("v").alias("root"))
    # a hub that follows another one is in both, with one root
    return scratch.cut(members.unionByName(hubs).where("c <> root").distinct(), "roots", 2 * most)


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (see `judged`)."""
    return judged(spark, docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def with_sets(docs: DataFrame, name: str, k: int = 5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns and the fingerprint of the row's set as `name`; null without words."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(at)):
                size, fp = fingerprints(*shingle_sets(data, off, k), hi - lo)
                sets = pa.array([x if n else None for x, n in zip(_binary(fp).to_pylist(), size, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))), sets], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def deduplicated(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of which each set of linked rows keeps one: that with the least id, null ids last.

    Rows without words are linked with nothing and stay.  A row goes by what its
    own text is linked with, whatever other rows have its id.
    """
    rows = judged(spark, docs, k, percent)
    by_id = rows.groupBy("doc_id").agg(F.count_if("first").alias("stay"), F.count_if(~F.col("first")).alias("go"))
    # an id all of whose rows go needs no more than the id; one with a row that stays beside others is settled row by row
    seen = Scratch(spark, "copies").cut(by_id.where("go > 0 or stay > 1").select("doc_id", (F.col("stay") > 0).alias("mixed")), "ids")
    n = seen.agg(F.count(F.lit(1)).alias("ids"), F.count_if("mixed").alias("mixed"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
    small = F.broadcast if n["ids"] <= BROADCAST_IDS else lambda df: df  # else both sides are shuffled, with whole texts
    rest = docs.join(small(seen.where("doc_id is not null").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    if n["null"]:
        rest = rest.where("doc_id is not null")
    if not n["mixed"]:
        return rest
    mixed = seen.where("mixed").select("doc_id")
    some = docs.join(small(mixed.where("doc_id is not null")), "doc_id", "left_semi").select(*docs.columns)
    if mixed.where("doc_id is null").count():
        some = some.unionByName(docs.where("doc_id is null"))
    taken = {c.lower() for c in docs.columns}
    name, heir_id, heir_cls, row = (next(x for i in range(len(taken) + 1) if (x := f"{c}{'_' * i}") not in taken) for c in ("set", "heir_id", "heir_cls", "row"))
    some = with_sets(some, name, k)
    heirs = rows.where(F.col("first") & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias(heir_id), F.col("cls").alias(heir_cls)).distinct()
    some_first = some.join(heirs, F.col("doc_id").eqNullSafe(F.col(heir_id)) & (F.col(name) == F.col(heir_cls)), "left_semi")
    # rows that share an id and a set: one by the hash of all that can be hashed
    whole = F.struct(*docs.columns)
    least = F.xxhash64(*(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    one = some_first.groupBy("doc_id", name).agg(F.min_by(whole, least).alias(row)).select(f"{row}.*")
    return rest.unionByName(some.where(F.col(name).isNull()).select(*docs.columns)).unionByName(one.select(*docs.columns))


def judged(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, cls, first.

    Words are runs of bytes other than white space, A-Z in lower case.  Linked
    are sets with 100 * intersection >= percent * union; component_id is the
    least id reachable.  Null and empty texts, and texts without words, have an
    empty set, are linked with nothing and kept.  Rows that share an id are
    rows of their own.  A null id is never a component_id unless nothing else is
    there, and such rows aren't kept beside others.  Other columns are ignored.
    cls is the fingerprint of the row's set; first holds for rows without words
    and for those with the least id, null ids last, of their linked rows, and of
    these with one set: more than one only if they share id and set.
    """
    scratch = Scratch(spark, "neardup")
    with bounded_batches(spark):  # rows carry two whole sets
        return _judged(spark, scratch, *keyed(docs, id_col, text_col), k, percent)


def _judged(spark: SparkSession, scratch: Scratch, docs: DataFrame, kind: str, k: int, percent: int) -> DataFrame:
    signed = scratch.cut(docs.mapInArrow(_sign(k, BANDS, ROWS), f"doc_id {kind}, n_shingles long, cls binary, bands array<long>"), "signed")
    full = signed.where("n_shingles > 0")
    n = full.count()
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.cut(classes.withColumn("c", F.monotonically_increasing_id()), "classes", n)
    banded = classes.select("c", "n", F.explode("bands").alias("band"))
    shared = scratch.cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared", n)
    met = scratch.cut(banded.join(shared, "band"), "met", n * 4)
    weight = met.groupBy("c").agg(F.sum("size").alias("weight"))
    pivots = scratch.cut(met.join(weight, "c").groupBy("band").agg(F.max_by(F.struct("c", "n"), F.struct("weight", "c")).alias("p")).select("band", "p.*").toDF("band", "p", "pn"), "pivots", n)
    # who meets in buckets of two only has nobody but the pivot to be compared with
    groups = met.join(pivots, "band").where("c <> p").groupBy("p", "c").agg(F.max("n").alias("n"), F.max("pn").alias("pn"), (F.max("size") == 2).alias("alone"))
    groups = scratch.cut(groups.where(f"not alone or 100 * least(n, pn) >= {percent} * greatest(n, pn)"), "groups", n * 2)
    scratch.drop(met, pivots, shared)
    wanted = groups.select("c").unionByName(groups.select(F.col("p").alias("c"))).distinct().join(classes.select("c", "cls", "rep"), "c")
    wanted = scratch.cut(wanted, "wanted", n)
    n_wanted = wanted.count()
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if n_wanted <= BROADCAST_IDS else ids
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")
    found = texts.mapInArrow(_sets(k), "cls binary, elements binary").dropDuplicates(["cls"])
    sets = scratch.cut(found.join(wanted.select("cls", "c"), "cls").select("c", "elements"), "sets", n_wanted * SET_WEIGHT)
    pairs = groups.join(sets.withColumnRenamed("elements", "x"), "c").join(sets.select(F.col("c").alias("p"), F.col("elements").alias("y")), "p").select("p", "c", "n", "pn", "alone", "x", "y")
    diffs = pairs.mapInArrow(_differences, "p long, c long, n long, pn long, k long, d array<long>, alone boolean")
    diffs = scratch.cut(diffs, "differences", n_wanted * SET_WEIGHT)
    scratch.drop(sets, groups, wanted)
    stars = diffs.where(f"100 * (n + pn - k) >= {percent} * (n + pn + k)").select(F.col("c").alias("u"), F.col("p").alias("v"))
    roots = components(scratch, stars.unionByName(_among(scratch, diffs, percent, n)), n * SET_WEIGHT)
    scratch.drop(diffs)
    # one row a class of a component, whose least id is found by partial sums and joined as a table, so that a large component can be split
    named = roots.unionByName(roots.select(F.col("root").alias("c"), "root").distinct()).join(classes.select("c", "rep"), "c")
    named = scratch.cut(named, "named", n)
    least = scratch.cut(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.min_by("c", F.struct(F.col("rep").isNull(), "rep", "c")).alias("heir")), "least", n)
    label = named.join(least, "root").select("c", "component_id", (F.col("c") == F.col("heir")).alias("first"))
    label = classes.select("c", "cls", "rep").join(label, "c", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    linked = full.select("doc_id", "n_shingles", "cls").join(label, "cls").select("doc_id", "n_shingles", "component_id", "cls", "first")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "cls", F.lit(True).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept).withColumn("first", F.col("first") & F.col("kept"))

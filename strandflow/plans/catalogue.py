"""The catalogue: each operator over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags, scoring, sequences
from ..operators import clusters as cl
from ..operators import consensus, cover, intervals, merge, runs, seqjoin
from .registry import QUERIES, SQL
from .registry import register as _register
from .registry import table as _t

HOUR = 3_600_000_000
MAX_GAP = 4 * HOUR
DAY = 24 * HOUR
WEIGHTS = {"n": 0.35, "entropy": 0.9, "balance_ratio": 0.4, "mean_value": -0.004}
BIAS = -1.6
#: Values from which an event counts as aligned, and below which as badly mapped.
ALIGNED, BAD = 10.0, 5.0

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import reads, records  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import reads, records  # noqa: F401

    return dict(SQL)


def _days(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


# ---- events as segments, runs of them as clusters

EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 4 END AS kind FROM events)"
GC = """gb AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 14400000000 THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
gc AS (SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS idx FROM gb)"""
FEAT = """ft AS (SELECT user_id, idx, count(*) AS n, count(*) FILTER (kind = 1) AS n_left, count(*) FILTER (kind = 2) AS n_middle, count(*) FILTER (kind = 4) AS n_right,
  CAST(bit_count(bit_or(kind)) AS INTEGER) AS n_kinds, avg(value) AS mean_value, count(*) FILTER (value >= 10) / count(*) AS te_frac, count(*) FILTER (value < 5) / count(*) AS low_frac,
  min(us) AS first_us, max(us) AS last_us, count(DISTINCT event_type) AS n_types FROM gc GROUP BY user_id, idx),
fx AS (SELECT *, -(CASE WHEN n_left > 0 THEN n_left / n * log2(n_left / n) ELSE 0 END + CASE WHEN n_middle > 0 THEN n_middle / n * log2(n_middle / n) ELSE 0 END
  + CASE WHEN n_right > 0 THEN n_right / n * log2(n_right / n) ELSE 0 END) AS entropy, (least(n_left, n_right) + 0.01::DOUBLE) / (greatest(n_left, n_right) + 0.01::DOUBLE) AS balance_ratio FROM ft)"""
PROB = "1 / (1 + exp(-(-1.6::DOUBLE + balance_ratio * 0.4::DOUBLE + entropy * 0.9::DOUBLE + mean_value * -0.004::DOUBLE + n * 0.35::DOUBLE)))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), flags.LEFT_CLIP).when(F.col("event_type") == "purchase", flags.MID_INSERT).otherwise(flags.RIGHT_CLIP)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"), kind.alias("kind"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of three days bound what a task sees of one user, however hot."""
    return cl.gap_cluster(events(spark, sf_dir), ["user_id"], "us", MAX_GAP, ["event_id"], bin_width=3 * DAY)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    f = clustered(spark, sf_dir).groupBy("user_id", "idx").agg(
        n.alias("n"), cl.count_of("kind", 1).alias("n_left"), cl.count_of("kind", 2).alias("n_middle"), cl.count_of("kind", 4).alias("n_right"),
        F.bit_count(F.bit_or("kind")).cast("int").alias("n_kinds"), F.avg("value").alias("mean_value"), (F.count_if(F.col("value") >= ALIGNED) / n).alias("te_frac"),
        (F.count_if(F.col("value") < BAD) / n).alias("low_frac"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("event_type").alias("n_types"),
    )
    return f.withColumns({"entropy": cl.entropy(F.col("n_left"), F.col("n_middle"), F.col("n_right")), "balance_ratio": cl.balance(F.col("n_left"), F.col("n_right"))})


@_register(f"WITH {EV}, {GC} SELECT user_id, idx, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM gc GROUP BY user_id, idx")
def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).groupBy("user_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@_register("""WITH d AS (SELECT DISTINCT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem),
b AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 1 THEN 0 ELSE 1 END AS brk FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY day)),
c AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY l_suppkey ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS idx FROM b)
SELECT l_suppkey, idx, count(*) AS n, CAST(min(day) AS INTEGER) AS first_day, CAST(max(day) AS INTEGER) AS last_day FROM c GROUP BY l_suppkey, idx""")
def gap_cluster_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "lineitem").select("l_suppkey", _days("l_shipdate").alias("day")).distinct()
    return cl.gap_cluster(d, ["l_suppkey"], "day", 1, [], bin_width=365).groupBy("l_suppkey", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@_register(f"""WITH {EV}, {GC}, {FEAT} SELECT user_id, idx, n, n_left, n_middle, n_right, n_kinds, round(mean_value, 6) AS mean_value, round(te_frac, 6) AS te_frac,
round(low_frac, 6) AS low_frac, round(entropy, 6) + 0.0 AS entropy, round(balance_ratio, 6) AS balance_ratio FROM fx""")
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select("user_id", "idx", "n", "n_left", "n_middle", "n_right", "n_kinds", *(_r(F.col(c), c) for c in ("mean_value", "te_frac", "low_frac")), (F.round("entropy", 6) + 0.0).alias("entropy"), _r(F.col("balance_ratio"), "balance_ratio"))


@_register(f"WITH {EV}, {GC}, {FEAT} SELECT user_id, idx, CASE WHEN n = 1 THEN 1 WHEN n = 2 AND n_types = 1 THEN 2 ELSE 0 END AS clt_type FROM fx")
def cluster_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("user_id", "idx", cl.cluster_type(F.col("n"), F.col("n_types")).alias("clt_type"))


@_register(f"""WITH {EV}, {GC}, h AS (SELECT user_id, idx, CAST(us // 3600000000 % 24 AS INTEGER) AS hour, count(*) AS k FROM gc GROUP BY ALL)
SELECT user_id, idx, hour FROM h QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY k DESC, hour) = 1""")
def cluster_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).withColumn("hour", F.expr(f"cast(us div {HOUR} % 24 as int)")).groupBy("user_id", "idx").agg(cl.modal("hour").alias("hour"))


@_register(f"""WITH {EV}, {GC} SELECT user_id, idx, event_id FROM gc
QUALIFY row_number() OVER (PARTITION BY user_id, idx ORDER BY CAST(event_type = 'purchase' AS INTEGER) DESC, value DESC, event_id) = 1""")
def representative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).groupBy("user_id", "idx").agg(cl.representative("event_id", F.col("kind") == 2, F.col("value"), F.col("value")).alias("event_id"))


BG = """bgk AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY l_suppkey QUALIFY row_number() OVER (ORDER BY w DESC, k) = 1)"""


@_register(f"WITH {BG} SELECT k AS l_suppkey, round(avg(l_discount), 6) AS bg_div, median(l_quantity) AS bg_read_len, round(sum(l_quantity) / any_value(w), 6) AS bg_depth FROM lineitem JOIN bgk ON l_suppkey = k GROUP BY k")
def background_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", "l_quantity")
    weights = li.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("w"))
    b = cl.background(li.join(weights, "l_suppkey"), "l_suppkey", "w", "l_discount", "l_quantity", "l_quantity")
    return b.select("l_suppkey", _r(F.col("bg_div"), "bg_div"), "bg_read_len", _r(F.col("bg_depth"), "bg_depth"))


LOW = f"""bg AS (SELECT avg(n) AS depth FROM ft), q AS (SELECT fx.*, {PROB} AS probability, n / depth AS ratio FROM fx, bg), g AS (SELECT * FROM q WHERE te_frac >= 0.5 AND NOT (probability <= 0.5 OR ratio >= 10))"""


def high_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    depth = f.agg(F.avg("n").alias("depth"))
    q = f.crossJoin(F.broadcast(depth)).withColumn("probability", scoring.logistic(WEIGHTS, BIAS)).withColumn("ratio", F.col("n") / F.col("depth"))  # depth is one row
    return q.where((F.col("te_frac") >= 0.5) & ~cl.is_low_quality(F.lit(False), F.col("probability"), F.col("ratio")))


@_register(f"WITH {EV}, {GC}, {FEAT}, {LOW} SELECT user_id, idx, n, round(ratio, 6) AS ratio, round(probability, 6) AS probability FROM g")
def low_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_quality(spark, sf_dir).select("user_id", "idx", "n", _r(F.col("ratio"), "ratio"), _r(F.col("probability"), "probability"))


@_register("""WITH l AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS score, l_orderkey, l_linenumber, l_partkey FROM lineitem),
p AS (SELECT *, s + q AS e, max(s + q) OVER (PARTITION BY l_suppkey ORDER BY s, score, s + q, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l),
k AS (SELECT *, e - greatest(s, coalesce(prev, s)) AS added FROM p WHERE prev IS NULL OR e > prev)
SELECT l_suppkey, count(*) AS n, CAST(sum(added) AS BIGINT) AS covered, round(sum(score / q), 3) AS score FROM k GROUP BY l_suppkey""")
def running_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", _days("l_shipdate").cast("long").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").alias("score"), "l_orderkey", "l_linenumber", "l_partkey").withColumn("e", F.col("s") + F.col("q"))
    c = cover.running_cover(li, ["l_suppkey"], "s", "e", ["score", "e", "l_orderkey", "l_linenumber", "l_partkey"], bin_width=90).where("counted")
    return c.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("covered"), _r(F.sum(F.col("score") / F.col("q")), "score", 3))


_ORDER_SPANS = "iv AS (SELECT CAST(o_custkey % 100 AS BIGINT) AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS i_start, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 5 AS i_end, o_orderkey AS rep FROM orders)"


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _days("o_orderdate").cast("long")
    return _t(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(100)).cast("long").alias("k"), day.alias("i_start"), (day + 5).alias("i_end"), F.col("o_orderkey").alias("rep"))


@_register(f"""WITH {_ORDER_SPANS}, p AS (SELECT DISTINCT CAST(l_suppkey % 100 AS BIGINT) AS k, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem),
m AS (SELECT p.k, day, count(*) AS n, min(least(abs(day - i_start), abs(day - i_end))) AS d FROM p JOIN iv ON p.k = iv.k AND i_start < day + 50 AND i_end > greatest(day - 50, 0) GROUP BY p.k, day)
SELECT p.k, p.day, coalesce(n, 0) AS n, d AS min_dist, CASE WHEN coalesce(n, 0) = 0 THEN 1 WHEN d < 3 THEN 2 ELSE 4 END AS location FROM p LEFT JOIN m ON p.k = m.k AND p.day = m.day""")
def point_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(100)).cast("long").alias("k"), _days("l_shipdate").cast("long").alias("day")).distinct()
    out = intervals.point_overlaps(p.withColumn("at", F.col("day")).withColumn("g", F.col("k")), _order_spans(spark, sf_dir).withColumnRenamed("k", "g"), "g", "at", ["k", "day"], 50, 128)
    return out.withColumn("location", intervals.location_type(F.col("n"), F.col("min_dist"), 3))


@_register(f"""WITH {_ORDER_SPANS}, q AS (SELECT s_suppkey AS id, CAST(s_suppkey % 100 AS BIGINT) AS k, min(day) AS s, min(day) + 2 AS e FROM
  (SELECT l_suppkey AS s_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_partkey FROM lineitem) GROUP BY s_suppkey, l_partkey),
u AS (SELECT DISTINCT * FROM q),
m AS (SELECT id, s, count(*) AS n, min(least(abs(s - i_start), abs(s - i_end), abs(e - i_start), abs(e - i_end))) AS d, arg_max(rep, (i_start, i_end, -rep)) AS rep
  FROM u JOIN iv ON u.k = iv.k AND i_start < e + 10 AND i_end > greatest(s - 10, 0) GROUP BY id, s)
SELECT u.id, u.s AS start, coalesce(n, 0) AS n, d AS min_dist, rep FROM u LEFT JOIN m ON u.id = m.id AND u.s = m.s""")
def interval_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(_days("l_shipdate").cast("long")).alias("start"))
    q = li.select(F.col("l_suppkey").alias("id"), F.pmod("l_suppkey", F.lit(100)).cast("long").alias("k"), "start", (F.col("start") + 2).alias("end")).distinct()
    return intervals.interval_overlaps(q, _order_spans(spark, sf_dir), "k", ["id", "start"], 10, 64, "rep")


BURST = """er AS (SELECT user_id, us, event_id FROM ev WHERE event_type = 'error'),
eb AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 86400000000 THEN 0 ELSE 1 END AS brk FROM er WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
bl AS (SELECT user_id, min(us) AS i_start, max(us) AS i_end FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS i FROM eb) GROUP BY user_id, i HAVING count(*) >= 2),
cs AS (SELECT user_id, idx, min(us) AS s, max(us) AS e FROM gc GROUP BY user_id, idx)"""


def _bursts(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    errors = cl.gap_cluster(events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], "us", DAY, ["event_id"], "i", bin_width=30 * DAY)
    bursts = errors.groupBy("user_id", "i").agg(F.min("us").alias("i_start"), F.max("us").alias("i_end"), F.count(F.lit(1)).alias("k")).where("k >= 2").drop("k", "i")
    spans = clustered(spark, sf_dir).groupBy("user_id", "idx").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    return intervals.semi(spans, bursts, "user_id", ["user_id", "idx"], 2_000_000, DAY, how).select("user_id", "idx")


@_register(f"WITH {EV}, {GC}, {BURST} SELECT user_id, idx FROM cs WHERE EXISTS (SELECT 1 FROM bl WHERE bl.user_id = cs.user_id AND i_start < e + 2000000 AND i_end > s - 2000000)")
def blacklist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(spark, sf_dir, "left_semi")


@_register(f"WITH {EV}, {GC}, {BURST} SELECT user_id, idx FROM cs WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.user_id = cs.user_id AND i_start < e + 2000000 AND i_end > s - 2000000)")
def blacklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(spark, sf_dir, "left_anti")


SPAN = """rd AS (SELECT user_id, idx AS own, event_id, us - 21600000000 AS i_start, us + 21600000000 AS i_end FROM gc),
rf AS (SELECT c.user_id, c.idx, count(*) AS n_ref FROM {src} c JOIN rd ON rd.user_id = c.user_id AND own <> c.idx AND i_start < first_us - 4500000000 AND i_end > first_us + 4500000000 GROUP BY c.user_id, c.idx),
fr AS (SELECT c.*, coalesce(n_ref, 0) AS n_ref, (n_left + n_right + 2 * n_middle) / (n_left + n_right + 2 * n_middle + 2 * coalesce(n_ref, 0)) AS frequency FROM {src} c LEFT JOIN rf ON rf.user_id = c.user_id AND rf.idx = c.idx)"""
_GENO = "CASE WHEN round(frequency, 6) < 0.2 THEN '0/0' WHEN round(frequency, 6) >= 0.8 THEN '1/1' ELSE '0/1' END AS genotype"


def supported(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Clusters with reads that span their breakpoint (each event stands for twelve hours of its user), frequency and genotype."""
    own = clustered(spark, sf_dir)
    reads = own.select("user_id", "event_id", (F.col("us") - 6 * HOUR).alias("i_start"), (F.col("us") + 6 * HOUR).alias("i_end"))
    ref = intervals.spanning(found.select("user_id", "idx", F.col("first_us").alias("ref_start"), F.col("first_us").alias("ref_end"), F.col("user_id").alias("u")), reads.withColumnRenamed("user_id", "u"), own.select("user_id", "idx", "event_id"), "u", ["user_id", "idx"], "event_id", 4_500_000_000, DAY)
    out = found.join(ref, ["user_id", "idx"])
    return out.withColumn("frequency", cl.frequency(F.col("n_left"), F.col("n_middle"), F.col("n_right"), F.col("n_ref"))).withColumn("genotype", flags.genotype(F.col("frequency")))


@_register(f"WITH {EV}, {GC}, {FEAT}, {SPAN.format(src='fx')} SELECT user_id, idx, n_ref, round(frequency, 6) AS frequency, {_GENO} FROM fr")
def spanning_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported(spark, sf_dir, featured(spark, sf_dir)).select("user_id", "idx", "n_ref", _r(F.col("frequency"), "frequency"), "genotype")


@_register(f"WITH {EV}, {GC}, {FEAT}, {LOW}, {SPAN.format(src='g')} SELECT user_id, idx, n, round(probability, 6) AS probability, n_ref, round(frequency, 6) AS frequency, {_GENO} FROM fr")
def flagship_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported(spark, sf_dir, high_quality(spark, sf_dir)).select("user_id", "idx", "n", _r(F.col("probability"), "probability"), "n_ref", _r(F.col("frequency"), "frequency"), "genotype")


flagship = flagship_genotypes


@_register(f"""WITH {EV}, {GC}, a AS (SELECT concat(user_id, '-', idx) AS insertion_id, count(*) AS n FROM gc GROUP BY user_id, idx HAVING count(*) >= 2),
b AS (SELECT concat(user_id, '-', idx) AS insertion_id, string_agg(event_id, ',' ORDER BY us, event_id) AS purchases FROM gc WHERE event_type = 'purchase' GROUP BY user_id, idx)
SELECT coalesce(a.insertion_id, b.insertion_id) AS insertion_id, n, purchases FROM a FULL JOIN b ON a.insertion_id = b.insertion_id""")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clustered(spark, sf_dir).withColumn("insertion_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("idx").cast("string")))
    a = own.groupBy("insertion_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    bought = F.array_sort(F.collect_list(F.struct("us", "event_id")))
    b = own.where("event_type = 'purchase'").groupBy("insertion_id").agg(F.array_join(F.transform(bought, lambda x: x["event_id"].cast("string")), ",").alias("purchases"))
    return merge.outer(a, b, ["insertion_id"])


@_register("""SELECT coalesce(p_size, -1) AS size, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey GROUP BY coalesce(p_size, -1)""")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = _t(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"))
    li = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return merge.looked_up(li, ["l_partkey"], small, "size", -1).groupBy("size").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


@_register("""SELECT p.p_partkey, round(coalesce(h.p, l.p, 0), 6) AS probability FROM part p LEFT JOIN (SELECT p_partkey, p_retailprice / 1000 AS p FROM part WHERE p_size > 25) h ON p.p_partkey = h.p_partkey
LEFT JOIN (SELECT p_partkey, p_retailprice / 2000 AS p FROM part WHERE p_size <= 10) l ON p.p_partkey = l.p_partkey""")
def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    high = p.where("p_size > 25").select("p_partkey", (F.col("p_retailprice") / 1000).alias("probability"))
    low = p.where("p_size <= 10").select("p_partkey", (F.col("p_retailprice") / 2000).alias("probability"))
    return merge.first_known(p.select("p_partkey"), ["p_partkey"], [high, low], "probability", 0.0).select("p_partkey", _r(F.col("probability"), "probability"))


@_register("""SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY p_brand) AS families, count(*) AS n FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey""")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    names = F.collect_set(F.struct(F.col("p_brand").alias("order"), F.col("p_brand").alias("name")))
    return named.groupBy("l_suppkey").agg(names.alias("names")).select("l_suppkey", merge.ordered_names(F.col("names")).alias("families"), F.size("names").cast("long").alias("n"))


@_register("""SELECT l_suppkey, CASE sign(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END)) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END AS strand FROM lineitem GROUP BY l_suppkey""")
def strand_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.sum(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0))
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(merge.sign(v).alias("strand"))


# ---- flags

_FLAG = "SELECT DISTINCT (l_orderkey * 48271 + l_partkey) % 67108864 AS flag FROM lineitem"
_B = dict(flags.BIT)


def _h(*names: str) -> str:
    return f"(flag & {flags.mask(*names)} <> 0)"


_DECODED = ", ".join(f"{_h(bit)} AS {name}" for name, bit in flags.BOOLEANS.items()) + f""",
CASE WHEN {_h('LEFT_FLANK_MAP')} THEN 'only_left' WHEN {_h('RIGHT_FLANK_MAP')} THEN 'only_right' WHEN {_h('DIFF_FLANK_MAP', 'SAME_FLANK_MAP')} THEN 'both_end' ELSE 'unknown' END AS reconstructed_ends,
CASE WHEN {_h('5P_FULL')} AND {_h('3P_FULL')} THEN 'full' WHEN {_h('5P_FULL')} AND {_h('3P_UNKNOWN')} THEN '3p_unknown' WHEN {_h('5P_FULL')} THEN '3p_turncated'
WHEN {_h('3P_FULL')} AND {_h('5P_UNKNOWN')} THEN '5p_unknown' WHEN {_h('3P_FULL')} THEN '5p_turncated' WHEN {_h('3P_UNKNOWN')} AND {_h('5P_UNKNOWN')} THEN '5p3p_unknown' ELSE '5p3p_truncated' END AS truncation,
CASE WHEN {_h('DNA')} THEN 'DNA' WHEN {_h('LTR')} THEN 'LTR' WHEN {_h('LINE')} THEN 'LINE' WHEN {_h('SINE')} THEN 'SINE' WHEN {_h('RETROPOSON')} THEN 'Retroposon' ELSE 'unknown' END AS te_class"""


def _flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.expr("(l_orderkey * 48271 + l_partkey) % 67108864").alias("flag")).distinct()


@_register(f"WITH f AS ({_FLAG}) SELECT flag, {_DECODED} FROM f")
def flag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag_rows(spark, sf_dir).select("flag", *flags.decoded(F.col("flag")))


_PF_FLAG = "(((l_orderkey * 48271 + l_partkey) % 67108864) & 32767) | (((l_orderkey * 48271 + l_partkey) % 67108864) & 66060288) | (1 << (15 + CAST(l_partkey % 5 AS INTEGER)))"
_ENDS, _FULL = f"({_h('LEFT_NEAR_END')} AND {_h('RIGHT_NEAR_END')})", f"({_h('5P_FULL')} AND {_h('3P_FULL')})"
_RETRO = f"(flag & {flags.mask(*flags.CLASSES)} IN ({', '.join(str(flags.BIT[c]) for c in flags.RETRO)}))"
_OTHER = f"(({_h('TSD')} OR NOT {_h('SELF_TO_SELF')}) AND {_ENDS})"


@_register(f"""WITH f AS (SELECT DISTINCT {_PF_FLAG} AS flag, l_linenumber % 3 AS clt_type FROM lineitem)
SELECT flag, clt_type, CASE WHEN {_RETRO} THEN (({_h('POLYA', 'AT_RICH')} AND {_ENDS}) OR (NOT {_h('SELF_TO_SELF')} AND {_FULL} AND {_h('SINGLE_TE')} AND {_ENDS}))
  WHEN flag & {flags.mask(*flags.CLASSES)} = {flags.BIT['LTR']} THEN ({_FULL} OR {_h('SOLO_LTR')}) AND {_OTHER} ELSE {_FULL} AND {_OTHER} END AS passed,
clt_type <> 0 AND {_h('SINGLE_TE')} AND {_ENDS} AND (({_h('5P_FULL')} AND {_h('3P_UNKNOWN')}) OR (NOT {_RETRO} AND {_h('5P_UNKNOWN')} AND {_h('3P_FULL')})) AS secondary,
{_RETRO} AND {_h('POLYA')} AND ({_h('LEFT_NEAR_END')} <> {_h('RIGHT_NEAR_END')}) AS polya_only FROM f""")
def post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("(l_orderkey * 48271 + l_partkey) % 67108864")
    flag = raw.bitwiseAND(F.lit(32767).cast("long")).bitwiseOR(raw.bitwiseAND(F.lit(66060288).cast("long"))).bitwiseOR(F.expr("shiftleft(cast(1 as bigint), cast(15 + l_partkey % 5 as int))"))
    rows = _t(spark, sf_dir, "lineitem").select(flag.alias("flag"), (F.col("l_linenumber") % 3).alias("clt_type")).distinct()
    bits = flags.post_filter(F.col("flag"), F.col("clt_type"))
    return rows.withColumn("bits", bits).select("flag", "clt_type", *(flags.has(F.col("bits"), b).alias(n) for b, n in (("PASS", "passed"), ("SECONDARY", "secondary"), ("POLYA_ONLY", "polya_only"))))


def _pb(c: str) -> str:
    return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


@_register(f"""WITH f AS (SELECT l_orderkey, l_partkey, count(*) AS n, (l_orderkey * 48271 + l_partkey) % 67108864 AS flag FROM lineitem GROUP BY l_orderkey, l_partkey), d AS (SELECT *, {_DECODED} FROM f)
SELECT l_orderkey, l_partkey, concat('insID=', l_orderkey, '-', l_partkey, ',leftClipReads=', n, ',spanningReads=', n + 1, ',rightClipReads=', n + 2, ',teClass=', te_class, ',assembled=', {_pb('assembled')}, ',truncation=', truncation,
',reconstructedEnds=', reconstructed_ends, ',hasPolyA=', {_pb('has_polya')}, ',hasTSD=', {_pb('has_tsd')}, ',singleton=', {_pb('singleton')}, ',self2self=', {_pb('self2self')}, ',soloLTR=', {_pb('solo_ltr')}) AS extra_info,
concat(CASE WHEN passed THEN '-' ELSE '+' END, ':', l_partkey, '-', l_partkey + n) AS query_region FROM d""")
def extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).withColumn("flag", F.expr("(l_orderkey * 48271 + l_partkey) % 67108864"))
    d = f.select("*", *flags.decoded(F.col("flag"))).withColumns({"insertion_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")), "leftclip_reads": F.col("n"), "spanning_reads": F.col("n") + 1, "rightclip_reads": F.col("n") + 2})
    return d.select("l_orderkey", "l_partkey", flags.extra_info().alias("extra_info"), sequences.query_region(F.col("passed"), F.col("l_partkey"), F.col("l_partkey") + F.col("n")).alias("query_region"))


# ---- CIGARs

_CIGAR = "concat(CAST(l_quantity AS INTEGER), 'S', l_orderkey % 90 + 1, 'M', l_partkey % 40, 'I', l_suppkey % 30 + 1, 'M', l_linenumber, 'D', l_partkey % 25 + 1, 'M', l_orderkey % 45 + 1, 'S')"
_WALK = f"""c AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, {_CIGAR} AS cigar FROM lineitem),
o AS (SELECT *, unnest(list_zip(regexp_extract_all(cigar, '([0-9]+)[MIDS]', 1), regexp_extract_all(cigar, '[0-9]+([MIDS])', 1), range(0, 7))) AS x FROM c),
p AS (SELECT * EXCLUDE (x), CAST(x[1] AS INTEGER) AS len, x[2] AS op, x[3] AS i FROM o),
w AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'S', 'I') THEN len ELSE 0 END) OVER v, 0) AS wq, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER v, 0) AS wr, coalesce(sum(CASE WHEN op = 'M' THEN len ELSE 0 END) OVER v, 0) AS wm,
  sum(CASE WHEN op = 'M' THEN len ELSE 0 END) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, q) AS total FROM p
  WINDOW v AS (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, q ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()
    part = lambda e, op: F.concat(F.expr(f"cast({e} as string)"), F.lit(op))
    return li.withColumn("cigar", F.concat(part("q", "S"), part("l_orderkey % 90 + 1", "M"), part("l_partkey % 40", "I"), part("l_suppkey % 30 + 1", "M"), part("l_linenumber", "D"), part("l_partkey % 25 + 1", "M"), part("l_orderkey % 45 + 1", "S")))


@_register(f"""WITH {_WALK} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, CASE i WHEN 0 THEN 1 WHEN 6 THEN 4 ELSE 2 END AS seg_type, CAST(wq AS INTEGER) AS query_start, CAST(wq + len AS INTEGER) AS query_end,
CAST(1000 + wr AS INTEGER) AS ref_position, CAST(CASE i WHEN 0 THEN total WHEN 6 THEN wm ELSE least(wm, total - wm) END AS INTEGER) AS overhang, CAST(total AS INTEGER) AS match_len FROM w WHERE op IN ('S', 'I') AND len >= 20""")
def cigar_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cigars(spark, sf_dir)
    s = c.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q", F.explode(cg.segments(F.col("cigar"), F.lit(1000), 20)).alias("s"))
    return s.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q", *(F.col(f"s.{f}").alias(f) for f in ("seg_type", "query_start", "query_end", "ref_position", "overhang", "match_len")))


@_register(f"""WITH {_WALK}, b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, op, wq, wr, unnest(range(0, len)) AS k FROM w WHERE op IN ('M', 'I', 'D') AND len > 0),
x AS (SELECT *, CASE WHEN op <> 'D' THEN wq + k END AS qp, CASE WHEN op <> 'I' THEN 1000 + wr + k END AS rp FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q, count(*) AS n, count(*) FILTER (qp IS NULL) AS deleted, count(*) FILTER (rp IS NULL) AS inserted,
CAST(sum(qp) AS BIGINT) AS q_sum, CAST(sum(rp) AS BIGINT) AS r_sum, CAST(sum(qp * rp) AS BIGINT) AS qr_sum FROM x GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, q""")
def cigar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q"]
    return _cigars(spark, sf_dir).select(*keys, cg.pair_totals(F.col("cigar"), F.lit(1000)).alias("t")).select(*keys, "t.*")


# ---- sequences (whole texts)


@_register("""WITH c AS (SELECT doc_id, i, text[i] AS ch FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)),
b AS (SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS brk FROM c),
r AS (SELECT doc_id, g, count(*) AS len, any_value(ch) AS ch FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM b) GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_runs, CAST(max(len) AS INTEGER) AS longest, count(*) FILTER (len >= 2) AS n_long, CAST(sum(len) AS BIGINT) AS n_chars FROM r GROUP BY doc_id""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.transform(runs.run_texts(F.col("text")), lambda r: F.length(r)).alias("r"))
    return d.select("doc_id", F.size("r").cast("long").alias("n_runs"), F.array_max("r").alias("longest"), F.size(F.filter("r", lambda x: x >= 2)).cast("long").alias("n_long"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"))


@_register(None)
def scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold over whole texts, which SQL could only do letter by letter; held against a plain fold in tests."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), "aeiouthnrsd ,.", "AAAAAAAAAAATTT").alias("seq"))
    return runs.with_scoring_runs(d, "seq").select("doc_id", F.posexplode("runs").alias("run", "x")).select("doc_id", "run", F.col("x.end").alias("end"), F.col("x.len").alias("len"))


@_register("""WITH c AS (SELECT lang, i, text[i] AS ch, count(*) AS n FROM (SELECT lang, text, unnest(range(1, length(text) + 1)) AS i FROM documents) GROUP BY lang, i, text[i])
SELECT lang, CAST(i AS INTEGER) AS pos, ch, n FROM c QUALIFY row_number() OVER (PARTITION BY lang, i ORDER BY n DESC, ch) = 1""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = consensus.position_counts(_t(spark, sf_dir, "documents"), "lang", "text")
    return consensus.vote(at, ["lang", "pos"], "ch", "n").select("lang", "pos", "ch", "n")


@_register("""WITH w AS (SELECT source, length(unnest(string_split(text, ' '))) AS len FROM documents), k AS (SELECT source, len, count(*) AS n FROM w GROUP BY source, len),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, len) AS r FROM k),
t AS (SELECT source, max(len) FILTER (r = 1) AS a, max(n) FILTER (r = 1) AS na, max(len) FILTER (r = 2) AS b, max(n) FILTER (r = 2) AS nb FROM r WHERE r <= 2 GROUP BY source)
SELECT source, CAST(CASE WHEN a = 3 THEN 3 WHEN b = 3 AND nb = na THEN 3 ELSE a END AS INTEGER) AS length, na AS n FROM t""")
def length_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _t(spark, sf_dir, "documents").select("source", F.explode(F.split("text", " ")).alias("w")).select("source", F.length("w").alias("len"))
    return consensus.length_mode(w, ["source"], "len", 3)


KMER = """g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) >= 8)),
h AS (SELECT item_id, p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 8))"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqjoin.shared_grams(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@_register(f"WITH {KMER} SELECT doc_id, item_id, count(DISTINCT g.gram) AS shared FROM g JOIN h USING (gram) GROUP BY doc_id, item_id")
def kmer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.countDistinct("gram").alias("shared"))


@_register(f"WITH {KMER} SELECT doc_id, item_id, g.p - h.p AS diag, count(*) AS n_seeds, min(g.p) AS first, max(g.p) AS last FROM g JOIN h USING (gram) GROUP BY doc_id, item_id, g.p - h.p")
def diagonal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(spark, sf_dir).groupBy("doc_id", "item_id", (F.col("p") - F.col("ip")).alias("diag")).agg(F.count(F.lit(1)).alias("n_seeds"), F.min("p").alias("first"), F.max("p").alias("last"))


@_register("""WITH t AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS b FROM documents)
SELECT doc_id, md5(substr(text, CAST(greatest(b - 499, 0) AS INTEGER) + 1, CAST(least(b + 1, n) - greatest(b - 499, 0) AS INTEGER))) AS upstream, md5(substr(text, CAST(b AS INTEGER) + 1, CAST(least(b + 500, n) - b AS INTEGER))) AS downstream,
greatest(b - 3000, 0) AS trim_start, least(b + 3000, n) AS trim_end, md5(concat(text, repeat('N', 50))) AS padded, length(replace(text, 'N', '')) AS without_n FROM t""")
def trim_flank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n")).withColumn("b", F.expr("n div 2"))
    f, r = sequences.flanks(F.col("text"), F.col("b"), F.col("b")), sequences.trim_region(F.col("b"), F.col("b"), F.col("n"))
    return t.select("doc_id", F.md5(f["left"]).alias("upstream"), F.md5(f["right"]).alias("downstream"), r["start"].cast("long").alias("trim_start"), r["end"].alias("trim_end"),
                    F.md5(sequences.padded(F.col("text"), F.lit(True), F.lit(False))).alias("padded"), F.length(sequences.without_n(F.col("text"))).cast("long").alias("without_n"))


@_register(f"""WITH {EV}, {GC}, {FEAT}, m AS (SELECT *, (first_us + last_us) // 2 AS mid, last_us - 1800000000 AS left_end, first_us + 1800000000 AS right_start FROM fx)
SELECT user_id, idx, CASE WHEN a AND b THEN 3 WHEN a THEN 1 WHEN b THEN 2 ELSE 0 END AS code, a AND b AND right_start < left_end AND left_end - right_start < 7200000000 AS tsd,
CASE WHEN a AND b THEN least(right_start, left_end) WHEN a THEN left_end - 1 WHEN b THEN right_start - 1 ELSE first_us END AS start, CASE WHEN a AND b THEN greatest(right_start, left_end) WHEN a THEN left_end WHEN b THEN right_start ELSE last_us END AS end_
FROM (SELECT *, abs(left_end - mid) <= 7200000000 AND n_left > 0 AS a, abs(right_start - mid) <= 7200000000 AND n_right > 0 AS b FROM m)""")
def tsd_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annotate import tsd

    f = featured(spark, sf_dir)
    call = tsd(F.col("first_us"), F.col("last_us"), F.when(F.col("n_left") > 0, F.col("last_us") - HOUR // 2), F.when(F.col("n_right") > 0, F.col("first_us") + HOUR // 2), near=2 * HOUR, longest=2 * HOUR)
    return f.select("user_id", "idx", call.alias("c")).select("user_id", "idx", "c.code", "c.tsd", "c.start", F.col("c.end").alias("end_"))


# ---- scores and totals


@_register(f"WITH {EV}, {GC}, {FEAT} SELECT user_id, idx, round({PROB}, 6) AS probability FROM fx")
def logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("user_id", "idx", _r(scoring.logistic(WEIGHTS, BIAS), "probability"))


@_register(f"WITH {EV}, {GC}, {FEAT} SELECT user_id, idx, round({PROB}, 6) AS probability FROM fx")
def pandas_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.scored(featured(spark, sf_dir), scoring.LogisticScorer(WEIGHTS, BIAS), ["user_id", "idx"], sorted(WEIGHTS))
    return out.select("user_id", "idx", _r(F.col("probability"), "probability"))


@_register(f"WITH {EV}, {GC}, {FEAT} SELECT user_id, idx, CASE WHEN n < 5 THEN 1 WHEN n < 10 THEN 2 WHEN n < 40 THEN 3 WHEN n < 70 THEN 4 ELSE 5 END AS min_edge FROM fx")
def min_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("user_id", "idx", sequences.min_edge(F.col("n")).alias("min_edge"))


@_register(f"WITH {EV}, {GC}, {FEAT}, {LOW} SELECT (SELECT count(*) FROM ev) AS segments, (SELECT count(*) FROM fx) AS clusters, (SELECT count(*) FROM g) AS high_quality")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).agg(F.sum("n").alias("segments"), F.count(F.lit(1)).alias("clusters"))
    return f.crossJoin(high_quality(spark, sf_dir).agg(F.count(F.lit(1)).alias("high_quality")))  # one row each

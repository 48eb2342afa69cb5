"""The operators over the driver's tables, each beside its SQL.

Tables play the parts of genomic data: line items are methylation calls, running sums of part sizes are bins, orders
are features, customers are regions, documents' letters are read as bases, suppliers as fragments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import ship
from ..functions import sequences as seq_
from ..operators import annotate, bins as bins_, calling, clean, counts as counts_, depth as depth_, diff, intervals
from ..sources import sinks, tables
from ..streaming import live_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
AS_BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# The views, in Spark and in SQL.


def v_calls(spark: SparkSession, d: str) -> DataFrame:
    sample = F.col("l_suppkey") % 6
    return read(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("chrom"), (F.col("l_partkey") + 1).cast("int").alias("pos"), sample.cast("int").alias("sample_no"), (sample % 2 + 1).cast("int").alias("group_no"), (F.col("l_linestatus") == "O").alias("meth"))


def v_samples(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").cast("int").alias("sample_no"), (F.col("id") % 2 + 1).cast("int").alias("group_no"))


def v_bins(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("bin_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, d, "part").select((F.col("p_partkey") % 7 + 1).cast("string").alias("chrom"), F.col("p_partkey").alias("bin_id"), F.col("p_size").cast("int").alias("len"))
    return rows.withColumn("end", F.sum("len").over(order).cast("int")).select("chrom", "bin_id", (F.col("end") - F.col("len") + 1).alias("start"), "end")


def v_cpgs(spark: SparkSession, d: str) -> DataFrame:
    return v_calls(spark, d).where("pos % 3 = 0").select("chrom", "pos").distinct()


def v_features(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("o_orderkey") * 10 + 1).cast("int")
    return read(spark, d, "orders").select((F.col("o_custkey") % 7 + 1).cast("string").alias("chrom"), F.col("o_orderkey").alias("feat_no"), start.alias("start"), (start + F.col("o_custkey") % 50 + 4).cast("int").alias("end"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), F.col("o_orderpriority").alias("type"))


def v_regions(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("c_custkey") * 100 + 1).cast("int")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("region_no"), (F.col("c_nationkey") % 7 + 1).cast("string").alias("chrom"), s.alias("s"), (s + F.col("c_custkey") % 30).cast("int").alias("e"))


def bases(text: str = "text") -> Column:
    return seq_.exchanged(F.coalesce(F.col(text), F.lit("")), LETTERS, AS_BASES)


def v_reads(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", bases().alias("seq"))


CALLS = "calls AS (SELECT l_linenumber::VARCHAR AS chrom, (l_partkey + 1)::INT AS pos, (l_suppkey % 6)::INT AS sample_no, (l_suppkey % 6 % 2 + 1)::INT AS group_no, l_linestatus = 'O' AS meth FROM lineitem)"
SAMPLES = "samples AS (SELECT range::INT AS sample_no, (range % 2 + 1)::INT AS group_no FROM range(6))"
BINS = 'bins AS (SELECT chrom, bin_id, (stop - len + 1)::INT AS start, stop FROM (SELECT *, (sum(len) OVER (PARTITION BY chrom ORDER BY bin_id))::INT AS stop FROM (SELECT (p_partkey % 7 + 1)::VARCHAR AS chrom, p_partkey AS bin_id, p_size AS len FROM part)))'
CPGS = "cpgs AS (SELECT DISTINCT chrom, pos FROM calls WHERE pos % 3 = 0)"
NCPG = "ncpg AS (SELECT b.*, (SELECT count(*) FROM cpgs c WHERE c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop)::INT AS n_cpg FROM bins b)"
HIT = "hit AS (SELECT b.chrom, b.bin_id, sample_no, count(*) FILTER (meth) AS m, count(*) FILTER (NOT meth) AS u FROM calls c JOIN bins b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop GROUP BY ALL)"
DENSE = "dense AS (SELECT b.chrom, b.bin_id, n_cpg, s.sample_no, s.group_no, coalesce(m, 0)::BIGINT AS meth, coalesce(u, 0)::BIGINT AS unmeth FROM ncpg b CROSS JOIN samples s LEFT JOIN hit h ON h.chrom = b.chrom AND h.bin_id = b.bin_id AND h.sample_no = s.sample_no)"
WINDOWS = "wins AS (SELECT chrom, (pos - 1) // 100 AS bin_id, sample_no, group_no, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM calls GROUP BY ALL)"
ALL = f"WITH {CALLS}, {SAMPLES}, {BINS}, {CPGS}, {NCPG}, {HIT}, {DENSE}"
WIN = f"WITH {CALLS}, {WINDOWS}"
FEATURES = "feats AS (SELECT (o_custkey % 7 + 1)::VARCHAR AS chrom, o_orderkey AS feat_no, (o_orderkey * 10 + 1)::INT AS lo, (o_orderkey * 10 + 5 + o_custkey % 50)::INT AS hi, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, o_orderpriority AS type FROM orders)"
REGIONS = "regs AS (SELECT c_custkey AS region_no, (c_nationkey % 7 + 1)::VARCHAR AS chrom, (c_custkey * 100 + 1)::INT AS s, (c_custkey * 100 + 1 + c_custkey % 30)::INT AS e FROM customer)"
FR = f"WITH {FEATURES}, {REGIONS}"
READS = f"WITH reads AS (SELECT doc_id, translate(coalesce(text, ''), '{LETTERS}', '{AS_BASES}') AS seq FROM documents)"
FISHER = "exp(lgamma(a.meth + a.unmeth + 1) - lgamma(a.meth + 1) - lgamma(a.unmeth + 1) + lgamma(b.meth + b.unmeth + 1) - lgamma(b.meth + 1) - lgamma(b.unmeth + 1) - lgamma(a.meth + a.unmeth + b.meth + b.unmeth + 1) + lgamma(a.meth + b.meth + 1) + lgamma(a.unmeth + b.unmeth + 1))"


def dense_counts_(spark: SparkSession, d: str) -> DataFrame:
    b = bins_.with_cpgs(v_bins(spark, d), v_cpgs(spark, d))
    counts = counts_.dense(counts_.bin_counts(v_calls(spark, d), v_bins(spark, d)), v_bins(spark, d), v_samples(spark))
    return counts.join(b.select("chrom", "bin_id", "n_cpg"), ["chrom", "bin_id"])


def used(df: DataFrame) -> DataFrame:
    return counts_.with_mask(df, counts_.Limits(least_hits=1))


def win_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_.window_counts(v_calls(spark, d), 100).withColumn("used", F.lit(True))


# Counts.


@query(f"{WIN} SELECT * FROM wins")
def window_counts(spark, d):
    return counts_.window_counts(v_calls(spark, d), 100)


@query(f"{WIN} SELECT a.chrom, a.bin_id, a.sample_no AS sample_1, b.sample_no AS sample_2, round({FISHER}, 6) AS p FROM wins a JOIN wins b ON a.chrom = b.chrom AND a.bin_id = b.bin_id AND a.sample_no < b.sample_no")
def window_fisher(spark, d):
    """The flagship: calls, windows, counts, pairs' point probabilities."""
    return diff.pairs(win_counts(spark, d)).select("chrom", "bin_id", "sample_1", "sample_2", F.round("p", 6).alias("p"))


@query(f"{ALL} SELECT chrom, bin_id, sample_no, group_no, meth, unmeth, n_cpg FROM dense")
def dense_bin_counts(spark, d):
    return dense_counts_(spark, d).select("chrom", "bin_id", "sample_no", "group_no", "meth", "unmeth", "n_cpg")


@query(f"""WITH {CALLS}, {BINS}, wide AS (SELECT chrom, bin_id, start, stop + 40 AS stop FROM bins),
    first_ AS (SELECT c.chrom, c.pos, min(bin_id) AS bin_id FROM (SELECT DISTINCT chrom, pos FROM calls) c JOIN wide b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop GROUP BY ALL)
    SELECT chrom, bin_id, sample_no, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM calls JOIN first_ USING (chrom, pos) GROUP BY ALL""")
def overlapping_bin_counts(spark, d):
    wide = v_bins(spark, d).withColumn("end", F.col("end") + 40)
    return counts_.bin_counts(v_calls(spark, d), wide).select("chrom", "bin_id", "sample_no", "meth", "unmeth")


@query(f"WITH {CALLS}, {BINS} SELECT c.chrom, c.pos, count(*) AS n FROM calls c WHERE NOT EXISTS (SELECT 1 FROM bins b WHERE b.chrom = c.chrom AND c.pos BETWEEN b.start AND b.stop AND (b.stop - b.start) % 2 = 0) GROUP BY ALL")
def calls_missed(spark, d):
    some = v_bins(spark, d).where("(end - start) % 2 = 0")
    return counts_.missed(v_calls(spark, d), some).groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, {BINS} SELECT c.chrom, c.sample_no, count(*) AS n, sum(pos)::BIGINT AS places FROM calls c WHERE NOT EXISTS (SELECT 1 FROM bins b WHERE b.chrom = c.chrom AND c.pos BETWEEN b.start AND b.stop AND b.stop - b.start > 30) GROUP BY ALL")
def excluded_regions(spark, d):
    out = v_bins(spark, d).where("end - start > 30")
    return counts_.without_excluded(v_calls(spark, d), out).groupBy("chrom", "sample_no").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"))


@query(f"""WITH {CALLS}, {BINS}, {CPGS}, slots AS (SELECT c.chrom, bin_id, pos, row_number() OVER (PARTITION BY c.chrom, bin_id ORDER BY pos)::INT AS slot FROM cpgs c JOIN bins b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop)
    SELECT c.chrom, b.bin_id, sample_no, coalesce(x.slot, y.slot, 0) AS slot, coalesce(x.pos, y.pos, 0) AS pos, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth
    FROM calls c JOIN bins b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop
    LEFT JOIN slots x ON x.chrom = c.chrom AND x.bin_id = b.bin_id AND x.pos = c.pos LEFT JOIN slots y ON y.chrom = c.chrom AND y.bin_id = b.bin_id AND y.pos = c.pos - 1 GROUP BY ALL""")
def cpg_detail_counts(spark, d):
    return counts_.cpg_counts(v_calls(spark, d), v_cpgs(spark, d), v_bins(spark, d), merge_strands=True)


@query(f"""{ALL}, x AS (SELECT *, meth + unmeth AS n, CASE WHEN meth + unmeth > 0 THEN meth / (meth + unmeth) ELSE -1.0 END AS share,
        count(*) FILTER (meth + unmeth > 0) OVER (PARTITION BY chrom, bin_id) AS nz FROM dense),
    y AS (SELECT *, min(share) FILTER (n > 0) OVER (PARTITION BY chrom, bin_id) AS lo, max(share) FILTER (n > 0) OVER (PARTITION BY chrom, bin_id) AS hi FROM x)
    SELECT chrom, bin_id, sample_no, CASE WHEN n < 3 THEN 1 WHEN n_cpg <= 0 OR n / n_cpg < 1.0 THEN 2 WHEN n_cpg <= 0 OR n / n_cpg > 40.0 THEN 3 WHEN n = 0 OR share < 0.2 THEN 4 WHEN n_cpg <= 2 THEN 5
        WHEN nz < 3 THEN 6 WHEN NOT coalesce(lo = 0 OR hi / lo >= 1.5, false) THEN 8 ELSE 0 END AS failed FROM y""")
def validity_mask(spark, d):
    limits = counts_.Limits(least_hits=3, least_per_cpg=1.0, most_per_cpg=40.0, least_proportion=0.2, over_cpgs=2, least_samples=3, fold=1.5)
    return counts_.with_mask(dense_counts_(spark, d), limits).select("chrom", "bin_id", "sample_no", "failed")


@query(f"{WIN}, t AS (SELECT chrom, bin_id, sum(meth) AS meth, sum(unmeth) AS unmeth FROM wins GROUP BY ALL) SELECT chrom, (grouping(chrom))::INT AS all_chroms, count(*) AS bins, count(*) FILTER (meth + unmeth > 0) AS bins_hit, sum(meth)::BIGINT AS meth, sum(unmeth)::BIGINT AS unmeth FROM t GROUP BY ROLLUP (chrom)")
def bin_totals(spark, d):
    return counts_.totals(win_counts(spark, d))


@query(f"""WITH {BINS}, a AS (SELECT chrom, start, stop, bin_id FROM bins WHERE stop - start > 10), b AS (SELECT chrom, start, stop, bin_id FROM bins WHERE stop - start < 35)
    SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.start, b.start) AS start, coalesce(a.stop, b.stop) AS "end", CASE WHEN a.chrom IS NULL THEN 'first' WHEN b.chrom IS NULL THEN 'second' ELSE 'none' END AS missing_in, a.bin_id AS bin_id_1, b.bin_id AS bin_id_2
    FROM a FULL JOIN b ON a.chrom = b.chrom AND a.start = b.start AND a.stop = b.stop""")
def same_bounds(spark, d):
    b = v_bins(spark, d)
    return counts_.same_bounds(b.where("end - start > 10").select("chrom", "start", "end", "bin_id"), b.where("end - start < 35").select("chrom", "start", "end", "bin_id"))


# Statistics.


@query(f"""{ALL}, k AS (SELECT * FROM dense WHERE meth + unmeth >= 1 AND n_cpg >= 2),
    x AS (SELECT a.chrom, a.bin_id, a.sample_no AS sample_1, b.sample_no AS sample_2, round({FISHER}, 6) AS p, a.meth / (a.meth + a.unmeth) AS pa, b.meth / (b.meth + b.unmeth) AS pb FROM k a JOIN k b ON a.chrom = b.chrom AND a.bin_id = b.bin_id AND a.sample_no < b.sample_no)
    SELECT chrom, bin_id, sample_1, sample_2, p, CASE WHEN pa > 0 AND pb > 0 THEN round(greatest(pa, pb) / least(pa, pb), 6) END AS fold, CASE WHEN pa = pb THEN '=' WHEN pa > pb THEN sample_1::VARCHAR ELSE sample_2::VARCHAR END AS greater FROM x""")
def pairwise(spark, d):
    rows = diff.bin_stats(used(dense_counts_(spark, d)), "P", least_cpgs=2)
    return rows.select("chrom", "bin_id", "sample_1", "sample_2", F.round("p", 6).alias("p"), F.round("fold", 6).alias("fold"), "greater")


CHI = """tot AS (SELECT chrom, bin_id, sum(meth) / sum(meth + unmeth) AS share, sum(meth + unmeth) AS hits, min(meth + unmeth) AS least FROM k GROUP BY ALL),
    chi AS (SELECT chrom, bin_id, sum(CASE WHEN share > 0 THEN (meth - (meth + unmeth) * share) ** 2 / ((meth + unmeth) * share) ELSE 0 END + CASE WHEN share < 1 THEN (unmeth - (meth + unmeth) * (1 - share)) ** 2 / ((meth + unmeth) * (1 - share)) ELSE 0 END) AS chi, (count(*) - 1)::INT AS df FROM k JOIN tot USING (chrom, bin_id) GROUP BY ALL)"""


@query(f"{WIN}, k AS (SELECT * FROM wins), {CHI} SELECT chrom, bin_id, round(chi, 6) AS chi, df FROM chi")
def chi_square(spark, d):
    return diff.chi_square(win_counts(spark, d)).select("chrom", "bin_id", F.round("chi", 6).alias("chi"), "df")


def _pruned(steps: int = 6) -> str:
    """SQL of the step-by-step pruning; each step drops a sample or is the last, so as many steps as samples do."""
    parts = ["u0 AS (SELECT * FROM dense WHERE meth + unmeth >= 1)"]
    for i in range(steps):
        parts.append(f"s{i} AS (SELECT *, sum(meth) OVER w / sum(meth + unmeth) OVER w AS share, count(*) OVER w AS k FROM u{i} WINDOW w AS (PARTITION BY chrom, bin_id))")
        parts.append(f"u{i + 1} AS (SELECT * EXCLUDE (share, k) FROM s{i} WHERE k < 2 OR ((meth + unmeth) * share >= 5 AND (meth + unmeth) * (1 - share) >= 5))")
    parts.append(f"e AS (SELECT *, sum(meth) OVER w / sum(meth + unmeth) OVER w AS share FROM u{steps} WINDOW w AS (PARTITION BY chrom, bin_id))")
    parts.append("c AS (SELECT chrom, bin_id, count(*)::INT AS samples, sum((meth - (meth + unmeth) * share) ** 2 / ((meth + unmeth) * share) + (unmeth - (meth + unmeth) * (1 - share)) ** 2 / ((meth + unmeth) * (1 - share))) AS chi FROM e GROUP BY ALL)")
    return ", ".join(parts)


@query(f"{ALL}, {_pruned()} SELECT b.chrom, b.bin_id, CASE WHEN samples >= 2 THEN round(chi, 6) ELSE 0.0 END AS chi, (CASE WHEN samples >= 2 THEN samples - 1 ELSE 0 END)::INT AS df, coalesce(samples, 0)::INT AS samples FROM bins b LEFT JOIN c USING (chrom, bin_id)")
def chi_square_pruned(spark, d):
    return diff.chi_square_pruned(used(dense_counts_(spark, d))).select("chrom", "bin_id", F.round("chi", 6).alias("chi"), "df", "samples")


@query(f"{WIN}, k AS (SELECT * FROM wins), {CHI} SELECT chrom, bin_id, round(share, 6) AS share, round(least(share, 1 - share) * least, 6) AS least_expected, hits::BIGINT AS hits FROM tot")
def expected_counts(spark, d):
    return diff.expected(win_counts(spark, d)).select("chrom", "bin_id", F.round("share", 6).alias("share"), F.round("least_expected", 6).alias("least_expected"), "hits")


@query()
def best_test(spark, d):
    return diff.bin_stats(used(dense_counts_(spark, d)), "q", least_cpgs=1).select("chrom", "bin_id", "kind", F.round("p", 6).alias("p"), "df")


@query()
def pair_or_chi(spark, d):
    return diff.bin_stats(used(dense_counts_(spark, d)), "p", least_cpgs=1).select("chrom", "bin_id", "kind", "sample_1", "sample_2", "df", F.round("p", 6).alias("p"))


@query()
def chi_or_pairs(spark, d):
    return diff.bin_stats(used(dense_counts_(spark, d)), "x", least_cpgs=1).select("chrom", "bin_id", "kind", "sample_1", "sample_2", "df", F.round("p", 6).alias("p"))


@query(f"""{WIN}, x AS (SELECT a.chrom, a.bin_id, round({FISHER}, 6) AS p FROM wins a JOIN wins b ON a.chrom = b.chrom AND a.bin_id = b.bin_id AND a.sample_no < b.sample_no)
    SELECT chrom, bin_id, min(p) AS least_p, max(p) AS most_p, count(*) AS n FROM x GROUP BY ALL""")
def all_pair_values(spark, d):
    rows = diff.all_pairs(win_counts(spark, d))
    return rows.select("chrom", "bin_id", F.round(F.array_min("p_values"), 6).alias("least_p"), F.round(F.array_max("p_values"), 6).alias("most_p"), F.size("p_values").cast("bigint").alias("n"))


ANOVA = """x AS (SELECT *, meth / (meth + unmeth) AS x FROM k WHERE meth + unmeth > 0),
    g AS (SELECT chrom, bin_id, group_no, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL),
    b AS (SELECT chrom, bin_id, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS t FROM g GROUP BY ALL HAVING count(*) FILTER (n >= 2) >= 2),
    a AS (SELECT chrom, bin_id, q - s * s / n AS ss_total, t - s * s / n AS ss_treat, (k - 1)::INT AS df1, (n - k)::INT AS df2 FROM b)"""


@query(f"{WIN}, k AS (SELECT * FROM wins), {ANOVA} SELECT chrom, bin_id, round(ss_total, 6) AS ss_total, round(ss_treat, 6) AS ss_treat, df1, df2, CASE WHEN ss_total > 1e-12 AND ss_treat > 1e-12 AND df2 > 0 AND ss_total > ss_treat THEN round(ss_treat * df2 / ((ss_total - ss_treat) * df1), 4) END AS f FROM a")
def anova(spark, d):
    return diff.anova(win_counts(spark, d)).select("chrom", "bin_id", F.round("ss_total", 6).alias("ss_total"), F.round("ss_treat", 6).alias("ss_treat"), "df1", "df2", F.round("f", 4).alias("f"))


@query(f"""{WIN}, k AS (SELECT * FROM wins), {ANOVA}, f AS (SELECT *, CASE WHEN ss_total > 1e-12 AND ss_treat > 1e-12 AND df2 > 0 AND ss_total > ss_treat THEN atan(sqrt(ss_treat * df2 / ((ss_total - ss_treat) * df1) / df2)) END AS t FROM a),
    g2 AS (SELECT chrom, bin_id, group_no, sum(meth) / sum(meth + unmeth) AS pooled FROM x GROUP BY ALL), top AS (SELECT chrom, bin_id, group_no FROM g2 QUALIFY row_number() OVER (PARTITION BY chrom, bin_id ORDER BY pooled DESC, group_no) = 1)
    SELECT chrom, bin_id, round(CASE df2 WHEN 1 THEN 1 - 2 * t / pi() WHEN 2 THEN 1 - sin(t) WHEN 3 THEN 1 - 2 / pi() * (t + sin(t) * cos(t)) WHEN 4 THEN 1 - sin(t) * (1 + cos(t) ** 2 / 2) END, 6) AS p, group_no AS greater FROM f JOIN top USING (chrom, bin_id)""")
def anova_p(spark, d):
    return diff.bin_stats(win_counts(spark, d), "a").select("chrom", "bin_id", F.round("p", 6).alias("p"), "greater")


@query(f"""{WIN}, k AS (SELECT * FROM wins), {ANOVA}, p AS (SELECT chrom, bin_id, group_no, round(sum(meth) / sum(meth + unmeth), 6) AS group_prop, count(*) AS group_n FROM x GROUP BY ALL)
    SELECT chrom, bin_id, sample_no, group_no, round(x.x, 6) AS prop, group_prop, group_n FROM x JOIN p USING (chrom, bin_id, group_no) JOIN a USING (chrom, bin_id)""")
def anova_detail(spark, d):
    counts = win_counts(spark, d)
    return diff.anova_detail(counts, diff.anova(counts)).select("chrom", "bin_id", "sample_no", "group_no", F.round("prop", 6).alias("prop"), F.round("group_prop", 6).alias("group_prop"), "group_n")


@query(f"""{WIN} SELECT chrom, bin_id, {', '.join(f"coalesce(printf('%.6f', round(max(meth / (meth + unmeth)) FILTER (sample_no = {s}), 6)), '-') AS s{s}" for s in range(6))} FROM wins GROUP BY ALL""")
def sample_columns(spark, d):
    rows = win_counts(spark, d).withColumn("prop", seq_.proportion(F.col("meth"), F.col("unmeth")))
    return diff.pivoted(rows, list(range(6)))


@query(f"{WIN} SELECT chrom, bin_id, round(avg(meth / (meth + unmeth)), 6) AS mean, round(stddev_samp(meth / (meth + unmeth)), 6) AS sd, count(*)::INT AS n FROM wins GROUP BY ALL HAVING count(*) >= 2")
def deviation(spark, d):
    return diff.bin_stats(win_counts(spark, d), "D").select("chrom", "bin_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"{ALL} SELECT chrom, bin_id, group_no, CASE WHEN coalesce(sum(meth + unmeth) FILTER (meth + unmeth >= 2), 0) > 0 THEN round(sum(meth) FILTER (meth + unmeth >= 2) / sum(meth + unmeth) FILTER (meth + unmeth >= 2), 6) ELSE -1.0 END AS prop FROM dense GROUP BY ALL")
def pooled_groups(spark, d):
    counts = counts_.with_mask(dense_counts_(spark, d), counts_.Limits(least_hits=2))
    return diff.pooled(counts).select("chrom", "bin_id", "group_no", F.round("prop", 6).alias("prop"))


@query(f"{ALL} SELECT chrom, bin_id, string_agg(CASE WHEN meth + unmeth >= 1 THEN meth || '+/' || unmeth || '-' ELSE '-' END, chr(9) ORDER BY sample_no) AS cells FROM dense GROUP BY ALL HAVING sum(meth + unmeth) > 0")
def bin_listing(spark, d):
    return diff.bin_stats(used(dense_counts_(spark, d)), "L")


@query(f"""{ALL}, r AS (SELECT a.chrom, a.bin_id, a.meth AS m1, a.unmeth AS u1, b.meth AS m2, b.unmeth AS u2, round({FISHER}, 6) AS p FROM dense a JOIN dense b ON a.chrom = b.chrom AND a.bin_id = b.bin_id AND a.sample_no = 0 AND b.sample_no = 1 WHERE a.n_cpg >= 5 AND a.meth > 0 AND a.unmeth > 0 AND b.meth > 0 AND b.unmeth > 0)
    SELECT chrom, bin_id, p FROM r WHERE (m1 / u1) / (m2 / u2) >= 2 OR (m1 / u1) / (m2 / u2) <= 0.5""")
def reduced_two_samples(spark, d):
    counts = dense_counts_(spark, d)
    bins = bins_.with_cpgs(v_bins(spark, d), v_cpgs(spark, d))
    return diff.reduced_test(counts, bins, 0, 1).select("chrom", "bin_id", F.round("p", 6).alias("p"))


# Depth.

DEPTH = f"WITH {CALLS}, {CPGS}, d AS (SELECT p.chrom, p.pos, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM cpgs p LEFT JOIN calls c ON c.chrom = p.chrom AND c.pos = p.pos GROUP BY ALL)"


@query(f"{DEPTH} SELECT * FROM d")
def depth_list(spark, d):
    return depth_.position_depth(v_calls(spark, d), v_cpgs(spark, d))


@query(f"""WITH {CALLS}, {CPGS}, n AS (SELECT c.chrom, c.pos, c.meth, min(p.pos) AS at FROM calls c JOIN cpgs p ON p.chrom = c.chrom AND abs(p.pos - c.pos) <= 1 GROUP BY c.chrom, c.pos, c.meth, c.sample_no, c.group_no),
    m AS (SELECT c.chrom, c.meth, (SELECT min(p.pos) FROM cpgs p WHERE p.chrom = c.chrom AND abs(p.pos - c.pos) <= 1) AS at FROM calls c)
    SELECT p.chrom, p.pos, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM cpgs p LEFT JOIN m ON m.chrom = p.chrom AND m.at = p.pos GROUP BY ALL""")
def depth_near(spark, d):
    return depth_.position_depth(v_calls(spark, d), v_cpgs(spark, d), near=1)


@query(f"{DEPTH}, x AS (SELECT *, meth + unmeth AS d FROM d) SELECT count(*) AS positions, count(*) FILTER (meth > 0) AS pos_meth, count(*) FILTER (unmeth > 0) AS pos_unmeth, sum(meth)::BIGINT AS meth, sum(unmeth)::BIGINT AS unmeth, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, median(d) AS median, (SELECT d FROM x GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) AS mode FROM x")
def depth_statistics(spark, d):
    made = depth_.statistics(depth_.position_depth(v_calls(spark, d), v_cpgs(spark, d)))
    return made.select("positions", "pos_meth", "pos_unmeth", "meth", "unmeth", "least", "most", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median", "mode")


@query(f"{DEPTH}, h AS (SELECT meth + unmeth AS depth, count(*) AS positions FROM d GROUP BY ALL) SELECT r.range AS depth, coalesce(positions, 0) AS positions FROM range((SELECT max(depth) + 1 FROM h)) r LEFT JOIN h ON h.depth = r.range")
def depth_histogram(spark, d):
    return depth_.histogram(depth_.position_depth(v_calls(spark, d), v_cpgs(spark, d)))


@query(f"""{DEPTH}, h AS (SELECT meth + unmeth AS depth, count(*) AS positions FROM d GROUP BY ALL), f AS (SELECT r.range AS depth, coalesce(positions, 0) AS positions FROM range((SELECT max(depth) + 1 FROM h)) r LEFT JOIN h ON h.depth = r.range),
    n AS (SELECT *, max(positions) OVER () AS most, CASE WHEN positions = 0 AND lag(positions, 1, 1) OVER (ORDER BY depth) = 0 THEN 0 ELSE 1 END AS fresh FROM f), g AS (SELECT *, sum(fresh) OVER (ORDER BY depth) AS run FROM n),
    z AS (SELECT *, count(*) OVER (PARTITION BY run) AS size, min(depth) OVER (PARTITION BY run) AS first FROM g)
    SELECT depth, CASE WHEN positions = 0 AND size > 3 THEN '[...]' ELSE depth || chr(9) || positions || chr(9) || repeat('*', (positions * 50 // most)::INT) END AS line FROM z WHERE positions > 0 OR size <= 3 OR depth = first""")
def depth_bars(spark, d):
    return depth_.bars(depth_.histogram(depth_.position_depth(v_calls(spark, d), v_cpgs(spark, d))))


@query(f"WITH {CALLS}, {CPGS} SELECT chrom, EXISTS (SELECT 1 FROM cpgs p WHERE p.chrom = c.chrom AND p.pos = c.pos) AS hit, count(*) AS n FROM calls c GROUP BY ALL")
def call_hits(spark, d):
    return depth_.hits(v_calls(spark, d), v_cpgs(spark, d)).groupBy("chrom", "hit").agg(F.count("*").alias("n"))


# Intervals.


@query(f"""WITH {BINS}, k AS (SELECT * FROM bins WHERE (stop - start) % 3 > 0), s AS (SELECT *, CASE WHEN start = lag(stop) OVER (PARTITION BY chrom ORDER BY start) + 1 THEN 0 ELSE 1 END AS step FROM k),
    r AS (SELECT *, sum(step) OVER (PARTITION BY chrom ORDER BY start) AS run FROM s) SELECT chrom, min(start) AS start, max(stop) AS "end", count(*) AS merged FROM r GROUP BY chrom, run""")
def joined_bins(spark, d):
    return intervals.merge_runs(v_bins(spark, d).where("(end - start) % 3 > 0"))


@query(f"""WITH {BINS}, k AS (SELECT * FROM bins WHERE (stop - start) % 3 > 0), g AS (SELECT chrom, stop + 1 AS start, lead(start) OVER (PARTITION BY chrom ORDER BY start) - 1 AS "end" FROM k) SELECT * FROM g WHERE start <= "end" """)
def gap_bins(spark, d):
    return intervals.gaps(v_bins(spark, d).where("(end - start) % 3 > 0"))


@query(f"""WITH {BINS}, k AS (SELECT * FROM bins WHERE (stop - start) % 3 > 0) SELECT chrom, bin_id, (sum(stop - start + 1) OVER w - (stop - start + 1) + 1)::BIGINT AS new_start, (sum(stop - start + 1) OVER w)::BIGINT AS new_end FROM k WINDOW w AS (PARTITION BY chrom ORDER BY start)""")
def rebased_bins(spark, d):
    return intervals.rebased(v_bins(spark, d).where("(end - start) % 3 > 0")).select("chrom", "bin_id", F.col("new_start").cast("bigint").alias("new_start"), "new_end")


@query(f"""WITH {CALLS}, {BINS}, {CPGS}, {NCPG} SELECT chrom, bin_id, start, stop AS "end", n_cpg FROM ncpg WHERE stop - start + 1 BETWEEN 10 AND 40 AND n_cpg >= 2""")
def pruned_bins(spark, d):
    made = bins_.with_cpgs(bins_.sized(v_bins(spark, d), 10, 40), v_cpgs(spark, d))
    return bins_.with_least_cpgs(made, 2)


@query()
def amalgamated_bins(spark, d):
    return bins_.amalgamated(bins_.with_cpgs(v_bins(spark, d), v_cpgs(spark, d)), 5)


@query(f"""{FR}, c AS (SELECT r.region_no, f.feat_no, CASE WHEN strand = '-' THEN s - hi + 1 ELSE lo - e + 1 END AS score FROM regs r JOIN feats f ON r.chrom = f.chrom
    WHERE CASE WHEN strand = '-' THEN s >= lo AND (s > hi OR (s <= hi AND e > hi)) ELSE e < lo OR (s < lo AND e BETWEEN lo AND hi) END)
    SELECT region_no, min(score)::BIGINT AS score, min_by(feat_no, score * 1000000000.0 + feat_no) AS feat_no FROM c GROUP BY region_no""")
def nearest_feature(spark, d):
    return annotate.nearest(v_regions(spark, d), v_features(spark, d)).select("region_no", "score", "feat_no")


@query(f"{FR}, c AS (SELECT r.region_no, f.feat_no, abs(f.lo - r.s) AS distance FROM regs r JOIN feats f ON r.chrom = f.chrom) SELECT region_no, min(distance)::BIGINT AS distance, min_by(feat_no, distance * 1000000000.0 + feat_no) AS feat_no FROM c GROUP BY region_no")
def proximal_feature(spark, d):
    return annotate.proximal(v_regions(spark, d), v_features(spark, d)).select("region_no", "distance", "feat_no")


@query(f"""WITH {FEATURES}, o AS (SELECT * FROM feats WHERE type = '1-URGENT'), g AS (SELECT * FROM feats WHERE type <> '1-URGENT'),
    c AS (SELECT g.feat_no AS gene_no, o.feat_no AS near_no, CASE WHEN g.strand = '-' THEN o.lo - g.hi + 1 ELSE g.lo - o.hi + 1 END AS distance FROM g JOIN o ON g.chrom = o.chrom WHERE CASE WHEN g.strand = '-' THEN o.lo > g.hi ELSE o.hi < g.lo END)
    SELECT gene_no, min(distance)::BIGINT AS distance, min_by(near_no, distance * 1000000000.0 + near_no) AS near_no FROM c GROUP BY gene_no""")
def upstream_feature(spark, d):
    f = v_features(spark, d)
    return annotate.upstream_of(f.where("type <> '1-URGENT'"), f.where("type = '1-URGENT'")).select("gene_no", "distance", "near_no")


@query(f"{FR} SELECT region_no, (SELECT count(*) FROM feats f WHERE f.chrom = r.chrom AND f.lo <= r.e AND f.hi >= r.s) AS n_features FROM regs r")
def feature_counts(spark, d):
    return annotate.counted(v_regions(spark, d), v_features(spark, d)).select("region_no", "n_features")


@query(f"{FR} SELECT region_no, feat_no, least(e, hi) - greatest(s, lo) + 1 AS overlap FROM regs r JOIN feats f ON f.chrom = r.chrom AND f.lo <= r.e AND f.hi >= r.s")
def overlap_lengths(spark, d):
    return annotate.overlap_lengths(v_regions(spark, d), v_features(spark, d))


@query(f"WITH {FEATURES} SELECT a.feat_no, min(b.feat_no) AS inner_no FROM feats a JOIN feats b ON a.chrom = b.chrom AND b.lo >= a.lo AND b.hi <= a.hi AND b.type = '1-URGENT' AND a.type <> '1-URGENT' GROUP BY a.feat_no")
def included_feature(spark, d):
    f = v_features(spark, d)
    return annotate.included(f.where("type <> '1-URGENT'"), f.where("type = '1-URGENT'")).select("feat_no", "inner_no")


PLACE = "CASE WHEN {q} BETWEEN lo AND hi THEN 'in' WHEN (strand = '-' AND {q} > hi) OR (strand <> '-' AND {q} < lo) THEN '5' ELSE '3' END"


@query(f"""{FR}, c AS (SELECT region_no, feat_no, strand, {PLACE.format(q='s')} AS a, {PLACE.format(q='e')} AS b FROM regs r JOIN feats f ON f.chrom = r.chrom AND f.lo <= r.e AND f.hi >= r.s)
    SELECT region_no, feat_no, CASE WHEN a = 'in' AND b = 'in' THEN 'internal' WHEN a = 'in' AND b = '3' THEN '3''_overlap' WHEN a = 'in' AND b = '5' THEN CASE WHEN strand = '-' THEN '5''_overlap' ELSE 'undefined' END
        WHEN a = '5' AND b = '5' THEN '5''_to' WHEN a = '5' AND b = 'in' THEN '5''_overlap' WHEN a = '5' AND b = '3' THEN 'included' WHEN a = '3' AND b = '3' THEN '3''_to' WHEN a = '3' AND b = '5' THEN 'included' ELSE '3''_overlap' END AS relation FROM c""")
def feature_relations(spark, d):
    pairs = annotate._overlapping(v_regions(spark, d), v_features(spark, d))
    return pairs.select("region_no", "feat_no", annotate.relation(*(F.col(c) for c in ("s", "e", "lo", "hi", "strand"))).alias("relation"))


SHORES = "greatest(lo - 2000, 1) AS sl, hi + 2000 AS sh, greatest(lo - 4000, 1) AS fl, hi + 4000 AS fh"


@query(f"""{FR}, c AS (SELECT r.region_no, r.s, r.e, f.feat_no, abs(f.lo - r.s) AS distance FROM regs r JOIN feats f ON r.chrom = f.chrom AND f.type = '1-URGENT'),
    n AS (SELECT region_no, min_by(feat_no, distance * 1000000000.0 + feat_no) AS feat_no FROM c GROUP BY region_no),
    x AS (SELECT n.region_no, n.feat_no, least(s, e) AS a, greatest(s, e) AS b, lo, hi, {SHORES} FROM n JOIN regs USING (region_no) JOIN feats USING (feat_no))
    SELECT region_no, feat_no, CASE WHEN a NOT BETWEEN fl AND fh AND b NOT BETWEEN fl AND fh THEN '-' WHEN a BETWEEN lo AND hi AND b BETWEEN lo AND hi THEN 'CpGI_core'
        WHEN (a BETWEEN lo AND hi AND b BETWEEN hi AND sh) OR (a BETWEEN sl AND lo AND b BETWEEN lo AND hi) THEN 'CpGI_coreshore' WHEN (a BETWEEN sl AND lo AND b BETWEEN sl AND lo) OR (a BETWEEN hi AND sh AND b BETWEEN hi AND sh) THEN 'CpGI_shore'
        WHEN (a BETWEEN fl AND sl AND b BETWEEN sl AND lo) OR (a BETWEEN hi AND sh AND b BETWEEN sh AND fh) THEN 'CpGI_shoreshelf' WHEN (a BETWEEN fl AND sl AND b BETWEEN fl AND sl) OR (a BETWEEN sh AND fh AND b BETWEEN sh AND fh) THEN 'CpGI_shelf' ELSE 'CpGI_shelfoverlap' END AS class FROM x""")
def island_classes(spark, d):
    islands = v_features(spark, d).where("type = '1-URGENT'")
    near = annotate.proximal(v_regions(spark, d), islands)
    return near.select("region_no", "feat_no", annotate.island_class(F.col("s"), F.col("e"), F.col("f_start"), F.col("f_end")).alias("class"))


@query(f"WITH {FEATURES} SELECT chrom, type, count(*) AS n FROM feats GROUP BY ALL")
def feature_type_counts(spark, d):
    return annotate.type_counts(v_features(spark, d))


@query(f"""{FR}, f AS (SELECT chrom, lo, hi FROM (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM feats) WHERE before IS NULL OR lo > before),
    c AS (SELECT r.*, (SELECT min(lo) FROM f WHERE f.chrom = r.chrom AND f.hi >= r.s) AS lo FROM regs r), x AS (SELECT c.*, f.hi, c.region_no % 2 = 0 AS rev FROM c LEFT JOIN f ON f.chrom = c.chrom AND f.lo = c.lo)
    SELECT class, count(*) AS n FROM (SELECT CASE WHEN lo IS NULL OR e < lo THEN 'unmapped' WHEN s = lo THEN '5prime_end' WHEN e = hi + CASE WHEN rev THEN 2 ELSE 0 END THEN '3prime_end' WHEN s > lo AND e < hi THEN 'internal'
        WHEN (lo > s AND lo < e) OR (hi > s AND hi < e) THEN 'on_join' ELSE 'unmapped' END AS class FROM x) GROUP BY class""")
def fragment_classes(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    apart = v_features(spark, d).withColumn("before", F.max("end").over(order)).where("before is null or start > before")
    reads = v_regions(spark, d).select(F.col("region_no").alias("read_id"), "chrom", F.col("s").alias("start"), F.col("e").alias("end"), F.when(F.col("region_no") % 2 == 0, "-").otherwise("+").alias("strand"))
    return calling.classified(reads, apart).groupBy("class").agg(F.count("*").alias("n"))


# Sequences and reads.


@query(f"{READS} SELECT doc_id, len(regexp_extract_all(seq, 'CG')) AS n_cg, len(regexp_extract_all(seq, 'GA[CT]')) AS n_gay FROM reads")
def motif_counts(spark, d):
    return v_reads(spark, d).select("doc_id", seq_.motif_count(F.col("seq"), "CG").cast("bigint").alias("n_cg"), seq_.motif_count(F.col("seq"), "GAY").cast("bigint").alias("n_gay"))


@query(f"""{READS}, p AS (SELECT doc_id, unnest(string_split(seq, 'CG')) AS piece, generate_subscripts(string_split(seq, 'CG'), 1) AS k FROM reads),
    q AS (SELECT doc_id, k, sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY doc_id) AS n FROM p) SELECT doc_id, (upto - 1)::INT AS pos FROM q WHERE k < n""")
def motif_positions(spark, d):
    return v_reads(spark, d).select("doc_id", F.explode(seq_.motif_positions(F.col("seq"), "CG")).alias("pos"))


@query(f"{READS} SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM (SELECT doc_id, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM reads)")
def reverse_complements(spark, d):
    clean_ = F.regexp_replace("seq", "[^ACGT]", "")
    return v_reads(spark, d).select("doc_id", F.md5(seq_.reverse_complement(clean_).cast("binary")).alias("digest"))


@query(f"{READS} SELECT doc_id, {', '.join(f'''(length(seq) - length(replace(seq, '{b.upper()}', '')))::BIGINT AS {b}''' for b in 'acgt')} FROM reads")
def base_composition(spark, d):
    return v_reads(spark, d).select("doc_id", seq_.base_composition(F.col("seq")).alias("x")).select("doc_id", "x.a", "x.c", "x.g", "x.t")


CODONS = ", ".join(f"'{k}': '{v}'" for k, v in sorted(seq_.codon_table().items()))


@query(f"""WITH reads AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{AS_BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents), t AS (SELECT MAP {{{CODONS}}} AS codons),
    u AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS k FROM reads WHERE length(seq) > 0), s AS (SELECT doc_id, sum(((k - 1) % 57 + 1) * ascii(c)) % 10000 AS checksum FROM u GROUP BY ALL)
    SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(seq, '...'), lambda x: t.codons[x]), '')) AS digest, coalesce(checksum, 0)::BIGINT AS checksum FROM reads CROSS JOIN t LEFT JOIN s USING (doc_id)""")
def translated_reads(spark, d):
    clean_ = F.regexp_replace("seq", "[^ACGT]", "")
    return v_reads(spark, d).select("doc_id", F.md5(seq_.translated(clean_).cast("binary")).alias("digest"), seq_.gcg_checksum(clean_).alias("checksum"))


@query(f"""{READS}, g AS (SELECT doc_id::VARCHAR AS chrom, seq FROM reads WHERE length(seq) > 0), p AS (SELECT chrom, unnest(string_split(seq, 'CCGG')) AS piece, generate_subscripts(string_split(seq, 'CCGG'), 1) AS k FROM g),
    q AS (SELECT chrom, k, sum(length(piece) + 4) OVER (PARTITION BY chrom ORDER BY k) AS upto, max(k) OVER (PARTITION BY chrom) AS n FROM p), s AS (SELECT chrom, upto - 2 AS start FROM q WHERE k < n UNION SELECT chrom, 1 FROM g),
    f AS (SELECT chrom, start::INT AS start, coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start) - 1, length(seq))::INT AS stop, row_number() OVER (PARTITION BY chrom ORDER BY start) - 1 AS bin_id FROM s JOIN g USING (chrom))
    SELECT chrom, bin_id, start, stop AS "end" FROM f""")
def restriction_fragments(spark, d):
    genome = v_reads(spark, d).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    lengths = genome.where("length(seq) > 0").select("chrom", F.length("seq").alias("length"))
    return bins_.fragments(bins_.site_positions(bins_.chunked(genome), ["C^CGG"]), lengths)


@query(f"""{READS}, h AS (SELECT doc_id, seq, strpos(seq, 'AGATCG') AS place FROM reads) SELECT doc_id, (CASE WHEN place > 0 THEN place - 1 ELSE length(seq) END)::INT AS trim_end FROM h""")
def trimmed_reads(spark, d):
    """One adaptor of the shortest length that is looked for: an exact hit cuts."""
    made = clean.cleaned(v_reads(spark, d), ["AGATCG"], clean.Trim(shortest_prefix=6, identity=100.0, repeats=-1))
    return made.select("doc_id", "trim_end")


@query()
def trimmed_reads_full(spark, d):
    made = clean.cleaned(v_reads(spark, d), ["AGATCGGAAGAGC", "CTGTCTCTTATA"], clean.Trim(shortest=20))
    return made.select("doc_id", "trim_start", "trim_end", "valid", F.size("hits").alias("n_hits"))


@query(f"""{READS}, p AS (SELECT a.doc_id, string_split(a.seq, '') AS x, string_split(b.seq, '') AS y, least(length(a.seq), length(b.seq)) AS n FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, (CASE WHEN n = 0 THEN 0 ELSE len(list_filter(list_zip(x[1:n], y[1:n]), lambda z: z[1] <> z[2] AND NOT (z[1] = 'T' AND z[2] = 'C'))) END)::INT AS mismatches FROM p""")
def bisulphite_mismatches(spark, d):
    r = v_reads(spark, d)
    both = r.join(r.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("other")), "doc_id")
    return both.select("doc_id", seq_.bisulphite_mismatches(F.col("seq"), F.col("other")).alias("mismatches"))




@query("""WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events) SELECT a.user_id, count(*) AS pairs, round(sum(a.value - b.value), 4) AS gap FROM x a JOIN x b ON a.user_id = b.user_id AND b.k = a.k + 1 GROUP BY a.user_id""")
def ordinal_pairs(spark, d):
    """Reads are paired by their running number; here, a user's events by theirs."""
    rows = sinks.numbered(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "k").select("user_id", "k", "value")
    nxt = rows.select("user_id", (F.col("k") - 1).alias("k"), F.col("value").alias("other"))
    return rows.join(nxt, ["user_id", "k"]).groupBy("user_id").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("value") - F.col("other")), 4).alias("gap"))


@query("""WITH m AS (SELECT l_suppkey % 120 AS tile, l_partkey % 50 AS x, l_linenumber AS y, l_orderkey * 8 + l_linenumber AS line_no, l_orderkey FROM lineitem), last AS (SELECT tile, x, y, max(line_no) AS line_no FROM m GROUP BY ALL),
    r AS (SELECT s_suppkey AS read_id, s_suppkey % 120 AS tile, s_suppkey % 50 AS x, s_nationkey % 7 + 1 AS y FROM supplier) SELECT read_id, line_no FROM r JOIN last USING (tile, x, y)""")
def read_mapping(spark, d):
    m = read(spark, d, "lineitem").select((F.col("l_suppkey") % 120).alias("tile"), (F.col("l_partkey") % 50).alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"))
    r = read(spark, d, "supplier").select(F.col("s_suppkey").alias("read_id"), (F.col("s_suppkey") % 120).alias("tile"), (F.col("s_suppkey") % 50).alias("x"), (F.col("s_nationkey") % 7 + 1).alias("y"))
    return calling.mapped(r, m).select("read_id", "line_no")


@query("SELECT s_suppkey, (16 * (1 + s_suppkey % 2 - 1) + 8 * (s_suppkey % 2) + s_suppkey % 8 + 1)::INT AS plain FROM supplier")
def tile_numbers(spark, d):
    k = F.col("s_suppkey")
    code = (1 + k % 2) * 1000 + (1 + k % 2) * 100 + k % 8 + 1
    return read(spark, d, "supplier").select("s_suppkey", calling.plain_tile(code, "3.2").alias("plain"))


# Parsers: lines are made from a table and read again.


@query(f"WITH {CALLS} SELECT chrom, pos, meth, count(*) AS n FROM calls GROUP BY ALL")
def parsed_calls(spark, d):
    lines = v_calls(spark, d).select(F.concat_ws("\t", "chrom", "pos", F.when(F.col("meth"), "+").otherwise("-")).alias("value"))
    return tables.calls(lines).groupBy("chrom", "pos", "meth").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber::VARCHAR AS chrom, (l_partkey + 1 - CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::INT AS pos, sum(l_quantity)::BIGINT AS n_meth, sum(l_suppkey % 4)::BIGINT AS n_unmeth FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def parsed_count_list(spark, d):
    x = read(spark, d, "lineitem")
    line = F.concat_ws(" ", "l_linenumber", F.col("l_partkey") + 1, F.when(F.col("l_linestatus") == "F", "-").otherwise("+"), F.when(F.col("l_returnflag") == "N", "CHH").otherwise("CGA"), F.col("l_quantity").cast("int"), F.col("l_suppkey") % 4)
    rows = tables.count_list(x.select(line.alias("value")))
    return rows.groupBy("chrom", "pos").agg(F.coalesce(F.sum(F.when(F.col("meth"), F.col("n"))), F.lit(0)).alias("n_meth"), F.coalesce(F.sum(F.when(~F.col("meth"), F.col("n"))), F.lit(0)).alias("n_unmeth"))


@query(f"""WITH {FEATURES} SELECT chrom, 't' || (feat_no // 3) AS id, min(lo) AS start, max(hi) AS "end", count(*)::INT AS n_segments FROM feats WHERE type <> '5-LOW' GROUP BY ALL""")
def parsed_gtf(spark, d):
    f = v_features(spark, d)
    attrs = F.concat(F.lit('gene_type "'), F.when(F.col("type") == "5-LOW", "lincRNA").otherwise("protein_coding"), F.lit('"; transcript_id "t'), F.floor(F.col("feat_no") / 3), F.lit('";'))
    lines = f.select(F.concat_ws("\t", "chrom", F.lit("x"), F.lit("exon"), "start", "end", F.lit("."), "strand", F.lit("."), attrs).alias("value"), F.col("feat_no").alias("line_no"))
    return tables.gtf(lines).select("chrom", "id", "start", "end", F.size("segments").alias("n_segments"))


@query(f"""WITH {FEATURES} SELECT c.feat_no, p.feat_no AS parent_no FROM feats c JOIN feats p ON p.chrom = c.chrom AND p.feat_no = c.feat_no - c.feat_no % 4 WHERE c.feat_no % 4 > 0""")
def parsed_gff3(spark, d):
    f = v_features(spark, d)
    parent = F.col("feat_no") - F.col("feat_no") % 4
    attrs = F.concat(F.lit("ID=f"), F.col("feat_no"), F.lit(";Name=n%20"), F.col("feat_no"), F.when(F.col("feat_no") % 4 > 0, F.concat(F.lit(";Parent=f"), parent)).otherwise(""))
    lines = f.select(F.concat_ws("\t", "chrom", F.lit("."), F.when(F.col("feat_no") % 4 > 0, "mRNA").otherwise("gene"), "start", "end", F.lit("."), "strand", F.lit("."), attrs).alias("value"), F.col("feat_no").alias("line_no"))
    kin = tables.with_parents(tables.gff3(lines))
    return kin.select("feat_no", F.substring("parent_id", 2, 20).cast("bigint").alias("parent_no"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    made = live_counts.event_windows(read(spark, d, "events"))
    return made.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' END AS sign, string_split(o_orderpriority, 'r')[1] AS head FROM orders")
def converter_columns(spark, d):
    o = read(spark, d, "orders")
    context = F.when(F.col("o_orderstatus") == "F", "Z").when(F.col("o_orderstatus") == "O", "z").otherwise("x")
    return o.select(F.col("o_orderkey").alias("k"), seq_.extractor_sign(context).alias("sign"), seq_.before_first_r(F.col("o_orderpriority")).alias("head"))


@query("SELECT l_orderkey // 4 AS record, string_agg(l_orderkey || ':' || n, '~' ORDER BY l_orderkey) AS value FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def four_to_one(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return sinks.four_to_one(x.select((F.col("l_orderkey") + 1).alias("line_no"), F.concat_ws(":", "l_orderkey", "n").alias("value")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return window_fisher(spark, d)


# The other entries need the views above.
from . import calling_queries, file_queries  # noqa: E402, F401

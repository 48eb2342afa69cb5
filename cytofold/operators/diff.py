"""Comparing samples and groups over bins: from dense counts with used (see counts.with_mask) to typed statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import ship
from ..functions.sequences import proportion
from ..functions.stats import chi_square_p, f_p, fisher_point, pruned_chi_square

BIN = ("chrom", "bin_id")
LEAST_EXPECTED = 5.0
#: Output modes by their letters (fixed values).
MODES = {"p": "pairs, or chi-square where counts allow", "P": "pairs", "x": "chi-square, else pairs", "X": "chi-square with pruning", "q": "smallest p", "Q": "all pairs by p", "a": "analysis of variance", "D": "deviation", "l": "list", "L": "list of hit bins"}


def pairs(counts: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Each two used samples of a bin: point probability, proportions, which is greater and by which factor.

    The pairs of one bin are as many as its samples' pairs, which the list of samples bounds.
    """
    kept = counts.where("used").select(*BIN, F.struct("sample_no", "meth", "unmeth").alias("s"))
    lists = kept.groupBy(*BIN).agg(F.array_sort(F.collect_list("s")).alias("all"))
    rows = lists.select(*BIN, F.posexplode("all").alias("i", "a"), "all").select(*BIN, "a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    rows = rows.select(*BIN, F.col("a.sample_no").alias("sample_1"), F.col("b.sample_no").alias("sample_2"), *(F.col(f"{s}.{c}").alias(f"{c}_{i}") for i, s in ((1, "a"), (2, "b")) for c in ("meth", "unmeth")))
    if drop_empty:
        rows = rows.where("meth_1 + unmeth_1 > 0 and meth_2 + unmeth_2 > 0")
    rows = rows.withColumn("p", fisher_point(F.col("meth_1"), F.col("unmeth_1"), F.col("meth_2"), F.col("unmeth_2")))
    rows = rows.withColumn("prop_1", proportion(F.col("meth_1"), F.col("unmeth_1"))).withColumn("prop_2", proportion(F.col("meth_2"), F.col("unmeth_2")))
    return rows.withColumn("fold", fold(F.col("prop_1"), F.col("prop_2"))).withColumn("greater", greater(F.col("prop_1"), F.col("prop_2"), F.col("sample_1"), F.col("sample_2")))


def fold(a: Column, b: Column) -> Column:
    """Larger by smaller proportion; null if either isn't above 0."""
    return F.when((a > 0) & (b > 0), F.try_divide(F.greatest(a, b), F.least(a, b)))


def greater(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    """The sample with the larger proportion; = on ties, - if either is empty."""
    return F.when((a < 0) | (b < 0), "-").when(a == b, "=").when(a > b, name_a.cast("string")).otherwise(name_b.cast("string"))


def expected(counts: DataFrame) -> DataFrame:
    """By bin over all samples: pooled share of methylated counts, the least expected count, hits."""
    sums = counts.groupBy(*BIN).agg(F.sum("meth").alias("m"), F.sum("unmeth").alias("u"), F.min(F.col("meth") + F.col("unmeth")).alias("least"))
    share = F.try_divide(F.col("m").cast("double"), (F.col("m") + F.col("u")).cast("double"))
    return sums.select(*BIN, share.alias("share"), F.coalesce(F.least(share, 1 - share) * F.col("least"), F.lit(0.0)).alias("least_expected"), (F.col("m") + F.col("u")).alias("hits"))


def chi_square(counts: DataFrame) -> DataFrame:
    """(chi, df, p) by bin: expected from the share of all samples, terms from the used ones."""
    ship(counts.sparkSession)
    n = F.col("meth") + F.col("unmeth")
    whole = Window.partitionBy(*BIN)
    share = F.try_divide(F.sum("meth").over(whole).cast("double"), F.sum(n).over(whole).cast("double"))
    e = counts.withColumn("_e1", n * share).withColumn("_e2", n * (1 - share)).where("used")
    term = lambda c, x: F.coalesce(F.try_divide(F.pow(F.col(c) - F.col(x), 2), F.col(x)), F.lit(0.0))
    made = e.groupBy(*BIN).agg(F.sum(term("meth", "_e1") + term("unmeth", "_e2")).alias("chi"), (F.count("*") - 1).cast("int").alias("df"))
    return made.withColumn("p", F.when((F.col("df") > 0) & (F.col("chi") > 0), chi_square_p("chi", "df")).otherwise(1.0))


@F.pandas_udf(T.StructType([T.StructField("chi", T.DoubleType()), T.StructField("df", T.IntegerType()), T.StructField("samples", T.IntegerType())]))
def _pruned(meth: pd.Series, unmeth: pd.Series, used: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pruned_chi_square(m, u, x) for m, u, x in zip(meth, unmeth, used, strict=True)], columns=["chi", "df", "samples"])


def chi_square_pruned(counts: DataFrame) -> DataFrame:
    """(chi, df, p, samples) by bin with samples of too small expected counts dropped step by step; p is 1 if under 2 remain."""
    ship(counts.sparkSession)
    lists = counts.groupBy(*BIN).agg(F.array_sort(F.collect_list(F.struct("sample_no", "meth", "unmeth", "used"))).alias("s"))
    made = lists.select(*BIN, _pruned("s.meth", "s.unmeth", "s.used").alias("x")).select(*BIN, "x.*")
    return made.withColumn("p", F.when((F.col("df") > 0) & (F.col("chi") > 0), chi_square_p("chi", "df")).otherwise(1.0))


def best(counts: DataFrame) -> DataFrame:
    """(kind, p, df) by bin: chi-square if every expected count is at least 5, else the smallest pair probability; df: the pairs."""
    chi = chi_square(counts).join(expected(counts).select(*BIN, "least_expected"), list(BIN))
    two = pairs(counts).groupBy(*BIN).agg(F.min("p").alias("fisher"), F.count("*").cast("int").alias("n_pairs"))
    rows = chi.join(two, list(BIN), "left")
    use = (F.col("least_expected") >= LEAST_EXPECTED) & (F.col("chi") > 0) & (F.col("df") > 0)
    return rows.select(*BIN, F.when(use, "chi").otherwise("pair").alias("kind"), F.when(use, F.col("p")).otherwise(F.coalesce("fisher", F.lit(1.0))).alias("p"), F.when(use, F.col("df")).otherwise(F.coalesce("n_pairs", F.lit(0))).alias("df"))


def all_pairs(counts: DataFrame) -> DataFrame:
    """By bin the pair probabilities in growing order, as one array."""
    return pairs(counts).groupBy(*BIN).agg(F.array_sort(F.collect_list(F.round("p", 9))).alias("p_values"))


def anova(counts: DataFrame) -> DataFrame:
    """One-way analysis of variance of the used samples' proportions by group: f, df1, df2, p, group counts and the group with most methylation.

    Needs two groups with two samples each; other groups join the sums. Without variance, or between no groups, f is null.
    """
    ship(counts.sparkSession)
    x = counts.where("used and meth + unmeth > 0").withColumn("x", F.col("meth") / (F.col("meth") + F.col("unmeth")))
    groups = x.groupBy(*BIN, "group_no").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("meth").alias("m"), F.sum(F.col("meth") + F.col("unmeth")).alias("t"))
    groups = groups.withColumn("pooled", F.col("m") / F.col("t"))
    info = F.array_sort(F.collect_list(F.struct("group_no", "n", "pooled"))).alias("groups")
    top = F.min_by("group_no", F.struct(-F.col("pooled"), F.col("group_no"))).alias("greater")
    made = groups.groupBy(*BIN).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count_if(F.col("n") >= 2).alias("full"), info, top).where("full >= 2")
    total, treat = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("between") - F.col("s") * F.col("s") / F.col("n")
    made = made.withColumn("ss_total", total).withColumn("ss_treat", treat).withColumn("df1", (F.col("k") - 1).cast("int")).withColumn("df2", (F.col("n") - F.col("k")).cast("int"))
    ok = (F.col("ss_total") > 1e-12) & (F.col("ss_treat") > 1e-12) & (F.col("df2") > 0)
    made = made.withColumn("f", F.when(ok, F.try_divide(F.col("ss_treat") * F.col("df2"), (F.col("ss_total") - F.col("ss_treat")) * F.col("df1"))))
    return made.withColumn("p", F.when(F.col("f").isNotNull(), f_p("f", "df1", "df2"))).select(*BIN, "ss_total", "ss_treat", "df1", "df2", "f", "p", "greater", "groups")


def anova_detail(counts: DataFrame, anova_rows: DataFrame) -> DataFrame:
    """Long form of the detailed analysis: a row for each used sample of an analysed bin with its proportion and its group's."""
    x = counts.where("used and meth + unmeth > 0").select(*BIN, "sample_no", "group_no", "meth", "unmeth", proportion(F.col("meth"), F.col("unmeth")).alias("prop"))
    pooled = x.groupBy(*BIN, "group_no").agg(proportion(F.sum("meth"), F.sum("unmeth")).alias("group_prop"), F.count("*").alias("group_n"))
    return x.join(pooled, [*BIN, "group_no"]).join(anova_rows.select(*BIN, "f", "p"), list(BIN))


def pivoted(detail: DataFrame, samples: list[int], value: str = "prop") -> DataFrame:
    """Samples as columns s<no>, - where a bin lacks one."""
    wide = detail.groupBy(*BIN).pivot("sample_no", samples).agg(F.first(F.round(value, 6)))
    return wide.select(*BIN, *(F.coalesce(F.format_string("%.6f", F.col(str(s))), F.lit("-")).alias(f"s{s}") for s in samples))


def deviation(counts: DataFrame) -> DataFrame:
    """Mean, sample deviation and number of the used samples' proportions; two samples at least."""
    x = counts.where("used and meth + unmeth > 0").withColumn("x", F.col("meth") / (F.col("meth") + F.col("unmeth")))
    return x.groupBy(*BIN).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("*").cast("int").alias("n")).where("n >= 2")


def pooled(counts: DataFrame) -> DataFrame:
    """By bin and group the pooled proportion of the used samples, -1 without counts."""
    used = F.col("used")
    return counts.groupBy(*BIN, "group_no").agg(proportion(F.coalesce(F.sum(F.when(used, F.col("meth"))), F.lit(0)), F.coalesce(F.sum(F.when(used, F.col("unmeth"))), F.lit(0))).alias("prop"))


def listing(counts: DataFrame, only_hit: bool = False) -> DataFrame:
    """By bin one text, m+/u- for each sample in order, - for samples that aren't used."""
    cell = F.when(F.col("used"), F.concat(F.col("meth").cast("string"), F.lit("+/"), F.col("unmeth").cast("string"), F.lit("-"))).otherwise("-")
    made = counts.groupBy(*BIN).agg(F.concat_ws("\t", F.transform(F.array_sort(F.collect_list(F.struct("sample_no", cell.alias("c")))), lambda s: s["c"])).alias("cells"), F.sum(F.col("meth") + F.col("unmeth")).alias("hits"), F.count_if("used").alias("n_used"))
    return (made.where("hits > 0 and n_used > 0") if only_hit else made).select(*BIN, "cells")


def reduced_test(counts: DataFrame, bins: DataFrame, first: int, second: int) -> DataFrame:
    """Two samples' bins of 5 CpGs at least, with counts of either kind in both, whose ratios meth / unmeth differ by a factor of 2."""
    a, b = (counts.where(F.col("sample_no") == s).select(*BIN, F.col("meth").alias(f"meth_{i}"), F.col("unmeth").alias(f"unmeth_{i}")) for i, s in ((1, first), (2, second)))
    rows = a.join(b, list(BIN)).join(bins.where("n_cpg >= 5").select(*BIN), list(BIN), "left_semi").where("meth_1 > 0 and meth_2 > 0 and unmeth_1 > 0 and unmeth_2 > 0")
    rows = rows.withColumn("ratio", (F.col("meth_1") / F.col("unmeth_1")) / (F.col("meth_2") / F.col("unmeth_2")))
    return rows.where("ratio >= 2 or ratio <= 0.5").withColumn("p", fisher_point(F.col("meth_1"), F.col("unmeth_1"), F.col("meth_2"), F.col("unmeth_2")))


def bin_stats(counts: DataFrame, mode: str = "p", least_cpgs: int = 5, windows: bool = False) -> DataFrame:
    """The statistics of an output mode (MODES). Pair tests of other bins than windows need least_cpgs CpGs (column n_cpg)."""
    fit = counts if windows or "n_cpg" not in counts.columns else counts.where(F.col("n_cpg") >= least_cpgs)
    if mode in ("p", "x"):
        by_chi = expected(counts).where(F.col("least_expected") >= LEAST_EXPECTED).select(*BIN)
        chi = (chi_square_pruned if mode == "p" else chi_square)(counts.join(by_chi, list(BIN), "left_semi"))
        two = pairs(fit.join(by_chi, list(BIN), "left_anti"))
        return chi.select(*BIN, F.lit("chi").alias("kind"), F.lit(None).cast("int").alias("sample_1"), F.lit(None).cast("int").alias("sample_2"), "df", "p").unionByName(two.select(*BIN, F.lit("pair").alias("kind"), "sample_1", "sample_2", F.lit(1).alias("df"), "p"))
    made = {"P": lambda: pairs(fit), "X": lambda: chi_square_pruned(counts), "q": lambda: best(fit), "Q": lambda: all_pairs(fit), "a": lambda: anova(counts), "D": lambda: deviation(counts), "l": lambda: listing(counts), "L": lambda: listing(counts, True)}
    return made[mode]()

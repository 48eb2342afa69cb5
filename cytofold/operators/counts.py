"""Methylation counts of bins and samples, the validity mask and the bin gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sequences import proportion
from ..functions.stats import fixed
from .intervals import apart, beside, point_in_interval
from .sizes import small


def methylated(n: str = "n") -> list[Column]:
    one = F.col(n) if n else F.lit(1)
    return [F.sum(F.when(F.col("meth"), one).otherwise(0)).cast("bigint").alias("meth"), F.sum(F.when(~F.col("meth"), one).otherwise(0)).cast("bigint").alias("unmeth")]


def window_counts(calls: DataFrame, width: int, n: str = "") -> DataFrame:
    """(chrom, bin_id, sample_no, group_no, meth, unmeth) by windows of one width: no join, one shuffle of sums."""
    return calls.withColumn("bin_id", F.floor((F.col("pos") - 1) / width)).groupBy("chrom", "bin_id", "sample_no", "group_no").agg(*methylated(n))


def bin_counts(calls: DataFrame, bins: DataFrame, n: str = "", first_hit_back: bool = False) -> DataFrame:
    """Counts by bins that may overlap: a call goes to the first bin (by bin_id) that holds it.

    Calls are added up by place before the join. first_hit_back: a call marked first_3p that stands at a bin's start
    belongs to the place before.
    """
    if first_hit_back:
        starts = bins.select(F.col("chrom").alias("_c"), F.col("start").alias("_s")).distinct()
        calls = calls.join(starts, (calls.chrom == F.col("_c")) & (calls.pos == F.col("_s")), "left")
        calls = calls.withColumn("pos", F.when(F.col("first_3p") & F.col("_s").isNotNull(), F.col("pos") - 1).otherwise(F.col("pos"))).drop("_c", "_s")
    sums = calls.groupBy("chrom", "pos", "sample_no", "group_no").agg(*methylated(n))
    found = point_in_interval(sums, first_bins(bins), known_apart=True)
    return found.groupBy("chrom", "bin_id", "sample_no", "group_no").agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))


def first_bins(bins: DataFrame) -> DataFrame:
    """(chrom, bin_id, start, end): the stretches of which a bin is the first (by bin_id) that holds them; they share no place.

    Bins are fewer than calls, so they are cut, not the calls joined with each of them.
    """
    real = bins.where("start <= end").select("chrom", "bin_id", "start", "end")
    if apart(real):
        return real
    edges = real.select("chrom", F.col("start").alias("_cut")).union(real.select("chrom", F.col("end") + 1)).distinct()
    until = beside(edges.withColumn("_cut_end", F.col("_cut")), "_cut", "_next", True, start="_cut", end="_cut_end").where("_next is not null").select("chrom", "_cut", "_next")
    held = point_in_interval(until, real, pos="_cut").groupBy("chrom", "_cut", "_next").agg(F.min("bin_id").alias("bin_id"))
    return held.select("chrom", "bin_id", F.col("_cut").alias("start"), (F.col("_next") - 1).alias("end"))


def dense(counts: DataFrame, bins: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each bin and sample, zeros included; samples is one short list."""
    every = bins.select("chrom", "bin_id").crossJoin(small(samples.select("sample_no", "group_no")))
    found = counts.select("chrom", "bin_id", "sample_no", "meth", "unmeth")
    return every.join(found, ["chrom", "bin_id", "sample_no"], "left").na.fill(0, ["meth", "unmeth"])


def missed(calls: DataFrame, bins: DataFrame) -> DataFrame:
    """Calls outside all bins."""
    return point_in_interval(calls, bins.select("chrom", "start", "end"), how="left_anti")


def without_excluded(calls: DataFrame, excluded: DataFrame) -> DataFrame:
    return point_in_interval(calls, excluded.select("chrom", "start", "end"), how="left_anti")


def cpg_counts(calls: DataFrame, bin_cpgs: DataFrame, bins: DataFrame, merge_strands: bool = False, n: str = "") -> DataFrame:
    """(chrom, bin_id, sample_no, slot, pos, meth, unmeth): slots count a bin's CpGs from 1; slot 0 holds calls at no CpG.

    merge_strands: a call one base behind a CpG belongs to it.
    """
    order = Window.partitionBy("chrom", "bin_id").orderBy("pos")
    slots = point_in_interval(bin_cpgs.select("chrom", "pos"), bins.select("chrom", "bin_id", "start", "end")).withColumn("slot", F.row_number().over(order)).select(F.col("chrom").alias("_c"), F.col("bin_id").alias("_b"), F.col("pos").alias("_p"), "slot")
    sums = calls.groupBy("chrom", "pos", "sample_no").agg(*methylated(n))
    placed = point_in_interval(sums, bins.select("chrom", "bin_id", "start", "end")).drop("start", "end")
    if merge_strands:
        # One table of the places at and behind CpGs, the CpG's own first, so that calls move once.
        near = F.explode(F.array(*(F.struct(F.lit(k).alias("behind"), (F.col("_p") + k).alias("at")) for k in (0, 1)))).alias("_n")
        best = slots.select("_c", "_b", "_p", "slot", near).groupBy("_c", "_b", F.col("_n.at").alias("_at")).agg(F.min(F.struct("_n.behind", "_p", "slot")).alias("_s"))
        slots = best.select("_c", "_b", "_at", "_s._p", "_s.slot")
    else:
        slots = slots.withColumn("_at", F.col("_p"))
    hit = placed.join(slots, (placed.chrom == F.col("_c")) & (placed.bin_id == F.col("_b")) & (placed.pos == F.col("_at")), "left").drop("_c", "_b", "_at")
    return hit.groupBy("chrom", "bin_id", "sample_no", F.coalesce("slot", F.lit(0)).alias("slot"), F.coalesce("_p", F.lit(0)).alias("pos")).agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))


@dataclass(frozen=True)
class Limits:
    """Checks of a sample's counts in a bin; None: not made. In the order in which they are made."""

    least_hits: int | None = None  # meth + unmeth
    least_per_cpg: float | None = None
    most_per_cpg: float | None = None
    least_proportion: float | None = None
    over_cpgs: int | None = None  # the bin must have more
    least_samples: int | None = None  # with hits
    least_cpg_hits: int | None = None  # CpGs with least_hits; needs the column cpgs_hit; stands for least_hits
    fold: float | None = None
    compat: bool = False  # as the chi-square paths of the tools: only the last two


def with_mask(counts: DataFrame, limits: Limits) -> DataFrame:
    """dense counts with n_cpg, plus used: whether the sample passes the checks, and failed: the first check it fails (0: none)."""
    bin_ = Window.partitionBy("chrom", "bin_id")
    hits = F.col("meth") + F.col("unmeth")
    per_cpg = F.try_divide(hits.cast("double"), F.col("n_cpg").cast("double"))
    share = proportion(F.col("meth"), F.col("unmeth"))
    rules: list[tuple[int, Column]] = []
    if limits.least_hits is not None and limits.least_hits > 0 and limits.least_cpg_hits is None:
        rules.append((1, hits < limits.least_hits))
    if limits.least_per_cpg is not None:
        rules.append((2, (F.col("n_cpg") <= 0) | (per_cpg < limits.least_per_cpg)))
    if limits.most_per_cpg is not None:
        rules.append((3, (F.col("n_cpg") <= 0) | (per_cpg > limits.most_per_cpg)))
    if limits.least_proportion is not None:
        rules.append((4, (hits == 0) | (share < limits.least_proportion)))
    if limits.over_cpgs is not None:
        rules.append((5, F.col("n_cpg") <= limits.over_cpgs))
    if limits.least_samples is not None:
        rules.append((6, F.sum(F.when(hits > 0, 1).otherwise(0)).over(bin_) < limits.least_samples))
    if limits.least_cpg_hits is not None:
        rules.append((7, (F.col("cpgs_hit") < limits.least_cpg_hits) & (F.col("cpgs_hit") < F.col("n_cpg"))))
    if limits.fold is not None:
        real = F.when(hits > 0, share)
        low, high = F.min(real).over(bin_), F.max(real).over(bin_)
        ratio = F.try_divide(high, low)
        passes = (low == 0) | F.when(F.lit(limits.fold > 1), ratio >= limits.fold).otherwise(F.lit(limits.fold > 0) & (ratio <= limits.fold))
        rules.append((8, ~F.coalesce(passes, F.lit(False))))
    if limits.compat:
        rules = [r for r in rules if r[0] >= 7]
    failed = F.lit(0)
    for bit, rule in reversed(rules):
        failed = F.when(rule, bit).otherwise(failed)
    return counts.withColumn("failed", failed).withColumn("used", F.col("failed") == 0)


def cpg_percent(by_cpg: DataFrame, sample: int = 1) -> DataFrame:
    """(chrom, bin_id, slot, place, percent) of one sample's cpg_counts: methylated percent to two places, - without counts; slot 0 is Stray."""
    n = F.col("meth") + F.col("unmeth")
    place = F.when(F.col("slot") == 0, "Stray").otherwise(F.col("pos").cast("string"))
    share = F.coalesce(fixed(F.try_divide(100 * F.col("meth").cast("double"), n.cast("double")), 2), F.lit("-"))
    return by_cpg.where(F.col("sample_no") == sample).select("chrom", "bin_id", "slot", place.alias("place"), F.when(n > 0, share).otherwise("-").alias("percent"))


def with_cpg_hits(counts: DataFrame, by_cpg: DataFrame, least_hits: int = 1) -> DataFrame:
    """counts plus cpgs_hit: the sample's CpGs in the bin (see cpg_counts) with so many hits."""
    hit = by_cpg.where((F.col("slot") > 0) & (F.col("meth") + F.col("unmeth") >= least_hits)).groupBy("chrom", "bin_id", "sample_no").agg(F.count("*").cast("int").alias("cpgs_hit"))
    return counts.join(hit, ["chrom", "bin_id", "sample_no"], "left").na.fill(0, ["cpgs_hit"])


def bin_gate(stats: DataFrame, least_cpgs: int = 0, least_hits: int = 1, most_p: float = 1.0, least_samples: int = 2) -> DataFrame:
    """Bins (n_cpg, hits, p, df) that are shown: windows without CpGs pass, others need all of the limits."""
    fits = (F.col("n_cpg") >= least_cpgs) & (F.col("hits") >= least_hits) & (F.col("p") <= most_p) & (F.col("df") + 1 >= least_samples)
    return stats.where((F.col("n_cpg") == 0) | fits)


def totals(counts: DataFrame) -> DataFrame:
    """By chromosome and in all (chrom null): bins with hits, meth, unmeth."""
    hit = counts.groupBy("chrom", "bin_id").agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))
    return hit.rollup("chrom").agg(F.grouping("chrom").cast("int").alias("all_chroms"), F.count("*").alias("bins"), F.count_if(F.col("meth") + F.col("unmeth") > 0).alias("bins_hit"), F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))


def same_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bins of two tables (chrom, start, end, …) by equal bounds; side says which table a bin is missing in."""
    x, y = a.alias("a"), b.alias("b")
    on = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
    side = F.when(F.col("a.chrom").isNull(), "first").when(F.col("b.chrom").isNull(), "second").otherwise("none")
    return x.join(y, on, "full").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("chrom", "start", "end")), side.alias("missing_in"), *(F.col(f"a.{c}").alias(f"{c}_1") for c in a.columns if c not in ("chrom", "start", "end")), *(F.col(f"b.{c}").alias(f"{c}_2") for c in b.columns if c not in ("chrom", "start", "end")))

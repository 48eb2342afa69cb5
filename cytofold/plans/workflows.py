"""Whole analyses: comparing samples, cleaning reads, annotating regions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import annotate, bins as bins_, clean, counts as counts_, depth as depth_, diff


@dataclass(frozen=True)
class Comparison:
    """What a comparison of samples is told; see MODES for mode."""

    mode: str = "p"
    window: int | None = None  # fixed windows; else bins are given
    sites: tuple[str, ...] = ("C^CGG",)
    shortest: int = 40
    longest: int = 220
    least_cpgs: int = 1
    join_adjacent: bool = False
    most_p: float = 1.0
    least_samples: int = 2
    limits: counts_.Limits = field(default_factory=counts_.Limits)


def fragment_bins(chunks: DataFrame, lengths: DataFrame, how: Comparison) -> DataFrame:
    """Restriction fragments with CpG counts, pruned and, if asked for, joined."""
    from ..operators.intervals import merge_runs

    made = bins_.fragments(bins_.site_positions(chunks, list(how.sites)), lengths)
    made = bins_.with_cpgs(bins_.sized(made, how.shortest, how.longest), bins_.motif_table(chunks))
    made = bins_.with_least_cpgs(made, how.least_cpgs)
    if how.join_adjacent:
        made = merge_runs(made, sums=("n_cpg",)).withColumn("bin_id", F.col("start").cast("bigint"))
    return made


def compare(calls: DataFrame, samples: DataFrame, how: Comparison = Comparison(), bins: DataFrame | None = None) -> DataFrame:
    """Statistics of calls (chrom, pos, sample_no, group_no, meth) over windows or given bins (with n_cpg)."""
    if bins is None:
        if not how.window:
            raise ValueError("either windows or bins")
        counts = counts_.window_counts(calls, how.window)
        bins = counts.select("chrom", "bin_id").distinct().withColumn("n_cpg", F.lit(0))
    else:
        counts = counts_.bin_counts(calls, bins)
    dense = counts_.dense(counts, bins, samples).join(bins.select("chrom", "bin_id", "n_cpg"), ["chrom", "bin_id"])
    stats = diff.bin_stats(counts_.with_mask(dense, how.limits), how.mode, windows=how.window is not None)
    return stats.where(F.col("p") <= how.most_p) if "p" in stats.columns and how.most_p < 1 else stats


def depth(calls: DataFrame, cpgs: DataFrame, near: int = 0) -> dict[str, DataFrame]:
    rows = depth_.position_depth(calls, cpgs, near)
    return {"list": rows, "statistics": depth_.statistics(rows), "histogram": depth_.histogram(rows)}


def clean_reads(reads: DataFrame, adaptors: list[str], how: clean.Trim = clean.Trim(), mode: str = "trim") -> DataFrame:
    """reads (…, seq[, qual]) trimmed (trim), masked (fill) or with their hits (list)."""
    qual = "qual" if "qual" in reads.columns and how.quality is not None else None
    made = clean.cleaned(reads, adaptors, how, qual=qual)
    if mode == "list":
        return made
    kept = made.where("valid")
    if mode == "fill":
        return kept.withColumn("seq", clean.filled(F.col("seq"), F.col("trim_start"), F.col("trim_end")))
    cut = [("seq", "seq"), *([("qual", "qual")] if "qual" in reads.columns else [])]
    for c, _ in cut:
        kept = kept.withColumn(c, clean.trimmed(F.col(c), F.col("trim_start"), F.col("trim_end"), how.longest))
    return kept


def clean_pairs(first: DataFrame, second: DataFrame, adaptors: list[str], how: clean.Trim = clean.Trim()) -> DataFrame:
    """Both reads' spans, by read_no, where both are valid."""
    return clean.valid_pairs(*(clean.cleaned(x, adaptors, how) for x in (first, second)))


def annotate_regions(regions: DataFrame, genes: DataFrame, starts: DataFrame | None = None, islands: DataFrame | None = None, internal: bool = False, most: int = 0, keep_missed: bool = False) -> DataFrame:
    """regions with their nearest gene and, beside it, the gene's nearest start and island upstream."""
    made = annotate.nearest(regions, genes, internal, most, keep_missed)
    for name, others in (("tss", starts), ("island", islands)):
        if others is not None:
            near = annotate.upstream_of(genes, others).select(F.col("gene_no").alias("feat_no"), F.col("near_no").alias(f"{name}_no"), F.col("distance").alias(f"{name}_distance"))
            made = made.join(near, "feat_no", "left")
    return made

"""Intervals to count in: restriction fragments, fixed windows, user's bins, and what is done to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sequences import base_composition, motif_positions
from .intervals import beside, point_in_interval, with_runs
from .sizes import small


#: Pieces of a block that chunked() cuts first.
MANY = 16


def parse_site(text: str) -> tuple[str, int]:
    """C^CGG as (CCGG, 1): the site and how many of its bases lie before the cut."""
    return text.replace("^", "").upper(), max(text.find("^"), 0)


def chunked(genome: DataFrame, size: int = 1 << 20, overlap: int = 1 << 10) -> DataFrame:
    """(chrom, seq) as (chrom, chunk_start, seq): pieces of size bases plus overlap."""
    # In steps: a piece is looked for in its block of MANY pieces, and that in a larger one, not from the chromosome's start on.
    rows = genome.select("chrom", "seq", F.lit(0).alias("_from"), F.greatest(F.length("seq"), F.lit(1)).alias("_n"))
    for block in [*(b for b in (size * MANY * MANY, size * MANY) if b < 1 << 30), size]:
        at = F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(block))).alias("_at")
        rows = rows.select("chrom", "seq", "_from", "_n", at)
        rows = rows.select("chrom", F.expr(f"substring(seq, _at + 1, {block + overlap})").alias("seq"), (F.col("_from") + F.col("_at")).alias("_from"), F.least(F.col("_n") - F.col("_at"), F.lit(block)).alias("_n"))
    return rows.select("chrom", (F.col("_from") + 1).alias("chunk_start"), "seq", F.lit(size).alias("size"))


def site_positions(chunks: DataFrame, sites: list[str], skip_others: bool = False) -> DataFrame:
    """(chrom, pos, cut): 1-based starts of the sites' hits and the first base behind the cut, each cut once."""
    made = None
    for text in sites:
        motif, offset = parse_site(text)
        hits = chunks.select("chrom", "chunk_start", "size", F.explode(motif_positions(F.col("seq"), motif, skip_others)).alias("_p")).where("_p <= size")
        hits = hits.select("chrom", (F.col("chunk_start") + F.col("_p") - 1).cast("int").alias("pos"), (F.col("chunk_start") + F.col("_p") - 1 + offset).cast("int").alias("cut"))
        made = hits if made is None else made.union(hits)
    return made.groupBy("chrom", "cut").agg(F.min("pos").alias("pos")).select("chrom", "pos", "cut")


def motif_table(chunks: DataFrame, motif: str = "CG") -> DataFrame:
    """(chrom, pos) of each hit of a motif: CG for CpGs, C for all cytosines."""
    return chunks.select("chrom", "chunk_start", "size", F.explode(motif_positions(F.col("seq"), motif)).alias("_p")).where("_p <= size").select("chrom", (F.col("chunk_start") + F.col("_p") - 1).cast("int").alias("pos"))


def fragments(cuts: DataFrame, lengths: DataFrame, tail: bool = True) -> DataFrame:
    """(chrom, bin_id, start, end): from one cut to the next; the first starts at 1, the tail ends with the chromosome."""
    starts = lengths.select("chrom", F.lit(1).alias("start")).union(cuts.select("chrom", F.col("cut").alias("start"))).distinct()
    rows = beside(starts.select("chrom", F.col("start").cast("int").alias("start")), "start", "_next", True, end="start", number="bin_id").join(lengths.select("chrom", "length"), "chrom")
    rows = rows.withColumn("end", F.coalesce(F.col("_next") - 1, F.col("length")).cast("int"))
    return (rows if tail else rows.where("_next is not null")).where("start <= end").select("chrom", "bin_id", F.col("start").cast("int").alias("start"), "end")


def digest(chunks: DataFrame, lengths: DataFrame, sites: list[str], shortest: int = 40, longest: int = 220) -> DataFrame:
    """Size-selected fragments, (previous cut, cut] of four-base sites, as reduced genomes are made."""
    whole = [s for s in sites if len(parse_site(s)[0]) == 4]
    return sized(fragments(site_positions(chunks, whole), lengths), shortest, longest)


def with_cpgs(bins: DataFrame, cpgs: DataFrame, compat: bool = False) -> DataFrame:
    """Plus n_cpg: CpGs whose C lies in the bin; compat: one less in a chromosome's last bin, as the tools counted."""
    counted = point_in_interval(cpgs.select("chrom", "pos"), bins.select("chrom", "bin_id", "start", "end")).groupBy("chrom", "bin_id").agg(F.count("*").cast("int").alias("n_cpg"))
    made = bins.join(counted, ["chrom", "bin_id"], "left").withColumn("n_cpg", F.coalesce("n_cpg", F.lit(0)))
    if compat:
        last = bins.groupBy("chrom").agg(F.max("bin_id").alias("_last"))
        made = made.join(small(last), "chrom").withColumn("n_cpg", F.col("n_cpg") - F.when(F.col("bin_id") == F.col("_last"), 1).otherwise(0)).drop("_last")
    return made


def region_sequences(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """regions (chrom, start, end, …) with the bases under them, put together from all chunks that a region touches."""
    first = chunks.select("size").first()
    size = first["size"] if first else 1 << 30
    place = regions.where("start >= 1").select("chrom", "start", "end").distinct()
    low, high = (F.floor((F.col(c) - 1) / size) for c in ("start", "end"))
    keyed = place.select("chrom", "start", "end", F.explode(F.sequence(low, F.greatest(low, high))).alias("_n")).withColumn("_chunk", (F.col("_n") * size + 1).cast("int"))
    c = chunks.select(F.col("chrom").alias("_c"), F.col("chunk_start").alias("_s"), F.col("seq").alias("_seq"))
    both = keyed.join(c, (keyed.chrom == F.col("_c")) & (F.col("_chunk") == F.col("_s")))
    # Of each chunk the bases that no later chunk begins with; regions are joined back by their place.
    start, end = F.greatest("start", "_s"), F.least(F.col("end"), F.col("_s") + size - 1)
    pieces = both.select("chrom", "start", "end", F.struct("_s", F.substring("_seq", start - F.col("_s") + 1, end - start + 1).alias("_part")).alias("_piece"))
    whole = pieces.groupBy("chrom", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_piece")), lambda x: x["_part"]), "").alias("seq"))
    kept = [c for c in regions.columns if c != "seq"]
    return regions.select(*kept).join(whole, ["chrom", "start", "end"]).select(*kept, "seq")


def composition(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbers of bases a, c, g, t and others over all regions, by chromosome."""
    x = region_sequences(regions, chunks).select("chrom", base_composition(F.col("seq")).alias("x"))
    return x.groupBy("chrom").agg(*(F.sum(f"x.{b}").alias(b) for b in ("a", "c", "g", "t", "other")))


def windows(lengths: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_id, start, end): windows of one width over each chromosome."""
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / width)))
    return lengths.where("length > 0").select("chrom", ids.alias("bin_id")).select("chrom", "bin_id", (F.col("bin_id") * width + 1).cast("int").alias("start"), ((F.col("bin_id") + 1) * width).cast("int").alias("end"))


def window_of(pos: Column, width: int) -> Column:
    return F.floor((pos - 1) / width)


def user_bins(rows: DataFrame, chromosomes: DataFrame | None = None) -> DataFrame:
    """(chrom, bin_id, start, end) of rows chrom, start, end in the order line_no; fails on start > end and unknown chromosomes."""
    if chromosomes is not None:
        known = chromosomes.select("chrom", F.lit(True).alias("_known"))
        rows = rows.join(small(known), "chrom", "left")
        rows = rows.withColumn("chrom", F.when(F.col("_known"), F.col("chrom")).otherwise(F.raise_error(F.concat(F.lit("unknown chromosome "), F.col("chrom"))))).drop("_known")
    start = F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(F.raise_error(F.lit("a bin ends before it starts")))
    return rows.select("chrom", F.col("line_no").cast("bigint").alias("bin_id"), start.cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def sized(bins: DataFrame, shortest: int = 0, longest: int = 0) -> DataFrame:
    """Bins of the lengths, both included; no limit unless both are given."""
    return bins.where((F.col("end") - F.col("start") + 1).between(shortest, longest)) if shortest and longest else bins


def with_least_cpgs(bins: DataFrame, least: int = 1) -> DataFrame:
    return bins.where(F.col("n_cpg") >= least)


def amalgamated(bins: DataFrame, least: int, weight: str = "n_cpg") -> DataFrame:
    """One pass from left to right: a bin takes in its adjacent successor if one of them has too few CpGs and both together
    have enough; then the pass goes on behind it. (chrom, start, end, weight, merged)

    Where two neighbours can't be taken together the pass starts anew, whatever was before; in a stretch of bins that each
    could be taken together with the next one it takes the first with the second, the third with the fourth and so on.
    """
    rows = bins.select("chrom", F.col("start").cast("int"), F.col("end").cast("int"), F.col(weight).cast("bigint").alias(weight))

    def fits(prev: Column) -> Column:
        return (F.col("start") == prev["end"] + 1) & (F.least(prev[weight], F.col(weight)) < least) & (prev[weight] + F.col(weight) >= least)

    runs = with_runs(rows, fits, ("end", weight))
    pair = F.floor((F.row_number().over(Window.partitionBy("chrom", "_run").orderBy("start", "end")) - 1) / 2)
    made = runs.withColumn("_pair", pair).groupBy("chrom", "_run", "_pair")
    return made.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(weight).alias(weight), F.count("*").cast("int").alias("merged")).drop("_run", "_pair")

"""Regions against annotation: nearest genes, transcription starts, CpG islands, exons, relations.

Regions have region_no, chrom, s, e; features feat_no, chrom, start (lo), end (hi), strand and, where exon classes are
asked for, segments. Distances follow the strand; a feature first in the file wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .intervals import best_beyond, overlap_length, overlaps, point_in_interval

#: Relations of a region to a feature, in their order (fixed values).
RELATIONS = ("undefined", "5'_to", "5'_overlap", "internal", "included", "3'_overlap", "3'_to")
SHORE = 2000


def d3(s: Column, e: Column, lo: Column, hi: Column, strand: Column) -> Column:
    """From the region to the feature's start, the region lying upstream."""
    return F.when(strand == "-", s - hi + 1).otherwise(lo - e + 1)


def d5(s: Column, e: Column, lo: Column, hi: Column, strand: Column) -> Column:
    return F.when(strand == "-", hi - e + 1).otherwise(s - lo + 1)


def upstream_distance(s: Column, e: Column, lo: Column, hi: Column, strand: Column) -> Column:
    return F.when(strand == "-", lo - e + 1).otherwise(s - hi + 1)


def place(q: Column, lo: Column, hi: Column, strand: Column) -> Column:
    """Of one position: internal, 5 (before the feature's start) or 3."""
    five = F.when(strand == "-", q > hi).otherwise(q < lo)
    return F.when(q.between(lo, hi), "in").when(five, "5").otherwise("3")


def relation(s: Column, e: Column, lo: Column, hi: Column, strand: Column) -> Column:
    a, b = place(s, lo, hi, strand), place(e, lo, hi, strand)
    return (
        F.when((a == "in") & (b == "in"), "internal").when((a == "in") & (b == "3"), "3'_overlap")
        .when((a == "in") & (b == "5"), F.when(strand == "-", "5'_overlap").otherwise("undefined"))
        .when((a == "5") & (b == "5"), "5'_to").when((a == "5") & (b == "in"), "5'_overlap").when((a == "5") & (b == "3"), "included")
        .when((a == "3") & (b == "3"), "3'_to").when((a == "3") & (b == "5"), "included").otherwise("3'_overlap")
    )


def _overlapping(regions: DataFrame, features: DataFrame) -> DataFrame:
    a = regions.select("chrom", "region_no", F.col("s").alias("start"), F.col("e").alias("end"))
    b = features.select("chrom", "feat_no", "strand", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlaps(a, b).select("region_no", "feat_no", "strand", F.col("start").alias("s"), F.col("end").alias("e"), F.col("b_start").alias("lo"), F.col("b_end").alias("hi"))


def _named(best: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    return best.join(features.select("feat_no", *(F.col(c).alias(f"f_{c}") for c in columns)), "feat_no", "left")


def nearest(regions: DataFrame, features: DataFrame, internal: bool = False, most: int = 0, keep_missed: bool = False) -> DataFrame:
    """regions with feat_no, score, relation, f_start, f_end, f_strand of the nearest feature that a region lies upstream of.

    Regions upstream of a feature and ones over its start are candidates, with internal also those inside it or
    around it, whose score grows by the feature's length. The smallest score wins. most: the largest distance.
    keep_missed: regions without a feature stay, with nulls.
    """
    length = F.col("end") - F.col("start") + 1
    extra = length if internal else F.lit(0)
    plus, minus = features.where("strand <> '-'"), features.where("strand = '-'")
    ahead = best_beyond(regions.select("region_no", "chrom", "s", "e"), plus, "e", "start", F.col("start") + extra, True, into="ahead")
    both = best_beyond(ahead, minus, "s", "end", -F.col("end") + extra, False, into="behind")
    far = both.select("region_no", F.explode(F.array(
        F.struct((F.col("ahead.score") - F.col("e") + 1).alias("score"), F.col("ahead.feat_no").alias("feat_no")),
        F.struct((F.col("behind.score") + F.col("s") + 1).alias("score"), F.col("behind.feat_no").alias("feat_no")),
    )).alias("x")).select("region_no", "x.score", "x.feat_no").where("feat_no is not null")
    allowed = RELATIONS[: 6 if internal else 3]
    near = _overlapping(regions, features)
    args = [F.col(c) for c in ("s", "e", "lo", "hi", "strand")]
    near = near.where(relation(*args).isin(*allowed)).select("region_no", (d3(*args) + ((F.col("hi") - F.col("lo") + 1) if internal else 0)).cast("double").alias("score"), F.col("feat_no").cast("bigint").alias("feat_no"))
    every = far.unionByName(near)
    if most:
        span = features.select("feat_no", length.alias("_len"))
        every = every.join(span, "feat_no").where((F.col("score") - (F.col("_len") if internal else 0)) <= most).drop("_len")
    best = every.groupBy("region_no").agg(F.min(F.struct("score", "feat_no")).alias("b")).select("region_no", F.col("b.score").cast("bigint").alias("score"), "b.feat_no")
    made = _named(regions.join(best, "region_no", "left" if keep_missed else "inner"), features, ["start", "end", "strand"])
    return made.withColumn("relation", F.when(F.col("feat_no").isNotNull(), relation(F.col("s"), F.col("e"), F.col("f_start"), F.col("f_end"), F.col("f_strand"))))


def proximal(regions: DataFrame, features: DataFrame) -> DataFrame:
    """regions with the feature whose low end is nearest to the region's start, on either side, and the distance."""
    shifted = regions.select("region_no", "chrom", "s").withColumn("_s", F.col("s") - 1)
    up = best_beyond(shifted, features, "_s", "start", F.col("start"), True, into="up")
    both = best_beyond(up, features, "s", "start", -F.col("start"), False, into="down")
    ahead, back = F.col("up.score") - F.col("s"), F.col("s") + F.col("down.score")
    a, b = F.struct(ahead.cast("bigint").alias("distance"), F.col("up.feat_no").alias("feat_no")), F.struct(back.cast("bigint").alias("distance"), F.col("down.feat_no").alias("feat_no"))
    pick = F.least(F.when(F.col("up").isNotNull(), a), F.when(F.col("down").isNotNull(), b))
    return _named(regions.join(both.select("region_no", pick.alias("_p")), "region_no").select(*regions.columns, "_p.distance", "_p.feat_no").where("feat_no is not null"), features, ["start", "end"])


def fragment_based(regions: DataFrame, starts: DataFrame, islands: DataFrame) -> DataFrame:
    """regions that have both a nearest start and an island (the nearest one downstream, else the one closest by), with
    each one's span and its distance along the forward strand."""
    near = nearest(regions, starts).select("region_no", F.col("feat_no").alias("tss_no"), F.col("f_start").alias("tss_start"), F.col("f_end").alias("tss_end"))
    first = nearest(regions, islands).select("region_no", F.col("feat_no").alias("_a"), F.col("f_start").alias("_as"), F.col("f_end").alias("_ae"))
    other = proximal(regions, islands).select("region_no", F.col("feat_no").alias("_b"), F.col("f_start").alias("_bs"), F.col("f_end").alias("_be"))
    both = regions.join(near, "region_no").join(first, "region_no", "left").join(other, "region_no", "left")
    both = both.select(*regions.columns, "tss_no", "tss_start", "tss_end", F.coalesce("_a", "_b").alias("island_no"), F.coalesce("_as", "_bs").alias("island_start"), F.coalesce("_ae", "_be").alias("island_end")).where("island_no is not null")
    far = lambda hi: F.col("s") - F.col(hi) + 1
    return both.withColumn("tss_distance", far("tss_end")).withColumn("island_distance", far("island_end"))


def introns(segments: Column) -> Column:
    """Spans between a feature's segments, which are sorted by start."""
    gaps = F.transform(F.slice(segments, 2, 1 << 20), lambda s, i: F.struct((F.get(segments, i)["end"] + 1).alias("start"), (s["start"] - 1).alias("end")))
    return F.filter(gaps, lambda g: g["start"] <= g["end"])


def spliced_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"] + 1)


def segment_of(segments: Column, pos: Column) -> Column:
    """The place, from 0, of the first segment that holds a position; -1 if none does."""
    held = F.transform(segments, lambda g, i: F.when(pos.between(g["start"], g["end"]), i))
    return F.coalesce(F.array_min(held), F.lit(-1))


def introns_between(segments: Column, a: Column, b: Column) -> Column:
    """Introns from one position to another; 0 unless both are on segments."""
    i, j = segment_of(segments, a), segment_of(segments, b)
    return F.when((i >= 0) & (j >= 0), F.abs(i - j)).otherwise(0)


def introns_beyond(segments: Column, pos: Column, strand: Column, to_3p: bool = True) -> Column:
    """Introns from a position's segment to the feature's 3' (or 5') end; 0 off the segments."""
    i = segment_of(segments, pos)
    last = (strand != "-") if to_3p else (strand == "-")
    return F.when(i < 0, 0).when(last, F.size(segments) - 1 - i).otherwise(i)


def spliced_distance(segments: Column, pos: Column, strand: Column, from_3p: bool = False) -> Column:
    """Bases of the segments from the feature's 5' (or 3') end to a position, both included; -1 off the segments."""
    low = (strand == "-") if from_3p else (strand != "-")
    upto = F.transform(segments, lambda g: F.when(low, F.least(g["end"], pos) - g["start"] + 1).otherwise(g["end"] - F.greatest(g["start"], pos) + 1))
    bases = F.aggregate(upto, F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(x, F.lit(0)))
    return F.when(segment_of(segments, pos) < 0, F.lit(-1).cast("bigint")).otherwise(bases)


def same_splicing(outer: Column, inner: Column) -> Column:
    """Whether inner segments are spliced as the outer ones over their range: both ends on outer segments, introns alike."""
    first, last = F.get(inner, F.lit(0))["start"], F.get(inner, F.size(inner) - 1)["end"]
    bare = lambda x: F.transform(x, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))
    within = F.filter(bare(introns(outer)), lambda g: (g["end"] >= first) & (g["start"] <= last))
    return (segment_of(outer, first) >= 0) & (segment_of(outer, last) >= 0) & (within == bare(introns(inner)))


def feature_overlap(segments: Column, lo: Column, hi: Column, strand: Column, in_lo: Column, in_hi: Column) -> Column:
    """How a feature lies in another whose segments hold both its ends: abuts, 5p_abut, 3p_abut, included; else none."""
    five, three = F.when(strand == "-", in_hi == hi).otherwise(in_lo == lo), F.when(strand == "-", in_lo == lo).otherwise(in_hi == hi)
    held = (segment_of(segments, in_lo) >= 0) & (segment_of(segments, in_hi) >= 0) & in_lo.between(lo, hi) & in_hi.between(lo, hi)
    return F.when(~held, "none").when(five & three, "abuts").when(five, "5p_abut").when(three, "3p_abut").otherwise("included")


def upstream_of(genes: DataFrame, others: DataFrame) -> DataFrame:
    """genes (feat_no, chrom, start, end, strand) with the nearest other feature before their start on their strand: near_no, distance > 0."""
    g = genes.select(F.col("feat_no").alias("gene_no"), "chrom", "start", "end", "strand")
    plus = best_beyond(g.where("strand <> '-'"), others, "start", "end", -F.col("end"), False, into="b")
    minus = best_beyond(g.where("strand = '-'"), others, "end", "start", F.col("start"), True, into="b")
    a = plus.select("gene_no", F.col("b.feat_no").alias("near_no"), (F.col("start") + F.col("b.score") + 1).cast("bigint").alias("distance"))
    b = minus.select("gene_no", F.col("b.feat_no").alias("near_no"), (F.col("b.score") - F.col("end") + 1).cast("bigint").alias("distance"))
    return a.unionByName(b).where("near_no is not null")


def counted(regions: DataFrame, features: DataFrame, whole: bool = False) -> DataFrame:
    """regions with n_features, those that overlap them; whole: only features covered wholly."""
    pairs = _overlapping(regions, features)
    pairs = pairs.where("lo >= s and hi <= e") if whole else pairs
    return regions.join(pairs.groupBy("region_no").agg(F.count("*").alias("n_features")), "region_no", "left").na.fill(0, ["n_features"])


def overlap_lengths(regions: DataFrame, features: DataFrame) -> DataFrame:
    pairs = _overlapping(regions, features)
    return pairs.select("region_no", "feat_no", overlap_length(*(F.col(c) for c in ("s", "e", "lo", "hi"))).alias("overlap"))


def included(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer features with inner_no, the first inner one (by feat_no) that lies wholly in them."""
    points = inner.select("chrom", F.col("feat_no").alias("inner_no"), F.col("start").alias("pos"), F.col("end").alias("inner_end"))
    held = point_in_interval(points, outer.select("chrom", "feat_no", "start", "end")).where(F.col("inner_end") <= F.col("end"))
    return outer.join(held.groupBy("feat_no").agg(F.min("inner_no").alias("inner_no")), "feat_no")


def island_class(s: Column, e: Column, lo: Column, hi: Column) -> Column:
    """Core, shore and shelf of a CpG island; the ends may come in either order."""
    a, b = F.least(s, e), F.greatest(s, e)
    shore_lo, shore_hi = F.greatest(lo - SHORE, F.lit(1)), hi + SHORE
    shelf_lo, shelf_hi = F.greatest(lo - 2 * SHORE, F.lit(1)), hi + 2 * SHORE
    core = lambda x: x.between(lo, hi)
    low_shore, high_shore = (lambda x: x.between(shore_lo, lo)), (lambda x: x.between(hi, shore_hi))
    low_shelf, high_shelf = (lambda x: x.between(shelf_lo, shore_lo)), (lambda x: x.between(shore_hi, shelf_hi))
    ranged = lambda x: x.between(shelf_lo, shelf_hi)
    return (
        F.when(~ranged(a) & ~ranged(b), "-").when(core(a) & core(b), "CpGI_core")
        .when((core(a) & high_shore(b)) | (low_shore(a) & core(b)), "CpGI_coreshore")
        .when((low_shore(a) & low_shore(b)) | (high_shore(a) & high_shore(b)), "CpGI_shore")
        .when((low_shelf(a) & low_shore(b)) | (high_shore(a) & high_shelf(b)), "CpGI_shoreshelf")
        .when((low_shelf(a) & low_shelf(b)) | (high_shelf(a) & high_shelf(b)), "CpGI_shelf").otherwise("CpGI_shelfoverlap")
    )


def exon_class(s: Column, e: Column, lo: Column, hi: Column, strand: Column, segments: Column) -> Column:
    """How a region lies on the exons of a gene; segments are sorted by start."""
    at = lambda q: F.coalesce(F.array_max(F.transform(segments, lambda g, i: F.when(q.between(g["start"], g["end"]), i))), F.lit(-1))
    after = lambda q: F.size(F.filter(segments, lambda g: g["start"] <= q))
    a, b = at(s), at(e)
    first, second = F.when(strand == "-", "exon_intron_boundary").otherwise("intron_exon_boundary"), F.when(strand == "-", "intron_exon_boundary").otherwise("exon_intron_boundary")
    inside = (
        F.when((a >= 0) & (a == b), "on_exon").when((a >= 0) & (b >= 0), "intron_internal").when(b >= 0, first).when(a >= 0, second)
        .when(after(s) == after(e), "on_intron").otherwise("exon_internal")
    )
    before = F.when(strand == "-", s > hi).otherwise(e < lo)
    return F.when(s.between(lo, hi) & e.between(lo, hi), inside).when(lo.between(s, e), "5prime").when(hi.between(s, e), "3prime").when(before, "upstream").otherwise("Unknown")


def filtered(features: DataFrame, types: list[str] | None = None, biotypes: list[str] | None = None, with_cds: DataFrame | None = None, attributes: dict[str, str] | None = None) -> DataFrame:
    """Features of types and biotypes; attributes: with these values in the map quals; with_cds: only those that hold one of its features."""
    for name, value in (attributes or {}).items():
        features = features.where(F.try_element_at("quals", F.lit(name)) == value)
    if types is not None:
        features = features.where(F.col("type").isin(types))
    if biotypes is not None:
        features = features.where(F.lower("biotype").isin([b.lower() for b in biotypes]))
    return features if with_cds is None else included(features, with_cds).drop("inner_no")


def type_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("chrom", "type").agg(F.count("*").alias("n"))

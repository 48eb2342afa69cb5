"""Methylation calls from aligned reads, and from mapper output matched with reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import ship
from ..functions.sequences import Bases, among, bisulphite_mismatches, by_row
from .bins import region_sequences
from .intervals import beside, point_in_interval

#: The flag bit of reads on the reverse strand (fixed value).
REVERSE = 16


def read_calls(reads: DataFrame, chunks: DataFrame, every_c: bool = False, exact_flag: bool = False, all_c_compat: bool = False) -> DataFrame:
    """(read_id, chrom, pos, meth, first_3p) from reads (read_id, chrom, pos, flag, seq) and a genome in overlapping chunks.

    Forward: at a reference C (before a G unless every_c) the read's C is methylated, its T unmethylated. Reverse: at a
    reference G behind a C the read's G is methylated, its A unmethylated; the call stands at the C. CIGARs are not
    looked at. first_3p marks the call nearest to a reverse read's 3' end. exact_flag: the flag must be 16, not hold it.
    """
    reverse = F.col("flag") == REVERSE if exact_flag else F.col("flag").bitwiseAND(REVERSE) != 0
    # A read's reference, with a base before and behind it: calls may need both.
    start, end = F.greatest(F.col("pos") - 1, F.lit(1)), F.col("pos") + F.length("seq")
    keyed = reads.where("pos >= 1").select("read_id", "chrom", "pos", reverse.alias("_reverse"), F.col("seq").alias("_read"), start.alias("start"), end.alias("end"))
    ship(reads.sparkSession)
    both = region_sequences(keyed, chunks).where("_reverse is not null")
    if every_c:
        motif, offset, pair = {False: "C", True: "C" if all_c_compat else "G"}, 0, {False: b"CT", True: b"GA"}
    else:
        # A reverse read's base stands behind the C that begins the motif.
        motif, offset, pair = {False: "CG", True: "CG"}, 1, {False: b"CT", True: b"GA"}

    @F.arrow_udf("array<int>")
    def found(ref: pa.Array, read: pa.Array, off: pa.Array, back: pa.Array) -> pa.Array:
        def hits(g: Bases, r: Bases, off: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, i = g.places(motif, back)
            row, i, base = r.at(row, i - off[row] + np.where(back[row], offset, 0))
            fits = np.where(back[row], among(pair[True])[base], among(pair[False])[base])
            return row[fits], 2 * i[fits] + among(b"CG")[base[fits]]

        return by_row(hits, ref, read, off, back)

    # Marked so that explode's filter of empty lists doesn't have it worked out twice.
    calls = both.select("read_id", "chrom", "pos", "_reverse", found.asNondeterministic()(F.col("seq"), F.col("_read"), F.col("pos") - F.col("start"), F.col("_reverse")).alias("_hits"))
    # Hits are in the order of their places, so the last one of a row is its nearest to the 3' end.
    last = F.max(F.try_element_at("_hits", F.lit(-1))).over(Window.partitionBy("read_id"))
    calls = calls.withColumn("_last", last).select("read_id", "chrom", "pos", "_reverse", "_last", F.explode("_hits").alias("_hit"))
    i = F.shiftright("_hit", 1)
    place = F.col("pos") + i - (0 if every_c else F.when(F.col("_reverse"), 1).otherwise(0))
    return calls.select("read_id", "chrom", place.cast("int").alias("pos"), (F.col("_hit") % 2 == 1).alias("meth"), (F.col("_reverse") & (i == F.shiftright("_last", 1))).alias("first_3p"))


def slice_calls(rows: DataFrame, one_based: bool = True) -> DataFrame:
    """(read_id, chrom, pos, meth) from reads with the genome's slice under them (read_id, chrom, start, strand, seq, genome).

    genome reads along the forward strand. A CpG of the strand-corrected slice is methylated where the read has a C,
    unmethylated anywhere else.
    """
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))

    @F.arrow_udf("array<int>")
    def found(genome: pa.Array, read: pa.Array, minus: pa.Array) -> pa.Array:
        def hits(g: Bases, r: Bases, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, i = g.places({False: "CG", True: "CG"}, minus)
            # A CpG of the reverse complement is one of the slice, counted from its other end.
            row, i, base = r.at(row, np.where(minus[row], g.n[row] - 2 - i, i))
            return row, 2 * i + (base == ord("C"))

        return by_row(hits, genome, read, minus)

    ship(rows.sparkSession)
    hit = rows.select("read_id", "chrom", "start", minus.alias("_minus"), F.length("seq").alias("_n"), found.asNondeterministic()(F.col("genome"), F.col("seq"), minus).alias("_hits"))
    hit = hit.select("read_id", "chrom", "start", "_minus", "_n", F.explode("_hits").alias("_hit"))
    i = F.shiftright("_hit", 1)
    pos = F.when(F.col("_minus"), F.col("start") + F.col("_n") - 2 - i).otherwise(F.col("start") + i) + (0 if one_based else 1)
    return hit.select("read_id", "chrom", pos.cast("int").alias("pos"), (F.col("_hit") % 2 == 1).alias("meth"))


def mismatches(read: Column, genome: Column) -> Column:
    return bisulphite_mismatches(read, genome)


def tile_of(header: Column, kind: str = "fastq") -> Column:
    """struct tile, x, y of a read's header: FASTA >s<lane>_<tile>_<x>_<y>, FASTQ with them as the last three of : fields."""
    parts = F.split(F.regexp_replace(header, "[#/ ].*$", ""), "_" if kind == "fasta" else ":")
    get = lambda i: F.try_element_at(parts, F.lit(i)).cast("int")
    return F.struct(get(-3).alias("tile"), get(-2).alias("x"), get(-1).alias("y"))


def plain_tile(tile: Column, layout: str = "gaii") -> Column:
    """A tile's running number: abcd (surface, swath, tile) of the 3.2 and 3.3 layouts; GAII tiles stay."""
    if layout == "gaii":
        return tile
    per = {"3.2": 8, "3.3": 8}[layout]
    swaths = {"3.2": 2, "3.3": 3}[layout]
    a, b, cd = F.floor(tile / 1000), F.floor(tile / 100) % 10, tile % 100
    return (swaths * per * (a - 1) + per * (b - 1) + cd).cast("int")


def tile_code(number: Column, layout: str = "gaii") -> Column:
    """The other way round."""
    if layout == "gaii":
        return number
    swaths = {"3.2": 2, "3.3": 3}[layout]
    z = number - 1
    return ((F.floor(z / (8 * swaths)) + 1) * 1000 + (F.floor(z / 8) % swaths + 1) * 100 + z % 8 + 1).cast("int")


def mapped(reads: DataFrame, mappings: DataFrame) -> DataFrame:
    """reads (tile, x, y, …) with the last (by line_no) mapping of their place."""
    last = mappings.groupBy("tile", "x", "y").agg(F.max_by(F.struct(*(c for c in mappings.columns if c not in ("tile", "x", "y"))), "line_no").alias("_m")).select("tile", "x", "y", "_m.*")
    return reads.join(last, ["tile", "x", "y"])


def fragment_class(s: Column, e: Column, lo: Column, hi: Column, reverse: Column) -> Column:
    """How a read lies on a reduced genome's fragment."""
    three = F.when(reverse, e == hi + 2).otherwise(e == hi)
    return (
        F.when(s > hi, "3prime_of").when(e < lo, "5prime_of").when(s == lo, "5prime_end").when(three, "3prime_end")
        .when((s > lo) & (e < hi), "internal").when(((lo > s) & (lo < e)) | ((hi > s) & (hi < e)), "on_join").otherwise("unmapped")
    )


def classified(reads: DataFrame, fragments: DataFrame) -> DataFrame:
    """reads (read_id, chrom, start, end, strand) plus class, by the first fragment that doesn't end before the read; unmapped without one."""
    f = fragments.select("chrom", F.col("start").alias("lo"), F.col("end").alias("hi"))
    # The first fragment whose end isn't before the read's start: the stretch from the end before to its own end holds the start.
    reach = beside(f, "hi", "_before", False, start="lo", end="hi").withColumn("from", F.coalesce("_before", F.lit(0)) + 1).drop("_before")
    found = point_in_interval(reads, reach, pos="start", start="from", end="hi", how="left")
    known = F.when(F.col("lo").isNull(), "unmapped").otherwise(fragment_class(F.col("start"), F.col("end"), F.col("lo"), F.col("hi"), F.col("strand") == "-"))
    return found.withColumn("class", F.when(known.isin("5prime_of", "3prime_of"), "unmapped").otherwise(known)).drop("from", "lo", "hi")

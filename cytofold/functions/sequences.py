"""Columns over base sequences."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

# IUB codes, their complements and the bases they stand for.
IUB = "ACGTURYKMSWBDHVN"
COMPLEMENT = "TGCAAYRMKSWVHDBN"
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

# The standard genetic code, its bases in the order T C A G, and how other codes differ.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODES = {
    "standard": {},
    "vertebrate_mitochondrial": {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    "yeast_mitochondrial": {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    "mould_mitochondrial": {"TGA": "W"},
    "invertebrate_mitochondrial": {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    "ciliate": {"TAA": "Q", "TAG": "Q"},
    "echinoderm_mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    "euplotid": {"TGA": "C"},
    "bacterial": {},
    "yeast_alternative": {"CTG": "S"},
    "ascidian_mitochondrial": {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    "flatworm_mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    "blepharisma": {"TAG": "Q"},
}


def upper(seq: Column) -> Column:
    """a-z in upper case; no character becomes two, so places stay."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def exchanged(seq: Column, old: str, new: str) -> Column:
    """Letters of old become those of new, as translate does it, but some hundred times as fast; all must be of one byte. Not for lambdas."""
    table = np.arange(256, dtype=np.uint8)
    table[list(old.encode("ascii"))[::-1]] = list(new.encode("ascii"))[::-1]  # of equal letters the first counts

    @F.arrow_udf("string")
    def put(texts: pa.Array) -> pa.Array:
        valid, offsets, data = texts.buffers()
        if data is None:
            return texts
        return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)])], offset=texts.offset)

    # Marked so that no filter moves below it and has it worked out twice.
    return put.asNondeterministic()(seq)


def complement(seq: Column) -> Column:
    """Base by base; other characters stay, case is kept."""
    return F.translate(seq, IUB + IUB.lower(), COMPLEMENT + COMPLEMENT.lower())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def iub_pattern(motif: str) -> str:
    """A regular expression of an ambiguous motif."""
    return "".join(c if len(BASES.get(c, c)) == 1 else f"[{BASES[c]}]" for c in motif.upper().replace("U", "T"))


def base_mask(base: Column) -> Column:
    """Bits A=1 C=2 G=4 T=8 of the bases that a code stands for; 0 for others."""
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    pairs = [x for code, bases in BASES.items() for x in (F.lit(code), F.lit(sum(bit[b] for b in bases)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper(base)), F.lit(0))


def iub_match(a: Column, b: Column) -> Column:
    """Whether two codes have a base in common."""
    return base_mask(a).bitwiseAND(base_mask(b)) != 0


#: Bases that are looked at together, so that a batch of long texts takes no more memory than one of short ones.
TOGETHER = 1 << 21
#: a-z in upper case, other bytes as they are.
UPPER = np.arange(256, dtype=np.uint8)
UPPER[97:123] -= 32


def among(letters: bytes) -> np.ndarray:
    """For each byte whether it is one of the letters."""
    return np.isin(np.arange(256), list(letters))


class Bases:
    """Texts of an Arrow array end to end in upper case, a byte a character: only letters of one byte are looked for."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        lead = (raw & 0xC0) != 0x80  # the first bytes of characters
        if not lead.all():
            edges = np.concatenate([[0], np.cumsum(lead)])[edges]
            raw = raw[lead]
        self.raw, self.edges, self.n = UPPER[raw], edges, np.diff(edges)

    def hits(self, motif: str) -> np.ndarray:
        """Whether a motif begins at a place; the last places of a text may need the next one."""
        n, hit = len(self.raw), np.ones(len(self.raw), bool)
        for k, c in enumerate(motif):
            fits = BASES[c.upper()].encode()
            same = self.raw[k:] == fits[0] if len(fits) == 1 else among(fits)[self.raw[k:]]
            hit[: len(same)] &= same
            hit[max(n - k, 0) :] = False
        return hit

    def places(self, motif: dict[bool, str], back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place from 0) of the hits of a row's motif, by its side."""
        hit = self.hits(motif[False])
        if motif[True] != motif[False]:
            hit = np.where(np.repeat(back, self.n), self.hits(motif[True]), hit)
        at = np.flatnonzero(hit)
        row = np.repeat(np.arange(len(self.n)), np.diff(np.searchsorted(at, self.edges)))
        length = np.where(back, len(motif[True]), len(motif[False]))
        whole = at + length[row] <= self.edges[row + 1]
        row, at = row[whole], at[whole]
        return row, at - self.edges[row]

    def at(self, row: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, i, the letter there) of the places that a row has."""
        there = (i >= 0) & (i < self.n[row])
        row, i = row[there], i[there]
        return row, i, self.raw[self.edges[row] + i]


def by_row(hits: Callable, first: pa.Array, *more: pa.Array) -> pa.Array:
    """For each row the sorted list of the numbers that hits gives, as (row, number); texts become Bases, rows of some TOGETHER bases go at a time."""
    size = np.cumsum(pc.binary_length(first).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    made, a = [], 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + TOGETHER, "right")))
        parts = (x.slice(a, b - a) for x in (first, *more))
        row, number = hits(*(Bases(x) if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x.to_numpy(zero_copy_only=False) for x in parts))
        if (np.diff(row * (1 << 32) + number) < 0).any():
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
        made.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(number.astype(np.int32))))
        a = b
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))


def motif_positions(seq: Column, motif: str, skip_others: bool = False) -> Column:
    """1-based starts of a motif, overlapping ones too, in any case; skip_others: characters that aren't bases don't break it."""
    plain = not skip_others and bool(motif) and set(motif.upper()) <= set(BASES)
    pattern = re.compile(f"(?={('[^ACGTU]*' if skip_others else '').join(iub_pattern(c) for c in motif)})", re.I)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        def hits(x: Bases) -> tuple[np.ndarray, np.ndarray]:
            row, i = x.places({False: motif, True: motif}, np.zeros(len(x.n), bool))
            return row, i + 1

        return by_row(hits, texts) if plain else pa.array([[m.start() + 1 for m in pattern.finditer(t or "")] for t in texts.to_pylist()], pa.list_(pa.int32()))

    # Marked so that explode's filter of empty lists doesn't have it worked out twice.
    return found.asNondeterministic()(seq)


def motif_hits(seq: Column, motifs: list[str], skip_others: bool = False) -> Column:
    """Of many motifs at once the longest that ends at each base: array of (start, end, motif), 1-based, in any case.

    One pass of an automaton over all motifs; ambiguous ones stand for each of their plain forms. skip_others: characters
    that aren't bases don't break a motif.
    """
    plain: dict[str, str] = {}
    for motif in motifs:
        for form in product(*(BASES.get(c, c) for c in motif.upper())):
            plain.setdefault("".join(form), motif)

    @F.pandas_udf("array<struct<start:int,end:int,motif:string>>")
    def found(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for form, motif in plain.items():
            automaton.add_word(form, (len(form), motif))
        if plain:
            automaton.make_automaton()

        def hits(text: str | None) -> list[dict]:
            up = re.sub("[a-z]+", lambda m: m[0].upper(), text or "").replace("U", "T")
            places = [i for i, c in enumerate(up) if c in "ACGT"] if skip_others else range(len(up))
            if skip_others:
                up = "".join(up[i] for i in places)
            longest: dict[int, tuple[int, str]] = {}
            for end, hit in automaton.iter(up) if plain else ():
                longest[end] = max(longest.get(end, hit), hit, key=lambda x: x[0])
            return [{"start": places[end - n + 1] + 1, "end": places[end] + 1, "motif": motif} for end, (n, motif) in sorted(longest.items())]

        return texts.map(hits)

    return found(seq)


def motif_count(seq: Column, motif: str) -> Column:
    return F.regexp_count(upper(seq), F.lit(f"(?={iub_pattern(motif)})"))


def first_match(seq: Column, motif: str) -> Column:
    """1-based place of the first match of an ambiguous motif, 0 if there is none."""
    return F.regexp_instr(upper(seq), F.lit(iub_pattern(motif)))


def last_match(seq: Column, motif: str) -> Column:
    """1-based place of the last match, 0 if there is none."""
    return F.coalesce(F.array_max(motif_positions(seq, motif)), F.lit(0))


def base_composition(seq: Column) -> Column:
    """struct a, c, g, t, other."""
    n = F.length(seq)
    counts = {b: n - F.length(F.replace(F.replace(seq, F.lit(b.upper()), F.lit("")), F.lit(b), F.lit(""))) for b in "acgt"}
    other = n
    for c in counts.values():
        other = other - c
    return F.struct(*(c.cast("bigint").alias(b) for b, c in counts.items()), other.cast("bigint").alias("other"))


def bisulphite_mismatches(read: Column, reference: Column) -> Column:
    """Places of the shorter where read and reference differ; a T in the read matches C, too."""
    n = F.least(F.length(read), F.length(reference))
    one = lambda s: F.split(F.substring(upper(s), F.lit(1), n), "")
    unlike = F.zip_with(one(read), one(reference), lambda r, g: F.when((r == g) | ((r == "T") & (g == "C")), 0).otherwise(1))
    return F.when(n > 0, F.aggregate(unlike, F.lit(0), lambda a, b: a + b)).otherwise(0)


def phred(symbol: Column, base: int = 33) -> Column:
    return F.ascii(symbol) - base


def phred_scores(quality: Column, base: int = 33) -> Column:
    return F.when(F.length(quality) > 0, F.transform(F.split(quality, ""), lambda c: phred(c, base))).otherwise(F.array().cast("array<int>"))


def phred_symbol(score: Column, base: int = 33) -> Column:
    return F.char(score + base)


def codon_table(code: str = "standard") -> dict[str, str]:
    made = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    return made | CODES[code]


def codons(seq: Column) -> Column:
    """Whole codons from the first base on."""
    plain = F.replace(upper(seq), F.lit("U"), F.lit("T"))
    return F.regexp_extract_all(plain, F.lit("(?s)(...)"), F.lit(1))


def translated(seq: Column, code: str | Mapping[str, str] = "standard") -> Column:
    """Residues of the codons, X where a codon isn't in the table."""
    table = codon_table(code) if isinstance(code, str) else code
    known = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(known, c), F.lit("X"))), "")


def codon_usage(df: DataFrame, seq: str = "seq", code: str = "standard") -> DataFrame:
    """(codon, residue, n) over all rows."""
    rows = df.select(F.explode(codons(F.col(seq))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    return rows.select("codon", translated(F.col("codon"), code).alias("residue"), "n")


def gcg_checksum(seq: Column) -> Column:
    """Sum of upper-case codes times their place in lines of 57, modulo 10,000."""
    letters = F.when(F.length(seq) > 0, F.split(upper(seq), "")).otherwise(F.array().cast("array<string>"))
    weighed = F.transform(letters, lambda c, i: (F.pmod(i, F.lit(57)) + 1).cast("bigint") * F.ascii(c))
    return F.pmod(F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(10000))


def proportion(meth: Column, unmeth: Column) -> Column:
    """meth / (meth + unmeth), -1 without counts."""
    return F.coalesce(F.try_divide(meth.cast("double"), (meth + unmeth).cast("double")), F.lit(-1.0))


def ratio(meth: Column, unmeth: Column) -> Column:
    """meth / unmeth, null without unmethylated counts."""
    return F.try_divide(meth.cast("double"), unmeth.cast("double"))


def url_decoded(text: Column) -> Column:
    """%XX escapes read; + stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


# Conversions of the former awk helpers.


def before_first_r(field: Column) -> Column:
    """The text before the first r."""
    return F.element_at(F.split(field, "r"), 1)


def extractor_sign(context: Column) -> Column:
    """Z is a methylated CpG, z an unmethylated one, anything else null."""
    return F.when(context == "Z", "+").when(context == "z", "-")


def fasta_record(header: Column, seq: Column) -> Column:
    """A FASTQ header and sequence as FASTA: the header without its @ and what follows a blank."""
    return F.concat(F.lit(">"), F.regexp_replace(F.element_at(F.split(header, r"\s"), 1), "^@", ""), F.lit("\n"), seq)

"""Read cleaning: adaptors and quality runs, trimming and masking, pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import ship


#: Reads whose hits are held as Python objects at once.
TOGETHER = 256
_UPPER = {c: c - 32 for c in range(97, 123)}


@dataclass(frozen=True)
class Trim:
    shortest_prefix: int = 6  # of an adaptor that is looked for
    identity: float = 85.0  # percent of the overlap
    most_overhang: int = 0  # 0: any
    skip: int = 0  # leading bases without hits
    mismatch: bool = False  # prefixes with one base exchanged, too
    trim_back: int = 0  # bases before a hit that go, too
    shortest: int = 1  # a read that stays
    longest: int = 0  # 0: any
    quality: int | None = None
    base: int = 33
    repeats: int = 2  # -1: until nothing is found
    from_five: int = 0  # bases cut from the adaptors' 5' ends
    compat: bool = False  # reads without a hit are not judged


class Finder:
    """Adaptor prefixes in reads."""

    def __init__(self, adaptors: list[str], how: Trim):
        self.how = how
        self.adaptors = list(dict.fromkeys(a.upper()[how.from_five :] for a in adaptors if len(a) > how.from_five))
        self.prefix: dict[str, int] = {}
        for i, a in enumerate(self.adaptors):
            for n in range(how.shortest_prefix, len(a) + 1):
                self.prefix.setdefault(a[:n], i)
                if how.mismatch:
                    for k in range(n):
                        for c in "ACGT":
                            self.prefix.setdefault(a[:k] + c + a[k + 1 : n], i)
        self.longest = max(map(len, self.prefix), default=0)
        words = sorted({p[: how.shortest_prefix] for p in self.prefix}, key=len)
        self.start = re.compile(f"(?=({'|'.join(map(re.escape, words))}))") if words else None

    def identity(self, adaptor: str, rest: str) -> float:
        n = min(len(adaptor), len(rest))
        return 100.0 * sum(map(eq, adaptor, rest)) / n if n else 0.0

    def hits(self, read: str) -> list[tuple[int, int, int, float]]:
        """(start, length of the longest prefix, adaptor, identity) of the valid hits, by start."""
        if self.start is None:
            return []
        up, found = read.translate(_UPPER), []  # places stay, whatever the characters
        for m in self.start.finditer(up, self.how.skip):
            s = m.start()
            n = next(n for n in range(min(len(up) - s, self.longest), 0, -1) if up[s : s + n] in self.prefix)
            i = self.prefix[up[s : s + n]]
            same = self.identity(self.adaptors[i], up[s : s + len(self.adaptors[i])])
            over = len(up) - s - len(self.adaptors[i])
            if same >= self.how.identity and (not self.how.most_overhang or over <= self.how.most_overhang):
                found.append((s, n, i, same))
        return found

    def quality_run(self, scores: list[int], end: int) -> tuple[int, int]:
        """The first run of good scores that is the longest; one replaces it only if at least 2 longer than it less 1."""
        best, begin = (0, -1), None
        for i in range(end + 1):
            good = i < end and scores[i] >= self.how.quality
            if good and begin is None:
                begin = i
            elif not good and begin is not None:
                if i - begin > best[1] - best[0] + 1:
                    best = (begin, i)
                begin = None
        return (best[0], min(best[1], end)) if best[1] >= 0 else (0, 0)

    def span(self, read: str, quality: str | None, first: list[tuple[int, int, int, float]] | None = None) -> tuple[int, int, bool]:
        """(start, end, valid) of what stays of a read; first: the hits of the whole read where they are known."""
        how, end, hit = self.how, len(read), False
        rounds = how.repeats if how.repeats >= 0 else len(read) + 1
        for i in range(max(1, rounds)):
            found = first if first is not None and not i else self.hits(read[:end])
            if not found:
                break
            hit, end = True, max(0, found[0][0] - how.trim_back)
        if how.compat and not hit:
            return 0, end, True
        start = 0
        if how.quality is not None and quality:
            start, end = self.quality_run([ord(c) - how.base for c in quality[:end]], min(end, len(quality)))
        return start, end, end - start >= how.shortest


def cleaned(reads: DataFrame, adaptors: list[str], how: Trim = Trim(), seq: str = "seq", qual: str | None = None) -> DataFrame:
    """reads plus trim_start, trim_end, valid and hits (array of start, length, adaptor, identity): judged read by read."""
    from pyspark.sql import types as T

    kept = [c for c in reads.columns if c not in ("trim_start", "trim_end", "valid", "hits")]
    hit = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("adaptor", T.IntegerType()), T.StructField("identity", T.DoubleType())]))
    # Only bases and scores go to Python, and only what is found comes back.
    made = T.StructType([T.StructField("trim_start", T.IntegerType()), T.StructField("trim_end", T.IntegerType()), T.StructField("valid", T.BooleanType()), T.StructField("hits", hit)])

    @F.arrow_udf(made)
    def judged(seqs: pa.Array, quals: pa.Array) -> pa.Array:
        finder, out, types = Finder(adaptors, how), [], (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("adaptor", pa.int32()), ("identity", pa.float64())])))
        for at in range(0, max(len(seqs), 1), TOGETHER):
            rows = []
            for s, q in zip(seqs.slice(at, TOGETHER), quals.slice(at, TOGETHER), strict=True):
                read = s.as_py() or ""
                found = finder.hits(read)
                rows.append((*finder.span(read, q.as_py(), found), [dict(zip(("start", "length", "adaptor", "identity"), h, strict=True)) for h in found]))
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            out.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], made.names))
        return pa.concat_arrays(out)

    ship(reads.sparkSession)
    found = judged.asNondeterministic()(F.col(seq), F.col(qual) if qual else F.lit(None).cast("string"))
    return reads.select(*kept, found.alias("_judged")).select(*kept, *(F.col(f"_judged.{c}").alias(c) for c in made.names))


def trimmed(seq: Column, start: Column, end: Column, longest: int = 0) -> Column:
    n = end - start
    return F.substring(seq, start + 1, F.greatest(F.least(n, F.lit(longest)) if longest else n, F.lit(0)))


def filled(seq: Column, start: Column, end: Column, by: str = "N") -> Column:
    """What doesn't stay becomes N; the length is kept."""
    return F.concat(F.repeat(F.lit(by), start), F.substring(seq, start + 1, end - start), F.repeat(F.lit(by), F.greatest(F.length(seq) - end, F.lit(0))))


def valid_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """read_no with both reads' spans where both are valid."""
    a, b = (x.where("valid").select("read_no", *(F.col(c).alias(f"{c}_{i}") for c in ("trim_start", "trim_end"))) for i, x in ((1, first), (2, second)))
    return a.join(b, "read_no")

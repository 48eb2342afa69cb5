"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources by code point (null last) weigh as the weights say, in turn, and share the words of all documents; a
target stops at cap times its source's words and the excess is shared by weight again until none is above. That is
min(weight x level, cap x words) for one level, which is the largest of the levels that each number of stopped sources
would give.

Copies: with r = target / words of the source, each document is taken floor(r) times for certain. What is left of the
target, rest, is drawn as a sample of fixed size (rest words) with unequal probabilities: a document of s words is
taken once more with probability p = min(1, rate x s), where the rate is such that the p x s of a source add up to
rest. Documents are ranked by random odds u / (1 - u) divided by inclusion odds p / (1 - p), those with p = 1 first, and
the sample is the ranking's beginning, as long as it fits into rest, closed by the one document behind it whose size comes
nearest to the words that are still missing. So long documents, whose loss would cost most words, are drawn more often
than short ones. A document of more than rest words has p = 0.
u comes from the id and the text, so reruns agree.

The ranking isn't sorted: a rank is a number of BITS bits, and where a source's ranking is cut is found digit by digit,
from sums over the values of each digit. Each step looks at the rows of the cut's own digit only, and its sums are made
before rows move. What meets in a task is at most 2 ** DIGIT sums of a source, whatever its number of rows. Tables that
are joined to rows have one row a source.

A null text has size 0; null sources are one source; documents of size 0 are never sampled, which costs nothing. Rows
equal in id, text and source have one rank and are taken all or not at all. Other columns, whatever their names, play no
part. Very long texts are counted as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut, fresh

WEIGHTS, CAP = (5, 2, 1), 3.0
#: Bits of a rank, and of a digit.
BITS, DIGIT = 48, 6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from id and text: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, source_rows, target, whole, rest) from (source, size): whole copies for certain, rest words to draw."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # Below, one row for each source.
    turn = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("target", F.least(F.col("weight") * F.max("level").over(every), F.col("most")))
    rows = rows.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size") + 1e-12), F.lit(0)))
    return rows.select("source", "source_size", "source_rows", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def rates(sizes: DataFrame, told: DataFrame) -> DataFrame:
    """told plus rate: the least that makes min(1, rate x size) x size of the documents that fit add up to rest.

    Sizes of 16 words and more are taken together with those that share their four highest bits, by their mean. Of the
    rates that each number of classes with p = 1, the largest sizes first, would give the largest is right.
    """
    fit = sizes.alias("r").join(told.alias("s"), _same("r", "s")).where("size > 0 and size <= rest").select("r.source", "size")
    low = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))
    classes = fit.groupBy("source", low.alias("low"), F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").alias("high")).agg(F.sum("size").alias("n"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    down = Window.partitionBy("source").orderBy(F.desc("low"), F.desc("high"))
    sums = classes.withColumn("above", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("below", F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing)))
    found = sums.alias("r").join(told.alias("s"), _same("r", "s")).groupBy("r.source").agg(F.max((F.col("rest") - F.col("above")) / F.col("below")).alias("rate"))
    return told.alias("s").join(found.alias("r"), _same("s", "r"), "left").select("s.*", "rate")


def inclusion(size: Column, rate: Column, rest: Column) -> Column:
    """The probability that a document is taken once more than its source's whole copies; null if none is drawn."""
    return F.when((size > 0) & (size <= rest), F.least(rate * size, F.lit(1 - 1e-9)))


def rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, q, as the number floor(q / (1 + q) x 2 ** BITS)."""
    a, b = u * (1 - p), p * (1 - u)
    return F.floor(a / (a + b) * float(1 << BITS))


def limits(sizes: DataFrame, told: DataFrame) -> DataFrame:
    """told plus limit and last: documents whose rank is below limit, or is last, are in the sample."""
    drawn = sizes.alias("r").join(told.alias("s"), _same("r", "s")).where("rate is not null").select("r.source", "size", rank(F.col("u"), inclusion(F.col("size"), F.col("rate"), F.col("rest"))).alias("rank"))
    left = drawn.where("rank is not null")
    at, shift = told.select("source", "rest", F.lit(0).cast("bigint").alias("before")), BITS
    while shift:
        shift -= DIGIT
        digits = left.groupBy("source", F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))
        upto = F.col("before") + F.sum("r.n").over(Window.partitionBy("r.source").orderBy("r.digit").rowsBetween(Window.unboundedPreceding, 0))
        sums = digits.alias("r").join(at.select("source", "rest", "before").alias("s"), _same("r", "s")).withColumn("upto", upto)
        at = cut(sums.where("upto >= rest and upto - n < rest").select("r.source", "rest", (F.col("upto") - F.col("n")).alias("before"), "n", "digit", "low", "high"), "mix-cuts")
        if at.where("low < high").isEmpty():
            break
        left = cut(left.alias("r").join(at.alias("s"), _same("r", "s") & (F.shiftright("r.rank", shift) == F.col("s.digit"))).select("r.*"), "mix-left")
    # The sample's beginning: what lies below the cut's own rank. gap: the words that are still missing then.
    begun = at.select("source", F.col("low").alias("limit"), (F.col("rest") - F.col("before")).alias("gap"))
    told = told.alias("s").join(begun.alias("r"), _same("s", "r"), "left").select("s.*", F.coalesce("limit", F.lit(1 << BITS)).alias("limit"), "gap")
    beyond = drawn.where("rank is not null").alias("r").join(begun.alias("s"), _same("r", "s")).where("rank >= limit").select("r.*", "gap").withColumn("off", F.abs(F.col("size") - F.col("gap")))
    least = beyond.groupBy("source").agg(F.min("off").alias("off"))
    near = beyond.alias("r").join(least.alias("s"), _same("r", "s") & (F.col("r.off") == F.col("s.off"))).groupBy("r.source", "rank", "gap").agg(F.abs(F.sum("size") - F.col("gap")).alias("off")).where("off < gap")
    last = near.groupBy("source").agg(F.min(F.struct("off", "rank")).getField("rank").alias("last"))
    return told.alias("s").join(last.alias("r"), _same("s", "r"), "left").select("s.*", F.coalesce("last", F.lit(-1)).alias("last"))


def copies(size: Column, u: Column, of: str = "") -> Column:
    """How often a document is taken, by its source's row of limits(); of: the name of a struct of its columns, with a dot."""
    place = rank(u, inclusion(size, F.col(f"{of}rate"), F.col(f"{of}rest")))
    more = (place < F.col(f"{of}limit")) | (place == F.col(f"{of}last"))
    return (F.col(f"{of}whole") + F.coalesce(more, F.lit(False)).cast("bigint")).cast("bigint")


def _plan(rows: DataFrame, weights: tuple, cap: float) -> DataFrame:
    """One row a source, from rows (source, size, u)."""
    told = cut(targets(rows, weights, cap), "mix-targets")
    told = cut(rates(rows, told), "mix-rates")
    return cut(limits(rows, told), "mix-limits")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, p, copies, taken) for each row of docs; p: of one copy more than the whole ones."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), uniform(F.col(doc_id), F.col(text), seed).alias("u"))
    rows = cut(rows, "mix-sizes")
    both = rows.alias("r").join(_plan(rows, weights, cap).alias("s"), _same("r", "s"))
    p = F.coalesce(inclusion(F.col("size"), F.col("rate"), F.col("rest")), F.lit(0.0))
    both = both.select("doc_id", "r.source", "size", "source_size", "target", p.alias("p"), copies(F.col("size"), F.col("u")).alias("copies"))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def mixture(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as mix() takes it."""
    size, u, plan, name = (fresh(docs, c) for c in ("_size", "_u", "_plan", "_source"))
    # Written with the rows: conditions on them are worked out more than once.
    rows = cut(docs.select(*(docs[c] for c in docs.columns), words(docs[text]).alias(size), uniform(docs[doc_id], docs[text], seed).alias(u)), "mix-rows")
    told = _plan(rows.select(rows[source].alias("source"), rows[size].alias("size"), rows[u].alias("u")), weights, cap)
    # One struct and names of our own: whatever docs' columns are called, none is hidden.
    told = told.select(F.col("source").alias(name), F.struct("whole", "rate", "rest", "limit", "last").alias(plan))
    both = rows.join(told, rows[source].eqNullSafe(told[name]))
    times = copies(rows[size], rows[u], f"{plan}.").cast("int")
    return both.select(*(rows[c] for c in docs.columns), times.alias(size)).where(F.col(size) > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(size))).alias(u)).drop(u)

"""Document fingerprints: Merkle trees over sections and paragraphs, with DataFrame functions only.

A text's lines are its sections; a section's paragraphs are its sentences: what a run of . ! ? ends, or WORDS words where
none comes before, with the white space behind. Every character is in one paragraph. A paragraph's digest is MD5 of its
bytes, a section's is MD5 of its paragraphs' digests, the root is SHA-256 of the sections' digests.

A fingerprint is the tree as text: the root, then for each section a slash, 16 digits of its digest and 8 of each of its
paragraphs' digests. Two fingerprints are compared from the root down: equal roots are equal texts; of the sections,
those that both have are equal as a whole and aren't looked into; in the others paragraphs are compared. Likeness is
2 x equal / (paragraphs of the one + paragraphs of the other), each different section and paragraph once. edits() walks the
branches in order and gives the places where they differ.

Null text is empty text: one empty section. Very long texts are fingerprinted as a whole: regular expressions have bounded
repeats, and branches are compared by hashing. Rows with equal ids follow each other by a hash of the text; an id that
very many rows have is cut into slices, and its equal rows are taken together. Null ids come last. Other columns,
whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_parts

WORDS = 16
PARAGRAPH = r"(?:[^\s.!?]{1,24}\s{0,8}){1,%d}[.!?]{0,8}\s{0,8}|[.!?]{1,8}\s{0,8}|\s+" % WORDS
#: Digits of a section's and of a paragraph's digest in a fingerprint.
SECTION, LEAF = 16, 8
#: Ranges of ids for each shuffle partition; what the driver holds of them is one row each.
RANGES, MOST_RANGES = 4, 1 << 16
#: Rows of one id from which it may be cut into slices.
REPEATED = 1000


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text, as text."""
    paragraphs = lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p.cast("binary")))
    tree = F.transform(F.split(text, "\n", -1), paragraphs)
    named = F.transform(tree, lambda ps: F.struct(F.md5(F.array_join(ps, "").cast("binary")).alias("digest"), F.array_join(F.transform(ps, lambda p: F.substring(p, 1, LEAF)), "").alias("leaves")))
    # A lambda's argument is a value: the sections' digests are computed once for the root and the branches.
    whole = lambda t: F.concat(F.sha2(F.array_join(t["digest"], "").cast("binary"), 256), F.lit("/"), F.array_join(F.transform(t, lambda s: F.concat(F.substring(s["digest"], 1, SECTION), s["leaves"])), "/"))
    return F.element_at(F.transform(F.array(named), whole), 1)


def sections(print_: Column) -> Column:
    return F.split(F.substring(print_, 66, 1 << 30), "/", -1)


def paragraphs(section: Column) -> Column:
    return F.regexp_extract_all(F.substring(section, SECTION + 1, 1 << 30), F.lit(f".{{{LEAF}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1, from the root down."""

    def branches(x: Column) -> Column:
        mine, other = x["a"], x["b"]
        leaves = lambda ss: F.array_distinct(F.flatten(F.transform(ss, paragraphs)))
        same = F.aggregate(F.array_intersect(mine, other), F.lit(0), lambda n, s: n + ((F.length(s) - SECTION) / LEAF).cast("int"))
        return F.struct(same.alias("same"), leaves(F.array_except(mine, other)).alias("a"), leaves(F.array_except(other, mine)).alias("b"))

    def shared(x: Column) -> Column:
        total = 2 * x["same"] + F.size(x["a"]) + F.size(x["b"])
        return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * (x["same"] + F.size(F.array_intersect(x["a"], x["b"]))) / F.greatest(total, F.lit(1)))

    of = F.transform(F.transform(F.array(F.struct(sections(a).alias("a"), sections(b).alias("b"))), branches), shared)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.element_at(of, 1))


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>, from 0, of the branches in which two fingerprints differ, in order."""
    unlike = lambda x, y: F.filter(F.transform(F.zip_with(x, y, lambda s, t: s.eqNullSafe(t)), lambda e, i: F.when(~e, i)), lambda i: i.isNotNull())

    def inside(i: Column, x: Column, y: Column) -> Column:
        p, q = (F.coalesce(paragraphs(F.get(t, i)), F.array().cast("array<string>")) for t in (x, y))
        return F.transform(unlike(p, q), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    walk = lambda x: F.flatten(F.transform(unlike(x["a"], x["b"]), lambda i: inside(i, x["a"], x["b"])))
    return F.element_at(F.transform(F.array(F.struct(sections(a).alias("a"), sections(b).alias("b"))), walk), 1)


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    return docs.withColumn(into, fingerprint(F.coalesce(F.col(text), F.lit(""))))


def _range_of(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most value: looked up in blocks of about the root of their number."""
    if not splits:
        return F.lit(0)
    width = max(1, int(len(splits) ** 0.5))
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to one constant
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    block = below(literal(splits[::width]))
    fine = F.slice(literal(splits), F.greatest((block - 1) * width + 1, F.lit(1)), width)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + below(fine))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): beside each text that of the next smaller id; after the smallest comes the largest.

    Ids are cut into ranges by sampled quantiles. Each range also gets the first row of the next one, so neighbours
    are found inside ranges and no task sees all rows. An id with more rows than a range's share is a range of its own, cut
    into slices by the texts' hash; equal rows of it are one row with a count until the end.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(MOST_RANGES, RANGES * shuffle_parts(spark))
    ids = base.select("doc_id")
    found = ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    share = max(REPEATED, (counts.agg(F.sum("n")).first()[0] or 0) // n)
    heavy = {r.doc_id: -(-r.n // share) for r in counts.where(F.col("n") > share).collect()}  # at most n ids
    splits = sorted({int(x) for x in found} | {x for v in heavy if v is not None for x in (v, v + 1)})
    rows = base.withColumn("copies", F.lit(1).cast("bigint"))
    part = F.lit(0)
    if heavy:
        is_heavy = lambda v: F.col("doc_id").isNull() if v is None else F.col("doc_id") == v
        any_ = F.lit(False)
        for v, k in heavy.items():
            any_ = any_ | F.coalesce(is_heavy(v), F.lit(False))
            # Slices grow with the hash: its 31 highest bits, as a share.
            part = F.when(F.coalesce(is_heavy(v), F.lit(False)), F.floor((F.shiftright("h", 33) + (1 << 30)) * k / (1 << 31)).cast("int")).otherwise(part)
        equal = base.where(any_).groupBy("doc_id", "h").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
        rows = rows.where(~any_).unionByName(equal)
    ranged = lambda df: df.withColumn("at", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), splits))).withColumn("part", part)
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("h")))
    heads = ranged(base.select("doc_id", "h")).groupBy("at", "part").agg(first.alias("top")).orderBy(F.desc("at"), "part").collect()  # one row for each range
    fill = [((*b.top[:1], ~b.top[1]), a) for a, b in zip(heads, heads[1:] + heads[:1], strict=True)]
    rows = ranged(rows).withColumn("extra", F.lit(0))
    wanted = spark.createDataFrame([(d, h, a.at, a.part) for (d, h), a in fill], "top bigint, top_h bigint, into int, into_part int")
    extra = base.join(F.broadcast(wanted), base.doc_id.eqNullSafe(wanted.top) & (base.h == wanted.top_h))
    extra = extra.select("doc_id", "text", "h", F.lit(1).cast("bigint").alias("copies"), F.col("into").alias("at"), F.col("into_part").alias("part"), F.lit(1).alias("extra"))
    order_by = Window.partitionBy("at", "part").orderBy("extra", F.desc_nulls_last("doc_id"), "h")
    both = with_fingerprint(rows.unionByName(extra))
    both = both.withColumn("next_text", F.lead("text").over(order_by)).withColumn("next_fingerprint", F.lead("fingerprint").over(order_by)).where("extra = 0")
    if heavy:  # of equal rows all but the last are followed by their like
        both = both.withColumn("nth", F.explode(F.expr("sequence(1L, copies)")))
        both = both.withColumn("next_text", F.when(F.col("nth") < F.col("copies"), F.col("text")).otherwise(F.col("next_text")))
        both = both.withColumn("next_fingerprint", F.when(F.col("nth") < F.col("copies"), F.col("fingerprint")).otherwise(F.col("next_fingerprint")))
    return both.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edit_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text against itself with its last third replaced by the start of the next one, and against the next one.

    edits: the branches in which the text and the edited text differ.
    """
    part = F.floor(F.col("n_chars") / 3).cast("int")
    pairs = with_next(docs, text, doc_id).withColumn("n_chars", F.length("text").cast("bigint"))
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - part).cast("int")), F.substring("next_text", F.lit(1), part)))
    pairs = with_fingerprint(pairs, "edited", "edited_fingerprint")
    own, other, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"), edits(own, other).alias("edits"))

"""Exact dedup by a log-structured merge index, with DataFrame functions only.

Rows are dealt to memtables. A memtable counts its digests, with partial sums before rows move, and is flushed as a run
of level 0: (digest, id, n) sorted by digest, with the identifier that stays, how many there were, and a filter. When a
level has FAN runs they are merged into one of the next level, which keeps of each digest the identifier that stays. So
a digest is written as often as there are levels, and there are at most FAN - 1 runs a level to look at. Runs are
immutable and lie in the shared folder; a lost executor repeats its own tasks only.

A run's filter is a Bloom filter cut into buckets of 2 ** 15 bits: a digest sets HASHES bits of one bucket. A digest that
a filter doesn't know isn't in its run, so only digests that pass are looked up in the run itself. Filters are broadcast
up to BROADCAST bytes, which their number of buckets tells; larger ones are joined by bucket. A run's own digests that
occur there once and pass no other run's filter are unique, without a look at another run.

Hits are verified: the bytes of each row of a digest that occurs twice are compared with those of the row that
stays. Rows of one digest are dealt out over as many slices as the group needs before they are joined to anything, with
a copy of the row that stays in each, so no group meets in one task. Rows that differ although their digests
agree are grouped by the bytes.

Null text is empty text; very long texts are digested and compared as a whole. Rows that repeat a doc_id count each; of
equal ids with equal texts groups() keeps all or none, keepers() one. A null id stays only where a group has no other.
Other columns, whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Slices, cut, fresh, shared_dir

#: Memtables that groups() fills, and runs of a level that are merged.
MEMTABLES, FAN = 5, 4
#: Bits of a filter for each digest, bits that one sets, bits of a bucket.
FILTER, HASHES, BUCKET = 16, 2, 1 << 15
#: Bytes of a filter that is broadcast.
BROADCAST = 8 << 20
def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hash() -> Column:
    return F.xxhash64("digest")


def _bucket(buckets: int) -> Column:
    return F.pmod(_hash(), F.lit(buckets))


def _bits() -> list[Column]:
    """The places of a digest's bits in its bucket."""
    return [F.shiftrightunsigned(_hash(), 64 - 15 * (k + 1)).bitwiseAND(BUCKET - 1).cast("int") for k in range(HASHES)]


def _is_set(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1


class Run:
    """A sorted table of digests in the shared folder, and its filter."""

    def __init__(self, rows: DataFrame, at: str):
        """Write rows (digest, id, n), one of each digest, and their filter."""
        self.spark, self.at = rows.sparkSession, at
        rows.sortWithinPartitions("digest").write.parquet(f"{at}/rows")
        self.digests = self.spark.read.schema(rows.schema).parquet(f"{at}/rows")
        self.buckets, n = 1, self.digests.count()
        while self.buckets * BUCKET < n * FILTER:
            self.buckets *= 2
        set_ = self.digests.select(_bucket(self.buckets).alias("bucket"), F.explode(F.array(*_bits())).alias("place"))
        set_.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).write.parquet(f"{self.at}/filter")

    @property
    def small(self) -> bool:
        """Whether the filter may be broadcast."""
        return self.buckets * BUCKET // 8 <= BROADCAST

    def may_have(self, rows: DataFrame) -> DataFrame:
        """rows (digest, …) without those whose digest the filter doesn't know."""
        known = self.spark.read.schema("bucket bigint, bits binary").parquet(f"{self.at}/filter").select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
        known = F.broadcast(known) if self.small else known
        there = _bucket(self.buckets) == F.col("_bucket")
        for place in _bits():
            there = there & _is_set("_bits", place)
        return rows.join(known, there, "left_semi")


class DigestIndex:
    """Sorted digest runs in a folder: level 0 as flushed, higher levels as merged."""

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: str = "smallest", fan: int = FAN):
        if keep not in ("smallest", "largest"):
            raise ValueError(keep)
        self.spark, self.keep, self.fan = spark, keep, fan
        self.folder = folder or f"{shared_dir(spark)}/cytofold/digests-{uuid.uuid4().hex}"
        self.levels: list[list[Run]] = []
        self.written = 0

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        pick = F.min("id") if self.keep == "smallest" else F.max("id")
        at = f"{self.folder}/run{self.written}-level{level}"
        self.written += 1
        run = Run(rows.groupBy("digest").agg(pick.alias("id"), F.sum("n").cast("bigint").alias("n")), at)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)

    def flush(self, rows: DataFrame) -> None:
        """A memtable (digest, id) becomes a run of level 0; levels that are full then are merged."""
        self._write(rows.select("digest", "id", F.lit(1).cast("bigint").alias("n")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next."""
        full, self.levels[level] = self.levels[level], []
        rows = full[0].digests
        for run in full[1:]:
            rows = rows.unionByName(run.digests)
        self._write(rows, level + 1)

    def _merged(self, found: list[DataFrame]) -> DataFrame:
        pick = F.min("id") if self.keep == "smallest" else F.max("id")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("digest").agg(pick.alias("id"), F.sum("n").cast("bigint").alias("n"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, id, n) of those of the given digests that the index has; a run is asked for what passes its filter only."""
        wanted = digests.select("digest").distinct()
        return self._merged([run.digests.join(run.may_have(wanted), "digest", "left_semi") for run in self.runs])

    def repeated(self) -> DataFrame:
        """(digest, id, n) of the digests that occur twice, in one run or in several.

        A run gives the digests that it has twice and those that pass another run's filter. A digest of two runs passes
        in both, so its counts come together.
        """
        found = []
        for run in self.runs:
            twice, once = run.digests.where("n > 1"), run.digests.where("n = 1")
            passed = [other.may_have(once) for other in self.runs if other is not run]
            # A digest that is twice in its run is asked for in all: it is given whether it passes or not.
            for more in passed:
                twice = twice.unionByName(more)
            found.append(twice.dropDuplicates(["digest"]) if len(passed) > 1 else twice)
        return self._merged(found).where("n > 1")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES) -> DataFrame:
    """(doc_id, digest, keep_id, group_size): for each row the row that stays of those with its bytes."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = cut(base.select("id", "digest"), "digests")
    index = DigestIndex(spark, keep=keep)
    for k in range(memtables):
        index.flush(rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)) == k))
    told = Run(index.repeated(), f"{index.folder}/hits")
    hits = told.digests.withColumnRenamed("id", "keep_id")
    slices = Slices(hits, "digest", "id")
    found = slices.of_rows(rows).join(slices.of_groups(hits), ["digest", "slice"], "left")
    found = found.select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))
    # Verification: a group's texts, slice by slice, against copies of the one that stays. Texts move only if the hits' filter knows them.
    texts = told.may_have(base) if told.small else base
    sized = cut(slices.of_rows(texts).join(slices.of_groups(hits).hint("merge"), ["digest", "slice"]), "hit-texts")
    stay = sized.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "n").agg(F.min("text").alias("kept_text"))
    odd = cut(sized.join(slices.of_groups(stay).drop("n"), ["digest", "slice"]).where("text <> kept_text").select("id", "digest", "text"), "collisions")
    if odd.isEmpty():
        return found.select(F.col("id").alias("doc_id"), "digest", "keep_id", F.col("n").alias("group_size"))
    # Digests met by different bytes: their rows are grouped by the bytes.
    shared = odd.select("digest").distinct()
    told = base.join(shared, "digest", "left_semi")
    pick = F.min("id") if keep == "smallest" else F.max("id")
    apart = told.select("id", "digest", "text").join(told.groupBy("digest", "text").agg(pick.alias("keep_id"), F.count("*").alias("n")), ["digest", "text"])
    plain = found.join(shared, "digest", "left_anti")
    return plain.select("id", "digest", "keep_id", "n").union(apart.select("id", "digest", "keep_id", "n")).toDF("doc_id", "digest", "keep_id", "group_size")


def keepers(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose bytes a row that stays has; of rows that repeat id and text one stays."""
    stay = groups(docs, text, doc_id, keep).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    marked = cut(stay.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_times")), "stay")
    digest = fresh(docs, "_digest_")
    rows = docs.withColumn(digest, sha256(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = rows.join(marked, rows[doc_id].eqNullSafe(marked["_id"]) & (rows[digest] == marked["_digest"]), "left_semi")
    return (rows if marked.where("_times > 1").isEmpty() else rows.dropDuplicates([doc_id, digest])).drop(digest)

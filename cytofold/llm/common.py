"""What the operators of this subpackage share: input, cut lineage, counting words."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import ship

#: White space as the word contracts define it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow for functions of this package, which executors get first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"file://{os.path.join(tempfile.gettempdir(), 'cytofold-shared')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and a lost executor loses nothing.

    Tables stay until the folder is cleared, as other checkpoints do.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cytofold/{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the table is written: the shuffle files behind it go at once
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    while name in df.columns:
        name += "_"
    return name


def whole(text="text"):
    """Text with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id="doc_id", n=5):
    """crc32 of the id as text (a null one: empty), mod n: the split between rows to learn from and rows held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a group that one slice holds; groups that may be broadcast with their slices (of some 40 bytes each).
SLICE, MOST_LARGE = 1000, 200_000
#: Slices of every group where more groups than that have over SLICE rows.
EVERY = 32


class Slices:
    """How rows of large groups are dealt before they are joined, so that no group meets in one task.

    groups: (key, n, …) with the rows of each group that counts; rows of others are dealt by their key alone.
    """

    def __init__(self, groups: DataFrame, key: str, by: str):
        self.key, self.by = key, by
        self.large = groups.where(F.col("n") > SLICE).select(key, F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
        self.few = self.large.count() <= MOST_LARGE

    def of_rows(self, rows: DataFrame) -> DataFrame:
        """rows (key, by, …) with their slice, by a hash of the column by."""
        at = F.xxhash64(self.by, F.lit(7))
        if not self.few:
            return rows.withColumn("slice", F.pmod(at, F.lit(EVERY)).cast("int"))
        rows = rows.join(F.broadcast(self.large), self.key, "left")
        return rows.withColumn("slice", F.pmod(at, F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")

    def of_groups(self, groups: DataFrame) -> DataFrame:
        """groups (key, n, …) once for each slice of theirs."""
        n = F.ceil(F.col("n") / SLICE).cast("int") if self.few else F.lit(EVERY)
        return groups.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))

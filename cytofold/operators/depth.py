"""Per-position depth: lists, statistics, histograms, and calls that hit or miss known positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .counts import methylated


def position_depth(calls: DataFrame, cpgs: DataFrame, near: int = 0, n: str = "") -> DataFrame:
    """(chrom, pos, meth, unmeth) of every known position, zeros included; near: calls so far off count for the lowest one."""
    sums = calls.groupBy("chrom", "pos").agg(*methylated(n))
    known = cpgs.select("chrom", "pos").distinct()
    if near:
        probe = sums.withColumn("_p", F.explode(F.sequence(F.col("pos") - near, F.col("pos") + near)))
        hit = probe.join(known.withColumnRenamed("pos", "_p"), ["chrom", "_p"]).groupBy("chrom", "pos").agg(F.min("_p").alias("_p"), F.first("meth").alias("meth"), F.first("unmeth").alias("unmeth"))
        sums = hit.groupBy("chrom", F.col("_p").alias("pos")).agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))
    return known.join(sums, ["chrom", "pos"], "left").na.fill(0, ["meth", "unmeth"])


def statistics(depth: DataFrame, from_one: bool = False) -> DataFrame:
    """One row: positions, methylated and unmethylated ones, totals, least, most, mean, deviation, median and mode of the depth."""
    d = depth.withColumn("d", F.col("meth") + F.col("unmeth"))
    d = d.where("d > 0") if from_one else d
    histogram = d.groupBy("d").agg(F.count("*").alias("k"), F.count_if(F.col("meth") > 0).alias("pos_meth"), F.count_if(F.col("unmeth") > 0).alias("pos_unmeth"), F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))
    # One row for each depth: the rest is about a short table.
    order = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("k").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = histogram.withColumn("_n", n).withColumn("_upto", F.sum("k").over(order))
    low = F.min(F.when(F.col("_upto") * 2 >= F.col("_n"), F.col("d")))
    high = F.min(F.when(F.col("_upto") * 2 > F.col("_n"), F.col("d")))
    x, x2 = F.sum(F.col("d") * F.col("k")), F.sum(F.col("d") * F.col("d") * F.col("k"))
    k = F.sum("k")
    return ranked.agg(
        k.alias("positions"), F.sum("pos_meth").alias("pos_meth"), F.sum("pos_unmeth").alias("pos_unmeth"), F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"), F.min("d").alias("least"), F.max("d").alias("most"),
        F.try_divide(x.cast("double"), k.cast("double")).alias("mean"),
        F.sqrt(F.try_divide(x2 - F.try_divide((x * x).cast("double"), k.cast("double")), (k - 1).cast("double"))).alias("sd"),
        ((low + high) / 2).alias("median"), F.max_by("d", F.struct(F.col("k"), -F.col("d"))).alias("mode"),
    )


def histogram(depth: DataFrame, from_one: bool = False) -> DataFrame:
    """(depth, positions) from 0 (or 1) to the largest depth, empty ones included."""
    d = depth.select((F.col("meth") + F.col("unmeth")).alias("depth")).groupBy("depth").agg(F.count("*").alias("positions"))
    every = d.agg(F.max("depth").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(int(from_one)).cast("bigint"), F.greatest("m", F.lit(int(from_one))))).alias("depth"))
    return every.join(d, "depth", "left").na.fill(0, ["positions"])


def bars(histogram_rows: DataFrame, width: int = 50) -> DataFrame:
    """Text lines: depth, positions, a bar against the largest; runs of more than three empty depths become [...]."""
    whole, order = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("depth")
    rows = histogram_rows.withColumn("_max", F.max("positions").over(whole)).withColumn("_new", F.when((F.col("positions") == 0) & (F.lag("positions", 1, 1).over(order) == 0), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("_run")
    rows = rows.withColumn("_size", F.count("*").over(run)).withColumn("_first", F.min("depth").over(run))
    rows = rows.where((F.col("positions") > 0) | (F.col("_size") <= 3) | (F.col("depth") == F.col("_first")))
    skipped = (F.col("positions") == 0) & (F.col("_size") > 3)
    bar = F.repeat(F.lit("*"), F.coalesce(F.floor(F.try_divide(F.col("positions") * width, F.col("_max"))), F.lit(0)).cast("int"))
    return rows.select("depth", F.when(skipped, "[...]").otherwise(F.format_string("%d\t%d\t%s", F.col("depth"), F.col("positions"), bar)).alias("line"))


def hits(calls: DataFrame, cpgs: DataFrame, near: int = 0) -> DataFrame:
    """calls plus hit: whether a known position is there."""
    known = cpgs.select("chrom", F.explode(F.sequence(F.col("pos") - near, F.col("pos") + near)).alias("pos")).distinct().withColumn("_hit", F.lit(True))
    return calls.join(known, ["chrom", "pos"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")

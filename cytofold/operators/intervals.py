"""Joins of points and intervals. Intervals are 1-based and hold both ends.

Spark has no range join, so each side gets an equality key. An interval is put on the level whose cells, 8 to the power
of the level, are at least an eighth of its length, and into the at most 9 cells that it touches; a point looks into
one cell on each level that occurs. Long intervals so cost no more than short ones and no cell gets them all.
Levels that occur are at most eleven small numbers, which a subquery of the same plan finds.

Intervals that share no place with each other need neither levels nor a join: points and intervals go by block, in one
order, and a point belongs to the last interval that began.

Nearest neighbours: the best feature beyond a point is found inside the point's block and, for blocks beyond, from one
row for each block, so no task sees a whole chromosome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bases of a block; rows of a chromosome are ordered by block, and over its blocks goes one row for each.
BLOCK = 1 << 16
#: Bases of a block in which points meet intervals: the rows of one are held together.
NEAR = 1 << 13


def _level(length: Column) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / 3) - 1, F.lit(0)).cast("int")


def _cells(df: DataFrame, start: str, end: str) -> DataFrame:
    cell = F.shiftleft(F.lit(1).cast("bigint"), 3).cast("bigint")  # 8
    width = F.pow(cell.cast("double"), F.col("_level")).cast("bigint")
    leveled = df.withColumn("_level", _level(F.col(end) - F.col(start) + 1))
    return leveled.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def levels(intervals: DataFrame, start: str = "start", end: str = "end") -> Column:
    """The levels that occur, at most eleven, as an array: a subquery that runs with the plan that holds it."""
    return intervals.agg(F.collect_set(_level(F.col(end) - F.col(start) + 1)).alias("l")).scalar()


def apart(intervals: DataFrame, by: str = "chrom", start: str = "start", end: str = "end") -> bool:
    """Whether no two intervals share a place; a job over the intervals."""
    rows = intervals.where(F.col(start) <= F.col(end)).select(by, start, end)
    return beside(rows, end, "_prev", False, by, start, end).where(F.col("_prev") >= F.col(start)).isEmpty()


def _of_the_last(points: DataFrame, intervals: DataFrame, pos: str, by: str, start: str, end: str, block: int) -> DataFrame:
    """point_in_interval's inner rows for intervals that are apart. An interval is put into each block that it touches."""
    into = F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(F.col(end) / block))).alias("_block")
    kept = [c for c in intervals.columns if c != by]
    i = intervals.where(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.struct(*kept).alias("_held"), start, into)
    # A plain number orders both: an interval stands before the points at its start.
    i = i.select("_by", "_block", (F.greatest(F.col(start).cast("bigint"), F.col("_block") * block) * 2).alias("_at"), "_held")
    p = points.where(F.col(by).isNotNull() & F.col(pos).isNotNull())
    p = p.select(F.col(by).alias("_by"), F.floor(F.col(pos) / block).alias("_block"), (F.col(pos).cast("bigint") * 2 + 1).alias("_at"), *(c for c in points.columns if c != by))
    order = Window.partitionBy("_by", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = p.unionByName(i, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(order)).where((F.col("_at") % 2 != 0) & (F.col(pos) <= F.col(f"_held.{end}")))
    return rows.select(*(F.col("_by").alias(by) if c == by else F.col(c) for c in points.columns), *(F.col(f"_held.{c}").alias(c) for c in kept))


def point_in_interval(points: DataFrame, intervals: DataFrame, pos: str = "pos", by: str = "chrom", start: str = "start", end: str = "end", how: str = "inner", known_apart: bool = False, block: int = NEAR) -> DataFrame:
    """points with the columns of each interval that holds them; how: inner, left, left_semi or left_anti.

    Intervals keep their columns but by. Names must not occur on both sides. Empty intervals (start > end) hold nothing.
    known_apart: no two intervals share a place, which else is looked up.
    """
    real = intervals.where(F.col(start) <= F.col(end))
    if how == "inner" and (known_apart or apart(real, by, start, end)):
        return _of_the_last(points, real, pos, by, start, end, block)
    probe = points.withColumn("_at", F.explode(levels(real, start, end)))
    probe = probe.withColumn("_probe", F.struct(F.col("_at").alias("level"), F.floor(F.col(pos) / F.pow(F.lit(8.0), F.col("_at"))).alias("cell"))).drop("_at")
    cells = _cells(real, start, end).withColumnRenamed(by, "_by")
    on = (probe[by] == cells["_by"]) & (F.col("_probe.level") == F.col("_level")) & (F.col("_probe.cell") == F.col("_cell")) & F.col(pos).between(F.col(start), F.col(end))
    if how == "inner":
        return probe.join(cells, on).drop("_probe", "_by", "_level", "_cell")
    if how in ("left_semi", "left_anti"):
        hit = point_in_interval(points.select(by, pos).distinct(), intervals, pos, by, start, end).select(F.col(by).alias("_by"), F.col(pos).alias("_pos")).distinct()
        return points.join(hit, (points[by] == hit["_by"]) & (points[pos] == hit["_pos"]), how)
    if how == "left":
        hit = point_in_interval(points.select(by, pos).distinct(), intervals, pos, by, start, end).withColumnsRenamed({by: "_by", pos: "_pos"})
        return points.join(hit, (points[by] == hit["_by"]) & (points[pos] == hit["_pos"]), "left").drop("_by", "_pos")
    raise ValueError(how)


def overlaps(a: DataFrame, b: DataFrame, by: str = "chrom") -> DataFrame:
    """Pairs of intervals (start, end) and (b_start, b_end) that share a place, each once.

    Either b starts inside a, or a starts inside b behind b's start.
    """
    inside = point_in_interval(b, a, pos="b_start", by=by)
    held = point_in_interval(a, b, pos="start", by=by, start="b_start", end="b_end").where("b_start < start")
    columns = [by, *(c for c in a.columns if c != by), *(c for c in b.columns if c != by)]
    return inside.select(*columns).unionByName(held.select(*columns))


def overlap_length(s: Column, e: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(e, hi) - F.greatest(s, lo) + 1, F.lit(0))


def best_beyond(points: DataFrame, features: DataFrame, at: str, anchor: str, score: Column, after: bool, by: str = "chrom", into: str = "best", block: int = BLOCK) -> DataFrame:
    """points plus into: of the features whose anchor lies after (or before) the point, a struct (score, feat_no) that is smallest.

    features needs by, anchor and feat_no; equal scores go to the smaller feat_no. Null where there is none.
    """
    sign = 1 if after else -1
    # What is found depends on (by, at) alone, and is joined back by them. "Before" is "after" with the axis turned round.
    p = points.select(F.col(by).alias("_by"), F.col(at).cast("bigint").alias("_place")).where("_by is not null and _place is not null").distinct()
    p = p.select("_by", (F.col("_place") * sign).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<score:double,feat_no:bigint>").alias("_best"))
    f = features.select(F.col(by).alias("_by"), (F.col(anchor).cast("bigint") * sign).alias("_at"), F.lit(0).alias("_kind"), F.struct(score.cast("double").alias("score"), F.col("feat_no").cast("bigint").alias("feat_no")).alias("_best"))
    every = p.unionByName(f).withColumn("_block", F.floor(F.col("_at") / block))
    # Features at the point's own place aren't beyond it: they sort after it when the window runs from the far end.
    far = Window.partitionBy("_by", "_block").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    inner = every.withColumn("_near", F.min("_best").over(far)).where("_kind = 1")
    sums = f.withColumn("_block", F.floor(F.col("_at") / block)).groupBy("_by", "_block").agg(F.min("_best").alias("_least"))
    blocks = p.select("_by", F.floor(F.col("_at") / block).alias("_block")).distinct().join(sums, ["_by", "_block"], "full")
    beyond = Window.partitionBy("_by").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.min("_least").over(beyond)).select("_by", "_block", "_carry")
    best = inner.join(carried, ["_by", "_block"], "left").select("_by", (F.col("_at") * sign).alias("_place"), F.least("_near", "_carry").alias(into))
    return points.join(best, (points[by] == best["_by"]) & (points[at] == best["_place"]), "left").drop("_by", "_place")


def _in_blocks(df: DataFrame, by: str, start: str, end: str, block: int) -> tuple[DataFrame, Window]:
    """df (rows with a chromosome and a start) with their block, and the order of a block's rows."""
    rows = df.where(F.col(by).isNotNull() & F.col(start).isNotNull()).withColumn("_block", F.floor(F.col(start) / block))
    return rows, Window.partitionBy(by, "_block").orderBy(start, end)


def with_runs(df: DataFrame, continues: Callable[[Column], Column], carry: tuple = ("end",), by: str = "chrom", start: str = "start", end: str = "end", into: str = "_run", block: int = BLOCK) -> DataFrame:
    """df with the number of each row's run on its chromosome, in order of start and end.

    A row goes on with the run of the row before if continues(that row's struct of carry) holds. Rows are looked at by
    block; over a chromosome's blocks go one row for each block. Rows without a chromosome or start are left out.
    """
    rows, order = _in_blocks(df, by, start, end, block)
    kept = F.struct(*carry)
    rows = rows.withColumn("_prev", F.lag(kept).over(order))
    apart = F.when(F.col("_prev").isNotNull() & ~F.coalesce(continues(F.col("_prev")), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_local", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(F.col(start).alias("a"), F.col(end).alias("b"))
    sums = rows.groupBy(by, "_block").agg(F.min_by(F.struct(*dict.fromkeys((start, *carry))), place).alias("_first"), F.max_by(kept, place).alias("_last"), F.max("_local").alias("_within"))
    along = Window.partitionBy(by).orderBy("_block")
    edges = sums.withColumn("_prev", F.lag("_last").over(along)).select(by, "_block", "_prev", "_within", "_first.*")
    edges = edges.withColumn("_opens", F.when(F.col("_prev").isNotNull() & F.coalesce(continues(F.col("_prev")), F.lit(False)), 0).otherwise(1))
    done = F.sum(F.col("_opens") + F.col("_within")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_within")
    return rows.join(edges.select(by, "_block", done.alias("_done")), [by, "_block"]).withColumn(into, F.col("_done") + F.col("_local")).drop("_block", "_prev", "_local", "_done")


def merge_runs(df: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", sums: tuple = ()) -> DataFrame:
    """Runs of adjacent intervals (start = end before + 1) as one each; sums: columns that are added up."""
    runs = with_runs(df, lambda prev: F.col(start) == prev[end] + 1, (end,), by, start, end)
    return runs.groupBy(by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"), *(F.sum(c).alias(c) for c in sums)).drop("_run")


def gaps(df: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """Stretches between one interval and the next; none before the first and behind the last."""
    rows, order = _in_blocks(df, by, start, end, block)
    place = F.struct(F.col(start).alias("a"), F.col(end).alias("b"))
    inner = rows.select(by, F.col(end).alias("_end"), F.lead(start).over(order).alias("_next"))
    sums = rows.groupBy(by, "_block").agg(F.min(start).alias("_first"), F.max_by(end, place).alias("_end"))
    between = sums.select(by, "_end", F.lead("_first").over(Window.partitionBy(by).orderBy("_block")).alias("_next"))
    return inner.union(between).select(by, (F.col("_end") + 1).alias(start), (F.col("_next") - 1).alias(end)).where(F.col(start) <= F.col(end))


def rebased(df: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """Plus new_start and new_end: the intervals put end to end from 1."""
    rows, order = _in_blocks(df, by, start, end, block)
    size = F.col(end) - F.col(start) + 1
    rows = rows.withColumn("_upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(by, "_block").agg(F.sum(size).alias("_size"))
    carried = sums.select(by, "_block", (F.sum("_size").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_done"))
    made = rows.join(carried, [by, "_block"]).withColumn("new_end", F.col("_done") + F.col("_upto"))
    return made.withColumn("new_start", F.col("new_end") - size + 1).select(*df.columns, "new_start", "new_end")


def beside(df: DataFrame, value: str, into: str, after: bool, by: str = "chrom", start: str = "start", end: str = "end", number: str | None = None, block: int = BLOCK) -> DataFrame:
    """df with into: value (never null) of the row before, or after, in order of start and end; number: the row's place from 0."""
    rows, order = _in_blocks(df, by, start, end, block)
    place = F.struct(F.col(start).alias("a"), F.col(end).alias("b"))
    near, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    rows = rows.withColumn("_near", near(value).over(order)).withColumn("_local", F.row_number().over(order))
    sums = rows.groupBy(by, "_block").agg(edge(value, place).alias("_edge"), F.count("*").alias("_n"))
    along = Window.partitionBy(by).orderBy("_block")
    carried = sums.select(by, "_block", near("_edge").over(along).alias("_edge"), (F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_done"))
    made = rows.join(carried, [by, "_block"]).withColumn(into, F.coalesce("_near", "_edge"))
    named = [(F.col("_done") + F.col("_local") - 1).cast("bigint").alias(number)] if number else []
    return made.select(*df.columns, into, *named)


def adjacent(prev_end: Column, start: Column) -> Column:
    return start == prev_end + 1

"""Results as text: the lines of each format, and writers. Typed tables are the real results; these are for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import fixed


def chromosome(name: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), name) if prefix else name


def bin_prefix(prefix: str = "", hits: bool = True) -> list[Column]:
    """Columns chr, start, end, len, cpgs and, with hits, the bin's hits and hits a CpG (-1.00 without CpGs)."""
    per = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.when(F.col("n_cpg") > 0, F.col("n_cpg")).cast("double")), F.lit(-1.0))
    base = [chromosome(F.col("chrom"), prefix).alias("chr"), "start", "end", (F.col("end") - F.col("start") + 1).alias("len"), F.col("n_cpg").alias("cpgs")]
    return [F.col(c) if isinstance(c, str) else c for c in base] + ([F.col("hits"), fixed(per, 2).alias("hits_per_cpg")] if hits else [])


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns))


def pair_line(counts: bool = False) -> Column:
    """Proportions to 4 places, the fold to 2, the probability as %g; counts: each sample's m+/u- behind."""
    cells = [F.concat(F.col(f"meth_{i}").cast("string"), F.lit("+/"), F.col(f"unmeth_{i}").cast("string"), F.lit("-")) for i in (1, 2)] if counts else []
    return F.concat_ws("\t", fixed(F.col("prop_1"), 4), fixed(F.col("prop_2"), 4), F.coalesce(fixed(F.col("fold"), 2), F.lit("-")), F.col("greater"), general(F.col("p")), *cells)


def general(x: Column) -> Column:
    """%g with six digits."""
    size = F.floor(F.log10(F.abs(x)))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(x, 10)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.format_string("%.5e", x), "e"), 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.element_at(F.split(F.format_string("%.5e", x), "e"), 2)
    rounded = F.round(x * F.pow(F.lit(10.0), 5 - size)) / F.pow(F.lit(10.0), 5 - size)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").when((size < -4) | (size >= 6), F.concat(short, F.lit("e"), power)).otherwise(plain)


def chi_text() -> Column:
    return F.format_string("Chi_%.4f_%ddf", "chi", "df")


def anova_text() -> Column:
    return F.format_string("F(%d,%d)=%.2f", "df1", "df2", "f")


def fragment_lines() -> Column:
    """chr<tab>a..b (n bp) CpG: k."""
    return F.format_string("%s\t%d..%d (%d bp) CpG: %d", F.col("chrom"), F.col("start"), F.col("end"), F.col("end") - F.col("start") + 1, F.col("n_cpg"))


def reduced_fasta(fragments: DataFrame, width: int = 60) -> DataFrame:
    """(chrom, header, lines): a chromosome's fragments (start, seq) joined in order, as FASTA lines of one width."""
    made = fragments.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda f: f["seq"]), "").alias("seq"), F.count("*").alias("n"))
    header = F.format_string(">%srr reduced representation: %d bp in %d fragments", F.col("chrom"), F.length("seq"), F.col("n"))
    return made.select("chrom", header.alias("header"), F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1)).alias("lines"))


def sequence_record(kind: str, name: Column, seq: Column, title: Column | str = "", width: int = 60) -> Column:
    """A sequence as a record of fasta, nbrf, staden, gcg, molgen or raw text, as files.sequences() reads it."""
    from ..functions.sequences import gcg_checksum

    lines = F.array_join(F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1)), "\n")
    title = F.lit(title) if isinstance(title, str) else title
    parts = {
        "fasta": (F.lit(">"), name, F.lit("\n"), lines),
        "nbrf": (F.lit(">DL;"), name, F.lit("\n"), title, F.lit("\n"), lines, F.lit("*")),
        "staden": (F.lit("<-"), name, F.lit("->"), lines),
        "gcg": (name, F.format_string("  Length: %d  Check: %d  ..", F.length(seq), gcg_checksum(seq)), F.lit("\n"), lines),
        "molgen": (F.lit(";"), name, F.lit("\n"), lines),
        "raw": (lines,),
    }
    return F.concat(*parts[kind], F.lit("\n"))


def seqmonk(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, start, line): bins re-based end to end, with hits."""
    from ..operators.intervals import rebased

    rows = rebased(bins.select("chrom", "bin_id", "start", "end")).join(counts.groupBy("chrom", "bin_id").agg(F.sum(F.col("meth") + F.col("unmeth")).alias("hits")), ["chrom", "bin_id"], "left").na.fill(0, ["hits"])
    return rows.select("chrom", "start", tabbed("chrom", "new_start", "new_end", "hits").alias("line"))


def cpg_detail(cpg_counts: DataFrame, only_hit: bool = False) -> DataFrame:
    """(chrom, bin_id, sample_no, line): Sample i: [Stray: m+u-] pos:m+u- …"""
    cell = F.concat(F.col("meth").cast("string"), F.lit("+"), F.col("unmeth").cast("string"), F.lit("-"))
    text = F.when(F.col("slot") == 0, F.concat(F.lit("Stray:"), cell)).otherwise(F.concat(F.col("pos").cast("string"), F.lit(":"), cell))
    made = cpg_counts.groupBy("chrom", "bin_id", "sample_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", text.alias("t")))), lambda x: x["t"]), " ").alias("_t"), F.sum(F.col("meth") + F.col("unmeth")).alias("_n"))
    made = made.where("_n > 0") if only_hit else made
    return made.select("chrom", "bin_id", "sample_no", F.format_string("Sample %d: %s", F.col("sample_no"), F.col("_t")).alias("line"))


def fastq_text(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    return F.concat_ws("\n", header, seq, plus, qual)


def four_to_one(lines: DataFrame, sep: str = "~") -> DataFrame:
    """Lines (line_no, value), four at a time, joined: (record, value)."""
    record = F.floor((F.col("line_no") - 1) / 4)
    made = lines.groupBy(record.alias("record")).agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("x"))
    return made.select("record", F.array_join(F.transform("x", lambda v: v["value"]), sep).alias("value"))


def feature_lines(features: DataFrame) -> DataFrame:
    """(feat_no, line) for each segment of each feature: chromosome, type, id, strand, its span and the segment's."""
    rows = features.withColumn("_s", F.explode_outer("segments")) if "segments" in features.columns else features.withColumn("_s", F.struct("start", "end"))
    return rows.select("feat_no", tabbed("chrom", "type", "id", "strand", "start", "end", F.col("_s.start"), F.col("_s.end")).alias("line"))


def chromosome_lines(features: DataFrame) -> DataFrame:
    """(line): each chromosome's id and its number of features."""
    return features.groupBy("chrom").agg(F.count("*").alias("n")).select(tabbed("chrom", "n").alias("line"))


def annotated(rows: DataFrame) -> DataFrame:
    """(region_no, line): kept tokens, distance, relation, name, span, biotype; - where there is nothing."""
    name = F.coalesce("name", "id", F.lit("<No Name>")) if {"name", "id"} <= set(rows.columns) else F.lit("<No Name>")
    span = F.concat_ws("-", "f_start", "f_end")
    return rows.select("region_no", tabbed(F.concat_ws("\t", "tokens"), "score", "relation", name, span).alias("line"))


def write_lines(lines: DataFrame, path: str, column: str = "line", order: str | None = None, compression: str | None = None) -> None:
    """One text column as files; order: sorted by it, files in its order."""
    rows = lines.orderBy(order) if order else lines
    writer = rows.select(column).write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, compression: str | None = None) -> None:
    w = df.write.option("sep", sep).option("header", header).option("nullValue", "-")
    (w.option("compression", compression) if compression else w).csv(path)


def numbered(df: DataFrame, by: list[str], order: list[str], into: str = "no") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

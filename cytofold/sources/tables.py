"""Text tables: calls, counts, alignments, mapper output, bins, regions, annotation lines.

Each reader takes lines, a DataFrame with a column value (spark.read.text gives one), so files of any store and rows of
any table are read alike. read_lines adds the file's name and, where asked for, a running number in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.sizes import small


def read_lines(spark: SparkSession, *paths: str, numbered: bool = False) -> DataFrame:
    """(file, value[, line_no]); numbers follow the order of files by path and of lines in them, without gathering them."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    if not numbered:
        return lines.drop("_block")
    # A split's lines have running ids; splits are put in the order of files and of places in them.
    ids = lines.withColumn("_id", F.monotonically_increasing_id())
    first = ids.groupBy("file", "_block").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))  # one row for each split
    before = first.select("file", "_block", (F.sum("n").over(Window.orderBy("file", "_block")) - F.col("n") - F.col("_first") + 1).alias("_add"))
    return ids.join(small(before), ["file", "_block"]).select("file", "value", (F.col("_id") + F.col("_add")).alias("line_no"))


def fields(value: str = "value", sep: str = r"\s+") -> Column:
    return F.split(F.trim(F.col(value)) if sep == r"\s+" else F.col(value), sep)


def known(rows: DataFrame, chromosomes: DataFrame | None, only: str | None = None) -> DataFrame:
    """Rows of listed chromosomes, and of one only if asked for; the list is short."""
    if chromosomes is not None:
        rows = rows.join(small(chromosomes.select("chrom").distinct()), "chrom", "left_semi")
    return rows.where(F.col("chrom") == only) if only is not None else rows


def calls(lines: DataFrame, chromosomes: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(chrom, pos, meth) of lines chr pos sign: + is methylated, anything else isn't; other lines are skipped."""
    x = lines.withColumn("_f", fields()).where("size(_f) = 3")
    made = x.select(*(c for c in lines.columns if c != "value"), F.element_at("_f", 1).alias("chrom"), F.expr("try_cast(_f[1] AS INT)").alias("pos"), F.element_at("_f", 3).startswith("+").alias("meth")).where("pos is not null")
    return known(made, chromosomes, only)


def count_list(lines: DataFrame, chromosomes: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(chrom, pos, meth, n) of lines chr pos strand context nC nT with a CG context: two rows with counts, on - one base before."""
    x = lines.withColumn("_f", fields()).where("size(_f) >= 6 and startswith(_f[3], 'CG')")
    pos = F.expr("try_cast(_f[1] AS INT)") - F.when(F.element_at("_f", 3) == "-", 1).otherwise(0)
    n = lambda i: F.expr(f"try_cast(_f[{i}] AS BIGINT)")
    both = F.explode(F.array(F.struct(F.lit(True).alias("meth"), n(4).alias("n")), F.struct(F.lit(False).alias("meth"), n(5).alias("n"))))
    made = x.select(F.element_at("_f", 1).alias("chrom"), pos.alias("pos"), both.alias("_c")).select("chrom", "pos", "_c.meth", "_c.n").where("n > 0 and pos is not null")
    return known(made, chromosomes, only)


SAM = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")  # fixed values
_SAM_INT = {"flag", "pos", "mapq", "pnext", "tlen"}


def sam(lines: DataFrame, longest: int | None = None, chromosomes: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """Alignments and their tags; @ lines are skipped; longest: bases that are kept of a read."""
    x = lines.where("not startswith(value, '@') and length(value) > 0").withColumn("_f", F.split("value", "\t"))
    columns = [F.expr(f"try_cast(_f[{i}] AS INT)").alias(n) if n in _SAM_INT else F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(SAM)]
    made = x.where(f"size(_f) >= {len(SAM)}").select(*columns, F.expr(f"slice(_f, {len(SAM) + 1}, greatest(size(_f) - {len(SAM)}, 0))").alias("tags"))
    if longest is not None:
        made = made.withColumn("seq", F.substring("seq", 1, longest))
    return known(made, chromosomes, only)


def sam_text(rows: DataFrame) -> Column:
    """A line of an alignment's columns."""
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in SAM), *([F.col("tags")] if "tags" in rows.columns else []))


def mapper(lines: DataFrame, kind: str) -> DataFrame:
    """(name, chrom, start, end, strand, seq) of rmapbs_bed (0-based starts), bsmap_102 or bsmap_12 lines."""
    # Where the columns are (fixed values).
    at = {"rmapbs_bed": (6, 3, 0, 1, 5, None), "bsmap_102": (9, 0, 3, 4, 5, 1), "bsmap_12": (11, 0, 4, 5, 6, 1)}
    n, name, chrom, start, strand, seq = at[kind]
    x = lines.withColumn("_f", fields()).where(f"size(_f) >= {n}")
    get = lambda i: F.get("_f", F.lit(i))
    s = get(start).try_cast("int")
    end = get(2).try_cast("int") if seq is None else s + F.length(get(seq)) - 1
    return x.select(*(c for c in lines.columns if c != "value"), get(name).alias("name"), get(chrom).alias("chrom"), s.alias("start"), end.alias("end"), get(strand).alias("strand"), (get(seq) if seq is not None else F.lit(None).cast("string")).alias("seq"))


def intervals(lines: DataFrame) -> DataFrame:
    """(chrom, start, end) of lines that begin so: user's bins, excluded regions."""
    x = lines.where("not startswith(ltrim(value), '#') and length(trim(value)) > 0").withColumn("_f", fields())
    return x.where("size(_f) >= 3").select(*(c for c in lines.columns if c != "value"), F.get("_f", F.lit(0)).alias("chrom"), F.expr("try_cast(_f[1] AS INT)").alias("start"), F.expr("try_cast(_f[2] AS INT)").alias("end"))


def reduced_positions(lines: DataFrame) -> DataFrame:
    """(chrom, start, end, n_cpg) of lines chr<tab>a..b (n bp) CpG: k."""
    pattern = r"^(\S+)\s+(\d+)\.\.(\d+)\s+\(\d+ bp\)\s+CpG:\s*(\d+)"
    get = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.regexp_like("value", F.lit(pattern))).select(get(1).alias("chrom"), get(2).cast("int").alias("start"), get(3).cast("int").alias("end"), get(4).cast("int").alias("n_cpg"))


def reduced_positions_text() -> Column:
    return F.format_string("%s\t%d..%d (%d bp) CpG: %d", "chrom", "start", "end", F.col("end") - F.col("start") + 1, "n_cpg")


def regions(lines: DataFrame, keep: int = 9, header: bool = False) -> DataFrame:
    """(line_no, tokens, chrom, start, end) of any table whose first columns are those; fails on fewer than three.

    keep: tokens that are kept, missing ones as -. header: lines that begin with # are skipped.
    """
    x = lines.where("length(trim(value)) > 0")
    x = (x.where("not startswith(value, '#')") if header else x).withColumn("_f", fields())
    x = x.withColumn("_f", F.when(F.size("_f") >= 3, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("a region has less than three columns: "), F.col("value")))))
    padded = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.coalesce(F.get("_f", i), F.lit("-")))
    return x.select("line_no", padded.alias("tokens"), F.get("_f", F.lit(0)).alias("chrom"), F.get("_f", F.lit(1)).cast("int").alias("start"), F.get("_f", F.lit(2)).cast("int").alias("end"))


def attribute(name: str, attrs: str = "attrs") -> Column:
    """The value of key "value" in a GTF attribute text, null if it isn't there."""
    found = F.regexp_extract(attrs, f'(?:^|; *){name} "([^"]*)"', 1)
    return F.when(F.regexp_like(F.col(attrs), F.lit(f'(?:^|; *){name} "')), found)


GTF_TYPES = ("exon", "CDS", "start_codon", "stop_codon", "transcript", "lncRNA")  # fixed values
GTF_IDS = ("transcript_name", "transcript_id", "gene_name")


def _nine(lines: DataFrame) -> DataFrame:
    x = lines.where("not startswith(value, '#') and length(value) > 0").withColumn("_f", F.split("value", "\t"))
    x = x.withColumn("_f", F.when(F.size("_f") == 9, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("a line hasn't nine fields: "), F.col("value")))))
    get = lambda i: F.get("_f", F.lit(i))
    return x.select("line_no", get(0).alias("chrom"), get(2).alias("type"), get(3).cast("int").alias("start"), get(4).cast("int").alias("end"), get(6).alias("strand"), get(8).alias("attrs"))


def gtf(lines: DataFrame, types: tuple = GTF_TYPES, ids: tuple = GTF_IDS, biotypes: tuple | None = ("protein_coding",), compat: bool = False) -> DataFrame:
    """(chrom, feat_no, type, id, biotype, strand, start, end, segments): one feature for each id and type.

    The id is the first of the attributes that is there; segments are all of its lines' spans. compat: only the first
    line of an id and type counts.
    """
    rows = _nine(lines).where(F.col("type").isin(*types)).withColumn("id", F.coalesce(*(attribute(a) for a in ids))).withColumn("biotype", F.coalesce(attribute("gene_type"), attribute("gene_biotype")))
    rows = rows.where("id is not null")
    if biotypes is not None:
        rows = rows.where(F.col("biotype").isin(*biotypes))
    spans = F.array_sort(F.collect_list(F.struct("line_no", "start", "end", "strand")))
    made = rows.groupBy("chrom", "id", "type").agg(F.min("line_no").alias("feat_no"), F.min_by("biotype", "line_no").alias("biotype"), F.min_by("strand", "line_no").alias("strand"), spans.alias("_s"))
    if compat:
        made = made.withColumn("_s", F.slice("_s", 1, 1))
    segments = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["strand"].alias("strand")))
    return made.select("chrom", "feat_no", "type", "id", "biotype", "strand", F.array_min("_s.start").alias("start"), F.array_max("_s.end").alias("end"), segments.alias("segments"))


def with_genes(features: DataFrame) -> DataFrame:
    """Exon features become mRNAs, each behind a gene of its extent; a CDS with the mRNA's id is its child."""
    exons = features.where("type = 'exon'")
    mrna = exons.withColumn("type", F.lit("mRNA")).withColumn("part", F.lit(1)).withColumn("parent_id", F.col("id"))
    gene = exons.withColumn("type", F.lit("gene")).withColumn("part", F.lit(0)).withColumn("parent_id", F.lit(None).cast("string"))
    rest = features.where("type <> 'exon'").withColumn("part", F.lit(2)).withColumn("parent_id", F.when(F.col("type") == "CDS", F.col("id")))
    return mrna.unionByName(gene).unionByName(rest)


def _fasta_mark(lines: DataFrame) -> DataFrame:
    """lines plus _mark, the number of the ##FASTA line of their file, null if there is none."""
    by = ["file"] if "file" in lines.columns else []
    mark = lines.where("startswith(value, '##FASTA')").groupBy(*by).agg(F.min("line_no").alias("_mark"))
    return lines.join(small(mark), by, "left") if by else lines.crossJoin(F.broadcast(mark))  # one row


def gff3(lines: DataFrame, types: tuple = ("gene", "mRNA", "CDS")) -> DataFrame:
    """(chrom, feat_no, type, id, name, parent_id, strand, start, end, quals) of lines with a Name or ID; values are URL-decoded.

    What follows a line ##FASTA are sequences, which gff3_sequences reads.
    """
    from ..functions.sequences import url_decoded

    rows = _nine(_fasta_mark(lines).where("_mark is null or line_no < _mark")).where(F.col("type").isin(*types))
    quals = F.transform_values(F.str_to_map("attrs", F.lit(";"), F.lit("=")), lambda k, v: url_decoded(v))
    rows = rows.withColumn("quals", quals)
    get = lambda k: F.try_element_at("quals", F.lit(k))
    return rows.select("chrom", F.col("line_no").alias("feat_no"), "type", get("ID").alias("id"), get("Name").alias("name"), get("Parent").alias("parent_id"), "strand", "start", "end", "quals").where("id is not null or name is not null")


def gff3_sequences(lines: DataFrame) -> DataFrame:
    """(name, seq) of the sequences behind ##FASTA."""
    rows = _fasta_mark(lines).where("line_no > _mark")
    by = Window.partitionBy(*(["file"] if "file" in lines.columns else []))
    head = F.max(F.when(F.col("value").startswith(">"), F.col("line_no"))).over(by.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    made = rows.withColumn("_head", head).where("_head is not null").groupBy("_head").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_l"))
    return made.select(F.trim(F.expr("substring(_l[0].value, 2)")).alias("name"), F.array_join(F.transform(F.expr("slice(_l, 2, size(_l))"), lambda x: F.trim(x["value"])), "").alias("seq"))


def with_parents(features: DataFrame) -> DataFrame:
    """Children with their parents' type and span."""
    p = features.select(F.col("chrom").alias("_c"), F.col("id").alias("_id"), F.col("type").alias("parent_type"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    return features.join(p, (features.chrom == F.col("_c")) & (features.parent_id == F.col("_id"))).drop("_c", "_id")


def chromosome_info(text: str) -> list[tuple[str, str]]:
    """(id, path) of an info file's lines; # starts a comment, quotes hold blanks."""
    import shlex

    return [(p[0], p[1] if len(p) > 1 else "") for p in (shlex.split(line, comments=True) for line in text.splitlines()) if p]


def chromosome_names(n: int, sex: bool = True) -> list[str]:
    """1 to n - 2, X and Y, or 1 to n."""
    return [*map(str, range(1, n - 1)), "X", "Y"] if sex and n >= 2 else [*map(str, range(1, n + 1))]


def catalogue(spark: SparkSession, prefix: str = "", suffix: str = ".fa", n: int = 24, info: str | None = None) -> DataFrame:
    """(chrom, ord, path): by an info file's text, or by names put between a prefix and .fa."""
    rows = chromosome_info(info) if info is not None else [(c, f"{prefix}{c}{suffix}") for c in chromosome_names(n)]
    return spark.createDataFrame([(c, i, p) for i, (c, p) in enumerate(rows)], "chrom string, ord int, path string")


def sites(text: str) -> list[str]:
    """Restriction sites, one a line, ^ where the cut is."""
    return [s.strip() for s in text.splitlines() if s.strip()]


def adaptors(text: str, from_five: int = 0) -> list[str]:
    """Adaptors of a list or of FASTA records, cut at the 5' end, each once and in order."""
    lines = [line.strip() for line in text.splitlines()]
    if any(line.startswith(">") for line in lines):
        found = ["".join(part.split("\n")[1:]) for part in "\n".join(lines).split(">")[1:]]
    else:
        found = [line for line in lines if line and not line.startswith("#")]
    return [a for a in dict.fromkeys(x.upper()[from_five:] for x in found) if a]


def format_of(first_line: str) -> str:
    """An annotation file's format by its first line."""
    for sign, kind in (("LOCUS", "genbank"), ("ID   ", "embl"), ("##gff-version", "gff3"), ("##description", "gtf"), ("#!genome", "gtf")):
        if first_line.startswith(sign):
            return kind
    return "gtf" if first_line.count("\t") == 8 and '"' in first_line else "gff3" if first_line.count("\t") == 8 else "unknown"

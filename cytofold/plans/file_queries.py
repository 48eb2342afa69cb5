"""Entries for sources and text formats over lines and files made of the driver's tables, each beside its SQL."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import bins as bins_
from ..sources import files, sinks, tables
from . import queries as q
from .queries import AS_BASES, CALLS, CPGS, FEATURES, LETTERS, query

SAM_SQL = "s AS (SELECT l_orderkey || '_' || l_linenumber AS qname, (l_partkey % 2 * 16)::INT AS flag, 'c' || l_suppkey % 7 AS chrom, (l_partkey + 1)::INT AS pos, (l_linenumber * 5)::INT AS mapq, (l_quantity::INT) || 'M' AS cigar, '*' AS rnext, 0::INT AS pnext, 0::INT AS tlen, md5(l_partkey::VARCHAR) AS seq, '*' AS qual, ['NM:i:' || l_linenumber, 'XX:Z:' || l_returnflag] AS tags FROM lineitem)"


def v_sam(spark, d) -> DataFrame:
    li = q.read(spark, d, "lineitem")
    n = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", F.concat_ws("_", n("l_orderkey"), n("l_linenumber")), (F.col("l_partkey") % 2 * 16).cast("string"), F.concat(F.lit("c"), (F.col("l_suppkey") % 7).cast("string")), (F.col("l_partkey") + 1).cast("string"), (F.col("l_linenumber") * 5).cast("string"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.md5(n("l_partkey").cast("binary")), F.lit("*"), F.concat(F.lit("NM:i:"), n("l_linenumber")), F.concat(F.lit("XX:Z:"), F.col("l_returnflag")))
    heads = spark.createDataFrame([("@HD\tVN:1.0",), ("@SQ\tSN:c1",)], "value string")
    return li.select(line.alias("value")).unionByName(heads)


@query(f"WITH {SAM_SQL} SELECT qname, flag, chrom, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, array_to_string(tags, ' ') AS tags FROM s")
def parsed_sam(spark, d):
    return tables.sam(v_sam(spark, d)).withColumn("tags", F.array_join("tags", " "))


@query(f"WITH {SAM_SQL} SELECT qname, substr(seq, 1, 10) AS seq FROM s WHERE chrom = 'c3'")
def short_sam(spark, d):
    """Reads cut to a longest length, of one chromosome."""
    return tables.sam(v_sam(spark, d), longest=10, only="c3").select("qname", "seq")


@query(f"WITH {SAM_SQL} SELECT md5(concat_ws(chr(9), qname, flag, chrom, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, array_to_string(tags, chr(9)))) AS digest FROM s")
def sam_lines(spark, d):
    """Alignments written as lines again."""
    rows = tables.sam(v_sam(spark, d))
    return rows.select(F.md5(tables.sam_text(rows).cast("binary")).alias("digest"))


def _bam(rows: pd.DataFrame, names: list[str]) -> bytes:
    """A BAM file's content (unpacked) of rows pos, flag, ref, seq."""
    out = [b"BAM\1", struct.pack("<i", 0), struct.pack("<i", len(names))]
    out += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1 << 30) for n in names]
    for r in rows.itertuples():
        name = f"r{r.k}".encode() + b"\0"
        codes = [files.BASES.index(c) for c in r.seq] + [0] * (len(r.seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        aux = b"NMi" + struct.pack("<i", r.k % 9)
        body = struct.pack("<iiBBHHHiiii", r.ref, r.pos - 1, len(name), 30, 0, 1, r.flag, len(r.seq), -1, -1, 0) + name + struct.pack("<I", len(r.seq) << 4) + packed + bytes([20] * len(r.seq)) + aux
        out.append(struct.pack("<i", len(body)) + body)
    return b"".join(out)


@query("""SELECT 'r' || c_custkey AS qname, (c_custkey % 2 * 16)::INT AS flag, 'chr' || c_nationkey % 7 AS chrom, (c_custkey * 10 + 1)::INT AS pos, (c_custkey % 20 + 5) || 'M' AS cigar,
    substr(repeat(translate(substr(md5(c_custkey::VARCHAR), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4), 1, (c_custkey % 20 + 5)::INT) AS seq, repeat('5', (c_custkey % 20 + 5)::INT) AS qual, 'i:' || c_custkey % 9 AS nm FROM customer""")
def parsed_bam(spark, d):
    """A file for each chromosome, made and read."""
    n = F.col("c_custkey") % 20 + 5
    seq = F.substring(F.repeat(F.translate(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT"), 4), F.lit(1), n.cast("int"))
    rows = q.read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("k"), (F.col("c_nationkey") % 7).cast("int").alias("ref"), (F.col("c_custkey") * 10 + 1).cast("int").alias("pos"), (F.col("c_custkey") % 2 * 16).cast("int").alias("flag"), seq.alias("seq"))
    names = [f"chr{i}" for i in range(7)]
    made = rows.groupBy("ref").applyInPandas(lambda p: pd.DataFrame({"path": [f"{p['ref'].iloc[0]}.bam"], "content": [_bam(p, names)]}), "path string, content binary")
    return files.parsed(made, "bam").select("qname", "flag", "chrom", "pos", "cigar", "seq", "qual", F.try_element_at("aux", F.lit("NM")).alias("nm"))


def content(*parts: Column) -> Column:
    return F.concat(*parts).cast("binary")


def wrapped(seq: Column) -> Column:
    return F.array_join(F.regexp_extract_all(seq, F.lit("(.{1,60})"), F.lit(1)), "\n")


LETTERED = f"WITH r AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{AS_BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"


def v_lettered(spark, d) -> DataFrame:
    return q.v_reads(spark, d).select("doc_id", F.regexp_replace("seq", "[^ACGT]", "").alias("seq"))


@query(f"{LETTERED} SELECT doc_id::VARCHAR AS path, 0::INT AS record, 'doc ' || doc_id AS name, md5(seq) AS digest FROM r UNION ALL SELECT doc_id::VARCHAR, 1, 'back', md5(reverse(seq)) FROM r")
def parsed_fasta(spark, d):
    """Two records a file, lines of sixty bases."""
    made = v_lettered(spark, d).select(F.col("doc_id").cast("string").alias("path"), content(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), wrapped(F.col("seq")), F.lit("\n>back\n"), wrapped(F.reverse("seq")), F.lit("\n")).alias("content"))
    return files.parsed(made, "fasta").select("path", "record", "name", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"{LETTERED} SELECT doc_id::VARCHAR AS path, kind, CASE kind WHEN 'raw' THEN '' ELSE 'n' || doc_id END AS name, md5(seq) AS digest FROM r, (SELECT unnest(['nbrf', 'staden', 'gcg', 'raw', 'molgen']) AS kind)")
def parsed_sequences(spark, d):
    """Other sequence formats."""
    r = v_lettered(spark, d).withColumn("lines", wrapped(F.col("seq"))).withColumn("n", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    text = {
        "nbrf": (F.lit(">P1;"), F.col("n"), F.lit("\na title\n"), F.col("lines"), F.lit("*\n")),
        "staden": (F.lit("<-"), F.col("n"), F.lit("->"), F.col("lines"), F.lit("\n")),
        "gcg": (F.col("n"), F.lit("  Length: 5  ..\n"), F.col("lines"), F.lit("\n")),
        "raw": (F.col("lines"), F.lit("\n")),
        "molgen": (F.lit(";"), F.col("n"), F.lit("\n"), F.col("lines"), F.lit("\n")),
    }
    made = None
    for kind, parts in text.items():
        x = files.parsed(r.select(F.col("doc_id").cast("string").alias("path"), content(*parts).alias("content")), kind).select("path", F.lit(kind).alias("kind"), F.coalesce("name", F.lit("")).alias("name"), F.md5(F.col("seq").cast("binary")).alias("digest"))
        made = x if made is None else made.unionByName(x)
    return made


@query(f"{LETTERED}, p AS (SELECT *, greatest(length(seq), 1) AS n FROM r) SELECT doc_id::VARCHAR AS path, k::BIGINT AS read_no, '@' || doc_id || ':' || k AS header, substr(seq, k::INT, 30) AS seq, repeat('I', length(substr(seq, k::INT, 30))) AS qual FROM p, (SELECT unnest([1, 2, 3]) AS k)")
def parsed_fastq(spark, d):
    """Three reads a file."""
    r = v_lettered(spark, d)
    part = lambda k: F.substring("seq", k, 30)
    record = lambda k: (F.lit("@"), F.col("doc_id").cast("string"), F.lit(f":{k}\n"), part(k), F.lit("\n+\n"), F.expr(f"repeat('I', length(substring(seq, {k}, 30)))"), F.lit("\n"))
    made = r.select(F.col("doc_id").cast("string").alias("path"), content(*(c for k in (1, 2, 3) for c in record(k))).alias("content"))
    return files.parsed(made, "reads").select("path", "read_no", "header", "seq", "qual")


@query(f"WITH {FEATURES} SELECT chrom, type, 'g' || feat_no AS id, strand, lo::INT AS start, (hi + 30)::INT AS \"end\", 2::INT AS n FROM feats")
def parsed_embl(spark, d):
    """Feature tables with joined and complementary places, one file a chromosome."""
    f = q.v_features(spark, d)
    span = F.format_string("join(%d..%d,%d..%d)", "start", "end", F.col("end") + 20, F.col("end") + 30)
    place = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    line = F.concat(F.format_string("FT   %-16s", F.regexp_replace("type", " ", "_")), place, F.lit("\nFT                   /gene=\"g"), F.col("feat_no").cast("string"), F.lit('"\n'))
    made = f.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feat_no", line.alias("l")))), lambda x: x["l"]), "").alias("x"))
    made = made.select(F.col("chrom").alias("path"), content(F.lit("ID   "), F.col("chrom"), F.lit("; DNA\n"), F.col("x"), F.lit("//\n")).alias("content"))
    names = f.select("type").distinct().select(F.regexp_replace("type", " ", "_").alias("_t"), F.col("type").alias("_n"))
    return files.parsed(made, "embl").join(names, F.col("type") == F.col("_t")).select("chrom", F.col("_n").alias("type"), "id", "strand", "start", "end", F.size("segments").alias("n"))


# Lines.


@query("SELECT 'rmapbs_bed' AS kind, 'n' || o_orderkey AS name, 'c' || o_custkey % 5 AS chrom, o_custkey::INT AS start, (o_custkey + 40)::INT AS \"end\", CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders UNION ALL SELECT 'bsmap_102', 'n' || o_orderkey, 'c' || o_custkey % 5, o_custkey::INT, (o_custkey + 5)::INT, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END FROM orders UNION ALL SELECT 'bsmap_12', 'n' || o_orderkey, 'c' || o_custkey % 5, o_custkey::INT, (o_custkey + 5)::INT, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END FROM orders")
def parsed_mappings(spark, d):
    """The three mapper formats."""
    o = q.read(spark, d, "orders")
    name, chrom, start = F.concat(F.lit("n"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")), F.col("o_custkey").cast("string")
    strand, end = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), (F.col("o_custkey") + 40).cast("string")
    x, n = F.lit("ACGTAC"), F.lit("0")
    lines = {"rmapbs_bed": (chrom, start, end, name, n, strand), "bsmap_102": (name, x, n, chrom, start, strand, n, x, x), "bsmap_12": (name, x, n, n, chrom, start, strand, n, x, n, x)}
    made = None
    for kind, parts in lines.items():
        rows = tables.mapper(o.select(F.concat_ws("\t", *parts).alias("value")), kind).select(F.lit(kind).alias("kind"), "name", "chrom", "start", "end", "strand")
        made = rows if made is None else made.unionByName(rows)
    return made


@query("SELECT (c_nationkey % 7)::VARCHAR AS chrom, c_custkey AS bin_id, (c_custkey * 10)::INT AS start, (c_custkey * 10 + c_nationkey)::INT AS \"end\" FROM customer")
def parsed_user_bins(spark, d):
    c = q.read(spark, d, "customer")
    lines = c.select(F.col("c_custkey").alias("line_no"), F.format_string("%d %d\t%d", F.col("c_nationkey") % 7, F.col("c_custkey") * 10, F.col("c_custkey") * 10 + F.col("c_nationkey")).alias("value"))
    known = spark.createDataFrame([(str(i),) for i in range(7)], "chrom string")
    return bins_.user_bins(tables.intervals(lines), known)


@query("SELECT 'x' || c_nationkey AS chrom, c_custkey::INT AS start, (c_custkey + 79)::INT AS \"end\", (c_custkey % 9)::INT AS n_cpg FROM customer")
def parsed_reduced_positions(spark, d):
    """Written as lines and read again."""
    rows = q.read(spark, d, "customer").select(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("chrom"), F.col("c_custkey").cast("int").alias("start"), (F.col("c_custkey") + 79).cast("int").alias("end"), (F.col("c_custkey") % 9).cast("int").alias("n_cpg"))
    return tables.reduced_positions(rows.select(tables.reduced_positions_text().alias("value")))


@query("SELECT c_custkey AS line_no, 'x' || c_nationkey AS chrom, c_custkey::INT AS start, (c_custkey + 9)::INT AS \"end\", 'x' || c_nationkey || '|' || c_custkey || '|' || (c_custkey + 9) || '|' || c_mktsegment || '|-' AS tokens FROM customer")
def parsed_regions(spark, d):
    c = q.read(spark, d, "customer")
    lines = c.select(F.col("c_custkey").alias("line_no"), F.concat_ws("\t", F.concat(F.lit("x"), F.col("c_nationkey").cast("string")), F.col("c_custkey").cast("string"), (F.col("c_custkey") + 9).cast("string"), "c_mktsegment").alias("value"))
    lines = lines.unionByName(spark.createDataFrame([(0, "#chrom\tstart\tend")], "line_no bigint, value string"))
    return tables.regions(lines, keep=5, header=True).withColumn("tokens", F.array_join("tokens", "|"))


@query(f"WITH {FEATURES}, t AS (SELECT chrom, 't' || (feat_no // 3) AS id, min(lo)::INT AS start, max(hi)::INT AS stop, min(feat_no) AS feat_no FROM feats GROUP BY 1, 2) SELECT chrom, id, k AS type, p::INT AS part, CASE WHEN k = 'mRNA' THEN id END AS parent_id, start, stop AS \"end\" FROM t, (SELECT unnest(['gene', 'mRNA']) AS k, unnest([0, 1]) AS p)")
def gtf_genes(spark, d):
    """Genes put before the mRNAs that exons make."""
    f = q.v_features(spark, d)
    attrs = F.format_string('gene_type "protein_coding"; transcript_id "t%d";', F.floor(F.col("feat_no") / 3))
    lines = f.select(F.col("feat_no").alias("line_no"), F.concat_ws("\t", "chrom", F.lit("x"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))
    return tables.with_genes(tables.gtf(lines)).select("chrom", "id", "type", "part", "parent_id", "start", "end")


@query("SELECT 's' || s_suppkey AS name, md5(repeat('ACGT', (s_suppkey % 40 + 1)::INT)) AS digest FROM supplier")
def gff3_sequences(spark, d):
    """Sequences behind the features of a GFF3 file."""
    s = q.read(spark, d, "supplier")
    seq = F.expr("repeat('ACGT', int(s_suppkey % 40 + 1))")
    parts = F.array(F.concat(F.lit(">s"), F.col("s_suppkey").cast("string")), F.substring(seq, 1, 50), F.substring(seq, 51, 1000))
    lines = s.select("s_suppkey", F.posexplode(parts).alias("i", "value")).select((F.col("s_suppkey") * 3 + F.col("i") + 10).alias("line_no"), "value")
    head = spark.createDataFrame([(0, "##gff-version 3"), (1, "1\tx\tgene\t1\t9\t.\t+\t.\tID=g1"), (2, "##FASTA")], "line_no bigint, value string")
    return tables.gff3_sequences(lines.unionByName(head)).select("name", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("SELECT CASE range WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE (range + 1)::VARCHAR END AS chrom, range::INT AS ord, 'hs_' || CASE range WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE (range + 1)::VARCHAR END || '.fa' AS path FROM range(24)")
def chromosome_catalogue(spark, d):
    return tables.catalogue(spark, "hs_", ".fa", 24)


@query(f"""WITH {CALLS}, {CPGS}, {q.BINS}, b AS (SELECT * FROM bins), held AS (SELECT c.chrom, bin_id, pos FROM cpgs c JOIN b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop),
    n AS (SELECT c.chrom, b.bin_id, c.sample_no, CASE WHEN h.pos IS NULL THEN 0 ELSE c.pos END AS pos, count(*) FILTER (meth) AS m, count(*) FILTER (NOT meth) AS u FROM calls c JOIN b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop LEFT JOIN held h ON h.chrom = c.chrom AND h.bin_id = b.bin_id AND h.pos = c.pos GROUP BY ALL)
    SELECT chrom, bin_id, sample_no, 'Sample ' || sample_no || ': ' || string_agg(CASE WHEN pos = 0 THEN 'Stray' ELSE pos::VARCHAR END || ':' || m || '+' || u || '-', ' ' ORDER BY pos) AS line FROM n GROUP BY chrom, bin_id, sample_no""")
def cpg_lines(spark, d):
    """Counts at each CpG as a sample's line."""
    from ..operators import counts as counts_

    return sinks.cpg_detail(counts_.cpg_counts(q.v_calls(spark, d), q.v_cpgs(spark, d), q.v_bins(spark, d)))


@query("""SELECT a.s_suppkey AS k, concat_ws(chr(9), printf('%.4f', m1 / (m1 + u1)::DOUBLE), printf('%.4f', m2 / (m2 + u2)::DOUBLE), '2.00', '1', '0.5', m1 || '+/' || u1 || '-', m2 || '+/' || u2 || '-') AS line
    FROM (SELECT s_suppkey, s_suppkey % 8 + 1 AS m1, s_suppkey % 5 + 1 AS u1, s_suppkey % 3 + 1 AS m2, s_suppkey % 7 + 1 AS u2 FROM supplier) a""")
def pair_lines(spark, d):
    """Pairs' lines with counts."""
    s = q.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), *((F.col("s_suppkey") % m + 1).alias(n) for n, m in (("meth_1", 8), ("unmeth_1", 5), ("meth_2", 3), ("unmeth_2", 7))))
    share = lambda i: F.col(f"meth_{i}") / (F.col(f"meth_{i}") + F.col(f"unmeth_{i}"))
    rows = s.withColumn("prop_1", share(1)).withColumn("prop_2", share(2)).withColumn("fold", F.lit(2.0)).withColumn("greater", F.lit("1")).withColumn("p", F.lit(0.5))
    return rows.select("k", sinks.pair_line(counts=True).alias("line"))


@query(f"""{LETTERED}, u AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS k FROM r WHERE length(seq) > 0),
    s AS (SELECT doc_id, sum(((k - 1) % 57 + 1) * ascii(c)) % 10000 AS checksum FROM u GROUP BY ALL), t AS (SELECT r.doc_id, seq, 'n' || r.doc_id AS n, coalesce(checksum, 0)::BIGINT AS checksum, array_to_string(regexp_extract_all(seq, '.{{1,60}}'), chr(10)) AS lines FROM r LEFT JOIN s USING (doc_id)),
    x AS (SELECT doc_id, unnest([['fasta', '>' || n || chr(10) || lines], ['nbrf', '>DL;' || n || chr(10) || 'a title' || chr(10) || lines || '*'], ['staden', '<-' || n || '->' || lines],
        ['gcg', n || '  Length: ' || length(seq) || '  Check: ' || checksum || '  ..' || chr(10) || lines], ['molgen', ';' || n || chr(10) || lines], ['raw', lines]]) AS v FROM t)
    SELECT doc_id, v[1] AS kind, md5(v[2] || chr(10)) AS digest FROM x""")
def sequence_records(spark, d):
    """Sequences written in each format."""
    r = v_lettered(spark, d)
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    kinds = ("fasta", "nbrf", "staden", "gcg", "molgen", "raw")
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), sinks.sequence_record(k, name, F.col("seq"), "a title").alias("text")) for k in kinds))).alias("x")
    return r.select("doc_id", made).select("doc_id", "x.kind", F.md5(F.col("x.text").cast("binary")).alias("digest"))

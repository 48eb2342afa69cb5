import gzip
import io
import struct
import zlib

import pytest
from cytofold.sources import files, sinks, tables
from cytofold.streaming import live_counts
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def at(tmp_path_factory, spark):
    files.register(spark)
    return tmp_path_factory.mktemp("files")


def lines(spark, *texts):
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "value string, line_no bigint")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_calls(spark):
    names = tables.catalogue(spark, n=4)
    assert rows(names, "chrom", "ord", "path") == [("1", 0, "1.fa"), ("2", 1, "2.fa"), ("X", 2, "X.fa"), ("Y", 3, "Y.fa")]
    got = tables.calls(lines(spark, "1 10497 +", "1\t5 x", "9 1 +", "bad", "1 2 3 4"), names)
    assert rows(got, "chrom", "pos", "meth") == [("1", 5, False), ("1", 10497, True)]
    got = tables.count_list(lines(spark, "1 10498 - CG 3 1", "1 5 + CHH 1 1"), names, only="1")
    assert rows(got) == [("1", 10497, False, 1), ("1", 10497, True, 3)]


def test_sam_and_mappers(spark):
    got = tables.sam(lines(spark, "@HD\tx", "r1\t0\t1\t5\t255\t6M\t*\t0\t0\tTGATCG\t*\tNM:i:0"), longest=3)
    r = got.first()
    assert (r.qname, r.flag, r.pos, r.seq, r.tags) == ("r1", 0, 5, "TGA", ["NM:i:0"])
    assert got.select(tables.sam_text(got).alias("t")).first().t == "r1\t0\t1\t5\t255\t6M\t*\t0\t0\tTGA\t*\tNM:i:0"
    assert rows(tables.mapper(lines(spark, "1 99 140 s1_3_10_20 0 +"), "rmapbs_bed"), "name", "chrom", "start", "strand") == [("s1_3_10_20", "1", 99, "+")]
    assert rows(tables.mapper(lines(spark, "n ACGT UM 1 7 - 0 x y"), "bsmap_102"), "chrom", "start", "end", "strand") == [("1", 7, 10, "-")]
    assert rows(tables.mapper(lines(spark, "n ACGT III UM 1 7 + 0 x 0 y"), "bsmap_12"), "chrom", "start", "end", "strand") == [("1", 7, 10, "+")]


def test_intervals(spark):
    made = tables.reduced_positions(lines(spark, "1\t101..180 (80 bp) CpG: 3", "x"))
    assert rows(made) == [("1", 101, 180, 3)]
    assert made.select(tables.reduced_positions_text().alias("t")).first().t == "1\t101..180 (80 bp) CpG: 3"
    assert rows(tables.intervals(lines(spark, "# x", "X 1 2000")), "chrom", "start", "end") == [("X", 1, 2000)]
    r = tables.regions(lines(spark, "1 100 179 80 3"), keep=6).first()
    assert (r.chrom, r.start, r.end, r.tokens) == ("1", 100, 179, ["1", "100", "179", "80", "3", "-"])
    with pytest.raises(Exception, match="three columns"):
        tables.regions(lines(spark, "1 100")).collect()
    assert tables.sites("C^CGG\n\nT^CGA\n") == ["C^CGG", "T^CGA"]
    assert tables.chromosome_info('# c\n1 /d/1.fa\n"chr 2" /d/2.fa # x\n') == [("1", "/d/1.fa"), ("chr 2", "/d/2.fa")]


GTF = [
    '1\tx\texon\t11\t20\t.\t+\t.\tgene_type "protein_coding"; transcript_id "T1";',
    '1\tx\tCDS\t12\t18\t.\t+\t.\tgene_type "protein_coding"; transcript_id "T1";',
    '1\tx\texon\t31\t40\t.\t+\t.\tgene_type "protein_coding"; transcript_id "T1";',
    '1\tx\texon\t50\t60\t.\t-\t.\tgene_biotype "lincRNA"; transcript_name "N"; transcript_id "T2";',
    "# comment",
]


def test_gtf(spark):
    got = tables.gtf(lines(spark, *GTF), biotypes=None)
    assert rows(got, "id", "type", "start", "end") == [("N", "exon", 50, 60), ("T1", "CDS", 12, 18), ("T1", "exon", 11, 40)]
    assert [tuple(s) for s in got.where("id = 'T1' and type = 'exon'").first().segments] == [(11, 20, "+"), (31, 40, "+")]
    assert rows(tables.gtf(lines(spark, *GTF)), "id").count(("N",)) == 0
    assert rows(tables.gtf(lines(spark, *GTF), compat=True).where("type = 'exon'"), "start", "end") == [(11, 20)]
    genes = tables.with_genes(got)
    assert rows(genes.where("id = 'T1'"), "type", "parent_id") == [("CDS", "T1"), ("gene", None), ("mRNA", "T1")] or genes.count() == 5
    with pytest.raises(Exception, match="nine fields"):
        tables.gtf(lines(spark, "1\tx\texon")).collect()


def test_gff3(spark):
    made = tables.gff3(lines(spark, "1\t.\tgene\t5\t90\t.\t-\t.\tID=g1;Name=a%20b", "1\t.\tmRNA\t5\t80\t.\t-\t.\tID=m1;Parent=g1"))
    assert rows(made, "id", "name", "parent_id") == [("g1", "a b", None), ("m1", None, "g1")] or made.count() == 2
    assert rows(tables.with_parents(made), "id", "parent_type", "parent_end") == [("m1", "gene", 90)]
    assert [tables.format_of(x) for x in ("LOCUS x", "ID   x", "##gff-version 3", GTF[0])] == ["genbank", "embl", "gff3", "gtf"]


def test_sequence_files(spark, at):
    (at / "a.fa").write_text(">1 x\nACG\nTNN\n>2\nGG*AA\n")
    assert rows(spark.read.format("seqfile").load(f"{at}/a.fa"), "record", "name", "seq") == [(0, "1 x", "ACGTNN"), (1, "2", "GG")]
    assert spark.read.format("seqfile").option("first", "true").load(f"{at}/a.fa").count() == 1
    assert list(files.sequences(iter([">P1;name\n", "title\n", "AC GT\n", "A*\n"]), "nbrf")) == [("name", "ACGTA")]
    assert list(files.sequences(iter(["!!NA x\n", "name Length: 4 ..\n", "  1 ACGT\n"]), "gcg")) == [("name", "ACGT")]
    assert list(files.sequences(iter(["ACGT\n", "AC\n"]), "raw")) == [("", "ACGTAC")]


def test_reads(spark, at):
    with gzip.open(at / "r.fq.gz", "wt") as f:
        f.write("@M:1:3:10:20\nACGT\n+\nIIII\n@b\nAC\n+\nII\n")
    got = spark.read.format("reads").load(f"{at}/r.fq.gz")
    assert rows(got, "read_no", "header", "seq", "qual") == [(1, "@M:1:3:10:20", "ACGT", "IIII"), (2, "@b", "AC", "II")]
    text = got.where("read_no = 2").select(sinks.fastq_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("t")).first().t
    assert text == "@b\nAC\n+\nII"


def bgzf(data):
    return gzip.compress(data)


def test_bam(spark, at):
    def record(ref, pos, name, flag, seq, aux=b""):
        code = [files.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 255, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([40] * len(seq)) + aux
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    aux = b"NMC\3" + b"XAZhi\0" + b"XBBs\2\0\0\0\1\0\xff\xff"
    (at / "x.bam").write_bytes(bgzf(head) + bgzf(record(0, 4, "r1", 0, "TGATC", aux)) + bgzf(record(-1, -1, "r2", 4, "AC")))
    r = spark.read.format("bam").load(f"{at}/x.bam").collect()
    assert len(r) == 1
    assert (r[0].qname, r[0].chrom, r[0].pos, r[0].seq, r[0].cigar, r[0].qual) == ("r1", "1", 5, "TGATC", "5M", "IIIII")
    assert r[0].aux == {"NM": "i:3", "XA": "Z:hi", "XB": "B:s,1,-1"}
    assert spark.read.format("bam").option("unplaced", "true").load(f"{at}/x.bam").count() == 2


def blocked(data, size):
    """data as BGZF blocks of some bytes each, the empty last one included."""
    out = []
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(b"\x1f\x8b\x08\4" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def test_bam_in_splits(spark, at):
    """Each alignment comes once, whatever the blocks and the splits are: records that cross blocks, a header of many blocks."""

    def record(i):
        name, n = f"read{i}", 700 if i == 50 else 1 + i % 40
        body = struct.pack("<iiBBHHHiiii", i % 30, i * 7, len(name) + 1, 9, 0, 1, 0, n, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", n << 4) + bytes((i + k) % 256 for k in range((n + 1) // 2)) + bytes([30] * n) + b"NMC" + bytes([i % 200])
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 30) + b"".join(struct.pack("<i", 4) + f"c{i:02}".encode() + b"\0" + struct.pack("<i", 10**6) for i in range(30))
    data = head + b"".join(map(record, range(300)))
    want = list(files.bam_records(io.BytesIO(data)))
    assert len(want) == 300
    for size in (61, 500, 60000):
        path = at / f"blocks{size}.bam"
        path.write_bytes(blocked(data, size))
        whole = path.stat().st_size
        store, inside = files.store(str(path))
        with store.open_input_file(inside) as f:
            for step in (97, 1000, whole):
                assert [r for a in range(0, whole, step) for r in files.bam_split(f, a, min(a + step, whole))] == want, (size, step)
    r = spark.read.format("bam").option("split", 700).load(f"file://{at}/blocks*.bam")
    assert r.count() == 900 and r.rdd.getNumPartitions() > 30
    assert r.select("qname").distinct().count() == 300
    broken = bytearray((at / "blocks500.bam").read_bytes())
    broken[len(broken) // 2] ^= 255
    (at / "broken.bam").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="no whole block"):
        spark.read.format("bam").load(f"{at}/broken.bam").count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("bam").load(f"{at}/nowhere.bam").count()


def test_flat_files(spark, at):
    assert files.location("complement(join(10..20,30..40))") == ("-", [(10, 20, "-"), (30, 40, "-")])
    assert files.location("join(1..5,complement(8..<9),J00194.1:100)") == ("+", [(1, 5, "+"), (8, 9, "-"), (100, 100, "+")])
    assert files.location("complement(complement(3^4))") == ("+", [(3, 4, "+")])
    (at / "e.embl").write_text('ID   X1; SV 1;\nFT   gene            5..40\nFT                   /gene="abc"\nFT   CDS             complement(join(10..20,\nFT                   30..40))\nFT                   /product="long\nFT                   name"\nSQ   x\n//\n')
    got = spark.read.format("flatfile").option("kind", "embl").load(f"{at}/e.embl")
    assert rows(got, "chrom", "feat_no", "type", "id", "strand", "start", "end") == [("X1", 0, "gene", "abc", "+", 5, 40), ("X1", 1, "CDS", None, "-", 10, 40)]
    assert got.where("type = 'CDS'").first().quals == {"product": ["long name"]}
    (at / "g.gb").write_text('LOCUS       AB1 100 bp\nFEATURES             Location/Qualifiers\n     gene            1..9\n                     /gene="g"\nORIGIN\n//\n')
    assert rows(spark.read.format("flatfile").option("kind", "genbank").load(f"{at}/g.gb"), "chrom", "type", "id", "start", "end") == [("AB1", "gene", "g", 1, 9)]


def test_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1000)))
    got = tables.read_lines(spark, str(tmp_path / "a.txt"), numbered=True)
    assert got.where("cast(value as bigint) + 1 = line_no").count() == 1000


def test_sinks(spark, tmp_path):
    bins = spark.createDataFrame([("1", 3, 10, 2, 5), ("1", 20, 29, 0, 0)], "chrom string, start int, end int, n_cpg int, hits int")
    assert rows(bins.select(*sinks.bin_prefix("chr")))[0] == ("chr1", 3, 10, 8, 2, 5, "2.50")
    assert rows(bins.select(*sinks.bin_prefix()), "hits_per_cpg") == [("-1.00",), ("2.50",)]
    fasta = sinks.reduced_fasta(spark.createDataFrame([("1", 9, "GGG"), ("1", 1, "AAAA")], "chrom string, start int, seq string"), width=5).first()
    assert fasta.lines == ["AAAAG", "GG"] and fasta.header.startswith(">1rr")
    detail = spark.createDataFrame([("1", 0, 1, 0, 0, 1, 2), ("1", 0, 1, 1, 17, 3, 0)], "chrom string, bin_id bigint, sample_no int, slot int, pos int, meth bigint, unmeth bigint")
    assert sinks.cpg_detail(detail).first().line == "Sample 1: Stray:1+2- 17:3+0-"
    four = sinks.four_to_one(lines(spark, *"abcdefgh"))
    assert rows(four) == [(0, "a~b~c~d"), (1, "e~f~g~h")]
    sinks.write_lines(four.select(F.col("value").alias("line")), str(tmp_path / "out"), compression="gzip")
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    sinks.write_table(bins, str(tmp_path / "table"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "table")).count() == 2
    counts = spark.createDataFrame([("1", 3, 1, 2)], "chrom string, bin_id bigint, meth bigint, unmeth bigint")
    kept = bins.withColumn("bin_id", F.col("start").cast("bigint"))
    assert rows(sinks.seqmonk(counts, kept), "line") == [("1\t1\t8\t3",), ("1\t9\t18\t0",)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1").write_text("1 5 +\n1 6 -\n1 250 +\n")
    q = live_counts.live_window_counts(live_counts.stream_calls(spark, str(tmp_path / "in")), 100).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "s2").write_text("1 7 +\n")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select bin_id, sample, meth, unmeth from live")) == [(0, "s1", 1, 1), (0, "s2", 1, 0), (2, "s1", 1, 0)]


def test_adaptors_usage_and_dump(spark):
    from cytofold.functions.sequences import codon_usage
    from cytofold.operators import counts

    assert tables.adaptors(">a\nACG\nT\n>b\nacgt\n>c\nGG") == ["ACGT", "GG"]
    assert tables.adaptors("# x\nAACC\nAACC\nTT\n", from_five=1) == ["ACC", "T"]
    usage = codon_usage(spark.createDataFrame([("ATGATGTA",), ("TGA",)], "seq string"))
    assert rows(usage) == [("ATG", "M", 2), ("TGA", "*", 1)]
    got = tables.gtf(lines(spark, *GTF))
    assert ("1\texon\tT1\t+\t11\t40\t31\t40",) in rows(sinks.feature_lines(got), "line")
    dense = spark.createDataFrame([("1", 0, 1, 1, 3, 0, 4), ("1", 0, 2, 1, 0, 0, 4)], "chrom string, bin_id bigint, sample_no int, group_no int, meth bigint, unmeth bigint, n_cpg int")
    by_cpg = spark.createDataFrame([("1", 0, 1, 0, 0, 9, 9), ("1", 0, 1, 1, 5, 2, 0), ("1", 0, 1, 2, 9, 1, 0)], "chrom string, bin_id bigint, sample_no int, slot int, pos int, meth bigint, unmeth bigint")
    hit = counts.with_cpg_hits(dense, by_cpg, 2)
    assert rows(hit, "sample_no", "cpgs_hit") == [(1, 1), (2, 0)]
    masked = counts.with_mask(hit, counts.Limits(least_hits=1, least_cpg_hits=1))
    assert rows(masked, "sample_no", "failed") == [(1, 0), (2, 7)]


def test_sequences_written_and_read(spark):
    seq = "ACGTTGCA" * 20
    for kind in ("fasta", "nbrf", "staden", "gcg", "molgen", "raw"):
        for text in (seq, ""):
            record = spark.range(1).select(sinks.sequence_record(kind, F.lit("s1"), F.lit(text), "a title").alias("t")).first().t
            assert list(files.sequences(io.StringIO(record), kind)) == [("" if kind == "raw" else "s1", text)], kind

"""Entries for methylation calling, reads, bins and statistics, each beside its SQL; see queries.py for the tables' parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequences as seq_
from ..operators import annotate, bins as bins_, calling, clean, counts as counts_, diff
from ..sources import sinks
from . import queries as q
from .queries import ALL, BINS, CALLS, CHI, CPGS, FEATURES, FISHER, NCPG, READS, REGIONS, WIN, query

# Calling: documents are chromosomes; each gives a read of a third of its length on each strand, bisulphite-converted
# in every second document. Chunks of the genome are far shorter than reads.


def v_genome(spark: SparkSession, d: str) -> DataFrame:
    return q.read(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("chrom"), q.bases().alias("seq"))


def v_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Letters become bases one by one, so a text's length is its chromosome's."""
    return q.read(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("chrom"), F.length("text").alias("length"))


def v_chunks(spark: SparkSession, d: str) -> DataFrame:
    return bins_.chunked(v_genome(spark, d), 64, 8)


def v_aligned(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), (n * i / 5 + 1).cast("int").alias("pos")) for i, f in enumerate((0, 16, 1, 17)))))
    # Of the text the parts come first, as their bases, places and lengths don't depend on the rest.
    texts = q.read(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("chrom"), "text", F.length("text").alias("n"))
    rows = texts.select("chrom", "text", "n", both.alias("x")).select("chrom", "x.flag", "x.pos", F.substring("text", F.col("x.pos"), F.ceil(n / 3).cast("int")).alias("text"))
    rows = rows.select("chrom", "flag", "pos", q.bases().alias("seq"))
    converted = F.when(F.col("chrom").cast("bigint") % 2 == 0, F.col("seq")).when(F.col("flag").bitwiseAND(16) == 0, F.replace("seq", F.lit("C"), F.lit("T"))).otherwise(F.replace("seq", F.lit("G"), F.lit("A")))
    return rows.select(F.concat_ws(":", "chrom", "flag").alias("read_id"), "chrom", "pos", "flag", converted.alias("seq"))


ALIGNED = f"""{READS}, genome AS (SELECT doc_id::VARCHAR AS chrom, doc_id, seq FROM reads WHERE length(seq) > 0),
    flags AS (SELECT unnest([0, 16, 1, 17]) AS flag, unnest([0, 1, 2, 3]) AS i),
    cut AS (SELECT chrom, doc_id, flag, seq AS ref, floor(length(seq) * i / 5.0 + 1)::INT AS pos, substr(seq, floor(length(seq) * i / 5.0 + 1)::INT, ceil(length(seq) / 3.0)::INT) AS part FROM genome, flags),
    aligned AS (SELECT chrom || ':' || flag AS read_id, chrom, pos, flag, ref, CASE WHEN doc_id % 2 = 0 THEN part WHEN flag & 16 = 0 THEN replace(part, 'C', 'T') ELSE replace(part, 'G', 'A') END AS seq FROM cut),
    bases AS (SELECT read_id, chrom, pos, flag, i, substr(seq, i, 1) AS b, substr(ref, pos + i - 1, 1) AS r, substr(ref, pos + i, 1) AS after, CASE WHEN pos + i > 2 THEN substr(ref, pos + i - 2, 1) ELSE '' END AS before
        FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM aligned))"""
CALLED = f"""{ALIGNED}, called AS (
    SELECT read_id, chrom, (pos + i - 1)::INT AS pos, b = 'C' AS meth, i, false AS rev FROM bases WHERE flag & 16 = 0 AND r = 'C' AND after = 'G' AND b IN ('C', 'T')
    UNION ALL SELECT read_id, chrom, (pos + i - 2)::INT, b = 'G', i, true FROM bases WHERE flag & 16 <> 0 AND r = 'G' AND before = 'C' AND b IN ('G', 'A'))"""


@query(f"{CALLED} SELECT read_id, chrom, pos, meth FROM called WHERE NOT rev")
def forward_calls(spark, d):
    return calling.read_calls(v_aligned(spark, d).where("(flag & 16) = 0"), v_chunks(spark, d)).select("read_id", "chrom", "pos", "meth")


@query(f"{CALLED} SELECT read_id, chrom, pos, meth, i = max(i) OVER (PARTITION BY read_id) AS first_3p FROM called WHERE rev")
def reverse_calls(spark, d):
    return calling.read_calls(v_aligned(spark, d).where("(flag & 16) <> 0"), v_chunks(spark, d))


@query(f"""{ALIGNED} SELECT read_id, chrom, (pos + i - 1)::INT AS pos, b IN ('C', 'G') AS meth FROM bases
    WHERE (flag & 16 = 0 AND r = 'C' AND b IN ('C', 'T')) OR (flag & 16 <> 0 AND r = 'G' AND b IN ('G', 'A'))""")
def all_c_calls(spark, d):
    return calling.read_calls(v_aligned(spark, d), v_chunks(spark, d), every_c=True).select("read_id", "chrom", "pos", "meth")


@query(f"""{ALIGNED} SELECT read_id, chrom, (pos + i - 1 - CASE WHEN flag = 16 THEN 1 ELSE 0 END)::INT AS pos, b IN ('C', 'G') AS meth FROM bases
    WHERE (flag <> 16 AND r = 'C' AND after = 'G' AND b IN ('C', 'T')) OR (flag = 16 AND r = 'G' AND before = 'C' AND b IN ('G', 'A'))""")
def exact_flag_calls(spark, d):
    """A reverse read's flag must be 16: 17 counts as forward."""
    return calling.read_calls(v_aligned(spark, d), v_chunks(spark, d), exact_flag=True).select("read_id", "chrom", "pos", "meth")


@query(f"{CALLED} SELECT chrom, pos, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM called GROUP BY ALL")
def called_depth(spark, d):
    """Depth from reads: their calls, added up by place."""
    return calling.read_calls(v_aligned(spark, d), v_chunks(spark, d)).groupBy("chrom", "pos").agg(*counts_.methylated(""))


@query(f"""{ALIGNED}, s AS (SELECT read_id, chrom, pos, flag, seq, substr(ref, pos, length(seq)) AS g FROM aligned),
    t AS (SELECT *, flag & 16 <> 0 AS minus, CASE WHEN flag & 16 <> 0 THEN reverse(translate(g, 'ACGT', 'TGCA')) ELSE g END AS r FROM s),
    u AS (SELECT *, unnest(range(length(seq))) AS i FROM t)
    SELECT read_id, chrom, (CASE WHEN minus THEN pos + length(seq) - 2 - i ELSE pos + i END)::INT AS pos, substr(seq, i + 1, 1) = 'C' AS meth FROM u WHERE substr(r, i + 1, 2) = 'CG'""")
def mapper_calls(spark, d):
    rows = v_aligned(spark, d).join(v_genome(spark, d).select("chrom", F.col("seq").alias("_g")), "chrom")
    rows = rows.select("read_id", "chrom", F.col("pos").alias("start"), F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"), "seq", F.expr("substring(_g, pos, length(seq))").alias("genome"))
    return calling.slice_calls(rows)


@query(f"{CALLED}, d AS (SELECT chrom, count(*) AS n, max(i) AS last FROM called WHERE rev GROUP BY chrom), w AS (SELECT chrom, (pos - 1) // 50 AS bin_id, meth FROM called) SELECT chrom, bin_id, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM w GROUP BY ALL")
def called_windows(spark, d):
    """From reads to counts by window."""
    calls = calling.read_calls(v_aligned(spark, d), v_chunks(spark, d)).withColumn("sample_no", F.lit(1)).withColumn("group_no", F.lit(1))
    return counts_.window_counts(calls, 50).drop("sample_no", "group_no")


@query(f"WITH {CALLS} SELECT chrom, pos, meth, count(*) AS n FROM calls WHERE chrom = '3' GROUP BY ALL")
def calls_of_one_chromosome(spark, d):
    from ..sources import tables

    lines = q.v_calls(spark, d).select(F.concat_ws(" ", "chrom", "pos", F.when(F.col("meth"), "+").otherwise("-")).alias("value"))
    return tables.calls(lines, only="3").groupBy("chrom", "pos", "meth").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS}, {BINS}, moved AS (SELECT c.chrom, c.sample_no, c.meth, CASE WHEN c.pos % 2 = 0 AND EXISTS (SELECT 1 FROM bins b WHERE b.chrom = c.chrom AND b.start = c.pos) THEN c.pos - 1 ELSE c.pos END AS pos FROM calls c)
    SELECT b.chrom, b.bin_id, sample_no, count(*) FILTER (meth) AS meth, count(*) FILTER (NOT meth) AS unmeth FROM moved c JOIN bins b ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop GROUP BY ALL""")
def first_hits_back(spark, d):
    """Calls marked as a reverse read's first hit go to the bin before, where they stand at a bin's start."""
    calls = q.v_calls(spark, d).withColumn("first_3p", F.col("pos") % 2 == 0)
    return counts_.bin_counts(calls, q.v_bins(spark, d), first_hit_back=True).select("chrom", "bin_id", "sample_no", "meth", "unmeth")


# Bins.


@query(f"{READS}, g AS (SELECT doc_id::VARCHAR AS chrom, length(seq) AS n FROM reads WHERE length(seq) > 0), w AS (SELECT chrom, unnest(range(0, (n - 1) // 100 + 1)) AS bin_id FROM g) SELECT chrom, bin_id, (bin_id * 100 + 1)::INT AS start, ((bin_id + 1) * 100)::INT AS \"end\" FROM w")
def fixed_windows(spark, d):
    return bins_.windows(v_lengths(spark, d), 100)


@query(f"{READS}, g AS (SELECT doc_id::VARCHAR AS chrom, seq FROM reads), i AS (SELECT chrom, seq, unnest(range(1, length(seq) + 1)) AS pos FROM g) SELECT chrom, pos::INT AS pos FROM i WHERE substr(seq, pos, 2) = 'CG'")
def cpg_table(spark, d):
    return bins_.motif_table(v_chunks(spark, d))


@query(f"{READS}, g AS (SELECT doc_id::VARCHAR AS chrom, seq FROM reads), i AS (SELECT chrom, seq, unnest(range(1, length(seq) + 1)) AS pos FROM g) SELECT chrom, pos::INT AS pos FROM i WHERE substr(seq, pos, 1) = 'C'")
def all_c_table(spark, d):
    return bins_.motif_table(v_chunks(spark, d), "C")


SITES = f"{READS}, g AS (SELECT doc_id::VARCHAR AS chrom, seq FROM reads WHERE length(seq) > 0), i AS (SELECT chrom, seq, unnest(range(1, length(seq) + 1)) AS pos FROM g), cuts AS (SELECT chrom, pos + 1 AS start FROM i WHERE substr(seq, pos, 4) = 'CCGG' UNION SELECT chrom, 1 FROM g), fr AS (SELECT chrom, start, coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start) - 1, length(seq)) AS stop, row_number() OVER (PARTITION BY chrom ORDER BY start) - 1 AS bin_id, seq FROM cuts JOIN g USING (chrom))"


@query(f"{SITES} SELECT chrom, bin_id, start::INT AS start, stop::INT AS \"end\" FROM fr WHERE stop - start + 1 BETWEEN 40 AND 220")
def reduced_fragments(spark, d):
    """Size-selected fragments of a reduced genome."""
    lengths = v_lengths(spark, d)
    return bins_.digest(v_chunks(spark, d), lengths, ["C^CGG"])


@query(f"""{SITES}, k AS (SELECT chrom, start, stop, substr(seq, start, stop - start + 1) AS part FROM fr WHERE stop - start + 1 BETWEEN 40 AND 220)
    SELECT chrom, '>' || chrom || 'rr reduced representation: ' || sum(length(part)) || ' bp in ' || count(*) || ' fragments' AS header, md5(string_agg(part, '' ORDER BY start)) AS digest FROM k GROUP BY chrom""")
def reduced_genome(spark, d):
    """The reduced genome as FASTA: its header, and a digest of its lines put together."""
    parts = bins_.region_sequences(reduced_fragments(spark, d), v_chunks(spark, d))
    return sinks.reduced_fasta(parts).select("chrom", "header", F.md5(F.array_join("lines", "").cast("binary")).alias("digest"))


@query(f"{SITES}, k AS (SELECT *, (length(substr(seq, start, stop - start + 2)) - length(replace(substr(seq, start, stop - start + 2), 'CG', ''))) // 2 AS n FROM fr WHERE stop - start + 1 BETWEEN 40 AND 220) SELECT chrom || chr(9) || start || '..' || stop || ' (' || (stop - start + 1) || ' bp) CpG: ' || n AS line FROM k")
def fragment_list(spark, d):
    made = bins_.with_cpgs(reduced_fragments(spark, d), cpg_table(spark, d))
    return made.select(sinks.fragment_lines().alias("line"))


@query(f"""{SITES}, k AS (SELECT * FROM fr WHERE stop - start + 1 > 30) SELECT chrom, bin_id, md5(substr(seq, start, stop - start + 1)) AS digest FROM k""")
def region_digests(spark, d):
    """Bases under regions, which span up to many chunks."""
    lengths = v_lengths(spark, d)
    regions = bins_.fragments(bins_.site_positions(v_chunks(spark, d), ["C^CGG"]), lengths).where("end - start + 1 > 30")
    return bins_.region_sequences(regions, v_chunks(spark, d)).select("chrom", "bin_id", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"""{SITES}, k AS (SELECT chrom, substr(seq, start, stop - start + 1) AS s FROM fr)
    SELECT chrom, {', '.join(f"sum(length(s) - length(replace(s, '{b.upper()}', '')))::BIGINT AS {b}" for b in 'acgt')}, sum(length(translate(s, 'ACGT', '')))::BIGINT AS other FROM k GROUP BY chrom""")
def region_composition(spark, d):
    lengths = v_lengths(spark, d)
    return bins_.composition(bins_.fragments(bins_.site_positions(v_chunks(spark, d), ["C^CGG"]), lengths), v_chunks(spark, d))


def _greedy() -> str:
    """A pass from left to right over runs of adjacent bins: a bin is taken as the second of two, the first of two, or alone."""
    return f"""WITH RECURSIVE {CALLS}, {BINS}, {CPGS}, {NCPG},
    o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start) AS k, lead(n_cpg) OVER w AS n2, lead(stop) OVER w AS stop2, lead(start) OVER w = stop + 1 AS joins FROM ncpg WINDOW w AS (PARTITION BY chrom ORDER BY start)),
    p AS (SELECT *, coalesce(joins, false) AND least(n_cpg, n2) < 5 AND n_cpg + n2 >= 5 AS fits FROM o),
    walk AS (SELECT chrom, k, start, CASE WHEN fits THEN stop2 ELSE stop END AS stop, CASE WHEN fits THEN n_cpg + n2 ELSE n_cpg END AS n, CASE WHEN fits THEN 2 ELSE 1 END AS merged FROM p WHERE k = 1
        UNION ALL SELECT p.chrom, p.k, p.start, CASE WHEN fits THEN stop2 ELSE p.stop END, CASE WHEN fits THEN p.n_cpg + n2 ELSE p.n_cpg END, CASE WHEN fits THEN 2 ELSE 1 END FROM p JOIN walk w ON p.chrom = w.chrom AND p.k = w.k + w.merged)
    SELECT chrom, start::INT AS start, stop::INT AS "end", n::BIGINT AS n_cpg, merged::INT AS merged FROM walk"""


q.SQL["amalgamated_bins"] = _greedy()


@query(f"""WITH {CALLS}, {BINS}, hits AS (SELECT b.chrom, b.bin_id, count(c.pos) AS n FROM bins b LEFT JOIN calls c ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop GROUP BY ALL),
    r AS (SELECT chrom, bin_id, start, (sum(stop - start + 1) OVER (PARTITION BY chrom ORDER BY start))::INT AS new_stop, stop - start + 1 AS len FROM bins)
    SELECT chrom, start::INT AS start, concat_ws(chr(9), chrom, new_stop - len + 1, new_stop, n) AS line FROM r JOIN hits USING (chrom, bin_id)""")
def seqmonk_lines(spark, d):
    counts = counts_.bin_counts(q.v_calls(spark, d), q.v_bins(spark, d))
    return sinks.seqmonk(counts, q.v_bins(spark, d))


@query(f"{ALL}, h AS (SELECT chrom, bin_id, sum(meth + unmeth)::BIGINT AS hits FROM dense GROUP BY ALL) SELECT 'chr' || chrom AS chr, start::INT AS start, stop::INT AS \"end\", (stop - start + 1)::INT AS len, n_cpg AS cpgs, hits, CASE WHEN n_cpg > 0 THEN printf('%.2f', hits::DOUBLE / n_cpg) ELSE '-1.00' END AS hits_per_cpg FROM ncpg JOIN h USING (chrom, bin_id)")
def bin_prefixes(spark, d):
    hits = q.dense_counts_(spark, d).groupBy("chrom", "bin_id").agg(F.sum(F.col("meth") + F.col("unmeth")).alias("hits"))
    return bins_.with_cpgs(q.v_bins(spark, d), q.v_cpgs(spark, d)).join(hits, ["chrom", "bin_id"]).select(*sinks.bin_prefix("chr"))


# Masks, gates and modes.


@query(f"{ALL}, x AS (SELECT b.chrom, b.bin_id, s.sample_no, c.pos, count(k.pos) AS n FROM ncpg b JOIN cpgs c ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop CROSS JOIN samples s LEFT JOIN calls k ON k.chrom = c.chrom AND k.pos = c.pos AND k.sample_no = s.sample_no GROUP BY ALL), y AS (SELECT chrom, bin_id, sample_no, count(*) FILTER (n >= 1)::INT AS hit FROM x GROUP BY ALL) SELECT d.chrom, d.bin_id, d.sample_no, coalesce(hit, 0)::INT AS cpgs_hit, NOT (coalesce(hit, 0) < 2 AND coalesce(hit, 0) < n_cpg) AS used FROM dense d LEFT JOIN y USING (chrom, bin_id, sample_no)")
def cpg_hit_mask(spark, d):
    """Samples with hits at two CpGs of a bin at least, or at all of them."""
    b = bins_.with_cpgs(q.v_bins(spark, d), q.v_cpgs(spark, d))
    by_cpg = counts_.cpg_counts(q.v_calls(spark, d), q.v_cpgs(spark, d), b)
    counts = counts_.with_cpg_hits(q.dense_counts_(spark, d), by_cpg)
    return counts_.with_mask(counts, counts_.Limits(least_cpg_hits=2)).select("chrom", "bin_id", "sample_no", "cpgs_hit", "used")


TAIL = "(1 - list_sum(list_transform(range(0, 600), lambda n: exp((df / 2.0 + n) * ln(chi / 2) - chi / 2 - lgamma(df / 2.0 + n + 1)))))"
USED = f"{ALL}, k AS (SELECT * FROM dense WHERE meth + unmeth >= 1)"
#: Pooled shares over all samples, terms from the used ones.
STATS = """tot AS (SELECT chrom, bin_id, sum(meth) / sum(meth + unmeth) AS share, sum(meth + unmeth) AS hits, min(meth + unmeth) AS least FROM dense WHERE n_cpg >= 1 GROUP BY ALL),
    ex AS (SELECT chrom, bin_id, coalesce(least(share, 1 - share) * least, 0) AS least_expected FROM tot),
    chi AS (SELECT chrom, bin_id, sum(CASE WHEN share > 0 THEN (meth - (meth + unmeth) * share) ** 2 / ((meth + unmeth) * share) ELSE 0 END + CASE WHEN share < 1 THEN (unmeth - (meth + unmeth) * (1 - share)) ** 2 / ((meth + unmeth) * (1 - share)) ELSE 0 END) AS chi, (count(*) - 1)::INT AS df FROM k JOIN tot USING (chrom, bin_id) GROUP BY ALL)"""
PAIRS = f"prs AS (SELECT a.chrom, a.bin_id, a.sample_no AS sample_1, b.sample_no AS sample_2, {FISHER} AS p FROM k a JOIN k b ON a.chrom = b.chrom AND a.bin_id = b.bin_id AND a.sample_no < b.sample_no WHERE a.n_cpg >= 1)"

q.SQL["best_test"] = f"""{USED}, {STATS}, {PAIRS}, least_ AS (SELECT chrom, bin_id, min(p) AS fisher, count(*)::INT AS n FROM prs GROUP BY ALL),
    j AS (SELECT *, least_expected >= 5 AND chi > 0 AND df > 0 AS by_chi FROM chi JOIN ex USING (chrom, bin_id) LEFT JOIN least_ USING (chrom, bin_id))
    SELECT chrom, bin_id, CASE WHEN by_chi THEN 'chi' ELSE 'pair' END AS kind, round(CASE WHEN by_chi THEN {TAIL} ELSE coalesce(fisher, 1.0) END, 6) AS p, (CASE WHEN by_chi THEN df ELSE coalesce(n, 0) END)::INT AS df FROM j"""


_EITHER = f"""{USED}, {STATS.replace(" WHERE n_cpg >= 1", "")}, {PAIRS}, big AS (SELECT chrom, bin_id FROM ex WHERE least_expected >= 5)
    SELECT chrom, bin_id, 'chi' AS kind, NULL::INT AS sample_1, NULL::INT AS sample_2, df, CASE WHEN df > 0 AND chi > 0 THEN round({TAIL}, 6) ELSE 1.0 END AS p FROM chi SEMI JOIN big USING (chrom, bin_id)
    UNION ALL SELECT chrom, bin_id, 'pair', sample_1, sample_2, 1, round(p, 6) FROM prs ANTI JOIN big USING (chrom, bin_id)"""
#: Where every expected count is 5 or more, pruning drops no sample, so both modes give the same.
q.SQL["chi_or_pairs"] = q.SQL["pair_or_chi"] = _EITHER


@query(f"{WIN}, k AS (SELECT * FROM wins), {CHI} SELECT chrom, bin_id, df, CASE WHEN df > 0 AND chi > 0 THEN round({TAIL}, 6) ELSE 1.0 END AS p FROM chi")
def chi_square_p(spark, d):
    """The tail for any degrees of freedom; the SQL adds up the incomplete gamma function's series."""
    return diff.chi_square(q.win_counts(spark, d)).select("chrom", "bin_id", "df", F.round("p", 6).alias("p"))


@query(f"{WIN}, k AS (SELECT * FROM wins), {CHI} SELECT chrom, bin_id, hits::BIGINT AS hits, df FROM chi JOIN tot USING (chrom, bin_id) WHERE hits >= 12 AND df + 1 >= 4 AND (CASE WHEN df > 0 AND chi > 0 THEN {TAIL} ELSE 1.0 END) <= 0.5")
def gated_bins(spark, d):
    """Bins of enough hits and samples whose probability is small enough."""
    counts = q.win_counts(spark, d)
    stats = diff.chi_square(counts).join(diff.expected(counts).select("chrom", "bin_id", "hits"), ["chrom", "bin_id"]).withColumn("n_cpg", F.lit(1))
    return counts_.bin_gate(stats, least_hits=12, most_p=0.5, least_samples=4).select("chrom", "bin_id", "hits", "df")


@query(f"""{ALL}, x AS (SELECT b.chrom, b.bin_id, c.pos, count(k.pos) FILTER (k.meth) AS m, count(k.pos) FILTER (NOT k.meth) AS u FROM ncpg b JOIN cpgs c ON c.chrom = b.chrom AND c.pos BETWEEN b.start AND b.stop LEFT JOIN calls k ON k.chrom = c.chrom AND k.pos = c.pos AND k.sample_no = 1 GROUP BY ALL)
    SELECT chrom, bin_id, pos::VARCHAR AS place, CASE WHEN m + u > 0 THEN printf('%.2f', 100.0 * m / (m + u)) ELSE '-' END AS percent FROM x WHERE m + u > 0""")
def cpg_percents(spark, d):
    """Methylated percent of sample 1 at each of its CpGs."""
    b = bins_.with_cpgs(q.v_bins(spark, d), q.v_cpgs(spark, d))
    by_cpg = counts_.cpg_counts(q.v_calls(spark, d), q.v_cpgs(spark, d), b)
    return counts_.cpg_percent(by_cpg).where("slot > 0 and percent <> '-'").drop("slot")


# Reads.


@query(f"""{READS}, h AS (SELECT doc_id, seq, strpos(seq, 'AGATCG') AS place FROM reads), t AS (SELECT *, CASE WHEN place > 0 THEN place - 1 ELSE length(seq) END AS n FROM h)
    SELECT doc_id, md5(substr(seq, 1, least(n, 100))) AS trimmed, md5(substr(seq, 1, n) || repeat('N', length(seq) - n)) AS filled FROM t""")
def trimmed_texts(spark, d):
    """Trimmed to a longest length, and filled with N to the read's length."""
    made = clean.cleaned(q.v_reads(spark, d), ["AGATCG"], clean.Trim(shortest_prefix=6, identity=100.0, repeats=-1))
    s, e = F.col("trim_start"), F.col("trim_end")
    return made.select("doc_id", F.md5(clean.trimmed(F.col("seq"), s, e, 100).cast("binary")).alias("trimmed"), F.md5(clean.filled(F.col("seq"), s, e).cast("binary")).alias("filled"))


@query(f"""{READS}, h AS (SELECT doc_id, seq, strpos(seq, 'AGATCG') AS p FROM reads), t AS (SELECT doc_id AS read_no, (CASE WHEN p > 0 THEN p - 1 ELSE length(seq) END)::INT AS n FROM h),
    h2 AS (SELECT doc_id, reverse(seq) AS seq FROM reads), t2 AS (SELECT doc_id AS read_no, (CASE WHEN strpos(seq, 'AGATCG') > 0 THEN strpos(seq, 'AGATCG') - 1 ELSE length(seq) END)::INT AS n FROM h2)
    SELECT a.read_no, a.n AS trim_end_1, b.n AS trim_end_2 FROM t a JOIN t2 b USING (read_no) WHERE a.n >= 200 AND b.n >= 200""")
def trimmed_pairs(spark, d):
    """Pairs whose reads are both long enough after cleaning."""
    how = clean.Trim(shortest_prefix=6, identity=100.0, repeats=-1, shortest=200)
    reads = q.v_reads(spark, d).withColumnRenamed("doc_id", "read_no")
    first, second = clean.cleaned(reads, ["AGATCG"], how), clean.cleaned(reads.withColumn("seq", F.reverse("seq")), ["AGATCG"], how)
    return clean.valid_pairs(first, second).select("read_no", "trim_end_1", "trim_end_2")


@query("""WITH r AS (SELECT o_orderkey AS read_no, md5(o_orderkey::VARCHAR) || md5((o_orderkey + 7)::VARCHAR) AS qual FROM orders),
    s AS (SELECT read_no, unnest(range(1, 65)) AS i, qual FROM r), g AS (SELECT read_no, i, ascii(substr(qual, i, 1)) - 33 >= 20 AS good FROM s),
    k AS (SELECT read_no, i, i - row_number() OVER (PARTITION BY read_no ORDER BY i) AS run FROM g WHERE good), n AS (SELECT read_no, min(i) - 1 AS a, max(i) AS b FROM k GROUP BY read_no, run),
    o AS (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY a) AS t FROM n),
    best AS (SELECT read_no, max(b - a) AS len FROM n GROUP BY read_no)
    SELECT read_no, len::INT AS longest FROM best""")
def quality_runs(spark, d):
    """Length of the longest run of good scores."""
    qual = F.concat(F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.md5((F.col("o_orderkey") + 7).cast("string").cast("binary")))
    reads = q.read(spark, d, "orders").select(F.col("o_orderkey").alias("read_no"), qual.alias("qual"))
    runs = F.transform(F.split(F.array_join(F.transform(seq_.phred_scores(F.col("qual")), lambda s: F.when(s >= 20, "x").otherwise(" ")), ""), " "), lambda r: F.length(r))
    return reads.select("read_no", F.array_max(runs).alias("longest"))


# Sequence functions.


@query(f"""{READS}, c AS (SELECT regexp_extract_all(regexp_replace(seq, '[^ACGT]', '', 'g'), '...') AS x FROM reads), u AS (SELECT unnest(x) AS codon FROM c)
    SELECT codon, CASE codon WHEN 'AGA' THEN '*' WHEN 'AGG' THEN '*' WHEN 'ATA' THEN 'M' WHEN 'TGA' THEN 'W' ELSE substr('{seq_.STANDARD}', 1 + 16 * (strpos('TCAG', substr(codon, 1, 1)) - 1) + 4 * (strpos('TCAG', substr(codon, 2, 1)) - 1) + strpos('TCAG', substr(codon, 3, 1)) - 1, 1) END AS residue, count(*) AS n FROM u GROUP BY ALL""")
def codon_usage(spark, d):
    """By a mitochondrial code."""
    reads = q.v_reads(spark, d).select(F.regexp_replace("seq", "[^ACGT]", "").alias("seq"))
    return seq_.codon_usage(reads, code="vertebrate_mitochondrial")


@query(f"{READS}, p AS (SELECT doc_id, seq, list_filter(range(1, length(seq) + 1), lambda i: regexp_matches(substr(seq, i, 3), '^GA[CT]')) AS hits FROM reads) SELECT doc_id, coalesce(list_min(hits), 0)::INT AS first, coalesce(list_max(hits), 0)::INT AS last FROM p")
def ambiguous_matches(spark, d):
    return q.v_reads(spark, d).select("doc_id", seq_.first_match(F.col("seq"), "GAY").alias("first"), seq_.last_match(F.col("seq"), "GAY").alias("last"))


IUB_SQL = "(VALUES " + ", ".join(f"('{c}', {sum({'A': 1, 'C': 2, 'G': 4, 'T': 8}[b] for b in bs)})" for c, bs in seq_.BASES.items()) + ") t(code, mask)"


@query(f"SELECT a.code AS a, b.code AS b, a.mask & b.mask <> 0 AS matches FROM (SELECT * FROM {IUB_SQL}) a CROSS JOIN (SELECT * FROM {IUB_SQL}) b")
def iub_matches(spark, d):
    codes = spark.createDataFrame([(c,) for c in seq_.BASES], "a string")  # sixteen codes
    return codes.crossJoin(codes.withColumnRenamed("a", "b")).select("a", "b", seq_.iub_match(F.col("a"), F.col("b")).alias("matches"))


@query("SELECT event_id, url_decode(replace(props, '+', '%2B')) AS plain, md5('>' || regexp_replace(string_split('@' || event_type || ' x', ' ')[1], '^@', '') || chr(10) || props) AS record FROM events")
def converted_texts(spark, d):
    e = q.read(spark, d, "events")
    record = seq_.fasta_record(F.concat(F.lit("@"), F.col("event_type"), F.lit(" x")), F.col("props"))
    return e.select("event_id", seq_.url_decoded(F.col("props")).alias("plain"), F.md5(record.cast("binary")).alias("record"))


@query("WITH t AS (SELECT s_suppkey, (s_suppkey % 48 + 1)::INT AS n FROM supplier) SELECT s_suppkey, ((n - 1) // 24 + 1) * 1000 + ((n - 1) // 8 % 3 + 1) * 100 + (n - 1) % 8 + 1 AS code, n AS back FROM t")
def tile_codes(spark, d):
    """Tiles of the 3.3 layout, there and back."""
    n = (F.col("s_suppkey") % 48 + 1).cast("int")
    code = calling.tile_code(n, "3.3")
    return q.read(spark, d, "supplier").select("s_suppkey", code.cast("bigint").alias("code"), calling.plain_tile(code, "3.3").alias("back"))


@query("SELECT s_suppkey, (s_suppkey % 120)::INT AS tile, (s_suppkey * 3)::INT AS x, (s_suppkey + 5)::INT AS y, (s_suppkey % 9)::INT AS fasta_tile FROM supplier")
def read_headers(spark, d):
    s = q.read(spark, d, "supplier")
    head = F.format_string("@M:1:%d:%d:%d#0/1", F.col("s_suppkey") % 120, F.col("s_suppkey") * 3, F.col("s_suppkey") + 5)
    fasta = F.format_string(">s1_%d_%d_%d", F.col("s_suppkey") % 9, F.col("s_suppkey"), F.col("s_suppkey"))
    t = calling.tile_of(head)
    return s.select("s_suppkey", t["tile"].alias("tile"), t["x"].alias("x"), t["y"].alias("y"), calling.tile_of(fasta, "fasta")["tile"].alias("fasta_tile"))


# Annotation.


@query(f"WITH {FEATURES} SELECT feat_no, concat_ws(chr(9), chrom, type, feat_no, strand, lo, hi, lo, hi) AS line FROM feats")
def feature_dump(spark, d):
    return sinks.feature_lines(q.v_features(spark, d).withColumn("id", F.col("feat_no").cast("string")))


@query(f"WITH {FEATURES} SELECT chrom || chr(9) || count(*) AS line FROM feats GROUP BY chrom")
def chromosome_dump(spark, d):
    return sinks.chromosome_lines(q.v_features(spark, d))


@query(f"WITH {FEATURES} SELECT feat_no FROM feats WHERE type IN ('1-URGENT', '2-HIGH') AND strand = '-' AND feat_no % 3 = 1")
def filtered_features(spark, d):
    f = q.v_features(spark, d).withColumn("biotype", F.when(F.col("strand") == "-", "Coding").otherwise("other")).withColumn("quals", F.create_map(F.lit("level"), (F.col("feat_no") % 3).cast("string")))
    return annotate.filtered(f, ["1-URGENT", "2-HIGH"], ["coding"], attributes={"level": "1"}).select("feat_no")


SEGMENTS = f"WITH {FEATURES}, {REGIONS}, g AS (SELECT *, lo + 2 AS a, lo + 5 AS b, hi + 3 AS c, hi + 20 AS d FROM feats)"


def v_genes(spark, d):
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    lo, hi = F.col("start"), F.col("end")
    return q.v_features(spark, d).withColumn("segments", F.array(span(lo, lo + 2), span(lo + 5, hi + 3), span(hi + 6, hi + 20))).withColumn("end", hi + 20)


@query(f"WITH {FEATURES} SELECT feat_no, (3 + (hi + 3 - lo - 5 + 1) + 15)::BIGINT AS spliced, 2::INT AS n_introns, (lo + 3)::INT AS first_start, (lo + 4)::INT AS first_end FROM feats")
def spliced_features(spark, d):
    g = v_genes(spark, d).withColumn("introns", annotate.introns(F.col("segments")))
    return g.select("feat_no", annotate.spliced_length(F.col("segments")).alias("spliced"), F.size("introns").alias("n_introns"), F.col("introns")[0]["start"].alias("first_start"), F.col("introns")[0]["end"].alias("first_end"))


@query(f"""{SEGMENTS}, p AS (SELECT region_no, feat_no, strand, s, e, lo, hi + 20 AS last,
        CASE WHEN s BETWEEN lo AND a THEN 0 WHEN s BETWEEN b AND c THEN 1 WHEN s BETWEEN hi + 6 AND d THEN 2 ELSE -1 END AS i, CASE WHEN e BETWEEN lo AND a THEN 0 WHEN e BETWEEN b AND c THEN 1 WHEN e BETWEEN hi + 6 AND d THEN 2 ELSE -1 END AS j,
        (lo <= s)::INT + (b <= s)::INT + (hi + 6 <= s)::INT AS si, (lo <= e)::INT + (b <= e)::INT + (hi + 6 <= e)::INT AS ei FROM regs r JOIN g ON r.chrom = g.chrom AND g.lo <= r.e + 50 AND g.d >= r.s - 50)
    SELECT region_no, feat_no, CASE WHEN s BETWEEN lo AND last AND e BETWEEN lo AND last THEN
            CASE WHEN i >= 0 AND i = j THEN 'on_exon' WHEN i >= 0 AND j >= 0 THEN 'intron_internal' WHEN j >= 0 THEN CASE WHEN strand = '-' THEN 'exon_intron_boundary' ELSE 'intron_exon_boundary' END
                 WHEN i >= 0 THEN CASE WHEN strand = '-' THEN 'intron_exon_boundary' ELSE 'exon_intron_boundary' END WHEN si = ei THEN 'on_intron' ELSE 'exon_internal' END
        WHEN lo BETWEEN s AND e THEN '5prime' WHEN last BETWEEN s AND e THEN '3prime' WHEN CASE WHEN strand = '-' THEN s > last ELSE e < lo END THEN 'upstream' ELSE 'Unknown' END AS class FROM p""")
def exon_classes(spark, d):
    """Regions against the genes within 50 bases."""
    from ..operators.intervals import overlaps

    r = q.v_regions(spark, d).select("region_no", "chrom", (F.col("s") - 50).alias("start"), (F.col("e") + 50).alias("end"), "s", "e")
    g = v_genes(spark, d).select("chrom", "feat_no", "strand", "segments", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    pairs = overlaps(r.select("chrom", "region_no", "start", "end"), g)
    pairs = pairs.join(r.select("region_no", "s", "e"), "region_no")
    return pairs.select("region_no", "feat_no", annotate.exon_class(F.col("s"), F.col("e"), F.col("b_start"), F.col("b_end"), F.col("strand"), F.col("segments")).alias("class"))


@query(f"""{SEGMENTS}, p AS (SELECT feat_no, strand, lo, a, b, c, hi + 6 AS f, d, x, CASE WHEN x BETWEEN lo AND a THEN 0 WHEN x BETWEEN b AND c THEN 1 WHEN x BETWEEN hi + 6 AND d THEN 2 ELSE -1 END AS i
        FROM g, (SELECT unnest([0, 4, 7, 26]) AS off), LATERAL (SELECT lo + off AS x)),
    n AS (SELECT *, greatest(least(a, x) - lo + 1, 0) + greatest(least(c, x) - b + 1, 0) + greatest(least(d, x) - f + 1, 0) AS below, greatest(a - greatest(lo, x) + 1, 0) + greatest(c - greatest(b, x) + 1, 0) + greatest(d - greatest(f, x) + 1, 0) AS above FROM p)
    SELECT feat_no, x::INT AS pos, i::INT AS segment, CASE WHEN i < 0 THEN 0 ELSE i END::INT AS introns, CASE WHEN i < 0 THEN 0 WHEN strand = '-' THEN i ELSE 2 - i END::INT AS to_3p,
        CASE WHEN i < 0 THEN -1 WHEN strand = '-' THEN above ELSE below END::BIGINT AS from_5p, CASE WHEN i < 0 THEN -1 WHEN strand = '-' THEN below ELSE above END::BIGINT AS from_3p FROM n""")
def spliced_places(spark, d):
    """Positions on genes' segments: introns up to them and beyond, spliced distances from both ends."""
    at = F.explode(F.array(*(F.col("start") + n for n in (0, 4, 7, 26)))).alias("pos")
    g = v_genes(spark, d).select("feat_no", "strand", "segments", "start", at)
    x = (F.col("segments"), F.col("pos"))
    return g.select(
        "feat_no", "pos", annotate.segment_of(*x).alias("segment"), annotate.introns_between(x[0], F.col("start"), x[1]).alias("introns"), annotate.introns_beyond(*x, F.col("strand")).alias("to_3p"),
        annotate.spliced_distance(*x, F.col("strand")).alias("from_5p"), annotate.spliced_distance(*x, F.col("strand"), from_3p=True).alias("from_3p"),
    )


@query(f"""{SEGMENTS} SELECT feat_no, feat_no % 4 <> 2 AS same, CASE feat_no % 4 WHEN 0 THEN 'abuts' WHEN 1 THEN CASE strand WHEN '-' THEN '3p_abut' ELSE '5p_abut' END WHEN 2 THEN 'included' ELSE 'included' END AS overlap FROM g""")
def nested_features(spark, d):
    """Genes against parts of themselves: all, all but some bases of the end, another intron, the middle segment."""
    lo, hi, k = F.col("start"), F.col("end") - 20, F.col("feat_no") % 4
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    whole = F.col("segments")
    short = F.array(span(lo, lo + 2), span(lo + 5, hi + 3), span(hi + 6, hi + 9))
    other = F.array(span(lo + 1, lo + 2), span(lo + 6, hi + 2))
    inner = F.when(k == 0, whole).when(k == 1, short).when(k == 2, other).otherwise(F.array(span(lo + 6, hi + 2)))
    g = v_genes(spark, d).withColumn("inner", inner)
    low, high = F.get("inner", F.lit(0))["start"], F.get("inner", F.size("inner") - 1)["end"]
    return g.select("feat_no", annotate.same_splicing(whole, F.col("inner")).alias("same"), annotate.feature_overlap(whole, F.col("start"), F.col("end"), F.col("strand"), low, high).alias("overlap"))


@query(f"""{READS}, u AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS k FROM reads WHERE length(seq) > 0),
    w AS (SELECT doc_id, k, c, lag(c) OVER o AS c1, lag(c, 2) OVER o AS c2, lag(c, 3) OVER o AS c3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    h AS (SELECT doc_id, k AS stop, CASE WHEN c3 || c2 || c1 || c = 'CCGG' THEN 4 WHEN c2 || c1 || c IN ('GAC', 'GAT') THEN 3 WHEN c1 || c = 'CG' THEN 2 END AS n FROM w)
    SELECT doc_id, n::BIGINT AS size, count(*) AS n, sum(stop - n + 1)::BIGINT AS starts, sum(stop)::BIGINT AS ends FROM h WHERE h.n IS NOT NULL GROUP BY doc_id, h.n""")
def many_motifs(spark, d):
    """The longest of several motifs at each base, by their size."""
    hits = q.v_reads(spark, d).select("doc_id", F.explode(seq_.motif_hits(F.col("seq"), ["CG", "CCGG", "GAY"])).alias("h"))
    hits = hits.select("doc_id", (F.col("h.end") - F.col("h.start") + 1).cast("bigint").alias("size"), F.col("h.start").alias("s"), F.col("h.end").alias("e"))
    return hits.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))

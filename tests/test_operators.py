import random

import pytest
from cytofold.operators import annotate, bins, calling, clean, counts, depth, diff, intervals
from cytofold.plans import workflows
from pyspark.sql import functions as F

T = "AACCGGTTCGAACCGGACGT"


@pytest.fixture(scope="module")
def chunks(spark):
    return bins.chunked(spark.createDataFrame([("T", T)], "chrom string, seq string"), size=7, overlap=10)


@pytest.fixture(scope="module")
def lengths(spark):
    return spark.createDataFrame([("T", 20)], "chrom string, length int")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_fragments(chunks, lengths):
    made = bins.with_cpgs(bins.fragments(bins.site_positions(chunks, ["C^CGG"]), lengths), bins.motif_table(chunks))
    assert rows(made, "bin_id", "start", "end", "n_cpg") == [(0, 1, 3, 0), (1, 4, 13, 2), (2, 14, 20, 2)]
    compat = bins.with_cpgs(bins.fragments(bins.site_positions(chunks, ["C^CGG"]), lengths), bins.motif_table(chunks), compat=True)
    assert [r[3] for r in rows(compat, "bin_id", "start", "end", "n_cpg")] == [0, 2, 1]
    assert rows(bins.motif_table(chunks), "pos") == [(4,), (9,), (14,), (18,)]
    assert rows(bins.fragments(bins.site_positions(chunks, ["C^CGG"]), lengths, tail=False), "start", "end") == [(1, 3), (4, 13)]
    assert rows(bins.digest(chunks, lengths, ["C^CGG"], 5, 9), "start", "end") == [(14, 20)]


def test_windows_and_pruning(spark, lengths):
    w = bins.windows(lengths, 8)
    assert rows(w, "start", "end") == [(1, 8), (9, 16), (17, 24)]
    assert bins.sized(w, 9, 20).count() == 0 and bins.sized(w).count() == 3
    with pytest.raises(Exception, match="before it starts"):
        bins.user_bins(spark.createDataFrame([("T", 9, 3, 1)], "chrom string, start int, end int, line_no int")).collect()


def test_merging(spark):
    b = spark.createDataFrame([("a", 1, 5, 1), ("a", 6, 9, 2), ("a", 10, 12, 0), ("a", 20, 30, 9), ("b", 1, 2, 1)], "chrom string, start int, end int, n_cpg int")
    assert rows(intervals.merge_runs(b, sums=("n_cpg",)), "chrom", "start", "end", "n_cpg") == [("a", 1, 12, 3), ("a", 20, 30, 9), ("b", 1, 2, 1)]
    assert rows(intervals.gaps(b)) == [("a", 13, 19)]
    assert rows(bins.amalgamated(b, 3), "chrom", "start", "end", "n_cpg") == [("a", 1, 9, 3), ("a", 10, 12, 0), ("a", 20, 30, 9), ("b", 1, 2, 1)]
    assert rows(intervals.rebased(b), "chrom", "new_start", "new_end")[:4] == [("a", 1, 5), ("a", 6, 9), ("a", 10, 12), ("a", 13, 23)]


@pytest.mark.parametrize("seed", range(2))
def test_interval_joins(spark, seed):
    rng = random.Random(seed)
    points = [(rng.choice("ab"), rng.randint(-5, 3000)) for _ in range(200)]
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 3, 40, 700, 5000]), i) for i, s in enumerate(rng.randint(-10, 3000) for _ in range(80))]
    p, b = spark.createDataFrame(points, "chrom string, pos int"), spark.createDataFrame(spans, "chrom string, start int, end int, i int")
    want = sorted((c, x, i) for c, x in points for d, s, e, i in spans if c == d and s <= x <= e)
    assert rows(intervals.point_in_interval(p, b), "chrom", "pos", "i") == want
    hit = {(c, x) for c, x, _ in want}
    assert rows(intervals.point_in_interval(p, b, how="left_anti")) == sorted(x for x in points if x not in hit)
    assert rows(intervals.point_in_interval(p, b, how="left_semi")) == sorted(x for x in points if x in hit)
    assert intervals.point_in_interval(p, b, how="left").count() == len(want) + sum(x not in hit for x in points)
    other = b.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("i").alias("j")).where("j % 2 = 0")
    pairs = rows(intervals.overlaps(b.where("i % 2 = 1"), other), "i", "j")
    assert pairs == sorted((i, j) for c, s, e, i in spans for d, t, f, j in spans if c == d and i % 2 and not j % 2 and s <= f and t <= e)


@pytest.mark.parametrize("after", [True, False])
def test_best_beyond(spark, after):
    rng = random.Random(7)
    points = [(i, rng.choice("ab"), rng.randint(0, 500)) for i in range(80)]
    feats = [(i, rng.choice("ab"), rng.randint(0, 500), rng.randint(0, 9)) for i in range(60)]
    made = intervals.best_beyond(spark.createDataFrame(points, "k int, chrom string, at int"), spark.createDataFrame(feats, "feat_no int, chrom string, a int, v int"), "at", "a", F.col("v"), after, block=16)
    got = {r.k: (r.best and (int(r.best.score), r.best.feat_no)) for r in made.collect()}
    for k, c, x in points:
        assert got[k] == min(((v, i) for i, d, a, v in feats if c == d and (a > x if after else a < x)), default=None)


@pytest.mark.parametrize("internal", [False, True])
def test_nearest_is_brute_force(spark, internal):
    rng = random.Random(11)
    regions = [(i, rng.choice("ab"), s, s + rng.randint(0, 60)) for i, s in enumerate(rng.randint(1, 2000) for _ in range(80))]
    feats = [(i, rng.choice("ab"), s, s + rng.randint(0, 200), rng.choice("+-")) for i, s in enumerate(rng.randint(1, 2000) for _ in range(50))]

    def place(q, lo, hi, m):
        return "in" if lo <= q <= hi else "5" if (q > hi if m == "-" else q < lo) else "3"

    def kind(s, e, lo, hi, m):
        a, b = place(s, lo, hi, m), place(e, lo, hi, m)
        table = {("in", "in"): 3, ("in", "3"): 5, ("in", "5"): 2 if m == "-" else 0, ("5", "5"): 1, ("5", "in"): 2, ("5", "3"): 4, ("3", "3"): 6, ("3", "5"): 4, ("3", "in"): 5}
        return table[a, b]

    got = {r.region_no: (r.score, r.feat_no, r.relation) for r in annotate.nearest(spark.createDataFrame(regions, "region_no int, chrom string, s int, e int"), spark.createDataFrame(feats, "feat_no int, chrom string, start int, end int, strand string"), internal=internal).collect()}
    for i, c, s, e in regions:
        every = [((s - hi + 1 if m == "-" else lo - e + 1) + (hi - lo + 1 if internal else 0), j, annotate.RELATIONS[kind(s, e, lo, hi, m)]) for j, d, lo, hi, m in feats if c == d and kind(s, e, lo, hi, m) < (6 if internal else 3)]
        assert got.get(i) == min(every, default=None)


def test_islands_and_exons(spark):
    cases = [(100, 200, 50, 300, "CpGI_core"), (10, 200, 50, 300, "CpGI_coreshore"), (5000, 5100, 8000, 9000, "CpGI_shelf"), (6500, 7000, 8000, 9000, "CpGI_shore"), (5500, 6500, 8000, 9000, "CpGI_shoreshelf"), (1, 99999, 8000, 9000, "-"), (7000, 10000, 8000, 9000, "CpGI_shelfoverlap"), (1, 5000, 8000, 9000, "CpGI_shelfoverlap"), (200, 100, 50, 300, "CpGI_core")]
    df = spark.createDataFrame(cases, "s int, e int, lo int, hi int, want string")
    assert [r[0] for r in df.select(annotate.island_class(F.col("s"), F.col("e"), F.col("lo"), F.col("hi"))).collect()] == [c[4] for c in cases]
    segments = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (30, 40))))
    cases = [(12, 15, "+", "on_exon"), (12, 35, "+", "intron_internal"), (15, 25, "+", "exon_intron_boundary"), (25, 35, "+", "intron_exon_boundary"), (25, 35, "-", "exon_intron_boundary"), (22, 25, "+", "on_intron"), (5, 12, "+", "5prime"), (35, 50, "+", "3prime"), (1, 5, "+", "upstream"), (50, 60, "-", "upstream"), (50, 60, "+", "Unknown")]
    df = spark.createDataFrame(cases, "s int, e int, strand string, want string")
    assert [r[0] for r in df.select(annotate.exon_class(F.col("s"), F.col("e"), F.lit(10), F.lit(40), F.col("strand"), segments)).collect()] == [c[3] for c in cases]


def test_calls_of_reads(spark, chunks):
    reads = spark.createDataFrame([(1, "T", 1, 0, "AATCGGTTTG"), (2, "T", 8, 16, "TCAAACC"), (3, "T", 19, 0, "GTTT")], "read_id int, chrom string, pos int, flag int, seq string")
    got = rows(calling.read_calls(reads, chunks), "read_id", "pos", "meth", "first_3p")
    assert got == [(1, 4, True, False), (1, 9, False, False), (2, 9, False, True)]
    assert rows(calling.read_calls(reads.where("read_id = 1"), chunks, every_c=True), "pos", "meth") == [(3, False), (4, True), (9, False)]
    sliced = spark.createDataFrame([(1, "T", 1, "+", "AATCGG", "AACCGG"), (2, "T", 3, "-", "CTGG", "CCGG")], "read_id int, chrom string, start int, strand string, seq string, genome string")
    assert rows(calling.slice_calls(sliced), "read_id", "pos", "meth") == [(1, 4, True), (2, 4, False)]


def test_tiles(spark):
    head = spark.createDataFrame([("@M:1:3:10:20", ">s1_3_10_20")], "q string, a string")
    r = head.select(calling.tile_of(F.col("q")).alias("q"), calling.tile_of(F.col("a"), "fasta").alias("a")).first()
    assert tuple(r.q) == tuple(r.a) == (3, 10, 20)
    for layout, codes in (("3.2", [1101, 1208, 2101, 2208]), ("3.3", [1101, 1308, 2101, 2308])):
        df = spark.createDataFrame([(c,) for c in codes], "c int").withColumn("n", calling.plain_tile(F.col("c"), layout))
        assert [r.c for r in df.select(calling.tile_code(F.col("n"), layout).alias("c")).collect()] == codes
        assert [r.n for r in df.collect()][:1] == [1]


def test_counts_conserve_calls(spark):
    rng = random.Random(2)
    calls = spark.createDataFrame([("a", rng.randint(1, 100), s, s % 2 + 1, rng.random() < 0.5, False) for _ in range(300) for s in [rng.randint(0, 3)]], "chrom string, pos int, sample_no int, group_no int, meth boolean, first_3p boolean")
    b = spark.createDataFrame([("a", 0, 1, 20), ("a", 1, 15, 40), ("a", 2, 60, 90)], "chrom string, bin_id bigint, start int, end int")
    made = counts.bin_counts(calls, b)
    assert made.agg(F.sum(F.col("meth") + F.col("unmeth"))).first()[0] + counts.missed(calls, b).count() == 300
    samples = calls.select("sample_no", "group_no").distinct()
    assert counts.dense(made, b, samples).count() == 3 * samples.count()
    moved = counts.bin_counts(spark.createDataFrame([("a", 60, 0, 1, True, True), ("a", 40, 0, 1, True, True)], calls.schema), b, first_hit_back=True)
    assert rows(moved, "bin_id", "meth") == [(1, 1)]


def test_anova(spark):
    data = [("a", 0, i, g, m, 10 - m, True) for i, (g, m) in enumerate([(1, 2), (1, 4), (2, 6), (2, 8)])]
    r = diff.anova(spark.createDataFrame(data, "chrom string, bin_id bigint, sample_no int, group_no int, meth bigint, unmeth bigint, used boolean")).first()
    assert (r.ss_total, r.ss_treat, r.f, r.df1, r.df2, r.greater) == (pytest.approx(0.2), pytest.approx(0.16), pytest.approx(8.0), 1, 2, 2)
    assert r.p == pytest.approx(0.105573, abs=1e-6)


@pytest.mark.parametrize("mode", list(diff.MODES))
def test_modes(spark, mode):
    data = [("a", b, i, i % 2 + 1, 20 * (1 + i), 30, True, 7) for b in range(2) for i in range(4)]
    made = diff.bin_stats(spark.createDataFrame(data, "chrom string, bin_id bigint, sample_no int, group_no int, meth bigint, unmeth bigint, used boolean, n_cpg int"), mode)
    assert made.count() == {"P": 12}.get(mode, 2)


def test_gate(spark):
    stats = spark.createDataFrame([(0, 0, 1.0, 0), (5, 9, 0.01, 1), (5, 9, 0.5, 1), (1, 9, 0.01, 1)], "n_cpg int, hits int, p double, df int")
    assert rows(counts.bin_gate(stats, 2, 1, 0.05)) == [(0, 0, 1.0, 0), (5, 9, 0.01, 1)]


def test_depth(spark):
    d = spark.createDataFrame([("a", i, x, 0) for i, x in enumerate([0, 0, 1, 3])], "chrom string, pos int, meth bigint, unmeth bigint")
    r = depth.statistics(d).first()
    assert (r.mean, r.mode, r.median, r.sd) == (1.0, 0, 0.5, pytest.approx(1.414214, abs=1e-6))
    assert rows(depth.histogram(d)) == [(0, 2), (1, 1), (2, 0), (3, 1)]
    sparse = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 9, 0)], d.schema)
    assert [r.line for r in depth.bars(depth.histogram(sparse)).orderBy("depth").collect()][1] == "[...]"


def test_cleaning(spark):
    finder = clean.Finder(["AGATCGGAAG"], clean.Trim())
    assert finder.span("CCCCAGATCGGAAGCC", None) == (0, 4, True)
    assert finder.span("CCCCAGATCG", None) == (0, 4, True)
    assert finder.span("CCCCAGATC", None) == (0, 9, True)
    assert clean.Finder(["AGATCGGAAG"], clean.Trim(mismatch=True)).span("CCCCAGATGGGAAG", None)[1] == 4
    q = clean.Finder([], clean.Trim(quality=20))
    text = "".join(chr(33 + x) for x in (30, 30, 10, 30, 30, 30, 30))
    assert q.span("ACGTACG", text) == (3, 7, True)
    assert clean.Finder([], clean.Trim(quality=20, compat=True)).span("ACGTACG", text) == (0, 7, True)
    reads = spark.createDataFrame([(1, "CCCCAGATCGGAAG", "I" * 14), (2, "AGATCGGAAG", "I" * 10)], "read_no int, seq string, qual string")
    assert rows(workflows.clean_reads(reads, ["AGATCGGAAG"]), "read_no", "seq", "qual") == [(1, "CCCC", "IIII")]
    assert rows(workflows.clean_reads(reads, ["AGATCGGAAG"], mode="fill"), "seq") == [("CCCC" + "N" * 10,)]
    assert workflows.clean_pairs(reads, reads.withColumn("seq", F.lit("ACGT")), ["AGATCGGAAG"]).count() == 1


def test_comparison(spark, chunks, lengths):
    calls = spark.createDataFrame([("T", p, s, s + 1, (p + s) % 2 == 0) for p in (4, 9, 14, 18) for s in (0, 1) for _ in range(12)], "chrom string, pos int, sample_no int, group_no int, meth boolean")
    samples = spark.createDataFrame([(0, 1), (1, 2)], "sample_no int, group_no int")
    b = workflows.fragment_bins(chunks, lengths, workflows.Comparison(shortest=1, longest=30))
    assert rows(b, "start", "end", "n_cpg") == [(4, 13, 2), (14, 20, 2)]
    assert rows(workflows.compare(calls, samples, bins=b), "bin_id", "kind", "df") == [(1, "chi", 1), (2, "chi", 1)]
    assert workflows.compare(calls, samples, workflows.Comparison(mode="P", window=10)).count() == 2
    joined = workflows.fragment_bins(chunks, lengths, workflows.Comparison(shortest=1, longest=30, join_adjacent=True))
    assert rows(joined, "start", "end", "n_cpg") == [(4, 20, 4)]


def test_regions_and_segments(spark, chunks):
    r = spark.createDataFrame([("T", 4, 9), ("T", 16, 20)], "chrom string, start int, end int")
    assert rows(bins.region_sequences(r, chunks), "seq") == [("CGGTTC",), ("GACGT",)]
    assert rows(bins.composition(r, chunks)) == [("T", 1, 3, 4, 3, 0)]
    segments = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (21, 25), (30, 40))))
    x = spark.range(1).select(annotate.introns(segments).alias("i"), annotate.spliced_length(segments).alias("n")).first()
    assert ([tuple(g) for g in x.i], x.n) == ([(26, 29)], 27)


def test_fragment_based(spark):
    regions = spark.createDataFrame([(1, "a", 100, 120), (2, "b", 100, 120)], "region_no int, chrom string, s int, e int")
    starts = spark.createDataFrame([(1, "a", 200, 210, "+")], "feat_no int, chrom string, start int, end int, strand string")
    islands = spark.createDataFrame([(7, "a", 20, 30, "+"), (8, "b", 200, 300, "+")], starts.schema)
    got = annotate.fragment_based(regions, starts, islands)
    assert rows(got, "region_no", "tss_no", "island_no", "tss_distance", "island_distance") == [(1, 1, 7, -109, 71)]


def test_long_lists_are_not_broadcast(spark):
    from cytofold.operators.sizes import small

    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(spark.range(5), 10)).lower()
    assert "broadcast" not in plan(small(spark.range(50), 10)).lower()


@pytest.mark.parametrize("size", [3, 7, 100])
def test_regions_and_reads_over_many_chunks(spark, size):
    small = bins.chunked(spark.createDataFrame([("T", T)], "chrom string, seq string"), size=size, overlap=2)
    places = [(a, b) for a in (1, 4, 7, 8, 15) for b in (a, a + 5, len(T)) if b <= len(T)] * 2
    r = spark.createDataFrame([("T", a, b, i) for i, (a, b) in enumerate(places)] + [("U", 1, 4, 99)], "chrom string, start int, end int, n int")
    assert sorted((x.n, x.seq) for x in bins.region_sequences(r, small).collect()) == [(i, T[a - 1 : b].upper()) for i, (a, b) in enumerate(places)]
    got = bins.composition(r.where("start = 1 and n < 3"), small).first()
    want = "".join(T[a - 1 : b].upper() for a, b in places[:3])
    assert (got.a, got.c, got.g, got.t) == tuple(want.count(x) for x in "ACGT")
    # Every CpG is called, from reads of the whole genome on both strands.
    reads = spark.createDataFrame([(1, "T", 1, 0, T), (2, "T", 1, 16, T)], "read_id bigint, chrom string, pos int, flag int, seq string")
    cpgs = [i + 1 for i in range(len(T)) if T[i : i + 2].upper() == "CG"]
    assert sorted((x.read_id, x.pos) for x in calling.read_calls(reads, small).collect()) == [(k, p) for k in (1, 2) for p in cpgs]


def test_runs_across_blocks(spark):
    """Blocks of a few bases give what one block gives, ties and gaps included."""
    spans = [("a", 1, 4), ("a", 5, 9), ("a", 10, 30), ("a", 31, 31), ("a", 40, 41), ("a", 42, 80), ("b", 3, 3), ("b", 3, 3), ("b", 4, 6), ("b", 90, 95)]
    df = spark.createDataFrame(spans, "chrom string, start int, end int")
    goes_on = lambda prev: F.col("start") == prev["end"] + 1
    for made in (
        lambda n: intervals.with_runs(df, goes_on, block=n),
        lambda n: intervals.gaps(df, block=n),
        lambda n: intervals.rebased(df, block=n),
        lambda n: intervals.beside(df, "end", "near", False, number="no", block=n),
        lambda n: intervals.beside(df, "start", "near", True, block=n),
    ):
        assert sorted(map(repr, made(3).collect())) == sorted(map(repr, made(1 << 16).collect()))
    assert sorted((r.chrom, r._run) for r in intervals.with_runs(df, goes_on, block=3).collect()) == [("a", 1)] * 4 + [("a", 2)] * 2 + [("b", 1), ("b", 2), ("b", 2), ("b", 3)]


def test_amalgamated_like_one_pass(spark):
    rng = random.Random(5)
    spans, at = [], 1
    for _ in range(400):
        at += rng.choice((0, 0, 0, 0, 7))
        size = rng.randint(1, 90)
        spans.append(("a", at, at + size - 1, rng.randint(0, 5)))
        at += size
    want, i = [], 0
    while i < len(spans):
        _, start, end, n = spans[i]
        if i + 1 < len(spans) and spans[i + 1][1] == end + 1 and min(n, spans[i + 1][3]) < 4 <= n + spans[i + 1][3]:
            want.append((start, spans[i + 1][2], n + spans[i + 1][3], 2))
            i += 2
        else:
            want.append((start, end, n, 1))
            i += 1
    made = bins.amalgamated(spark.createDataFrame(spans, "chrom string, start int, end int, n_cpg int"), 4)
    assert sorted((r.start, r.end, r.n_cpg, r.merged) for r in made.collect()) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("every_c, exact_flag, compat", [(False, False, False), (True, False, False), (True, False, True), (False, True, False)])
def test_calls_are_found_read_by_read(spark, every_c, exact_flag, compat):
    """Any letters, against brute force; a row is made for each call, not for each base of a read."""
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGTacgtCGNé世😀") for _ in range(600))
    pick = [(i, rng.choice([1, 2, rng.randint(3, 620)]), rng.choice([0, 16, 17, 1])) for i in range(60)]
    reads = [(i // 2, "T", p, f, "".join(c if rng.random() < 0.7 else rng.choice("ACGTctgaN世") for c in genome[p - 1 : p - 1 + rng.randint(0, 90)]) + rng.choice(["", "CGCG"])) for i, p, f in pick] + [(99, "T", 5, 0, None), (98, None, 5, 0, "CG"), (97, "T", 1, None, "CG"), (96, "T", 0, 0, genome)]
    want, ends = [], {}
    up = lambda s: "".join(c.upper() if "a" <= c <= "z" else c for c in s)
    g = " " + up(genome) + " " * 100
    for i, c, p, f, s in reads:
        if s is None or c is None or f is None or p < 1:
            continue
        back = f == 16 if exact_flag else bool(f & 16)
        for k, b in enumerate(up(s)):
            x = p + k
            if x > len(genome):
                break
            if back and b in "GA" and (g[x] == ("C" if compat else "G") if every_c else g[x] == "G" and g[x - 1] == "C") or not back and b in "CT" and g[x] == "C" and (every_c or g[x + 1] == "G"):
                want.append((i, x - (back and not every_c), b in "CG", back, k))
                ends[i] = max(ends.get(i, 0), k)
    made = calling.read_calls(spark.createDataFrame(reads, "read_id int, chrom string, pos int, flag int, seq string"), bins.chunked(spark.createDataFrame([("T", genome)], "chrom string, seq string"), 64, 8), every_c, exact_flag, compat)
    assert rows(made, "read_id", "pos", "meth", "first_3p") == sorted((i, x, m, back and k == ends[i]) for i, x, m, back, k in want)
    assert "posexplode" not in _plan(made) and "Window" not in _plan(made.drop("first_3p"))


def test_slices_are_called_read_by_read(spark):
    rng = random.Random(5)
    cases = [(i, "T", rng.randint(1, 50), rng.choice("+-"), "".join(rng.choice("ACGTcgé") for _ in range(rng.randint(0, 40))), "".join(rng.choice("ACGCGcgT世") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    pair = str.maketrans("ACGT", "TGCA")
    want = []
    for i, _, start, strand, s, g in cases:
        ref = g.replace("c", "C").replace("g", "G")
        ref = ref.translate(pair)[::-1] if strand == "-" else ref
        want += [(i, start + len(s) - 2 - k if strand == "-" else start + k, c in "Cc") for k, c in enumerate(s) if ref[k : k + 2] == "CG"]
    made = calling.slice_calls(spark.createDataFrame([*cases, (99, "T", 1, "+", "CG", None), (98, "T", 1, "+", None, "CG")], "read_id int, chrom string, start int, strand string, seq string, genome string"))
    assert rows(made, "read_id", "pos", "meth") == sorted(want)
    assert "posexplode" not in _plan(made)


def test_pieces_are_cut_in_blocks(spark):
    """A piece is cut from a block, whose length doesn't grow with the chromosome."""
    text = "".join(random.Random(1).choice("ACGTé世😀") for _ in range(5000))
    made = bins.chunked(spark.createDataFrame([("T", text), ("E", ""), ("S", "ACG")], "chrom string, seq string"), 4, 2)
    assert rows(made) == sorted([("T", i + 1, text[i : i + 6], 4) for i in range(0, 5000, 4)] + [("E", 1, "", 4), ("S", 1, "ACG", 4)])
    assert _plan(made).count("Generate explode") == 3


def test_motifs_are_looked_for_once(spark):
    """explode's filter of empty lists has no second search; any letters, against a plain search."""
    texts = ["".join(random.Random(i).choice("ACGTacgtNuU é世") for _ in range(i % 37)) for i in range(200)]
    df = bins.chunked(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chrom string, seq string"), 7, 6)
    up = [t.replace("c", "C").replace("g", "G").replace("a", "A").replace("t", "T") for t in texts]
    assert rows(bins.motif_table(df)) == sorted((str(i), k + 1) for i, t in enumerate(up) for k in range(len(t)) if t[k : k + 2] == "CG")
    assert rows(bins.motif_table(df, "GAY")) == sorted((str(i), k + 1) for i, t in enumerate(up) for k in range(len(t)) if t[k : k + 3] in ("GAC", "GAT"))
    assert _plan(bins.motif_table(df)).count("EvalPython") == 1


@pytest.mark.parametrize("block", [4, 1 << 13])
def test_points_in_intervals_that_are_apart(spark, block):
    """Each point goes once, to one sort: no probe for each level, no join."""
    rng = random.Random(block)
    spans, at = [], -40
    for i in range(60):
        at += rng.choice([1, 1, 2, 9])
        spans.append(("a", at, at + rng.choice([0, 1, 5, 30, 200]), i))
        at = spans[-1][2]
    spans += [("b", -5, 3000, 99), ("c", 9, 3, 98), (None, 1, 9, 97)]
    points = [(rng.choice(["a", "a", "b", "c", None]), rng.randint(-50, 1200), k % 7) for k in range(300)] + [("a", None, 0)] * 2
    p, b = spark.createDataFrame(points, "chrom string, pos int, k int"), spark.createDataFrame(spans, "chrom string, start int, end int, i int")
    assert intervals.apart(b) and not intervals.apart(b.union(b.where("i = 5")))
    made = intervals.point_in_interval(p, b, block=block)
    assert made.columns == ["chrom", "pos", "k", "start", "end", "i"]
    assert rows(made) == sorted((c, x, k, s, e, i) for c, x, k in points for d, s, e, i in spans if c is not None and x is not None and c == d and s <= x <= e)
    assert "Join" not in _plan(made) and _plan(made).count("Generate explode") == 1


def test_calls_go_to_the_first_bin(spark):
    """Bins that overlap are cut into stretches, calls aren't joined with each bin that holds them."""
    rng = random.Random(9)
    spans = [(rng.choice("ab"), i, s, s + rng.choice([-1, 0, 3, 40, 300])) for i, s in enumerate(rng.randint(-10, 500) for _ in range(80))]
    calls = [(rng.choice("ab"), rng.randint(-20, 800), rng.randint(0, 2), 1, rng.random() < 0.5) for _ in range(500)]
    b, c = spark.createDataFrame(spans, "chrom string, bin_id int, start int, end int"), spark.createDataFrame(calls, "chrom string, pos int, sample_no int, group_no int, meth boolean")
    want = {}
    for d, x, s, g, m in calls:
        held = [i for e, i, lo, hi in spans if d == e and lo <= x <= hi]
        if held:
            n = want.setdefault((d, min(held), s, g), [0, 0])
            n[not m] += 1
    assert rows(counts.bin_counts(c, b)) == sorted((*k, *v) for k, v in want.items())
    stretches = counts.first_bins(b)
    assert intervals.apart(stretches)
    assert "Join" not in _plan(counts.bin_counts(c, b.where("bin_id < 0")))


def test_only_what_is_found_comes_back_from_python(spark):
    reads = spark.createDataFrame([(i, "ACGT" * (i % 9) + "agATCGé" * (i % 3), "IIII" * i) for i in range(600)], "read_no int, seq string, qual string")
    made = clean.cleaned(reads, ["AGATCG"], clean.Trim(shortest_prefix=6, identity=100.0, repeats=-1))
    finder = clean.Finder(["AGATCG"], clean.Trim(shortest_prefix=6, identity=100.0, repeats=-1))
    assert rows(made, "read_no", "trim_start", "trim_end", "valid") == sorted((r.read_no, *finder.span(r.seq, None)) for r in reads.collect())
    assert sum(len(r.hits) for r in made.collect()) == sum(len(finder.hits(r.seq)) for r in reads.collect())
    assert "InPandas" not in _plan(made) and "qual" not in made.select("trim_end")._jdf.queryExecution().optimizedPlan().output().toString()

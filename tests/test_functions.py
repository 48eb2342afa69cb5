import math

import numpy as np
import pytest
from cytofold.functions import sequences as s, stats
from cytofold.sources import sinks
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_complement(spark):
    assert one(spark, s.reverse_complement(F.col("q")), q="AACgnRY-") == "-RYncGTT"
    assert one(spark, s.iub_match(F.col("a"), F.col("b")), a="R", b="G") and not one(spark, s.iub_match(F.col("a"), F.col("b")), a="R", b="C")
    assert one(spark, s.base_mask(F.col("a")), a="n") == 15


def test_motifs(spark):
    assert one(spark, s.motif_positions(F.col("q"), "CCGG"), q="AACCGGTTCGAACCGGACGT") == [3, 13]
    assert one(spark, s.motif_positions(F.col("q"), "AA"), q="AAAA") == [1, 2, 3]
    assert one(spark, s.motif_positions(F.col("q"), "CG", skip_others=True), q="CNNG") == [1]
    assert one(spark, s.motif_positions(F.col("q"), "CG"), q="CNNG") == []
    assert one(spark, s.motif_count(F.col("q"), "AA"), q="aaaa") == 3
    assert one(spark, s.first_match(F.col("q"), "RG"), q="TTAGGG") == 3
    assert one(spark, s.last_match(F.col("q"), "RG"), q="TTAGGG") == 5


def test_bisulphite_and_quality(spark):
    assert one(spark, s.bisulphite_mismatches(F.col("a"), F.col("b")), a="TTCA", b="CTCG") == 1
    assert one(spark, s.phred_scores(F.col("q")), q="!I") == [0, 40]
    assert one(spark, s.phred_symbol(F.col("q")), q=40) == "I"


def test_codons(spark):
    assert one(spark, s.translated(F.col("q")), q="ATGGCCTGAxx") == "MA*"
    assert one(spark, s.translated(F.col("q"), "vertebrate_mitochondrial"), q="TGAAUA") == "WM"
    assert one(spark, s.gcg_checksum(F.col("q")), q="ACGT") == (65 + 2 * 67 + 3 * 71 + 4 * 84) % 10000
    assert one(spark, s.url_decoded(F.col("q")), q="a%20b+c") == "a b+c"
    assert one(spark, s.proportion(F.col("m"), F.col("u")), m=0, u=0) == -1.0


def test_converters(spark):
    assert one(spark, s.before_first_r(F.col("q")), q="1rr") == "1"
    assert one(spark, s.before_first_r(F.col("q")), q="chr1") == "ch"
    assert one(spark, s.extractor_sign(F.col("q")), q="z") == "-"
    assert one(spark, s.fasta_record(F.col("h"), F.col("q")), h="@r1 x", q="ACGT") == ">r1\nACGT"


@pytest.mark.parametrize("table,p", [((3, 1, 1, 3), 16 / 70), ((0, 0, 0, 0), 1.0), ((5, 0, 0, 5), 1 / 252)])
def test_fisher_point(spark, table, p):
    got = one(spark, stats.fisher_point(*(F.col(c) for c in "abcd")), **dict(zip("abcd", table, strict=True)))
    assert got == pytest.approx(p, rel=1e-10)


def test_points_sum_to_one(spark):
    rows = spark.range(0, 8).select(F.col("id").alias("a"), (9 - F.col("id")).alias("b"), (7 - F.col("id")).alias("c"), (4 + F.col("id")).alias("d"))
    total = rows.select(F.sum(stats.fisher_point(F.col("a"), F.col("b"), F.col("c"), F.col("d")))).first()[0]
    assert total == pytest.approx(1.0, rel=1e-9)


def test_tails():
    x = np.array([0.0, 0.1, 1.0, 3.0, 20.0, 200.0])
    assert stats.chi_square_tail(x, np.full(6, 2)) == pytest.approx(np.exp(-x / 2), rel=1e-9)
    assert stats.chi_square_tail(x, np.full(6, 4)) == pytest.approx(np.exp(-x / 2) * (1 + x / 2), rel=1e-9)
    assert stats.chi_square_tail(x, np.full(6, 1)) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x], rel=1e-8)
    assert stats.f_tail(np.array([8.0]), np.array([1]), np.array([2]))[0] == pytest.approx(0.105573, abs=1e-6)
    f = np.array([0.3, 1.0, 4.0])
    assert stats.f_tail(f, np.full(3, 2), np.full(3, 6)) == pytest.approx((1 + 2 * f / 6) ** -3, rel=1e-9)


def test_pruning():
    assert stats.pruned_chi_square([30, 10], [10, 30]) == (pytest.approx(20.0), 1, 2)
    chi, df, n = stats.pruned_chi_square([30, 10, 1], [10, 30, 1])
    assert (chi, df, n) == (pytest.approx(20.0), 1, 2)
    assert stats.pruned_chi_square([1, 1], [1, 1]) == (0.0, 0, 0)
    assert stats.pruned_chi_square([30, 10], [10, 30], [True, False]) == (0.0, 0, 1)


@pytest.mark.parametrize("x,text", [(0.228571428, "0.228571"), (1.0, "1"), (0.0, "0"), (1e-7, "1e-07"), (0.00012345678, "0.000123457"), (123456.7, "123457")])
def test_general_format(spark, x, text):
    assert one(spark, sinks.general(F.col("v")), v=x) == text


def test_motif_hits(spark):
    def hits(text, motifs, **how):
        found = spark.createDataFrame([(text,)], "t string").select(s.motif_hits(F.col("t"), motifs, **how).alias("h")).first().h
        return [(h.start, h.end, h.motif) for h in found]

    assert hits("aCCGGacg", ["CG", "CCGG", "GG"]) == [(3, 4, "CG"), (2, 5, "CCGG"), (7, 8, "CG")]
    assert hits("GAUGACGAA", ["GAY"]) == [(1, 3, "GAY"), (4, 6, "GAY")]
    assert hits("CnnG", ["CG"]) == [] and hits("CnnG", ["CG"], skip_others=True) == [(1, 4, "CG")]
    assert hits(None, ["CG"]) == [] and hits("", ["CG"]) == [] and hits("ACG", []) == []


def test_letters_are_exchanged(spark):
    """As translate does it, and without its map of each character."""
    texts = [("ABCabc é世😀 xyz",), ("",), (None,), ("zzA",)] * 50
    df = spark.createDataFrame(texts, "t string")
    made = df.select("t", s.exchanged(F.col("t"), "ABCazA", "CABzaB").alias("x"), F.translate("t", "ABCazA", "CABzaB").alias("y"))
    assert made.where("not x <=> y").count() == 0 and made.repartition(7).where("x is null").count() == 50
    plan = made.select("x").where("length(x) > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and plan.count("ArrowEvalPython") == 1

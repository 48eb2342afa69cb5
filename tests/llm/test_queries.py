"""Every query over small tables of odd rows, and the stages of the pipeline."""

import importlib

import duckdb
import pytest
from cytofold.llm import queries
from pyspark.sql import functions as F

EXTRA = ["_hash", "_copy", "digest", "score", "key", "runs", "size", "fp", "hash", "n_tokens", "_stay", "ids", "predicted", "copies", "keep_id", "data"]


def write(spark, at, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("y", F.lit("clash")).write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, f"some words of document {i % 7} and more of the same kind here " * (i % 4), ["en", "de", None][i % 3], ["a", "b", None][i % 3], None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, "long " * 40_000, "en", "a", 1), (103, "x" * 100_000, "de", "b", 1), (104, "\n" * 50, "en", "a", 1), (3, rows[3][1], "en", "a", 1), (105, "tie tie", "en", "c", 1), (106, "tie tie", "en", "c", 1), (107, "été 🙂 \x00 ñ", "fr", "é", 1)]
    return write(spark, f"file://{tmp_path_factory.mktemp('odd')}", rows, [(i, 1, int(i % 7 == 0)) for i in range(40)] + [(1, None, None)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, f"file://{tmp_path_factory.mktemp('empty')}", [], [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == 49
    assert sorted({r.doc_id for r in rows}) == sorted([*range(40), *range(100, 108)])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_odd_values(spark, tmp_path, name):
    """Null, empty, very long and equal texts, null sources and clashing columns: the values are those of the SQL."""
    rows = [(i, f"Some words of document {i % 7} and more of the same kind here. " * (i % 4), ["en", "de", None][i % 3], ["a", "b", None][i % 3], None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, "long words! " * 8000, "en", "a", 1), (103, "x" * 30_000, "de", "b", 1), (104, "\n" * 50, "en", "a", 1), (105, "tie tie", "en", "c", 1), (106, "tie tie", "en", "c", 1), (107, "été 🙂 ñ MIT License", "fr", "é", 1)]
    at = write(spark, f"file://{tmp_path}/odd", rows, [])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/odd/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, at)
    assert sorted(got.columns) == columns
    order = lambda rows: sorted(map(plain, rows), key=lambda r: r[columns.index("doc_id")])
    assert order(got.select(*columns).collect()) == order(want.project(", ".join(columns)).fetchall())


def test_null_and_repeated_ids_have_values(spark, tmp_path):
    rows = [(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (3, "a b c", "en", "s", 1), (3, None, None, None, 1)]
    at = write(spark, f"file://{tmp_path}/ids", rows, [(3, 1, 0), (None, 1, 1)])
    q = lambda name: sorted((tuple(r) for r in queries.QUERIES[name](spark, at).collect()), key=str)
    assert sorted(r[1:4] for r in q("op5_exact_dedup")) == [(3, 1, True), (3, 3, False), (3, 3, False), (3, 3, True)]
    assert {r[1] for r in q("op2_toxicity") if r[0] is None} == {True}  # crc32 of an empty text is 0
    assert {r[1] for r in q("op3_language_id") if r[0] is None} == {False}
    assert [r[4] for r in q("op8_mixing") if r[0] is None] == [q("op8_mixing")[-1][4]] * 2
    assert all(r[2] == 3 for r in q("op10_simhash") if r[0] == 3)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_null_ids(spark, tmp_path):
    at = write(spark, f"file://{tmp_path}/null", [(None, "a b c", "en", "s", 1), (None, None, None, None, None), (1, "a b c", "en", "s", 1)], [(1, 1, 0)])
    for name, q in queries.QUERIES.items():
        assert q(spark, at).count() == 3, name


def test_pipeline(spark, odd, empty):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, odd)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert docs.count() <= before.count()
        at = f"{odd}-{name}"
        docs.write.parquet(at)
        docs = spark.read.parquet(at)
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    assert pipeline.run(spark, empty).count() == 0


def test_copies_go_and_others_stay(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    text = lambda: " ".join(rng.choice(words) for _ in range(120))
    rows, near = [], []
    for i in range(60):
        t = text()
        rows.append((i, t, "en", "s", 1))
        if i < 10:
            rows.append((1000 + i, t, "en", "s", 1))
        elif i < 20:
            w = t.split()
            w[5] = "edited"
            rows.append((2000 + i, " ".join(w), "en", "s", 1))
            near.append(2000 + i)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(pipeline.STAGES)
    kept = stages["exact_dedup"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(range(10))
    kept = stages["near_dedup"](spark, kept, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(range(10)) - set(near)

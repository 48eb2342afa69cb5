import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cytofold.llm import common, exact_dedup, fm_dedup, repeats, suffix_dedup
from pyspark.sql import functions as F


def brute_bytes(docs, w):
    """Rows in order; a string is a repeat if a smaller id's row has it (null is the largest) or the row itself earlier."""
    rank = lambda d: (d is None, d or 0)
    least, out = {}, []
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            s = b[i : i + w]
            least[s] = min(least.get(s, rank(d)), rank(d))
    for d, t in docs:
        b, own = (t or "").encode(), set()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            s = b[i : i + w]
            if least[s] < rank(d) or s in own:
                gone[i : i + w] = b"\1" * w
            own.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d or 0, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, w):
    rank = lambda d: (d is None, d or 0)
    first, out = {}, []
    for d, t in docs:
        p = (t or "").encode().split()
        for i in range(len(p) - w + 1):
            s = tuple(p[i : i + w])
            first[s] = min(first.get(s, rank(d)), rank(d))
    for d, t in docs:
        p = (t or "").encode().split()
        gone = [False] * len(p)
        for i in range(len(p) - w + 1):
            if first[tuple(p[i : i + w])] < rank(d):
                gone[i : i + w] = [True] * w
        kept = [x for x, g in zip(p, gone, strict=True) if not g]
        out.append((d or 0, len(p), len(p) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    docs = []
    for i in range(n):
        t = " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(words), rng.choice(passages)]) for _ in range(rng.randint(0, 12)))
        docs.append((i * 7 % 101, t))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (205, "a a a a a a a a a a a a a"), (206, "x" * 3), (207, "\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00")]
    rng.shuffle(docs)
    return docs


def bytes_of(spark, docs, **how):
    found = suffix_dedup.remove(spark.createDataFrame(docs, "doc_id bigint, text string"), **how).collect()
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def words_of(spark, docs, **how):
    found = fm_dedup.remove(spark.createDataFrame(docs, "doc_id bigint, text string"), **how).collect()
    return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in found)


@pytest.mark.parametrize("seed,bucket", [(1, 40_000), (2, 40_000), (3, 20), (4, 5)])
def test_suffix_dedup(spark, seed, bucket):
    """Also in buckets so small that most strings' equals lie beyond a boundary."""
    docs = corpus(seed)
    assert bytes_of(spark, docs, window=12, anchor=5, bucket=bucket) == brute_bytes(docs, 12)


@pytest.mark.parametrize("seed,bucket", [(1, 40_000), (2, 40_000), (3, 20), (4, 5)])
def test_fm_dedup(spark, seed, bucket):
    docs = corpus(seed)
    assert words_of(spark, docs, window=5, anchor=2, bucket=bucket) == brute_words(docs, 5)


@pytest.mark.parametrize("bucket", [40_000, 10])
def test_repeated_and_null_ids(spark, bucket):
    """Rows of one id aren't earlier than each other, so equal ones are judged alike."""
    docs = corpus(6, 30)
    docs = [(None if d % 5 == 0 else d % 9, t) for d, t in docs] + [(1, "abcdefghijklmnop"), (1, "abcdefghijklmnop"), (1, "zzabcdefghijklmnopabcdefghijklmnop"), (None, "abcdefghijklm"), (2, "abcdefghijklmnopqr")]
    docs += [(0, "one two three four five six"), (0, "one two three four five six"), (7, "one two three four five six")]
    assert bytes_of(spark, docs, window=12, anchor=5, bucket=bucket) == brute_bytes(docs, 12)
    assert words_of(spark, docs, window=5, anchor=2, bucket=bucket) == brute_words(docs, 5)


def test_one_passage_in_a_third_of_all_rows(spark):
    """Its contexts lie in many buckets, with other words around it in each document."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 9))), *("the same old words again" if i % 3 == 0 else word()).split(), *(word() for _ in range(6))])) for i in range(300)]
    assert bytes_of(spark, docs, window=14, anchor=5, bucket=15) == brute_bytes(docs, 14)
    assert words_of(spark, docs, window=4, anchor=2, bucket=15) == brute_words(docs, 4)


def test_spans_and_kept_text(spark):
    docs = [(1, "0123456789abcdef"), (2, "XX0123456789abcdefYY")]
    r = {r.doc_id: r for r in suffix_dedup.remove(spark.createDataFrame(docs, "doc_id bigint, text string"), window=12, anchor=5).collect()}
    assert [tuple(s) for s in r[2].spans] == [(2, 18)]
    assert bytes(r[2].kept) == b"XXYY"
    w = {r.doc_id: r for r in fm_dedup.remove(spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d e y")], "doc_id bigint, text string"), window=5, anchor=2).collect()}
    assert [tuple(s) for s in w[2].spans] == [(1, 6)]
    assert w[2].kept == "x y"


ODD = ["", "one", " lead and  two\tgaps\r\n", "", "   ", "next", "to", "each\x0bother\x0c", "\x00 \x00\x00 a\x00", "é日本 🙂\u00a0x \u2003", "w" * 64 + " " + "w" * 65 + " " + "w" * 200, "12345678 123456789 1234567"]


@pytest.mark.parametrize("portion", [1, 30, 1 << 20])
def test_words_of_a_column(monkeypatch, portion):
    """Words are those of bytes.split, text by text, and have equal hashes exactly if they are equal."""
    monkeypatch.setattr(repeats, "PORTION", portion)
    column = pa.array(["not this", *ODD, *reversed(ODD), "nor this"])[1:-1]
    parts = [t.encode().split() for t in ODD + ODD[::-1]]
    of = repeats.Words(3, 2)
    h = [x.tolist() for x in of.reads(column)]
    assert [len(x) for x in h] == [len(p) for p in parts]
    by = {(w, x) for p, y in zip(parts, h, strict=True) for w, x in zip(p, y, strict=True)}
    assert len(by) == len({w for w, _ in by}) == len({x for _, x in by})
    for part in repeats.portions(column):
        some = parts[part]
        rows = [(i, a, b) for i, p in enumerate(some) for a in range(len(p)) for b in range(a + 1, len(p) + 1)]
        r, a, b = np.array(rows, np.int64).reshape(-1, 3).T
        assert of.cutter(column[part])(r, a, b) == [b" ".join(some[i][x:y]) for i, x, y in rows]


def test_words_are_read_in_little_time():
    """Words that were never met cost little more than to part them."""
    rng = random.Random(5)
    column = pa.array([" ".join(str(rng.getrandbits(40)) for _ in range(2000)) for _ in range(200)])

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    words = repeats.Words(13, 5)
    assert least(lambda: list(words.reads(column))) < 4 * least(lambda: [t.as_py().encode().split() for t in column])


def test_spans_and_kept_words(spark):
    docs = [(1, "a  b\tc d e"), (2, "x\n\na b c d e"), (3, "y a b c d e z  a b c d e"), (4, None), (5, "u v"), (6, "  b c d e")]
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], r.kept) for r in fm_dedup.remove(spark.createDataFrame(docs, "doc_id bigint, text string"), window=4, anchor=2).collect()}
    assert got == {1: ([], "a b c d e"), 2: ([(1, 6)], "x"), 3: ([(1, 6), (7, 12)], "y z"), 4: ([], ""), 5: ([], "u v"), 6: ([(0, 4)], "")}


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_multikey_sort(n):
    rng = np.random.default_rng(n)
    for most in (1, 3, 1 << 62):
        m = rng.integers(0, most, (n, 6)).astype(np.uint64)
        order = suffix_dedup.multikey_sort(m)
        assert sorted(order.tolist()) == list(range(n))
        assert [tuple(r) for r in m[order].tolist()] == sorted(tuple(r) for r in m.tolist())


def test_bits():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 1023, 1024, 1025, 5000):
        bits = rng.random(n) < 0.4
        at = np.arange(n + 1)
        assert fm_dedup.Bits(bits).rank(at).tolist() == np.concatenate(([0], np.cumsum(bits))).tolist()
    # 64 bits take 64 and 18 to count in.
    big = fm_dedup.Bits(np.ones(1 << 20, bool))
    assert big.words.nbytes + big.small.nbytes + big.large.nbytes < 1.3 * (1 << 17)


def test_fm_index_intervals():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)  # a passage and what parts it from the next
    holders = rng.integers(0, 1000, 401)
    index = fm_dedup.FMIndex(text, 5, 7, holders)
    words = text.tolist()
    places = lambda s: [j for j in range(len(words)) if words[j : j + len(s)] == s]
    for _ in range(200):
        i, n = int(rng.integers(0, 390)), int(rng.integers(1, 8))
        low, high = np.array([0]), np.array([len(text)])
        for c in reversed(words[i : i + n]):
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == len(places(words[i : i + n]))
        if n == 7:
            assert index.least[index.classes[7].of(low)][0] == min(holders[j] for j in places(words[i : i + 7]))
            a, b = index.classes[6].interval(low)
            assert b[0] - a[0] == len(places(words[i : i + 6]))


@pytest.mark.parametrize("digest", [None, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(5)).cast("string")])
def test_exact_dedup(spark, digest):
    """Also with a digest that collides: the bytes decide."""
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", "b", "A", "", None, "a ", "c" * 1000, f"u{i}"])) for i in range(200)]
    how = {"digest": digest} if digest else {}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(frame, keep=keep, **how).collect()}
        assert got == {d: (pick(g), len(g)) for g in groups.values() for d in g}


def test_slices_of_a_large_group(spark, monkeypatch):
    """A third of all rows have one text: no slice holds many, whether slices are broadcast or not."""
    monkeypatch.setattr(common, "SLICE", 50)
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    hits = spark.createDataFrame([("hot", 1998, 667)], "digest string, keep_id bigint, n bigint")
    for most in (10, 0):
        monkeypatch.setattr(common, "MOST_LARGE", most)
        slices = common.Slices(hits, "digest", "id")
        counts = [r["count"] for r in slices.of_rows(docs.selectExpr("doc_id as id", "text as digest")).where("digest = 'hot'").groupBy("slice").count().collect()]
        assert sum(counts) == 667 and max(counts) <= 2 * 667 / len(counts) and slices.of_groups(hits).count() >= len(counts) > 10
        got = exact_dedup.groups(docs, keep="largest").where("doc_id % 3 = 0").select("keep_id", "group_size").distinct().collect()
        assert [tuple(r) for r in got] == [(1998, 667)]


def test_digest_index_levels(spark, tmp_path):
    """Runs of a full level are merged; the least id stays; lookups find digests of any level."""
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", fan=2)
    rows = [[("b", 5), ("a", 7)], [("b", 2), ("c", 1)], [("c", 0), ("d", 4)]]
    shapes = []
    for r in rows:
        index.flush(spark.createDataFrame(r, "digest string, id bigint"))
        shapes.append([len(level) for level in index.levels])
    assert shapes == [[1], [0, 1], [1, 1]]
    assert sorted(tuple(r) for r in index.levels[1][0].digests.collect()) == [("a", 7, 1), ("b", 2, 2), ("c", 1, 1)]
    assert sorted(tuple(r) for r in index.lookup(spark.createDataFrame([("a",), ("c",), ("z",)], "digest string")).collect()) == [("a", 7, 1), ("c", 0, 2)]
    assert sorted(tuple(r) for r in index.repeated().collect()) == [("b", 2, 2), ("c", 0, 2)]
    index.flush(spark.createDataFrame([("e", 9)], "digest string, id bigint"))
    assert [len(level) for level in index.levels] == [0, 0, 1]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_filters_skip_runs(spark, tmp_path, monkeypatch, broadcast):
    """A filter knows all of its run's digests and few others."""
    monkeypatch.setattr(exact_dedup, "BROADCAST", broadcast)
    digests = lambda a, b: spark.range(a, b).selectExpr("sha2(cast(id as string), 256) as digest", "id")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    index.flush(digests(0, 5000))
    index.flush(digests(5000, 6000))
    first, second = index.runs
    assert first.buckets > 1
    assert first.may_have(digests(0, 5000)).count() == 5000
    assert first.may_have(digests(10_000, 20_000)).count() < 500
    assert second.may_have(digests(5000, 6000)).count() == 1000
    assert second.may_have(digests(0, 5000)).count() < 250
    assert index.lookup(digests(4990, 5010)).count() == 20
    assert index.repeated().count() == 0


def test_keepers(spark):
    docs = spark.createDataFrame([(1, "x", "k"), (2, "x", "k"), (2, "x", "k"), (3, None, "k"), (4, "", "k"), (None, "y", None), (None, "y", None)], "doc_id bigint, text string, digest string")
    assert sorted((r.doc_id or 0, r.digest) for r in exact_dedup.keepers(docs, keep="largest").collect()) == [(0, None), (2, "k"), (4, "k")]

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from cytofold.llm import components, simhash


def brute_components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def brute_print(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(30)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = {x: r for x, r in brute_components(pairs).items() if x != r}
    assert got == want


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def clusters(rng, n):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    all_ = [base]
    for flips in (1, 3, 4, 5):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        all_.append(x)
    return np.unique(np.concatenate(all_))


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_trie_finds_each_link_once(radius):
    keys = clusters(np.random.default_rng(radius), 60)
    found = [(min(a, b), max(a, b)) for i, j in simhash.trie_links(keys, 0, radius) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    distance = np.bitwise_count(keys[:, None] ^ keys[None, :])
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in zip(*np.nonzero(distance <= radius), strict=True) if a < b}


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_any_number_of_blocks_gives_the_same_links(spark, agree):
    keys = clusters(np.random.default_rng(9), 40)
    signed = keys.view(np.int64).tolist()
    rows = spark.createDataFrame([(x,) for x in signed] * 2, "fp bigint")
    got = brute_components([(r.a, r.b) for r in simhash.near_links(rows, radius=4, agree=agree).collect()])
    distance = np.bitwise_count(keys[:, None] ^ keys[None, :])
    want = brute_components([(signed[a], signed[b]) for a, b in zip(*np.nonzero(distance <= 4), strict=True) if a != b])
    groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in m.values()}
    assert groups(got) == groups(want)


def test_documents(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(300)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        docs.append((3 * i, " ".join(w)))
        if i % 2:
            for k in range(3):
                v = list(w)
                if v:
                    v[rng.randrange(len(v))] = "Changed"
                docs.append((3 * i + 200 + k, " ".join(v)))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "oNE  TWO")]
    rng.shuffle(docs)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    prints = {d: brute_print(t, 4) for d, t in docs}
    assert {d: x[0] for d, x in got.items()} == prints
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {d: x[1] for d, x in got.items()} == brute_components(links)


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    docs, groups = [], defaultdict(list)
    for i in range(20):
        w = rng.sample(words, 80)
        for k in range(4):
            v = list(w)
            if k:
                v[rng.randrange(80)] = f"x{k}"
            docs.append((100 * i + k, " ".join(v), None, "s", None))
            groups[i].append(100 * i + k)
    docs += [(None, "no id", None, None, 1), (7777, None, "en", None, 1)]
    stay = {r.doc_id for r in simhash.representatives(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert stay == {g[0] for g in groups.values()} | {None, 7777}


def test_links_of_two_tables(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs = []
    for i in range(25):
        w = [rng.choice(words) for _ in range(60)]
        for k in range(4):
            v = list(w)
            for _ in range(3 * k):
                v[rng.randrange(60)] = rng.choice(words)
            docs.append((10 * i + k, " ".join(v)))
    docs += [(1000, None), (1001, "!!"), (1002, "One"), (1003, "one.")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), radius=6, tables=2).collect()}
    prints = {d: simhash.word_simhash(t, 2) for d, t in docs}
    links = [(a, b) for a in prints for b in prints if any((x ^ y).bit_count() <= 6 for x, y in zip(prints[a], prints[b], strict=True))]
    assert got == brute_components(links)
    first = {a: b for a, b in brute_components([(a, b) for a in prints for b in prints if (prints[a][0] ^ prints[b][0]).bit_count() <= 6]).items()}
    assert first != got  # the second table does find more


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("tile", [1000, 7])
def test_only_texts_that_reach_the_threshold_go(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    docs = {}
    for i in range(6):
        w = rng.sample(words, 80)
        docs[100 * i] = " ".join(w)
        for k in range(1, 9):  # copies with one to eight words changed in different places
            v = list(w)
            for j in range(k):
                v[9 * j + 6] = f"{v[9 * j + 6]}x{k}"
            docs[100 * i + k] = " ".join(v)
        for k in range(6):  # the same words and mostly the same pairs, in another order
            m = 8 + 9 * k
            docs[100 * i + 20 + k] = " ".join(x for a in range(0, 80, 4) for x in (w[m:] + w[:m])[(a + 4) % 80 : (a + 4) % 80 + 4][:: 1 if a % 8 else -1])
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), radius=6, tables=2).collect()}
    links = [(a, b) for a in docs for b in docs if near[a] == near[b] and jaccard(docs[a], docs[b]) >= 0.8]
    want = {a for a, b in brute_components(links).items() if a == b}
    got = [r.doc_id for r in simhash.representatives(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(want)
    assert len(set(near.values())) < len(want) < len(docs)  # some candidates are left alone, some go


@pytest.mark.parametrize("seed", range(3))
def test_alike(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.choice(30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(40)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 5]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i == j or len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) > 0]
    assert simhash.alike(sets, 0.8).tolist() == [brute_components(links)[i] for i in range(len(sets))]

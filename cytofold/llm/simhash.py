"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words between white space, A-Z lower-cased; shingles of some words, repeats included; a bit is 1 where
over half of the shingles' XXH64 (seed 42) have it. Equal fingerprints are one node with the smallest doc_id.

With tables > 0 a text's features are its distinct words, runs of letters and digits in lower case, and its distinct
pairs of neighbours: an edit of a few words then moves few bits however short the text is. Of these each text gets as
many fingerprints as there are tables, by hashes that are independent; texts are linked if one of them says so.

Links: of r + k blocks of bits, two fingerprints that differ in at most r bits agree on k at least. So each
fingerprint goes to one bucket for each choice of k blocks and the blocks' values, and all links are found inside
buckets. k grows with the logarithm of the number of fingerprints, so that buckets stay small; any k finds the
same links. In a bucket the fingerprints, their bits in an order in which the chosen blocks lead, are a binary trie:
pairs of its nodes are descended together, the bits in which they differ are added up, and a pair is left as soon as
the sum exceeds r. Only a spanning forest of a bucket's links leaves the task, so copies and tight groups don't
multiply; no link between components is lost.

representatives() takes these links as a search for candidates only: texts that links join are compared by the exact
Jaccard similarity of their sets of five-word shingles, and only pairs that reach the threshold are linked in the end.

Null texts have no words: fingerprint 0. Rows with one doc_id are kept each. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Slices, arrow, cut, shuffle_parts
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Node pairs that one step of the descent holds (the rest wait); fingerprints that a bucket should have on average.
AT_ONCE, BUCKET = 1 << 18, 128
#: Different texts of a group of candidates that are compared in one place; larger groups are cut into tiles of this size, each compared with each.
TILE = 1000


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint as an unsigned number."""
    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return _majority([hashes])
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    ends, of = ends[words - 1 :].tolist(), xxhash.xxh64_intdigest
    step = 1 << 14
    return _majority(np.array([of(joined[a:b], 42) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)], np.uint64) for i in range(0, len(starts), step))


_LETTERS = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """XXH64 (seed 42) of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
        if len(self) >= 150_000:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


def _stirred(z: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (splitmix64's last step)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_simhash(text: str | None, tables: int = 1, known: _Hashes | None = None) -> list[int]:
    """The fingerprints of a text's distinct words and neighbouring pairs."""
    parts = _LETTERS.findall((text or "").lower())
    if not parts:
        return [0] * tables
    known = _Hashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    features = np.unique(np.concatenate((h, _stirred(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]))))
    step = 1 << 14
    blocks_ = [features[i : i + step] for i in range(0, len(features), step)]
    return [_majority(_stirred(x + np.uint64(t * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if t else x for x in blocks_) for t in range(tables)]


def _majority(blocks) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, tables: int = 0) -> DataFrame:
    """docs without text, plus the fingerprints fp0, fp1, … as signed longs: one of shingles, or one for each table."""
    new = [f"fp{t}" for t in range(max(1, tables))]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} bigint" for n in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            made = [word_simhash(t.as_py(), tables, known) if tables else [simhash(t.as_py(), words)] for t in batch.column(text)]
            prints = np.array(made, np.uint64).reshape(-1, len(new)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(prints[:, i]) for i in range(len(new)))], names=[*kept, *new])

    return arrow(docs.select(*(docs[c] for c in [*kept, text])), run, schema)


def blocks(count: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, bits) of count blocks that cover all bits."""
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def agreeing(fingerprints: int, radius: int) -> int:
    """How many blocks to choose, so that a bucket has some hundred fingerprints on average; 64 bits bound it."""
    k = 1
    while k < 6 and fingerprints / 2 ** (64 * k // (radius + k)) > BUCKET:
        k += 1
    return k


def _led(keys: np.ndarray, chosen: tuple[int, ...], cuts: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """keys with the chosen blocks as the highest bits, and how many bits these are."""
    made = np.zeros(len(keys), np.uint64)
    for low, n in [cuts[i] for i in chosen] + [c for i, c in enumerate(cuts) if i not in chosen]:
        made = (made << np.uint64(n)) | ((keys >> np.uint64(low)) & np.uint64((1 << n) - 1))
    return made, sum(cuts[i][1] for i in chosen)


def trie_links(keys: np.ndarray, lead: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of keys, sorted and distinct, that agree on the lead highest bits and differ in at most radius others.

    Nodes are ranges of keys. A step splits each pair of nodes at their next bit: like children go on with the same
    sum, unlike ones with one more. Pairs of single keys are settled at once by counting their differing bits.
    """
    if len(keys) < 2:
        return
    top = keys >> np.uint64(64 - lead) if lead else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    ends = np.append(starts[1:], len(keys))
    some = ends - starts > 1
    depth_of = lambda n, d: np.full(n, d, np.int64)
    first = np.stack([starts[some], ends[some], starts[some], ends[some], np.zeros(some.sum(), np.int64), depth_of(some.sum(), lead)])
    waiting = [first[:, i : i + AT_ONCE // 8] for i in range(0, first.shape[1], AT_ONCE // 8)]
    sums: dict[int, np.ndarray] = {}

    def ones(bit: int) -> np.ndarray:
        if bit not in sums:
            sums[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        return sums[bit]

    while waiting:
        pairs = waiting.pop()
        depth = int(pairs[5, 0])
        if pairs.shape[1] > AT_ONCE:
            waiting += [pairs[:, i : i + AT_ONCE] for i in range(0, pairs.shape[1], AT_ONCE)]
            continue
        lo1, hi1, lo2, hi2, err, _ = pairs
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            i, j = lo1[single], lo2[single]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= radius)
            if near.any():
                yield i[near], j[near]
            lo1, hi1, lo2, hi2, err = (x[~single] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1) or depth >= 64:
            continue
        c = ones(depth)
        mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        same = lo1 == lo2  # a node with itself: its children's pair is taken once
        made = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1)]
        other = ~same
        made.append((mid1[other], hi1[other], lo2[other], mid2[other], err[other] + 1))
        a1, b1, a2, b2, e = (np.concatenate(x) for x in zip(*made, strict=True))
        keep = (b1 > a1) & (b2 > a2) & (e <= radius) & ~((a1 == a2) & (b1 - a1 == 1))
        if keep.any():
            n = int(keep.sum())
            waiting.append(np.stack([a1[keep], b1[keep], a2[keep], b2[keep], e[keep], depth_of(n, depth + 1)]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def near_links(nodes: DataFrame, fp: str = "fp", radius: int = 4, agree: int = 1) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that differ in at most radius bits, a forest for each bucket."""
    cuts = blocks(radius + agree)
    choices = list(combinations(range(radius + agree), agree))

    def value(chosen: tuple[int, ...]) -> str:
        made = "0L"
        for i in chosen:
            low, n = cuts[i]
            made = f"(shiftleft({made}, {n}) | (shiftrightunsigned(fp, {low}) & {(1 << n) - 1}L))"
        return made

    led = F.array(*(F.struct(F.lit(k).alias("choice"), F.expr(value(chosen)).alias("value")) for k, chosen in enumerate(choices)))
    spread = nodes.select(F.col(fp).alias("fp")).where("fp is not null").distinct().select("fp", F.explode(led).alias("at")).select("fp", "at.choice", "at.value")
    spread = spread.repartition(shuffle_parts(nodes.sparkSession), "choice", "value").sortWithinPartitions("choice", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: int | None = None

        def solve() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held)
            keys, lead = _led(fps, choices[at], cuts)
            order = np.argsort(keys)
            fps = fps[order].view(np.int64)
            root = forest(len(keys), trie_links(keys[order], lead, radius))
            i = np.flatnonzero(root != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[root[i]]), pa.array(fps[i])], names=["a", "b"])

        # Whole buckets are gathered up to a size and then joined together; a bucket is never parted.
        last = None
        for batch in batches:
            fps, choice, values = (np.asarray(batch.column(c)) for c in ("fp", "choice", "value"))
            change = np.flatnonzero((choice[1:] != choice[:-1]) | (values[1:] != values[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(fps)], strict=True):
                if a == b:
                    continue
                key = (int(choice[a]), int(values[a]))
                if held and (key[0] != at or key != last and sum(map(len, held)) >= AT_ONCE):
                    yield from solve()
                    held = []
                at, last = key[0], key
                held.append(fps[a:b].view(np.uint64))
        if held:
            yield from solve()

    return arrow(spread, run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, radius: int = 4, tables: int = 0) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most radius differing bits."""
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, tables=tables), "simhash")
    nodes = cut(rows.groupBy("fp0").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    agree = agreeing(nodes.count(), radius)
    edges = near_links(nodes, "fp0", radius, agree)
    for t in range(1, tables):
        # Further tables' links as links between the first table's fingerprints: one of each stands for its texts.
        stands = rows.groupBy(f"fp{t}").agg(F.min("fp0").alias("stand"))
        found = near_links(stands, f"fp{t}", radius, agree)
        ends = [stands.select(F.col(f"fp{t}").alias(c), F.col("stand").alias(f"{c}_stand")) for c in ("a", "b")]
        edges = edges.union(found.join(ends[0], "a").join(ends[1], "b").select("a_stand", "b_stand"))
        edges = edges.union(rows.select("fp0", f"fp{t}").distinct().join(stands, f"fp{t}").select("fp0", "stand"))
    roots = components(edges)
    rooted = cut(nodes.join(roots, nodes.fp0 == roots.node, "left").select("fp0", "n", "least", F.coalesce("root", "fp0").alias("root")), "simhash-roots")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-components")
    slices = Slices(named, "root", "fp0")
    named = slices.of_rows(rooted.drop("n")).join(slices.of_groups(named).drop("n"), ["root", "slice"]).select("fp0", "component_id")
    slices = Slices(nodes, "fp0", "doc_id")
    named = slices.of_groups(nodes.select("fp0", "n").join(named, "fp0")).drop("n")
    return slices.of_rows(rows.select("doc_id", "fp0")).join(named, ["fp0", "slice"]).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles, as simhash() takes them, as sorted XXH64 (seed 42); a text of up to words words is one shingle."""
    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    of, grams = xxhash.xxh64_intdigest, (b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1)))
    return np.unique(np.fromiter((of(g, 42) for g in grams), np.uint64))


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the smallest number of its component; sets are linked if their Jaccard similarity reaches the threshold."""
    n = len(sets)
    root, sizes = np.arange(n), np.fromiter(map(len, sets), np.int64, n)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    # Where each shingle is: the owners of shingle x are owners[first[x] : first[x] + held[x]].
    owners, held = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")], np.bincount(ids)
    first, at = np.cumsum(held) - held, np.concatenate(([0], np.cumsum(sizes)))
    for i in range(n):
        if (root[i:] == root[i]).all():
            continue
        mine = ids[at[i] : at[i + 1]]
        count = held[mine]
        places = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owners[places], minlength=n)
        near = root[both >= threshold * np.maximum(sizes + sizes[i] - both, 1) - 1e-9]
        if len(near):
            root[np.isin(root, near)] = near.min()
    return root


def alike_links(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b): digests of units (group, digest, shingles), links that join all of a group that reach the threshold."""
    tiles = units.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n")
    mine = units.join(tiles, "group").withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int"))
    both = mine.select("group", "digest", "shingles", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).where("tiles = 1 or tile <> other")
    both = both.select("group", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "digest", "shingles")
    both = both.repartition(shuffle_parts(units.sparkSession), "group", "p", "q").sortWithinPartitions("group", "p", "q", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digests, sets = None, [], []

        def solve() -> pa.RecordBatch:
            root = alike(sets, threshold)
            i = np.flatnonzero(root != np.arange(len(sets)))
            return pa.RecordBatch.from_arrays([pa.array([digests[j] for j in root[i]], pa.binary()), pa.array([digests[j] for j in i], pa.binary())], names=["a", "b"])

        for batch in batches:
            for *key, digest, held in zip(*(batch.column(c).to_pylist() for c in ("group", "p", "q", "digest", "shingles")), strict=True):
                if key != last and sets:
                    yield solve()
                    digests, sets = [], []
                last = key
                digests.append(digest)
                sets.append(np.frombuffer(held, np.uint64))
        if sets:
            yield solve()

    return arrow(both, run, "a binary, b binary").distinct()


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 6, tables: int = 2, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that are near-duplicates of a row with a smaller doc_id.

    Near-duplicates are joined by links of texts whose shingles of some words have a Jaccard similarity of at least
    threshold; such pairs are looked for among texts that near_duplicates() joins by their words and pairs. Of rows that
    repeat a doc_id all are kept or none; rows whose doc_id is null are kept.
    """
    known = docs.where(F.col(doc_id).isNotNull())
    found = cut(near_duplicates(known, text, doc_id, radius=radius, tables=tables).select("doc_id", F.col("component_id").alias("group")), "near-groups")
    shared = cut(found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    slices = Slices(shared, "group", "doc_id")
    grouped = slices.of_rows(found).join(slices.of_groups(shared), ["group", "slice"], "left")
    alone = grouped.where("n is null").select("doc_id")
    members = grouped.where("n is not null").select(F.col("doc_id").alias("_id"), "group").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py(), words).tobytes() for t in batch.column("text")]
            digests = [xxhash.xxh3_128_digest(x) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(made, pa.binary())], names=["group", "doc_id", "digest", "shingles"])

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = known.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(members, F.col("doc_id") == F.col("_id")).select("group", "doc_id", "text")
    texts = cut(arrow(texts, run, f"group {kind}, doc_id {kind}, digest binary, shingles binary"), "near-shingles")
    links = alike_links(texts.groupBy("group", "digest").agg(F.any_value("shingles").alias("shingles")), threshold)
    roots = components(links)
    named = texts.groupBy("digest").agg(F.min("doc_id").alias("least")).join(roots, F.col("digest") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("digest", "first")
    stay = alone.union(texts.select("doc_id", "digest").join(named, "digest").where("doc_id = first").select("doc_id")).select(F.col("doc_id").alias("_stay")).distinct()
    return known.join(stay, known[doc_id] == stay["_stay"], "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))

"""Substring dedup by compressed FM-indexes: words covered by a passage that an earlier document has, too.

Passages whose anchors recur (see repeats.py) are dealt to shards by ranges of their anchors' hashes. A shard's distinct
passages become an FM-index: their Burrows-Wheeler transform, suffixes sorted as deep as a window needs by doubling, in a
wavelet matrix, one bit vector for each bit of the word numbers. A bit vector takes 18 bits for 64 of its own to count
in; the suffix array itself isn't kept. The documents' passages are streamed against the index from their ends: each
step is one backward-search step, which takes two rank queries a level, so the interval of suffixes that start with the
last words read is always at hand, and with it the matching statistic, up to the window. At a full window the
least document of its interval tells whether the window is a repeat; then its last word is let go, that is, the
interval grows to that of the shorter string. Intervals reported are runs of such windows.

An anchor's passages lie in one shard, or in neighbouring ones if they are very many. Windows of a shard's first
and last anchor that aren't repeats in it are dealt to shards of their own, by the window, and streamed against those.

Words of a shard are numbered exactly, by their bytes; hashes only choose what is looked at.

Null text has no words. Rows that repeat an id are documents of which none is earlier. Null ids come last. Texts shorter
than the window keep all words; very long ones give more rows, no wider ones. Other columns, whatever their names, play
no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import arrow, cut

WINDOW, ANCHOR = 13, 5


class Bits:
    """A bit vector that counts its ones before any place: 64-bit words, a 16-bit count a word within 16 words, a 32-bit count for each 16."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.pad(packed, (0, 128 - len(packed) % 128)).view(np.uint64)  # a place behind the last bit is a place, too
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, 16)
        self.large = np.concatenate(([0], np.cumsum(ones.sum(axis=1))))[:-1].astype(np.uint32)
        self.small = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return self.large[word >> 4].astype(np.int64) + self.small[word] + inside


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        x = sequence
        for level in reversed(range(self.levels)):
            bit = ((x >> level) & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate((x[~bit], x[bit]))
        self.start = self._down(np.zeros(symbols, np.int64), np.arange(symbols))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where places (one row or more of them, a symbol for each column) lead to on the last level."""
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[k].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before at."""
        return self._down(at, symbol) - self.start[symbol]


class Classes:
    """Intervals of the suffixes that agree in their first words: where they begin, as bits and as places."""

    def __init__(self, begins: np.ndarray):
        self.bits, self.edges = Bits(begins), np.append(np.flatnonzero(begins), len(begins)).astype(np.int32)

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.bits.rank(at + 1) - 1

    def interval(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.of(at)
        return self.edges[c].astype(np.int64), self.edges[c + 1].astype(np.int64)


class FMIndex:
    """Of a sequence of word numbers (0 parts passages): intervals of the suffixes that start with a string, up to depth words.

    least: of each class of suffixes that agree in depth words the smallest of its places' holders.
    """

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int, holders: np.ndarray):
        n = len(sequence)
        name, names, h = sequence.astype(np.int64), {1: sequence.astype(np.int64)}, 1
        shifted = lambda x, d: np.concatenate((x[d:] + 1, np.zeros(min(d, n), np.int64)))
        while True:
            key = name * (n + symbols + 2) + shifted(name, h)
            order = np.argsort(key)
            ranked = key[order]
            fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            name = np.empty(n, np.int64)
            name[order] = fresh
            h *= 2
            names[h] = name
            if h >= depth:
                break
        # order: suffixes by their first h words; that of equal ones is of no account, since no interval parts them.
        self.size = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=symbols))))
        self.wavelet = WaveletMatrix(sequence[order - 1], symbols)
        self.classes = {}
        for d in (depth, depth - 1):
            half = 1 << (max(1, d) - 1).bit_length() - 1
            a, b = names[half], shifted(names[half], d - half)
            self.classes[d] = Classes(np.concatenate(([True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))))
        self.least = np.minimum.reduceat(holders[order], self.classes[depth].edges[:-1])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol followed by the strings of intervals: a backward-search step."""
        low, high = self.first[symbol] + self.wavelet.rank(symbol, np.stack((low, high)))
        return low, high


def resolve(shard: repeats.Bucket, window: int = WINDOW) -> repeats.Resolved:
    """The runs of windows that an earlier document in the shard has, too, and the windows that one beyond it may have."""
    passages: dict[bytes, int] = {}
    of = np.array([passages.setdefault(d, len(passages)) for d in shard.rest.to_pylist()], np.int64)  # rows come by document: the first has the least
    _, at = np.unique(of, return_index=True)
    least = shard.doc[at]
    words = b" \n ".join(passages).split(b" ") + [b"\n"]  # no word is a line end
    numbers = {w: i for i, w in enumerate(dict.fromkeys([b"\n", *words]))}
    flat = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    begin = np.concatenate(([0], np.flatnonzero(flat == 0) + 1))
    sizes, begin = np.diff(begin) - 1, begin[:-1]
    index = FMIndex(flat, len(numbers), window, np.repeat(least, sizes + 1))
    full, shorter = index.classes[window], index.classes[window - 1]
    repeat = np.zeros((len(sizes), int(sizes.max()) - window + 1), bool)
    by_size = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.size, np.int64)
    for step in range(int(sizes.max())):
        live = by_size[: np.searchsorted(-sizes[by_size], -step, "left")]  # those longer than step
        place = sizes[live] - 1 - step
        low[live], high[live] = index.extend(flat[begin[live] + place], low[live], high[live])
        if step >= window - 1:  # full windows: judged, then shortened by their last word
            repeat[live, place] = index.least[full.of(low[live])] < least[live]
            low[live], high[live] = shorter.interval(low[live])
    # Rows whose passage a smaller document has are repeats as a whole; the others are judged by their passage.
    whole = shard.doc > least[of]
    rows = np.flatnonzero(~whole)
    some = rows[repeat[of[rows]].any(axis=1)]
    row, a, b = repeats.runs_of(repeat[of[some]], some)
    every = np.flatnonzero(whole)
    runs = np.concatenate((row, every)), np.concatenate((shard.first[row] + a, shard.first[every])), np.concatenate((shard.first[row] + b, shard.first[every] + shard.more[every]))
    edge = rows[(shard.lead[rows] == shard.lead.min()) | (shard.lead[rows] == shard.lead.max())]
    open_, at, windows = [], [], []
    for i in edge.tolist():
        parts = words[begin[of[i]] : begin[of[i]] + sizes[of[i]]]
        for j in np.flatnonzero(~repeat[of[i], : len(parts) - window + 1]).tolist():
            open_.append(i)
            at.append(shard.first[i] + j)
            windows.append(b" ".join(parts[j : j + window]))
    return runs, (np.array(open_, np.int64), np.array(at, np.int64), windows)


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, bucket: int = repeats.BUCKET) -> DataFrame:
    """(doc_id, text, runs): runs of places (first, last) where passages of window words start that an earlier document has."""
    base = repeats.keyed(docs, text, doc_id)
    of = repeats.Words(window, anchor)
    found = cut(repeats.contexts(base, of, within=False), "passages")
    return repeats.with_runs(base, repeats.judged(found, of, partial(resolve, window=window), within=False, bucket=bucket))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept): spans as array of (start, end) in words; kept joined by one space."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept string"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.portions(batch.column(1)):
                ids, texts, runs = (batch.column(i)[part] for i in range(3))
                words = repeats.Worded(texts)
                whole, at = words.joined()
                gone = repeats.covered_all(words.first, runs, window)
                first, last = repeats.stretches(gone, words.first)
                spans = np.searchsorted(first, words.first)
                row = np.repeat(np.arange(len(texts)), np.diff(spans))
                pairs = pa.StructArray.from_arrays([pa.array(x - words.first[row]) for x in (first, last)], ["start", "end"])
                a, b = repeats.stretches(~gone, words.first)
                pieces = [whole[i:j] for i, j in zip(at[a].tolist(), (at[b] - 1).tolist(), strict=True)]
                kept = [b" ".join(pieces[i:j]) for i, j in pairwise(np.searchsorted(a, words.first).tolist())]
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                columns = [pa.array(np.diff(words.first)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                columns += [pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs).cast(span), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return arrow(repeated(docs, text, doc_id, window, **how), run, schema)

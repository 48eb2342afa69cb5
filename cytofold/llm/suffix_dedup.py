"""Suffix-array dedup: bytes covered by a string of some length that starts earlier, too.

A sparse suffix array holds the suffixes that start at anchors which recur (see repeats.py); all other windows are
unique. Suffixes are range-partitioned by their leading bytes, as many as a window needs, at sampled splitters (Spark's
range partitioner samples them). A bucket sorts its suffixes by multikey quicksort, eight bytes a step, and the
reversed bytes before the anchors likewise. Of two neighbours in each order the common length is known; a window
that starts o bytes before its anchor equals another exactly if the suffixes share its last bytes and the reversed
prefixes its first o. Runs of neighbours that share enough are the classes; all but a class's first window, by document
and place, are repeats.

Across boundaries: a suffix beyond a bucket's boundary shares with one in the bucket no more bytes than the bucket's
first, or last, suffix does. So only windows that need no more bytes than their suffix shares with one of these two may
have equals elsewhere. Those go into a second array, of windows, where equals are neighbours; what its boundaries
part is compared directly.

Null text is empty text. Matches never cross documents; rows that repeat an id are documents of their own, of which none is
earlier. Null ids come last. Texts shorter than the window keep all bytes; very long ones give more rows, no wider ones.
Other columns, whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import arrow, cut

WINDOW, ANCHOR = 100, 32


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of unsigned numbers, most significant first, by multikey quicksort.

    All open ranges take a step together. A range's rows are parted in three by a pivot, the median of three, in the
    column at the range's depth: the smaller and the larger ones stay at this depth, the equal ones go on to the next.
    """
    n, columns = words.shape
    order = np.arange(n)
    low, high, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (high - low > 1) & (depth < columns)
        low, high, depth = low[live], high[live], depth[live]
        if not len(low):
            return order
        size = high - low
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) - begin[of] + low[of]
        rows = order[at]
        value = words[rows, depth[of]]
        a, b, c = value[begin], value[begin + size // 2], value[begin + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        start, edges = low, [low]
        for part in (value < pivot, value == pivot, value > pivot):
            upto = np.cumsum(part)
            before = upto[begin] - part[begin]
            chosen = np.flatnonzero(part)
            order[start[of[chosen]] + upto[chosen] - 1 - before[of[chosen]]] = rows[chosen]
            start = start + upto[begin + size - 1] - before
            edges.append(start)
        low, high = np.concatenate(edges[:3]), np.concatenate(edges[1:])
        depth = np.concatenate((depth, depth + 1, depth))


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many bytes each shares with the one before it."""
    pad = -rows.shape[1] % 8
    full = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad))))
    order = multikey_sort(full.view(">u8").astype(np.uint64))
    there = rows[order]
    return order, np.concatenate(([0], _shared(there[1:], there[:-1])))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def resolve(bucket: repeats.Bucket, window: int = WINDOW, anchor: int = ANCHOR) -> repeats.Resolved:
    """The runs of windows that an earlier place in the bucket has, too, and the windows that a place beyond it may have."""
    n = len(bucket)
    low, high = bucket.offset - bucket.more, bucket.offset  # offsets o of the windows' starts before the anchor
    width = int(high.max()) + 1
    after, ahead = repeats.Strings(bucket.lead), repeats.Strings(bucket.rest)
    right, left = after.matrix(window), ahead.matrix(max(1, width - 1), backwards=True)
    (ro, rc), (lo, lc) = _sorted(right), _sorted(left)

    def classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
        made = np.empty(n, np.int64)
        made[order] = np.cumsum(common < least)
        return made

    # Contexts equal to an earlier one as a whole: all their windows are repeats, and they add nothing to what follows.
    same = (classes(ro, rc, window) * (n + 1) + classes(lo, lc, width - 1)) * 65536 + high * 256 + bucket.more
    whole = bucket.later(np.arange(n), same, within=True)
    repeat = np.zeros((n, width), bool)  # by row and offset
    offset = np.arange(width)[None, :]
    there = ~whole[:, None] & (low[:, None] <= offset) & (offset <= high[:, None])
    for o in range(width):
        rows = np.flatnonzero(there[:, o])
        if len(rows) < 2:
            continue
        r = classes(ro, rc, window - o)
        rows = rows[np.bincount(r[rows])[r[rows]] > 1]
        if len(rows) > 1:
            repeat[rows, o] = bucket.later(rows, r[rows] * (n + 1) + classes(lo, lc, o)[rows], within=True)
    row, a, b = repeats.runs_of(repeat[:, ::-1], np.arange(n))  # by growing start
    start = bucket.first[row] + bucket.offset[row] - (width - 1)
    every = np.flatnonzero(whole)
    runs = np.concatenate((row, every)), np.concatenate((start + a, bucket.first[every])), np.concatenate((start + b, bucket.first[every] + bucket.more[every]))
    edge = np.maximum(_shared(right, right[ro[:1]]), _shared(right, right[ro[-1:]]))
    i, o = np.nonzero(there & ~repeat & (window - offset <= edge[:, None]))
    cut_ = [ahead.flat[ahead.start[k] + ahead.size[k] - d : ahead.start[k] + ahead.size[k]].tobytes() + after.flat[after.start[k] : after.start[k] + window - d].tobytes() for k, d in zip(i.tolist(), o.tolist(), strict=True)]
    return runs, (i, bucket.first[i] + bucket.offset[i] - o, cut_)


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, bucket: int = repeats.BUCKET) -> DataFrame:
    """(doc_id, text, runs): runs of places (first, last) where repeated strings of window bytes start."""
    base = repeats.keyed(docs, text, doc_id)
    of = repeats.Bytes(window, anchor)
    found = cut(repeats.contexts(base, of, within=True), "suffixes")
    return repeats.with_runs(base, repeats.judged(found, of, partial(resolve, window=window, anchor=anchor), within=True, bucket=bucket))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): spans as array of (start, end) in bytes; kept as binary."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for t, r in zip(part.column(1), part.column(2), strict=True):
                    data, spans = t.as_py().encode("utf-8", "replace"), []
                    kept = data
                    if (found := r.as_py()) is not None:
                        gone = repeats.covered(len(data), found, window)
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return arrow(repeated(docs, text, doc_id, window, **how), run, schema)

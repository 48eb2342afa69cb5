"""Passages that occur more than once: what suffix-array and substring dedup share.

Every window (W consecutive symbols) picks the symbol run of length k in it whose hash is smallest, its anchor. Equal
windows pick equal anchors at the same offset, so a window can recur only if its anchor does. Steps:

1. anchors: each document gives one row (hash, document, place) for each anchor, with the windows that picked it;
2. rows whose hash occurs once are dropped: their windows are unique. Hashes that a task meets more than once in
   some hundred documents are known to recur: one row is dealt by its hash, the others anywhere, so a hash that a third
   of all documents have is no task's alone;
3. the rest go back to their texts, by document, and leave as contexts: the symbols of the anchor's windows. Contexts
   with equal symbols that one task meets are combined before they move: of those the first stands for all, the others'
   windows are repeats of its windows;
4. contexts are range-partitioned by sampled splitters of (lead, document, place) into buckets of about BUCKET, where an
   operator's resolver says which windows are repeats of others in the bucket. A lead that very many contexts have is
   cut over several buckets like any other stretch of the order;
5. windows that may have equals beyond a bucket's first or last lead, and aren't repeats there, are compared across the
   boundaries: they are contexts of their own, whose lead is the whole window, and go through the same resolver once
   more. What is then still open lies at the boundaries of these buckets, a few windows for each, and is compared as such;
6. a document's repeated windows come back to its text.

No bucket has to hold all of a lead, so there is no limit to how often one occurs. Rows move three times: places twice,
texts once in step 3 and once in step 6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow, cut, shuffle_parts

_LOW = np.uint64((1 << 20) - 1)
#: Windows that are looked at together; symbols of documents that are joined for it; contexts that leave at once.
STEP, JOINED, BATCH = 1 << 19, 1 << 20, 20_000
#: Bytes of text whose words are looked at together; words of more bytes than LONG are hashed one by one.
PORTION, LONG = 1 << 20, 64
#: Contexts of a bucket, on average.
BUCKET = 40_000
#: Contexts that a task remembers; a full memory is emptied, which only lets more rows through.
SEEN = 200_000
#: Places that are sampled for each bucket to find the splitters; they come to the driver.
SAMPLES = 25
_SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: What stands for a null id: it comes after all others.
LAST = (1 << 63) - 1
#: Marks a place whose anchor is known to recur.
_SURE = 1 << 62


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Strings:
    """A column of texts or of bytes as one array of bytes and places in it."""

    def __init__(self, column: pa.Array):
        wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
        self.flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.start, self.size = ends[:-1], np.diff(ends)

    def rows(self, order: np.ndarray) -> Strings:
        made = object.__new__(Strings)
        made.flat, made.start, made.size = self.flat, self.start[order], self.size[order]
        return made

    def matrix(self, width: int, backwards: bool = False) -> np.ndarray:
        """Rows of width bytes from each string's start, or from its end backwards, zeros behind it."""
        step, out = np.arange(width)[None, :], np.zeros((len(self.start), width), np.uint8)
        for i in range(0, len(out) * bool(len(self.flat)), 4096):
            part = slice(i, i + 4096)
            start, size = self.start[part, None], self.size[part, None]
            inside = step < size
            out[part] = np.where(inside, self.flat[np.where(inside, start + size - 1 - step if backwards else start + step, 0)], 0)
        return out


def portions(column: pa.Array) -> Iterator[slice]:
    """Parts of a column of about PORTION bytes, no text cut."""
    texts = Strings(column)
    ends, i = texts.start + texts.size, 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, texts.start[i] + PORTION, "right")))
        yield slice(i, j)
        i = j


class Bytes:
    """Symbols are bytes of UTF-8."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor

    def reads(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The symbols of each text."""
        return (np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8) for text in column)

    def cutter(self, column: pa.Array) -> Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]:
        """What gives the symbols of some rows' texts from one place to another."""
        texts = Strings(column)
        low = texts.start[0]
        whole, base = texts.flat[low : texts.start[-1] + texts.size[-1]].tobytes(), texts.start - low
        return lambda row, a, b: [whole[i:j] for i, j in zip((base[row] + a).tolist(), (base[row] + b).tolist(), strict=True)]

    def parted(self, whole: list[bytes], anchor: np.ndarray, runs: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Contexts as their leads, the symbols from the anchor on, and those before it; runs: the anchors."""
        return [w[i:] for w, i in zip(whole, anchor.tolist(), strict=True)], [w[:i] for w, i in zip(whole, anchor.tolist(), strict=True)]

    lead_type, lead_sql = pa.binary(), "binary"

    def hashes(self, symbols: np.ndarray) -> np.ndarray:
        """Of the anchor-length run at each place."""
        k = self.anchor
        x = symbols.astype(np.uint64)
        have, made, h, at = 1, x, None, 0
        parts = {1: x}
        while have * 2 <= k:
            made = made[: len(made) - have] | (made[have:] << np.uint64(8 * have)) if have < 8 else _mix(made[: len(made) - have] * np.uint64(0x9E3779B97F4A7C15) ^ made[have:])
            have *= 2
            parts[have] = made
        n = max(0, len(symbols) - k + 1)
        for size in sorted(parts, reverse=True):
            if k - at >= size:
                part = parts[size][at : at + n]
                h = part if h is None else _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ part)
                at += size
        return _mix(h[:n] * np.uint64(0x9E3779B97F4A7C15))


def stretches(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and where they end; none goes on across a bound."""
    bounds = bounds[(0 < bounds) & (bounds < len(mask))]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    begins[bounds] = mask[bounds]
    ends[:-1] &= ~mask[1:]
    ends[bounds - 1] = mask[bounds - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Worded:
    """The words of a column's texts, as arrays: every text's first word, and the end; where words start in the bytes, and their sizes."""

    def __init__(self, column: pa.Array):
        texts = Strings(column)
        low, high = (int(texts.start[0]), int(texts.start[-1] + texts.size[-1])) if len(column) else (0, 0)
        self.flat = texts.flat[low:high]
        self.space = (self.flat - np.uint8(9) < 5) | (self.flat == 32)
        self.start, end = stretches(~self.space, texts.start - low)
        self.size = end - self.start
        self.first = np.searchsorted(self.start, np.append(texts.start, high) - low)

    def hashes(self) -> np.ndarray:
        """Of each word: eight bytes a step, all words together; words of more than LONG bytes by themselves."""
        padded = np.concatenate((self.flat, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(self.flat) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
        h = _mix(self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        open_ = np.flatnonzero(self.size <= LONG)
        for at in range(0, LONG, 8):
            left = self.size[open_] - at
            open_, left = open_[left > 0], left[left > 0]
            if not len(open_):
                break
            part = eight[self.start[open_] + at] << (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64))
            h[open_] = _mix((h[open_] ^ part) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(self.size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(self.flat[self.start[i] : self.start[i] + self.size[i]], 7)
        return h

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, a space behind each, and where each starts in that, and the end."""
        at = np.concatenate(([0], np.cumsum(self.size + 1)))
        if not len(self.size):
            return b"", at
        plain = np.where(self.space, np.uint8(32), self.flat).tobytes()
        end = self.start + self.size
        parts = np.flatnonzero(self.start[1:] != end[:-1] + 1)  # words that no single white space parts from the next
        a, b = self.start[np.concatenate(([0], parts + 1))], end[np.append(parts, len(end) - 1)]
        return b" ".join([plain[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]) + b" ", at


class Words:
    """Symbols are runs of characters other than white space (space and U+0009 to U+000D)."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor

    def reads(self, column: pa.Array) -> Iterator[np.ndarray]:
        for part in portions(column):
            words = Worded(column[part])
            h = words.hashes()
            yield from (h[a:b] for a, b in pairwise(words.first.tolist()))

    def cutter(self, column: pa.Array) -> Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]:
        words = Worded(column)
        whole, at = words.joined()
        base = words.first[:-1]
        return lambda row, a, b: [whole[i:j] for i, j in zip(at[base[row] + a].tolist(), (at[base[row] + b] - 1).tolist(), strict=True)]

    def parted(self, whole: list[bytes], anchor: np.ndarray, runs: list[bytes]) -> tuple[list[int], list[bytes]]:
        """Contexts as their leads, hashes of the anchors, and their words."""
        return [xxhash.xxh64_intdigest(r, 3) - (1 << 63) for r in runs], whole

    lead_type, lead_sql = pa.int64(), "bigint"

    def hashes(self, symbols: np.ndarray) -> np.ndarray:
        n = max(0, len(symbols) - self.anchor + 1)
        h = symbols[:n]
        for j in range(1, self.anchor):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ symbols[j : j + n])
        return _mix(h)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def anchored(symbols: np.ndarray, bounds: np.ndarray, of: Bytes | Words) -> tuple[np.ndarray, ...]:
    """(hash, document, anchor's place, first window, last window), places within documents; bounds: where documents start, and the end."""
    w = of.window - of.anchor + 1
    if w > 256:
        raise ValueError("windows may be 255 symbols longer than anchors")
    empty = np.zeros(0, np.int64)
    if len(symbols) < of.window:
        return empty.astype(np.uint64), empty, empty, empty, empty
    h = of.hashes(symbols)
    sizes = np.diff(bounds)
    some = sizes >= of.window
    edge = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(edge, bounds[:-1][some], 1)
    np.add.at(edge, (bounds[1:][some] - of.window + 1), -1)
    valid = np.cumsum(edge)[: len(symbols) - of.window + 1] > 0
    found = []
    for c in range(0, len(valid), STEP):
        v = valid[c : c + STEP]
        part = h[c : c + len(v) + w - 1]
        pick = (_least((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), w) & _LOW).astype(np.int64)
        differs = pick[1:] != pick[:-1]
        first = np.flatnonzero(v & np.concatenate(([True], differs | ~v[:-1])))
        last = np.flatnonzero(v & np.concatenate((differs | ~v[1:], [True])))
        found.append((pick[first] + c, first + c, last + c))
    p, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(bounds, a, "right") - 1
    # Empty documents share a bound with the next one; "right" picks the last, which has symbols.
    at = bounds[doc]
    return h[p], doc, p - at, a - at, b - at


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(key, doc_id, doc, text): keys are ids or, where an id is null or repeats, numbers of rows; doc orders documents, null ids last."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = base.select(F.count("*").alias("n"), F.count("doc_id").alias("m")).first()
    if n.n == n.m and not n.n - base.select("doc_id").distinct().count():
        base = base.withColumn("key", F.col("doc_id"))
    else:
        base = cut(base.withColumn("key", F.monotonically_increasing_id()), "keyed")
    return base.select("key", "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")


def _pack(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (p << 16) | ((p - a) << 8) | (b - a)


def _anchor_rows(of: Bytes | Words) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
            h, doc, p, a, b = anchored(np.concatenate(parts), bounds, of)
            key, at = np.array(keys, np.int64)[doc], _pack(p, a, b)
            if len(h):
                order = np.argsort(h, kind="stable")
                again = h[order[1:]] == h[order[:-1]]
                at[order[1:][again]] |= _SURE
                at[order[:-1][again]] |= _SURE
                other = order[1:][again]
                h[other] = _mix(key[other].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ at[other].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(at)], names=["hash", "key", "at"])

        keys, parts, size = [], [], 0
        for batch in batches:
            for key, symbols in zip(batch.column(0).to_pylist(), of.reads(batch.column(1)), strict=True):
                if len(symbols) < of.window:
                    continue
                keys.append(key)
                parts.append(symbols)
                size += len(symbols)
                if size >= JOINED:
                    yield made(keys, parts)
                    keys, parts, size = [], [], 0
        if keys:
            yield made(keys, parts)

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash those that are known to recur or whose neighbour has the same hash."""
    held, same = None, False  # the last row isn't judged before the next is seen; same: as the one before it
    plain = _SURE - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        h, key, at = (np.asarray(batch.column(i)) for i in range(3))
        if held is not None:
            h, key, at = (np.concatenate(([x], y)) for x, y in zip(held, (h, key, at), strict=True))
        equal = h[1:] == h[:-1]
        keep = np.concatenate(([same], equal)) | (at >= _SURE)
        keep[:-1] |= equal
        held, same = (h[-1], key[-1], at[-1]), bool(keep[-1])
        keep = keep[:-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(at[:-1][keep] & plain)], names=["key", "at"])
    if held is not None and same:
        yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2] & plain], pa.int64())], names=["key", "at"])


CONTEXT = "key bigint, doc bigint, first bigint, offset int, more int, rest binary"


def _context_rows(of: Bytes | Words, within: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "key", "doc", "first", "offset", "more", "rest"]
        seen: dict[bytes, tuple[int, int]] = {}  # where a context was met first: document and key
        for batch in batches:
            for part in portions(batch.column(2)):
                keys, docs, texts, places = (batch.column(i)[part] for i in range(4))
                row = np.repeat(np.arange(len(texts)), np.asarray(places.value_lengths()))
                at = np.asarray(places.flatten())
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                keys, docs, piece = np.asarray(keys), np.asarray(docs), of.cutter(texts)
                for i in range(0, len(at), BATCH):
                    r, p, back, more = row[i : i + BATCH], at[i : i + BATCH] >> 16, at[i : i + BATCH] >> 8 & 255, at[i : i + BATCH] & 255
                    whole, first = piece(r, p - back, p - back + more + of.window), []
                    for data, doc, key in zip(whole, docs[r].tolist(), keys[r].tolist(), strict=True):
                        before = seen.get(data)
                        if before is None:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen[data] = (doc, key)
                        first.append(before is None or not (before[0] < doc or within and before[1] == key))
                    gone = ~np.array(first)
                    own = np.flatnonzero(first)
                    lead, rest = of.parted(list(compress(whole, first)), back[own], piece(r[own], p[own], p[own] + of.anchor))
                    where = pa.array(np.cumsum(~gone) - 1, mask=gone)
                    columns = [pa.array(lead, of.lead_type).take(where), pa.array(keys[r]), pa.array(docs[r]), pa.array(p - back), pa.array(back, pa.int32()), pa.array(more, pa.int32()), pa.array(rest, pa.binary()).take(where)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contexts(base: DataFrame, of: Bytes | Words, within: bool) -> DataFrame:
    """(lead, key, doc, first, offset, more, rest) of the anchors that recur: the context's symbols in two parts, its document,
    the first of its windows, the anchor's place in it, how many more windows follow. Without lead and rest: it is combined
    with an equal one, and its windows are repeats. within: a document's own earlier places count."""
    parts = shuffle_parts(base.sparkSession)
    rows = arrow(base.select("key", "text"), _anchor_rows(of), "hash bigint, key bigint, at bigint")
    rows = arrow(rows.repartition(parts, "hash").sortWithinPartitions("hash"), _recurring, "key bigint, at bigint")
    places = rows.groupBy("key").agg(F.collect_list("at").alias("places"))  # at most a document's length
    texts = base.select("key", "doc", "text").join(places, "key").select("key", "doc", "text", "places").sortWithinPartitions("doc", "key")
    return arrow(texts, _context_rows(of, within), f"lead {of.lead_sql}, {CONTEXT}")


class Bucket:
    """Contexts as arrays, in the order of (doc, key, first)."""

    def __init__(self, table: pa.Table):
        key, doc, first = (np.asarray(table.column(c)) for c in ("key", "doc", "first"))
        order = np.lexsort((first, key, doc))
        self.key, self.doc, self.first = key[order], doc[order], first[order]
        self.offset, self.more = (np.asarray(table.column(c))[order].astype(np.int64) for c in ("offset", "more"))
        self.rest = table.column("rest").combine_chunks().take(pa.array(order))
        lead = table.column("lead").combine_chunks().take(pa.array(order))
        self.lead = lead if pa.types.is_binary(lead.type) else np.asarray(lead)

    def __len__(self) -> int:
        return len(self.key)

    def later(self, rows: np.ndarray, of: np.ndarray, within: bool) -> np.ndarray:
        """Which of some rows, in their order, are preceded in their class by another document's or, if within counts, by their own."""
        order = np.argsort(of, kind="stable")
        c, doc, key = of[order], self.doc[rows][order], self.key[rows][order]
        opens = np.concatenate(([True], c[1:] != c[:-1]))
        found = doc > doc[opens][np.cumsum(opens) - 1]
        if within:
            found[1:] |= ~opens[1:] & (key[1:] == key[:-1])
        out = np.empty(len(rows), bool)
        out[order] = found
        return out


def runs_of(repeat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row of a matrix."""
    padded = np.zeros((repeat.shape[0], repeat.shape[1] + 2), np.int8)
    padded[:, 1:-1] = repeat
    step = np.diff(padded, axis=1)
    r, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return rows[r], a, b - 1


#: What resolvers give: runs of repeats (row, first, last), and open windows (row, first, symbols).
Resolved = tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list[bytes]]]
OUT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("window", pa.binary())])
OUT_SQL = "key bigint, doc bigint, first bigint, last bigint, window binary"


def resolved(found: DataFrame, resolver: Callable[[Bucket], Resolved], bucket: int) -> DataFrame:
    """(key, doc, first, last, window): runs of repeated windows; with window: one that may have equals in other buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        of = Bucket(pa.Table.from_batches(held))
        held.clear()
        (row, first, last), (open_, at, windows) = resolver(of)
        yield pa.RecordBatch.from_arrays([pa.array(of.key[row]), pa.array(of.doc[row]), pa.array(first), pa.array(last), pa.nulls(len(row), pa.binary())], schema=OUT)
        for i in range(0, len(open_), BATCH):
            part = slice(i, i + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(of.key[open_[part]]), pa.array(of.doc[open_[part]]), pa.array(at[part]), pa.array(at[part]), pa.array(windows[part], pa.binary())], schema=OUT)

    spark = found.sparkSession
    parts = max(shuffle_parts(spark), -(-found.count() // bucket))
    before = spark.conf.get(_SAMPLES)
    spark.conf.set(_SAMPLES, str(SAMPLES))
    try:
        return cut(arrow(found.repartitionByRange(parts, "lead", "key", "first"), run, OUT_SQL), "repeats")
    finally:
        spark.conf.set(_SAMPLES, before)


def judged(found: DataFrame, of: Bytes | Words, resolver: Callable[[Bucket], Resolved], within: bool, bucket: int = BUCKET) -> DataFrame:
    """(key, first, last) of repeated windows: of combined contexts, of buckets, and across their boundaries."""
    told = resolved(found.where("rest is not null"), resolver, bucket)
    parts = [found.where("rest is null").select("key", "first", F.expr("first + more").alias("last")), told.where("window is null").select("key", "first", "last")]
    lead = F.col("window") if of.lead_sql == "binary" else F.xxhash64("window")
    rest = F.lit(b"") if of.lead_sql == "binary" else F.col("window")
    open_ = told.where("window is not null").select(lead.alias("lead"), "key", "doc", "first", F.lit(0).alias("offset"), F.lit(0).alias("more"), rest.alias("rest"))
    if not open_.isEmpty():
        across = resolved(open_, resolver, bucket)
        # A few windows for each boundary; a document's places of one are one row.
        edge = across.where("window is not null").groupBy("window", "key", "doc").agg(F.sort_array(F.collect_list("first")).alias("places"))
        edge = edge.withColumn("least", F.min("doc").over(Window.partitionBy("window")))
        edge = edge.select("key", (F.col("doc") > F.col("least")).alias("later"), F.posexplode("places").alias("nth", "first"))
        later = F.col("later") | (F.col("nth") > 0) if within else F.col("later")
        parts += [across.where("window is null").select("key", "first", "last"), edge.where(later).select("key", "first", F.col("first").alias("last"))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def with_runs(base: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, text, runs) of every document, runs null where there are none."""
    by = runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # at most a document's length
    return base.join(by, "key", "left").select("doc_id", "text", "runs")


def covered(n: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Which of n symbols lie in a window of the runs."""
    edge = np.zeros(n + 1, np.int64)
    if runs:
        np.add.at(edge, [r["first"] for r in runs], 1)
        np.add.at(edge, [r["last"] + window for r in runs], -1)
    return np.cumsum(edge[:-1]) > 0


def covered_all(bounds: np.ndarray, runs: pa.ListArray, window: int) -> np.ndarray:
    """Which symbols of texts lie in a window of their runs; bounds: where texts start among the symbols, and the end."""
    start = np.repeat(bounds[:-1], np.asarray(runs.value_lengths().fill_null(0)))
    first, last = (np.asarray(x) for x in runs.flatten().flatten())
    n = int(bounds[-1]) + 1
    return np.cumsum(np.bincount(start + first, minlength=n) - np.bincount(start + last + window, minlength=n))[:-1] > 0

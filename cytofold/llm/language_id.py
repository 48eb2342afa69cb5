"""Language identification by compression.

Each language has some zstandard raw-content dictionaries of its own text. A whole text, in lower case, is compressed in
blocks with each; the language whose dictionaries leave the fewest bytes is chosen. A short text is repeated, so that
its first copy's cost is seen in the size. The margin between the two smallest sizes, against the smallest, gives the
score; texts whose margin is below a limit are marked as rejected (the best guess is still given).

Every language of the labelled rows is learned. The sample that it is learned from is bounded: of each language the
PER_LANGUAGE rows whose hash of id and text is smallest, dealt to DICTIONARIES dictionaries of DICTIONARY bytes at most, of
which one row fills a PART at most; with very many languages dictionaries are smaller, so that all together hold TOTAL bytes.

Null texts and texts without a letter are `und` with score 0. Ties go to the language first in order. Where no row
is labelled, all are `und`. Null or repeated ids are rows like others; rows that repeat id and text are learned once.
Very long texts are compressed as a whole, a block at a time. Columns whose names are those of the results are
replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow, cut

PER_LANGUAGE, DICTIONARY, DICTIONARIES, TOTAL, PART = 300, 1 << 17, 2, 1 << 24, 16
#: Bytes that are compressed together, the level, and the characters under which a text is repeated.
BLOCK, LEVEL, SHORT = 1 << 12, 6, 300
#: A margin under this share of the smallest size is narrow.
NARROW = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def dictionary_size(languages: int) -> int:
    return max(256, min(DICTIONARY, TOTAL // (DICTIONARIES * max(1, languages))))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, list[bytes]]:
    """Raw-content dictionaries of each language from the rows for which learn holds."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("at"), learn.alias("learn")).where("learn and lang is not null and length(trim(text)) > 0")
    order = Window.partitionBy("lang").orderBy("at")
    picked = cut(rows.select("lang", "at").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE).groupBy("lang", "at").agg(F.min("rank").alias("rank")), "lang-sample")
    size = dictionary_size(picked.select("lang").distinct().count())
    sample = rows.join(picked, ["lang", "at"])
    part = size // PART

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [t.as_py().lower().encode("utf-8", "replace")[:part] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.binary())], names=["lang", "rank", "part"])

    # A text comes as what a dictionary can hold of it; rows that repeat one come once.
    rows_ = arrow(sample.select("lang", "rank", "text"), parts, "lang string, rank int, part binary").distinct()
    made: dict[str, list[bytearray]] = {}
    for row in rows_.orderBy("lang", "rank", "part").toLocalIterator():
        of = made.setdefault(row.lang, [bytearray() for _ in range(DICTIONARIES)])[row.rank % DICTIONARIES]
        if len(of) < size:
            of += bytes(row.part) + b"\n"
    return {name: [bytes(d[:size]) for d in ds if d] for name, ds in sorted(made.items())}


class Sizer:
    """Compressed bytes of a text by each language's dictionaries."""

    def __init__(self, dictionaries: dict[str, list[bytes]]):
        self.names = sorted(dictionaries)
        self.by = [[self._compressor(d) for d in dictionaries[n]] for n in self.names]

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[float]:
        plain = text.lower()
        data = (plain if len(plain) > SHORT else " ".join([plain] * 4)).encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        return [sum(len(c.compress(b)) for c in cs for b in blocks) / max(1, len(cs)) for cs in self.by]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / max(1.0, best) if len(order) > 1 else 1.0
        return self.names[order[0]], 1 - math.exp(-20 * margin), margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, list[bytes]], text: str = "text") -> DataFrame:
    """docs without text, plus lang_pred, score and rejected; columns of these names are replaced."""
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c != text and c not in new]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept) + "lang_pred string, score double, rejected boolean"
    # Bounded: TOTAL bytes.
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(sent.value)
        for batch in batches:
            made = [sizer.predict(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *new])

    return arrow(docs.select(*(docs[c] for c in [*kept, text])), run, schema)

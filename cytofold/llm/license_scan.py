"""License scan: an exact set-similarity join of text blocks with license templates.

Words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII. Templates may have any length, notices or
whole licenses; one of up to n words, n the least of STEP, 2 STEP, 4 STEP and so on that does, is compared with blocks of 2 n
words, each n words, over the whole text, so a passage of n words lies whole in one. A template (its distinct words) matches
a block when the block has at least THRESHOLD of them. Words are ordered by how often they occur in all documents, rare
ones first; two sets with so many words in common share one of the template's first |T| - c + 1 words (prefix filter),
the block has at least c words of templates (length filter), and what is left behind the shared word on both sides
reaches c (positional filter). What passes is counted exactly, so every matching pair of block and template is found.

Templates of one family differ by a word or two, so a set match alone doesn't tell them apart. With telling, a match
counts only if its block has one of the label's telling runs, whole and as consecutive words: TELLING has the runs by
which the labels of TEMPLATES are told from their neighbours. A passage whose telling run is edited gets no label.

Beside the templates, fixed phrases are looked up as consecutive words. Templates and phrases are parameters and
small; the frequencies that come to the driver are those of the templates' words.

Null text is empty text. Rows are judged one by one, so repeated rows get equal results; empty tables give empty ones.
Work on a text grows with its length, very long ones included, times the templates' occurrences. Columns whose names are
those of the results are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow

THRESHOLD, STEP = 0.8, 32
#: Base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
#: Notices, grants and whole licenses by which licenses are recognised (fixed values).
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0": ["the person who associated a work with this deed has dedicated the work to the public domain"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
    "isc": ["and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", _ISC],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", _MIT],
    "mpl-2.0": ["licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
_GPL = ("gnu general public license version {}", "gnu general public license as published by the free software foundation either version {}", "gnu general public license as published by the free software foundation version {}")
#: Of each label the runs of words one of which a block must have, beside a template's words (fixed values).
TELLING = {
    "apache-2.0": ["apache license version 2.0", "apache org licenses license 2.0"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-4.0": ["cc by 4.0", "creative commons attribution 4.0"],
    "cc-by-nc-4.0": ["cc by-nc 4.0", "creative commons attribution noncommercial 4.0", "creative commons attribution non commercial 4.0"],
    "cc-by-sa-4.0": ["cc by-sa 4.0", "creative commons attribution sharealike 4.0", "creative commons attribution share alike 4.0"],
    "cc0": ["dedicated the work to the public domain"],
    "gpl-2.0": [x.format(2) for x in _GPL],
    "gpl-3.0": [x.format(3) for x in _GPL],
    "isc": ["provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["mit license", "to deal in the software without restriction"],
    "mpl-2.0": ["mozilla public license version 2.0", "mozilla public license v 2.0"],
    "unlicense": ["free and unencumbered software released into the public domain"],
}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def template_sets(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, frozenset[bytes], int]]:
    """(label, distinct words, step of the blocks) of each template."""
    made = []
    for label, texts in sorted(templates.items()):
        for t in texts:
            step, parts = STEP, words(t)
            if not parts:
                raise ValueError("a template has no word")
            while step < len(parts):
                step *= 2
            made.append((label, frozenset(parts), step))
    return made


def frequencies(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """How often each word of the templates occurs in all documents."""
    wanted = frozenset(w for _, s, _ in template_sets(templates) for w in s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                count.update(filter(wanted.__contains__, words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    rows = arrow(docs.select(text), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the templates' words
    found = {r.word.encode(): r.n for r in rows}
    return {w: found.get(w, 0) for w in wanted}


class Scanner:
    def __init__(self, count: dict[bytes, int], templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, telling: dict[str, list[str]] | None = None):
        self.telling = None if telling is None else {label: [b" %b " % b" ".join(words(r)) for r in runs] for label, runs in telling.items()}
        self.order = {w: i for i, w in enumerate(sorted(count, key=lambda w: (count[w], w)))}
        self.templates = [(label, sorted(s, key=self.order.__getitem__), s, math.ceil(threshold * len(s) - 1e-9)) for label, s, _ in template_sets(templates)]
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        #: By step: the templates whose prefix has a word, and the word's place in it.
        self.prefix: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, (_, _, step) in enumerate(template_sets(templates)):
            _, ranked, _, need = self.templates[k]
            for i, w in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefix.setdefault(step, {}).setdefault(w, []).append((k, i))

    def base(self, parts: list[bytes]) -> tuple[list[int], set[str]]:
        """Where phrases stand, as word numbers, and their labels."""
        places: list[int] = []
        found: set[str] = set()
        joined, starts = b" " + b" ".join(parts) + b" ", None
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            if at >= 0 and starts is None:
                starts = list(accumulate(map(len, parts), lambda a, n: a + n + 1, initial=0))  # of each word, its blank
            while at >= 0:
                places.append(bisect_left(starts, at))
                found.add(label)
                at = joined.find(phrase, at + 1)
        return places, found

    def matches(self, parts: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word of the block, its words, label, containment) of every block and template that match."""
        found, there = [], set(parts)
        for step, prefix in self.prefix.items():
            hits = prefix.keys() & there
            if not hits:
                continue
            starts = sorted({s for i, w in enumerate(parts) if w in hits for s in (i // step * step - step, i // step * step) if s >= 0})
            for start in starts:
                block = sorted({w for w in parts[start : start + 2 * step] if w in self.order}, key=self.order.__getitem__)
                tried = set()
                for j, w in enumerate(block):
                    for k, i in prefix.get(w, ()):
                        label, ranked, whole, need = self.templates[k]
                        if k in tried or len(block) < need or min(len(ranked) - i, len(block) - j) < need:
                            continue
                        tried.add(k)
                        both = len(whole.intersection(block))
                        if both >= need:
                            found.append((start, 2 * step, label, both / len(whole)))
        return found

    def told(self, parts: list[bytes], start: int, size: int, label: str) -> bool:
        """Whether the block has a telling run of the label; labels without runs need none."""
        if self.telling is None or label not in self.telling:
            return True
        block = b" %b " % b" ".join(parts[start : start + size])
        return any(run in block for run in self.telling[label])

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        parts = words(text)
        places, base = self.base(parts)
        matches = [m for m in self.matches(parts) if self.told(parts, *m[:3])]
        score = max([1.0 if places else 0.0, *(m[3] for m in matches)])
        return len(parts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[2] for m in matches})), score


#: What scan_documents adds (fixed values).
COLUMNS = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}


def scan_documents(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, telling: dict[str, list[str]] | None = None) -> DataFrame:
    """docs without text, plus COLUMNS; columns of these names are replaced."""
    scanner = Scanner(frequencies(docs, templates, text), templates, phrases, threshold, telling)
    kept = [c for c in docs.columns if c != text and c not in COLUMNS]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept) + ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scanner.scan(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([x[k] for x in made], kinds[kind]) for k, kind in enumerate(COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *COLUMNS])

    return arrow(docs.select(*(docs[c] for c in [*kept, text])), run, schema)

"""SentencePiece merge-type encoding and decoding.

Encoding is the backtracking form of byte-pair merging. A segmentation is the one that merging would leave exactly
when each token is what merging leaves of its own text and each two neighbours stay apart when their joined text is
merged anew. So: take the longest vocabulary match (Aho-Corasick) at each place, test it against its left
neighbour, fall back to shorter matches, and step back where none fits, keeping in a bitfield the places from which
no ending exists. Each place fails once at most, so the work is linear in the text, very long texts included.

Decoding takes the ids, not the text: their pieces are joined, runs of byte pieces are read as UTF-8.

Texts are cut before white space that follows something else, between marks and what else no piece holds beside them,
and around characters that no longer piece holds: no piece spans such a place (checked when the model is loaded), so no merge does. What is found for a unit is kept in
a dictionary of bounded size.

Null text is empty text and has no ids. Repeated rows are encoded each. No row is dropped; an empty table gives an
empty result. Columns whose names are those of the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow

SPACE = "▁"
#: Units and neighbour tests that one worker keeps; a full dictionary is emptied.
KEPT = 300_000
#: Kinds of piece in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialized message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 5:
            yield number, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield number, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            raise ValueError(f"field {number} has wire type {wire}")


class PieceCodec:
    """Ids of a text, and the text of ids, by the model file at path."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only merge-type (BPE) models are encoded")
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only the identity normalizer that keeps white space is supported")
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        if not trainer.get(35, 0):
            raise ValueError("only models with byte fallback are supported")
        self.marks = {i for i, (_, _, kind) in enumerate(self.pieces) if kind in (UNKNOWN, CONTROL)}
        self.said = [bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode() for piece, _, kind in self.pieces]
        self.number = [str(i) for i in range(len(self.pieces))]
        self.prefix = bool(spec.get(3, 1))
        self.kept = kept
        usable = {s: i for i, (s, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        self.ids, self.scores = usable, {s: self.pieces[i][1] for s, i in usable.items()}
        self.bytes = {int(s[3:5], 16): i for i, (s, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unit = re.compile(self._unit_pattern([s for s in usable if len(s) > 1]), re.S)
        self.known = re.compile(f"[{re.escape(''.join(s for s in usable if len(s) == 1))}]*")
        self.done = _Units(self)
        self.text = [s for s, _, _ in self.pieces]
        self.size = [len(s) for s in self.text]
        #: For each token at the left the tokens that were tested at its right; how many in all.
        self.apart: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.tested = 0
        order = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.order = {i: order[self.scores[s]] for s, i in usable.items()}
        #: When a token is merged (single characters: before all others), and of what.
        self.rank, self.halves = [-1] * len(self.pieces), {}
        self.finder = ahocorasick.Automaton()
        for s, i in usable.items():
            if len(s) == 1:
                self.finder.add_word(s, (0, i))
            elif self.merged(s) == [s]:
                self.finder.add_word(s, (len(s) - 1, i))
                self.rank[i], self.halves[i] = self.order[i], tuple(usable[x] for x in self.merged(s, 2))
        #: Tokens of which a part at an edge is merged later than the whole could be: their neighbours are merged anew.
        self.odd: set[int] = set()
        for i in sorted(self.halves, key=self.size.__getitem__):
            if any(x in self.odd or self.rank[x] >= self.rank[i] for x in self.halves[i]):
                self.odd.add(i)
        #: The longest token that starts a token, itself excluded; -1: none.
        self.shorter = [-1] * len(self.pieces)
        for s in self.finder:
            self.shorter[usable[s]] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.finder), -1)
        self.finder.make_automaton()

    @staticmethod
    def _unit_pattern(longer: list[str]) -> str:
        """A pattern of the units: between two of them stands no pair of characters that a piece holds side by side."""
        pairs = {(a, b) for s in longer for a, b in zip(s, s[1:], strict=False)}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            return ".+"
        merging = {c for pair in pairs for c in pair}
        alone = {c for c in "\n\r\t" if c not in merging}
        marks = {c for c in merging if not c.isalnum() and c != SPACE}  # that nothing but marks follows in a piece
        while odd := {a for a, b in pairs if a in marks and b not in marks}:
            marks -= odd
        before = {a for a, b in pairs if b in marks and a not in marks and a != SPACE}  # what else marks follow
        a, m, x = (re.escape("".join(sorted(c))) for c in (alone, marks, before))
        rest = f"[^{SPACE}{a}{m}]"
        rest = f"{rest}+(?:(?<=[{x}])[{m}]+{rest}*)*" if x else f"{rest}+"
        return "|".join([f"[{a}]"] * bool(a) + [f"{SPACE}*{rest}"] + [f"{SPACE}*[{m}]+"] * bool(m) + [f"{SPACE}+"])

    def merged(self, text: str, least: int = 1) -> list[str]:
        """text by merging itself, down to least parts: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.scores
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens apart."""
        if self.tested >= self.kept:
            for row in self.apart:
                row.clear()
            self.tested = 0
        self.tested += 1
        known = self.apart[left][right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Merges are undone from the last one backwards, only those at the tokens' border: whenever the parts that
        then meet there could be merged before the merge that is undone, they would have been. Of equals the leftmost is first."""
        text, rank, ids = self.text, self.rank, self.ids
        if left in self.odd or right in self.odd:
            return self.merged(text[left] + text[right]) == [text[left], text[right]]
        limit = len(rank)
        while True:
            whole = ids.get(text[left] + text[right])
            if whole is not None and self.order[whole] < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], self.halves[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, self.halves[right][0]
            else:
                return True

    def split(self, text: str) -> list[str]:
        """The tokens of text, all of whose characters are pieces."""
        return [self.text[i] for i in self.split_ids(text)]

    def split_ids(self, text: str) -> list[int]:
        n = len(text)
        if not n:
            return []
        longest = [-1] * n
        for end, (back, token) in self.finder.iter(text):
            longest[end - back] = token  # of those that start at one place, longer ones end later
        shorter, apart, size = self.shorter, self.apart, self.size
        failed: bytearray | None = None  # bit i is 1 once no ending from i exists
        token = longest[0]
        taken, at = [token], size[token]  # nothing stands before the first token that it had to fit
        while at < n:
            last, token = token, longest[at]
            row = apart[last]
            while token >= 0:
                if failed is None or not failed[at + size[token] >> 3] >> (at + size[token] & 7) & 1:
                    fits = row.get(token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                token = last
                while True:  # back to a token in whose place a shorter one fits
                    failed[at >> 3] |= 1 << (at & 7)
                    at -= size[taken.pop()]
                    token = shorter[token]
                    while token >= 0:
                        if not failed[at + size[token] >> 3] >> (at + size[token] & 7) & 1 and (not taken or self._fits(taken[-1], token)):
                            break
                        token = shorter[token]
                    if token >= 0:
                        break
                    if not taken:
                        raise ValueError("no segmentation")
                    token = taken[-1]
            taken.append(token)
            at += size[token]
        return taken

    def _fits(self, left: int, right: int) -> bool:
        fits = self.apart[left].get(right)
        return self.compatible(left, right) if fits is None else fits

    def unit_ids(self, unit: str) -> list[int]:
        if self.known.fullmatch(unit):
            return self.split_ids(unit)
        found: list[int] = []
        run = ""
        for c in unit:
            if c in self.ids:
                run += c
            else:
                found += self.split_ids(run)
                found += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                run = ""
        return found + self.split_ids(run)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.done.__getitem__, self.units(text or ""))))

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; runs of byte pieces are read as UTF-8, each byte that isn't becomes U+FFFD; the first white space is the prefix."""
        if ids and self.marks.isdisjoint(ids):
            # Where all bytes together are UTF-8, each run of byte pieces is, since other pieces are whole characters.
            with suppress(UnicodeDecodeError):
                whole = b"".join(map(self.said.__getitem__, ids)).decode()
                return whole[1:] if self.prefix and whole.startswith(" ") and self.pieces[ids[0]][2] != BYTE else whole
        out: list[str] = []
        raw = bytearray()
        first = True

        def flush() -> None:
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                out.append((piece[1:] if first and self.prefix and piece.startswith(SPACE) else piece).replace(SPACE, " "))
            first = False
        flush()
        return "".join(out)

    def digest(self, text: str | None) -> tuple[int, str, str, list[int]]:
        """How many ids, the SHA-256 of the ids and of the text that they decode to, and the ids."""
        ids = self.encode(text)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        return len(ids), sha(",".join(map(self.number.__getitem__, ids))), sha(self.decode(ids)), ids


class _Units(dict):
    """The ids of units; emptied when full."""

    def __init__(self, of: PieceCodec):
        super().__init__()
        self.of = of

    def __missing__(self, unit: str) -> tuple[int, ...]:
        found = tuple(self.of.unit_ids(unit))
        if len(unit) <= 48:
            if len(self) >= self.of.kept:
                self.clear()
            self[unit] = found
        return found


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs' columns plus n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids; a column of such a name is replaced."""
    new = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    if keep_ids:
        new.append(("ids", pa.list_(pa.int32()), "array<int>"))
    names = {n for n, _, _ in new}
    docs = docs.select([docs[c] for c in docs.columns if c not in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + "".join(f", {n} {kind}" for n, _, kind in new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts = part.column(text)
                made = [c.digest(t.as_py())[: len(new)] for t in texts]
                columns = [pa.array([x[k] for x in made], kind) for k, (_, kind, _) in enumerate(new[:3])]
                if keep_ids:
                    columns.append(pa.array([x[3] for x in made], new[3][1]))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(n for n, _, _ in new)])

    return arrow(docs, run, schema)

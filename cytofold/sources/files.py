"""Files that aren't lines: sequence files, reads, BAM and annotation flat files.

register(spark) makes seqfile, reads, bam and flatfile formats of spark.read. BAM files are split at their blocks; a file
of another format is one partition and is streamed. Many files are read side by side. Paths are one or more parted by
commas, with *, ? and [] or folders, local or of any store that pyarrow.fs opens (s3, gs, hdfs, …).
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import ship


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files or of those that a pattern names, sorted."""
    at, inside = store(path)
    prefix = path.removesuffix(inside) if "://" in path else ""
    info = at.get_file_info(inside)
    if info.type == stores.FileType.File:
        return [(path, info.size)]
    parts = inside.split("/")
    fixed = next((i for i, x in enumerate(parts) if re.search(r"[*?\[]", x)), len(parts))
    wanted = parts[fixed:] or ["*"]
    found = at.get_file_info(stores.FileSelector("/".join(parts[:fixed]) or "/", allow_not_found=True, recursive=len(wanted) > 1))
    fits = lambda p: len(p) == len(wanted) and all(map(fnmatch.fnmatchcase, p, wanted))
    hits = sorted((prefix + f.path, f.size) for f in found if f.type == stores.FileType.File and fits(f.path.split("/")[fixed:]))
    if not hits:
        raise FileNotFoundError(path)
    return hits


class File(InputPartition):
    """Bytes start to end of a file: all of it where the format can't be split."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    #: Bytes of a partition; 0: a file is one.
    split = 0

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[File]:
        step = int(self.options.get("split", self.split)) if self.split else 0
        files = [f for p in self.options["path"].split(",") for f in listed(p.strip())]
        return [File(p, a, min(a + step, n) if step else n) for p, n in files for a in (range(0, n, step) if step else [0])]

    def rows(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: File) -> Iterator[tuple]:
        yield from self.rows(partition.path)


def opened(path: str):
    """A text file, unpacked if it is gzip."""
    at, inside = store(path)
    f = at.open_input_file(inside)
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=f) if packed else io.BufferedReader(f), errors="replace")


# Sequence files.


def sequences(lines: Iterator[str], kind: str = "fasta") -> Iterator[tuple[str, str]]:
    """(name, sequence) of fasta, nbrf, staden, gcg, molgen or raw text; residues are letters and -, a * ends them."""
    clean = lambda s: re.sub(r"[^A-Za-z\-]", "", s.split("*")[0])
    if kind in ("raw", "staden"):
        parts = [line.lstrip("<-").rstrip("\n") for line in lines if not line.startswith(";")]
        name = ""
        if kind == "staden" and parts and (m := re.match(r"-*(\S+?)-*>(.*)", parts[0])):
            name, parts[0] = m[1], m[2]
        yield name, "".join(map(clean, parts))
        return
    if kind == "gcg":
        name, seq, inside = "", [], False
        for line in lines:
            if inside:
                seq.append(clean(line))
            elif ".." in line:
                name, inside = line.split()[0], True
        yield name, "".join(seq)
        return
    start = ";" if kind == "molgen" else ">"
    name, seq, skip, ended = None, [], 0, False
    for line in lines:
        if line.startswith(start) and not (kind == "molgen" and name is not None and not seq):
            if name is not None:
                yield name, "".join(seq)
            name, seq, ended = line[1:].strip(), [], False
            if kind == "nbrf":
                name, skip = name.split(";", 1)[-1], 1  # its next line is a title
        elif skip:
            skip -= 1
        elif name is not None and not ended:
            seq.append(clean(line))
            ended = "*" in line
    if name is not None:
        yield name, "".join(seq)


class SeqReader(Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        first = self.options.get("first", "false").lower() == "true"
        with opened(path) as f:
            for i, (name, seq) in enumerate(sequences(f, self.options.get("kind", "fasta"))):
                if first and i:
                    return
                yield path, i, name, seq


class SeqFile(DataSource):
    """Options path, kind, first (the first record only)."""

    @classmethod
    def name(cls) -> str:
        return "seqfile"

    def schema(self) -> str:
        return "path string, record int, name string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return SeqReader(self.options)


# Reads.


def reads(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(header, sequence, plus line, qualities) of FASTQ records, or of two-line FASTA ones, by the first character."""
    it = (line.rstrip("\n") for line in lines)
    for header in it:
        if not header:
            continue
        seq = next(it, "")
        if header.startswith(">"):
            yield header, seq, None, None
        elif header.startswith("@"):
            yield header, seq, next(it, ""), next(it, "")
        else:
            raise ValueError(f"not a read's header: {header[:60]}")


class ReadsReader(Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        with opened(path) as f:
            for i, r in enumerate(reads(f)):
                yield (path, i + 1, *r)


class Reads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return "path string, read_no bigint, header string, seq string, plus string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return ReadsReader(self.options)


# BAM.

BASES = "=ACMGRSVTWYHKDBN"  # fixed values: 4-bit bases and CIGAR operations
OPERATIONS = "MIDNSHP=X"
_NUMBER = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def tags(data: bytes) -> dict[str, str]:
    """Auxiliary fields as tag -> type:value."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name], at = f"A:{chr(data[at])}", at + 1
        elif kind in _NUMBER:
            (value,) = struct.unpack_from(_NUMBER[kind], data, at)
            at += struct.calcsize(_NUMBER[kind])
            out[name] = f"f:{value:g}" if kind == "f" else f"i:{value}"
        elif kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = f"{kind}:{data[at:end].decode('latin-1')}", end + 1
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            size = struct.calcsize(_NUMBER[inner])
            values = [struct.unpack_from(_NUMBER[inner], data, at + 5 + i * size)[0] for i in range(n)]
            out[name], at = f"B:{inner}," + ",".join(f"{v:g}" if inner == "f" else str(v) for v in values), at + 5 + n * size
        else:
            raise ValueError(f"auxiliary field of type {kind}")
    return out


def bam_header(stream) -> tuple[list[str], list[int]]:
    """Names and lengths of the references of an unpacked BAM stream, which stands at its first alignment then."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.read(4))[0]
    stream.read(number())
    names, lengths = [], []
    for _ in range(number()):
        names.append(stream.read(number())[:-1].decode())
        lengths.append(number())
    return names, lengths


def bam_row(data: bytes, refs: list[str]) -> tuple:
    """An alignment's row from its bytes behind their number; positions are 1-based."""
    named = lambda i: refs[i] if i >= 0 else "*"
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] or "*"
    at += (n_seq + 1) // 2
    qual = data[at : at + n_seq]
    at += n_seq
    text = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    return name, flag, named(ref), pos + 1, mapq, cigar, "=" if next_ref == ref and ref >= 0 else named(next_ref), next_pos + 1, tlen, seq, text, tags(data[at:])


def bam_records(stream) -> Iterator[tuple]:
    """Alignments of an unpacked BAM stream."""
    refs = bam_header(stream)[0]
    while len(size := stream.read(4)) == 4:
        data = stream.read(n := struct.unpack("<i", size)[0])
        if len(data) < n:
            raise ValueError("an alignment is cut short")
        yield bam_row(data, refs)


class Ahead:
    """A file that is read a megabyte at a time, so that a store gets few requests."""

    def __init__(self, f):
        self.f, self.at, self.data = f, 0, b""

    def size(self) -> int:
        return self.f.size()

    def read_at(self, n: int, at: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.f.read_at(max(n, 1 << 20), at)
        return self.data[at - self.at : at - self.at + n]


def block(f, at: int) -> tuple[bytes, int] | None:
    """What the BGZF block at a place of a file holds and where the next one begins; None if there is no whole block."""
    head = f.read_at(12, at)
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    more = struct.unpack_from("<H", head, 10)[0]
    extra, i, size = f.read_at(more, at + 12), 0, 0
    while i + 4 <= len(extra):
        kind, n = extra[i : i + 2], struct.unpack_from("<H", extra, i + 2)[0]
        if kind == b"BC" and n == 2 and i + 6 <= len(extra):
            size = struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + n
    if size < more + 20:
        return None
    data = f.read_at(size - more - 12, at + 12 + more)
    try:
        made = zlib.decompress(data[:-8], -15)
    except zlib.error:
        return None
    return (made, at + size) if len(data) == size - more - 12 and struct.unpack("<II", data[-8:]) == (zlib.crc32(made), len(made)) else None


class Blocks:
    """The bytes of a file's blocks from one on, as a stream; own() tells whether its place is in a block that begins before end."""

    def __init__(self, f, at: int, end: int):
        self.f, self.next, self.end, self.size = f, at, end, f.size()
        self.held, self.at, self.loaded, self.limit = bytearray(), 0, 0, None
        self.begins: list[tuple[int, int]] = []  # (bytes before, place in the file) of the blocks that are held

    def fill(self) -> bool:
        if self.next >= self.size:
            return False
        found = block(self.f, self.next)
        if found is None:
            raise ValueError(f"no whole block at byte {self.next}")
        if self.limit is None and self.next >= self.end:
            self.limit = self.loaded
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0
            self.begins = [x for x in self.begins if x[0] >= self.place() - (1 << 16)]
        self.begins.append((self.loaded, self.next))
        self.held += found[0]
        self.loaded, self.next = self.loaded + len(found[0]), found[1]
        return True

    def place(self) -> int:
        return self.loaded - len(self.held) + self.at

    def peek(self, n: int, skip: int = 0) -> bytes:
        while len(self.held) - self.at < skip + n and self.fill():
            pass
        return bytes(self.held[self.at + skip : self.at + skip + n])

    def read(self, n: int) -> bytes:
        data = self.peek(n)
        self.at += len(data)
        return data

    def own(self) -> bool:
        while self.place() == self.loaded:
            if not self.fill():
                return False
        return self.limit is None or self.place() < self.limit

    def where(self) -> tuple[int, int]:
        """(place of the block in the file, place in the block); the file's size at its end."""
        while self.place() == self.loaded:
            if not self.fill():
                return self.size, 0
        before, at = max(x for x in self.begins if x[0] <= self.place())
        return at, self.place() - before


#: Alignments in a row that must make sense where one is taken to begin.
CHAIN = 8


def begins_here(blocks: Blocks, skip: int, lengths: list[int]) -> bool:
    """Whether alignments begin skip bytes on: each one's numbers, name and size make sense, up to CHAIN or the file's end."""
    for _ in range(CHAIN):
        data = blocks.peek(36, skip)
        if not data:
            return True
        if len(data) < 36:
            return False
        size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data)
        for r, p in ((ref, pos), (next_ref, next_pos)):
            if not -1 <= r < len(lengths) or not -1 <= p <= (lengths[r] if r >= 0 else 1 << 31):
                return False
        if n_name < 1 or n_seq < 0 or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
            return False
        name = blocks.peek(n_name, skip + 36)
        if len(name) < n_name or name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
            return False
        skip += 4 + size
    return True


def bam_split(f, start: int, end: int) -> Iterator[tuple]:
    """Alignments that begin in blocks which begin at bytes start to end of a BGZF file; all its splits together give each once.

    A block is known by its checksum. Behind the header's end the first alignment is looked for by begins_here(); an
    alignment that makes no sense later on raises, so nothing is lost in silence.
    """
    f = Ahead(f)
    head = Blocks(f, 0, f.size())
    names, lengths = bam_header(head)
    first, inside = head.where()
    if end <= first:
        return
    at, guess = (first, False) if start <= first else (start, True)
    if guess:
        while at < end:
            near = f.read_at(min(1 << 16, end - at) + 3, at)
            i = near.find(b"\x1f\x8b\x08\x04")
            if i >= 0 and block(f, at + i) is not None:
                at += i
                break
            at += i + 1 if i >= 0 else max(len(near) - 3, 1)
        if at >= end:
            return
    stream = Blocks(f, at, end)
    if not guess:
        stream.read(inside)
    while guess and stream.own():
        if begins_here(stream, 0, lengths):
            break
        stream.at += 1
    while stream.own():
        n = struct.unpack("<i", stream.read(4).ljust(4, b"\0"))[0]
        data = stream.read(n) if n >= 32 else b""
        if n < 32 or len(data) < n:
            raise ValueError("not an alignment, or one that is cut short")
        yield bam_row(data, names)


class BamReader(Reader):
    split = 64 << 20

    def read(self, partition: File) -> Iterator[tuple]:
        unplaced = self.options.get("unplaced", "false").lower() == "true"
        at, inside = store(partition.path)
        with at.open_input_file(inside) as f:
            if block(f, 0) is not None:
                found = bam_split(f, partition.start, partition.end)
            elif partition.start:  # plain gzip or unpacked: the first partition reads it all
                return
            else:
                packed = f.read_at(2, 0) == b"\x1f\x8b"
                f.seek(0)
                found = bam_records(gzip.GzipFile(fileobj=f) if packed else f)
            for row in found:
                if unplaced or row[2] != "*":
                    yield row


class Bam(DataSource):
    """Options unplaced: alignments without a reference, too; split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, aux map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


# Annotation flat files.


def location(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(strand, segments) of a feature's place; complement turns the strand each time, join, order and the like list parts."""
    text = re.sub(r"\s", "", text)
    at = 0

    def part(strand: str) -> list[tuple[int, int, str]]:
        nonlocal at
        if m := re.compile(r"(complement|join|order|group|one[-_]of|replace)\(").match(text, at):
            at = m.end()
            inner = ("+" if strand == "-" else "-") if m[1] == "complement" else strand
            found = part(inner)
            while at < len(text) and text[at] == ",":
                at += 1
                if text[at] == '"':  # what replace puts in
                    at = text.index('"', at + 1) + 1
                else:
                    found += part(inner)
            at += 1
            return found
        m = re.compile(r"(?:[\w.]+:)?[<>]?(?:\((\d+)\.\d+\)|(\d+))(?:(?:\.\.|\^|\.)[<>]?(?:\(\d+\.(\d+)\)|(\d+)))?").match(text, at)
        if not m:
            raise ValueError(f"not a place: {text[at:at + 40]}")
        at = m.end()
        first = int(m[1] or m[2])
        return [(first, int(m[3] or m[4] or first), strand)]

    segments = part("+")
    return segments[0][2], segments


def flat_features(lines: Iterator[str], kind: str) -> Iterator[tuple]:
    """(entry, feat_no, type, id, strand, start, end, segments, quals) of EMBL, GenBank or SeqMonk text."""
    embl = kind != "genbank"
    entry, number = "", 0
    current: list | None = None  # type, place, qualifiers

    def made():
        strand, segments = location(current[1])
        quals: dict[str, list[str]] = {}
        for q in current[2]:
            key, _, value = q.partition("=")
            quals.setdefault(key, []).append(value.strip().strip('"').replace('""', '"'))
        ident = next((quals[k][0] for k in ("name", "gene", "protein_id", "locus_tag", "label") if k in quals), None)
        return entry, number, current[0], ident, strand, min(s[0] for s in segments), max(s[1] for s in segments), segments, quals

    table = False
    for raw in lines:
        line = raw.rstrip("\n")
        code = line[:2] if embl else line[:12].strip()
        if line.startswith("//"):
            if current:
                yield made()
                number += 1
            current, table = None, False
            continue
        if embl and code == "ID" or not embl and code == "LOCUS":
            entry = line[5:].split(";")[0].split()[0] if embl else line[12:].split()[0]
            continue
        if embl and code == "AC" and "chromosome:" in line:
            entry = line.split(":")[2]
        if not embl and line.startswith("FEATURES"):
            table = True
            continue
        inside = line.startswith("FT") if embl else table and line.startswith("     ")
        if not inside:
            if not embl and code:
                table = False
            if current and not inside:
                yield made()
                number += 1
                current = None
            continue
        body = line[5:]
        if body[:1].strip():  # a new feature
            if current:
                yield made()
                number += 1
            name, _, place = body.partition(" ")
            current = [name, place.strip(), []]
        elif current:
            rest = body.strip()
            if rest.startswith("/"):
                current[2].append(rest[1:])
            elif current[2]:
                current[2][-1] += " " + rest
            else:
                current[1] += rest
    if current:
        yield made()


class FlatReader(Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        with opened(path) as f:
            yield from ((path, *x) for x in flat_features(f, self.options.get("kind", "embl")))


class FlatFile(DataSource):
    """Option kind: embl, genbank or sqmonk."""

    @classmethod
    def name(cls) -> str:
        return "flatfile"

    def schema(self) -> str:
        return "path string, chrom string, feat_no bigint, type string, id string, strand string, start int, end int, segments array<struct<start:int,end:int,strand:string>>, quals map<string,array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return FlatReader(self.options)


def parsed(files: DataFrame, kind: str, unplaced: bool = False) -> DataFrame:
    """Rows of whole files (path, content) as spark.read.format("binaryFile") gives them, from any store that Spark reads.

    kind: fasta, nbrf, staden, gcg, molgen, raw; reads; bam; embl, genbank, sqmonk. Gzip is unpacked. A file is one row, so
    its size is bounded by what a row may hold; larger ones are read by the formats that register() adds.
    """
    flat = FlatFile.schema(None)
    schema = Bam.schema(None) if kind == "bam" else Reads.schema(None) if kind == "reads" else flat if kind in ("embl", "genbank", "sqmonk") else SeqFile.schema(None)

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
        if kind == "bam":
            return (r for r in bam_records(stream) if unplaced or r[2] != "*")
        lines = io.TextIOWrapper(stream, errors="replace")
        if kind == "reads":
            return ((path, i + 1, *r) for i, r in enumerate(reads(lines)))
        if kind in ("embl", "genbank", "sqmonk"):
            return ((path, *x) for x in flat_features(lines, kind))
        return ((path, i, name, seq) for i, (name, seq) in enumerate(sequences(lines, kind)))

    names = [f.name for f in StructType.fromDDL(schema).fields]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for row in rows(path, content):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _batch(held, names, kinds)
                        held = []
                if held:
                    yield _batch(held, names, kinds)

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    def plain(v):
        if isinstance(v, dict):
            return list(v.items())
        return [dict(zip(("start", "end", "strand"), x, strict=True)) for x in v] if isinstance(v, list) and v and isinstance(v[0], tuple) else v

    return pa.RecordBatch.from_arrays([pa.array([plain(v) for v in column], schema.field(i).type) for i, column in enumerate(zip(*rows, strict=True))], names=names)


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (SeqFile, Reads, Bam, FlatFile):
        spark.dataSource.register(source)

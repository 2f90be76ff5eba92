"""Block-compressed variant files as a Spark data source.

A block-compressed file is a chain of small gzip members whose headers give their
sizes, so a task can begin at any of them.  A record's place is its virtual offset
(the member's place in the file, shifted by 16 bits, and the place inside the
member); it also serves as the file order.  The source cuts a file in ranges:

* with regions and an index beside the file (``.tbi`` or ``.csi``): the ranges of
  members that the index names for the regions, nothing else is read;
* otherwise: equal byte ranges, where a task finds the first member of its range
  and reads the line that its last member leaves open to its end.  Binary records
  have no mark to begin at, so those files are cut where their index says that
  records begin, and are one range without an index.

Variant text gives lines; binary variants (``.bcf``) are decoded to the same
records as text, so that all that follows is alike.

Places of files are local paths, ``file:`` URIs, or URIs of the stores that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes that one task reads at most (a member more, to end a line).
RANGE_BYTES = 32 << 20
#: Lines or records, and their bytes, in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: The end of places in a file.
END = 1 << 63

# fixed values: how a member with extra fields begins, and its largest size
MEMBER = b"\x1f\x8b\x08\x04"
MOST_MEMBER = 1 << 16
TABIX, COORDINATE, BINARY = b"TBI\1", b"CSI\1", b"BCF\2\2"

Region = tuple[str, int, int]


class FormatError(ValueError):
    """A file that is not of the expected binary form."""


# ---------------------------------------------------------------- files


def open_file(path: str) -> BinaryIO:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://?", path)
    if not scheme or scheme[1] == "file":
        return open(re.sub("^file:(//)?", "", path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def file_size(f: BinaryIO) -> int:
    f.seek(0, os.SEEK_END)
    return f.tell()


def member_size(raw: bytes, at: int = 0) -> int | None:
    """Size of the compressed member whose header stands at ``at``, else None."""
    if len(raw) - at < 18 or raw[at : at + 4] != MEMBER:
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(raw)):
        tag, n = raw[i : i + 2], struct.unpack_from("<H", raw, i + 2)[0]
        if tag == b"BC" and n == 2 and i + 6 <= len(raw):
            return struct.unpack_from("<H", raw, i + 4)[0] + 1
        i += 4 + n
    return None


def is_block_compressed(path: str) -> bool:
    """Whether a file can be opened here and begins with a member of known size."""
    try:
        with open_file(path) as f:
            return member_size(f.read(256)) is not None
    except (OSError, ValueError, ImportError):
        return False


class Members:
    """Decompressed members from a place on: (place, contents) one after the other."""

    def __init__(self, f: BinaryIO, at: int):
        self.f, self.at = f, at
        self.read_bytes = 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        buffer, base = b"", self.at
        while True:
            i = self.at - base
            if len(buffer) - i < MOST_MEMBER + 64:
                self.f.seek(base + len(buffer))
                more = self.f.read(1 << 18)
                self.read_bytes += len(more)
                buffer, base, i = buffer[i:] + more, self.at, 0
            if i >= len(buffer):
                return
            size = member_size(buffer, i)
            if size is None or i + size > len(buffer):
                raise FormatError(f"no whole compressed member at byte {self.at}")
            extra = struct.unpack_from("<H", buffer, i + 10)[0]
            yield self.at, zlib.decompress(buffer[i + 12 + extra : i + size - 8], -15)
            self.at += size


def first_member(f: BinaryIO, at: int, size: int) -> int:
    """The place of the first member at or after a byte; ``size`` if there is none.

    Compressed bytes can look like a header by chance, so what follows it must be
    a header too, or the end of the file.
    """
    if at == 0:
        return 0
    f.seek(at)
    raw = f.read(3 * MOST_MEMBER)
    i = raw.find(MEMBER)
    while i >= 0:
        n = member_size(raw, i)
        if n is not None and (at + i + n == size or (i + n < len(raw) and member_size(raw, i + n) is not None)):
            return at + i
        i = raw.find(MEMBER, i + 1)
    return size


# ---------------------------------------------------------------- index


@dataclass
class Index:
    """Chunks of virtual offsets by reference and bin."""

    shift: int
    depth: int
    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    #: the first place of records that overlap a window, or of a bin
    linear: list[list[int]]
    lowest: list[dict[int, int]]

    def starts(self) -> list[int]:
        """Places where records begin, in order."""
        return sorted({a for bins in self.bins for chunks in bins.values() for a, _ in chunks} | {a for windows in self.linear for a in windows if a})

    def chunks(self, ref: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records at places start to stop (from one)."""
        if ref >= len(self.bins):
            return []
        first, last = start - 1, min(stop, 1 << (self.shift + 3 * self.depth)) - 1
        if last < first:
            return []
        bins, wanted = self.bins[ref], []
        for level in range(self.depth + 1):
            base, width = ((1 << 3 * level) - 1) // 7, self.shift + 3 * (self.depth - level)
            low, high = base + (first >> width), base + (last >> width)
            wanted += [b for b in bins if low <= b <= high] if high - low > len(bins) else [b for b in range(low, high + 1) if b in bins]
        least = 0
        if self.linear[ref]:
            windows = self.linear[ref]
            least = windows[min(first >> self.shift, len(windows) - 1)]
        else:
            b = ((1 << 3 * self.depth) - 1) // 7 + (first >> self.shift)
            while b and b not in self.lowest[ref]:
                b = (b - 1) >> 3
            least = self.lowest[ref].get(b, 0)
        return merged([(max(a, least), z) for b in wanted for a, z in bins[b] if z > least])


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def read_index(path: str, names: list[str] | None = None) -> Index | None:
    """The index beside a file, or None; ``names`` are those of the file's header."""
    for suffix in (".tbi", ".csi"):
        try:
            with open_file(path + suffix) as f:
                raw = b"".join(part for _, part in Members(f, 0))
        except OSError:
            continue
        return parse_index(raw, names)
    return None


def parse_index(raw: bytes, names: list[str] | None) -> Index:
    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return got

    def listed(aux: bytes) -> list[str]:
        return [n.decode() for n in aux.split(b"\0")[:-1]]

    tabix = raw[:4] == TABIX
    if tabix:
        shift, depth = 14, 5
        refs, *_, size = take("8i")
        names = listed(raw[at : at + size])
        at += size
    elif raw[:4] == COORDINATE:
        shift, depth, size = take("3i")
        if size > 28:  # as for text: six numbers, the names' size, the names
            names = listed(raw[at + 28 : at + size])
        at += size
        (refs,) = take("i")
    else:
        raise FormatError("not an index of a known kind")
    summary = ((1 << 3 * (depth + 1)) - 1) // 7 + 1  # a bin of counts, without chunks of records
    out = Index(shift, depth, names or [], [], [], [])
    for _ in range(refs):
        bins, lowest = {}, {}
        for _ in range(take("i")[0]):
            (number,) = take("I")
            low = 0 if tabix else take("Q")[0]
            (n,) = take("i")
            places = take(f"{2 * n}Q")
            if number != summary:
                bins[number], lowest[number] = list(zip(places[0::2], places[1::2], strict=True)), low
        out.bins.append(bins)
        out.lowest.append(lowest)
        out.linear.append(list(take(f"{take('i')[0]}Q")) if tabix else [])
    return out


# ---------------------------------------------------------------- headers


@dataclass
class Header:
    """What a file says before its records, and where these begin."""

    samples: list[str]
    contigs: list[str]
    #: names of INFO, FORMAT and FILTER entries by number, for binary files
    strings: list[str]
    start: int


def _numbered(lines: list[str], kinds: tuple[str, ...], first: list[str]) -> list[str]:
    """Names by number: by their IDX, else in the order in which they stand."""
    out = dict(enumerate(first))
    for line in lines:
        m = re.match(rf"##(?:{'|'.join(kinds)})=<(?:.*?[,<])??ID=([^,>]+)", line)
        if not m or m[1] in out.values():
            continue
        number = re.search(r"[,<]IDX=(\d+)", line)
        out[int(number[1]) if number else max(out, default=-1) + 1] = m[1]
    return [out.get(i, f"{i}") for i in range(max(out, default=-1) + 1)]


def read_head(path: str) -> Header:
    """The header of a block-compressed file, text or binary."""
    with open_file(path) as f:
        text, wanted = b"", None
        inside: list[tuple[int, int]] = []  # bytes before each member, its place
        for place, part in Members(f, 0):
            inside.append((len(text), place))
            text += part
            if wanted is None and len(text) >= 9:
                wanted = 9 + struct.unpack_from("<I", text, 5)[0] if text[:5] == BINARY else 0
            if wanted:
                if len(text) >= wanted:
                    end = wanted
                    break
            else:
                m = re.search(rb"^#CHROM[^\n]*\n", text, re.MULTILINE)
                if m:
                    end = m.end()
                    break
        else:
            if wanted or not (m := re.search(rb"^#CHROM[^\n]*\Z", text, re.MULTILINE)):
                raise FormatError(f"{path}: no #CHROM header")
            end = m.end()
        before, place = max(x for x in inside if x[0] <= end)
        start = (place << 16) + end - before
        if end - before >= MOST_MEMBER:  # behind a full member: the next one's first byte
            f.seek(place)
            start = (place + (member_size(f.read(MOST_MEMBER)) or 0)) << 16
    head = (text[9:end].rstrip(b"\0") if wanted else text[:end]).decode("utf-8", "replace")
    lines = head.splitlines()
    last = next((line for line in lines if line.startswith("#CHROM")), None)
    if last is None:
        raise FormatError(f"{path}: no #CHROM header")
    return Header(last.split("\t")[9:], _numbered(lines, ("contig",), []), _numbered(lines, ("INFO", "FORMAT", "FILTER"), ["PASS"]), start)


# ---------------------------------------------------------------- binary records

# fixed values: sizes, forms, and the missing and closing values of typed entries
TYPES = {1: "i1", 2: "<i2", 3: "<i4", 5: "<f4", 7: "S1"}
MISSING = {1: -0x80, 2: -0x8000, 3: -0x80000000}
FLOAT_MISSING, FLOAT_CLOSED = 0x7F800001, 0x7F800002


class Record:
    """Reads typed entries one after the other."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def kind(self) -> tuple[int, int]:
        """(number of values, type)."""
        b = self.raw[self.at]
        self.at += 1
        n = b >> 4
        if n == 15:
            n = int(self.values(*self.kind())[0])
        return n, b & 15

    def values(self, n: int, kind: int) -> np.ndarray:
        if kind == 0:
            return np.zeros(0, np.int8)
        if kind not in TYPES:
            raise FormatError(f"an entry of unknown type {kind}")
        out = np.frombuffer(self.raw, TYPES[kind], n, self.at)
        self.at += out.nbytes
        return out

    def string(self) -> str:
        n, kind = self.kind()
        return self.values(n, kind).tobytes().rstrip(b"\0").decode("utf-8", "replace")

    def number(self) -> int:
        return int(self.values(*self.kind())[0])


def shown(values: np.ndarray, kind: int) -> str:
    """Values of one entry as text: commas between them, a dot for a missing one."""
    if kind == 7:
        return values.tobytes().split(b"\0")[0].decode("utf-8", "replace") or "."
    if kind == 5:
        bits = values.view("<u4")
        kept = values[bits != FLOAT_CLOSED]
        return ",".join("." if b == FLOAT_MISSING else f"{v:.6g}" for v, b in zip(kept.tolist(), kept.view("<u4").tolist(), strict=True)) or "."
    if kind not in MISSING:
        return "."
    low = MISSING[kind]
    return ",".join("." if v == low else str(v) for v in values.tolist() if v != low + 1) or "."


def genotype(values: np.ndarray, kind: int) -> str:
    """Alleles with what joins them; the low bit of an allele tells that it is phased."""
    closed = MISSING[kind] + 1
    own = [v for v in values.tolist() if v != closed]
    named = ["." if v >> 1 == 0 or v == closed - 1 else str((v >> 1) - 1) for v in own]
    return "".join(("|" if v & 1 else "/") * (i > 0) + a for i, (v, a) in enumerate(zip(own, named, strict=True))) or "."


def _cells(form: str, n: int, kind: int, raw: np.ndarray, samples: int) -> np.ndarray:
    """One FORMAT entry as text of all samples: each distinct value is written once."""
    if n == 0:
        return np.full(samples, ".", object)
    whole = np.ascontiguousarray(raw.reshape(samples, n))
    rows = whole.view(np.dtype((np.void, whole.dtype.itemsize * n))).ravel()
    distinct, where = np.unique(rows, return_inverse=True)
    one = genotype if form == "GT" and kind in MISSING else shown
    text = np.array([one(np.frombuffer(d.tobytes(), whole.dtype), kind) for d in distinct], object)
    return text[where]


def decode(shared: bytes, own: bytes, header: Header) -> tuple:
    """(chrom, pos, vid, ref, alts, info, fmt, cells) of a binary record."""
    chrom, pos, _, _, counts, sized = struct.unpack_from("<iiifII", shared)
    alleles, infos, forms, samples = counts >> 16, counts & 0xFFFF, sized >> 24, sized & 0xFFFFFF
    r = Record(shared)
    r.at = 24
    vid = r.string() or "."
    named = [r.string() for _ in range(alleles)]
    r.values(*r.kind())  # filters
    info = []
    for _ in range(infos):
        key = header.strings[r.number()]
        n, kind = r.kind()
        info.append(f"{key}={shown(r.values(n, kind), kind)}" if n and kind else key)
    r = Record(own)
    names, columns = [], []
    for _ in range(forms):
        names.append(header.strings[r.number()])
        n, kind = r.kind()
        columns.append(_cells(names[-1], n, kind, r.values(n * samples, kind), samples))
    cells = columns[0] if len(columns) == 1 else [":".join(c) for c in zip(*columns, strict=True)]
    return header.contigs[chrom], pos + 1, vid, named[0] if named else ".", named[1:] or ["."], ";".join(info) or ".", ":".join(names), list(cells)


# ---------------------------------------------------------------- ranges


@dataclass
class Range(InputPartition):
    """Virtual offsets [start, stop): a record belongs to the range it begins in.

    ``start`` may be any byte of the file where ``found`` is set: the range then
    begins at the first member from there on, behind the first line end.  A range
    that such a one follows (``open_end``) has the line that begins right at that
    member.
    """

    start: int
    stop: int
    found: bool = False
    open_end: bool = False


def _cut(start: int, stop: int, places: list[int], found: bool) -> list[Range]:
    """[start, stop) cut at some places: found by bytes, or where records begin."""
    ends = [start, *places, stop]
    return [Range(a, z, found and i > 0, found and i < len(places)) for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False))]


def _apart(places: list[int], start: int, stop: int, most: int) -> list[int]:
    """Those of sorted places inside a range that are ``most`` compressed bytes apart."""
    out, last = [], start
    for p in places:
        if start < p < stop and (p >> 16) - (last >> 16) >= most:
            out.append(p)
            last = p
    return out


def plan(path: str, header: Header, binary: bool, regions: list[Region] | None, most: int = RANGE_BYTES) -> list[Range]:
    """The ranges to read: those that the index names for the regions, or all of the file."""
    index = read_index(path, header.contigs) if binary or regions is not None else None
    chunks = [(header.start, END)]
    if regions is not None and index is not None:
        names = {n: i for i, n in enumerate(index.names)}
        chunks = merged([c for chrom, start, stop in regions if chrom in names for c in index.chunks(names[chrom], start, stop)])
    if binary:
        starts = index.starts() if index is not None else []
        return [r for a, z in chunks for r in _cut(a, z, _apart(starts, a, z, most), False)]
    with open_file(path) as f:
        size = file_size(f)
    return [r for a, z in chunks for r in _cut(a, z, [p << 16 for p in range((a >> 16) + most, min(z >> 16, size), most)], True)]


def lines(f: BinaryIO, r: Range, size: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that begin in a range."""
    start = first_member(f, r.start >> 16, size) << 16 if r.found else r.start
    skip = r.found  # the first line belongs to the range before
    low, at, pending, beyond = start & 0xFFFF, None, [], None
    for place, part in Members(f, start >> 16):
        here = place << 16
        if beyond is None and here >= r.stop:
            beyond = place  # the member at which the next range begins
        while low < len(part):
            if at is None:
                at = here + low
                if at >= r.stop and not (r.open_end and low == 0 and place == beyond):
                    return
            end = part.find(b"\n", low)
            if end < 0:
                pending.append(part[low:])
                break
            pending.append(part[low:end])
            if not skip:
                yield at, b"".join(pending)
            at, pending, skip, low = None, [], False, end + 1
        if at is None and here + low >= r.stop and not r.open_end:
            return  # nothing of the next member is needed
        low = 0
    if pending and not skip:
        yield at, b"".join(pending)


class Bytes:
    """Decompressed bytes from a virtual offset on, with the place of each read."""

    def __init__(self, f: BinaryIO, start: int):
        self.members, self.skip = iter(Members(f, start >> 16)), start & 0xFFFF
        self.part, self.at, self.place = b"", 0, start >> 16

    def offset(self) -> int | None:
        """The virtual offset of the next byte; None at the end."""
        while self.at >= len(self.part):
            got = next(self.members, None)
            if got is None:
                return None
            (self.place, self.part), self.at, self.skip = got, self.skip, 0
        return (self.place << 16) + self.at

    def take(self, n: int) -> bytes:
        out = []
        while n and self.offset() is not None:
            out.append(self.part[self.at : self.at + n])
            self.at += len(out[-1])
            n -= len(out[-1])
        if n:
            raise FormatError("a record ends before its size")
        return b"".join(out)


def binary_records(f: BinaryIO, r: Range, header: Header) -> Iterator[tuple]:
    """(ord, ...) of the binary records that begin in a range."""
    source = Bytes(f, r.start)
    while (at := source.offset()) is not None and at < r.stop:
        shared, own = struct.unpack("<II", source.take(8))
        yield at, *decode(source.take(shared), source.take(own), header)


# ---------------------------------------------------------------- data source

LINES = "ord long, line string"
RECORDS = "ord long, chrom string, pos long, vid string, ref string, alts array<string>, info string, fmt string, cells array<string>"
_RECORDS = pa.schema([
    ("ord", pa.int64()), ("chrom", pa.string()), ("pos", pa.int64()), ("vid", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())),
    ("info", pa.string()), ("fmt", pa.string()), ("cells", pa.list_(pa.string())),
])
_LINES = pa.schema([("ord", pa.int64()), ("line", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded by rows and by bytes."""
    out: list[tuple] = []
    total = 0
    for row in rows:
        out.append(row)
        total += size(row)
        if len(out) >= BATCH_ROWS or total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, total = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, regions: list[Region] | None, binary: bool, most: int):
        self.path, self.regions, self.binary, self.most = path, regions, binary, most
        self.header = read_head(path)

    def partitions(self) -> list[Range]:
        return plan(self.path, self.header, self.binary, self.regions, self.most) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        with open_file(self.path) as f:
            if self.binary:
                yield from _batches(binary_records(f, partition, self.header), _RECORDS, lambda row: sum(map(len, row[8])) + len(row[6]))
            else:
                text = ((at, line.rstrip(b"\r").decode("utf-8", "replace")) for at, line in lines(f, partition, file_size(f)))
                yield from _batches(text, _LINES, lambda row: len(row[1]))


class BlockSource(DataSource):
    """``format("variant_blocks")``: options path, binary, regions (JSON), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "variant_blocks"

    def schema(self) -> str:
        return RECORDS if self.options.get("binary") == "true" else LINES

    def reader(self, schema) -> BlockReader:
        given = json.loads(self.options.get("regions", "null"))
        regions = None if given is None else [(c, int(a), int(z)) for c, a, z in given]
        return BlockReader(self.options["path"], regions, self.options.get("binary") == "true", int(self.options.get("range_bytes", RANGE_BYTES)))


def read(spark: SparkSession, path: str, binary: bool, regions: list[Region] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines (ord, line), or binary records, of a file or of what its index names."""
    spark.dataSource.register(BlockSource)
    source = spark.read.format("variant_blocks").option("path", path).option("binary", str(binary).lower()).option("range_bytes", str(range_bytes))
    if regions is not None:
        source = source.option("regions", json.dumps(regions))
    return source.load()

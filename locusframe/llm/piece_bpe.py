"""SentencePiece encoding and decoding with offsets into the original bytes.

The text is normalised by the longest prefixes that the model's compiled
character map knows, and every byte of the normalised text keeps the place of
the original byte that it came from.  The normalised text is cut where no piece
of the vocabulary can reach across (a space symbol after any other sign), the
fragments are merged alone, and each piece is projected through the kept places
to its span of original bytes.

The file is read directly; pieces are merged here.  Models of type BPE with byte
fallback are read; others, and those with user-defined or unused pieces, raise
``ValueError`` when a row is encoded.

Defined results: a null text counts as empty (no ids, empty decoded text); ids
pass through, be they null, repeated or strings; repeated rows give repeated
results; other columns are never read; an empty table gives an empty table.
Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import as_before, as_text, bounded_batches, release_memory

CACHE_ENTRIES = 300_000
CACHED_LENGTH = 64
#: Fragments of more symbols are merged with a heap.
HEAP_LENGTH = 200
#: Signs before this one take at most two bytes.
WIDE = "\u0800"

# fixed values: the sign that stands for a space, and the one for broken bytes
SPACE, BROKEN = "▁", "�"
# fixed values: kinds of pieces and of models in a model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def records(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the protocol-buffer wire format."""
    at, end = 0, len(raw)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < end:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double-array trie and the replacements.

    The blob is the trie's size in bytes (little-endian, 32 bits), the trie's
    32-bit units, and the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units: list[int] = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        #: first bytes of any key: all others stand for themselves
        self.first = {b for b in range(256) if self.units and self._step(self._offset(self.units[0]), b)[0] is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, node: int, byte: int) -> tuple[int | None, int]:
        """(the node behind a byte or None, the unit that led there)."""
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0x80000000
        if unit & 0x800000FF != byte:
            return None, unit
        return at ^ self._offset(unit), unit

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes read) of the longest key that starts at ``at``."""
        node: int | None = self._offset(self.units[0])
        found = None
        for i in range(at, len(text)):
            node, unit = self._step(node, text[i])
            if node is None:
                break
            if unit & 0x100:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, n = found
        return self.replacements[start : self.replacements.index(b"\0", start)], n


class Normalizer:
    """A model's normalisation, with the original place of every byte of it."""

    def __init__(self, spec: bytes):
        got = dict(records(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.dummy_prefix = bool(got.get(3, 1))
        self.remove_extra = bool(got.get(4, 1))
        self.symbol = (SPACE if got.get(5, 1) else " ").encode()

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, original byte of each of its bytes and of its end)."""
        raw = text.encode("utf-8")
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.map.first or self.remove_extra:
            return self._mapped(raw)
        # only spaces change: each becomes the symbol, and all else stays
        wide = np.ones(len(raw), np.int64)
        wide[np.frombuffer(raw, np.uint8) == 0x20] = len(self.symbol)
        plain = np.frombuffer(raw, np.uint8)
        starts = np.arange(len(raw))
        starts[(plain & 0xC0) == 0x80] = 0
        starts = np.maximum.accumulate(starts)  # inside a character: its start
        before = len(self.symbol) if self.dummy_prefix else 0
        places = np.concatenate([np.zeros(before, np.int64), np.repeat(starts, wide), [len(raw)]])
        symbol = self.symbol.decode()
        return symbol * self.dummy_prefix + text.replace(" ", symbol), places

    def _prefixes(self, raw: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, place, bytes read) of one prefix after the other."""
        at, first = 0, self.map.first
        while at < len(raw):
            got = self.map.longest(raw, at) if raw[at] in first else None
            if got is None:
                end = at + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                got = raw[at:end], end - at
            yield got[0], at, got[1]
            at += got[1]

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        out, places, symbol = bytearray(), [], self.symbol
        started = not self.remove_extra
        if self.remove_extra:
            lead = 0
            for new, at, n in self._prefixes(raw):
                if new != b" ":
                    break
                lead = at + n
            if lead == len(raw):
                return "", np.zeros(1, np.int64)
        else:
            lead = 0
        if self.dummy_prefix:
            out += symbol
            places += [lead] * len(symbol)
        after_space = not started
        for new, at, n in self._prefixes(raw[lead:]):
            if after_space:
                new = new.lstrip(b" ")
            for b in new:
                add = symbol if b == 0x20 else bytes([b])
                out += add
                places += [lead + at] * len(add)
            if new:
                after_space = self.remove_extra and new.endswith(b" ")
        end = len(raw)
        while self.remove_extra and out.endswith(symbol):
            end = places[len(out) - len(symbol)]
            del out[-len(symbol) :], places[-len(symbol) :]
        return out.decode("utf-8", "replace"), np.array([*places, end], np.int64)


class PieceBPE:
    """Encoder and decoder over a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(records(f.read()))
        entries = [dict(records(v)) for k, v in fields if k == 1]
        trainer = dict(records(next((v for k, v in fields if k == 2), b"")))
        spec = next((v for k, v in fields if k == 3), b"")
        kinds = [e.get(3, NORMAL) for e in entries]
        if trainer.get(3, 1) != BPE_MODEL or not trainer.get(35, 0):
            raise ValueError("the model is not a BPE model with byte fallback")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("the model has user-defined or unused pieces")
        self.normalize = Normalizer(spec)
        names = [e[1].decode("utf-8") for e in entries]
        self.ids = {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
        self.bytes_at = [i for i, k in enumerate(kinds) if k == BYTE]
        at_byte = {int(names[i][3:5], 16): i for i in self.bytes_at}
        self.byte_ids = [at_byte[b] for b in range(256)]
        scores = {p: struct.unpack("<f", entries[i].get(2, b"\0\0\0\0"))[0] for p, i in self.ids.items()}
        places = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: the merge order: a smaller rank goes first, equal ranks from the left
        self.rank = {p: places[s] for p, s in scores.items()}
        self.never = len(places)
        #: whether every space symbol after another sign is a certain cut
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.space_id = [p.startswith(SPACE) for p in names]
        lone = " ⁇ ".encode() if 44 not in trainer else trainer[44]
        #: what an id reads as; single bytes for byte pieces
        self.surface = [lone if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(names, kinds, strict=True)]
        self.controls = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.is_byte = [k == BYTE for k in kinds]
        #: bytes that a piece takes of the normalised text
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(names, kinds, strict=True)], np.int64)
        self.decimal = [str(i) for i in range(len(names))]
        self.packed = [struct.pack("<I", i) for i in range(len(names))]
        self.cache: dict[str, bytes] = {}
        self.fast, self.of_fast = self._fast_merger()

    def _fast_merger(self):
        """(merger of short fragments, packed id of each of its tokens), or None.

        It starts from bytes, so it serves fragments of signs of one or two
        bytes: the two bytes of a sign are its first merges, and then follow the
        pieces in their order.  A sign without a piece stays in bytes, which is
        the byte fallback.  Pieces of equal rank (runs of space symbols) have no
        part in it.
        """
        try:
            import tiktoken
        except ImportError:
            return None, []
        short = sorted((r, p) for p, r in self.rank.items() if len(p) > 1 and (q := p.replace(SPACE, " ", 1)) and max(q) < WIDE)
        tokens = [bytes([b]) for b in range(256)] + [p.encode() for p in self.ids if len(p) == 1 and "\x80" <= p < WIDE]
        of = [self.packed[self.ids.get(SPACE if b == 0x20 else chr(b), self.byte_ids[b]) if b < 128 else self.byte_ids[b]] for b in range(256)]
        of += [self.packed[self.ids[t.decode()]] for t in tokens[256:]]
        tokens += [p.replace(SPACE, " ").encode() for _, p in short]
        of += [self.packed[self.ids[p]] for _, p in short]
        if len({r for r, _ in short}) < len(short) or len(set(tokens)) < len(tokens) or SPACE not in self.ids or self.normalize.symbol != SPACE.encode():
            return None, []
        return tiktoken.Encoding("fragments", pat_str="(?s).+", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={}), of

    # ------------------------------------------------------------ encoding

    def fragments(self, normal: str) -> list[str]:
        """The normalised text between its certain cuts."""
        if not self.cuts:
            return [normal]
        parts = normal.split(SPACE)
        if "" not in parts[1:]:
            return [SPACE + p for p in parts[1:]] if not parts[0] else [parts[0], *[SPACE + p for p in parts[1:]]]
        out, run = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            run += SPACE
            if p:
                out.append(run + p)
                run = ""
        return [*out, run] if run else out

    def _merged(self, fragment: str) -> list[str]:
        """Pieces of a fragment: the best-ranked neighbours merge, leftmost first."""
        parts = list(fragment)
        if len(parts) > HEAP_LENGTH:
            return self._merged_long(parts)
        get, never = self.rank.get, self.never
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], never)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def _packed(self, fragment: str) -> bytes:
        """Ids of a fragment, packed."""
        # a fragment that is a piece may still merge otherwise: not by the merger
        if self.fast is not None and len(fragment) <= HEAP_LENGTH and fragment not in self.ids:
            bare = fragment.replace(SPACE, " ", 1)
            if bare.isascii() or max(bare) < WIDE:
                return b"".join(map(self.of_fast.__getitem__, self.fast.encode_ordinary(bare)))
        out = []
        for p in self._merged(fragment):
            i = self.ids.get(p)
            out += [self.packed[self.byte_ids[b]] for b in p.encode("utf-8")] if i is None else [self.packed[i]]
        return b"".join(out)

    def _encoded(self, fragment: str) -> bytes:
        packed = self._packed(fragment)
        if len(fragment) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[fragment] = packed
        return packed

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first original byte, end) of every piece of a text."""
        normal, places = self.normalize(text)
        get, miss = self.cache.get, self._encoded
        packed = b"".join([get(f) or miss(f) for f in self.fragments(normal)]) if normal else b""
        ids = np.frombuffer(packed, "<u4")
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.width[ids], out=bounds[1:])
        at = places[bounds]
        return ids, at[:-1], at[1:]

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put before it goes."""
        surface, start, head = self.surface, 0, b""
        if self.normalize.dummy_prefix or self.normalize.remove_extra:
            for start, i in enumerate(ids):  # noqa: B007
                if self.is_byte[i]:
                    break
                stripped = self.space_id[i]
                head = surface[i][1:] if stripped else surface[i]
                if head or (stripped and not self.normalize.remove_extra):
                    start += 1
                    break
            else:
                start = len(ids)
        rest = ids[start:]
        if self.controls.isdisjoint(rest):
            try:
                return head.decode() + b"".join(map(surface.__getitem__, rest)).decode("utf-8")
            except UnicodeDecodeError:
                pass
        return head.decode() + self._decode_broken(rest)

    def _decode_broken(self, ids: list[int]) -> str:
        """As above, where runs of byte pieces hold bytes that are no text, or
        control pieces, which end such runs, stand between them."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(BROKEN)
                    n = 1
                at += n
            run.clear()
            if i >= 0:
                out.append(self.surface[i].decode("utf-8"))
        return "".join(out)


_LOADED: dict[str, PieceBPE] = {}


def model(path: str) -> PieceBPE:
    """One per worker process while a task runs."""
    if path not in _LOADED:
        _LOADED[path] = PieceBPE(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_pieces: bool = True, keep_text: bool = True) -> DataFrame:
    """Per row: id, n_tokens, digests of ids, decoded text and spans, and them if kept.

    ``ids_sha256`` is over decimal ids joined by commas, ``spans_sha256`` over
    the first and end bytes of all pieces (little-endian, 32 bits, all firsts
    before all ends).  ``path`` is a model file that every executor can open.
    A narrow map: no shuffle, memory bounded by a batch and the fragment cache.
    """
    bounded_batches(df.sparkSession)
    kept = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>"} if keep_pieces else {}
    kept |= {"decoded": "string"} if keep_text else {}
    digests = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    extra = "".join(f", {name} {of}" for name, of in kept.items())
    schema = f"{id_col} string, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string{extra}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        try:
            for pdf in it:
                yield encoded(m, pdf)
        finally:
            _LOADED.clear()
            release_memory()

    def encoded(m: PieceBPE, pdf: pd.DataFrame) -> pd.DataFrame:
        cols: dict[str, list] = {c: [] for c in (*digests, "ids", "starts", "ends", "decoded")}
        for text in pdf[text_col]:
            ids, starts, ends = m.encode(text) if isinstance(text, str) else m.encode("")
            listed = ids.tolist()
            decoded = m.decode(listed)
            cols["n_tokens"].append(len(listed))
            cols["ids_sha256"].append(hashlib.sha256(",".join(map(m.decimal.__getitem__, listed)).encode()).hexdigest())
            cols["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            cols["spans_sha256"].append(hashlib.sha256(starts.astype("<u4").tobytes() + ends.astype("<u4").tobytes()).hexdigest())
            if keep_pieces:
                for name, values in (("ids", ids), ("starts", starts), ("ends", ends)):
                    cols[name].append(values.astype(np.int32))
            if keep_text:
                cols["decoded"].append(decoded)
        return pd.DataFrame({id_col: pdf[id_col]} | {c: cols[c] for c in (*digests, *kept)})

    return as_before(df.select(as_text(df, id_col), df[text_col]).mapInPandas(run, schema), df, id_col)

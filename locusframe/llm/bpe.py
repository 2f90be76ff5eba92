"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across,
so it marks a certain cut: what lies on either side may be encoded alone and
the ids concatenated.  Of all 65,536 pairs those are used that no token holds,
wherever the cut is also safe for the splitting pattern that runs before the
merges (``safe_cut``): the pattern must split, or go on, alike with and without
it.  Cuts before single spaces are found first, all others in what is longer
than ``WHOLE_LENGTH``.
Fragments repeat far more often than words, so each task keeps a bounded cache
of fragment -> packed ids and a text's ids are one join over its fragments.

Defined results: a null text counts as empty (no ids, empty decoded text);
repeated rows give repeated results; ids pass through, be they null, repeated or
strings; other columns are never read; an empty table gives an empty table.  Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import as_before, as_text, bounded_batches, release_memory

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
#: Fragments up to this length are merged as they are; longer ones are cut
#: inside words first.
WHOLE_LENGTH = 24
LATIN_END = "\u0250"

# fixed values: the public pattern of byte-level BPE that splits before merges
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def kind(c: str) -> str:
    """What the splitting pattern takes a character for: L, N, space or P."""
    return "S" if c.isspace() else k if (k := unicodedata.category(c)[0]) in "LN" else "P"


def safe_cut(c: str, d: str) -> bool:
    """Whether the splitting pattern finds the same pieces with a cut between c and d.

    Runs of letters, of digits, and of other signs may be cut anywhere, and the
    pattern itself splits where one kind follows another.  A space may belong to
    what follows it.  A quotation mark may begin a contraction: nothing is cut
    after it before a letter, and a run of signs is not cut before it.
    """
    before, after = kind(c), kind(d)
    if "S" in (before, after):
        return False
    if before == after:
        return before != "P" or d != "'"
    return not (c == "'" and after == "L")


class ForcedBoundaryBPE:
    """Encoder and decoder over a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        size = 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.pieces: list[bytes] = [b""] * size
        self.inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            b = bytes(alphabet[c] for c in token)
            self.pieces[i] = b
            a = np.frombuffer(b, np.uint8)
            self.inside[a[:-1], a[1:]] = True
        for a in spec["added_tokens"]:
            self.pieces[a["id"]] = a["content"].encode()
        special = [re.escape(a["content"]) for a in sorted(spec["added_tokens"], key=lambda a: -len(a["content"]))]
        self.special_ids = {a["content"]: np.uint32(a["id"]).tobytes() for a in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        # bytes that some token holds before a space: no certain cut after them
        self.held = [bytes([b]) for b in range(256) if b != 0x20 and self.inside[b, 0x20]]
        self.cache: dict[str, bytes] = {}
        self.merger = self._merger(spec, alphabet)

    def _merger(self, spec: dict, alphabet: dict[str, int]):
        """A faster merger for short fragments, where ids are the merge order."""
        try:
            import tiktoken
        except ImportError:
            return None
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab["".join(m)] != 256 + i for i, m in enumerate(pairs)):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("fragments", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _library(self, fragment: str) -> bytes:
        if self.merger is not None and max(fragment) < LATIN_END:
            return np.array(self.merger.encode_ordinary(fragment), "<u4").tobytes()
        return np.array(self.tok.encode(fragment, add_special_tokens=False).ids, "<u4").tobytes()

    def _fragment(self, unit: str) -> bytes:
        """Ids of a unit, by its certain cuts."""
        cache = self.cache
        out = []
        for part in self.fragments(unit) if len(unit) > WHOLE_LENGTH else [unit]:
            got = cache.get(part)
            if got is None:
                got = self._library(part)
                if len(part) <= CACHED_LENGTH:
                    cache[part] = got
            out.append(got)
        whole = b"".join(out)
        if len(unit) <= CACHED_LENGTH:
            cache[unit] = whole
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return whole

    def fragments(self, unit: str) -> list[str]:
        """A unit's pieces between all of its certain cuts."""
        chars = [c.encode("utf-8", "replace") for c in unit]
        last = np.frombuffer(b"".join(c[-1:] for c in chars), np.uint8)
        first = np.frombuffer(b"".join(c[:1] for c in chars), np.uint8)
        never = np.flatnonzero(~self.inside[last[:-1], first[1:]]) + 1
        cuts = [0, *(i for i in never.tolist() if safe_cut(unit[i - 1], unit[i])), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def units(self, text: str) -> list[str]:
        """Fragments between certain cuts at spaces; their join is the text."""
        parts = text.split(" ")
        held = self.held and any(h + b" " in raw for raw in (text.encode("utf-8"),) for h in self.held)
        if not held and "" not in parts and not any(p[0].isspace() for p in parts):
            return [parts[0], *[" " + p for p in parts[1:]]]
        # no cut inside a run of white space that a space is part of
        units = [parts[0]]
        before = parts[0]
        for p in parts[1:]:
            if before == "" or p == "" or p[0].isspace() or before[-1].encode("utf-8", "replace")[-1:] in self.held:
                units[-1] += " " + p
            else:
                units.append(" " + p)
            before = p
        return [u for u in units if u]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is not None and self.special.search(text):
            return b"".join(
                self.special_ids[p] if p in self.special_ids else self.encode_packed(p) for p in self.special.split(text) if p
            )
        get, miss = self.cache.get, self._fragment
        return b"".join([get(u) or miss(u) for u in self.units(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One per worker process while a task runs."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Per row: id, n_tokens, digests of ids and decoded text, and both if kept.

    ``path`` is a tokenizers file that every executor can open.  A narrow map:
    no shuffle, memory bounded by a batch and the fragment cache.
    """
    bounded_batches(df.sparkSession)
    kept = {"ids": "array<int>"} if keep_ids else {}
    kept |= {"decoded": "string"} if keep_text else {}
    extra = "".join(f", {name} {of}" for name, of in kept.items())
    schema = f"{id_col} string, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        try:
            yield from encoded(bpe, it)
        finally:
            _LOADED.clear()
            release_memory()

    def encoded(bpe: ForcedBoundaryBPE, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            cols: dict[str, list] = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in pdf[text_col]:
                packed = bpe.encode_packed(text) if isinstance(text, str) else b""
                ids = np.frombuffer(packed, "<i4")
                decoded = bpe.decode(ids.tolist())
                cols["n_tokens"].append(len(ids))
                cols["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    cols["ids"].append(ids)
                if keep_text:
                    cols["decoded"].append(decoded)
            yield pd.DataFrame({id_col: pdf[id_col]} | {c: cols[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256", *kept)})

    return as_before(df.select(as_text(df, id_col), df[text_col]).mapInPandas(run, schema), df, id_col)

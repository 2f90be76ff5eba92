"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

A document is contaminated by an item if some stretch of its words lies within
``floor((1 - similarity) * n)`` word edits of the item's n words.

1. Words are lower-cased runs of letters, digits and non-ASCII characters.
2. Seeds: within k edits of n words some run of ceil((n - k) / (k + 1)) words
   stays whole, so only places that share such a run (at most four words are asked
   for) with an item can match.  Each edit breaks at most q of the item's runs of
   q words, so a match keeps n - q + 1 - k q of them at starts within k of its
   own; places with fewer are dropped, and the rest join to stretches that hold
   every match whole.  This drops nothing that the edit check would accept.
3. CGK: a window is read by a pointer that stays or moves on by a random bit of
   the word under it; the 3n words read are the embedding, so that nearly every
   walk reads its window to the end, in which few edits
   are few differing places.  Each of ``tables`` hash tables samples ``bits``
   of those places, with a new walk after every few tables.
4. Stretches with a window that shares a key with the item in any table are
   checked first by the exact edit distance; the edits found there bound what
   another stretch of the text must keep to be the better match.  Stretches that
   the tables miss and that this bound leaves are all checked too.

So every match is found, with the least edits of the item to any stretch of the
text (the first such stretch), and ``tables`` and ``bits`` change the order of
the checks only.

Items are read in chunks of bounded bytes that travel with the tasks; texts are
read whole in one narrow pass per chunk, without a shuffle.

Defined results: null, empty or wordless texts and items match nothing;
repeated items and rows each give their own rows; rows and items without an id
cannot be named in a pair and give none; ids that are no integers raise
``TypeError``; other columns are ignored; with an empty table on either side the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, RollingHash, batches, bounded_batches, long_id, mix64, release_memory, word_bounds

SIMILARITY = 0.8
TABLES = 48
WALKS = 8
BITS = 4
CHUNK_BYTES = 16 << 20
MOST_RUN = 4
WINDOW_CHUNK = 20_000
SEED_CHUNK = 1 << 21

def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, first word of each text with a closing bound)."""
    raw = [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    hashes, counts = [], [np.zeros(1, np.int64)]
    for lo, hi in batches(raw, 1 << 18):  # small enough for the processor's cache
        buf, ws, we, n = word_bounds(raw[lo:hi])
        hashes.append(mix64(RollingHash(buf).of(ws, we) + (we - ws).astype(U64)) | U64(1))
        counts.append(n)
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.cumsum(np.concatenate(counts))


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def run_hashes(words: np.ndarray, q: int) -> np.ndarray:
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, q, U64)
    for i in range(q):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + words[i : n + i])
    return h


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits of all of ``item`` to any stretch of ``text``; where it ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist(), 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[:-1] + (text != U64(w)), row[1:] + 1)
        # insertions run along the row: a running minimum of value - place
        row = np.minimum.accumulate(nxt - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _pieces(text: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``SEED_CHUNK`` seeds each."""
    if not len(text):
        return
    cuts = np.append(np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))), len(text))
    total = np.concatenate(([0], np.cumsum(n)))
    x = 0
    while x < len(text):
        y = int(cuts[max(np.searchsorted(total[cuts], total[x] + SEED_CHUNK, "right") - 1, np.searchsorted(cuts, x, "right"))])
        yield x, y
        x = y


def _dense(rows: np.ndarray, size: np.ndarray, edits: np.ndarray, q: int) -> np.ndarray:
    """Seeds (sorted by text, item, start) that are one of at least n - q + 1 - k q
    seeds of their pair whose starts differ by at most 2k."""
    text, item, start = rows.T
    k = edits[item]
    need = np.maximum(size[item] - q + 1 - k * q, 1)
    pair = np.cumsum(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))) - 1 if len(rows) else text
    span = int(start.max(initial=0) - start.min(initial=0)) + 2 * int(edits.max(initial=0)) + 1
    at = pair * span + (start - start.min(initial=0))
    end = np.searchsorted(at, at + 2 * k, "right")
    ok = end - np.arange(len(rows)) >= need
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(ok), 1)
    np.subtract.at(cover, end[ok], 1)
    return np.cumsum(cover)[:-1] > 0


class Index:
    """The tables over one chunk of items."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float, tables: int, bits: int, seed: int = 11):
        self.similarity, self.tables, self.bits = similarity, tables, bits
        rng = np.random.default_rng(seed)
        words, bounds = words_of(texts)
        self.items = [(i, words[a:b]) for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a]
        self.most = max((len(w) for _, w in self.items), default=0)
        self.step_seed = rng.integers(1, 2**63, (WALKS, 3 * self.most + 1), dtype=np.int64).view(U64)
        self.where = rng.random((tables, bits))
        self.salt = rng.integers(1, 2**63, tables, dtype=np.int64).view(U64)
        # runs: hash -> (item, place); a bitmap answers most look-ups
        runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, w) in enumerate(self.items):
            e = allowed_edits(len(w), similarity)
            q = min(MOST_RUN, -(-(len(w) - e) // (e + 1)))
            h = run_hashes(w, q)
            runs.setdefault(q, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.runs = {}
        for q, parts in runs.items():
            h, item, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(h, kind="stable")
            size = 1 << max(16, int(np.ceil(np.log2(len(h) * 32 + 1))))
            bitmap = np.zeros(size, bool)
            bitmap[(h & U64(size - 1)).astype(np.int64)] = True
            self.runs[q] = (h[order], item[order], place[order], bitmap)
        if self.items:
            flat = np.concatenate([w for _, w in self.items])
            n = np.array([len(w) for _, w in self.items], np.int64)
            self.item_keys = self.keys(flat, np.cumsum(n) - n, n)

    def keys(self, words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The key of each window (words[start : start + n]) in each table."""
        most = int(n.max())
        padded = np.concatenate((words, np.zeros(most + 1, U64)))
        out = np.empty((len(n), self.tables), U64)
        per = -(-self.tables // WALKS)
        for walk in range(WALKS):
            own = range(walk * per, min(self.tables, (walk + 1) * per))
            if not len(own):
                break
            read = np.empty((3 * most + 1, len(n)), U64)
            at = np.zeros(len(n), np.int64)
            for j in range(3 * most + 1):
                sym = np.where(at < n, padded[start + np.minimum(at, n)], U64(0))
                read[j] = sym
                at += (mix64(sym + self.step_seed[walk, j]) >> U64(63)).astype(np.int64)
            for t in own:
                key = mix64(n.astype(U64) + self.salt[t])
                for b in range(self.bits):
                    place = (self.where[t, b] * 3 * n).astype(np.int64)
                    key = mix64(key * U64(0x100000001B3) + read[place, np.arange(len(n))])
                out[:, t] = key
        return out

    def seeds(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, item, start) of each run shared with an item, where enough runs
        stand near each other to hold a match."""
        found = []
        size = np.array([len(w) for _, w in self.items], np.int64)
        edits = ((1 - self.similarity) * size + 1e-9).astype(np.int64)
        for q, (h, item, place, bitmap) in self.runs.items():
            mine = run_hashes(words, q)
            hit = np.flatnonzero(bitmap[(mine & U64(len(bitmap) - 1)).astype(np.int64)])
            text = np.searchsorted(bounds, hit, "right") - 1
            hit = hit[hit + q <= bounds[text + 1]]
            lo, hi = np.searchsorted(h, mine[hit], "left"), np.searchsorted(h, mine[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(bounds, hit, "right") - 1
            for x, y in _pieces(text, n):
                some = n[x:y]
                pos, of = np.repeat(hit[x:y], some), np.repeat(text[x:y], some)
                at = np.repeat(lo[x:y], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                rows = np.stack((of, item[at], pos - place[at]), 1)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                found.append(np.unique(rows[_dense(rows, size, edits, q)], axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def stretches(self, seeds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item, first word, end) of what holds every match, and each seed's stretch."""
        if not len(seeds):
            return np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        text, item, start = seeds.T
        size = np.array([len(w) for _, w in self.items], np.int64)[item]
        edits = ((1 - self.similarity) * size + 1e-9).astype(np.int64)
        lo, hi = np.maximum(bounds[text], start - edits), np.minimum(bounds[text + 1], start + size + 2 * edits)
        # starts are sorted within a pair, so are both ends
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] >= hi[:-1])))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(seeds) - 1]))
        return np.stack((text[first], item[first], lo[first], hi[last]), 1), np.cumsum(new) - 1

    def near(self, words: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
        """Stretches with a window that shares a key with their item."""
        out = np.zeros(count, bool)
        if not len(seeds):
            return out
        size = np.array([len(w) for _, w in self.items], np.int64)[seeds[:, 1]]
        edits = ((1 - self.similarity) * size + 1e-9).astype(np.int64)
        found = []
        for d in range(-int(edits.max()), int(edits.max()) + 1):
            s = seeds[:, 2] + d
            ok = (abs(d) <= edits) & (s >= bounds[seeds[:, 0]]) & (s < bounds[seeds[:, 0] + 1])
            found.append(np.stack((seeds[ok, 0], s[ok], size[ok], seeds[ok, 1], of[ok]), 1))
        wins = np.unique(np.concatenate(found), axis=0)
        new = np.concatenate(([True], (wins[1:, :3] != wins[:-1, :3]).any(axis=1))) if len(wins) else np.zeros(0, bool)
        which, own = np.cumsum(new) - 1, wins[new, :3]
        for lo in range(0, len(own), WINDOW_CHUNK):
            text, start, n = own[lo : lo + WINDOW_CHUNK].T
            keys = self.keys_in(words, start, n, np.minimum(n, bounds[text + 1] - start))
            rows = np.arange(*np.searchsorted(which, (lo, lo + len(text))))
            item_keys = self.item_keys[wins[rows, 3]]
            out[wins[rows[(keys[which[rows] - lo] == item_keys).any(axis=1)], 4]] = True
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) of every match, the best of a pair."""
        words, bounds = words_of(texts)
        if not self.items or not len(words):
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seeds = self.seeds(words, bounds)
        parts, of = self.stretches(seeds, bounds)
        near = np.zeros(len(parts), bool)
        step = max(1, SEED_CHUNK // (2 * allowed_edits(self.most, self.similarity) + 1))
        for a in range(0, len(seeds), step):
            near |= self.near(words, bounds, seeds[a : a + step], of[a : a + step], len(parts))
        for x in np.argsort(~near, kind="stable").tolist():
            t, item, lo, hi = parts[x].tolist()
            w = self.items[item][1]
            k = best.get((t, item), (allowed_edits(len(w), self.similarity), 0))[0]
            if (t, item) in best and not self.may_reach(words, w, k, lo, hi):
                continue
            d, end = fit_distance(w, words[lo:hi])
            if d <= k and (d, lo + end) < best.get((t, item), (k + 1, 0)):
                best[(t, item)] = (d, lo + end)
        return [(t, item, d, max(end - len(self.items[item][1]), int(bounds[t])) - int(bounds[t])) for (t, item), (d, end) in sorted(best.items())]

    @staticmethod
    def may_reach(words: np.ndarray, item: np.ndarray, k: int, lo: int, hi: int) -> bool:
        """Whether a stretch holds enough of the item's words for k edits."""
        if hi - lo < len(item) - k:
            return False
        return int(np.isin(item, words[lo:hi]).sum()) >= len(item) - k

    def keys_in(self, words: np.ndarray, start: np.ndarray, n: np.ndarray, n_in: np.ndarray) -> np.ndarray:
        """Keys of windows that may reach past their text: the rest reads as nothing."""
        if (n == n_in).all():
            return self.keys(words, start, n)
        # cut windows get a copy of their words with an empty tail
        cut = np.flatnonzero(n != n_in)
        extra = [np.concatenate((words[s : s + m], np.zeros(k - m, U64))) for s, m, k in zip(start[cut].tolist(), n_in[cut].tolist(), n[cut].tolist(), strict=True)]
        at = start.copy()
        at[cut] = len(words) + np.concatenate(([0], np.cumsum(n[cut])[:-1]))
        return self.keys(np.concatenate((words, *extra)), at, n)


def _matches(ids: list[int], texts: list[str | None], similarity: float, tables: int, bits: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(ids, texts, similarity, tables, bits)
        try:
            for pdf in it:
                yield matched(index, pdf)
        finally:
            release_memory()

    def matched(index: Index, pdf: pd.DataFrame) -> pd.DataFrame:
        doc, text = pdf["doc"].to_numpy(), [t if isinstance(t, str) else None for t in pdf["text"]]
        sizes = [t.encode("utf-8", "replace") if t else b"" for t in text]
        out = []
        for a, b in batches(sizes, 1 << 22):
            out += [(doc[a + t], index.items[i][0], d, s, len(index.items[i][1])) for t, i, d, s in index.search(text[a:b])]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(("doc", "item", "edits", "first_word", "item_words"), cols, strict=True)})

    return run


def find_leaks(
    spark: SparkSession, df: DataFrame, items: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, bits: int = BITS,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item id, edits, first_word, item_words) of every contaminated pair."""
    bounded_batches(spark)
    docs = df.select(long_id(df, id_col).alias("doc"), df[text_col].alias("text")).where("doc IS NOT NULL")
    bench = items.select(long_id(items, item_id_col).alias("item"), items[item_text_col].alias("text")).where("item IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunks = max(1, -(-int(total) // CHUNK_BYTES))
    out = None
    for c in range(chunks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == c).collect()
        found = docs.mapInPandas(
            _matches([r[0] for r in rows], [r[1] for r in rows], similarity, tables, bits), "doc long, item long, edits long, first_word long, item_words long"
        )
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"doc": id_col, "item": item_id_col})

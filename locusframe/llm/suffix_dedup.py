"""Suffix-array dedup: remove bytes of strings that also start earlier.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(smaller id, or the same document and an earlier start); all judged on the
input.

Sorting every suffix of the corpus would move many times its size.  Two equal
strings of ``length`` bytes hold the same least-hash gram at the same place,
so only suffixes at such anchors are kept: about one in forty.  An anchor
stands for the run of windows whose least gram it is.  Its tokens are the first
eight bytes of the suffix, which order suffixes as their bytes do, then the hash
of the gram and the hash of the bytes under that run of windows.

1. Each task sorts its own anchors by their tokens and settles equal ones at
   once: all but the first of an equal run are covered.  What is left goes to
   buckets between splitters sampled from the anchors, so suffixes that begin
   alike spread over buckets by their later tokens.  Buckets number by the bytes
   of the corpus (``BUCKET_BYTES`` each, ``MOST_BUCKETS`` at most).
2. Buckets are sorted by multikey quicksort on the tokens.  In a run with all
   tokens equal all but the first are covered.  Runs that share only the gram,
   and grams at a bucket's first or last place (which may go on in the next
   bucket), are compared below the gram.
3. Those few anchors get their bytes from the texts.  Windows at the same
   place around the same gram are equal if their bytes are.  A gram with many
   different surroundings (a passage that very many documents share) is dealt
   out by window instead of by gram, so no task gets all of them.
4. Each document's covered runs are merged and cut.

Bytes are compared by 64-bit hashes of random byte codes.

Defined results: a null or empty text has no bytes; texts shorter than
``length`` keep all.  Rows equal in id and text are one document: none of them
covers another, and all lose the same.  Rows of one id with different texts are
documents one after the other, in the order of a hash of the text.  A row whose
id is null keeps all, and covers nothing.  Ids that are no integers raise
``TypeError``; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, RollingHash, bounded_batches, long_id, materialize, mix64, to_bytes

GRAM = 24
SAMPLE_DOCS = 2_000
FLUSH = 400_000
COMMON_GRAM = 64
BUCKET_BYTES, MOST_BUCKETS, SAMPLES_PER_BUCKET = 1 << 20, 100_000, 8

COVERED, ANCHOR, PART, CONTEXT, WINDOW = range(5)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of each window of ``w`` values."""
    val, at, size = v, np.arange(len(v), dtype=np.int64), 1

    def merge(val, at, step):
        n = len(val) - step
        right = val[step:] < val[:n]
        return np.where(right, val[step:], val[:n]), np.where(right, at[step:], at[:n])

    while size * 2 <= w:
        val, at = merge(val, at, size)
        size *= 2
    if size < w:
        val, at = merge(val, at, w - size)
    return at


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leading bytes, gram hash, surroundings hash, packed place) of a text's anchors.

    Leading bytes are a signed word in the order of the bytes.  Place: first window << 16 | windows - 1 << 8 | anchor - first window.
    """
    n = len(text)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    h = RollingHash(np.frombuffer(text, np.uint8))
    starts = np.arange(n - gram + 1)
    g = mix64(h.of(starts, starts + gram))
    at = sliding_argmin(g, length - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    a = at[first]
    form = ((last - first).astype(U64) << U64(8)) | (a - first).astype(U64)
    around = mix64(h.of(first, last + length) + mix64(form + U64(1)))
    lead = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)[a].copy().view(">u8").ravel().astype(U64)
    return (lead ^ U64(1 << 63)).view(np.int64), g[a].view(np.int64), around.view(np.int64), (first << 16) | form.astype(np.int64)


def _place(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor)."""
    first = loc >> 16
    return first, first + ((loc >> 8) & 255), first + (loc & 255)


def multikey_quicksort(columns: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of rows by their tokens: three-way partition, token after token."""
    out: list[np.ndarray] = []
    stack = [(np.arange(len(columns[0])), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= small or depth == len(columns):
            out.append(rows[np.lexsort([c[rows] for c in reversed(columns[depth:])])] if depth < len(columns) else rows)
            continue
        c = columns[depth][rows]
        pivot = np.partition(c[:: max(1, len(c) // 64)], len(c[:: max(1, len(c) // 64)]) // 2)[len(c[:: max(1, len(c) // 64)]) // 2]
        less, more = c < pivot, c > pivot
        if more.any():
            stack.append((rows[more], depth))
        stack.append((rows[~(less | more)], depth + 1))
        if less.any():
            stack.append((rows[less], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def merge_runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of intervals by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(doc) - 1]))
    return doc[new], start[new], (reach - shift)[last]


_ROWS = "kind byte, bucket long, t0 long, t1 long, t2 long, doc long, loc long"


def _frame(kind: int, bucket, t0, t1, t2, doc, loc) -> pd.DataFrame:
    cols = {c: np.zeros(len(doc), np.int64) + v for c, v in zip(("bucket", "t0", "t1", "t2", "doc", "loc"), (bucket, t0, t1, t2, doc, loc), strict=True)}
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int8)} | cols)


def _covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Covered runs: t0 and t1 hold start and end; dealt out by document."""
    doc, start, end = merge_runs(doc, start, end)
    spread = -1 - (mix64(doc.astype(np.int64).view(U64)) >> U64(40)).astype(np.int64)
    return _frame(COVERED, spread, start, end, 0, doc, 0)


def _first_of_equal(key: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first (by doc, place) of their key, and the others."""
    order = np.lexsort((loc, doc, key))
    k = key[order]
    head = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    return order[head], order[~head]


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """True for the first row of each run of rows that are equal in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _buckets(columns: list[np.ndarray], splitters: list[tuple[int, ...]]) -> np.ndarray:
    """Number of splitters at or below each row of sorted columns."""
    cuts = np.zeros(len(columns[0]) + 1, np.int64)
    first = np.array([s[0] for s in splitters], np.int64)
    low, high = np.searchsorted(columns[0], first, "left"), np.searchsorted(columns[0], first, "right")
    np.add.at(cuts, low[low == high], 1)
    for k in np.flatnonzero(low < high).tolist():  # later tokens decide
        lo, hi = low[k], high[k]
        for c, v in zip(columns[1:], splitters[k][1:], strict=True):
            lo, hi = lo + np.searchsorted(c[lo:hi], v, "left"), lo + np.searchsorted(c[lo:hi], v, "right")
        cuts[lo] += 1
    return np.cumsum(cuts)[:-1]


def _collect_anchors(length: int, gram: int, splitters: list[tuple[int, ...]]):
    """Map side: anchors of a task's texts, sorted, equal ones settled."""

    def flush(docs: list[int], parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        if not parts:
            return
        doc = np.repeat(np.array(docs, np.int64), [len(p[0]) for p in parts])
        *tokens, loc = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = multikey_quicksort([*tokens, doc, loc])
        tokens, doc, loc = [t[order] for t in tokens], doc[order], loc[order]
        head = _changes(tokens)
        first, last, _ = _place(loc[~head])
        yield _covered(doc[~head], first, last + length)
        tokens = [t[head] for t in tokens]
        yield _frame(ANCHOR, _buckets(tokens, splitters), *tokens, doc[head], loc[head])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for pdf in it:
            for d, t in zip(pdf["doc"].tolist(), to_bytes(pdf["text"]), strict=True):
                if len(t) >= length:
                    docs.append(d)
                    parts.append(anchors(t, length, gram))
                    rows += len(parts[-1][0])
                    if rows > FLUSH:
                        yield from flush(docs, parts)
                        docs, parts, rows = [], [], 0
        yield from flush(docs, parts)

    return run


def _sort_bucket(rows: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    *tokens, doc, loc = (rows[c].to_numpy() for c in ("t0", "t1", "t2", "doc", "loc"))
    order = multikey_quicksort([*tokens, doc, loc])
    tokens, doc, loc = [t[order] for t in tokens], doc[order], loc[order]
    head = _changes(tokens)
    first, last, _ = _place(loc[~head])
    yield _covered(doc[~head], first, last + length)
    grams, doc, loc = [t[head] for t in tokens[:2]], doc[head], loc[head]
    new = _changes(grams)
    # what may go on over a boundary is compared below the gram too
    part = ~new | ~np.concatenate((new[1:], [False]))
    run = np.cumsum(new)
    part |= (run == 1) | (run == run[-1])
    yield _frame(PART, 0, grams[1][part], 0, 0, doc[part], loc[part])


def _sort_buckets(length: int):
    """Reduce side: rows come sorted by bucket."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, parts = None, []
        for pdf in it:
            covered = pdf["kind"].to_numpy() == COVERED
            if covered.any():
                yield pdf[covered]
            pdf = pdf[~covered]
            if not len(pdf):
                continue
            keys = pdf["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts and keys[a] != bucket:
                    yield from _sort_bucket(pd.concat(parts), length)
                    parts = []
                bucket = keys[a]
                parts.append(pdf.iloc[a:b])
        if parts:
            yield from _sort_bucket(pd.concat(parts), length)

    return run


_BELOW = "kind byte, key long, doc long, loc long, bytes binary"


def _windows_of(text: bytes, gram_hash: np.ndarray, loc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of every window of some anchors of a text.

    The key is of the gram, the window's place around it, and its bytes.
    """
    h = RollingHash(np.frombuffer(text, np.uint8))
    first, last, at = _place(loc)
    n = last - first + 1
    start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = (np.repeat(at, n) - start).astype(U64)
    key = mix64(h.of(start, start + length) + mix64(np.repeat(gram_hash.view(U64), n) + shift))
    return key, start


def _fetch(length: int):
    """Texts with their anchors to compare -> context rows and window rows."""

    def flush(wins: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        if not wins:
            return
        key, doc, start = (np.concatenate([w[i] for w in wins]) for i in range(3))
        head, rest = _first_of_equal(key, doc, start)
        d, s, e = merge_runs(doc[rest], start[rest], start[rest] + length)
        yield _below(COVERED, mix64(d.view(U64)).view(np.int64), d, (s << 32) | (e - s), None)
        yield _below(WINDOW, key[head].view(np.int64), doc[head], start[head], None)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wins: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for pdf in it:
            keys, docs, locs, ctx = [], [], [], []
            for d, t, part in zip(pdf["doc"].tolist(), to_bytes(pdf["text"]), pdf["part"], strict=True):
                common = [(p["t0"], p["loc"]) for p in part if p["common"]]
                for p in part:
                    if not p["common"]:
                        first, more = p["loc"] >> 16, (p["loc"] >> 8) & 255
                        keys.append(p["t0"])
                        docs.append(d)
                        locs.append(p["loc"])
                        ctx.append(t[first : first + more + length])
                if common:
                    key, start = _windows_of(t, np.array([c[0] for c in common], np.int64), np.array([c[1] for c in common], np.int64), length)
                    wins.append((key, np.full(len(key), d, np.int64), start))
                    held += len(key)
            if keys:
                yield _below(CONTEXT, np.array(keys, np.int64), np.array(docs, np.int64), np.array(locs, np.int64), ctx)
            if held > FLUSH:
                yield from flush(wins)
                wins, held = [], 0
        yield from flush(wins)

    return run


def _below(kind: int, key: np.ndarray, doc: np.ndarray, loc: np.ndarray, ctx: list[bytes] | None) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int8), "key": key, "doc": doc, "loc": loc, "bytes": ctx if ctx is not None else [None] * len(doc)})


_RUNS = "doc long, start long, stop long"


def _runs(doc, start, stop) -> pd.DataFrame:
    doc, start, stop = merge_runs(doc, start, stop)
    return pd.DataFrame({"doc": doc.astype(np.int64), "start": start.astype(np.int64), "stop": stop.astype(np.int64)})


def _compare(length: int):
    """Rows sorted by (kind, key, doc, place) -> covered runs.

    A gram's contexts number at most ``COMMON_GRAM``; whole groups are settled
    together in chunks of bounded bytes.
    """

    def settle(parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts)
        key, doc, loc = p["key"].to_numpy(), p["doc"].to_numpy(), p["loc"].to_numpy()
        ctx = p["bytes"].tolist()
        first, _, at = _place(loc)
        base = np.cumsum([0, *map(len, ctx[:-1])])
        moved = (base << 16) | (loc & 0xFFFF)
        win, start = _windows_of(b"".join(ctx), key, moved, length)
        n = ((loc >> 8) & 255) + 1
        which = np.repeat(np.arange(len(loc)), n)
        true_start = start - base[which] + first[which]
        _, rest = _first_of_equal(win, doc[which], true_start)
        return _runs(doc[which][rest], true_start[rest], true_start[rest] + length)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows = [], 0
        last = None
        for pdf in it:
            kind = pdf["kind"].to_numpy()
            done = pdf[kind == COVERED]
            if len(done):
                loc = done["loc"].to_numpy()
                yield _runs(done["doc"].to_numpy(), loc >> 32, (loc >> 32) + (loc & 0xFFFFFFFF))
            wins = pdf[kind == WINDOW]
            if len(wins):
                key, doc, start = wins["key"].to_numpy(), wins["doc"].to_numpy(), wins["loc"].to_numpy()
                again = np.concatenate(([last is not None and key[0] == last], key[1:] == key[:-1]))
                last = key[-1]
                yield _runs(doc[again], start[again], start[again] + length)
            ctx = pdf[kind == CONTEXT]
            if len(ctx):
                keys = ctx["key"].to_numpy()
                if rows > 8_000:
                    # settle up to the last gram that is surely complete
                    held = pd.concat(parts)
                    tail = held["key"].to_numpy()[-1]
                    if tail != keys[0]:
                        yield settle([held])
                        parts, rows = [], 0
                    else:
                        open_part = held["key"].to_numpy() == tail
                        if not open_part.all():
                            yield settle([held[~open_part]])
                            parts = [held[open_part]]
                            rows = len(parts[0])
                parts.append(ctx)
                rows += len(ctx)
        if parts:
            yield settle(parts)

    return run


def _cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        out: list[tuple] = []
        for t, runs in zip(to_bytes(pdf["text"]), pdf["runs"], strict=True):
            if runs is None or not len(runs):
                out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t))
                continue
            start = np.array([r["start"] for r in runs], np.int64)
            stop = np.array([r["stop"] for r in runs], np.int64)
            _, start, stop = merge_runs(np.zeros(len(start), np.int64), start, stop)
            start, stop = np.minimum(start, len(t)), np.minimum(stop, len(t))
            edges = [0, *np.stack((start, stop), 1).ravel().tolist(), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
            out.append((len(t), len(t) - len(kept), int((stop > start).sum()), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pd.DataFrame({"id": pdf["id"], "n_bytes": cols[0], "n_removed": cols[1], "n_spans": cols[2], "kept_sha256": cols[3], "kept": cols[4]})


def _splitters(docs: DataFrame, length: int, gram: int) -> list[tuple[int, ...]]:
    """Bounds of the buckets, from the anchors of a sample of documents."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).collect()[0]
    n = min(-(-(size or 0) // BUCKET_BYTES), MOST_BUCKETS)
    if n < 2:
        return []
    part = min(1.0, max(SAMPLE_DOCS, n * SAMPLES_PER_BUCKET // 20) / rows)
    found = docs.sample(False, part, 7).mapInPandas(_collect_anchors(length, gram, []), _ROWS).where(F.col("kind") == ANCHOR)
    # a window of w grams has its least one in about 2 of w + 1 places
    share = n * SAMPLES_PER_BUCKET / max(1.0, size * part * 2 / (length - gram + 2))
    some = found.where(F.pmod(F.xxhash64("doc", "loc"), F.lit(1 << 20)) < share * (1 << 20)).select("t0", "t1", "t2").collect()
    some = sorted(tuple(r) for r in some)
    return sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []


def covered_runs(spark: SparkSession, docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """(doc, start, stop) of covered bytes of ``docs`` (doc, text); may overlap."""
    if length - gram > 255:
        raise ValueError(f"length is at most {gram + 255}: an anchor's place has 8 bits for its windows")
    routed = docs.mapInPandas(_collect_anchors(length, gram, _splitters(docs, length, gram)), _ROWS)
    sorted_ = materialize(spark, routed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_sort_buckets(length), _ROWS).drop("bucket"))
    done = sorted_.where(F.col("kind") == COVERED).select("doc", F.col("t0").alias("start"), F.col("t1").alias("stop"))
    part = sorted_.where(F.col("kind") == PART).select("t0", "doc", "loc")
    counts = part.groupBy("t0").agg(F.count("*").alias("c")).where("c > 1")
    asks = (
        part.join(counts, "t0")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("t0", "loc", (F.col("c") > COMMON_GRAM).alias("common"))).alias("part"))
    )
    below = docs.join(asks, "doc").mapInPandas(_fetch(length), _BELOW)
    more = materialize(spark, below.repartition("key").sortWithinPartitions("kind", "key", "doc", "loc").mapInPandas(_compare(length), _RUNS))
    return done.union(more)


def _named(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (id, text) with ``doc``, one number in their order for rows equal in
    both; and each ``doc`` once."""
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("doc", F.col("id"))
        return docs, docs
    docs = docs.withColumn("print", F.xxhash64("text"))
    order = docs.select("id", "print").distinct().repartitionByRange("id", "print").sortWithinPartitions("id", "print")
    names = materialize(spark, order.withColumn("doc", F.monotonically_increasing_id()))
    docs = docs.join(names, ["id", "print"]).drop("print")
    return docs, docs.dropDuplicates(["doc"])


def dedup(spark: SparkSession, df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row."""
    bounded_batches(spark)
    rows = df.select(long_id(df, id_col).alias("id"), df[text_col].alias("text"))
    docs, once = _named(spark, rows.where("id IS NOT NULL"))
    runs = covered_runs(spark, once.select("doc", "text"), length).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    nameless = rows.where("id IS NULL").select("id", "text", F.lit(None).cast(dict(runs.dtypes)["runs"]).alias("runs"))
    whole = docs.join(runs, "doc", "left").select("id", "text", "runs").union(nameless)
    out = whole.select(F.col("id").cast("string").alias("id"), "text", "runs").mapInPandas(_cut, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept")

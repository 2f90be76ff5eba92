"""N-gram Jaccard join: documents whose word shingle sets are alike.

Two documents link when ``100 * |A n B| >= percent * |A u B|``; the result is
each document's set size and the smallest id reachable by links.

1. One pass counts how many documents hold each shingle, over all documents, in
   ``SLOTS`` counters by hash (a fixed size, whatever the corpus).  The counts
   put all shingles in one order, rare ones first; shingles that share a
   counter only look more frequent than they are.
2. Linked sets, written in that order, differ in few elements, so they share two
   neighbours near the beginning, among their rarest elements.  A document is sent
   to the lists of as many pairs of rare neighbours as may be parted, and one
   more, with its size and the largest size of a partner that it may still have
   if that pair is the first they share.  Documents of one list whose size
   intervals overlap are candidates.  Each task joins the intervals of its own
   documents first, so a list that a third of all documents share gets a few
   rows per task.
3. Components of the candidates are families: every link lies in one.  Families
   are dealt out in blocks of bounded shingles and rows, every block also gets
   the family's first set, and each block is joined exactly by T-occurrence
   search: the short inverted lists are merged by a heap, the long ones (their
   number by DivideSkip's rule) are probed by binary search for candidates that
   can still reach the overlap; what is connected already is skipped, and only a
   spanning forest of links leaves the task.
4. In families of several blocks, the sets outside the largest connected part
   are gathered in chunks of bounded size, and each chunk is compared with all
   blocks: pairs inside one part cannot change the result, all others are
   searched.
5. Components of all links.

Equal sets are one vertex throughout.  Ids are only put back at the end.

Defined results: null or empty texts, or texts of white space only, have an
empty set, link with nothing and are their own component.  With fewer words
than a shingle the whole sequence is the one shingle.  Rows that repeat an id
are separate documents of that name, each judged by its own text.  A row whose
id is null gets its set size and a null component, and links with nothing.  Ids
that are no integers raise ``TypeError``.  Sets are sets of 64-bit hashes of the
shingles.  Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, UnionFind, batches, bounded_batches, components, discard, long_id, materialize, maybe_in, mix64, release_memory, to_bytes, word_hashes

SLOTS, PIECES = 1 << 20, 64
BLOCK_SHINGLES, BLOCK_ROWS = 250_000, 200
FLUSH_ROWS = 250_000
SLICE_ROWS = 100_000
PROBE_LISTS = 32
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01

#: From this similarity on lists are of pairs of neighbours, below of single elements.
PAIRS_FROM = 75

NODE, SIG, NEAR = range(3)


def shingle_sets(texts: list[bytes], words: int = 3) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    for lo, hi in batches(texts):
        h, bounds, _, _ = word_hashes([t.lower() for t in texts[lo:hi]])
        if len(h) >= words:
            sh = np.zeros(len(h) - words + 1, U64)
            for k in range(words):
                sh = mix64(sh * U64(0x100000001B3) + h[k : len(h) - words + 1 + k])
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                yield np.unique(sh[a : b - words + 1])
            elif b > a:
                one = np.full(1, b - a, U64)
                for x in h[a:b]:
                    one = mix64(one * U64(0x9E3779B97F4A7C15) + x)
                yield one
            else:
                yield np.zeros(0, U64)


def set_print(s: np.ndarray) -> int:
    """A set's fingerprint, as a signed word."""
    return int(mix64(np.array([np.sum(mix64(s), dtype=U64) + U64(len(s))], U64)).view(np.int64)[0])


# ---------------------------------------------------------------- frequencies


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _count(words: int):
    """Each task's counters, in compressed pieces."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for pdf in it:
            for part in _pieces(shingle_sets(to_bytes(pdf["text"]), words)):
                total += np.bincount(_slot(part), minlength=SLOTS)
        if total.any():
            cut = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(PIECES, -1)
            yield pd.DataFrame({"piece": np.arange(PIECES), "counts": [zlib.compress(c.tobytes(), 1) for c in cut]})

    return run


def _pieces(sets: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[np.ndarray]:
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size > most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _add_counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in it:
        for piece, counts in zip(pdf["piece"].tolist(), pdf["counts"], strict=True):
            more = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
            sums[piece] = sums[piece] + more if piece in sums else more
    yield pd.DataFrame({"piece": np.array(list(sums), np.int64), "counts": [c.astype("<i8").tobytes() for c in sums.values()]})


def frequency_order(docs: DataFrame, words: int) -> np.ndarray:
    """Rank (a byte, growing with the logarithm of the count) of each counter.

    ``SLOTS`` bytes whatever the corpus; counts cover all documents.
    """
    schema = "piece long, counts binary"
    summed = docs.select("text").mapInPandas(_count(words), schema).repartition(PIECES, "piece").mapInPandas(_add_counts, schema)
    counts = np.zeros((PIECES, SLOTS // PIECES), np.int64)
    for piece, c in summed.collect():
        counts[piece] = np.frombuffer(c, "<i8")
    return np.floor(4 * np.log2(1.0 + counts.ravel())).astype(np.uint8)


# ---------------------------------------------------------------- candidates


def prefix(s: np.ndarray, order: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of a set, largest partner by each if it is the first shared).

    From ``PAIRS_FROM`` percent on, a key is two neighbours in the common order of
    elements.  An element that only this set has parts two pairs of neighbours at
    most, one that only the partner has parts one; a partner of m elements leaves
    2 n + m - 3 * overlap such pairs parted at most, so if the first i pairs are,
    m is at most (n (200 - percent) - i (100 + percent)) / (2 percent - 100), and
    only so many pairs are sent as may be parted by any partner, and one more.
    Below that a key is one element, of the n - T + 1 first.

    Linked sets that differ share a key, and the larger one is no larger than the
    smaller one's largest partner there.  If the key stands too late for any
    partner of at least the set's own size, that is less than the size.
    """
    n = len(s)
    least = -(-n * percent // 100)
    if percent < PAIRS_FROM:
        keys = s[np.argsort(order[_slot(s)], kind="stable")[: n - least + 1]]
        reach = (n - np.arange(len(keys))) * (100 + percent) // percent - n
    else:
        parted = (n * (200 - percent) - least * (2 * percent - 100)) // (100 + percent)
        first = s[np.argsort(order[_slot(s)], kind="stable")[: parted + 2]]
        keys = mix64(first[:-1] * U64(0x9E3779B97F4A7C15) + first[1:])
        reach = np.minimum((n * (200 - percent) - np.arange(len(keys)) * (100 + percent)) // (2 * percent - 100), n * 100 // percent)
    return keys, np.maximum(reach, n - 1)


def _overlaps(key: np.ndarray, n: np.ndarray, reach: np.ndarray, before: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first of each run of overlapping intervals [n, reach], largest reach so far).

    Rows are sorted by key, n, and falling reach; ``before`` is the last row's
    key and largest reach of what came earlier.
    """
    new_key = np.concatenate(([before is None or before[0] != key[0]], key[1:] != key[:-1]))
    lift = np.cumsum(new_key) * (1 << 34)
    so_far = reach + lift
    if not new_key[0]:
        so_far[0] = max(int(reach[0]), before[1])
    so_far = np.maximum.accumulate(so_far) - lift
    last = np.concatenate(([before[1] if before else 0], so_far[:-1]))
    return new_key | (n > last), so_far


_ROUTE = "kind byte, key long, n int, a long, b long"


def _rows(kind: int, key: np.ndarray, n, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    size = len(a)
    return pd.DataFrame({"kind": np.full(size, kind, np.int8), "key": key.view(np.int64), "n": np.zeros(size, np.int32) + np.asarray(n, np.int32), "a": a, "b": b})


def _spread(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.view(U64))


def _near(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    pairs = np.unique(np.stack((a, b), 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return _rows(NEAR, _spread(pairs[:, 0].copy()), 0, pairs[:, 0], pairs[:, 1])


def _route(percent: int, words: int, order: np.ndarray):
    """Map side of step 2: rows of documents, of lists, and candidates found here."""

    def flush(sent: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        if not sent:
            return
        sizes = [len(v[1]) for v in sent.values()]
        fp = np.repeat(np.array(list(sent), np.int64), sizes)
        n = np.repeat(np.array([v[0] for v in sent.values()], np.int64), sizes)
        key = np.concatenate([v[1] for v in sent.values()])
        reach = np.concatenate([v[2] for v in sent.values()])
        at = np.lexsort((-reach, n, key))
        fp, n, key, reach = fp[at], n[at], key[at], reach[at]
        first, so_far = _overlaps(key, n, reach)
        head = np.flatnonzero(first)
        last = np.concatenate((head[1:], [len(key)])) - 1
        yield _near(fp, fp[head][np.cumsum(first) - 1])
        for lo in range(0, len(head), SLICE_ROWS):
            some, end = head[lo : lo + SLICE_ROWS], last[lo : lo + SLICE_ROWS]
            # the reach of this run alone: earlier runs of the list end before it
            yield _rows(SIG, key[some], n[some], fp[some], so_far[end])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        rows = 0
        for pdf in it:
            doc, ns, prints = pdf["doc"].to_numpy(np.int64), [], []
            for s in shingle_sets(to_bytes(pdf["text"]), words):
                fp = set_print(s)
                ns.append(len(s))
                prints.append(fp)
                if len(s) and fp not in sent:
                    sent[fp] = (len(s), *prefix(s, order, percent))
                    rows += len(sent[fp][1])
            yield _rows(NODE, _spread(doc), ns, doc, np.array(prints, np.int64))
            if rows > FLUSH_ROWS:
                yield from flush(sent)
                sent, rows = {}, 0
        yield from flush(sent)
        sent.clear()
        release_memory()

    return run


def _meet(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side of step 2: rows come sorted by (kind, key, n, falling reach)."""
    before, head = None, 0
    for pdf in it:
        lists = pdf["kind"].to_numpy() == SIG
        if not lists.all():
            yield pdf[~lists]
        if not lists.any():
            continue
        part = pdf[lists]
        key, n, fp, reach = (part[c].to_numpy() for c in ("key", "n", "a", "b"))
        first, so_far = _overlaps(key, n.astype(np.int64), reach, before)
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        heads = np.where(start < 0, head, fp[start])
        before, head = (int(key[-1]), int(so_far[-1])), int(heads[-1])
        yield _near(fp, heads)


# ---------------------------------------------------------------- search


def search_block(ids: list[int], sets: list[np.ndarray], queries: list[int], percent: int, uf: UnionFind, parts: list[int] | None = None) -> None:
    """T-occurrence search of some sets of a block against all of them.

    ``queries`` are indices into ``sets``; ``parts`` tells what is connected
    already.  For each query the L longest inverted lists of its elements are set
    aside, L by DivideSkip's rule; the others are merged by a heap with counts;
    candidates that can still reach their overlap are probed by binary search in
    the long lists, shortest first, and given up as soon as they cannot.  Links
    go to ``uf``.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2 or not sizes.sum():
        return
    owner = np.repeat(np.arange(n), sizes)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.argsort(inverse, kind="stable")
    posting = owner[at]
    entry = inverse[at] * n + posting  # (list, set), sorted: all lists one after the other
    df = np.bincount(inverse)
    end = np.cumsum(df)
    start = end - df
    of_set = np.split(inverse, np.cumsum(sizes)[:-1])
    label = np.unique(ids if parts is None else parts, return_inverse=True)[1]
    up = 100 + percent
    for q in queries:
        size = int(sizes[q])
        if not size:
            continue
        low = -(-size * percent // 100)
        open_ = (label != label[q]) & (sizes >= low) & (sizes * percent <= size * 100)
        if not open_.any():
            continue
        least = max(1, -(-percent * (size + low) // up))  # the smallest overlap of any partner
        mine = of_set[q][np.argsort(df[of_set[q]], kind="stable")]
        long_ones = min(least - 1, int(least / (MU * math.log2(max(2, int(df[mine[-1]]))) + 1)))
        short, rest = mine[: size - long_ones], mine[size - long_ones :]
        merged = np.concatenate([posting[start[t] : end[t]] for t in short.tolist()])
        can = open_[merged]
        if not can.any():
            continue
        cuts = np.flatnonzero(np.diff(np.repeat(np.arange(len(short)), df[short])[can])) + 1
        lists = [part.tolist() for part in np.split(merged[can], cuts)]
        counted = [(c, sum(1 for _ in same)) for c, same in itertools.groupby(heapq.merge(*lists))]
        cand = np.array([c for c, _ in counted], np.int64)
        have = np.array([k for _, k in counted], np.int64)
        need = -(-percent * (size + sizes[cand]) // up)
        done = 0
        while len(cand):
            for c in cand[have >= need].tolist():
                if label[c] != label[q]:
                    label[label == label[c]] = label[q]
                    uf.join(ids[c], ids[q])
            alive = (label[cand] != label[q]) & (have + (len(rest) - done) >= need)
            cand, have, need = cand[alive], have[alive], need[alive]
            if done == len(rest):
                break
            probe = rest[done : done + PROBE_LISTS, None] * n + cand[None, :]
            place = np.minimum(np.searchsorted(entry, probe), len(entry) - 1)
            have = have + (entry[place] == probe).sum(axis=0)
            done += len(probe)


def _search(percent: int, words: int):
    """Rows of (grp, fp, part, query, text) sorted by group -> links."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        seen: dict[int, list] = {}
        for (_, fp, part, query, _), s in zip(rows, shingle_sets(to_bytes(pd.Series([r[4] for r in rows], dtype=object)), words), strict=True):
            if set_print(s) == fp:  # another row of the same id may have another text
                seen[fp] = [part, query or (fp in seen and seen[fp][1]), s]
        ids, uf = sorted(seen), UnionFind()
        search_block(ids, [seen[d][2] for d in ids], [i for i, d in enumerate(ids) if seen[d][1]], percent, uf, [seen[d][0] for d in ids])
        a, b = uf.stars()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rows = None, []
        for pdf in it:
            for row in zip(pdf["grp"].tolist(), pdf["fp"].tolist(), pdf["part"].tolist(), pdf["query"].tolist(), pdf["text"].tolist(), strict=True):
                if row[0] != group:
                    if len(rows) > 1:
                        yield solve(rows)
                    group, rows = row[0], []
                rows.append(row)
        if len(rows) > 1:
            yield solve(rows)
        rows.clear()
        release_memory()

    return run


def _verify(spark: SparkSession, docs: DataFrame, members: DataFrame, percent: int, words: int) -> DataFrame:
    """Links among rows (doc, fp, grp, part, query) of ``members``, searched by group."""
    near = maybe_in(spark, docs, "doc", members.select("doc"))
    dealt = near.join(members, "doc").select("grp", "fp", "part", "query", "text")
    return materialize(spark, dealt.repartition("grp").sortWithinPartitions("grp").mapInPandas(_search(percent, words), "a long, b long"))


def _each(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _blocks(n: str, rows: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK_SHINGLES, F.col(rows) / BLOCK_ROWS)).cast("long")


def _link_sets(spark: SparkSession, docs: DataFrame, sets: DataFrame, near: DataFrame, percent: int, words: int) -> DataFrame:
    """Steps 3 and 4: links (a, b) between the fingerprints of ``sets`` (fp, doc, n)."""
    families = components(spark, near).withColumnsRenamed({"id": "fp", "component": "family"}).join(sets.select("fp", "doc", "n"), "fp")
    families = materialize(spark, families)
    large = families.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).select("family", _blocks("total", "sets").alias("blocks"))
    large = materialize(spark, large.where("blocks > 1"))
    placed = families.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = materialize(spark, placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))))
    group = F.xxhash64("family", "block").alias("grp")
    inside = placed.select("doc", "fp", group, F.col("fp").alias("part"), F.lit(True).alias("query"))
    # each family's first set stands in all of its blocks
    heads = placed.where("fp = family and blocks > 1").withColumn("block", _each("blocks"))
    links = _verify(spark, docs, inside.union(heads.select("doc", "fp", group, F.col("fp").alias("part"), F.lit(True).alias("query"))), percent, words)
    big = placed.where("blocks > 1")
    if not big.isEmpty():
        part = components(spark, links)
        big = big.join(part, F.col("fp") == F.col("id"), "left").withColumn("part", F.coalesce("component", "fp")).drop("id", "component")
        counts = big.groupBy("family", "part").agg(F.count("*").alias("c"))
        main = materialize(spark, counts.groupBy("family").agg(F.max_by("part", F.struct("c", "part")).alias("main")))
        big = materialize(spark, big.join(main, "family"))
        outside = big.where("part <> main")
        chunks = materialize(spark, outside.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).select("family", _blocks("total", "sets").alias("chunks")))
        if not chunks.isEmpty():
            group = F.xxhash64("family", "block", "chunk").alias("grp")
            hosts = big.join(chunks, "family").withColumn("chunk", _each("chunks")).select("doc", "fp", group, "part", F.lit(False).alias("query"))
            asks = outside.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))).withColumn("block", _each("blocks"))
            links = links.union(_verify(spark, docs, hosts.union(asks.select("doc", "fp", group, "part", F.lit(True).alias("query"))), percent, words))
    discard(spark, families)
    return links


def jaccard_components(spark: SparkSession, df: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``."""
    bounded_batches(spark)
    rows = df.select(long_id(df, id_col).alias("doc"), df[text_col].alias("text"))
    docs = rows.where("doc IS NOT NULL")
    routed = docs.mapInPandas(_route(percent, words, frequency_order(docs, words)), _ROUTE)
    # a set number: partitions that are merged by their small compressed size
    # would hold too many rows for a worker
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(spark, routed.repartition(tasks, "key").sortWithinPartitions("kind", "key", "n", F.desc("b")).mapInPandas(_meet, _ROUTE))
    nodes = met.where(F.col("kind") == NODE).select(F.col("a").alias("doc"), F.when(F.col("n") > 0, F.col("b")).alias("fp"), F.col("n").cast("long").alias("n"))
    sets = materialize(spark, nodes.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.count("*").alias("copies")))
    links = _link_sets(spark, docs, sets, met.where(F.col("kind") == NEAR).select("a", "b"), percent, words)
    comp = components(spark, links)
    named = sets.join(comp, F.col("fp") == F.col("id"), "left").where("component IS NOT NULL OR copies > 1").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(spark, named.select("fp", "doc", "component"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    found = materialize(spark, named.join(least, "component").select("fp", "least"))
    out = nodes.join(found, "fp", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
    for t in (sets, named):
        discard(spark, t)
    nameless = rows.where("doc IS NULL").select("text").mapInPandas(_sizes(words), "n_shingles long")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc"), "n_shingles", F.lit(None).cast("long").alias("component_id"))).withColumnRenamed("doc", id_col)


def _sizes(words: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"n_shingles": [len(s) for s in shingle_sets(to_bytes(pdf["text"]), words)]}, dtype="int64")

    return run

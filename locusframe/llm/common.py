"""Shared pieces: tables, shared scratch tables, text hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources import scratch

U64 = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: texts may be long, signatures are many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(df: DataFrame, col: str) -> Column:
    """An id column as long; ids that are no integers raise ``TypeError``."""
    kind = dict(df.dtypes)[col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers; {col} is {kind}")
    return df[col].cast("long")


def as_text(df: DataFrame, col: str) -> Column:
    """An id column on its way through pandas, where a null beside it would turn
    integers into doubles; ``as_before`` casts it back."""
    return df[col].cast("string").alias(col)


def as_before(out: DataFrame, df: DataFrame, col: str) -> DataFrame:
    return out.withColumn(col, F.col(col).cast(dict(df.dtypes)[col]))


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    return scratch.cut(df)


def discard(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    scratch.discard(df)


def release_memory() -> None:
    """Give a worker's freed memory back: workers live on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


FILTER_BITS = 1 << 26


def maybe_in(spark: SparkSession, df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``col`` may be in the one column of ``ids``.

    A bitmap of ``FILTER_BITS`` bits over hashed ids is broadcast: 8 MB whatever
    the number of ids.  It lets strangers pass and drops no id, so it only
    saves what a following join would shuffle for nothing.
    """
    bit = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS))
    # the construction counts bits from one in each bucket
    maps = (
        ids.select((bit + 1).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    )
    own = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)) + 1
    at = df.withColumn("_bucket", F.bitmap_bucket_number(own)).withColumn("_at", F.bitmap_bit_position(own))
    joined = at.join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.substring("_map", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return joined.where(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1).select(*df.columns)


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E6C63D0876A9A35 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, U64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


class RollingHash:
    """Polynomial prefix sums over a byte buffer: any substring's hash in O(1)."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inv = powers(_BASE_INV, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_CODES[buf] * powers(_BASE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word (maximal run without ASCII white space) of every text.

    Returns (hashes, first word of each text with a closing bound, byte start
    and byte end of each word inside its own text).
    """
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=starts[1:])
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    ws, we = edge[0::2], edge[1::2]
    hashes = mix64(RollingHash(buf).of(ws, we) + (we - ws).astype(U64))
    bounds = np.searchsorted(ws, starts)
    shift = np.repeat(starts[:-1], np.diff(bounds))
    return hashes, bounds, ws - shift, we - shift


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("0") : ord("9") + 1] = True
_LETTER[128:] = True


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits and non-ASCII bytes.

    Returns (joined bytes, starts, ends, words of each text).
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    letter = _LETTER[buf]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate(([0], edge))
    ws, we = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return buf, ws, we, np.diff(np.searchsorted(ws, ends), prepend=0)


def batches(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; one longer text is a run alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def to_bytes(col: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in col]


# ---------------------------------------------------------------- components


class UnionFind:
    """Union by smaller label, with path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = up.setdefault(x, x)
        while r != up[r]:
            up[r] = up[up[r]]
            r = up[r]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.find(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return [p[0] for p in pairs], [p[1] for p in pairs]


_CHUNK = 500_000


def _forest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task as stars; flushed at a fixed count, so memory is bounded."""
    uf = UnionFind()
    for pdf in it:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            uf.join(a, b)
        if len(uf.up) >= _CHUNK:
            a, b = uf.stars()
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")
            uf = UnionFind()
    a, b = uf.stars()
    yield pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _unsettled(edges: DataFrame) -> DataFrame:
    """Ids that keep edges (a, b) from being stars: two centres, or both ends."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    ids = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return ids.where("leaf > 1 or (leaf = 1 and centre = 1)")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Alternates the large-star and small-star steps, which keep the components
    and end in stars after a few rounds whatever the shape; each task first
    replaces its edges by a spanning forest.  Only ids that have an edge to
    another id are returned.
    """
    schema = "a long, b long"
    cur = materialize(spark, edges.select("a", "b").where("a <> b").mapInPandas(_forest, schema))
    while not _unsettled(cur).isEmpty():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        new = materialize(spark, small)
        discard(spark, cur)
        cur = new
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )

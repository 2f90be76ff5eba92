"""Embedding near-dedup: PCA-ordered tiled comparison.

Vectors of one label (and length) link when their cosine reaches a threshold.

1. Equal vectors of a label form a class with a count and go on as one.
2. A rotation to principal axes, fitted on a bounded sample of unit vectors
   (``SAMPLE_ROWS``, the smallest by a hash of the id), orders dimensions by
   variance.  It is orthogonal, so cosines do not change whatever the sample.
3. Unit vectors with cosine t lie within sqrt(2 - 2t) of each other, so in
   each leading axis their cells of that width are equal or next to each
   other.  Cells are cut in tiles of bounded size by a hash of the id, and the
   pairs of tiles in neighbouring cells are dealt out as groups: a label or
   cell that holds a third of all rows is many groups.
4. In a pair of tiles products accumulate over blocks of leading dimensions;
   the rest of each product is at most the product of the suffix norms, and
   rows that can reach the threshold with none are dropped from the tile.
   What is left is decided by the cosine of the given vectors in doubles.
5. A group returns counts of links by row and a spanning forest, never pairs.

Defined results: vectors or labels that are null, and vectors that are empty,
zero, or hold null or non-finite components, link with nothing: no links, own
component, kept.  So do rows without an id, whose component is null.  Repeated
rows with one id count as rows of that id's class.  A cosine equal to the threshold
links.  Ids that are no integers raise ``TypeError``.  Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, long_id, materialize

SAMPLE_ROWS = 4_000
TILE_ROWS = 1_024
AXES = 2
BLOCKS = (8, 16, 32)


def fit_axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Principal axes (columns, by falling variance) for each vector length."""
    by_len: dict[int, list[list[float]]] = {}
    for v in sample:
        by_len.setdefault(len(v), []).append(v)
    out = {}
    for d, vs in by_len.items():
        x = _scaled(np.array(vs, np.float64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(axis=0)
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows by a power of two near their largest component: no square overflows,
    and nothing is rounded, so a cosine right at the threshold stays there."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _rotate(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    u = _scaled(vectors)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    v = axes.get(vectors.shape[1])
    return u if v is None else u @ v


def tile_links(x: np.ndarray, y: np.ndarray, axes: dict[int, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row indices of x, of y, link matrix between them) after the bounds."""
    rx, ry = _rotate(x, axes), _rotate(y, axes)
    d = rx.shape[1]
    keep_x, keep_y = np.arange(len(x)), np.arange(len(y))
    sx = np.sqrt(np.maximum(np.cumsum(rx[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    sy = np.sqrt(np.maximum(np.cumsum(ry[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    done, acc = 0, np.zeros((len(x), len(y)))
    for k in (*[b for b in BLOCKS if b < d], d):
        acc = acc + rx[keep_x, done:k] @ ry[keep_y, done:k].T
        done = k
        if k < d:
            can = acc + sx[keep_x, k][:, None] * sy[keep_y, k][None, :] >= threshold - 1e-9
        else:
            can = acc >= threshold - 1e-9
        in_x, in_y = can.any(axis=1), can.any(axis=0)
        keep_x, keep_y = keep_x[in_x], keep_y[in_y]
        acc = acc[np.ix_(in_x, in_y)]
        if not acc.size:
            return keep_x, keep_y, np.zeros((len(keep_x), len(keep_y)), bool)
    a, b = _scaled(x[keep_x]), _scaled(y[keep_y])
    cos = (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])
    return keep_x, keep_y, cos >= threshold


_FOUND = "kind byte, a long, b long"


def _stars(x: np.ndarray, y: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id) that span what a tile pair's links connect."""
    ids, label = np.concatenate((x, y)), np.arange(len(x) + len(y))
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        own = np.unique(np.append(label[len(x) + np.flatnonzero(link[i])], label[i]))
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    edge = low[label] != ids
    return ids[edge], low[label][edge]


def _solve(ids, mult, side, vectors, axes, threshold) -> pd.DataFrame:
    """Counts (kind 0: id, links) and forest edges (kind 1) of one tile pair."""
    left = side != 1
    right = side != 0
    x, y = vectors[left], vectors[right]
    ix, iy, mx, my = ids[left], ids[right], mult[left], mult[right]
    own = bool((side == 2).all())
    kx, ky, link = tile_links(x, y, axes, threshold)
    ix, iy, mx, my = ix[kx], iy[ky], mx[kx], my[ky]
    if own:
        link &= ix[:, None] != iy[None, :]
    counts_x = link @ my
    got = [(ix[counts_x > 0], counts_x[counts_x > 0])]
    if not own:
        counts_y = mx @ link
        got.append((iy[counts_y > 0], counts_y[counts_y > 0]))
    a, b = _stars(ix, iy, link)
    parts = [pd.DataFrame({"kind": np.int8(0), "a": i, "b": n.astype(np.int64)}) for i, n in got]
    parts.append(pd.DataFrame({"kind": np.int8(1), "a": a, "b": b}))
    return pd.concat(parts).astype({"kind": "int8", "a": "int64", "b": "int64"})


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, parts = None, []

        def finish() -> pd.DataFrame:
            p = pd.concat(parts)
            return _solve(p["rep"].to_numpy(), p["mult"].to_numpy(), p["side"].to_numpy(), np.stack(p["embedding"].to_numpy()).astype(np.float64), axes, threshold)

        for pdf in it:
            for key, part in pdf.groupby("pair", sort=False):
                if key != group:
                    if parts:
                        yield finish()
                    group, parts = key, []
                parts.append(part)
        if parts:
            yield finish()

    return run


def _cells(axes: dict[int, np.ndarray], width: float, n_axes: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = np.zeros((len(pdf), n_axes), np.int64)
            lens = pdf["embedding"].map(len).to_numpy()
            for d in np.unique(lens):
                rows = np.flatnonzero(lens == d)
                r = _rotate(np.stack(pdf["embedding"].iloc[rows].to_numpy()).astype(np.float64), axes)
                k = min(n_axes, int(d))
                out[rows[:, None], np.arange(k)[None, :]] = np.floor(r[:, :k] / width).astype(np.int64)
            yield pdf.assign(**{f"c{i}": out[:, i] for i in range(n_axes)})

    return run


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``."""
    bounded_batches(spark)
    rows = df.select(long_id(df, id_col).alias("id"), df[vec_col].alias("embedding"), df[label_col].alias("label"))
    e = F.col("embedding")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine = fine & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    valid = rows.where(F.coalesce(fine, F.lit(False)))
    classes = materialize(spark, valid.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    sample = [r[0] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").collect()]
    axes = fit_axes(sample)
    width = math.sqrt(max(2 - 2 * threshold, 0)) * (1 + 1e-6) + 1e-9
    cell_cols = [f"c{i}" for i in range(AXES)]
    schema = f"label {dict(classes.dtypes)['label']}, embedding {dict(classes.dtypes)['embedding']}, rep long, mult long, " + ", ".join(f"{c} long" for c in cell_cols)
    placed = materialize(spark, classes.mapInPandas(_cells(axes, width, AXES), schema).withColumn("len", F.size("embedding")))
    cell = ["label", "len", *cell_cols]
    tiles = placed.groupBy(*cell).agg(F.ceil(F.count("*") / TILE_ROWS).cast("long").alias("tiles"))
    # neighbouring cells, each pair once: offsets whose first non-zero is positive
    offsets = [o for o in _offsets(AXES) if o >= (0,) * AXES]
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)]) for o in offsets])).alias("o")
    here = tiles.select(*cell, F.col("tiles").alias("n_left"), shift)
    there = tiles.select(F.col("label").alias("_l"), F.col("len").alias("_n"), *[F.col(c).alias(f"_{c}") for c in cell_cols], F.col("tiles").alias("n_right"))
    on = (here["label"] == there["_l"]) & (here["len"] == there["_n"])
    for i, c in enumerate(cell_cols):
        on = on & (here[c] + here["o"][f"o{i}"] == there[f"_{c}"])
    near = here.join(there, on)
    same = F.lit(True)
    for c in cell_cols:
        same = same & (F.col(c) == F.col(f"_{c}"))
    seq = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pairs = near.select("*", same.alias("same"), F.explode(seq(F.col("n_left"))).alias("t_left")).select("*", F.explode(seq(F.col("n_right"))).alias("t_right"))
    pairs = pairs.where(~F.col("same") | (F.col("t_left") <= F.col("t_right")))
    pairs = pairs.withColumn("pair", F.xxhash64("label", "len", *cell_cols, "t_left", *[f"_{c}" for c in cell_cols], "t_right"))
    own = F.col("same") & (F.col("t_left") == F.col("t_right"))
    ends = pairs.select(
        "label", "len", "pair",
        F.explode(
            F.when(own, F.array(F.struct(*[F.col(c).alias(c) for c in cell_cols], F.col("t_left").alias("tile"), F.lit(2).alias("side")))).otherwise(
                F.array(
                    F.struct(*[F.col(c).alias(c) for c in cell_cols], F.col("t_left").alias("tile"), F.lit(0).alias("side")),
                    F.struct(*[F.col(f"_{c}").alias(c) for c in cell_cols], F.col("t_right").alias("tile"), F.lit(1).alias("side")),
                )
            )
        ).alias("end"),
    ).select("label", "len", "pair", "end.*")
    tiled = placed.join(tiles, cell).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    dealt = tiled.join(ends, [*cell, "tile"]).select("pair", "side", "rep", "mult", "embedding")
    found = materialize(spark, dealt.repartition("pair").sortWithinPartitions("pair").mapInPandas(_compare(axes, threshold), _FOUND))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("_r")).agg(F.sum("b").alias("links"))
    comp = components(spark, found.where("kind = 1").select("a", "b"))
    reps = (
        classes.join(counts, F.col("rep") == F.col("_r"), "left")
        .join(comp.select(F.col("id").alias("_i"), "component"), F.col("rep") == F.col("_i"), "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    members = valid.join(reps, ["label", "embedding"]).select("id", "links", "component")
    lone = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    discard(spark, placed)
    return members.union(lone).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _offsets(n: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(n):
        out = [(*o, v) for o in out for v in (-1, 0, 1)]
    return out

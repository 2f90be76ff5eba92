"""Clusters of similar haplotypes.

Which haplotypes link is decided without all pairs of a region.  A few pivots,
spread far apart among its most frequent haplotypes, are compared with every
haplotype.  Where ``d`` is the number of sites at which a haplotype differs from a
pivot and ``m`` the number that it misses, two haplotypes a and b differ at
``d(a) - d(b) - m(b)`` sites at least: what sets a apart from the pivot and not b
sets a apart from b, unless b misses it.  So groups of haplotypes of like
distances are set against each other only if no pivot tells them apart; those
that are, are cut in tiles of bounded size and compared exactly.  Missing sites
loosen the bound and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.alleles import MISSING
from locusframe.functions.text import natural_key, split_composite
from locusframe.sources.scratch import cut, discard

#: Haplotypes of a tile; regions of no more are compared whole.
TILE = 512
#: Pivots of a region at most, and the haplotypes among which they are sought.
PIVOTS, CANDIDATES = 64, 512
#: Shares of missing sites that part haplotypes of like distances.
LOST = (0.1, 0.25, 0.5)
#: Forest edges that one task may join to components.
WHOLE_EDGES = 500_000
#: Hashes of a sequence's tokens; 0 is a missing site.
_CODES = "array<bigint>"


def token_codes(seq: Column) -> Column:
    """Tokens as 64-bit hashes, a missing one as 0."""
    return F.transform(seq, lambda t: F.when(t == MISSING, F.lit(0).cast("long")).otherwise(F.xxhash64(t)))


def compared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sites called in both, differing ones) of all rows of x against all of y."""
    n, sites = len(x), x.shape[1]
    both = np.concatenate((x, y))
    # a column for each token of each site: equal tokens are a product of ones
    place = np.broadcast_to(np.arange(sites), both.shape)
    order = np.lexsort((both.ravel(), place.ravel()))
    code, site = both.ravel()[order], place.ravel()[order]
    fresh = np.concatenate(([True], (code[1:] != code[:-1]) | (site[1:] != site[:-1])))
    column = np.empty(both.size, np.int64)
    column[order] = np.cumsum(fresh) - 1
    called = both != 0
    ones = np.zeros((len(both), int(fresh.sum())), np.float32)
    rows = np.broadcast_to(np.arange(len(both))[:, None], both.shape)
    ones[rows[called], column.reshape(both.shape)[called]] = 1
    seen = called.astype(np.float32)
    common = seen[:n] @ seen[n:].T
    return common.astype(np.int64), (common - ones[:n] @ ones[n:].T).astype(np.int64)


def _shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances: the share of differing sites, 1 where no site is called in both."""
    if not x.shape[1]:
        return np.ones((len(x), len(y)))
    common, other = compared(x, y)
    return np.where(common > 0, other / np.maximum(common, 1), 1.0)


def _spread(threshold: float):
    """Pivots of one region: each as far as can be from those before it, until
    all candidates are within the threshold of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hap_rank"])
        codes = np.stack(pdf["codes"].to_list())
        apart = compared(codes, codes)[1]
        picked, least, near = [0], apart[0].copy(), max(threshold, 0) * codes.shape[1] / 2
        while len(picked) < PIVOTS and least.max() > near:
            picked.append(int(least.argmax()))
            least = np.minimum(least, apart[picked[-1]])
        return pd.DataFrame({"region_ord": pdf["region_ord"].iloc[:1], "pivots": [[codes[i].tolist() for i in picked]]})

    return run


def _placed(large: DataFrame, threshold: float) -> DataFrame:
    """(region_ord, hap, codes, sites, m, d, cell, ring): haplotypes by their pivots."""
    top = large.where(F.col("hap_rank") <= CANDIDATES)
    kind = dict(large.dtypes)["region_ord"]
    pivots = top.groupBy("region_ord").applyInPandas(_spread(threshold), f"region_ord {kind}, pivots array<{_CODES}>")
    apart = lambda p: F.aggregate(F.zip_with("codes", p, lambda a, b: F.when((a != 0) & (b != 0) & (a != b), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    near = large.join(pivots, "region_ord").select(
        "region_ord", "hap", "codes", F.size("codes").alias("sites"), F.size(F.filter("codes", lambda c: c == 0)).alias("m"), F.transform("pivots", apart).alias("d")
    )
    # a few rings around each pivot, and apart in each those that miss many sites, for
    # which the bound is loose: groups stay few, whatever the region
    width = F.greatest(F.lit(1.0), F.col("sites") * max(threshold, 0.05) / 2)
    lost = F.size(F.filter(F.lit(list(LOST)), lambda share: F.col("m") > F.col("sites") * share))
    ring = F.floor(F.array_min("d") / width).cast("int") * (len(LOST) + 1) + lost
    return near.withColumn("cell", F.array_position("d", F.array_min("d")).cast("int")).withColumn("ring", ring)


def _groups(placed: DataFrame) -> DataFrame:
    """Groups of haplotypes with the ranges of their distances."""
    key = ["region_ord", "cell", "ring"]
    found = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max("sites").alias("sites"), F.max("m").alias("m"))
    # a row for each pivot, combined before it is shuffled
    ends = placed.select(*key, F.posexplode("d").alias("i", "v")).groupBy(*key, "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("e"))
    return found.join(ends, key).select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), "n", "sites", "m", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))


def group_pairs(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs of groups, each once, that no pivot tells apart.

    A region has at most pivots times rings of them, whatever its haplotypes.
    """
    a = groups.select("region_ord", *[F.col(c).alias(f"a_{c}") for c in groups.columns if c != "region_ord"])
    b = groups.select("region_ord", *[F.col(c).alias(f"b_{c}") for c in groups.columns if c != "region_ord"])
    ordered = (F.col("a_cell") < F.col("b_cell")) | ((F.col("a_cell") == F.col("b_cell")) & (F.col("a_ring") <= F.col("b_ring")))
    most = F.col("a_sites") * F.lit(threshold) + 1e-6

    def beyond(x: str, y: str) -> Column:
        over = F.zip_with(f"{x}_lo", f"{y}_hi", lambda low, high: low - high - F.col(f"{y}_m") > most)
        return F.exists(over, lambda v: v)

    return a.join(b, "region_ord").where(ordered & ~beyond("a", "b") & ~beyond("b", "a"))


_DEALT = ("region_ord", "cell", "ring", "tile")


def _tile_pairs(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, side, region_ord, hap, codes): haplotypes dealt to pairs of tiles.

    side: 0 and 1 for the two tiles of a pair, 2 for a tile against itself.
    """
    tiles = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut_up = pairs.select("*", F.explode(tiles("a_tiles")).alias("a_tile")).select("*", F.explode(tiles("b_tiles")).alias("b_tile"))
    same_group = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_ring") == F.col("b_ring"))
    cut_up = cut_up.where(~same_group | (F.col("a_tile") <= F.col("b_tile")))
    end = lambda x, side: F.struct(F.col(f"{x}_cell").alias("cell"), F.col(f"{x}_ring").alias("ring"), F.col(f"{x}_tile").alias("tile"), F.lit(side).alias("side"))
    ends = F.when(same_group & (F.col("a_tile") == F.col("b_tile")), F.array(end("a", 2))).otherwise(F.array(end("a", 0), end("b", 1)))
    pair = F.concat_ws(",", "region_ord", "a_cell", "a_ring", "a_tile", "b_cell", "b_ring", "b_tile")
    dealt = cut_up.select("region_ord", pair.alias("pair"), F.explode(ends).alias("end")).select("region_ord", "pair", "end.*")
    counts = placed.groupBy("region_ord", "cell", "ring").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(counts, ["region_ord", "cell", "ring"]).withColumn("tile", F.pmod(F.xxhash64("hap"), F.col("tiles")).cast("int"))
    return tiled.join(dealt, list(_DEALT)).select("pair", "side", "region_ord", "hap", "codes")


def _solver(threshold: float, whole: bool):
    """All links of pairs of tiles, or a spanning forest of them."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        codes, hap, side = np.stack(p["codes"].to_list()), p["hap"].to_numpy(object), p["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        far = _shares(codes[left], codes[right])
        link = far <= threshold
        if side[0] == 2:
            link = np.triu(link, 1)
        i, j = np.nonzero(link)
        if not whole:
            keep = _spanning(left[i], right[j], len(p))
            i, j = i[keep], j[keep]
        one, two = hap[left[i]], hap[right[j]]
        low = one < two
        return pd.DataFrame({"region_ord": p["region_ord"].iloc[0], "hap1": np.where(low, one, two), "hap2": np.where(low, two, one), "distance": far[i, j]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []
        for pdf in it:
            for key, part in pdf.groupby("pair", sort=False):
                if key != now and parts:
                    yield solve(pd.concat(parts))
                    parts = []
                now = key
                parts.append(part)
        if parts:
            yield solve(pd.concat(parts))

    return run


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges that join what was not joined by edges before them."""
    up = np.arange(n)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def links(haps: DataFrame, threshold: float, whole: bool = True) -> DataFrame:
    """(region_ord, hap1, hap2, distance) of pairs up to the threshold, each
    once; or, if not ``whole``, enough of them to connect the same haplotypes."""
    coded = cut(haps.select("region_ord", "hap", "hap_rank", token_codes(F.col("seq")).alias("codes")))
    sizes = coded.groupBy("region_ord").agg(F.count("*").alias("n"))
    big = cut(sizes.where(F.col("n") > TILE).select("region_ord"))
    kind = dict(haps.dtypes)["region_ord"]
    if big.isEmpty():
        dealt = coded
    else:
        dealt = coded.join(big, "region_ord", "left_anti")
    # small regions are one tile each
    dealt = dealt.select(F.col("region_ord").cast("string").alias("pair"), F.lit(2).alias("side"), "region_ord", "hap", "codes")
    if not big.isEmpty():
        placed = cut(_placed(coded.join(big, "region_ord", "left_semi"), threshold))
        dealt = dealt.unionByName(_tile_pairs(placed, group_pairs(_groups(placed), threshold)))
    solved = dealt.repartition("pair").sortWithinPartitions("pair").mapInPandas(_solver(threshold, whole), f"region_ord {kind}, hap1 string, hap2 string, distance double")
    # tiles of groups are disjoint, so no pair is found twice
    return solved


def components(haps: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_ord, hap, root): the smallest haplotype text that edges reach.

    Few edges are joined by one task; of more, every end takes the least label
    around it, and that label's own, until nothing changes.
    """
    edges = cut(edges.select("region_ord", "hap1", "hap2"))
    kind = dict(haps.dtypes)["region_ord"]
    if edges.count() <= WHOLE_EDGES:
        roots = edges.coalesce(1).mapInPandas(_join_all, f"region_ord {kind}, hap string, root string")
        return haps.select("region_ord", "hap").join(roots, ["region_ord", "hap"], "left").withColumn("root", F.coalesce("root", "hap"))
    return _spread_labels(haps, edges)


def _join_all(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for pdf in it:
        for r, one, two in zip(pdf["region_ord"].tolist(), pdf["hap1"], pdf["hap2"], strict=True):
            a, b = root((r, one)), root((r, two))
            up[max(a, b)] = min(a, b)
    ends = [(*x, root(x)[1]) for x in list(up)]
    yield pd.DataFrame(ends, columns=["region_ord", "hap", "root"])


def _spread_labels(haps: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots by rounds; they grow with the logarithm of a component's length."""
    edges = cut(edges.union(edges.select("region_ord", F.col("hap2").alias("hap1"), F.col("hap1").alias("hap2"))))
    labels = cut(haps.select("region_ord", "hap", F.col("hap").alias("root")))
    while True:
        near = (
            edges.join(labels.select("region_ord", F.col("hap").alias("hap2"), "root"), ["region_ord", "hap2"]).groupBy("region_ord", F.col("hap1").alias("hap")).agg(F.min("root").alias("low"))
        )
        step = labels.join(near, ["region_ord", "hap"], "left").select("region_ord", "hap", F.least("root", F.coalesce("low", "root")).alias("next"), "root")
        jump = step.select("region_ord", F.col("hap").alias("next"), F.col("next").alias("far"))
        new = cut(step.join(jump, ["region_ord", "next"], "left").select("region_ord", "hap", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")))
        discard(labels)
        labels = new
        if new.where("root <> old").isEmpty():
            discard(edges)
            return labels.drop("old")


def clusters(haps: DataFrame, threshold: float) -> DataFrame:
    """(region_ord, hap, cluster); labels follow text order of the ids."""
    roots = components(haps, links(haps, threshold, whole=False))
    order = Window.partitionBy("region_ord").orderBy("root")
    return roots.withColumn("cluster", F.concat(F.lit("HapC"), F.dense_rank().over(order).cast("string"))).drop("root")


def consensus_tokens(haps: DataFrame, member: DataFrame, sites: DataFrame) -> DataFrame:
    """(region_ord, cluster, site_ord, token): all parts, natural order."""
    tokens = haps.join(member, ["region_ord", "hap"]).select("region_ord", "cluster", F.posexplode("seq").alias("at", "token"))
    place = Window.partitionBy("region_ord").orderBy("site_ord")
    numbered = sites.select("region_ord", "site_ord", (F.row_number().over(place) - 1).alias("at"))
    parts = tokens.join(numbered, ["region_ord", "at"]).select("region_ord", "cluster", "site_ord", F.explode_outer(split_composite(F.col("token"))).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("part").isNotNull(), F.struct(natural_key(F.col("part")).alias("k"), "part")))), lambda s: s["part"]), "/")
    out = parts.groupBy("region_ord", "cluster", "site_ord").agg(joined.alias("token"))
    return out.withColumn("token", F.when(F.col("token") == "", "N").otherwise(F.col("token")))


def cluster_sizes(of_copies: DataFrame, member: DataFrame, once: bool = False) -> DataFrame:
    """G1: distinct samples over the haplotypes of a cluster.

    With ``once`` a sample has one copy a region: copies are counted where they are,
    and no names are shuffled.
    """
    n = F.count("sample") if once else F.countDistinct("sample")
    return of_copies.join(member, ["region_ord", "hap"]).groupBy("region_ord", "cluster").agg(n.alias("n"))

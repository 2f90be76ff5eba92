"""Classes of samples against groups and traits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.ranges import cumulated
from locusframe.functions.statistics import benjamini_hochberg, chi_square_tail, exact_rank_sum_p, normal_two_sided
from locusframe.functions.text import significance
from locusframe.sources.scratch import cut

EXACT_SIZE = 8

# fixed values: reasons as reports give them
FEW_CLASSES = "fewer than two classes with numeric trait values"
EMPTY_CLASS = "one or both classes have no numeric trait values"


def class_counts(df: DataFrame, cls: str, within: list[str], min_count: int = 1) -> DataFrame:
    """(within, cls, n, ord): classes by size, ties by name."""
    order = Window.partitionBy(*within).orderBy(F.desc("n"), cls)
    return df.groupBy(*within, cls).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).withColumn("ord", F.row_number().over(order))


def crosstab(df: DataFrame, cls: str, group: str, within: list[str], min_count: int = 1) -> DataFrame:
    """Every group by every shown class with count and share."""
    # the only pass over the rows; written, so that its true size is known, and few
    # classes are broadcast
    every = cut(df.groupBy(*within, group, cls).agg(F.count("*").alias("n")))
    order = Window.partitionBy(*within).orderBy(F.desc("size"), cls)
    sizes = every.groupBy(*within, cls).agg(F.sum("n").alias("size")).where(F.col("size") >= min_count)
    shown = sizes.withColumn("ord", F.row_number().over(order)).drop("size")
    counts = every.join(shown.drop("ord"), [*within, cls], "left_semi")
    cells = counts.select(*within, group).distinct().join(shown, within)
    total = Window.partitionBy(*within, group)
    return (
        cells.join(counts, [*within, group, cls], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("share", F.col("n") / F.sum("n").over(total))
    )


def pie_slices(table: DataFrame, group: str, within: list[str]) -> DataFrame:
    """Slices above zero; a label from four percent on."""
    pct = F.col("share") * 100
    return table.where("n > 0").withColumn("pct", pct).withColumn("label", F.when(pct >= 4, F.format_string("%.1f%%", pct)).otherwise(""))


def long_traits(df: DataFrame, cls: str, names: list[str], within: list[str], min_count: int = 1, counted: DataFrame | None = None) -> DataFrame:
    """(within, trait, cls, ord, value) of shown classes.

    ``counted`` are rows of the same classes without traits, where counting those is cheaper.
    """
    # written, so that few classes are broadcast: no task takes all rows of a class
    shown = cut(class_counts(df if counted is None else counted, cls, within, min_count).drop("n"))
    kept = df.join(shown, [*within, cls])
    kinds = dict(df.dtypes)
    # numbers need not go through text
    number = lambda n: F.col(n).cast("double") if kinds.get(n) in ("double", "bigint", "int") else F.col(n).cast("string").try_cast("double")
    cols = [F.struct(F.lit(n).alias("trait"), F.lit(i).alias("trait_ord"), number(n).alias("value")) for i, n in enumerate(names)]
    values = kept.select(*within, F.col(cls).alias("cls"), "ord", F.explode(F.array(*cols)).alias("t")).select(*within, "cls", "ord", "t.*")
    return values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def average_ranks(live: DataFrame, keys: list[str], times: Column | None = None) -> DataFrame:
    """(keys, value, t, r): each distinct value, how often, and its mean rank."""
    return cumulated(live, keys, times).select(*keys, "value", "t", (F.col("before") + (F.col("t") + 1) / F.lit(2.0)).alias("r"))


def kruskal(values: DataFrame, within: list[str]) -> DataFrame:
    """(within, trait, trait_ord, n, k, h, pvalue, skipped)."""
    keys = [*within, "trait", "trait_ord"]
    # the only pass over the values: a row for each class and distinct value
    every = cut(values.groupBy(*keys, "cls", "value").agg(F.count("*").alias("c")))
    counts = every.where("value is not null")
    ranks = average_ranks(counts, keys, F.sum("c"))
    by_class = counts.join(ranks, [*keys, "value"]).groupBy(*keys, "cls").agg(F.sum(F.col("r") * F.col("c")).alias("rs"), F.sum("c").alias("n"))
    sums = by_class.groupBy(*keys).agg(F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").cast("int").alias("k"))
    t = F.col("t").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    plain = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    even = 1 - F.col("ties") / (n * n * n - n)
    out = sums.join(ties, keys).withColumn("even", F.when(F.col("n") > 1, even).otherwise(0.0))
    h = F.when((F.col("k") >= 2) & (F.col("even") > 0), plain / F.col("even"))
    out = out.withColumn("h", h).withColumn("pvalue", F.when(F.col("h").isNotNull(), chi_square_tail(F.coalesce("h", F.lit(0.0)), F.col("k") - 1)))
    reason = F.when(F.col("k") < 2, FEW_CLASSES).when(F.col("h").isNull(), "Kruskal-Wallis failed: all values are the same").otherwise("")
    have = out.select(*keys, "n", "k", "h", "pvalue", reason.alias("skipped"))
    # traits without any value are reported too
    return every.select(*keys).distinct().join(have, keys, "left").na.fill({"n": 0, "k": 0, "skipped": FEW_CLASSES})


def pairwise(values: DataFrame, within: list[str]) -> DataFrame:
    """Every pair of classes, in display order.

    (within, trait, trait_ord, class1, class2, n1, n2, mean1, mean2, u, z,
    pvalue, padj, skipped).  Without ties and with a side of at most eight
    values the p-value is exact, else normal with tie and continuity
    correction; adjustment is within a trait.
    """
    keys = [*within, "trait", "trait_ord"]
    stats = values.groupBy(*keys, "cls", "ord").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    a = stats.select(*keys, F.col("cls").alias("class1"), F.col("ord").alias("ord1"), F.col("n").alias("n1"), F.col("mean").alias("mean1"))
    b = stats.select(*keys, F.col("cls").alias("class2"), F.col("ord").alias("ord2"), F.col("n").alias("n2"), F.col("mean").alias("mean2"))
    pairs = a.join(b, keys).where("ord1 < ord2")
    sums = _rank_sums(values.where("value is not null"), keys)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("u2x") / 2.0
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    out = pairs.join(sums, [*keys, "ord1", "ord2"], "left").withColumn("u", F.when(both, F.greatest(u1, n1 * n2 - u1)))
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    out = out.withColumn("z", F.when(both & (var > 0), (F.col("u") - n1 * n2 / 2 - 0.5) / F.sqrt(var)))
    exact = both & (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_SIZE)
    small = out.where(exact).withColumn("pvalue", exact_rank_sum_p(F.col("n1"), F.col("n2"), F.col("u")))
    large = out.where(~F.coalesce(exact, F.lit(False))).withColumn("pvalue", F.when(F.col("z").isNotNull(), normal_two_sided(F.coalesce("z", F.lit(0.0)))))
    whole = small.unionByName(large).withColumn("pvalue", F.when(both & F.col("pvalue").isNull(), 1.0).otherwise(F.col("pvalue")))
    reason = F.when(both, "").otherwise(EMPTY_CLASS)
    adjusted = benjamini_hochberg(whole, "pvalue", "padj", keys).withColumn("skipped", reason)
    return adjusted.drop("u2x", "ties")


def _rank_sums(live: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord1, ord2, u2x, ties) of every pair of classes, from one sorted pass.

    U of a class against another is, over its values, how many of the other's lie
    below and half of those that are equal (``u2x`` is twice that).  The pass keeps
    how many values each class has had so far; so a distinct value of a class is
    one row, however many classes it is compared with.  Each range part adds up
    its own, and for parts before it only the classes' totals count.
    """
    counts = live.groupBy(*keys, "value", "ord").agg(F.count("*").alias("c"))
    rows = counts.groupBy(*keys, "value").agg(F.collect_list(F.struct("ord", "c")).alias("cs"))
    # groups are told apart by a text of their keys, which stand beside it
    named = rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_g"), "value", F.col("cs.ord").alias("ords"), F.col("cs.c").alias("cs"))
    schema = "_g string, part int, ord1 int, ord2 int, n long, below long, cubes double"
    found = cut(named.repartitionByRange("_g", "value").sortWithinPartitions("_g", "value").mapInPandas(_pass, schema))
    own, inside = found.where("ord2 is null"), found.where("ord2 is not null")
    # all classes in all parts of a group, with how many of each lie in the parts before
    every = own.select("_g", "part").distinct().join(own.select("_g", F.col("ord1").alias("ord2")).distinct(), "_g")
    there = every.join(own.select("_g", "part", F.col("ord1").alias("ord2"), F.col("n").alias("n2")), ["_g", "part", "ord2"], "left")
    earlier = Window.partitionBy("_g", "ord2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = there.select("_g", "part", "ord2", F.coalesce(F.sum("n2").over(earlier), F.lit(0)).alias("lower"))
    across = own.select("_g", "part", "ord1", "n").join(before, ["_g", "part"]).where("ord1 < ord2")
    none = F.lit(0.0).alias("cubes")
    both = across.select("_g", "ord1", "ord2", (2 * F.col("n") * F.col("lower")).alias("below"), none).unionByName(inside.select("_g", "ord1", "ord2", "below", "cubes"))
    sums = both.groupBy("_g", "ord1", "ord2").agg(F.sum("below").alias("u2x"), F.sum("cubes").alias("mixed"))
    alone = own.groupBy("_g", "ord1").agg((F.sum("cubes") - F.sum("n")).alias("t"))
    one, two = alone.withColumnRenamed("t", "t1"), alone.select("_g", F.col("ord1").alias("ord2"), F.col("t").alias("t2"))
    groups = live.select(*keys).distinct().withColumn("_g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    whole = sums.join(one, ["_g", "ord1"]).join(two, ["_g", "ord2"]).join(groups, "_g")
    return whole.select(*keys, "ord1", "ord2", "u2x", (F.col("mixed") + F.col("t1") + F.col("t2")).alias("ties"))


#: Distinct values that are added up at once.
_AT_ONCE = 2048


def _pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each group's part over its sorted values: of its classes (ord2 null;
    how many values, and the cubes of their counts), and of its pairs of classes."""
    now, of, state = None, {}, None

    def widened(a: np.ndarray, k: int) -> np.ndarray:
        return np.pad(a, [(0, k - n) for n in a.shape])

    def add(ords: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """The next values, as a matrix of their counts by class."""
        nonlocal state
        flat = np.concatenate(ords)
        for o in np.unique(flat).tolist():
            of.setdefault(o, len(of))
        k = len(of)
        seen, below, cubes, mixed = (widened(x, k) for x in state)
        c = np.zeros((len(ords), k), np.int64)
        c[np.repeat(np.arange(len(ords)), [len(o) for o in ords]), [of[o] for o in flat.tolist()]] = np.concatenate(counts)
        upto = np.cumsum(c, axis=0)
        below = below + c.T @ (2 * (seen + upto) - c)
        size = c.astype(np.float64)
        state = seen + upto[-1], below, cubes + (size**3).sum(axis=0), mixed + (size * size).T @ size

    def done() -> pd.DataFrame:
        seen, below, cubes, mixed = state
        ords, k = np.array(list(of), np.int64), len(of)
        i, j = np.nonzero(ords[:, None] < ords[None, :])
        head = {"_g": now, "part": TaskContext.get().partitionId()}
        own = pd.DataFrame(head | {"ord1": ords, "ord2": pd.array([None] * k, "Int64"), "n": seen, "below": 0, "cubes": cubes})
        pairs = pd.DataFrame(head | {"ord1": ords[i], "ord2": pd.array(ords[j], "Int64"), "n": 0, "below": below[i, j], "cubes": 3 * (mixed[i, j] + mixed[j, i])})
        return pd.concat([own, pairs])

    for pdf in it:
        for g, part in pdf.groupby("_g", sort=False):
            if g != now:
                if now is not None:
                    yield done()
                now, of = g, {}
                state = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros(0), np.zeros((0, 0))
            ords, counts = part["ords"].to_list(), part["cs"].to_list()
            for at in range(0, len(ords), _AT_ONCE):
                add(ords[at : at + _AT_ONCE], counts[at : at + _AT_ONCE])
    if now is not None:
        yield done()


def report(values: DataFrame, within: list[str], level: str) -> DataFrame:
    """Overall and pairwise rows in one table."""
    keys = [*within, "trait", "trait_ord"]
    overall = kruskal(values, within).select(
        *keys, F.lit(level).alias("PlotLevel"), F.lit("overall").alias("ComparisonType"), F.lit("ALL").alias("Class1"), F.lit("").alias("Class2"),
        F.lit(0).alias("ord1"), F.lit(0).alias("ord2"), F.col("n").cast("long").alias("N1"), F.lit(None).cast("long").alias("N2"),
        F.lit(None).cast("double").alias("Mean1"), F.lit(None).cast("double").alias("Mean2"), F.lit("Kruskal-Wallis").alias("Test"), "pvalue",
        F.col("pvalue").alias("padj_BH"), significance(F.col("pvalue")).alias("Significance"), F.col("skipped").alias("SkippedReason"),
    )
    pairs = pairwise(values, within).select(
        *keys, F.lit(level).alias("PlotLevel"), F.lit("pairwise").alias("ComparisonType"), F.col("class1").alias("Class1"), F.col("class2").alias("Class2"),
        "ord1", "ord2", F.col("n1").alias("N1"), F.col("n2").alias("N2"), F.col("mean1").alias("Mean1"), F.col("mean2").alias("Mean2"),
        F.lit("two-sided Mann-Whitney U").alias("Test"), "pvalue", F.col("padj").alias("padj_BH"), significance(F.col("padj")).alias("Significance"),
        F.col("skipped").alias("SkippedReason"),
    )
    return overall.unionByName(pairs)


def top_annotations(table: DataFrame, within: list[str], most: int = 10) -> DataFrame:
    """The first significant pairs of each trait."""
    order = Window.partitionBy(*within, "trait").orderBy("padj_BH", "pvalue", "ord1", "ord2")
    shown = table.where("ComparisonType = 'pairwise' and padj_BH <= 0.05")
    return shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def jitter_points(values: DataFrame, seed: int = 42) -> DataFrame:
    """Every value beside its class, moved sideways by a little seeded noise."""
    return values.where("value is not null").withColumn("x", F.col("ord") + 0.035 * F.randn(seed))


def box_stats(values: DataFrame, within: list[str]) -> DataFrame:
    """Quartiles, and whiskers at the last value within 1.5 ranges."""
    keys = [*within, "trait", "cls"]
    live = values.where("value is not null")
    # the values at the ranks on either side of each quartile
    places = [F.lit(share) * (F.col("total") - 1) for share in (0.25, 0.5, 0.75)]
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("t")), F.col("value")))
    sides = [at(side(p)).alias(f"{name}{i}") for i, p in enumerate(places) for name, side in (("low", F.floor), ("high", F.ceil))]
    # the only pass over the values: a row for each class and distinct value
    counted = cumulated(live, keys)
    found = counted.groupBy(*keys).agg(F.max("total").alias("n"), *sides)

    def between(i: int, share: float) -> Column:
        place = F.lit(share) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col(f"low{i}")).otherwise((high - place) * F.col(f"low{i}") + (place - low) * F.col(f"high{i}"))

    quart = found.select(*keys, "n", *[between(i, share).alias(q) for i, (q, share) in enumerate((("q1", 0.25), ("med", 0.5), ("q3", 0.75)))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = counted.join(quart, keys).groupBy(*keys, "n", "q1", "med", "q3").agg(
        F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("high")
    )
    return ends.withColumn("whislo", F.least("low", "q1")).withColumn("whishi", F.greatest("high", "q3")).drop("low", "high")

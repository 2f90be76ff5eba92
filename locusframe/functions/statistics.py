"""Exact and asymptotic tests as expressions and windows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.functions import ranges
from locusframe.sources.scratch import cut

TIE_SLACK = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """two-sided p-value of a 2x2 table; 1 for an empty one.

    Tables as likely as the observed one, within an absolute slack, count.
    Three passes over the possible tables (greatest log weight, their total,
    the sum of those that count) carry a running log weight, so time and space
    (the list of tables) are linear in the number of tables.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    r1, r2, k = a + b, c + d, a + c
    lo = F.greatest(F.lit(0.0), k - r2)
    hi = F.least(r1, k)
    steps = F.when(hi > lo, F.sequence(lo.cast("long"), (hi - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    margins = F.struct(r1.alias("r1"), r2.alias("r2"), k.alias("k"), lo.alias("lo"), a.alias("a"), steps.alias("steps"))

    def solve(m: Column) -> Column:
        def weight(y: Column) -> Column:
            return F.log(((m["r1"] - y) * (m["k"] - y)) / ((y + 1.0) * (m["r2"] - m["k"] + y + 1.0)))

        start = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("top"), F.lit(0.0).alias("seen"))
        peak = F.aggregate(
            m["steps"],
            start,
            lambda s, y: let(
                s["now"] + weight(y),
                lambda w: F.struct(w.alias("now"), F.greatest(s["top"], w).alias("top"), F.when(y + 1.0 == m["a"], w).otherwise(s["seen"]).alias("seen")),
            ),
        )

        def over(top: Column, take: Callable[[Column], Column]) -> Column:
            """Sum of what is taken of each table's weight relative to the top."""
            first = F.struct(F.lit(0.0).alias("now"), take(F.exp(-top)).alias("sum"))
            return F.aggregate(
                m["steps"], first, lambda s, y: let(s["now"] + weight(y), lambda w: F.struct(w.alias("now"), (s["sum"] + take(F.exp(w - top))).alias("sum")))
            )["sum"]

        return let(
            peak,
            lambda q: let(
                over(q["top"], lambda v: v),
                lambda total: let(
                    F.exp(q["seen"] - q["top"]) / total, lambda seen: over(q["top"], lambda v: let(v / total, lambda p: F.when(p <= seen + TIE_SLACK, p).otherwise(0.0)))
                ),
            ),
        )

    return F.when(a + b + c + d == 0, F.lit(1.0)).otherwise(F.least(let(margins, solve), F.lit(1.0)))


def benjamini_hochberg(df: DataFrame, p: str, out: str, within: list[str]) -> DataFrame:
    """Adjusted p-values within groups; null p-values stay out and null.

    Equal p-values are equal after it.  Of many tests the distinct p-values are
    ranked over range parts, and the least value from a rank on is that of its
    part from there and of the parts behind.
    """
    rows = cut(df)
    if rows.count() <= ranges.WHOLE:
        return _adjusted_whole(rows, p, out, within)
    dealt = ranges.dealt(rows.where(F.col(p).isNotNull()).groupBy(*within, F.col(p).alias("_p")).agg(F.count("*").alias("_t")), *within, "_p")
    parts = ranges.before_parts(dealt, within, F.sum("_t"))
    upto = Window.partitionBy(*within, "part").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.join(parts, [*within, "part"]).withColumn("_v", F.col("_p") * F.col("total") / (F.col("before") + F.sum("_t").over(upto)))
    later = Window.partitionBy(*within).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    behind = own.groupBy(*within, "part").agg(F.min("_v").alias("_low")).select(*within, "part", F.min("_low").over(later).alias("_behind"))
    down = Window.partitionBy(*within, "part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.least(F.min("_v").over(down), "_behind", F.lit(1.0))
    found = own.join(behind, [*within, "part"]).select(*[F.col(k).alias(f"_k_{k}") for k in within], "_p", least.alias(out))
    on = rows[p] == F.col("_p")
    for k in within:
        on = on & (rows[k] == F.col(f"_k_{k}"))
    return rows.join(found, on, "left").select(*df.columns, out)


def _adjusted_whole(df: DataFrame, p: str, out: str, within: list[str]) -> DataFrame:
    live = F.col(p).isNotNull()
    keys = [*within, "_live"]
    up = Window.partitionBy(*keys).orderBy(F.col(p), F.monotonically_increasing_id())
    whole = Window.partitionBy(*keys)
    down = Window.partitionBy(*keys).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("_live", live).withColumn("_rank", F.row_number().over(up)).withColumn("_n", F.count(p).over(whole))
    adjusted = F.least(F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down), F.lit(1.0))
    return ranked.withColumn(out, F.when(live, adjusted)).drop("_live", "_rank", "_n")


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; reached by one row per test only."""
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(v))


@F.pandas_udf(T.DoubleType())
def exact_rank_sum_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of U without ties, by counting rank subsets.

    The counts of each U are the coefficients of the Gaussian binomial: one factor
    for each value of the smaller side, in whole numbers, so time is that side
    times the number of values of U.
    """

    def one(a: float, b: float, big: float) -> float | None:
        if any(v is None or math.isnan(v) for v in (a, b, big)):
            return None
        n, m = sorted((int(a), int(b)))
        ways = np.zeros(n * m + 1, object)
        ways[0] = 1
        for k in range(1, n + 1):
            # times (1 - q^(m + k)), over (1 - q^k)
            ways[m + k :] -= ways[: max(0, n * m + 1 - m - k)].copy()
            for first in range(k):
                ways[first::k] = np.add.accumulate(ways[first::k])
        upper = int(ways[int(math.ceil(big)) :].sum())
        return min(1.0, 2 * upper / math.comb(n + m, n))

    return pd.Series([one(*v) for v in zip(n1, n2, u, strict=True)], dtype="float64")


def chi_square_tail(h: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    half = h / 2.0
    even_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest((df / 2).cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, i: F.struct(
            (s["sum"] + F.when(i < (df / 2).cast("int"), s["term"] * half / i).otherwise(0.0)).alias("sum"), (s["term"] * half / i).alias("term")
        ),
    )["sum"]
    m = ((df - 1) / 2).cast("int")
    first = F.sqrt(half) * (2.0 / math.sqrt(math.pi))
    odd_terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        F.struct(F.lit(0.0).alias("sum"), first.alias("term")),
        lambda s, i: F.struct((s["sum"] + F.when(i <= m, s["term"]).otherwise(0.0)).alias("sum"), (s["term"] * half / (i + F.lit(0.5))).alias("term")),
    )["sum"]
    even = F.exp(-half) * even_terms
    odd = erfc(F.sqrt(half)) + F.exp(-half) * odd_terms
    return F.when(h <= 0, 1.0).when(F.pmod(df, F.lit(2)) == 0, even).otherwise(odd)


def normal_two_sided(z: Column) -> Column:
    """min(1, 2 P(Z > z))."""
    return F.least(F.lit(1.0), erfc(z / math.sqrt(2)))

"""Joins of intervals by bins of several widths.

An interval is put in the bins that it covers, of the narrowest width at which
these are few, and of every wider one.  Two intervals meet in the bins of the wider
of their own widths, and of these only in the one where both have begun, so each
pair is found once.  A key is a bin, not a whole chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a place inside a bin, for each width; the last one covers everything.
WIDTHS = (14, 17, 20, 23, 26, 29, 32, 62)
#: Bins of its own width that an interval covers at most, less one.
FEW = 8


def _binned(df: DataFrame, start: Column, stop: Column, tag: str) -> DataFrame:
    """Rows with ``_width`` and ``_bin`` of all their bins, and their own width and start."""
    low, high = F.least(start, stop), F.greatest(start, stop)
    own = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        own = F.when(F.shiftright(high, w) - F.shiftright(low, w) <= FEW, F.lit(w)).otherwise(own)
    named = df.withColumns({f"_low{tag}": low, f"_high{tag}": high, f"_own{tag}": own}).where(F.col(f"_low{tag}").isNotNull() & F.col(f"_high{tag}").isNotNull())
    wide = named.withColumn("_width", F.explode(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w >= F.col(f"_own{tag}"))))
    bins = F.sequence(F.call_function("shiftright", f"_low{tag}", "_width"), F.call_function("shiftright", f"_high{tag}", "_width"))
    return wide.withColumn("_bin", F.explode(bins)).drop(f"_high{tag}")


def overlapping(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Rows of a beside those of b with equal keys whose intervals overlap, ends included.

    Columns of the two have different names.  Rows without a place match nothing.
    """
    x = _binned(a, F.col(a_ends[0]), F.col(a_ends[1]), "1")
    y = _binned(b, F.col(b_ends[0]), F.col(b_ends[1]), "2").withColumnRenamed("_width", "_width2").withColumnRenamed("_bin", "_bin2")
    on = (F.col("_width") == F.col("_width2")) & (F.col("_bin") == F.col("_bin2"))
    for k, q in keys:
        on = on & (x[k] == y[q])
    met = x.join(y, on).where(
        (F.col("_width") == F.greatest("_own1", "_own2"))
        & (F.col("_bin") == F.call_function("shiftright", F.greatest("_low1", "_low2"), F.col("_width")))
        & (F.col(a_ends[1]) >= F.col(b_ends[0])) & (F.col(a_ends[0]) <= F.col(b_ends[1]))
    )
    return met.select(*a.columns, *b.columns)

"""Order within a group without a task that holds the group.

Rows are dealt out by range; what lies before a row is what precedes it in its
part and the totals of the parts before, and these totals are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.sources.scratch import cut

#: Rows that windows over whole groups may take; of more, parts are ordered.
WHOLE = 200_000


def dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows by range of ``order``, with the number of their ``part``; written once."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def before_parts(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, part, before, total): sizes of the earlier parts of a group, and of all."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "part").agg(size.alias("size"))
    return sizes.select(*keys, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(*keys)).alias("total"))


def cumulated(live: DataFrame, keys: list[str], times: Column | None = None) -> DataFrame:
    """(keys, value, t, before, total): each distinct value, how often it stands
    (rows, or the sum ``times``), how many lie before it, and how many there are."""
    times = F.count("*") if times is None else times
    rows = dealt(live.groupBy(*keys, "value").agg(times.alias("t")), *keys, "value")
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before_parts(rows, keys, F.sum("t")), [*keys, "part"])
    return joined.select(*keys, "value", "t", (F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0))).alias("before"), "total")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Rows with their number from one within their group."""
    rows = cut(df)
    if rows.count() <= WHOLE:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = dealt(rows, *[F.col(k) for k in keys], *order)
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    joined = rows.join(before_parts(rows, keys, F.count("*")), [*keys, "part"])
    return joined.withColumn(out, (F.col("before") + F.row_number().over(inside)).cast("int")).select(*df.columns, out)

"""Variant text as a stream of encoded sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources import readers


def stream_sites(spark: SparkSession, folder: str, regions: DataFrame) -> DataFrame:
    """Sites of the regions from every variant text that arrives in a folder.

    The regions are a small static table; no state is kept.
    """
    lines = spark.readStream.text(folder).select(F.regexp_replace("value", "\r$", "").alias("line"), F.xxhash64("value").alias("ord"))
    return readers.sites_of(readers.in_regions(readers.parse_records(lines), regions))

"""Intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a folder of its own;
    a cluster raises ``ValueError``.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "locusframe-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[DataFrame] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes the tables of ``cut`` made inside, when nothing reads them any more."""
    have = len(_MADE)
    try:
        yield
    finally:
        for df in _MADE[have:]:
            discard(df)
        del _MADE[have:]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    It is computed once and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    _MADE.append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``cut`` that no later plan reads."""
    path = getattr(df, "_lf_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

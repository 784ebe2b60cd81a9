"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``base``: a file or a folder of files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def micros(ts) -> F.Column:
    """Epoch microseconds of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))

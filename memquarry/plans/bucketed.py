"""Bucketed tables without a catalog: a folder per write, any set of folders as one table.

Every write divides its rows by the hash of some columns into the same number of
buckets, so rows with equal columns lie in files of one bucket, whichever write they
came with. A scan over several folders gives each bucket to one task: what groups by
these columns needs no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, path: str, buckets: int, by: list[str], order: list[str]) -> None:
    """Writes each bucket in the given order. Rows move to their bucket's task first, and
    AQE splits a bucket that is far larger than others, which then has several files."""
    name = f"memquarry_{uuid.uuid4().hex}"
    moved = rows.hint("rebalance", buckets, *[F.col(c) for c in by])
    moved.write.format("parquet").bucketBy(buckets, *by).sortBy(*order).option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the name only; the files stay


def read(spark: SparkSession, paths: list[str], schema: str, buckets: int, by: list[str], order: list[str]) -> DataFrame:
    """The folders (or files) as one bucketed table."""
    jvm = spark.sparkContext._jvm
    seq = jvm.PythonUtils.toSeq
    session, package = spark._jsparkSession, jvm.org.apache.spark.sql
    spec = package.catalyst.catalog.BucketSpec(buckets, seq(by), seq(order))
    some = jvm.scala.Some
    source = package.execution.datasources.DataSource(session, "parquet", seq(paths), some(package.types.StructType.fromDDL(schema)), seq([]), some(spec), jvm.PythonUtils.toScalaMap({}), jvm.scala.Option.empty())
    return DataFrame(session.baseRelationToDataFrame(source.resolveRelation(False, False)), spark)


def large_files(spark: SparkSession, paths: list[str], most: int) -> tuple[list[str], list[str]]:
    """The files of buckets with more than ``most`` bytes in all folders, and the others.
    Sizes are summed where the files are listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select("path", "length")
    files = files.withColumn("bucket", F.regexp_extract("path", r"_([0-9]+)(?:\.c[0-9]+)?[^/]*$", 1))
    sizes = files.groupBy("bucket").agg(F.sum("length").alias("bytes"))
    rows = files.join(sizes, "bucket").select("path", (F.col("bytes") > most).alias("large")).collect()
    return sorted(r["path"] for r in rows if r["large"]), sorted(r["path"] for r in rows if not r["large"])

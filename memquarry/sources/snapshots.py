"""Snapshots with a pointer, and backups with a manifest.

A snapshot is a folder ``seq=N``; the pointer names the one to read and is written
last, so a snapshot that was cut off is never read. A backup is a copy with a
manifest of sizes and digests; it is checked before anything is put in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(state: DataFrame, path: str, seq: int, keep_tenants_apart: bool = True) -> None:
    writer = state.write.mode("overwrite")
    if keep_tenants_apart:
        writer = writer.partitionBy("tenant_id")
    writer.parquet(f"{path}/seq={seq}")
    state.sparkSession.createDataFrame([(seq,)], "seq bigint").coalesce(1).write.mode("append").json(f"{path}/_pointer")


def current_seq(spark: SparkSession, path: str) -> int:
    """The newest snapshot that was finished."""
    found = spark.read.schema("seq bigint").json(f"{path}/_pointer").agg(F.max("seq")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return found


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    seq = current_seq(spark, path)
    return spark.read.parquet(f"{path}/seq={seq}"), seq


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, digest) of the data files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))


def backup(spark: SparkSession, source: str, target: str) -> None:
    """Copies the files and writes their manifest beside them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target + "/data")
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{source} could not be copied")
    manifest(spark, source).write.mode("errorifexists").json(target + "/manifest")


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """Files of a backup that are missing, changed or were never listed."""
    listed = spark.read.schema("name string, length bigint, digest string").json(target + "/manifest").withColumnRenamed("digest", "listed").select("name", "listed")
    found = manifest(spark, target + "/data").select("name", "digest")
    return listed.join(found, "name", "full_outer").where(~F.col("listed").eqNullSafe(F.col("digest")))


def restore(spark: SparkSession, target: str) -> DataFrame:
    """The data of a backup, after it has been checked."""
    bad = damaged(spark, target).limit(1).collect()
    if bad:
        raise ValueError(f"backup is damaged: {bad[0]['name']}")
    return spark.read.parquet(target + "/data")

"""Streams over the engine's tables: the change feed into a store, consumer groups,
time windows.

Each runs on what has arrived and ends (``availableNow``), or goes on if given
another trigger; its checkpoint lies in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators.change_store import ChangeStore
from memquarry.plans.scratch import new_path

NOW = {"availableNow": True}


def table_stream(spark: SparkSession, base: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{base}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def follow(feed: DataFrame, store: ChangeStore, trigger: dict | None = None, checkpoint: str | None = None) -> ChangeStore:
    """Appends a feed to a store, a run per batch. How far the feed has been read is kept
    in ``checkpoint``, a folder of the store if not given, so a feed that is followed again
    goes on where it was. A batch that is repeated after a failure leaves the state as it
    was: applying a change twice does nothing."""
    q = feed.writeStream.foreachBatch(lambda batch, _: store.append(batch)).option("checkpointLocation", checkpoint or f"{store.path}/followed").trigger(**(trigger or NOW)).start()
    q.awaitTermination()
    return store


def consumer_group(entries: DataFrame, trigger: dict | None = None, folder: str | None = None) -> DataFrame:
    """(stream, cursor, delivered, n_pending) of a group on each stream after all (stream,
    entry, acked): entries are delivered once, in order; what is not acknowledged in any
    row stays pending.

    The state is kept by entry, not by stream: a stream with most of the entries is spread
    over all tasks, and its rows are combined before the shuffle. ``folder`` keeps state
    and results from one call to the next."""
    spark = entries.sparkSession
    folder = folder or new_path(spark, "groups")
    seen = entries.groupBy("stream", "entry").agg(F.bool_or("acked").alias("acked"))
    put = lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/entries/batch={i}")
    q = seen.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or NOW)).start()
    q.awaitTermination()
    kind = ", ".join(f"{c} {t}" for c, t in entries.select("stream", "entry", "acked").dtypes)
    last = spark.read.schema(kind).parquet(f"{folder}/entries").groupBy("stream", "entry").agg(F.bool_or("acked").alias("acked"))
    return last.groupBy("stream").agg(F.max("entry").alias("cursor"), F.count(F.lit(1)).alias("delivered"), F.count_if(~F.coalesce("acked", F.lit(False))).alias("n_pending"))


# Time windows: the same transformations on a table and on a stream (with a watermark).


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    found = events.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")

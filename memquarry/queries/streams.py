"""Queries that run as streams, and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators.change_store import ChangeStore
from memquarry.queries import Registry
from memquarry.queries.feeds import _P1_SQL, NOW_NS
from memquarry.sources.tables import table
from memquarry.streaming import feeds

R = Registry()


@R.query(_P1_SQL)
def stream_state_fold(spark: SparkSession, base: str) -> DataFrame:
    """The state after the change feed has been followed as a stream."""
    return feeds.follow(feeds.table_stream(spark, base, "changelog"), ChangeStore(spark)).state(NOW_NS)


@R.query("SELECT event_type AS stream, max(event_id) AS cursor, count(*) AS delivered, count_if(event_id % 3 <> 0)::BIGINT AS n_pending FROM events GROUP BY event_type")
def stream_consumer_group(spark: SparkSession, base: str) -> DataFrame:
    """A consumer group on each event type that acknowledges each third event."""
    e = feeds.table_stream(spark, base, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("entry"), (F.col("event_id") % 3 == 0).alias("acked"))
    return feeds.consumer_group(e)


def _events(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def tumbling_errors(spark: SparkSession, base: str) -> DataFrame:
    return feeds.tumbling(_events(spark, base).where("event_type = 'error'"), "ts", "1 hour", "event_type")


@R.query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - i * 3600000000 AS start_us, event_type, count(*) AS n FROM events, range(2) t(i) GROUP BY ALL")
def sliding_events(spark: SparkSession, base: str) -> DataFrame:
    return feeds.sliding(_events(spark, base), "ts", "2 hours", "1 hour", "event_type")


@R.query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, part""")
def session_users(spark: SparkSession, base: str) -> DataFrame:
    return feeds.sessions(_events(spark, base), "ts", "1 hour", "user_id")


@R.query("SELECT DISTINCT tenant_id, seq, effect_no FROM changelog")
def dedup_late(spark: SparkSession, base: str) -> DataFrame:
    """Deliveries of the feed without repeats."""
    return table(spark, base, "changelog").select("tenant_id", "seq", "effect_no").distinct()


@R.query("SELECT tenant_id, seq, count(DISTINCT coalesce(effect_no, 0)) AS n_effects, max(coalesce(effect_no, 0)) + 1 = count(DISTINCT coalesce(effect_no, 0)) AS complete FROM changelog WHERE seq IS NOT NULL GROUP BY ALL")
def log_frames(spark: SparkSession, base: str) -> DataFrame:
    """The frames (transactions) of the log: their effects, and whether none between is lacking."""
    e = F.coalesce("effect_no", F.lit(0))
    one = table(spark, base, "changelog").where("seq IS NOT NULL").select("tenant_id", "seq", e.alias("e")).distinct()
    return one.groupBy("tenant_id", "seq").agg(F.count(F.lit(1)).alias("n_effects"), (F.max("e") + 1 == F.count(F.lit(1))).alias("complete"))

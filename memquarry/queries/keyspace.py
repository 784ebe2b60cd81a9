"""Queries on keys: ``events`` as a log of SETs (key user:N, seq event_id, a deadline of
k hours after the event, none where k is a multiple of 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import keyspace as K
from memquarry.queries import Registry
from memquarry.sources.tables import micros, table

R = Registry()
NOW_US = 1705276800000000  # 2024-01-15
_HOUR = 3600000000
_LOG = f"""WITH log AS (SELECT 'user:' || user_id AS key, event_id AS seq, printf('%.4f', value) AS value, event_type, user_id,
  json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) AS us FROM events),
kv AS (SELECT key, value, CASE WHEN k % 3 = 0 THEN 0 ELSE us + k * {_HOUR} * 4 END AS expires_at, seq FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
"""


def _log(spark: SparkSession, base: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, base, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.col("event_id").alias("seq"),
        F.format_string("%.4f", "value").alias("value"),
        "event_type",
        "user_id",
        k.alias("k"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(micros("ts") + k * (_HOUR * 4)).alias("expires_at"),
    )


def _kv(spark: SparkSession, base: str) -> DataFrame:
    return K.latest(_log(spark, base), ["key"], "seq", "value", "expires_at", "seq")


@R.query(_LOG + "SELECT key, value, expires_at, seq FROM kv")
def kv_latest(spark: SparkSession, base: str) -> DataFrame:
    return _kv(spark, base)


@R.query(_LOG + f"SELECT key, value FROM kv WHERE expires_at = 0 OR expires_at >= {NOW_US}")
def kv_live_ttl(spark: SparkSession, base: str) -> DataFrame:
    return _kv(spark, base).where(K.is_live(NOW_US)).select("key", "value")


@R.query(_LOG + f"SELECT key, CASE WHEN expires_at = 0 THEN -1 WHEN expires_at < {NOW_US} THEN -2 ELSE floor((expires_at - {NOW_US}) / 1000000)::BIGINT END AS ttl FROM kv")
def kv_ttl_seconds(spark: SparkSession, base: str) -> DataFrame:
    return _kv(spark, base).select("key", K.ttl(NOW_US, 1000000).alias("ttl"))


@R.query(_LOG + "SELECT key, value FROM kv WHERE regexp_full_match(key, 'user:1.[0-9]*')")
def keys_glob(spark: SparkSession, base: str) -> DataFrame:
    return K.matching(_kv(spark, base), "user:1?*").select("key", "value")


@R.query(_LOG + "SELECT key FROM kv WHERE key > 'user:120' ORDER BY key LIMIT 10")
def keys_scan_page(spark: SparkSession, base: str) -> DataFrame:
    return K.scan(_kv(spark, base), "user:120", 10).select("key")


_ARGS = ["user:1", "user:nobody", "user:7", "user:1", "user:149"]


@R.query(_LOG + f"SELECT (pos - 1)::INTEGER AS pos, a.key, kv.value FROM (SELECT unnest({_ARGS}) AS key, unnest(range(1, {len(_ARGS) + 1})) AS pos) a LEFT JOIN kv ON kv.key = a.key")
def mget_positional(spark: SparkSession, base: str) -> DataFrame:
    return K.mget(_kv(spark, base), _ARGS)


@R.query(_LOG + f"SELECT count(*) AS n FROM (SELECT unnest({_ARGS}) AS key) a JOIN kv USING (key)")
def exists_count(spark: SparkSession, base: str) -> DataFrame:
    return K.exists_count(_kv(spark, base), _ARGS)


_TYPED = """WITH typed AS (SELECT 'string' AS type, 'user:' || user_id AS key FROM events UNION SELECT 'hash', 'cust:' || o_custkey FROM orders
UNION SELECT 'zset', 'nation:' || c_nationkey FROM customer UNION SELECT 'list', 'order:' || l_orderkey FROM lineitem UNION SELECT 'bitmap', 'type:' || event_type FROM events)
"""


def _typed(spark: SparkSession, base: str) -> DataFrame:
    def part(kind: str, prefix: str, name: str, col: str) -> DataFrame:
        return table(spark, base, name).select(F.lit(kind).alias("type"), F.concat(F.lit(prefix), F.col(col).cast("string")).alias("key"))

    parts = [part("string", "user:", "events", "user_id"), part("hash", "cust:", "orders", "o_custkey"), part("zset", "nation:", "customer", "c_nationkey"), part("list", "order:", "lineitem", "l_orderkey"), part("bitmap", "type:", "events", "event_type")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


@R.query(_TYPED + "SELECT type, count(*) AS n, CASE WHEN type = 'string' THEN 'embstr' WHEN type IN ('hash', 'list', 'set') THEN 'listpack' WHEN type = 'zset' THEN 'skiplist' ELSE 'raw' END AS encoding FROM typed GROUP BY type")
def keyspace_stats(spark: SparkSession, base: str) -> DataFrame:
    """Keys by type (and in total: DBSIZE is their sum), with the stored encoding."""
    return _typed(spark, base).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("encoding", K.encoding(F.col("type")))


@R.query(_TYPED + "SELECT a.key, coalesce(type, 'none') AS type FROM (SELECT unnest(['user:1', 'cust:1', 'nation:3', 'order:7', 'nothing']) AS key) a LEFT JOIN typed USING (key)")
def type_of(spark: SparkSession, base: str) -> DataFrame:
    return K.mget(_typed(spark, base), ["user:1", "cust:1", "nation:3", "order:7", "nothing"], value="type").select("key", F.coalesce("value", F.lit("none")).alias("type"))


_COUNT = """WITH log AS (SELECT 'user:' || user_id AS key, event_id AS seq, event_type = 'error' AS is_set, CASE WHEN event_type = 'error' THEN 100 ELSE json_extract_string(props, '$.k')::BIGINT END AS amount FROM events)
"""


@R.query(_COUNT + """, s AS (SELECT key, max(seq) AS last_set FROM log WHERE is_set GROUP BY key)
SELECT key, (coalesce(max(CASE WHEN is_set AND seq = last_set THEN amount END), 0) + coalesce(sum(CASE WHEN NOT is_set AND (last_set IS NULL OR seq > last_set) THEN amount END), 0))::BIGINT AS value FROM log LEFT JOIN s USING (key) GROUP BY key""")
def incr_counters(spark: SparkSession, base: str) -> DataFrame:
    """Counters: an error event sets the user's counter to 100, others add k."""
    is_set = F.col("event_type") == "error"
    log = _log(spark, base).select("key", "seq", is_set.alias("is_set"), F.when(is_set, F.lit(100)).otherwise(F.col("k")).cast("bigint").alias("amount"))
    return K.counters(log, "key", "seq", "is_set", "amount")


@R.query(_LOG + "SELECT key, string_agg(left(event_type, 1), '' ORDER BY seq) AS value FROM log GROUP BY key")
def append_concat(spark: SparkSession, base: str) -> DataFrame:
    return K.appended(_log(spark, base).withColumn("part", F.substring("event_type", 1, 1)), "key", "seq", "part")


@R.query(_LOG + "SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM log")
def getset_previous(spark: SparkSession, base: str) -> DataFrame:
    return K.previous(_log(spark, base).select("key", "seq", "value"), "key", "seq", "value")


@R.query(_LOG + "SELECT key, arg_min(value, seq) AS value, min(seq) AS seq, count(*) AS attempts FROM log GROUP BY key")
def setnx_first(spark: SparkSession, base: str) -> DataFrame:
    return K.first_set(_log(spark, base), "key", "seq", "value")


_OPS = """WITH log AS (SELECT 'user:' || user_id AS key, event_id AS seq, CASE event_type WHEN 'click' THEN 'XX' WHEN 'view' THEN 'NX' WHEN 'error' THEN 'DEL' ELSE 'SET' END AS op, printf('%.4f', value) AS value FROM events),
b AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'XX' THEN op <> 'DEL' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM log),
a AS (SELECT * FROM b WHERE op = 'SET' OR op = 'NX' AND NOT there OR op IN ('XX', 'DEL') AND there)
"""


@R.query(_OPS + "SELECT key, value FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'DEL'")
def set_nx_xx(spark: SparkSession, base: str) -> DataFrame:
    """A log of SET, SET NX, SET XX and DEL by type of event."""
    t = F.col("event_type")
    op = F.when(t == "click", "XX").when(t == "view", "NX").when(t == "error", "DEL").otherwise("SET")
    return K.set_state(_log(spark, base).select("key", "seq", op.alias("op"), "value"), "key", "seq", "op", "value")


@R.query("WITH log AS (SELECT o_orderkey AS seq, o_custkey % 500 AS a, o_custkey % 700 AS b, o_totalprice FROM orders), e AS (SELECT seq, 0 AS pos, 'k' || a AS key, o_totalprice AS value FROM log UNION ALL SELECT seq, 1, 'k' || b, -o_totalprice FROM log) SELECT key, value FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, pos DESC) = 1")
def mset_frames(spark: SparkSession, base: str) -> DataFrame:
    """MSET of two keys per order: a frame of effects in order, of which a later one of the same key holds."""
    c, v = F.col("o_custkey"), F.col("o_totalprice")
    pair = lambda pos, n, x: F.struct(F.lit(pos).alias("pos"), F.concat(F.lit("k"), (c % n).cast("string")).alias("key"), x.alias("value"))
    e = table(spark, base, "orders").select(F.col("o_orderkey").alias("seq"), F.explode(F.array(pair(0, 500, v), pair(1, 700, -v))).alias("e")).select("seq", "e.*")
    return K.latest(e.withColumn("at", F.struct("seq", "pos")), ["key"], "at", "value")


_FLUSH = "WITH l AS (SELECT event_id AS seq, user_id % 7 AS db, user_id, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN CASE WHEN event_id % 400 = 0 THEN 'all' ELSE 'db' END ELSE 'set' END AS op FROM events)\n"


@R.query(_FLUSH + ", f AS (SELECT db, max(seq) AS f FROM l WHERE op = 'db' GROUP BY db), a AS (SELECT max(seq) AS f FROM l WHERE op = 'all') SELECT seq, l.db, user_id FROM l LEFT JOIN f ON f.db = l.db, a WHERE op = 'set' AND (f.f IS NULL OR seq > f.f) AND (a.f IS NULL OR seq > a.f)")
def flush_db_all(spark: SparkSession, base: str) -> DataFrame:
    """The sets that outlive the last FLUSHDB of their database and the last FLUSHALL."""
    i, err = F.col("seq"), F.col("event_type") == "error"
    op = F.when(err & (i % 400 == 0), "all").when(err & (i % 50 == 0), "db").otherwise("set")
    l = table(spark, base, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("db"), "user_id", "event_type").withColumn("op", op)  # noqa: E741
    return K.flushed(l, "db", "seq", F.col("op") == "db", F.col("op") == "all").select("seq", "db", "user_id")


@R.query(_TYPED + "SELECT count(*) AS n FROM typed")
def db_size(spark: SparkSession, base: str) -> DataFrame:
    return _typed(spark, base).agg(F.count(F.lit(1)).alias("n"))


@R.query(_LOG + f"SELECT key, floor(({NOW_US} + 1500000000000 - max(us)) / 1000000)::BIGINT AS idle, 1::INTEGER AS refcount FROM log GROUP BY key")
def object_idle(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), micros("ts").alias("us"))
    return K.idle_seconds(e, "key", "us", F.lit(NOW_US + 1500000000000))


@R.query("WITH m AS (SELECT (max(event_id) // 2)::BIGINT AS m FROM events) SELECT user_id, event_id, value FROM events, m WHERE event_id <= m")
def mvcc_history_at(spark: SparkSession, base: str) -> DataFrame:
    """All versions at or before the middle one."""
    e = table(spark, base, "events").select("user_id", "event_id", "value")
    return K.history_at(e, "event_id", e.agg(F.max("event_id")).first()[0] // 2)


@R.query("WITH m AS (SELECT (max(event_id) // 2)::BIGINT AS m FROM events) SELECT user_id, count(*) AS versions, min(event_id) AS oldest FROM events, m WHERE event_id >= m GROUP BY user_id")
def mvcc_gc(spark: SparkSession, base: str) -> DataFrame:
    """What a collection of the versions before the middle one leaves, by key."""
    e = table(spark, base, "events").select("user_id", "event_id")
    kept = K.collected(e, "event_id", e.agg(F.max("event_id")).first()[0] // 2)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"), F.min("event_id").alias("oldest"))


@R.query("""WITH w AS (SELECT event_id AS txn, user_id AS key, event_id - 40 AS seen, event_id AS upto FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, (user_id + 1) % 150, event_id - 40, event_id FROM events WHERE event_type = 'purchase'),
p AS (SELECT txn, key, coalesce(bool_or(e.event_id > seen AND e.event_id <= upto), false) AS m FROM w LEFT JOIN events e ON e.user_id = w.key AND e.event_type = 'error' GROUP BY txn, key)
SELECT txn, bool_or(m) AS aborted, count_if(m)::BIGINT AS moved FROM p GROUP BY txn""")
def watch_aborts(spark: SparkSession, base: str) -> DataFrame:
    """Purchases as transactions that watched two users for 40 versions; errors write."""
    e = table(spark, base, "events")
    b = e.where("event_type = 'purchase'")
    one = lambda k: b.select(F.col("event_id").alias("txn"), k.alias("user_id"), (F.col("event_id") - 40).alias("seen"), F.col("event_id").alias("at"))
    watches = one(F.col("user_id")).unionAll(one((F.col("user_id") + 1) % 150))
    return K.watch_results(watches, e.where("event_type = 'error'").select("user_id", "event_id"), "user_id", "event_id")


@R.query(_LOG + "SELECT CASE WHEN key = 'user:1' THEN 'user:2' ELSE key END AS key, value, expires_at FROM kv WHERE key <> 'user:2'")
def rename_keys(spark: SparkSession, base: str) -> DataFrame:
    return K.renamed(_kv(spark, base), "user:1", "user:2").select("key", "value", "expires_at")


@R.query("SELECT c_custkey, c_name[3:6] AS middle, c_name[-4:-2] AS tail, '' AS nothing, strlen(c_name) AS len FROM customer")
def getrange_slice(spark: SparkSession, base: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, base, "customer").select(
        "c_custkey", K.getrange(name, 2, 5).cast("string").alias("middle"), K.getrange(name, -4, -2).cast("string").alias("tail"), K.getrange(name, 5, 2).cast("string").alias("nothing"), F.octet_length(name).cast("bigint").alias("len")
    )


@R.query("SELECT c_custkey, c_name[1:2] || 'XYZ' || c_name[6:] AS inside, rpad(c_name, greatest(length(c_name), 24)::INTEGER, '.')[1:24] || 'END' AS beyond FROM customer")
def setrange_overlay(spark: SparkSession, base: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, base, "customer").select("c_custkey", K.setrange(name, 2, b"XYZ").cast("string").alias("inside"), F.translate(K.setrange(name, 24, b"END").cast("string"), "\x00", ".").alias("beyond"))


@R.query(_LOG + ", p AS (SELECT key, seq, (sum(strlen(key) + 96 + strlen(value)) OVER (PARTITION BY key ORDER BY seq))::BIGINT AS projected FROM log) SELECT key, seq, projected, projected > 4000 AS rejected FROM p")
def quota_admission(spark: SparkSession, base: str) -> DataFrame:
    log = _log(spark, base).select("key", "seq", "value")
    return K.admission(log, "key", "seq", K.cost(F.col("key"), F.col("value")), 4000).select("key", "seq", "projected", "rejected")


@R.query(_LOG + "SELECT key, value FROM kv WHERE key NOT IN ('user:1', 'user:2', 'user:3') ")
def del_keys(spark: SparkSession, base: str) -> DataFrame:
    kv = _kv(spark, base)
    gone = spark.createDataFrame([("user:1",), ("user:2",), ("user:3",), ("user:1",)], "key string")
    return kv.join(gone, "key", "left_anti").select("key", "value")


@R.query("SELECT e.event_id, h.value AS value_then FROM events e LEFT JOIN LATERAL (SELECT value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id ORDER BY p.event_id DESC LIMIT 1) h ON true WHERE e.event_type = 'error'")
def mvcc_read_at(spark: SparkSession, base: str) -> DataFrame:
    """As-of read: for each error the user's last purchase at that version."""
    e = table(spark, base, "events").where(F.col("event_type").isin("error", "purchase"))
    seen = K.read_at(e, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "value_then")
    return seen.where("event_type = 'error'").select("event_id", "value_then")


@R.query(_LOG + "SELECT key, value, seq FROM kv")
def snapshot_plus_tail(spark: SparkSession, base: str) -> DataFrame:
    """State from a snapshot at event 6000 and the log after it."""
    log = _log(spark, base).select("key", "seq", "value")
    snapshot = K.latest(log.where("seq <= 6000"), ["key"], "seq", "value", "seq")
    tail = log.where("seq > 6000").select("key", "value", "seq")
    return K.latest(snapshot.unionByName(tail), ["key"], "seq", "value", "seq")

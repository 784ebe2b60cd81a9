"""Queries on tenants, access, routing and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import tenancy as T
from memquarry.queries import Registry
from memquarry.sources.tables import micros, table

R = Registry()
_U = "WITH u AS (SELECT * FROM tenant_usage WHERE tenant_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY commands DESC NULLS LAST, disk_bytes DESC NULLS LAST) = 1)\n"


def _usage(spark: SparkSession, base: str) -> DataFrame:
    return T.one_per_tenant(table(spark, base, "tenant_usage"))


@R.query(_U + ", d AS (SELECT tenant_id, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY tenant_id) SELECT u.tenant_id, u.keys, u.vectors, u.errors, coalesce(n_docs, 0) AS n_docs, coalesce(n_chars, 0) AS n_chars FROM u LEFT JOIN d USING (tenant_id)")
def tenant_usage(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return _usage(spark, base).join(docs, "tenant_id", "left").select("tenant_id", "keys", "vectors", "errors", zero("n_docs"), zero("n_chars"))


@R.query(_U + "SELECT tenant_id, CASE WHEN coalesce(hibernated, false) THEN 'hibernated' WHEN status IN ('running', 'starting') THEN status ELSE 'down' END AS status FROM u")
def tenant_status(spark: SparkSession, base: str) -> DataFrame:
    return _usage(spark, base).select("tenant_id", T.status(F.col("hibernated"), F.col("status")).alias("status"))


@R.query(_U + ", p AS (SELECT tenant_id, CASE WHEN memory_limit_bytes > 0 THEN floor(memory_used_bytes * 100 / memory_limit_bytes)::BIGINT END AS percent FROM u) SELECT tenant_id, percent, CASE WHEN percent >= 100 THEN 'full' ELSE 'near_limit' END AS finding FROM p WHERE percent >= 80")
def capacity_findings(spark: SparkSession, base: str) -> DataFrame:
    u = _usage(spark, base)
    p = u.select("tenant_id", T.memory_percent(u).alias("percent")).where("percent >= 80")
    return p.withColumn("finding", F.when(F.col("percent") >= 100, "full").otherwise("near_limit"))


@R.query("""WITH t AS (SELECT DISTINCT tenant_id FROM changelog WHERE tenant_id IS NOT NULL), u AS (SELECT DISTINCT tenant_id FROM tenant_usage WHERE tenant_id IS NOT NULL)
SELECT coalesce(t.tenant_id, u.tenant_id) AS tenant_id, CASE WHEN u.tenant_id IS NULL THEN 'missing_usage' ELSE 'orphan_usage' END AS finding FROM t FULL JOIN u USING (tenant_id) WHERE t.tenant_id IS NULL OR u.tenant_id IS NULL""")
def consistency_full_outer(spark: SparkSession, base: str) -> DataFrame:
    return T.consistency(table(spark, base, "changelog"), table(spark, base, "tenant_usage"))


@R.query("""WITH e AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM e)
SELECT event_type, day, n, CASE WHEN before IS NULL OR n < before THEN n ELSE n - before END AS delta FROM d""")
def error_delta_findings(spark: SparkSession, base: str) -> DataFrame:
    days = table(spark, base, "events").groupBy("event_type", F.floor(micros("ts") / 86400000000).cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return T.deltas(days, "event_type", "day", "n")


@R.query("SELECT event_type, count(*) AS n, count_if(value > 50)::BIGINT AS n_slow, floor(avg(value))::BIGINT AS mean_value, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY event_type")
def command_metrics(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_slow"), F.floor(F.avg("value")).cast("bigint").alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@R.query("""SELECT 'commands{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_lines(spark: SparkSession, base: str) -> DataFrame:
    """Counters in the text form that metric collectors read."""
    counts = table(spark, base, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat(F.lit('commands{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@R.query("SELECT DISTINCT tenant_id, key FROM changelog WHERE starts_with(key, 'doc:legal') OR starts_with(key, 'cfg:')")
def acl_prefix_filter(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "changelog").where(T.allowed(F.col("key"), ["doc:legal*", "cfg:*"])).select("tenant_id", "key").distinct()


@R.query("""WITH u(u, enabled, permissions, patterns) AS (VALUES ('u0', true, 1, ['user:1*']), ('u1', true, 3, ['*']), ('u2', true, 7, ['user:', 'x*']), ('u3', false, 7, ['*'])),
r AS (SELECT event_id, 'u' || (user_id % 5) AS u, CASE event_type WHEN 'error' THEN 'flushdb' WHEN 'purchase' THEN 'VMIGRATE' WHEN 'click' THEN 'set' ELSE 'GET' END AS command, 'user:' || user_id AS key FROM events)
SELECT event_id, coalesce(enabled AND (permissions & CASE command WHEN 'flushdb' THEN 4 WHEN 'VMIGRATE' THEN 2 WHEN 'set' THEN 2 ELSE 1 END) > 0, false) AS may_run,
  coalesce(enabled AND len(list_filter(patterns, lambda p: starts_with(key, rtrim(p, '*')))) > 0, false) AS may_touch FROM r LEFT JOIN u USING (u)""")
def acl_commands(spark: SparkSession, base: str) -> DataFrame:
    """Events as commands of five users, one of them unknown and one disabled."""
    users = spark.createDataFrame([("u0", True, 1, ["user:1*"]), ("u1", True, 3, ["*"]), ("u2", True, 7, ["user:", "x*"]), ("u3", False, 7, ["*"])], "user string, enabled boolean, permissions int, patterns array<string>")
    t = F.col("event_type")
    command = F.when(t == "error", "flushdb").when(t == "purchase", "VMIGRATE").when(t == "click", "set").otherwise("GET")
    e = table(spark, base, "events").select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"), command.alias("command"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))
    return T.permitted(e, users).select("event_id", "may_run", "may_touch")


@R.query(_U + ", s AS (SELECT count(*)::BIGINT AS tenants, sum(keys)::BIGINT AS keys, sum(vectors)::BIGINT AS vectors, sum(memory_used_bytes)::BIGINT AS memory_used_bytes, sum(commands)::BIGINT AS commands, sum(errors)::BIGINT AS errors FROM u) UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value")
def info_rows(spark: SparkSession, base: str) -> DataFrame:
    return T.info(_usage(spark, base))


# CRC-16, bit by bit, over the bytes of the tag; the tag is found by walking the braces.
_SLOT_SQL = """WITH k AS (SELECT DISTINCT key FROM changelog WHERE key IS NOT NULL UNION SELECT DISTINCT 'a{' || key || '{' || tenant_id || '}}' FROM changelog WHERE key IS NOT NULL AND tenant_id IS NOT NULL),
p AS (SELECT key, position('{' IN key) AS o FROM k), c AS (SELECT key, o, CASE WHEN o > 0 AND contains(substr(key, o), '}') THEN o + position('}' IN substr(key, o)) - 1 ELSE 0 END AS e FROM p),
t AS (SELECT key, CASE WHEN e > 0 AND length(string_split(left(key, e - 1), '{')[-1]) > 0 THEN string_split(left(key, e - 1), '{')[-1] ELSE key END AS tag FROM c),
d AS (SELECT DISTINCT tag FROM t),
x AS (SELECT tag, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(hex(encode(tag))) // 2 + 1), lambda i: ('0x' || hex(encode(tag))[(2 * i - 1):(2 * i)])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b << 8), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, one: (CASE WHEN (a & 32768) > 0 THEN xor(a << 1, 4129) ELSE a << 1 END) & 65535)) AS crc FROM d)
SELECT key, (crc % 16384)::INTEGER AS slot FROM t JOIN x USING (tag)"""


@R.query(_SLOT_SQL)
def hash_slot(spark: SparkSession, base: str) -> DataFrame:
    """Slots of all keys, and of keys with braces within braces."""
    k = table(spark, base, "changelog").where("key IS NOT NULL")
    nested = k.where("tenant_id IS NOT NULL").select(F.concat(F.lit("a{"), "key", F.lit("{"), "tenant_id", F.lit("}}")).alias("key"))
    return k.select("key").unionAll(nested).distinct().withColumn("slot", T.hash_slot("key"))


_NODES = ["n1", "n2", "n3", "n4", "n5"]


@R.query("""WITH k AS (SELECT user_id, (user_id * 7919 % 16384)::INTEGER AS slot FROM (SELECT DISTINCT user_id FROM events)), r AS (SELECT 'n' || (i + 1) AS node, i * 3276 AS a, CASE WHEN i = 4 THEN 16383 ELSE (i + 1) * 3276 - 1 END AS b FROM range(5) t(i))
SELECT user_id, slot, node FROM k JOIN r ON slot BETWEEN a AND b""")
def slot_ranges(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "events").select("user_id").distinct()
    return users.withColumn("slot", (F.col("user_id") * 7919 % 16384).cast("int")).withColumn("node", T.owner(F.col("slot"), _NODES))


@R.query("""WITH ring AS (SELECT ('0x' || substr(sha256(n || '-v' || i), 1, 8))::BIGINT AS h, n AS node FROM (SELECT unnest(['n1', 'n2', 'n3', 'n4', 'n5']) AS n), range(64) t(i)),
k AS (SELECT DISTINCT tenant_id, ('0x' || substr(sha256(tenant_id), 1, 8))::BIGINT AS h FROM documents WHERE tenant_id IS NOT NULL)
SELECT tenant_id, coalesce((SELECT arg_min(node, r.h) FROM ring r WHERE r.h >= k.h), (SELECT arg_min(node, h) FROM ring)) AS node FROM k""")
def hash_ring(spark: SparkSession, base: str) -> DataFrame:
    return T.ring_owner(table(spark, base, "documents").select("tenant_id").where("tenant_id IS NOT NULL").distinct(), "tenant_id", _NODES)


@R.query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n FROM c WHERE n >= (SELECT floor(avg(n)) FROM c)")
def hot_keys(spark: SparkSession, base: str) -> DataFrame:
    return T.hot_keys(table(spark, base, "events"), "user_id")


_ACKS = "WITH a AS (SELECT n_nationkey AS replica, (SELECT max(event_id) FROM events) - n_nationkey * 37 AS acked FROM nation)\n"


@R.query(_ACKS + "SELECT replica, acked, greatest((SELECT max(event_id) FROM events) - acked, 0)::BIGINT AS lag, (SELECT count_if(acked >= (SELECT max(event_id) - 200 FROM events)) >= 5 FROM a) AS quorum_met FROM a")
def lag_quorum(spark: SparkSession, base: str) -> DataFrame:
    top = table(spark, base, "events").agg(F.max("event_id")).first()[0]
    acks = table(spark, base, "nation").select(F.col("n_nationkey").alias("replica"), (F.lit(top).cast("bigint") - F.col("n_nationkey") * 37).alias("acked"))
    return T.lag_and_quorum(acks, F.lit(top), top - 200, 5)


_JOBS = "WITH j AS (SELECT event_id, epoch_us(ts) AS us, least(30000, 100 * 2 ** least(user_id % 12, 30))::BIGINT AS wait FROM events WHERE event_type = 'error')\n"


@R.query(_JOBS + "SELECT event_id, wait AS next_wait_ms FROM j WHERE us + wait * 1000 <= (SELECT max(epoch_us(ts)) FROM events)")
def retry_due(spark: SparkSession, base: str) -> DataFrame:
    """The failed events whose wait is over at the newest event's time, over the whole table."""
    e = table(spark, base, "events")
    attempt = F.col("user_id") % 12
    now = e.agg(F.max(micros("ts"))).first()[0]
    jobs = e.where("event_type = 'error'").select("event_id", (micros("ts") + T.backoff_ms(attempt) * 1000).alias("run_at"), attempt.alias("attempt"))
    return T.due_jobs(jobs, F.lit(now).cast("bigint")).select("event_id", "next_wait_ms")


@R.query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT user_id, us, i, 2.0::DOUBLE AS tokens, 1 AS ok FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.us, e.i, CASE WHEN least(3.0, f.tokens + (e.us - f.us) / 1e6 / 20000) >= 1 THEN least(3.0, f.tokens + (e.us - f.us) / 1e6 / 20000) - 1 ELSE least(3.0, f.tokens + (e.us - f.us) / 1e6 / 20000) END,
    CASE WHEN least(3.0, f.tokens + (e.us - f.us) / 1e6 / 20000) >= 1 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, sum(ok)::BIGINT AS n_allowed, count(*) AS n FROM f GROUP BY user_id""")
def rate_limit(spark: SparkSession, base: str) -> DataFrame:
    """Events a day that pass a token bucket of 1 per 20,000 s with a burst of 3, by user."""
    e = table(spark, base, "events").select("user_id", micros("ts").alias("us"))
    return T.rate_limited(e, "user_id", "us", 1 / 20000, 3.0).groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count(F.lit(1)).alias("n"))


@R.query("""WITH a AS (SELECT user_id, event_id, event_type IN ('error', 'view', 'click') AS failed FROM events), ok AS (SELECT user_id, max(event_id) AS ok FROM a WHERE NOT failed GROUP BY user_id)
SELECT user_id, count(*) AS failures, max(event_id) AS "at" FROM a LEFT JOIN ok USING (user_id) WHERE failed AND (ok IS NULL OR event_id > ok) GROUP BY user_id HAVING count(*) > 2 ORDER BY "at" DESC, user_id LIMIT 20""")
def dead_letter_queue(spark: SparkSession, base: str) -> DataFrame:
    """Users as jobs; clicks, views and errors are failures: what more than two in a row left in a queue of 20."""
    return T.dead_letters(table(spark, base, "events"), "user_id", "event_id", F.col("event_type").isin("error", "view", "click"), 2, 20)


@R.query("""WITH w AS (SELECT user_id, (event_id * 6) // (SELECT max(event_id) + 1 FROM events) AS w, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT user_id FROM w),
h AS (SELECT k.user_id, list(coalesce(w.n, 0)::BIGINT ORDER BY t.i) AS c FROM k CROSS JOIN range(6) t(i) LEFT JOIN w ON w.user_id = k.user_id AND w.w = t.i GROUP BY k.user_id)
SELECT user_id, list_reduce(c, lambda a, x: a // 2 + x)::BIGINT AS count FROM h""")
def cache_admission(spark: SparkSession, base: str) -> DataFrame:
    """Access counts that are halved at the end of each sixth of the log."""
    e = table(spark, base, "events")
    n = e.agg(F.max("event_id") + 1).first()[0]
    return T.admitted(e, "user_id", F.floor(F.col("event_id") * 6 / F.lit(n)), 6)


@R.query("SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 40")
def cache_lru(spark: SparkSession, base: str) -> DataFrame:
    """What a cache of 40 users holds after the log."""
    return T.least_recent(table(spark, base, "events"), "user_id", "event_id", 40)


@R.query(_U + "SELECT coalesce(status, 'unknown') AS status, sum(keys)::BIGINT AS keys, sum(memory_used_bytes)::BIGINT AS memory, count(*) AS n, grouping(status)::INTEGER AS is_total FROM u GROUP BY ROLLUP (status)")
def usage_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Usage by status and in total."""
    u = _usage(spark, base).rollup("status").agg(F.sum("keys").alias("keys"), F.sum("memory_used_bytes").alias("memory"), F.count(F.lit(1)).alias("n"), F.grouping("status").cast("int").alias("is_total"))
    return u.withColumn("status", F.coalesce("status", F.lit("unknown")))

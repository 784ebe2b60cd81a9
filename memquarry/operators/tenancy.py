"""Usage, capacity, access, routing and load of tenants as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.plans.ranking import value_before

SLOTS = 16384


def one_per_tenant(usage: DataFrame) -> DataFrame:
    """Repeated rows of a tenant once; of differing ones the one with most commands."""
    return usage.where(F.col("tenant_id").isNotNull()).groupBy("tenant_id").agg(F.max_by(F.struct(*[c for c in usage.columns if c != "tenant_id"]), F.struct("commands", "disk_bytes")).alias("u")).select("tenant_id", "u.*")


def status(hibernated: Column, state: Column) -> Column:
    """hibernated, then running, then starting, else down."""
    return F.when(F.coalesce(hibernated, F.lit(False)), "hibernated").when(state.isin("running", "starting"), state).otherwise("down")


def memory_percent(usage: DataFrame) -> Column:
    """Whole percent of the limit in use; null without limit."""
    limit = F.col("memory_limit_bytes")
    return F.when(limit > 0, F.floor(F.col("memory_used_bytes") * 100 / limit)).cast("bigint")


def consistency(tenants: DataFrame, usage: DataFrame) -> DataFrame:
    """Tenants without usage and usage without tenant."""
    t = tenants.select("tenant_id").where(F.col("tenant_id").isNotNull()).distinct().withColumn("_t", F.lit(True))
    u = usage.select("tenant_id").where(F.col("tenant_id").isNotNull()).distinct().withColumn("_u", F.lit(True))
    both = t.join(u, "tenant_id", "full_outer")
    return both.where(F.col("_t").isNull() | F.col("_u").isNull()).select("tenant_id", F.when(F.col("_u").isNull(), "missing_usage").otherwise("orphan_usage").alias("finding"))


def deltas(counts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds the increase over the row before of the same key; a counter that fell began anew."""
    before = F.col("_before_it")
    found = value_before(counts, key, [order], F.col(value), "_before_it")
    return found.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)).drop("_before_it")


def allowed(key: Column, patterns: list[str]) -> Column:
    """Whether a key begins with one of the patterns (a trailing * adds nothing)."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.startswith(key, F.lit(p.rstrip("*")))
    return out


#: Bits of permissions, and the commands that need more than reading.
READ, WRITE, ADMIN = 1, 2, 4
ADMIN_COMMANDS = "ACL BGSAVE CLUSTER CONFIG DEBUG FLUSHALL FLUSHDB REPLICAOF SAVE SHUTDOWN SLAVEOF VCOMPACT".split()
WRITE_COMMANDS = (
    "APPEND DECR DECRBY DEL DISCARD EXEC EXPIRE GEOADD GETSET HDEL HINCRBY HMSET HSET INCR INCRBY LPOP LPUSH LREM LSET LTRIM MSET MULTI PERSIST PUBLISH RENAME "
    "RPOP RPUSH SADD SET SETBIT SETEX SETNX SETRANGE SPOP SREM VADD VADDBIN VADD_BATCH VDEL VMIGRATE XACK XADD XGROUP ZADD ZINCRBY ZREM"
).split()


def permitted(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``may_run`` and ``may_touch`` to requests (user, command, key): whether the user
    (user, enabled, permissions, patterns) may run the command, by its class, and whether the
    key begins with one of the patterns. Unknown and disabled users may do nothing."""
    name = F.upper("command")
    needs = F.when(name.isin(ADMIN_COMMANDS), ADMIN).when(name.isin(WRITE_COMMANDS), WRITE).otherwise(READ)
    known = requests.join(users.select("user", "enabled", "permissions", "patterns"), "user", "left")
    on = F.coalesce("enabled", F.lit(False))
    touch = F.exists("patterns", lambda p: F.startswith(F.col("key"), F.regexp_replace(p, r"\*$", "")))
    out = known.withColumn("may_run", on & (F.coalesce("permissions", F.lit(0)).bitwiseAND(needs) > 0)).withColumn("may_touch", on & F.coalesce(touch, F.lit(False)))
    return out.drop("enabled", "permissions", "patterns")


def info(usage: DataFrame) -> DataFrame:
    """(name, value): the totals that INFO reports, a row each."""
    sums = usage.agg(F.count(F.lit(1)).alias("tenants"), *[F.sum(c).cast("bigint").alias(c) for c in ("keys", "vectors", "memory_used_bytes", "commands", "errors")])
    return sums.unpivot([], sums.columns, "name", "value")


def _crc_table() -> np.ndarray:
    """CRC-16 of every byte (polynomial 0x1021, from 0)."""
    c = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        c = np.where(c & 0x8000, c << 1 ^ 0x1021, c << 1) & 0xFFFF
    return c


def crc16(keys: list[bytes]) -> np.ndarray:
    """CRC-16 of many keys at once, a byte of all of them in each step."""
    n = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(-n, kind="stable")
    n, keys, table = n[order], [keys[i] for i in order.tolist()], _crc_table()
    flat = np.frombuffer(b"".join(keys), np.uint8)
    start, crc = np.cumsum(n) - n, np.zeros(len(n), np.uint32)
    for i in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -i, side="left"))  # keys longer than i
        crc[:m] = (crc[:m] << 8 ^ table[crc[:m] >> 8 ^ flat[start[:m] + i]]) & 0xFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def hash_slot(key: str) -> Column:
    """The slot of a key: CRC-16 of the key, or of its tag, which stands between the first
    closing brace that has an opening one before it and the last such opening one; an empty
    tag does not count. Distinct keys of a batch are hashed once."""
    tag = F.regexp_extract(F.col(key), r"^[^{]*\{(?:[^{}]*\{)*([^{}]*)\}", 1)

    @F.pandas_udf("int")
    def slot(tags: pd.Series) -> pd.Series:
        codes, names = pd.factorize(tags)
        found = (crc16([n.encode() for n in names]) % SLOTS).astype(np.int64)
        return pd.Series(np.append(found, 0)[codes]).where(codes >= 0).astype("Int32")

    return slot(F.when(tag != "", tag).otherwise(F.col(key)))


def slot_ranges(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """(node, first, last): equal ranges over the nodes by name, the remainder to the last."""
    ordered, each = sorted(nodes), SLOTS // len(nodes)
    rows = [(n, i * each, SLOTS - 1 if i == len(ordered) - 1 else (i + 1) * each - 1) for i, n in enumerate(ordered)]
    return spark.createDataFrame(rows, "node string, first int, last int")


def owner(slot: Column, nodes: list[str]) -> Column:
    """The node of a slot. Ranges are equal, so it is a division, not a range join."""
    ordered, each = sorted(nodes), SLOTS // len(nodes)
    return F.element_at(F.array(*[F.lit(n) for n in ordered]), F.least(F.floor(slot / each).cast("int"), F.lit(len(nodes) - 1)) + 1)


def ring_owner(keys: DataFrame, key: str, nodes: list[str], virtual: int = 64) -> DataFrame:
    """Adds ``node``: the first virtual node of the ring at or after the key's hash, else the first of all.

    The ring has nodes * virtual points, a parameter's size; a key finds its place in
    them by binary search within the task."""
    import hashlib

    ring = sorted((int.from_bytes(hashlib.sha256(f"{n}-v{i}".encode()).digest()[:4], "big"), n) for n in nodes for i in range(virtual))
    points, owners = np.array([h for h, _ in ring], np.int64), np.array([n for _, n in ring], object)

    @F.pandas_udf("string")
    def find(h: pd.Series) -> pd.Series:
        at = np.searchsorted(points, h.fillna(0).to_numpy(np.int64)) % len(points)
        return pd.Series(owners[at]).where(h.notna().to_numpy(), None)

    return keys.withColumn("node", find(F.conv(F.substring(F.sha2(F.col(key), 256), 1, 8), 16, 10).cast("bigint")))


def hot_keys(accesses: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys with at least the mean number of accesses, in whole numbers."""
    counts = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.floor(F.avg("n")).cast("bigint").alias("_mean"))
    return counts.crossJoin(mean).where(F.col("n") >= F.col("_mean")).drop("_mean")


def lag_and_quorum(acks: DataFrame, primary: Column, seq: int, quorum: int) -> DataFrame:
    """Per replica its lag; and whether enough replicas have acknowledged ``seq``."""
    met = acks.agg((F.count_if(F.col("acked") >= seq) >= quorum).alias("quorum_met"))
    return acks.withColumn("lag", F.greatest(primary - F.col("acked"), F.lit(0))).crossJoin(met)


def backoff_ms(attempt: Column, first: int = 100, most: int = 30000) -> Column:
    """Doubling waits with a ceiling, without jitter."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)))).cast("bigint")


def rate_limited(requests: DataFrame, client: str, us: str, rate: float, burst: float) -> DataFrame:
    """(client, us, allowed) by a token bucket per client, requests in order of time.

    The bucket is a fold over a client's requests. Rows stream through a task in
    order, and only the bucket of the client at hand is kept, so a client may have
    any number of requests."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, burst, 0
        for p in parts:
            out = []
            for c, t in zip(p[client].tolist(), p[us].tolist()):
                if c != current:
                    current, tokens, last = c, burst, t
                tokens = min(burst, tokens + (t - last) / 1e6 * rate)
                last = t
                out.append(tokens >= 1)
                if out[-1]:
                    tokens -= 1
            yield pd.DataFrame({client: p[client], us: p[us], "allowed": out})

    rows = requests.where(F.col(client).isNotNull() & F.col(us).isNotNull()).select(client, us)
    types = dict(rows.dtypes)
    return rows.repartition(client).sortWithinPartitions(client, us).mapInPandas(work, f"{client} {types[client]}, {us} {types[us]}, allowed boolean")


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose time has come, with the wait after their next failure."""
    return jobs.where(F.col("run_at") <= now).withColumn("next_wait_ms", backoff_ms(F.col("attempt")))


def dead_letters(attempts: DataFrame, job: str, order: str, failed: Column, most: int, keep: int) -> DataFrame:
    """(job, failures, at): the jobs that failed more than ``most`` times since they last
    went through, in the dead-letter queue, which keeps the newest ``keep``. That is its
    capacity, not a cut of the input."""
    ok = attempts.where(~failed).groupBy(job).agg(F.max(order).alias("_ok"))
    since = attempts.where(failed).join(ok, job, "left").where(F.col("_ok").isNull() | (F.col(order) > F.col("_ok")))
    dead = since.groupBy(job).agg(F.count(F.lit(1)).alias("failures"), F.max(order).alias("at")).where(F.col("failures") > most)
    return dead.orderBy(F.desc("at"), job).limit(keep)


def admitted(accesses: DataFrame, key: str, window: Column, n_windows: int) -> DataFrame:
    """(key, count): access counts that are halved (in whole numbers) at the end of each
    window, ``window`` counting from 0. A key sends a count per window, not its accesses."""
    per = accesses.groupBy(key, window.cast("int").alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    counts = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_n"))).alias("_c"))
    fold = F.aggregate(F.sequence(F.lit(0), F.lit(n_windows - 1)), F.lit(0).cast("bigint"), lambda a, w: F.floor(a / 2).cast("bigint") + F.coalesce(F.try_element_at("_c", w), F.lit(0)))
    return counts.select(key, fold.alias("count"))


def least_recent(accesses: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, last): what a cache of ``capacity`` keys holds that evicts the least recently used."""
    return accesses.groupBy(key).agg(F.max(order).alias("last")).orderBy(F.desc("last"), key).limit(capacity)

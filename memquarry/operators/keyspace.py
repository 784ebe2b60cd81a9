"""Commands on keys, each for all keys at once.

A *log* has a row per effect (key, seq, ...); a *keyspace* has a row per key (key,
value, expires_at; 0 or null: no deadline). Times are integers in one unit, and
``now`` is always given. Every rule that only needs the last effect of a key is an
aggregate, combined before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memquarry.plans.ranking import last_known, running_sum, value_before


def latest(log: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The values of the last effect of each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def is_live(now: int, expires: str = "expires_at") -> Column:
    """Not past its deadline; a deadline equal to now has not passed."""
    e = F.coalesce(F.col(expires), F.lit(0))
    return (e == 0) | (e >= now)


def ttl(now: int, per_second: int, expires: str = "expires_at") -> Column:
    """-2 for an expired key, -1 without deadline, else whole seconds left."""
    e = F.coalesce(F.col(expires), F.lit(0))
    return F.when(e == 0, F.lit(-1)).when(e < now, F.lit(-2)).otherwise(F.floor((e - now) / per_second)).cast("bigint")


def glob(pattern: str) -> str:
    """The regular expression of a key pattern with ``*`` and ``?``; nothing else is special."""
    return "^" + "".join({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(c, re.escape(c)) for c in pattern) + r"\z"


def matching(kv: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    return kv.where(F.col(key).rlike(glob(pattern)))


def scan(kv: DataFrame, after: str | None, count: int, key: str = "key") -> DataFrame:
    """A page of keys in order; the cursor is the last key of the page before."""
    rows = kv if after is None else kv.where(F.col(key) > after)
    return rows.orderBy(key).limit(count)


def mget(kv: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """(pos, key, value) for each argument in its place, null where missing."""
    spark = kv.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, key string")
    found = kv.where(F.col(key).isin(keys)).select(F.col(key).alias("_k"), F.col(value).alias("value"))
    return wanted.join(found, F.col("key") == F.col("_k"), "left").select("pos", "key", "value")


def exists_count(kv: DataFrame, keys: list[str], key: str = "key") -> DataFrame:
    """How many of the arguments exist; repeated ones count each time."""
    return mget(kv.withColumn("_one", F.lit(1)), keys, key, "_one").agg(F.count("value").alias("n"))


def counters(log: DataFrame, key: str, order: str, is_set: str, amount: str) -> DataFrame:
    """(key, value) of counters: the last value set, and what was added after it.

    The additions are summed by the set they follow; the last set of a key is an
    aggregate, so no key's rows need to be in one place in order."""
    last = log.where(F.col(is_set)).groupBy(key).agg(F.max(F.struct(F.col(order), F.col(amount))).alias("_s"))
    joined = log.where(~F.col(is_set)).join(last, key, "full_outer")
    after = F.col("_s").isNull() | (F.col(order) > F.col(f"_s.{order}"))
    return joined.groupBy(key).agg((F.coalesce(F.max(f"_s.{amount}"), F.lit(0)) + F.coalesce(F.sum(F.when(after, F.col(amount))), F.lit(0))).cast("bigint").alias("value"))


def appended(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the parts appended to each key, in order. The value of a key is one
    value and is made in one place."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return log.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[value]), "").alias("value"))


def previous(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The log with ``old``: the value each set replaced."""
    return value_before(log, key, [order], F.col(value), "old")


def first_set(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """SETNX: of the sets of a key only the first has effect."""
    return log.groupBy(key).agg(F.min_by(value, order).alias(value), F.min(order).alias(order), F.count(F.lit(1)).alias("attempts"))


def conditional_sets(log: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """Adds ``applied`` to a log of SET, NX (only if the key is absent), XX (only if it is
    there) and DEL. After SET and NX a key is there whatever came before, after DEL it is
    not, and XX leaves that as it is: so only the last row that is not XX decides."""
    seen = last_known(log, key, [order], F.when(F.col(op) != "XX", F.col(op) != "DEL"), "_there", inclusive=False)
    return seen.withColumn("_there", F.coalesce("_there", F.lit(False))).withColumn("applied", F.when(F.col(op) == "NX", ~F.col("_there")).when(F.col(op) == "SET", F.lit(True)).otherwise(F.col("_there"))).drop("_there")


def set_state(log: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """(key, value) once the applied sets and deletions are done."""
    done = conditional_sets(log, key, order, op, value).where("applied")
    last = done.groupBy(key).agg(F.max_by(F.struct(op, value), order).alias("_v"))
    return last.where(F.col(f"_v.{op}") != "DEL").select(key, f"_v.{value}")


def flushed(log: DataFrame, db: str, order: str, is_flush: Column, everywhere: Column | None = None) -> DataFrame:
    """The rows that outlive FLUSHDB (``is_flush``: of its own database) and FLUSHALL
    (``everywhere``: of all): those after the last of either. The flushes come to one row
    per database before they meet the log."""
    per = log.where(is_flush).groupBy(db).agg(F.max(order).alias("_f"))
    out = log.where(~is_flush).join(per, db, "left").where(F.col("_f").isNull() | (F.col(order) > F.col("_f"))).drop("_f")
    if everywhere is None:
        return out
    top = log.where(everywhere).agg(F.max(order).alias("_f"))
    return out.where(~everywhere).crossJoin(F.broadcast(top)).where(F.col("_f").isNull() | (F.col(order) > F.col("_f"))).drop("_f")


def idle_seconds(log: DataFrame, key: str, us: str, now_us: Column) -> DataFrame:
    """(key, idle, refcount): OBJECT IDLETIME, whole seconds since the last access, and
    OBJECT REFCOUNT, which is always 1."""
    return log.groupBy(key).agg(F.floor((now_us - F.max(us)) / 1000000).cast("bigint").alias("idle"), F.lit(1).alias("refcount"))


def read_at(log: DataFrame, key: str, version: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last written ``value`` (null where a row writes none) of the key at
    each row's version."""
    return last_known(log, key, [version], value, name)


def history_at(log: DataFrame, version: str, at: int) -> DataFrame:
    """All versions at or before a version."""
    return log.where(F.col(version) <= at)


def collected(log: DataFrame, version: str, least: int) -> DataFrame:
    """The versions that a collection of those below ``least`` leaves."""
    return log.where(F.col(version) >= least)


def watch_results(watches: DataFrame, log: DataFrame, key: str, version: str) -> DataFrame:
    """(txn, aborted, moved): a transaction that watched (txn, key, seen, at) is aborted if a
    watched key got a version above ``seen`` up to its EXEC at version ``at``.

    Watches and writes of a key are walked once from the newest on; the write met last is
    the first one after a watch. No watch meets all writes of its key."""
    wide = watches.select(key, F.col("seen").alias("_p"), F.lit(0).alias("_w"), "txn", "at")
    wide = wide.unionByName(log.select(key, F.col(version).alias("_p"), F.lit(1).alias("_w")), allowMissingColumns=True)
    walked = last_known(wide, key, [-F.col("_p"), F.col("_w")], F.when(F.col("_w") == 1, F.col("_p")), "_after", inclusive=False)
    per = walked.withColumn("_m", F.coalesce(F.col("_after") <= F.col("at"), F.lit(False))).where("_w = 0").groupBy("txn", key).agg(F.bool_or("_m").alias("_m"))
    return per.groupBy("txn").agg(F.bool_or("_m").alias("aborted"), F.count_if("_m").alias("moved"))


def renamed(kv: DataFrame, old: str, new: str, key: str = "key") -> DataFrame:
    """RENAME: ``old`` takes the place of ``new``; its deadline goes with it."""
    return kv.where(F.col(key) != new).withColumn(key, F.when(F.col(key) == old, F.lit(new)).otherwise(F.col(key)))


def bounds(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First and last place (from 0) of an inclusive range; the last is less than the
    first where it is empty. Negative places count from the end."""
    s = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    e = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return s, e


def getrange(value: Column, start: int, stop: int) -> Column:
    """An inclusive range of bytes."""
    b = value.cast("binary")
    s, e = bounds(F.octet_length(b), start, stop)
    return F.when(s > e, F.lit(b"").cast("binary")).otherwise(F.substring(b, s + 1, e - s + 1))


def setrange(value: Column, offset: int, part: bytes) -> Column:
    """Overwrites bytes from ``offset``, filling a gap with zero bytes."""
    b = F.coalesce(value.cast("binary"), F.lit(b"").cast("binary"))
    pad = F.rpad(b, F.greatest(F.octet_length(b), F.lit(offset)), F.lit(b"\x00"))
    return F.concat(F.substring(pad, F.lit(1), F.lit(offset)), F.lit(part), F.substring(b, F.lit(offset + len(part) + 1), F.greatest(F.octet_length(b) - offset - len(part), F.lit(0))))


def cost(key: Column, value: Column) -> Column:
    """Bytes that an entry is charged."""
    return (F.octet_length(key.cast("string")) + 96 + F.octet_length(value.cast("string"))).cast("bigint")


def admission(log: DataFrame, group: str, order: str, charge: Column, limit: int) -> DataFrame:
    """The log with the group's projected bytes at each write and whether it is rejected.
    Rejected writes count in the projection, as the reference for all writes is the log."""
    return running_sum(log, group, [order], charge, "projected").withColumn("rejected", F.col("projected") > limit)


def encoding(kind: Column) -> Column:
    """The stored encoding of a type."""
    return F.when(kind == "string", "embstr").when(kind.isin("hash", "list", "set"), "listpack").when(kind == "zset", "skiplist").otherwise("raw")

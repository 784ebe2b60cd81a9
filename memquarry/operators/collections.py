"""Hashes, lists, sets, sorted sets, bitmaps, geo points, documents and streams as
relations with a row per element; every operator works on all keys at once.

Ranges follow one rule: places count from 0, negative ones from the end, both ends
are inclusive and cut to what is there.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.operators.keyspace import bounds
from memquarry.plans.ranking import numbered


def placed(rows: DataFrame, key: str, *order) -> DataFrame:
    """Adds ``pos`` from 0 within each key, by the given order."""
    return numbered(rows, key, list(order))


def ranged(rows: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """The rows whose ``pos`` lies in the range of their key. Sizes come from an aggregate."""
    if start >= 0 and stop >= 0:
        return rows.where(F.col("pos").between(start, stop))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    s, e = bounds(F.col("_n"), start, stop)
    return rows.join(sizes, key).where(F.col("pos").between(s, e)).drop("_n")


def at_index(rows: DataFrame, key: str, index: int) -> DataFrame:
    return ranged(rows, key, index, index)


def pushed(rows: DataFrame, key: str, order: str, left: Column) -> DataFrame:
    """Elements pushed to either end: ``pos`` of each in the list that results."""
    return numbered(rows, key, [F.when(left, -F.col(order)).otherwise(F.col(order))])


def popped(rows: DataFrame, key: str, left: int, right: int = 0) -> DataFrame:
    """LPOP and RPOP: adds ``end``, \"left\" or \"right\" for the elements (with ``pos``) that
    the pops return, null for what stays. Pops from the left come first."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(sizes, key)
    end = F.when(F.col("pos") < left, "left").when(F.col("pos") >= F.col("_n") - right, "right")
    return out.withColumn("end", end).drop("_n")


def element_set(rows: DataFrame, key: str, index: int, value: str, new: Column) -> DataFrame:
    """LSET: the element at an index of each list, from the end if negative, replaced;
    shorter lists stay as they are."""
    if index >= 0:
        return rows.withColumn(value, F.when(F.col("pos") == index, new).otherwise(F.col(value)))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, key).withColumn(value, F.when(F.col("pos") == F.col("_n") + index, new).otherwise(F.col(value))).drop("_n")


# Commands that count -------------------------------------------------------------


def added_counts(commands: DataFrame, keys: list[str], order: str, *per: str) -> DataFrame:
    """(per..., added): how many elements (``keys``) each command of HSET, SADD, ZADD or
    GEOADD made new, commands being the rows of equal ``per``: those in which an element
    comes first. The first place of an element is an aggregate, so elements may be hot."""
    first = commands.groupBy(*keys).agg(F.min_by(F.struct(*per), order).alias("_c"))
    n = first.groupBy(*[F.col(f"_c.{p}").alias(p) for p in per]).agg(F.count(F.lit(1)).alias("added"))
    return commands.select(*per).distinct().join(n, list(per), "left").select(*per, F.coalesce("added", F.lit(0)).cast("bigint").alias("added"))


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What HDEL, SREM or ZREM leaves."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def removed_counts(rows: DataFrame, gone: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(key, removed): how many of the named elements were there."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("removed"))


# Sets ---------------------------------------------------------------------------


def intersection(sets: DataFrame, key: str, member: str, keys: list) -> DataFrame:
    """Members of every key; a missing key has none."""
    n = len(set(keys))
    per = sets.where(F.col(key).isin(keys)).select(key, member).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("_n"))
    return per.where(F.col("_n") == n).select(member)


def union(sets: DataFrame, key: str, member: str, keys: list) -> DataFrame:
    return sets.where(F.col(key).isin(keys)).select(member).distinct()


def difference(sets: DataFrame, key: str, member: str, keys: list) -> DataFrame:
    """Members of the first key that none of the others has."""
    per = sets.where(F.col(key).isin(keys)).groupBy(member).agg(F.max((F.col(key) == keys[0]).cast("int")).alias("_in"), F.max(F.col(key).isin(keys[1:]).cast("int")).alias("_out"))
    return per.where("_in = 1 AND _out = 0").select(member)


def sample(sets: DataFrame, key: str, member: str, n: int, seed: int) -> DataFrame:
    """n members of each key without replacement, the same for the same seed."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.col(member)), member)
    return sets.select(key, member).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def members_after(log: DataFrame, key: str, member: str, order: str, is_add: Column) -> DataFrame:
    """The members of each key after a log of SADD and SREM: those whose last command adds."""
    last = log.groupBy(key, member).agg(F.max_by(is_add, order).alias("_in"))
    return last.where("_in").select(key, member)


def spop(sets: DataFrame, key: str, member: str, n: int, seed: int) -> DataFrame:
    """The members with ``popped``: n of each key by ``sample``, which the set loses."""
    out = sample(sets, key, member, n, seed).withColumn("popped", F.lit(True))
    return sets.select(key, member).distinct().join(out, [key, member], "left").withColumn("popped", F.coalesce("popped", F.lit(False)))


# Sorted sets --------------------------------------------------------------------


def ranks(zset: DataFrame, key: str, member: str, score: str) -> DataFrame:
    """Adds ``rank`` by (score, member) and ``revrank``, both from 0."""
    sizes = zset.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(zset, key, [score, member], "rank")
    return ranked.join(sizes, key).withColumn("revrank", (F.col("_n") - 1 - F.col("rank")).cast("int")).drop("_n")


def reverse_range(zset: DataFrame, key: str, member: str, score: str, start: int, stop: int) -> DataFrame:
    return ranged(numbered(zset, key, [score, member], descending=True), key, start, stop)


def scores_of(zset: DataFrame, key: str, member: str, score: str, wanted: list) -> DataFrame:
    """(key, member, score): ZSCORE of the wanted members of every key, null where missing."""
    asked = zset.select(key).distinct().withColumn(member, F.explode(F.array(*[F.lit(w) for w in wanted])))
    return asked.join(zset.where(F.col(member).isin(wanted)).select(key, member, score), [key, member], "left")


# Bitmaps ------------------------------------------------------------------------


def bit_counts(bits: DataFrame, key: str, offset: str) -> DataFrame:
    return bits.select(key, offset).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def first_one(bits: DataFrame, key: str, offset: str) -> DataFrame:
    return bits.groupBy(key).agg(F.min(offset).cast("bigint").alias("pos"))


def first_zero(bits: DataFrame, key: str, offset: str) -> DataFrame:
    """The first offset that is not set: where the set ones from 0 stop being without a
    gap; -1 where they fill whole bytes."""
    row = numbered(bits.select(key, offset).distinct(), key, [offset], "_r")
    run = row.groupBy(key).agg(F.sum((F.col(offset) == F.col("_r")).cast("bigint")).alias("_run"), F.max(offset).alias("_max"))
    size = (F.floor(F.col("_max") / 8) + 1) * 8
    return run.select(key, F.when(F.col("_run") == size, F.lit(-1)).otherwise(F.col("_run")).cast("bigint").alias("pos"))


def get_bits(bits: DataFrame, key: str, offset: str, wanted: list[int]) -> DataFrame:
    """(key, offset, bit) of the wanted offsets of every key, 0 beyond the end."""
    keys = bits.select(key).distinct().withColumn(offset, F.explode(F.array(*[F.lit(w) for w in wanted])))
    return keys.join(bits.select(key, offset).distinct().withColumn("_b", F.lit(1)), [key, offset], "left").select(key, offset, F.coalesce("_b", F.lit(0)).alias("bit"))


def set_bits(log: DataFrame, key: str, offset: str, order: str, bit: str) -> DataFrame:
    """SETBIT: the log with ``old``, the bit that each command replaced (0 at first)."""
    before = F.lag(bit, 1, 0).over(Window.partitionBy(key, offset).orderBy(order))
    return log.withColumn("old", before)


# Geo ----------------------------------------------------------------------------

#: The radius that distances are computed with, and unit factors.
RADIUS_M = 6372797.560856
UNITS = {"m": 1.0, "km": 1 / 1000, "mi": 1 / 1609.344, "ft": 3.28084}


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Great-circle distance (haversine)."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return F.lit(2.0 * RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * UNITS[unit]


#: Fixed value: bits of each coordinate in a geo score.
GEO_BITS = 26


def geo_score(lon: Column, lat: Column) -> Column:
    """The score that orders points: both coordinates as fractions of their range, cut to 26
    bits; the latitude counts half. Every score is exact in a double."""
    cells = 1 << GEO_BITS
    part = lambda x, low, width: F.least(F.floor((x - low) / width * cells), F.lit(cells - 1)) / F.lit(float(cells))
    return part(lon, -180, 360) + part(lat, -90, 180) / 2


def radius_join(points: DataFrame, centres: DataFrame, radius_m: float, cell_deg: float | None = None) -> DataFrame:
    """(centre, member, metres) of all points (member, lon, lat) within the radius of a
    centre (centre, lon, lat): an equi-join on cells of latitude and longitude that are
    at least as wide as the radius, then the exact distance.

    Near the poles a circle spans many cells of longitude; there the whole ring of a
    latitude band is one cell."""
    degrees = radius_m / RADIUS_M * 57.29577951308232
    step = cell_deg or max(degrees, 1e-6)
    band = lambda lat: F.floor((lat + 90) / step).cast("int")

    def columns(b: Column) -> Column:
        """How many cells the band is divided into: as wide as the radius at its edge nearest a pole, with one band to spare."""
        edge = F.least(F.greatest(F.abs(b * step - 90 - step), F.abs((b + 2) * step - 90)), F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / step * F.cos(F.radians(edge)) * 0.99)).cast("int")

    cell = lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n).cast("int"), n)
    p = points.withColumn("_b", band(F.col("lat"))).withColumn("_c", cell(F.col("lon"), columns(F.col("_b"))))
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    c = centres.select("centre", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).withColumn("_b", band(F.col("_lat"))).withColumn("_d", near)
    c = c.withColumn("_b", F.col("_b") + F.col("_d")).withColumn("_n", columns(F.col("_b"))).withColumn("_c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("_lon"), F.col("_n")) + d, F.col("_n"))))))
    found = p.join(c, ["_b", "_c"]).withColumn("metres", distance(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat")))
    return found.where(F.col("metres") <= radius_m).select("centre", "member", "metres")


# Documents ----------------------------------------------------------------------


def json_path(doc: Column, path: str) -> Column:
    """The value at a dotted path of objects; null where there is none."""
    return F.get_json_object(doc, "$" if path in (".", "$") else "$." + path)


def _steps(path: str) -> list[str]:
    return [p for p in path.removeprefix("$").split(".") if p]


def json_set(doc: Column, path: str, value: Column) -> Column:
    """JSON.SET: the document with a JSON value at a dotted path of objects. Steps that are
    missing or no objects become objects; a null document is an empty one; a value or
    document that cannot be read gives null. Keys come in sorted order, as they are stored.
    There is no built-in for it, so documents pass through Arrow in batches."""
    steps = _steps(path)

    @F.pandas_udf("string")
    def put(docs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(docs, values):
            try:
                root, new = {} if d is None else json.loads(d), json.loads(v)
                if steps:
                    at = root
                    for p in steps[:-1]:
                        at[p] = at = at[p] if isinstance(at.get(p), dict) else {}
                    at[steps[-1]] = new
                out.append(json.dumps(root if steps else new, separators=(",", ":"), sort_keys=True, ensure_ascii=False))
            except (TypeError, ValueError, AttributeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return put(doc, value)


def json_deleted(docs: DataFrame, key: str, keys: list) -> DataFrame:
    """JSON.DEL: the documents without those of the given keys, whole."""
    return docs.where(~F.col(key).isin(keys))


def json_type(doc: Column) -> Column:
    """object, array, string, number, boolean or null."""
    t = F.btrim(doc)
    first = F.substring(t, 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").when(t.rlike(r"^-?[0-9]"), "number")
    )


# Streams ------------------------------------------------------------------------


def entry_ids(entries: DataFrame, key: str, ms: str, *order: str) -> DataFrame:
    """XADD with ``*``: adds ``id``, the millisecond and the number of the entry within it
    in its stream, from 0."""
    w = Window.partitionBy(key, ms).orderBy(*order)
    return entries.withColumn("id", F.concat_ws("-", F.col(ms).cast("string"), (F.row_number().over(w) - 1).cast("string")))


def lengths(entries: DataFrame, key: str) -> DataFrame:
    """XLEN of every stream."""
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("len"))


def last_entries(entries: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """XREVRANGE with COUNT: the newest entries of each stream with ``back`` from 0."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entries.withColumn("back", F.row_number().over(w) - 1).where(F.col("back") < count)


def consumers(delivered: DataFrame, acked: DataFrame, ids: list[str], group: str, consumer: str, entry: str) -> DataFrame:
    """(group, consumer, n_pending, first, last): what each consumer of a group was given
    (one row per entry) and nobody has acknowledged."""
    open_ = pending(delivered, acked, *ids)
    return open_.groupBy(group, consumer).agg(F.count(F.lit(1)).alias("n_pending"), F.min(entry).alias("first"), F.max(entry).alias("last"))


def stream_range(entries: DataFrame, first: str, last: str, id_col: str = "id") -> DataFrame:
    """Entries with first <= id <= last, ids compared as text; ``-`` and ``+`` are open ends."""
    out = entries
    if first != "-":
        out = out.where(F.col(id_col) >= first)
    if last != "+":
        out = out.where(F.col(id_col) <= last)
    return out


def trimmed(entries: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The last ``keep`` entries of each stream."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def read_after(entries: DataFrame, key: str, order: str, after, count: int) -> DataFrame:
    """Of each stream the first ``count`` entries after a place."""
    w = Window.partitionBy(key).orderBy(order)
    return entries.where(F.col(order) > after).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def pending(delivered: DataFrame, acked: DataFrame, *ids: str) -> DataFrame:
    """What was delivered and not acknowledged."""
    return delivered.join(acked.select(*ids).distinct(), list(ids), "left_anti")


def fan_out(messages: DataFrame, subscriptions: DataFrame, channel: str) -> DataFrame:
    """Each message for each subscriber of its channel."""
    return messages.join(subscriptions, channel)

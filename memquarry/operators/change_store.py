"""A log-structured store of changes: sorted runs, merge on read, compaction.

A change is a row of the log with a type:

====  ==============  ======================================================
code  name            effect
====  ==============  ======================================================
1     SET             the key exists, with value and deadline
2     DELETE          the key is gone
3     EXPIRE          only the deadline of a key that exists (0 or less: none)
4     VADD            adds or replaces (key, space, id)
6     VTOMBSTONE      removes (key, space, id)
7     DELETE_INDEX    removes all ids of (key, space)
====  ==============  ======================================================

*Append* writes a run: the changes divided into buckets by hash of (tenant, key), each
bucket sorted by key and log position. *Read* gives the same bucket of all runs to one
task, which merges the sorted runs and walks the result key by key; tombstones (DELETE,
VTOMBSTONE, DELETE_INDEX) take out what lies before them. Nothing is shuffled. A bucket
that holds more than ``hot_bytes``, as when one key has a large share of all changes, is
not left to one task: its rows are reduced to maxima by key where they are read, and only
those are shuffled. That gives the same result, as every rule of the log can be stated
with the last position of each kind of change of a key, and "last" is a maximum.
*Compaction* is by levels: when a level has more than ``compact_after`` runs, they are
merged into one of the next level without the changes that a later one has made void.
A *manifest* names the runs that count. It is written last, under a new number, so a
job that is cut off leaves the store as it was, and a later session opens it where the
last one left off. Folders that a compaction has replaced are removed by the next one.

Defined results: rows with null key, null seq or a type not listed are ignored;
a null effect_no counts as 0, a null space as ``''``, a null deadline as none;
null tenants and ids are values like others; an empty log gives an empty state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memquarry.plans import bucketed, files
from memquarry.plans.scratch import new_path

SET, DELETE, EXPIRE, VADD, VTOMBSTONE, DELETE_INDEX = 1, 2, 3, 4, 6, 7
RUN_COLUMNS = ("tenant_id", "key", "space", "id", "seq", "effect_no", "type", "expires_at", "ts_ns", "value", "vector")
RUN_SCHEMA = "tenant_id string, key string, space string, id string, seq bigint, effect_no int, type int, expires_at bigint, ts_ns bigint, value string, vector array<float>"
BUCKET = ("tenant_id", "key")
KEY = ("tenant_id", "key", "space", "id")
INDEX = ("tenant_id", "key", "space")


def normalised(changes: DataFrame) -> DataFrame:
    """The changes that count, in the columns of a run.

    SET keys have space and id ``''``; index-wide deletions have id ``''``.
    Columns of the log beyond those of a run are left out."""
    kind = F.col("type").cast("int")
    is_vector = kind.isin(VADD, VTOMBSTONE, DELETE_INDEX)
    is_entry = kind.isin(VADD, VTOMBSTONE)
    have = set(changes.columns)
    optional = [(F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in (("ts_ns", "bigint"), ("value", "string"), ("vector", "array<float>"))]
    return changes.where(F.col("key").isNotNull() & F.col("seq").isNotNull() & kind.isin(SET, DELETE, EXPIRE, VADD, VTOMBSTONE, DELETE_INDEX)).select(
        "tenant_id",
        "key",
        F.when(is_vector, F.coalesce("space", F.lit(""))).otherwise("").alias("space"),
        F.when(is_entry, F.col("id")).otherwise("").alias("id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("effect_no").cast("int"), F.lit(0)).alias("effect_no"),
        kind.alias("type"),
        F.greatest(F.coalesce(F.col("expires_at").cast("bigint"), F.lit(0)), F.lit(0)).alias("expires_at"),
        *optional,
    )


def _at() -> Column:
    return F.struct("seq", "effect_no")


def _last(kind: int | tuple[int, ...], also: Column | None = None) -> Column:
    kinds = kind if isinstance(kind, tuple) else (kind,)
    cond = F.col("type").isin(*kinds)
    return F.max(F.when(cond if also is None else cond & also, _at()))


def merge(changes: DataFrame, now_ns: int, payload: bool = False) -> DataFrame:
    """The state that the normalised changes lead to, as at ``now_ns``.

    A key lives if its last SET came after its last DELETE, was not past its
    deadline, and no EXPIRE after it set a deadline that has passed; an entry of
    an index lives if its last VADD came after its last VTOMBSTONE and after the
    last DELETE_INDEX of its index. ``seq`` is that of the last SET or VADD. With
    ``payload``, value, vector, current deadline and time of writing are added.
    """
    past = (F.col("expires_at") > 0) & (F.col("expires_at") <= F.lit(now_ns))
    keys = changes.where(F.col("type").isin(SET, DELETE, EXPIRE))
    put = F.struct("seq", "effect_no", past.alias("void"), *(["expires_at", "ts_ns", "value"] if payload else []))
    state = (
        keys.groupBy(*KEY)
        .agg(
            F.max(F.when(F.col("type") == SET, put)).alias("put"),
            _last(DELETE).alias("gone"),
            _last(EXPIRE, past).alias("kill"),
            *([F.max(F.when(F.col("type") == EXPIRE, F.struct("seq", "effect_no", "expires_at"))).alias("moved")] if payload else []),
        )
        .where(F.col("put").isNotNull() & ~F.col("put.void"))
        .withColumn("at", F.struct("put.seq", "put.effect_no"))
        .where((F.col("gone").isNull() | (F.col("gone") < F.col("at"))) & (F.col("kill").isNull() | (F.col("kill") < F.col("at"))))
    )
    vput = F.struct("seq", "effect_no", *(["ts_ns", "vector"] if payload else []))
    entries = (
        changes.where(F.col("type").isin(VADD, VTOMBSTONE))
        .groupBy(*KEY)
        .agg(F.max(F.when(F.col("type") == VADD, vput)).alias("put"), _last(VTOMBSTONE).alias("gone"))
        .withColumn("at", F.struct("put.seq", "put.effect_no"))
        .where(F.col("put").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("at"))))
    )
    dropped = (
        changes.where(F.col("type") == DELETE_INDEX)
        .groupBy(*INDEX)
        .agg(F.max(_at()).alias("dropped"))
        .select(F.col("tenant_id").alias("d_tenant"), F.col("key").alias("d_key"), F.col("space").alias("d_space"), "dropped")
    )
    entries = entries.join(
        dropped,
        F.col("tenant_id").eqNullSafe(F.col("d_tenant")) & (F.col("key") == F.col("d_key")) & (F.col("space") == F.col("d_space")),
        "left",
    ).where(F.col("dropped").isNull() | (F.col("dropped") < F.col("at")))
    if not payload:
        return state.select(*KEY, "put.seq").unionAll(entries.select(*KEY, "put.seq"))
    deadline = F.when(F.col("moved.seq").isNotNull() & (F.struct("moved.seq", "moved.effect_no") > F.col("at")), F.col("moved.expires_at")).otherwise(F.col("put.expires_at"))
    return state.select(*KEY, "put.seq", "put.ts_ns", "put.value", F.lit(None).cast("array<float>").alias("vector"), deadline.alias("expires_at")).unionAll(
        entries.select(*KEY, "put.seq", "put.ts_ns", F.lit(None).cast("string"), "put.vector", F.lit(0).cast("bigint"))
    )


def merge_runs(changes: DataFrame, now_ns: int, payload: bool = False) -> DataFrame:
    """``merge`` for changes that are bucketed by (tenant, key): one walk over keys, entries
    and deletions of indexes together, without a shuffle."""
    kind = F.col("type")
    past = (F.col("expires_at") > 0) & (F.col("expires_at") <= F.lit(now_ns))
    put = F.struct("seq", "effect_no", past.alias("void"), *(["expires_at", "ts_ns", "value", "vector"] if payload else []))
    seen = (
        changes.withColumn("what", _what())
        .groupBy(*INDEX, "what", "id")
        .agg(
            F.max_by(put, F.when(kind.isin(SET, VADD), _at())).alias("put"),
            F.max(F.when(kind.isin(SET, VADD), _at())).alias("at"),
            _last((DELETE, VTOMBSTONE)).alias("gone"),
            _last(EXPIRE, past).alias("kill"),
            _last(DELETE_INDEX).alias("dropped"),
            *([F.max(F.when(kind == EXPIRE, F.struct("seq", "effect_no", "expires_at"))).alias("moved")] if payload else []),
        )
        .withColumn("dropped", F.when(F.col("what") == 1, F.max("dropped").over(Window.partitionBy(*INDEX))))
    )
    before = lambda c: F.col(c).isNull() | (F.col(c) < F.col("at"))
    live = seen.where(F.col("at").isNotNull() & before("gone") & before("kill") & before("dropped") & ((F.col("what") == 1) | ~F.col("put.void")))
    if not payload:
        return live.select(*KEY, "at.seq")
    deadline = F.when(F.struct("moved.seq", "moved.effect_no") > F.col("at"), F.col("moved.expires_at")).otherwise(F.col("put.expires_at"))
    is_key = F.col("what") == 0
    return live.select(*KEY, "at.seq", "put.ts_ns", F.when(is_key, F.col("put.value")).alias("value"), F.when(~is_key, F.col("put.vector")).alias("vector"), F.when(is_key, F.when(F.col("moved").isNull(), F.col("put.expires_at")).otherwise(deadline)).otherwise(F.lit(0)).alias("expires_at"))


class ChangeStore:
    """Runs of changes in one folder, which a manifest lists.

    ``buckets`` and the columns they are made of hold for the life of a store: choose as
    many as leave a bucket of all runs well under ``hot_bytes``."""

    def __init__(self, spark: SparkSession, path: str | None = None, compact_after: int = 8, buckets: int = 32, hot_bytes: int = 1 << 30) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "changes")
        self.compact_after, self.hot_bytes = compact_after, hot_bytes
        known = [n for n in files.names(spark, f"{self.path}/manifest") if n.endswith(".json")]
        self._number = int(known[-1].split(".")[0]) if known else 0
        self._now = json.loads(files.read_text(spark, f"{self.path}/manifest/{known[-1]}")) if known else {"buckets": buckets, "runs": [], "retired": []}

    def runs(self) -> list[str]:
        """The folders that count, oldest level first."""
        return [f"{self.path}/{r['name']}" for r in sorted(self._now["runs"], key=lambda r: (-r["level"], r["name"]))]

    def append(self, changes: DataFrame) -> None:
        """Write the changes as a run; merge the runs of levels that have too many."""
        name = self._write(normalised(changes))
        self._record([*self._now["runs"], {"name": name, "level": 0}], self._now["retired"])
        level = 0
        while len(mine := [r for r in self._now["runs"] if r["level"] == level]) > self.compact_after:
            self._merge(mine, level + 1)
            level += 1

    def changes(self) -> DataFrame:
        if not self._now["runs"]:
            raise ValueError("the store is empty")
        return self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs())

    def state(self, now_ns: int, payload: bool = False) -> DataFrame:
        """What the changes lead to, as at ``now_ns``."""
        if not self._now["runs"]:
            raise ValueError("the store is empty")
        hot, rest = self._parts(self.runs())
        out = [merge_runs(rest, now_ns, payload)] if rest is not None else []
        out += [merge(hot, now_ns, payload)] if hot is not None else []
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def compact(self) -> None:
        """One run from all: repeats go, and so do changes before the last SET, DELETE, VADD
        or VTOMBSTONE of their key, and entries before the last DELETE_INDEX of their index.
        The last ones stay, as a change that arrives late may lie before them."""
        if self._now["runs"]:
            self._merge(self._now["runs"], 1 + max(r["level"] for r in self._now["runs"]))

    def _parts(self, paths: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """The changes of the buckets that are too large for a task, and the others as a
        bucketed table."""
        read = lambda p: bucketed.read(self.spark, p, RUN_SCHEMA, self._now["buckets"], list(BUCKET), [*KEY, "seq", "effect_no"])
        if sum(files.size(self.spark, p) for p in paths) <= self.hot_bytes:
            return None, read(paths)
        large, small = bucketed.large_files(self.spark, paths, self.hot_bytes)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*large) if large else None, read(small) if small else None

    def _merge(self, runs: list[dict], level: int) -> None:
        hot, rest = self._parts([f"{self.path}/{r['name']}" for r in runs])
        parts = [f(p) for f, p in ((_survivors_of_large, hot), (_survivors, rest)) if p is not None]
        name = self._write(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        gone = [r["name"] for r in runs]
        self._record([r for r in self._now["runs"] if r["name"] not in gone] + [{"name": name, "level": level}], gone)
        for old in set(self._retired) - set(gone):
            files.remove(self.spark, f"{self.path}/{old}")

    def _record(self, runs: list[dict], retired: list[str]) -> None:
        self._retired = self._now["retired"]
        text = json.dumps({"buckets": self._now["buckets"], "runs": runs, "retired": retired})
        files.write_new(self.spark, f"{self.path}/manifest/{self._number + 1:010d}.json", text)
        self._number += 1
        self._now = json.loads(text)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{self._number + 1:010d}-{uuid.uuid4().hex[:8]}"
        bucketed.write(rows.select(*RUN_COLUMNS), f"{self.path}/{name}", self._now["buckets"], list(BUCKET), [*KEY, "seq", "effect_no"])
        return name


#: What makes two rows deliveries of the same change.
SAME = ("tenant_id", "key", "space", "id", "seq", "effect_no", "type")


def _what() -> Column:
    """Keys, entries of an index and indexes may have the same names."""
    return F.when(F.col("type").isin(VADD, VTOMBSTONE), 1).when(F.col("type") == DELETE_INDEX, 2).otherwise(0)


def _kept() -> Column:
    """Whether a change still counts beside ``base``, the last of its key that is no EXPIRE,
    and ``dropped``, the last deletion of its index."""
    return (F.col("base").isNull() | (_at() >= F.col("base"))) & (F.col("dropped").isNull() | (_at() > F.col("dropped")))


def _survivors(rows: DataFrame) -> DataFrame:
    """Of bucketed changes those that no later one makes void, without a shuffle."""
    wide = rows.dropDuplicates(list(SAME)).withColumn("what", _what())
    of = lambda *keys: Window.partitionBy(*keys)
    wide = wide.withColumn("base", F.max(F.when(F.col("type") != EXPIRE, _at())).over(of(*INDEX, "what", "id")))
    wide = wide.withColumn("dropped", F.when(F.col("what") == 1, F.max(F.when(F.col("type") == DELETE_INDEX, _at())).over(of(*INDEX))))
    return wide.where(_kept()).select(*RUN_COLUMNS)


def _survivors_of_large(rows: DataFrame) -> DataFrame:
    """The same where a key may have any number of changes: the last ones are maxima, made
    before a shuffle, and come back by joins, whose large keys AQE splits."""
    wide = rows.dropDuplicates(list(SAME)).withColumn("what", _what())

    def with_last(df: DataFrame, last: DataFrame, keys: tuple, name: str) -> DataFrame:
        other = last.select(*[F.col(c).alias(f"_{c}") for c in keys], name)
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return df.join(other, same, "left").drop(*[f"_{c}" for c in keys])

    names = (*INDEX, "what", "id")
    wide = with_last(wide, wide.where(F.col("type") != EXPIRE).groupBy(*names).agg(F.max(_at()).alias("base")), names, "base")
    dropped = rows.where(F.col("type") == DELETE_INDEX).groupBy(*INDEX).agg(F.max(_at()).alias("dropped"))
    wide = with_last(wide, dropped, INDEX, "dropped").withColumn("dropped", F.when(F.col("what") == 1, F.col("dropped")))
    return wide.where(_kept()).select(*RUN_COLUMNS)

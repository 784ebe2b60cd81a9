"""Queries on the change feed and on raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import change_store, row_errors
from memquarry.plans.scratch import new_path, written
from memquarry.queries import Registry
from memquarry.sources import binary, snapshots
from memquarry.sources.tables import micros, table

R = Registry()
NOW_NS = 1748736000000000000

_P1_SQL = f"""
WITH log AS (
  SELECT DISTINCT tenant_id, seq, coalesce(effect_no, 0) AS effect_no, type, key,
         CASE WHEN type IN (4, 6, 7) THEN coalesce(space, '') ELSE '' END AS space,
         CASE WHEN type IN (4, 6) THEN id ELSE '' END AS id,
         CASE WHEN expires_at > 0 THEN expires_at ELSE 0 END AS expires_at
  FROM changelog WHERE key IS NOT NULL AND seq IS NOT NULL AND type IN (1, 2, 3, 4, 6, 7)),
keys AS (
  SELECT *, last_value(CASE WHEN type IN (1, 2) THEN type END IGNORE NULLS) OVER w AS base,
         last_value(CASE WHEN type IN (1, 2) THEN seq END IGNORE NULLS) OVER w AS base_seq,
         sum(CASE WHEN type IN (1, 2) THEN 1 ELSE 0 END) OVER w AS part,
         row_number() OVER (PARTITION BY tenant_id, key ORDER BY seq DESC, effect_no DESC) AS back
  FROM log WHERE type IN (1, 2, 3)
  WINDOW w AS (PARTITION BY tenant_id, key ORDER BY seq, effect_no ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT tenant_id, key, part, base, base_seq FROM keys WHERE back = 1),
live AS (
  SELECT e.tenant_id, e.key, '' AS space, '' AS id, e.base_seq AS seq FROM ends e
  WHERE e.base = 1 AND NOT EXISTS (
    SELECT 1 FROM keys k WHERE k.tenant_id IS NOT DISTINCT FROM e.tenant_id AND k.key = e.key AND k.part = e.part
      AND k.expires_at > 0 AND k.expires_at <= {NOW_NS})),
entries AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, key, space, id ORDER BY seq DESC, effect_no DESC) AS back
  FROM log WHERE type IN (4, 6)),
vectors_live AS (
  SELECT tenant_id, key, space, id, seq FROM entries e
  WHERE back = 1 AND type = 4 AND NOT EXISTS (
    SELECT 1 FROM log d WHERE d.type = 7 AND d.tenant_id IS NOT DISTINCT FROM e.tenant_id AND d.key = e.key AND d.space = e.space
      AND (d.seq > e.seq OR d.seq = e.seq AND d.effect_no > e.effect_no)))
SELECT tenant_id, key, space, id, seq FROM live
UNION ALL SELECT tenant_id, key, space, id, seq FROM vectors_live
"""


def _fed(spark: SparkSession, base: str, store: change_store.ChangeStore, n: int) -> change_store.ChangeStore:
    """The feed appended in ``n`` parts, in the order in which it arrived."""
    feed = table(spark, base, "changelog")
    us = micros("received_at")
    cuts = feed.agg(F.approx_percentile(us, [i / n for i in range(1, n)])).first()[0] or []
    number = sum([(us > c).cast("int") for c in cuts], F.lit(0))
    for i in range(len(cuts) + 1):
        store.append(feed.where(F.coalesce(number, F.lit(0)) == i))
    return store


@R.query(_P1_SQL)
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Everything that exists once all effects are applied: four runs, merged on read."""
    return _fed(spark, base, change_store.ChangeStore(spark), 4).state(NOW_NS)


@R.query(_P1_SQL)
def p1_compacted(spark: SparkSession, base: str) -> DataFrame:
    """The same state from a store that merges its runs at every second append, opened anew."""
    store = _fed(spark, base, change_store.ChangeStore(spark, compact_after=1), 4)
    store.compact()
    return change_store.ChangeStore(spark, store.path).state(NOW_NS)


@R.query(_P1_SQL)
def snapshot_restored(spark: SparkSession, base: str) -> DataFrame:
    """The state written as a snapshot and read through its pointer."""
    path = new_path(spark, "snapshot")
    snapshots.write_snapshot(_fed(spark, base, change_store.ChangeStore(spark), 1).state(NOW_NS), path, 1, keep_tenants_apart=False)
    return snapshots.read_snapshot(spark, path)[0]


@R.query(_P1_SQL)
def backup_restored(spark: SparkSession, base: str) -> DataFrame:
    """The state copied with its manifest, checked and read from the copy."""
    state = written(_fed(spark, base, change_store.ChangeStore(spark), 1).state(NOW_NS), "state")
    copy = new_path(spark, "backup")
    snapshots.backup(spark, state.inputFiles()[0].rsplit("/", 1)[0], copy)
    return snapshots.restore(spark, copy)


@R.query("""WITH e AS (SELECT DISTINCT tenant_id, seq, effect_no, type, key, space, id, value, expires_at, vector FROM changelog WHERE seq IS NOT NULL)
SELECT tenant_id, seq, (row_number() OVER (PARTITION BY tenant_id, seq ORDER BY effect_no, type, key, space, id, value, vector, expires_at) - 1)::INTEGER AS effect_no, type::INTEGER AS type, key, id, value, len(vector)::INTEGER AS dim FROM e""")
def wal_scan(spark: SparkSession, base: str) -> DataFrame:
    """The log packed into checked frames and read again."""
    blobs = binary.packed_frames(table(spark, base, "changelog").where("seq IS NOT NULL"), "blob")
    return binary.frames_of(blobs, "blob").select("tenant_id", "seq", "effect_no", "type", "key", "id", "value", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"))


_FIELD = r"""("(?:[^"]|"")*"|[^",][^,]*|)"""
_P4_CHECKED = rf"""
WITH records AS (
  SELECT DISTINCT line_id, raw, CASE WHEN right(raw, 1) = chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS body FROM billing_lines),
parts AS (
  SELECT line_id, raw, body, regexp_full_match(body, '{_FIELD}(,{_FIELD})*') AS sound,
         regexp_extract_all(',' || body, ',{_FIELD}', 1) AS p FROM records),
fields AS (
  SELECT line_id, raw, sound, len(p) AS n,
         list_transform(p, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:length(x)-1], '""', '"') ELSE x END, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS f
  FROM parts),
checked AS (
  SELECT line_id, CASE
    WHEN raw IS NULL THEN 'column_count'
    WHEN NOT sound THEN 'quoting'
    WHEN n <> 6 THEN 'column_count'
    WHEN NOT regexp_full_match(f[1], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR left(f[1], 4) = '0000' OR try_cast(f[1] AS DATE) IS NULL THEN 'date'
    WHEN length(f[2]) NOT BETWEEN 1 AND 100 THEN 'timekeeper'
    WHEN NOT regexp_full_match(f[3], '[0-9]+([.][0-9]+)?') OR try_cast(f[3] AS DOUBLE) IS NULL OR try_cast(f[3] AS DOUBLE) <= 0 OR try_cast(f[3] AS DOUBLE) > 24 THEN 'hours'
    WHEN NOT regexp_full_match(f[4], '([A-Za-z][0-9]{{3}})?') THEN 'task_code'
    WHEN NOT regexp_full_match(f[5], '([A-Za-z][0-9]{{3}})?') THEN 'activity_code'
    WHEN f[6] = '' THEN 'narrative' END AS reason, f
  FROM fields)
"""


@R.query(_P4_CHECKED + "SELECT line_id, reason FROM checked WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The records that cannot be loaded, with the first reason."""
    _, bad = row_errors.time_entries(table(spark, base, "billing_lines"))
    return bad.select("line_id", "reason").distinct()


@R.query(
    _P4_CHECKED
    + """SELECT line_id, f[1] AS entry_date, f[2] AS timekeeper, round(f[3]::DOUBLE, 6) AS hours,
       upper(nullif(f[4], '')) AS task_code, upper(nullif(f[5], '')) AS activity_code, f[6] AS narrative
FROM checked WHERE reason IS NULL"""
)
def p4_loaded(spark: SparkSession, base: str) -> DataFrame:
    """The valid records as typed entries; repeated deliveries once."""
    good, _ = row_errors.time_entries(table(spark, base, "billing_lines"))
    return good.select(
        "line_id",
        F.col("date").cast("string").alias("entry_date"),
        "timekeeper",
        F.round(F.col("hours").cast("double"), 6).alias("hours"),
        "task_code",
        "activity_code",
        "narrative",
    ).distinct()

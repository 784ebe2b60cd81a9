"""Queries on collections: hash = a customer's orders by priority, list = the lines of an
order, set = the customers of an order status, zset = customers of a nation by balance,
bitmap = the users of an event type, geo = suppliers, stream = a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import collections as C
from memquarry.operators import keyspace as K
from memquarry.queries import Registry
from memquarry.sources.tables import table

R = Registry()

_HASH = "WITH h AS (SELECT o_custkey AS key, o_orderpriority AS field, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)\n"


def _hash(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("field"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return K.latest(o, ["key", "field"], "seq", "value")


@R.query(_HASH + "SELECT key, field, value FROM h")
def hash_hgetall(spark: SparkSession, base: str) -> DataFrame:
    return _hash(spark, base)


@R.query(_HASH + "SELECT a.field, value FROM (SELECT unnest(['1-URGENT', 'nothing', '5-LOW']) AS field) a LEFT JOIN (SELECT * FROM h WHERE key = 7) USING (field)")
def hash_hmget(spark: SparkSession, base: str) -> DataFrame:
    one = _hash(spark, base).where("key = 7")
    return K.mget(one, ["1-URGENT", "nothing", "5-LOW"], "field").select(F.col("key").alias("field"), "value")


@R.query(_HASH + "SELECT key, field, value FROM h WHERE NOT (field = '5-LOW' AND key % 2 = 0)")
def hash_hdel(spark: SparkSession, base: str) -> DataFrame:
    h = _hash(spark, base)
    gone = h.where("key % 2 = 0 AND field = '5-LOW'").select("key", "field")
    return h.join(gone, ["key", "field"], "left_anti")


@R.query("SELECT o_custkey AS key, o_orderpriority AS field, sum(o_orderkey % 100)::BIGINT AS value FROM orders GROUP BY ALL")
def hash_hincrby(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("field")).agg(F.sum(F.col("o_orderkey") % 100).alias("value"))


@R.query(_HASH + "SELECT key, count(*) AS len, bool_or(field = '5-LOW') AS has_low FROM h GROUP BY key")
def hash_hlen_hexists(spark: SparkSession, base: str) -> DataFrame:
    return _hash(spark, base).groupBy("key").agg(F.count(F.lit(1)).alias("len"), F.bool_or(F.col("field") == "5-LOW").alias("has_low"))


_LIST = "WITH l AS (SELECT l_orderkey AS key, l_partkey AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)\n"


def _list(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("value"), "l_linenumber", "l_suppkey")
    return C.placed(rows, "key", "l_linenumber", "value", "l_suppkey").select("key", "value", "pos")


@R.query(_LIST + "SELECT key, pos::INTEGER AS pos, value FROM l WHERE pos >= greatest(n - 3, 0) AND pos <= n - 2")
def list_lrange(spark: SparkSession, base: str) -> DataFrame:
    return C.ranged(_list(spark, base), "key", -3, -2)


@R.query(_LIST + "SELECT key, pos::INTEGER AS pos, value FROM l WHERE pos = n - 1")
def list_lindex(spark: SparkSession, base: str) -> DataFrame:
    return C.at_index(_list(spark, base), "key", -1)


@R.query(_LIST + "SELECT key, pos::INTEGER AS pos, value FROM l WHERE pos BETWEEN 1 AND 2")
def list_ltrim(spark: SparkSession, base: str) -> DataFrame:
    return C.ranged(_list(spark, base), "key", 1, 2)


@R.query(_LIST + "SELECT key, pos::INTEGER AS pos, CASE WHEN pos = 0 THEN -1 WHEN pos = n - 2 THEN -2 ELSE value END AS value FROM l")
def list_lset(spark: SparkSession, base: str) -> DataFrame:
    """The last but one element of each list set to -2, then the first to -1."""
    last = C.element_set(_list(spark, base), "key", -2, "value", F.lit(-2).cast("bigint"))
    return C.element_set(last, "key", 0, "value", F.lit(-1).cast("bigint")).select("key", "pos", "value")


@R.query(_LIST + "SELECT key, pos::INTEGER AS pos, value, CASE WHEN pos = 0 THEN 'left' ELSE 'right' END AS \"end\" FROM l WHERE pos = 0 OR pos = n - 1")
def list_popped(spark: SparkSession, base: str) -> DataFrame:
    """The elements that one LPOP and then one RPOP of each list return."""
    return C.popped(_list(spark, base), "key", 1, 1).where(F.col("end").isNotNull()).select("key", "pos", "value", "end")


@R.query(_LIST + "SELECT key, max(n) AS len, count_if(pos NOT IN (0, n - 1))::BIGINT AS after_pops FROM l GROUP BY key")
def list_llen_pops(spark: SparkSession, base: str) -> DataFrame:
    """Lengths, and what is left after one LPOP and one RPOP."""
    n = F.count(F.lit(1))
    return _list(spark, base).groupBy("key").agg(n.alias("len"), F.greatest(n - 2, F.lit(0)).alias("after_pops"))


@R.query("SELECT user_id AS key, event_id AS value, (row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END) - 1)::INTEGER AS pos FROM events")
def list_push_ends(spark: SparkSession, base: str) -> DataFrame:
    """Each third event is pushed to the left end, the others to the right."""
    e = table(spark, base, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"))
    return C.pushed(e, "key", "value", F.col("value") % 3 == 0).select("key", "value", "pos")


_HFIRST = "WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)\n"


@R.query(_HFIRST + "SELECT o.o_orderkey AS command, (count(f.o_orderkey))::BIGINT AS added FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def hash_hset_added(spark: SparkSession, base: str) -> DataFrame:
    """HSET, one command per order: how many fields each made new."""
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("command"))
    return C.added_counts(o, ["key", "field"], "command", "command")


@R.query(_HASH + "SELECT key, count(*) AS removed FROM h WHERE field IN ('5-LOW', '1-URGENT') AND key % 2 = 0 GROUP BY key")
def hash_hdel_counts(spark: SparkSession, base: str) -> DataFrame:
    """HDEL of two fields of every second hash: how many were there."""
    h = _hash(spark, base)
    named = h.where("key % 2 = 0").select("key").distinct().withColumn("field", F.explode(F.array(F.lit("5-LOW"), F.lit("1-URGENT"))))
    return C.removed_counts(h, named, ["key", "field"], "key")


_SETS = "WITH s AS (SELECT DISTINCT o_orderstatus AS key, o_custkey AS member FROM orders)\n"


def _sets(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")).distinct()


@R.query(_SETS + "SELECT member FROM s WHERE key = 'F' INTERSECT SELECT member FROM s WHERE key = 'O'")
def set_inter(spark: SparkSession, base: str) -> DataFrame:
    return C.intersection(_sets(spark, base), "key", "member", ["F", "O"])


@R.query(_SETS + "SELECT member FROM s WHERE key = 'F' UNION SELECT member FROM s WHERE key = 'P'")
def set_union(spark: SparkSession, base: str) -> DataFrame:
    return C.union(_sets(spark, base), "key", "member", ["F", "P"])


@R.query(_SETS + "SELECT member FROM s WHERE key = 'F' EXCEPT (SELECT member FROM s WHERE key = 'O' UNION SELECT member FROM s WHERE key = 'P')")
def set_diff(spark: SparkSession, base: str) -> DataFrame:
    return C.difference(_sets(spark, base), "key", "member", ["F", "O", "P"])


@R.query(_SETS + "SELECT key, count(*) AS n, bool_or(member = 7) AS has_7 FROM s GROUP BY key")
def set_card(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("member") == 7).alias("has_7"))


@R.query()
def set_sample(spark: SparkSession, base: str) -> DataFrame:
    return C.sample(_sets(spark, base), "key", "member", 5, 42)


@R.query(_SETS + "SELECT key, count(*) AS before, least(count(*), 5)::BIGINT AS popped, (count(*) - least(count(*), 5))::BIGINT AS after FROM s GROUP BY key")
def set_spop(spark: SparkSession, base: str) -> DataFrame:
    """SPOP of five members of each set: sizes before and after."""
    p = C.spop(_sets(spark, base), "key", "member", 5, 42)
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("before"), F.count_if("popped").alias("popped"), F.count_if(~F.col("popped")).alias("after"))


@R.query("WITH l AS (SELECT o_orderstatus AS key, o_custkey AS member, o_orderpriority <> '5-LOW' AS is_add FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey DESC) = 1) SELECT key, member FROM l WHERE is_add")
def set_srem(spark: SparkSession, base: str) -> DataFrame:
    """Members after a log in which orders of low priority remove their customer and others add it."""
    o = table(spark, base, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member"), "o_orderkey", "o_orderpriority")
    return C.members_after(o, "key", "member", "o_orderkey", F.col("o_orderpriority") != "5-LOW")


@R.query("WITH f AS (SELECT o_orderstatus AS key, o_custkey, min(o_orderkey) AS first FROM orders GROUP BY ALL), c AS (SELECT DISTINCT o_orderstatus AS key, o_orderkey % 100 AS batch FROM orders), n AS (SELECT key, first % 100 AS batch, count(*) AS n FROM f GROUP BY ALL) SELECT key, batch, coalesce(n, 0)::BIGINT AS added FROM c LEFT JOIN n USING (key, batch)")
def set_sadd_counts(spark: SparkSession, base: str) -> DataFrame:
    """New members by set and batch of commands (orders by the last two digits of the key)."""
    o = table(spark, base, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member"), "o_orderkey", (F.col("o_orderkey") % 100).alias("batch"))
    return C.added_counts(o, ["key", "member"], "o_orderkey", "key", "batch")


_Z = "WITH z AS (SELECT c_nationkey AS key, c_custkey AS member, c_acctbal AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)\n"


def _zset(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("score"))


@R.query(_Z + "SELECT key, member, score, rank::INTEGER AS rank, (n - 1 - rank)::INTEGER AS revrank FROM z")
def zset_rank(spark: SparkSession, base: str) -> DataFrame:
    return C.ranks(_zset(spark, base), "key", "member", "score")


@R.query(_Z + "SELECT key, rank::INTEGER AS pos, member, score FROM z WHERE rank BETWEEN greatest(n - 5, 0) AND n - 2")
def zset_range(spark: SparkSession, base: str) -> DataFrame:
    return C.ranged(C.placed(_zset(spark, base), "key", "score", "member"), "key", -5, -2)


@R.query(_Z + "SELECT key, (n - 1 - rank)::INTEGER AS pos, member, score FROM z WHERE n - 1 - rank BETWEEN 0 AND 2")
def zset_revrange(spark: SparkSession, base: str) -> DataFrame:
    return C.reverse_range(_zset(spark, base), "key", "member", "score", 0, 2)


@R.query(_Z + "SELECT key, member, score FROM z WHERE score BETWEEN 0 AND 500")
def zset_range_by_score(spark: SparkSession, base: str) -> DataFrame:
    return _zset(spark, base).where(F.col("score").between(0, 500))


@R.query(_Z + "SELECT key, count(*) AS card, count_if(score >= 1000)::BIGINT AS n FROM z GROUP BY key")
def zset_count(spark: SparkSession, base: str) -> DataFrame:
    return _zset(spark, base).groupBy("key").agg(F.count(F.lit(1)).alias("card"), F.count_if(F.col("score") >= 1000).alias("n"))


@R.query("SELECT o_orderpriority AS key, o_custkey AS member, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY ALL")
def zset_incrby(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))


@R.query(_Z + "SELECT k.key, w.m::BIGINT AS member, z.score FROM (SELECT DISTINCT key FROM z) k, (SELECT unnest([7, 8, -1]) AS m) w LEFT JOIN z ON z.key = k.key AND z.member = w.m")
def zset_zscore(spark: SparkSession, base: str) -> DataFrame:
    """The scores of three members in every set, null where they are not in it."""
    return C.scores_of(_zset(spark, base), "key", "member", "score", [7, 8, -1]).select("key", F.col("member").cast("bigint").alias("member"), "score")


@R.query(_Z + "SELECT key, count_if(score < 0)::BIGINT AS removed, count_if(score >= 0)::BIGINT AS card FROM z GROUP BY key")
def zset_zrem(spark: SparkSession, base: str) -> DataFrame:
    """ZREM of the members with a negative score: how many go and how many stay."""
    z = _zset(spark, base)
    gone = z.where("score < 0").select("key", "member")
    left = C.removed(z, gone, ["key", "member"]).groupBy("key").agg(F.count(F.lit(1)).alias("card"))
    out = C.removed_counts(z, gone, ["key", "member"], "key").join(left, "key", "full_outer")
    return out.select("key", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("removed", "card")])


def _bits(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit_offset"))


@R.query("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY key")
def bitmap_count(spark: SparkSession, base: str) -> DataFrame:
    return C.bit_counts(_bits(spark, base), "key", "bit_offset")


_BITS = "WITH b AS (SELECT DISTINCT event_type AS key, user_id AS o FROM events WHERE user_id <> 5 OR event_type <> 'click')\n"


def _some_bits(spark: SparkSession, base: str) -> DataFrame:
    return _bits(spark, base).where("bit_offset <> 5 OR key <> 'click'")


@R.query(_BITS + """, r AS (SELECT key, o, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS i FROM b), s AS (SELECT key, min(o) AS one, count_if(o = i)::BIGINT AS run, (max(o) // 8 + 1) * 8 AS size FROM r GROUP BY key)
SELECT key, one AS first_one, CASE WHEN run = size THEN -1 ELSE run END AS first_zero FROM s""")
def bitmap_pos(spark: SparkSession, base: str) -> DataFrame:
    b = _some_bits(spark, base)
    return C.first_one(b, "key", "bit_offset").withColumnRenamed("pos", "first_one").join(C.first_zero(b, "key", "bit_offset").withColumnRenamed("pos", "first_zero"), "key")


@R.query(_BITS + "SELECT k.key, w.o::BIGINT AS bit_offset, (CASE WHEN b.o IS NULL THEN 0 ELSE 1 END)::INTEGER AS bit FROM (SELECT DISTINCT key FROM b) k, (SELECT unnest([0, 5, 100000]) AS o) w LEFT JOIN b ON b.key = k.key AND b.o = w.o")
def bitmap_getbit(spark: SparkSession, base: str) -> DataFrame:
    return C.get_bits(_some_bits(spark, base), "key", "bit_offset", [0, 5, 100000]).select("key", F.col("bit_offset").cast("bigint").alias("bit_offset"), "bit")


@R.query("SELECT event_id, coalesce(lag((event_id % 2)::INTEGER) OVER (PARTITION BY event_type, user_id ORDER BY event_id), 0)::INTEGER AS old FROM events")
def bitmap_setbit_old(spark: SparkSession, base: str) -> DataFrame:
    """SETBIT of a user's bit to the parity of the event: the bit before."""
    e = table(spark, base, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 2).cast("int").alias("bit"))
    return C.set_bits(e, "event_type", "user_id", "event_id", "bit").select("event_id", "old")


_GEO = "WITH g AS (SELECT s_suppkey AS member, ((s_suppkey * 37) % 360 - 180)::DOUBLE AS lon, ((s_suppkey * 17) % 170 - 85)::DOUBLE AS lat FROM supplier), d AS (SELECT a.member AS a, b.member AS b, 2 * 6372797.560856 * asin(sqrt(least(1.0, sin((radians(b.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin((radians(b.lon) - radians(a.lon)) / 2) ** 2))) AS m FROM g a, g b)\n"


def _geo(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, base, "supplier").select(k.alias("member"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 170 - 85).cast("double").alias("lat"))


@R.query(_GEO + "SELECT b AS member, round(m / 1000, 3) AS km, round(m / 1609.344, 3) AS mi, round(m * 3.28084, 1) AS ft FROM d WHERE a = 1")
def geo_dist(spark: SparkSession, base: str) -> DataFrame:
    g = _geo(spark, base)
    lon, lat = g.where("member = 1").select("lon", "lat").first()
    far = lambda unit: C.distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    return g.select("member", F.round(far("km"), 3).alias("km"), F.round(far("mi"), 3).alias("mi"), F.round(far("ft"), 1).alias("ft"))


@R.query(_GEO + "SELECT b AS centre, a AS member, round(m, 2) AS metres FROM d WHERE b % 20 = 0 AND m <= 1500000")
def geo_radius_join(spark: SparkSession, base: str) -> DataFrame:
    """All suppliers within 1,500 km of each whose key is divisible by 20."""
    g = _geo(spark, base)
    centres = g.where("member % 20 = 0").withColumnRenamed("member", "centre")
    return C.radius_join(g, centres, 1500000.0).withColumn("metres", F.round("metres", 2))


@R.query(_GEO + "SELECT (pos - 1)::INTEGER AS pos, lon, lat FROM (SELECT unnest(['7', '100000', '3']) AS k, unnest(range(1, 4)) AS pos) LEFT JOIN g ON g.member::VARCHAR = k")
def geo_pos(spark: SparkSession, base: str) -> DataFrame:
    points = _geo(spark, base).select(F.col("member").cast("string").alias("key"), F.struct("lon", "lat").alias("value"))
    return K.mget(points, ["7", "100000", "3"]).select("pos", "value.lon", "value.lat")


@R.query(_GEO.split(", d AS")[0] + """, f AS (SELECT member, least(floor((lon + 180) / 360 * 67108864), 67108863)::BIGINT AS a, least(floor((lat + 90) / 180 * 67108864), 67108863)::BIGINT AS b FROM g)
SELECT member, list_sum(list_transform(range(26), lambda i: ((a >> (25 - i)) & 1) / pow(2.0, i + 1) + ((b >> (25 - i)) & 1) / pow(2.0, i + 2))) AS score FROM f""")
def geo_scores(spark: SparkSession, base: str) -> DataFrame:
    """The score that orders a point: a binary digit of each coordinate in turn."""
    return _geo(spark, base).select("member", C.geo_score(F.col("lon"), F.col("lat")).alias("score"))


@R.query("WITH l AS (SELECT o_custkey AS member, ((o_orderkey * 37) % 360 - 180)::DOUBLE AS lon, ((o_orderkey * 17) % 170 - 85)::DOUBLE AS lat, o_orderkey FROM orders) SELECT member, lon, lat FROM l QUALIFY row_number() OVER (PARTITION BY member ORDER BY o_orderkey DESC) = 1")
def geo_upsert(spark: SparkSession, base: str) -> DataFrame:
    """GEOADD again and again: the last position of each member."""
    k = F.col("o_orderkey")
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("member"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 170 - 85).cast("double").alias("lat"), k)
    return K.latest(o, ["member"], "o_orderkey", "lon", "lat")


@R.query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none.deep') AS missing FROM events")
def json_get_path(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("event_id", C.json_path(F.col("props"), "k").alias("k"), C.json_path(F.col("props"), "none.deep").alias("missing"))


@R.query("SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' END AS type, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' END AS k_type FROM events")
def json_type(spark: SparkSession, base: str) -> DataFrame:
    p = F.col("props")
    return table(spark, base, "events").select("event_id", C.json_type(p).alias("type"), C.json_type(C.json_path(p, "k")).alias("k_type"))


@R.query("""SELECT event_id, json_extract_string(d, '$.k') AS k, json_extract_string(d, '$.meta.user') AS user_of, json_extract_string(d, '$.meta.kind') AS kind
FROM (SELECT event_id, json_merge_patch(props, json_object('meta', json_object('user', user_id, 'kind', event_type))) AS d FROM events)""")
def json_set_path(spark: SparkSession, base: str) -> DataFrame:
    """Two values set at paths that did not exist, read back."""
    d = C.json_set(F.col("props"), "meta.user", F.col("user_id").cast("string"))
    d = C.json_set(d, ".meta.kind", F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    e = table(spark, base, "events").select("event_id", d.alias("d"))
    return e.select("event_id", *[C.json_path(F.col("d"), p).alias(n) for p, n in (("k", "k"), ("meta.user", "user_of"), ("meta.kind", "kind"))])


@R.query("SELECT event_id, props FROM events WHERE event_id NOT IN (1, 5, 9)")
def json_del(spark: SparkSession, base: str) -> DataFrame:
    return C.json_deleted(table(spark, base, "events").select("event_id", "props"), "event_id", [1, 5, 9])


@R.query("SELECT n_nationkey, ['object', 'array', 'string', 'number', 'boolean', 'null'][n_nationkey % 6 + 1] AS type FROM nation")
def json_type_all(spark: SparkSession, base: str) -> DataFrame:
    """The type of a value of every kind."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit('"'), "n_name", F.lit('"'))
    docs = F.array(F.concat(F.lit('{"a":'), name, F.lit("}")), F.concat(F.lit("["), name, F.lit("]")), name, F.concat(F.lit("-"), k.cast("string")), F.when(k % 4 < 2, "true").otherwise("false"), F.lit("null"))
    return table(spark, base, "nation").select("n_nationkey", C.json_type(F.element_at(docs, (k % 6 + 1).cast("int"))).alias("type"))


_STREAM = "WITH x AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 || '-0' AS id, event_type FROM events)\n"


def _stream(spark: SparkSession, base: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    return table(spark, base, "events").select(F.col("user_id").alias("key"), "event_id", F.concat(ms.cast("string"), F.lit("-0")).alias("id"), "event_type")


@R.query(_STREAM + "SELECT key, id, event_type FROM x WHERE id >= '1704500000000' AND id <= '1705000000000-9'")
def stream_range(spark: SparkSession, base: str) -> DataFrame:
    return C.stream_range(_stream(spark, base), "1704500000000", "1705000000000-9").select("key", "id", "event_type")


@R.query(_STREAM + "SELECT key, id, event_id FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) <= 5")
def stream_trim_maxlen(spark: SparkSession, base: str) -> DataFrame:
    return C.trimmed(_stream(spark, base), "key", "event_id", 5).select("key", "id", "event_id")


@R.query(_STREAM + "SELECT key, event_id FROM x WHERE event_id > 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) <= 3")
def stream_read_after(spark: SparkSession, base: str) -> DataFrame:
    return C.read_after(_stream(spark, base), "key", "event_id", 5000, 3).select("key", "event_id")


@R.query(_STREAM + "SELECT key, event_id FROM x WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def stream_group_pending(spark: SparkSession, base: str) -> DataFrame:
    """Even events were delivered to the group, each third was acknowledged."""
    s = _stream(spark, base)
    return C.pending(s.where("event_id % 2 = 0").select("key", "event_id"), s.where("event_id % 3 = 0"), "event_id").select("key", "event_id")


@R.query("SELECT event_type AS key, (epoch_us(ts) // 3600000000) || '-' || (row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY event_id) - 1) AS id, event_id FROM events")
def stream_xadd_ids(spark: SparkSession, base: str) -> DataFrame:
    """Ids of entries by event type; the clock ticks once an hour, so that numbers run on."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("bigint")
    e = table(spark, base, "events").select(F.col("event_type").alias("key"), "event_id", hour.alias("hour"))
    return C.entry_ids(e, "key", "hour", "event_id").select("key", "id", "event_id")


@R.query(_STREAM + "SELECT key, count(*) AS len FROM x GROUP BY key")
def stream_xlen(spark: SparkSession, base: str) -> DataFrame:
    return C.lengths(_stream(spark, base), "key")


@R.query(_STREAM + "SELECT key, (row_number() OVER (PARTITION BY key ORDER BY event_id DESC) - 1)::INTEGER AS back, id, event_id FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) <= 4")
def stream_xrevrange(spark: SparkSession, base: str) -> DataFrame:
    return C.last_entries(_stream(spark, base), "key", "event_id", 4).select("key", "back", "id", "event_id")


@R.query("SELECT event_type AS \"group\", 'c' || (user_id % 3) AS consumer, count(*) AS n_pending, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 GROUP BY ALL")
def stream_consumers(spark: SparkSession, base: str) -> DataFrame:
    """What each of three consumers of each group has not acknowledged."""
    e = table(spark, base, "events").select(F.col("event_type").alias("group"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), "event_id")
    return C.consumers(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["group", "event_id"], "group", "consumer", "event_id")


@R.query("SELECT subscriber, channel, count(*) AS n FROM (SELECT event_type AS channel FROM events) JOIN (SELECT n_nationkey AS subscriber, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['click', 'error'] ELSE ['view'] END) AS channel FROM nation) USING (channel) GROUP BY ALL")
def pubsub_fanout(spark: SparkSession, base: str) -> DataFrame:
    """Deliveries by subscriber and channel; messages are counted by channel before the join."""
    sent = table(spark, base, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    even = F.col("n_nationkey") % 2 == 0
    subs = table(spark, base, "nation").select(F.col("n_nationkey").alias("subscriber"), F.explode(F.when(even, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array(F.lit("view")))).alias("channel"))
    return C.fan_out(sent, subs, "channel").select("subscriber", "channel", "n")

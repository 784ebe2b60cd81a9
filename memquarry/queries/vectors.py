"""Queries on vector search, with ``embeddings`` as the index: id = vec_id, the spaces
``text`` and ``image`` are the two halves of a vector, documents have the same ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.functions import vector_columns as V
from memquarry.operators import blocks, ivf
from memquarry.operators import vectors as S
from memquarry.queries import Registry
from memquarry.sources import binary
from memquarry.sources.tables import table

R = Registry()
DIM = 64
_HITS = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)\n"


def _index(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))


def _space(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("id", F.slice("embedding", 1 if name == "text" else 33, 32).alias("embedding"))


def _first(spark: SparkSession, base: str, k: int, **options) -> DataFrame:
    rows = _index(spark, base)
    return S.search(rows, S.stored(rows, [0]), k, **options).select("id", "score")


@R.query(_HITS + "SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def vsearch_topk(spark: SparkSession, base: str) -> DataFrame:
    return _first(spark, base, 10)


@R.query(_HITS + "SELECT id, score FROM s WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 50")
def vsearch_min_score(spark: SparkSession, base: str) -> DataFrame:
    return _first(spark, base, 50, min_score=0.2)


@R.query(_HITS + "SELECT id, score FROM s WHERE id IN (SELECT doc_id FROM documents WHERE contains(text, 'notice')) ORDER BY score DESC, id LIMIT 10")
def vsearch_filter_contains(spark: SparkSession, base: str) -> DataFrame:
    rows = _index(spark, base)
    return S.search(S.containing(rows, _docs(spark, base), "notice"), S.stored(rows, [0]), 10).select("id", "score")


@R.query(_HITS + "SELECT h.id, score, text AS doc FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 10) h LEFT JOIN documents ON doc_id = h.id")
def vsearch_with_docs(spark: SparkSession, base: str) -> DataFrame:
    return S.with_documents(_first(spark, base, 10), _docs(spark, base))


@R.query("""WITH q AS (SELECT embedding[1:32]::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 10""")
def vsearch_space(spark: SparkSession, base: str) -> DataFrame:
    rows = _space(_index(spark, base), "text")
    return S.search(rows, S.stored(rows, [0]), 10).select("id", "score")


@R.query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id IN (3, 7, 11) AND e.vec_id <> q.vec_id)
SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5""")
def vsim_exclude_self(spark: SparkSession, base: str) -> DataFrame:
    rows = _index(spark, base)
    return S.search(rows, S.stored(rows, [3, 7, 11]), 5, exclude_self=True)


@R.query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 3""")
def knn_join(spark: SparkSession, base: str) -> DataFrame:
    """The 3 nearest of every row whose id is divisible by 20, against all rows."""
    return blocks.nearest(_index(spark, base), F.col("id") % 20 == 0, 3, DIM)


def _exact(spark: SparkSession, base: str) -> DataFrame:
    return blocks.nearest(_index(spark, base), F.col("id") % 20 == 0, 10, DIM)


def _probed(spark: SparkSession, base: str, cells: int, probes: int) -> DataFrame:
    rows = _index(spark, base)
    index = ivf.CellIndex.build(rows, DIM, cells)
    return index.search(S.stored(rows, [0, 7, 11]), 10, probes, exclude_self=True)


@R.query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id IN (0, 7, 11) AND e.vec_id <> q.vec_id)
SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10""")
def vsearch_ivf_all(spark: SparkSession, base: str) -> DataFrame:
    """The index with every cell probed, which is exact."""
    return _probed(spark, base, 16, 16)


@R.query()
def vsearch_ivf(spark: SparkSession, base: str) -> DataFrame:
    """The index with three quarters of its cells probed."""
    return _probed(spark, base, 32, 24)


@R.query()
def ivf_recall(spark: SparkSession, base: str) -> DataFrame:
    """Recall at 10 of the index with three quarters of its cells probed, for the rows whose
    id is divisible by 20: mean and 5th percentile. The test vectors are hardly clustered;
    for real ones far fewer cells do."""
    rows = _index(spark, base)
    index = ivf.CellIndex.build(rows, DIM, 32)
    queries = rows.where("id % 20 = 0")
    return ivf.recall_summary(S.recall(index.search_many(queries, 10, 24), _exact(spark, base), 10))


def _fuse_sql(w1: float, w2: float, tail: str) -> str:
    half = "WITH q AS (SELECT embedding[1:32]::DOUBLE[] AS t, embedding[33:64]::DOUBLE[] AS i FROM embeddings WHERE vec_id = 0),\n"
    parts = [
        f"{n} AS (SELECT vec_id AS id, {w} * round(list_cosine_similarity(embedding[{a}:{b}]::DOUBLE[], {n[0]}), 6) AS score FROM embeddings, q ORDER BY round(list_cosine_similarity(embedding[{a}:{b}]::DOUBLE[], {n[0]}), 6) DESC, id LIMIT 80)"
        for n, w, a, b in (("text", w1, 1, 32), ("image", w2, 33, 64))
    ]
    return half + ", ".join(parts) + ", f AS (SELECT id, round(sum(score), 6) AS score FROM (SELECT * FROM text UNION ALL SELECT * FROM image) GROUP BY id) SELECT id, score FROM f " + tail


def _fused(spark: SparkSession, base: str, **options) -> DataFrame:
    rows = _index(spark, base)
    spaces = {n: (r, S.stored(r, [0])[0][1]) for n in ("text", "image") for r in [_space(rows, n)]}
    return S.fuse(spaces, 10, **options)


@R.query(_fuse_sql(0.6, 0.4, "ORDER BY score DESC, id LIMIT 10"))
def vfuse_weighted(spark: SparkSession, base: str) -> DataFrame:
    return _fused(spark, base, weights=[0.6, 0.4])


@R.query(_fuse_sql(0.5, 0.5, "WHERE score >= 0.15 ORDER BY score DESC, id LIMIT 10"))
def vfuse_equal_min_score(spark: SparkSession, base: str) -> DataFrame:
    return _fused(spark, base, min_score=0.15)


_SQ8 = """WITH z AS (SELECT vec_id AS id, embedding, CASE WHEN list_max(list_transform(embedding, lambda x: abs(x))) > 0
  THEN (list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127)::FLOAT ELSE 1::FLOAT END AS scale FROM embeddings),
c AS (SELECT id, embedding, scale, list_transform(embedding, lambda x: greatest(-127, least(127, round((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE)))::INTEGER) AS codes FROM z)
"""


def _coded(spark: SparkSession, base: str) -> DataFrame:
    rows = _index(spark, base).withColumn("scale", V.sq8_scale(F.col("embedding")))
    return rows.withColumn("codes", V.sq8_codes(F.col("embedding"), F.col("scale")))


@R.query(_SQ8 + "SELECT id, scale::DOUBLE AS scale, array_to_string(codes, ',') AS codes FROM c")
def sq8_encode(spark: SparkSession, base: str) -> DataFrame:
    return _coded(spark, base).select("id", F.col("scale").cast("double").alias("scale"), F.array_join("codes", ",").alias("codes"))


@R.query(_SQ8 + "SELECT id, round(sqrt(list_sum(list_transform(codes, lambda q: ((q::FLOAT * scale)::FLOAT::DOUBLE) * ((q::FLOAT * scale)::FLOAT::DOUBLE)))), 5) AS norm FROM c")
def sq8_decode_norm(spark: SparkSession, base: str) -> DataFrame:
    return _coded(spark, base).select("id", F.round(V.norm(V.sq8_decode(F.col("codes"), F.col("scale"))), 5).alias("norm"))


def _decoded(spark: SparkSession, base: str) -> DataFrame:
    return _coded(spark, base).select("id", V.sq8_decode(F.col("codes"), F.col("scale")).alias("embedding"))


_DECODED = _SQ8 + ", d AS (SELECT id, list_transform(codes, lambda q: (q::FLOAT * scale)::FLOAT::DOUBLE) AS v FROM c)\n"


@R.query(_DECODED + "SELECT d.id, round(list_cosine_similarity(v, q.embedding::DOUBLE[]), 6) AS score FROM d, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, d.id LIMIT 10")
def vsearch_sq8_asymmetric(spark: SparkSession, base: str) -> DataFrame:
    """A full-precision query against quantised rows."""
    return S.search(_decoded(spark, base), S.stored(_index(spark, base), [0]), 10).select("id", "score")


@R.query(_DECODED + """, pairs AS (SELECT q.vec_id AS query, d.id, round(list_cosine_similarity(v, q.embedding::DOUBLE[]), 6) AS a, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS x
  FROM d JOIN embeddings e ON e.vec_id = d.id, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY query ORDER BY x DESC, id) AS rx FROM pairs)
SELECT query, round(count_if(ra <= 10 AND rx <= 10) / 10, 6) AS recall FROM r GROUP BY query""")
def recall_at_k_sq8(spark: SparkSession, base: str) -> DataFrame:
    """Recall at 10 of the quantised search, by query."""
    asks = F.col("id") % 20 == 0
    return S.recall(blocks.nearest(_decoded(spark, base), asks, 10, DIM, queries=_index(spark, base).where(asks)), _exact(spark, base), 10)


@R.query(_DECODED + """, pairs AS (SELECT q.vec_id AS query, d.id, round(list_cosine_similarity(v, q.embedding::DOUBLE[]), 6) AS a, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS x
  FROM d JOIN embeddings e ON e.vec_id = d.id, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY query ORDER BY x DESC, id) AS rx FROM pairs),
k AS (SELECT query, round(count_if(ra <= 10 AND rx <= 10) / 10, 6) AS recall FROM r GROUP BY query)
SELECT count(*) AS n, round(avg(recall), 6) AS mean, round(quantile_cont(recall, 0.05), 6) AS p05 FROM k""")
def recall_summary_sq8(spark: SparkSession, base: str) -> DataFrame:
    """Mean and 5th percentile of the recall of the quantised search."""
    return ivf.recall_summary(recall_at_k_sq8(spark, base))


@R.query("""SELECT label, count(*) AS n, min(len(embedding))::INTEGER AS dim, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS mean_norm,
(count(*) * 128 + sum(len(embedding) * 4 + length(vec_id::VARCHAR) + 32))::BIGINT AS bytes FROM embeddings GROUP BY label""")
def vector_stats(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).alias("dim"),
        F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"),
        (F.count(F.lit(1)) * 128 + F.sum(F.size("embedding") * 4 + F.length(F.col("vec_id").cast("string")) + 32)).cast("bigint").alias("bytes"),
    )


# The vector change log: every row is added; each fifth overwritten with the next row's
# vector; each seventh deleted; each twenty-first added again.
_LOG = """WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), log AS (
  SELECT vec_id AS id, vec_id AS seq, embedding AS v, true AS live FROM embeddings
  UNION ALL SELECT a.vec_id, 1000000 + a.vec_id, b.embedding, true FROM embeddings a, n, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id = (a.vec_id + 1) % n
  UNION ALL SELECT vec_id, 2000000 + vec_id, NULL, false FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL SELECT vec_id, 3000000 + vec_id, embedding, true FROM embeddings WHERE vec_id % 21 = 0)
"""


def _vector_log(spark: SparkSession, base: str) -> DataFrame:
    e = _index(spark, base)
    n = e.agg(F.max("id") + 1).first()[0]
    after = e.select(F.pmod(F.col("id") - 1 + n, F.lit(n)).alias("id"), "embedding").where(F.col("id") % 5 == 0)
    cols = lambda df, shift, live: df.select("id", (F.col("id") + shift).alias("seq"), F.col("embedding").alias("v") if live else F.lit(None).cast("array<float>").alias("v"), F.lit(live).alias("live"))
    return cols(e, 0, True).unionAll(cols(after, 1000000, True)).unionAll(cols(e.where("id % 7 = 0"), 2000000, False)).unionAll(cols(e.where("id % 21 = 0"), 3000000, True))


def _as_of(log: DataFrame, cutoff: int) -> DataFrame:
    """The vectors live after the changes up to the cutoff."""
    last = log.where(F.col("seq") <= cutoff).groupBy("id").agg(F.max_by(F.struct("v", "live"), "seq").alias("r"))
    return last.where("r.live").select("id", F.col("r.v").alias("embedding"))


def _as_of_sql(cutoff: int) -> str:
    return _LOG + f""", last AS (SELECT * FROM log WHERE seq <= {cutoff} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM last, embeddings WHERE vec_id = 5 AND live ORDER BY score DESC, id LIMIT 10"""


def _add_as_of(name: str, cutoff: int, doc: str) -> None:
    def f(spark: SparkSession, base: str) -> DataFrame:
        return S.search(_as_of(_vector_log(spark, base), cutoff), S.stored(_index(spark, base), [5]), 10).select("id", "score")

    f.__doc__ = doc
    R.query(_as_of_sql(cutoff), name=name)(f)


_add_as_of("vsearch_as_of_before_overwrite", 999999, "The search as of the first adds.")
_add_as_of("vsearch_as_of_after_overwrite", 1999999, "The search as of the overwrites.")
_add_as_of("vsearch_as_of_after_delete", 2999999, "The search as of the deletions.")


@R.query(_LOG + """, s AS (SELECT *, lag(live) OVER (PARTITION BY id ORDER BY seq) AS before FROM log)
SELECT id, arg_max(live, seq) AS live, (1 + sum(CASE WHEN before IS NOT NULL AND before <> live THEN 1 ELSE 0 END))::BIGINT AS generation FROM s GROUP BY id""")
def vector_generations(spark: SparkSession, base: str) -> DataFrame:
    return S.generations(_vector_log(spark, base).select("id", "seq", "live"))


@R.query(_LOG + """, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id % 10 AS shard, count(*) AS rows_before, count_if(live)::BIGINT AS rows_after, count_if(NOT live)::BIGINT AS removed, count_if(NOT live) / count(*) > 0.2 AS due FROM last GROUP BY shard""")
def vcompact(spark: SparkSession, base: str) -> DataFrame:
    """What a compaction of each shard would remove, and whether it is due."""
    last = _vector_log(spark, base).groupBy("id").agg(F.max_by("live", "seq").alias("live"))
    return last.groupBy((F.col("id") % 10).alias("shard")).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if("live").alias("rows_after"), F.count_if(~F.col("live")).alias("removed"), (F.count_if(~F.col("live")) / F.count(F.lit(1)) > 0.2).alias("due")
    )


# A migration: rows with odd ids are put into a shadow, half of them twice; then swap or cancel;
# rows added later have ids over one million.
_MIGRATION = """WITH shadow AS (SELECT vec_id AS id, vec_id AS seq, embedding AS v FROM embeddings WHERE vec_id % 2 = 1
  UNION ALL SELECT a.vec_id, 10000000 + a.vec_id, b.embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1 WHERE a.vec_id % 4 = 1),
late AS (SELECT 1000000 + vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)
"""


def _migration(spark: SparkSession, base: str) -> tuple[S.Migration, DataFrame]:
    e = _index(spark, base)
    again = e.select((F.col("id") + 1).alias("id"), "embedding").where("id % 4 = 1").join(e.select("id"), "id", "left_semi")
    late = e.where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), "embedding")
    m = S.Migration(e).start().add(e.where("id % 2 = 1").withColumn("seq", F.col("id"))).add(again.withColumn("seq", F.col("id") + 10000000))
    return m, late


_HEAD = "SELECT id, round(v[1]::DOUBLE, 6) AS first_value FROM "


def _heads(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"))


@R.query(_MIGRATION + _HEAD + "(SELECT id, v FROM shadow QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1 UNION ALL SELECT id, v FROM late)")
def vmigrate_swap(spark: SparkSession, base: str) -> DataFrame:
    """After the swap the shadow's rows and the later ones live; the old ones are gone."""
    m, late = _migration(spark, base)
    return _heads(m.swap().live.unionByName(late))


@R.query(_MIGRATION + _HEAD + "(SELECT vec_id AS id, embedding AS v FROM embeddings UNION ALL SELECT id, v FROM late)")
def vmigrate_cancel(spark: SparkSession, base: str) -> DataFrame:
    """After a cancel the old rows and the later ones live."""
    m, late = _migration(spark, base)
    return _heads(m.cancel().live.unionByName(late))


@R.query("""WITH b AS (SELECT vec_id % 100 AS id, vec_id AS pos, embedding AS v FROM embeddings WHERE vec_id % 3 = 0), n AS (SELECT id, v FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)
""" + _HEAD + "(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, v FROM n)")
def vadd_batch(spark: SparkSession, base: str) -> DataFrame:
    """A batch that overwrites the first hundred ids, some of them several times."""
    e = _index(spark, base)
    batch = e.where("id % 3 = 0").select((F.col("id") % 100).alias("id"), "embedding", F.col("id").alias("pos"))
    return _heads(S.upserted(e, batch))


@R.query("SELECT vec_id::VARCHAR AS id, round(embedding[1]::DOUBLE, 6) AS first_value, len(embedding)::INTEGER AS dim FROM embeddings")
def vadd_binary(spark: SparkSession, base: str) -> DataFrame:
    """The vectors packed into binary rows and read again."""
    blobs = binary.packed(_index(spark, base), "id", "embedding", "blob")
    rows = binary.vectors_of(blobs, "blob", DIM)
    return rows.select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"), F.size("embedding").alias("dim"))


@R.query("""WITH h AS (SELECT label, ('0x' || substr(sha256(vec_id::VARCHAR), 1, 15))::BIGINT AS h FROM embeddings)
SELECT label, count(*) AS n, bit_xor(h)::BIGINT AS digest FROM h GROUP BY label""")
def index_seals(spark: SparkSession, base: str) -> DataFrame:
    """Count and digest of the ids of each part of the index. The digest combines the
    hashes of the ids, so parts of a group are combined before the shuffle."""
    h = F.conv(F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    return table(spark, base, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("digest"))

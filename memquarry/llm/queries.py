"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.llm import harmful, mixing, packing, personal, splitting, tokens
from memquarry.llm.near_duplicates import NearDuplicates
from memquarry.llm.shared_spans import SharedSpans
from memquarry.llm.similar_vectors import SimilarVectors
from memquarry.plans.scratch import written
from memquarry.queries import Registry
from memquarry.sources.tables import table

R = Registry()


def _shingle_sql(n: int, threshold: float) -> str:
    words = ", ".join(f"w[i + {j}]" for j in range(n))
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', {words}) AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
sim AS (SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c >= {threshold} * (x.n + y.n - c))
"""


@R.query(_shingle_sql(3, 0.6) + "SELECT doc_a, doc_b FROM sim")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of documents with similarity at least 0.6 on runs of three words."""
    found = NearDuplicates(table(spark, base, "documents"), n_words=3, threshold=0.6)
    return found.pairs().select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


@R.query(_shingle_sql(5, 0.8) + """
, sets AS (SELECT doc_id, hash(list_sort(list(sh))) AS h FROM s GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sets),
links AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM sim JOIN classes x ON x.doc_id = doc_a JOIN classes y ON y.doc_id = doc_b WHERE x.class_id <> y.class_id),
deg AS (SELECT c, count(DISTINCT o) AS n FROM (SELECT a AS c, b AS o FROM links UNION ALL SELECT b, a FROM links) GROUP BY c)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN deg ON c = class_id""")
def p3_documents(spark: SparkSession, base: str) -> DataFrame:
    """Every document with its class of equal texts and its number of similar classes
    (runs of five words, similarity 0.8)."""
    return NearDuplicates(table(spark, base, "documents")).documents().select(F.col("id").alias("doc_id"), "class_id", "n_links")


def _shared_spans(spark: SparkSession, base: str) -> SharedSpans:
    return SharedSpans({"documents": (table(spark, base, "documents"), "doc_id", "text", None), "hits": (table(spark, base, "hits"), "hit_id", "text", "doc_id")}, 300)


_P7_SQL = """
WITH recs AS (SELECT 'documents' AS k, doc_id AS id, doc_id AS g, text FROM documents UNION SELECT 'hits', hit_id, doc_id, text FROM hits),
w AS (SELECT DISTINCT k, id, g, hash(substring(text, i, 300)) AS h FROM (SELECT k, id, g, text, unnest(range(1, length(text) - 298)) AS i FROM recs WHERE length(text) >= 300)),
shared AS (SELECT k, h FROM w GROUP BY k, h HAVING count(*) > 1), s AS (SELECT w.* FROM w JOIN shared USING (k, h))
SELECT DISTINCT a.k AS rec_kind, a.id AS rec_a, b.id AS rec_b FROM s a JOIN s b ON a.k = b.k AND a.h = b.h AND a.id < b.id AND a.g <> b.g"""


@R.query(_P7_SQL)
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of records of one kind that have at least 300 successive characters in common."""
    return _shared_spans(spark, base).pairs().select(F.col("kind").alias("rec_kind"), F.col("id_a").alias("rec_a"), F.col("id_b").alias("rec_b"))


_P7_ISLANDS = """
WITH recs AS (SELECT 'documents' AS k, doc_id AS id, doc_id AS g, text FROM documents WHERE length(text) >= 300 UNION SELECT 'hits', hit_id, doc_id, text FROM hits WHERE length(text) >= 300),
copies AS (SELECT a.k, a.id, length(a.text) AS size, count(*) FILTER (b.g IS DISTINCT FROM a.g) AS n FROM recs a JOIN recs b ON a.k = b.k AND a.text = b.text GROUP BY ALL),
texts AS (SELECT k, text, min(id) AS rep FROM recs GROUP BY ALL),
w AS (SELECT k, rep, i - 1 AS first, hash(substring(text, i, 300)) AS h FROM (SELECT *, unnest(range(1, length(text) - 298)) AS i FROM texts)),
several AS (SELECT w.k, h FROM w JOIN texts t ON t.k = w.k AND t.rep = w.rep JOIN recs r ON r.k = t.k AND r.text = t.text GROUP BY ALL HAVING count(DISTINCT w.rep) > 1 AND count(DISTINCT r.g) > 1),
s AS (SELECT w.k, rep, first, first - lag(first) OVER (PARTITION BY w.k, rep ORDER BY first) <= 300 AS joined FROM w JOIN several USING (k, h)),
n AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY k, rep ORDER BY first) AS island FROM s),
islands AS (SELECT k, rep, min(first) AS first, max(first) + 300 AS past FROM n GROUP BY k, rep, island)
"""


@R.query(_P7_ISLANDS + """, part AS (SELECT k, rep, sum(past - first) AS chars, count(*) AS spans FROM islands GROUP BY ALL)
SELECT DISTINCT c.k AS rec_kind, c.id AS rec_id, c.n AS n_copies, (CASE WHEN c.n > 0 THEN size ELSE coalesce(chars, 0) END)::BIGINT AS shared_chars, (CASE WHEN c.n > 0 THEN 1 ELSE coalesce(spans, 0) END)::BIGINT AS n_spans
FROM copies c JOIN recs r ON r.k = c.k AND r.id = c.id JOIN texts t ON t.k = r.k AND t.text = r.text LEFT JOIN part p ON p.k = t.k AND p.rep = t.rep""")
def p7_shared(spark: SparkSession, base: str) -> DataFrame:
    """For each record of at least 300 characters, how much of its text occurs elsewhere."""
    return _shared_spans(spark, base).shared_by_record().select(F.col("kind").alias("rec_kind"), F.col("id").alias("rec_id"), "n_copies", "shared_chars", "n_spans")


@R.query(_P7_ISLANDS + """SELECT DISTINCT c.k AS rec_kind, c.id AS rec_id, CASE WHEN c.n > 0 THEN 0 ELSE first END AS first, CASE WHEN c.n > 0 THEN size ELSE past END AS past
FROM copies c JOIN recs r ON r.k = c.k AND r.id = c.id JOIN texts t ON t.k = r.k AND t.text = r.text LEFT JOIN islands i ON i.k = t.k AND i.rep = t.rep WHERE c.n > 0 OR first IS NOT NULL""")
def p7_spans(spark: SparkSession, base: str) -> DataFrame:
    """The passages of each record that occur elsewhere, from ``first`` up to ``past``."""
    return _shared_spans(spark, base).spans_by_record().select(F.col("kind").alias("rec_kind"), F.col("id").alias("rec_id"), "first", "past")


DOC_LIMIT, DOC_OVERLAP = 4000, 200
HIT_LIMIT, HIT_OVERLAP = 900, 80
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"


def _pieces(spark: SparkSession, base: str) -> DataFrame:
    docs = splitting.pieces(table(spark, base, "documents"), "documents", "doc_id", "text", DOC_LIMIT, DOC_OVERLAP)
    return docs.unionAll(splitting.pieces(table(spark, base, "hits"), "hits", "hit_id", "text", HIT_LIMIT, HIT_OVERLAP))


@R.query(f"""
SELECT 'documents' AS rec_kind, doc_id AS rec_id FROM documents WHERE length({_TRIM.format("text")}) > {DOC_LIMIT}
UNION SELECT 'hits', hit_id FROM hits WHERE length({_TRIM.format("text")}) > {HIT_LIMIT}""")
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The items that come out in several pieces."""
    return _pieces(spark, base).where("n_pieces > 1").select("rec_kind", "rec_id").distinct()


@R.query()
def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All pieces of documents and hits; of repeated deliveries one."""
    return _pieces(spark, base).dropDuplicates(["rec_kind", "rec_id", "piece_no"])


@R.query(f"""
WITH items AS (SELECT 'documents' AS rec_kind, doc_id AS rec_id, {_TRIM.format("text")} AS t, {DOC_LIMIT} AS most FROM documents UNION SELECT 'hits', hit_id, {_TRIM.format("text")}, {HIT_LIMIT} FROM hits)
SELECT rec_kind, rec_id, sha256(t) AS digest, true AS within_limit, length(t) > most AS cut FROM items WHERE t <> ''""")
def p2_rejoined(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of every item put together again without their overlaps: a digest of the
    text that results, whether all pieces are within the limit, and whether there are several."""
    p = p2_pieces(spark, base)
    is_doc = F.col("rec_kind") == "documents"
    fresh = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.substring(F.col("text"), F.when(is_doc, DOC_OVERLAP + 1).otherwise(HIT_OVERLAP + 1), F.length("text")))
    whole = p.groupBy("rec_kind", "rec_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("text")))).alias("parts"),
        F.bool_and(F.length("text") <= F.when(is_doc, DOC_LIMIT).otherwise(HIT_LIMIT)).alias("within_limit"),
        (F.max("n_pieces") > 1).alias("cut"),
    )
    return whole.select("rec_kind", "rec_id", F.sha2(F.array_join(F.transform("parts", lambda x: x["text"]), ""), 256).alias("digest"), "within_limit", "cut")


CAPACITY = 2048


def _sized(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "source", tokens.n_tokens("text").cast("bigint").alias("size"))
    return written(docs, "sizes")


@R.query()
def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    """Every document in containers of 2,048 tokens: doc_id, part, n_tokens, container."""
    docs = table(spark, base, "documents").select("doc_id", tokens.n_tokens("text").alias("size"))
    return packing.pack(docs, "doc_id", "size", CAPACITY).select(F.col("item").alias("doc_id"), "part", F.col("size").alias("n_tokens"), "container")


@R.query()
def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    """The containers with the room left in each."""
    docs = table(spark, base, "documents").select("doc_id", tokens.n_tokens("text").alias("size"))
    return packing.containers(packing.pack(docs, "doc_id", "size", CAPACITY), CAPACITY)


@R.query("SELECT doc_id, true AS in_order, true AS cut_only_if_too_large, true AS within_capacity FROM documents WHERE length(text) > 0")
def p8_checked(spark: SparkSession, base: str) -> DataFrame:
    """What must hold for every document: its parts are numbered from 0 without a gap, all
    but the last are full, and no container it is in holds more than its capacity."""
    packed = written(p8_packed(spark, base), "packed")
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    per = packed.join(used, "container").groupBy("doc_id")
    n, last = F.count(F.lit(1)), F.max("part")
    return per.agg((last + 1 == n).alias("in_order"), (F.count_if(F.col("n_tokens") == CAPACITY) >= n - 1).alias("cut_only_if_too_large"), (F.max("used") <= CAPACITY).alias("within_capacity"))


@R.query()
def p9_mixed(spark: SparkSession, base: str) -> DataFrame:
    """Every use of a document in the mix, in its global order."""
    docs = _sized(spark, base)
    planned = written(mixing.plan(docs, table(spark, base, "mix_targets")), "plan")
    return mixing.mix(docs, planned).select("place", "doc_id", "copy_no", "source", F.col("size").alias("n_tokens"))


@R.query()
def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares that the mix reaches, by source."""
    docs = _sized(spark, base)
    planned = written(mixing.plan(docs, table(spark, base, "mix_targets")), "plan")
    return mixing.report(mixing.mix(docs, planned), planned)


@R.query("""WITH best AS (SELECT source, max(struct_pack(s := coalesce(target_share, 0), r := coalesce(max_repeats, 0))) AS t FROM mix_targets WHERE source IS NOT NULL GROUP BY source)
SELECT source, t.r AS max_repeats, true AS within_repeats, true AS only_its_own FROM best""")
def p9_checked(spark: SparkSession, base: str) -> DataFrame:
    """What must hold for every target: no document is used more often than allowed, and
    every use is one of a document of its source."""
    docs = _sized(spark, base)
    planned = written(mixing.plan(docs, table(spark, base, "mix_targets")), "plan")
    uses = mixing.mix(docs, planned).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("copy_no").alias("top"))
    known = docs.select("doc_id", F.col("source").alias("own"))
    per = uses.join(known, "doc_id", "left").groupBy("source").agg(F.max(F.greatest("k", F.col("top") + 1)).alias("most"), F.bool_and(F.col("source").eqNullSafe(F.col("own"))).alias("same"))
    return planned.select("source", "max_repeats").join(per, "source", "left").select("source", "max_repeats", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("same", F.lit(True)).alias("only_its_own"))


@R.query("""
WITH best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC NULLS LAST) AS r FROM vectors WHERE id IS NOT NULL),
live AS (
  SELECT id, tenant_id, index_name, coalesce(space, '') AS space, embedding::DOUBLE[] AS e FROM best
  WHERE r = 1 AND NOT coalesce(tombstone, false) AND len(embedding) = 64
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
sims AS (
  SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS c FROM live a JOIN live b
  ON a.tenant_id IS NOT DISTINCT FROM b.tenant_id AND a.index_name IS NOT DISTINCT FROM b.index_name AND a.space = b.space AND a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM sims)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM ranked WHERE r <= 10 AND c >= 0.9""")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of live vectors of one collection with cosine at least 0.90 of which one is
    among the 10 most similar of the other."""
    found = SimilarVectors(table(spark, base, "vectors")).neighbours()
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@R.query()
def p5_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The 10 most similar live vectors of the collection, or all others of a smaller one,
    whatever their cosine, for the ids divisible by 20."""
    return SimilarVectors(table(spark, base, "vectors")).complete(F.col("id") % 20 == 0)


def _harmful_scores(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    model = harmful.fit_on(docs, table(spark, base, "doc_labels"))
    return harmful.score(docs, model, ["doc_id", "source"])


@R.query()
def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _harmful_scores(spark, base).where("flagged").select("doc_id")


@R.query()
def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    """Documents, flagged documents and their share by source."""
    by = _harmful_scores(spark, base).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg("score").alias("mean_score"))
    return by.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))


def _scanned(spark: SparkSession, base: str, with_text: bool) -> DataFrame:
    docs = personal.scan(table(spark, base, "documents"), "documents", "doc_id", "text", with_text)
    return docs.unionAll(personal.scan(table(spark, base, "notes"), "notes", "note_id", "text", with_text))


@R.query()
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """The kinds of personal information in each record."""
    found = _scanned(spark, base, False).select("rec_kind", "rec_id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["kind"]))).alias("pii_kind"))
    return found.distinct()


@R.query("SELECT 'documents' AS rec_kind, doc_id AS rec_id, true AS rest_is_kept FROM documents WHERE text IS NOT NULL UNION SELECT 'notes', note_id, true FROM notes WHERE text IS NOT NULL")
def p6_checked(spark: SparkSession, base: str) -> DataFrame:
    """What must hold for every text: with the placeholders put back to what the spans held,
    the redacted text is the source."""
    both = None
    for kind, id_col in (("documents", "doc_id"), ("notes", "note_id")):
        rows = table(spark, base, kind).where("text IS NOT NULL")
        rows = rows.select(F.lit(kind).alias("rec_kind"), F.col(id_col).alias("rec_id"), F.col("text").alias("source")).dropDuplicates(["rec_kind", "rec_id"])
        both = rows if both is None else both.unionAll(rows)
    red = _scanned(spark, base, True).where("text IS NOT NULL").dropDuplicates(["rec_kind", "rec_id"])
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    # (text so far, place in the source) over the spans in order.
    step = lambda a, s: F.struct(F.concat(a["text"], F.substring(F.col("source"), a["at"] + 1, s["first"] - a["at"]), mark(s)).alias("text"), s["past"].alias("at"))
    made = F.aggregate("spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step, lambda a: F.concat(a["text"], F.substring(F.col("source"), a["at"] + 1, F.length("source"))))
    return red.join(both, ["rec_kind", "rec_id"]).select("rec_kind", "rec_id", (made == F.col("text")).alias("rest_is_kept"))


@R.query()
def p6_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every text with typed placeholders, and how many there are; of repeated deliveries one."""
    return _scanned(spark, base, True).select("rec_kind", "rec_id", "text", F.size("spans").alias("n_spans")).dropDuplicates(["rec_kind", "rec_id"])

"""Queries on texts: ``documents``, and ``hits`` as their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import leaks, row_errors
from memquarry.operators import text as X
from memquarry.operators import vectors as S
from memquarry.queries import Registry
from memquarry.queries.feeds import _P4_CHECKED
from memquarry.sources.tables import table

R = Registry()
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_WINDOWS = "list_filter(list_transform(range(0, greatest(0, ceil((length({t}) - {n}) / {s}))::BIGINT + 1), lambda i: trim({t}[(i * {s} + 1):(i * {s} + {n})], " + _BLANK + ")), lambda c: length(c) > 0)"


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents")


@R.query(f"WITH d AS (SELECT doc_id, trim(text, {_BLANK}) AS t FROM documents), c AS (SELECT doc_id, {_WINDOWS.format(t='t', n=500, s=420)} AS c FROM d) SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INTEGER AS pos, unnest(c) AS chunk FROM c")
def chunk_fixed(spark: SparkSession, base: str) -> DataFrame:
    return X.exploded(_docs(spark, base), "doc_id", X.windows(F.col("text"), 500, 80))


@R.query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\n\\r\\f\\x0b]*\\n'), lambda x: trim(x, {_BLANK})), lambda x: length(x) > 0) AS p FROM documents),
c AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 900 THEN [x] ELSE {_WINDOWS.format(t='x', n=700, s=620)} END)) AS c FROM p)
SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INTEGER AS pos, unnest(c) AS chunk FROM c""")
def clause_chunks(spark: SparkSession, base: str) -> DataFrame:
    return X.exploded(_docs(spark, base), "doc_id", X.clauses(F.col("text")))


@R.query("SELECT 'meta:doc:' || trim(regexp_replace(lower(doc_name), '[^a-z0-9]+', '-', 'g'), '-') AS key, doc_name || '|chunks=' || count(*) AS value FROM documents WHERE doc_name IS NOT NULL GROUP BY doc_name")
def document_rows(spark: SparkSession, base: str) -> DataFrame:
    """The row that an ingest keeps beside the chunks: name and number of chunks."""
    n = _docs(spark, base).where("doc_name IS NOT NULL").groupBy("doc_name").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit("meta:doc:"), X.slug(F.col("doc_name"))).alias("key"), F.concat("doc_name", F.lit("|chunks="), F.col("n").cast("string")).alias("value"))


@R.query("SELECT DISTINCT n.source, sha256(n.text) AS digest FROM documents n WHERE n.doc_id % 2 = 0 AND n.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 2 = 1 AND s.source IS NOT DISTINCT FROM n.source AND s.text = n.text) AND n.source IS NOT NULL")
def source_versions(spark: SparkSession, base: str) -> DataFrame:
    """Texts with an even id that their source has not had among the odd ones: the versions a watch adds."""
    d = _docs(spark, base).where("source IS NOT NULL")
    seen = d.where("doc_id % 2 = 1 AND text IS NOT NULL").select("source", F.sha2("text", 256).alias("digest"))
    return X.new_versions(d.where("doc_id % 2 = 0"), seen, "source", "text").select("source", "digest")


@R.query("""WITH p AS (SELECT doc_id, text, '<html><nav>menu</nav><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><script>if (a < b) { x }</script><footer>end</footer></html>' AS html FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM p) SELECT doc_id, sha256(t) AS digest FROM t""")
def html_text_digest(spark: SparkSession, base: str) -> DataFrame:
    """Digests of the visible text of pages made from the documents."""
    c = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    page = F.concat(F.lit("<html><nav>menu</nav><p>"), c, F.lit("</p><script>if (a < b) { x }</script><footer>end</footer></html>"))
    d = _docs(spark, base).where("text IS NOT NULL").select("doc_id", page.alias("html"))
    return d.select("doc_id", X.html_columns("html")[1].alias("digest"))


@R.query("SELECT doc_id, 'doc:' || trim(regexp_replace(lower(doc_name), '[^a-z0-9]+', '-', 'g'), '-') || ':' || doc_id AS chunk_key FROM documents")
def chunk_keys(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", F.concat(F.lit("doc:"), X.slug(F.col("doc_name")), F.lit(":"), F.col("doc_id").cast("string")).alias("chunk_key"))


_WORDS, _OVERLAP_WORDS = (f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({stop}, w))" for stop in (X.STOP_WORDS, X.OVERLAP_STOP_WORDS))
_SET = "list_distinct(list_concat({w}, list_transform(list_filter({w}, lambda x: x[-1:] = 's' AND length(x) > 4), lambda x: x[:-2])))"
QUESTION = "Which notices must be given under the agreement before the escrow deposit is released?"


def _overlap_sql(text: str) -> str:
    q, t = _SET.format(w=_OVERLAP_WORDS.format(t=f"'{QUESTION}'")), _SET.format(w=_OVERLAP_WORDS.format(t=text))
    return f"(len(list_intersect({q}, {t})) / len({q}))"


@R.query(f"SELECT doc_id, round({_overlap_sql('text')}, 6) AS overlap FROM documents WHERE text IS NOT NULL ORDER BY overlap DESC, doc_id LIMIT 20")
def token_overlap_rank(spark: SparkSession, base: str) -> DataFrame:
    d = _docs(spark, base).where("text IS NOT NULL")
    return d.select("doc_id", F.round(X.overlap(F.lit(QUESTION), F.col("text")), 6).alias("overlap")).orderBy(F.desc("overlap"), "doc_id").limit(20)


_EMBED = f"""WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f, 1.0::DOUBLE AS weight FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.65::DOUBLE FROM w),
h AS (SELECT doc_id, (('0x' || substr(sha256(f), 1, 8))::BIGINT % 64)::INTEGER AS bucket, weight * CASE WHEN ('0x' || substr(sha256(f), 9, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END AS v FROM f),
s AS (SELECT doc_id, bucket, sum(v) AS v FROM h GROUP BY ALL UNION ALL SELECT doc_id, 0, 1.0 FROM w WHERE len(w) = 0),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY doc_id),
e AS (SELECT doc_id, bucket, CASE WHEN n > 0 THEN v / n ELSE v END AS v FROM s JOIN n USING (doc_id))
"""


@R.query(_EMBED + "SELECT doc_id, bucket, round(v, 6) AS weight FROM e WHERE abs(v) > 1e-9")
def feature_hash_embed(spark: SparkSession, base: str) -> DataFrame:
    e = X.embedded(_docs(spark, base), "doc_id", "text")
    return e.select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("bucket", "v")).where(F.abs("v") > 1e-9).select("doc_id", "bucket", F.round("v", 6).alias("weight"))


@R.query("""WITH RECURSIVE h AS (SELECT doc_id, 0 AS i, sha256(text) AS h FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, i + 1, sha256(unhex(h)) FROM h WHERE i < 3),
v AS (SELECT doc_id, (i * 8 + j)::INTEGER AS pos, ('0x' || substr(h, (8 * j + 1)::INTEGER, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1 AS v FROM h, range(8) t(j))
SELECT doc_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS v FROM v""")
def digest_embed(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of 32 numbers from chained digests of the texts."""
    d = _docs(spark, base).where("text IS NOT NULL").select("doc_id", F.posexplode(X.digest_embedding(F.col("text"), 32)).alias("pos", "v"))
    return d.select("doc_id", "pos", F.round("v", 6).alias("v"))


_QVEC = [round(x, 9) for x in X.embed_text(QUESTION)]
_RECALL = _EMBED + f", q AS (SELECT unnest(range(0, 64))::INTEGER AS bucket, unnest({_QVEC})::DOUBLE AS qv), r AS (SELECT doc_id AS id, round(sum(v * qv) / {sum(x * x for x in _QVEC) ** 0.5!r}, 6) AS score FROM e JOIN q USING (bucket) GROUP BY doc_id)\n"


def _recalled(spark: SparkSession, base: str, k: int) -> DataFrame:
    return S.search(X.embedded(_docs(spark, base), "doc_id", "text"), [(0, _QVEC)], k).select("id", "score")


@R.query(_RECALL + "SELECT id, score FROM r ORDER BY score DESC, id LIMIT 10")
def recall_by_text(spark: SparkSession, base: str) -> DataFrame:
    return _recalled(spark, base, 10)


@R.query(_RECALL + f", t AS (SELECT id, score FROM r ORDER BY score DESC, id LIMIT 6) SELECT id, score, round({_overlap_sql('text')}, 6) AS overlap, row_number() OVER (ORDER BY round({_overlap_sql('text')}, 6) DESC, score DESC, id)::INTEGER AS place FROM t JOIN documents ON doc_id = id")
def lexical_rerank(spark: SparkSession, base: str) -> DataFrame:
    """The six nearest texts, ranked by word overlap, then score."""
    from pyspark.sql import Window

    docs = _docs(spark, base).select(F.col("doc_id").alias("id"), "text")
    top = S.with_documents(_recalled(spark, base, 6), docs).withColumn("overlap", F.round(X.overlap(F.lit(QUESTION), F.col("text")), 6))
    return top.select("id", "score", "overlap", F.row_number().over(Window.orderBy(F.desc("overlap"), F.desc("score"), "id")).alias("place"))


@R.query(f"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0b]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_BLANK})), lambda x: length(x) > 0) AS s FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(s) AS q, unnest(range(1, len(s) + 1)) AS i FROM s), h AS (SELECT *, (contains(lower(q), 'notice')::INT + contains(lower(q), 'terminat')::INT + contains(lower(q), 'renew')::INT) AS hits FROM x),
b AS (SELECT doc_id, q FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, length(q) DESC, i) = 1)
SELECT s.doc_id, coalesce(q, trim(text, {_BLANK})[:700]) AS quote FROM s LEFT JOIN b USING (doc_id)""")
def sentence_best_quote(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).where("text IS NOT NULL").select("doc_id", X.best_quote(F.col("text"), ["notice", "terminat", "renew"]).alias("quote"))


_WORD_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in X.NUMBER_WORDS.items()) + "}"


def _numbers_sql(text: str, unit: str) -> str:
    pattern = X.NUMBER.replace("'", "''") + unit
    found = [f"regexp_extract_all(lower({text}), '{pattern}', {g})" for g in (1, 2)]
    return f"list_transform(list_zip({found[0]}, {found[1]}), lambda r: coalesce(try_cast(nullif(r[2], '') AS BIGINT), {_WORD_MAP}[r[1]], try_cast(r[1] AS BIGINT)))"


_DAYS = _numbers_sql("text", "days")


@R.query(f"SELECT doc_id, list_max({_numbers_sql('text', 'days?')}) AS max_days, list_min({_numbers_sql('text', 'months?')}) AS min_months FROM documents WHERE text IS NOT NULL")
def number_extract(spark: SparkSession, base: str) -> DataFrame:
    d = _docs(spark, base).where("text IS NOT NULL")
    return d.select("doc_id", F.array_max(X.numbers_before(F.col("text"), "days?")).alias("max_days"), F.array_min(X.numbers_before(F.col("text"), "months?")).alias("min_months"))


@R.query(f"""WITH n(n) AS (SELECT unnest({list(X.NUMBER_WORDS)})), t AS (SELECT n_nationkey, 'Ends after ' || n || chr(10) || ' (' || (n_nationkey + 40) || ' )  Days or ' || n || chr(9) || 'days, or 7days; ' || upper(n) || ' Months' AS text FROM nation, n)
SELECT n_nationkey, text, list_sort({_numbers_sql('text', 'days?')})::VARCHAR AS days, list_max({_numbers_sql('text', 'months?')}) AS months FROM t""")
def number_words(spark: SparkSession, base: str) -> DataFrame:
    """Numbers in words and in parentheses, in texts made from the nations."""
    n = F.explode(F.array(*[F.lit(w) for w in X.NUMBER_WORDS]))
    t = table(spark, base, "nation").select("n_nationkey", n.alias("n"))
    text = F.concat(F.lit("Ends after "), "n", F.lit("\n ("), (F.col("n_nationkey") + 40).cast("string"), F.lit(" )  Days or "), "n", F.lit("\tdays, or 7days; "), F.upper("n"), F.lit(" Months"))
    d = t.select("n_nationkey", text.alias("text"))
    shown = F.concat(F.lit("["), F.array_join(F.array_sort(X.numbers_before(F.col("text"), "days?")).cast("array<string>"), ", "), F.lit("]"))
    return d.select("n_nationkey", "text", shown.alias("days"), F.array_max(X.numbers_before(F.col("text"), "months?")).alias("months"))


_CHUNKS = "WITH c AS (SELECT DISTINCT doc_id, chunk_no, first_value(text) OVER (PARTITION BY doc_id, chunk_no ORDER BY text NULLS LAST) AS text FROM hits WHERE chunk_no IS NOT NULL)\n"


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "hits").where("chunk_no IS NOT NULL").groupBy("doc_id", "chunk_no").agg(F.min("text").alias("text"))


@R.query(_CHUNKS + ", m AS (SELECT *, regexp_extract_all(text, '§[ ]*([0-9]+(?:[.][0-9]+)?)', 1) AS m FROM c) SELECT doc_id, chunk_no, coalesce(last_value(CASE WHEN len(m) > 0 THEN '§' || m[-1] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_no), '—') AS section FROM m")
def section_carry_forward(spark: SparkSession, base: str) -> DataFrame:
    return X.carried_forward(_chunks(spark, base), "doc_id", "chunk_no", X.section_mark(F.col("text"))).select("doc_id", "chunk_no", "section")


_CHUNK_Q = _CHUNKS + f", s AS (SELECT doc_id, chunk_no, round({_overlap_sql('coalesce(text, \'\')')}, 9) AS o FROM c), near AS (SELECT doc_id, max(chunk_no) AS n FROM c GROUP BY doc_id), "


@R.query(_CHUNK_Q + """b AS (SELECT doc_id, chunk_no AS lex, o FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, chunk_no) = 1), v AS (SELECT s.doc_id, s.o AS vo, n FROM s JOIN near ON near.doc_id = s.doc_id AND n = chunk_no)
SELECT doc_id, CASE WHEN vo >= 0.2 OR o <= 0 THEN n ELSE lex END::INTEGER AS place, CASE WHEN vo >= 0.2 OR o <= 0 OR n = lex THEN 'vector' ELSE 'read' END AS via FROM b JOIN v USING (doc_id)""")
def chunk_choice(spark: SparkSession, base: str) -> DataFrame:
    """The chunk of each document to read on a question, with the last chunk as the nearest by vector."""
    c = _chunks(spark, base).withColumnRenamed("chunk_no", "place")
    return X.chosen_chunk(c, "doc_id", F.lit(QUESTION), c.groupBy("doc_id").agg(F.max("place").alias("place")))


_TOPIC = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0b]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {b})), lambda x: length(x) > 0 AND regexp_matches(lower(x), '{p}'))"


@R.query(f"""WITH s AS (SELECT doc_id, text, array_to_string({_TOPIC.format(b=_BLANK, p='notice')}, ' ') AS scoped FROM documents), n AS (SELECT doc_id, text, {_numbers_sql('scoped', 'days?')} AS d FROM s)
SELECT doc_id, CASE WHEN text IS NULL OR NOT contains(lower(text), 'notice') THEN 'missing' WHEN len(d) = 0 THEN 'medium' WHEN list_max(d) > 60 THEN 'medium' ELSE 'clear' END AS most, CASE WHEN text IS NULL OR NOT contains(lower(text), 'notice') THEN 'missing' WHEN len(d) = 0 THEN 'medium' WHEN list_min(d) < 30 THEN 'high' ELSE 'clear' END AS least FROM n""")
def threshold_states(spark: SparkSession, base: str) -> DataFrame:
    """What each document says on notices: at most 60 days, and at least 30."""
    t = F.col("text")
    return _docs(spark, base).select("doc_id", X.threshold_state(t, "notice", "days?", 60, False).alias("most"), X.threshold_state(t, "notice", "days?", 30, True).alias("least"))


@R.query(_CHUNKS + "SELECT doc_id, chunk_no, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c")
def chunk_offsets(spark: SparkSession, base: str) -> DataFrame:
    return X.offsets(_chunks(spark, base), "doc_id", "chunk_no", "text").select("doc_id", "chunk_no", "first")


_FOUND = _CHUNKS + f", f AS (SELECT doc_id, chunk_no, CASE WHEN text IS NULL THEN 'missing' WHEN list_max({_DAYS}) > 100 THEN 'high' WHEN list_max({_DAYS}) > 60 THEN 'medium' ELSE 'clear' END AS state FROM c)\n"


def _findings(spark: SparkSession, base: str) -> DataFrame:
    days = F.array_max(X.numbers_before(F.col("text"), "days"))
    state = F.when(F.col("text").isNull(), "missing").when(days > 100, "high").when(days > 60, "medium").otherwise("clear")
    return _chunks(spark, base).select("doc_id", F.col("chunk_no").alias("place"), state.alias("state"))


@R.query(_FOUND + "SELECT doc_id, state, chunk_no AS place FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['clear', 'medium', 'missing', 'high'], state) DESC, chunk_no) = 1")
def worst_of_findings(spark: SparkSession, base: str) -> DataFrame:
    return X.worst_of(_findings(spark, base), "doc_id")


@R.query(_FOUND + f", o AS (SELECT f.*, round({_overlap_sql('coalesce(text, \'\')')}, 9) AS o FROM f JOIN c USING (doc_id, chunk_no)) SELECT doc_id, state, chunk_no AS place FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['clear', 'medium', 'missing', 'high'], state) DESC, o DESC, chunk_no) = 1")
def worst_by_overlap(spark: SparkSession, base: str) -> DataFrame:
    """The worst finding of each document; of equals the one that shares most words with the question."""
    texts = _chunks(spark, base).withColumnRenamed("chunk_no", "place")
    return X.worst_of(_findings(spark, base).join(texts, ["doc_id", "place"]), "doc_id", tie=F.round(X.overlap(F.lit(QUESTION), F.coalesce("text", F.lit(""))), 9))


@R.query(_FOUND + "SELECT count_if(state = 'clear')::BIGINT AS clear, count_if(state = 'medium')::BIGINT AS medium, count_if(state = 'missing')::BIGINT AS missing, count_if(state = 'high')::BIGINT AS high, count_if(state <> 'clear')::BIGINT AS open FROM f")
def finding_tally(spark: SparkSession, base: str) -> DataFrame:
    return X.tally(_findings(spark, base))


@R.query("""WITH r AS (SELECT doc_id, sha256(text) AS fingerprint FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND text IS NOT NULL UNION ALL SELECT doc_id, 'older' FROM documents WHERE doc_id % 6 = 0)
SELECT d.doc_id, CASE WHEN r.fingerprint IS NULL THEN 'open' WHEN r.fingerprint = sha256(d.text) THEN 'accepted' ELSE 'reset' END AS decision FROM documents d LEFT JOIN r USING (doc_id)""")
def review_overlay(spark: SparkSession, base: str) -> DataFrame:
    d = _docs(spark, base).select("doc_id", "text")
    stamp = F.sha2("text", 256)
    reviews = d.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "older").otherwise(stamp).alias("fingerprint"), F.lit("accepted").alias("decision")).where("fingerprint IS NOT NULL")
    return X.overlay(d, reviews, "doc_id", stamp).select("doc_id", "decision")


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT supersedes FROM documents WHERE supersedes IS NOT NULL AND supersedes <> doc_id)")
def superseded_filter(spark: SparkSession, base: str) -> DataFrame:
    return X.current(_docs(spark, base).select("doc_id", "supersedes")).select("doc_id")


@R.query(
    _P4_CHECKED
    + """, e AS (SELECT line_id, f[2] AS timekeeper, f[3]::DOUBLE AS hours, dayofweek(f[1]::DATE) IN (0, 6) AS weekend, f[4] = '' AS no_code, length(f[6]) < 40 AS short FROM checked WHERE reason IS NULL)
SELECT timekeeper, count(*) AS entries, round(sum(hours), 6) AS hours, count_if(hours > 10)::BIGINT AS long_day, count_if(weekend)::BIGINT AS weekend, count_if(no_code)::BIGINT AS no_code, count_if(short)::BIGINT AS short FROM e GROUP BY timekeeper"""
)
def billing_flags(spark: SparkSession, base: str) -> DataFrame:
    """Totals and flags of the valid time entries by timekeeper; repeated deliveries once."""
    good, _ = row_errors.time_entries(table(spark, base, "billing_lines"))
    one = good.select("line_id", "date", "timekeeper", F.col("hours").cast("double").alias("hours"), "task_code", "narrative").distinct()
    return one.groupBy("timekeeper").agg(
        F.count(F.lit(1)).alias("entries"),
        F.round(F.sum("hours"), 6).alias("hours"),
        F.count_if(F.col("hours") > 10).alias("long_day"),
        F.count_if(F.dayofweek("date").isin(1, 7)).alias("weekend"),
        F.count_if(F.col("task_code").isNull()).alias("no_code"),
        F.count_if(F.length("narrative") < 40).alias("short"),
    )


@R.query("SELECT doc_id, keyword, substr(sha256(doc_id || '|' || keyword), 1, 16) AS alert_id FROM documents, (SELECT unnest(['Escrow', 'data protection', 'hibernation', 'Haftung']) AS keyword) WHERE contains(lower(text), lower(keyword))")
def keyword_watch_alerts(spark: SparkSession, base: str) -> DataFrame:
    return X.watched(_docs(spark, base), "doc_id", "text", ["Escrow", "data protection", "hibernation", "Haftung"])


@R.query(f"""WITH t AS (SELECT DISTINCT tenant_id, lower(text) AS text FROM hits WHERE tenant_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT DISTINCT tenant_id, left(trim(text, {_BLANK}), 80) AS head FROM t WHERE trim(text, {_BLANK}) <> ''), n AS (SELECT DISTINCT length(head) AS n FROM h),
w AS (SELECT DISTINCT tenant_id, substr(text, i, n) AS head FROM (SELECT tenant_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM t, n WHERE length(text) >= n)),
o AS (SELECT head, min(tenant_id) AS a, max(tenant_id) AS b FROM w WHERE head IN (SELECT head FROM h) GROUP BY head)
SELECT tenant_id, count(*) AS heads, count_if(a <> tenant_id OR b <> tenant_id)::BIGINT AS leaked FROM h JOIN o USING (head) GROUP BY tenant_id""")
def leak_anywhere(spark: SparkSession, base: str) -> DataFrame:
    """Per tenant, how many of the heads of its texts stand anywhere in a text of another
    tenant: the first 80 characters, or the whole of a shorter text; case does not count."""
    found = leaks.leaked_heads(table(spark, base, "hits"), "tenant_id", "text")
    return found.groupBy(F.col("tenant").alias("tenant_id")).agg(F.count(F.lit(1)).alias("heads"), F.count_if("leaked").alias("leaked"))


@R.query("SELECT k AS code, count(*) AS n FROM (SELECT json_extract_string(CASE WHEN event_id % 10 = 0 THEN left(props, 3) ELSE props END, '$.k') AS k FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS p FROM events) WHERE p IS NOT NULL) WHERE k::INT <= 20 GROUP BY k UNION ALL SELECT 'malformed', count(*) FROM events WHERE event_id % 10 = 0")
def log_code_counts(spark: SparkSession, base: str) -> DataFrame:
    """Codes of a log of JSON lines, of which each tenth is cut off: counts of the listed
    codes, and of the lines that cannot be read."""
    line = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    code = F.from_json(line, "k string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    found = table(spark, base, "events").select(code.alias("c")).select(F.when(F.col("c._bad").isNotNull() | F.col("c").isNull(), "malformed").otherwise(F.col("c.k")).alias("code"))
    return found.where((F.col("code") == "malformed") | (F.col("code").try_cast("int") <= 20)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@R.query()
def document_diff(spark: SparkSession, base: str) -> DataFrame:
    """Lines that differ between each document and the one it supersedes."""
    d = _docs(spark, base).select("doc_id", "supersedes", "text")
    pairs = d.where("supersedes IS NOT NULL").join(d.select(F.col("doc_id").alias("supersedes"), F.col("text").alias("old")), "supersedes").select("doc_id", "old", F.col("text").alias("new"))
    return X.diffs(pairs, "doc_id", "old", "new")

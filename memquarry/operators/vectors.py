"""Exact similarity search over a table of vectors.

Scores are cosines, rounded to 6 decimals as clients see them; 0 where a vector
has no length. Order is score descending, then id ascending. Queries come in
blocks of bounded size; a batch of rows is scored against a block with one matrix
product and gives at most k rows per query, so what is shuffled is k rows per
query and batch, not a score per pair.

Defined results: rows whose vector is null, of another dimension than the query,
or not finite are left out; k <= 0 gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries scored in one pass; a larger set is searched in several.
BLOCK = 8192
RESULT = "query bigint, id bigint, score double"


def clamp_fetch(k: int) -> int:
    """How many hits of each space enter a fusion."""
    return max(32, min(256, 8 * k))


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ok = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim
    x = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    ok[np.flatnonzero(ok)[~good]] = False
    x = x[good]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return ok, np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def search(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int, min_score: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query, id, score): of the rows (id, embedding) the k best for each query."""
    spark = rows.sparkSession
    parts = [_pass(rows, queries[i : i + BLOCK], k, min_score, exclude_self) for i in range(0, len(queries) if k > 0 else 0, BLOCK)]
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return top_per_query(out, k)


def top_per_query(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _pass(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int, min_score: float | None, exclude_self: bool) -> DataFrame:
    q_ids = np.array([q for q, _ in queries], np.int64)
    q = np.array([v for _, v in queries], np.float64)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, np.divide(q, n, out=np.zeros_like(q), where=n > 0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            ok, x = _matrix(b.column(1), q.shape[1])
            ids = b.column(0).filter(pa.array(ok)).to_numpy().astype(np.int64)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            for first in range(0, len(q), 256):
                s = np.round(q[first : first + 256] @ x.T, 6) + 0.0
                if exclude_self:
                    s[q_ids[first : first + 256, None] == ids[None, :]] = -np.inf
                # Stable order on rows sorted by id: ties go to the smaller id.
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(s, best, 1)
                keep = np.isfinite(top) if min_score is None else top >= min_score
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[first + r]), pa.array(ids[best[r, c]]), pa.array(top[r, c])], names=["query", "id", "score"])

    return rows.select(F.col("id").cast("bigint"), "embedding").mapInArrow(work, RESULT)


def stored(rows: DataFrame, ids: list[int]) -> list[tuple[int, list[float]]]:
    """The vectors of a few ids, as queries; an unknown id is an error."""
    found = {r["id"]: r["embedding"] for r in rows.where(F.col("id").isin(ids)).select("id", "embedding").collect()}
    missing = [i for i in ids if i not in found]
    if missing:
        raise KeyError(f"vector id not found: {missing[0]}")
    return [(i, found[i]) for i in ids]


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Each hit with its document (id, doc), null where there is none. Joined after the cut."""
    return hits.join(docs, "id", "left")


def containing(rows: DataFrame, docs: DataFrame, needle: str) -> DataFrame:
    """The rows whose document (id, doc) contains the needle; before the search, so that it is exact."""
    return rows.join(docs.where(F.col("doc").contains(needle)).select("id"), "id", "left_semi")


def fuse(spaces: dict[str, tuple[DataFrame, list[float]]], k: int, weights: list[float] | None = None, min_score: float | None = None) -> DataFrame:
    """(id, score): weighted mean of the cosines in several spaces, of the ids among the
    best of any space; a space without the id adds 0. ``min_score`` holds for the fused score."""
    if len(spaces) < 2:
        raise ValueError("a fusion needs two spaces at least")
    w = weights or [1.0] * len(spaces)
    if len(w) != len(spaces) or any(not np.isfinite(x) or x < 0 for x in w) or sum(w) <= 0:
        raise ValueError("one finite weight >= 0 per space, not all 0")
    hits = None
    for (rows, query), x in zip(spaces.values(), w):
        part = search(rows, [(0, query)], clamp_fetch(k)).withColumn("score", F.col("score") * (x / sum(w)))
        hits = part if hits is None else hits.unionAll(part)
    fused = hits.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))
    if min_score is not None:
        fused = fused.where(F.col("score") >= min_score)
    return fused.orderBy(F.desc("score"), "id").limit(k)


def generations(log: DataFrame) -> DataFrame:
    """Per id of an ordered log of (id, seq, live): its state at the end and its generation,
    1 and one more for each change between live and dead."""
    w = Window.partitionBy("id").orderBy("seq")
    before = F.lag("live").over(w)
    changed = F.when(before.isNull(), F.lit(0)).otherwise((before != F.col("live")).cast("int"))
    return log.withColumn("_c", changed).groupBy("id").agg(F.max_by("live", "seq").alias("live"), (F.sum("_c") + 1).cast("bigint").alias("generation"))


# Migrations --------------------------------------------------------------------------


@dataclass(frozen=True)
class Migration:
    """VMIGRATE: a live index (id, embedding) and a shadow that is filled beside it.

    ``start`` opens an empty shadow; ``add`` fills it, of an id the last row (``seq``)
    holds; searches see ``live`` until ``swap`` puts the shadow in its place, which an
    empty shadow cannot; ``cancel`` drops the shadow."""

    live: DataFrame
    shadow: DataFrame | None = None

    def start(self) -> "Migration":
        if self.shadow is not None:
            raise ValueError("a migration is under way")
        return Migration(self.live, self.live.select("id", "embedding").limit(0).withColumn("seq", F.lit(0).cast("bigint")))

    def add(self, rows: DataFrame) -> "Migration":
        """``rows``: id, embedding, seq."""
        if self.shadow is None:
            raise ValueError("no migration is under way")
        return Migration(self.live, self.shadow.unionByName(rows.select("id", "embedding", "seq")))

    def swap(self) -> "Migration":
        if self.shadow is None or self.shadow.isEmpty():
            raise ValueError("the shadow index is empty")
        return Migration(self.shadow.groupBy("id").agg(F.max_by("embedding", "seq").alias("embedding")))

    def cancel(self) -> "Migration":
        return Migration(self.live)


def upserted(live: DataFrame, batch: DataFrame) -> DataFrame:
    """VADD_BATCH: the rows (id, embedding) with those of the batch (id, embedding, pos) in
    their place; of an id given twice the last holds."""
    new = batch.groupBy("id").agg(F.max_by("embedding", "pos").alias("embedding"))
    return live.join(new.select("id"), "id", "left_anti").select("id", "embedding").unionByName(new)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query, recall): the share of the k exact hits that were found."""
    hit = exact.join(found.select("query", "id", F.lit(1).alias("_f")), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.round(F.sum(F.coalesce("_f", F.lit(0))) / k, 6).alias("recall"))

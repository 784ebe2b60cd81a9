"""Exact nearest neighbours of many vectors at once, in blocks.

Each group of rows (a collection) is divided into blocks of queries and blocks of
rows by a hash of the id; a pair of blocks is one unit of work, whose queries are
held as a matrix while its rows stream by. A unit gives at most k hits per query.
Neither queries nor rows pass through the driver, and a group may be of any size.

Defined results: vectors that are null, of another dimension or not finite are
left out; a vector of length 0 has score 0 with every other. Order is score
descending, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a unit.
UNIT_QUERIES, UNIT_ROWS = 1 << 15, 1 << 18
#: Scores computed at once.
CHUNK = 1 << 20
RESULT = "query bigint, id bigint, score double"


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and those with length 1 (or 0)."""
    ok = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim
    x = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    ok[np.flatnonzero(ok)[~good]] = False
    x = x[good]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return ok, np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Best:
    """The k best rows seen so far for each of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, digits: int, with_self: bool) -> None:
        self.ids, self.x, self.k, self.digits, self.with_self = ids, x, k, digits, with_self
        self.score = np.full((len(ids), k), -np.inf)
        self.other = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CHUNK // max(len(ids), 1))
        for first in range(0, len(self.ids), step):
            past = min(first + step, len(self.ids))
            s = np.round(self.x[first:past] @ x.T, self.digits) + 0.0
            if not self.with_self:
                s[self.ids[first:past, None] == ids[None, :]] = -np.inf
            least = self.score[first:past, -1]
            if self.k < len(ids) and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            q, r = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            if len(q):
                self._merge(first + np.unique(q), first + q, s[q, r], ids[r])

    def _merge(self, met: np.ndarray, q: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        q = np.concatenate((np.repeat(met, self.k), q))
        score = np.concatenate((self.score[met].ravel(), score))
        other = np.concatenate((self.other[met].ravel(), other))
        order = np.lexsort((other, -score, q))
        take = order[np.searchsorted(q[order], met)[:, None] + np.arange(self.k)]
        self.score[met], self.other[met] = score[take], other[take]

    def batch(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.other[q, c]), pa.array(self.score[q, c])], names=["query", "id", "score"])


def _units(dim: int, k: int, digits: int, with_self: bool):
    """Reads rows sorted by unit, its queries first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asking, best = None, [], None
        for b in batches:
            ok, x = unit_rows(b.column(5), dim)
            keep = np.flatnonzero(ok)
            if not len(keep):
                continue
            key = np.stack([b.column(i).to_numpy()[keep] for i in range(4)], 1)
            ids = b.column(4).to_numpy()[keep]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                *unit, side = key[i].tolist()
                if unit != current:
                    if best is not None:
                        yield best.batch()
                    current, asking, best = unit, [], None
                if side == 0:
                    asking.append((ids[i:j], x[i:j]))
                elif asking:
                    if best is None:
                        best = _Best(np.concatenate([a for a, _ in asking]), np.concatenate([a for _, a in asking]), k, digits, with_self)
                    best.see(ids[i:j], x[i:j])
        if best is not None:
            yield best.batch()

    return work


def _blocks(queries: Column, rows: Column) -> list[Column]:
    """Into how many blocks so many queries and rows are divided."""
    return [F.greatest(F.lit(1), F.ceil(n / most)).cast("int").alias(c) for n, most, c in ((queries, UNIT_QUERIES, "q"), (rows, UNIT_ROWS, "r"))]


def _places(asks: Column, searched: Column) -> Column:
    """The units (query block, row block, side) that a row takes part in."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    unit = lambda qb, rb, side: F.struct(qb.alias("qb"), rb.alias("rb"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<qb: int, rb: int, side: int>>")
    mine = F.when(asks, F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda j: unit(block("q"), j, 0))).otherwise(none)
    theirs = F.when(searched, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda i: unit(i, block("r"), 1))).otherwise(none)
    return F.explode(F.concat(mine, theirs))


def _hits(wide: DataFrame, asks: Column, searched: Column, k: int, dim: int, digits: int) -> DataFrame:
    """``wide``: coll, id, embedding, q, r."""
    units = wide.withColumn("u", _places(asks, searched)).select("coll", "u.qb", "u.rb", "u.side", "id", "embedding")
    return units.repartition("coll", "qb", "rb").sortWithinPartitions("coll", "qb", "rb", "side").mapInArrow(_units(dim, k, digits, False), RESULT)


def hits_by_unit(ids: DataFrame, embeddings: DataFrame, k: int, dim: int, digits: int = 6) -> DataFrame:
    """(query, id, score): of each unit the k rows nearest to each query of the same
    collection, without itself. ``ids``: coll, id, asks (whether the row is a query);
    ``embeddings``: id, embedding. Sizes meet the ids before the embeddings are moved."""
    n = F.count(F.lit(1))
    sizes = ids.groupBy("coll").agg(F.count_if("asks").alias("_q"), n.alias("_r")).where("_q > 0 AND _r > 1").select("coll", *_blocks(F.col("_q"), F.col("_r")))
    wide = ids.join(sizes, "coll").join(embeddings.select("id", "embedding"), "id")
    return _hits(wide, F.col("asks"), F.lit(True), k, dim, digits)


def hits_of_queries(rows: DataFrame, queries: DataFrame, k: int, dim: int, digits: int = 6) -> DataFrame:
    """The same for queries (coll, id, embedding) that are no rows; one with the id of a row
    does not find it."""
    wide = lambda df, asks: df.select("coll", F.col("id").cast("bigint").alias("id"), "embedding", F.lit(asks).alias("asks"))
    asked = queries.groupBy("coll").agg(F.count(F.lit(1)).alias("_q"))
    sizes = rows.groupBy("coll").agg(F.count(F.lit(1)).alias("_r")).join(asked, "coll").select("coll", *_blocks(F.col("_q"), F.col("_r")))
    return _hits(wide(rows, False).unionByName(wide(queries, True)).join(sizes, "coll"), F.col("asks"), ~F.col("asks"), k, dim, digits)


def nearest(rows: DataFrame, asks: Column, k: int, dim: int, queries: DataFrame | None = None) -> DataFrame:
    """(query, id, score): the k nearest others of each row (id, embedding) for which ``asks``
    holds, or of each of ``queries``."""
    one = F.lit(0).cast("bigint").alias("coll")
    if queries is not None:
        hits = hits_of_queries(rows.select(one, "id", "embedding"), queries.select(one, "id", "embedding"), k, dim)
    else:
        sizes = rows.agg(F.count_if(asks).alias("_q"), F.count(F.lit(1)).alias("_r")).select(*_blocks(F.col("_q"), F.col("_r")))  # one row
        wide = rows.select(one, F.col("id").cast("bigint").alias("id"), "embedding", F.coalesce(asks, F.lit(False)).alias("asks")).crossJoin(F.broadcast(sizes))
        hits = _hits(wide, F.col("asks"), F.lit(True), k, dim, 6)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

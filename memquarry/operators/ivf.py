"""An index of cells for vector search: inverted lists of a spherical k-means.

*Build*: centroids are fitted on a bounded sample (``SAMPLE`` rows by hash of the id);
every row goes to the cell of its nearest centroid, and the index is written in the
order of the cells, so that a search reads the row groups of the cells it probes and
no others. *Search*: a query looks into the ``probes`` cells whose centroids are nearest
and ranks their rows by the vectors themselves; with as many probes as cells it is
exact. ``probes`` is what EF is for a graph index.

Defined results: rows that are null, of another dimension or not finite are left out;
an empty table gives an empty index; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.operators import vectors
from memquarry.operators.blocks import RESULT, hits_of_queries, unit_rows
from memquarry.plans.scratch import new_path

#: Rows that centroids are fitted on, and the most cells there are.
SAMPLE, MOST_CELLS = 1 << 15, 4096


def centroids_of(x: np.ndarray, cells: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Unit centroids; a cell that runs empty begins anew at the row served worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        total[empty] = x[np.argsort(s.max(1))[: len(empty)]]
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.divide(total, n, out=c.copy(), where=n > 0)
    return c


@dataclass
class CellIndex:
    """(id, embedding, cell) in the order of the cells, and the centroids."""

    rows: DataFrame
    centroids: np.ndarray
    path: str

    @staticmethod
    def build(rows: DataFrame, dim: int, cells: int | None = None, path: str | None = None) -> "CellIndex":
        """``cells`` is the root of the number of rows if not given, at most ``MOST_CELLS``."""
        spark = rows.sparkSession
        usable = rows.select(F.col("id").cast("bigint").alias("id"), "embedding").where(F.size("embedding") == dim)
        n = usable.count()
        sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        _, x = unit_rows(sample["embedding"].combine_chunks(), dim) if n else (None, np.zeros((0, dim)))
        cells = min(max(1, cells or int(round(n**0.5))), max(len(x), 1), MOST_CELLS)
        c = centroids_of(x, cells) if len(x) else np.zeros((1, dim))
        shared = spark.sparkContext.broadcast(c)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok, x = unit_rows(b.column(1), dim)
                cell = (x @ shared.value.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(cell)], names=["id", "embedding", "cell"])

        kind = dict(rows.dtypes)["embedding"]
        placed = usable.mapInArrow(assign, f"id bigint, embedding {kind}, cell int")
        path = path or new_path(spark, "cells")
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows")
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        return CellIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> "CellIndex":
        """An index that was built before. Its centroids are written last: without them it is
        not whole and cannot be opened."""
        c = spark.read.parquet(f"{path}/centroids").orderBy("cell").limit(MOST_CELLS).toPandas()
        return CellIndex(spark.read.parquet(f"{path}/rows"), np.array(c["centroid"].tolist(), np.float64), path)

    def faults(self, rows: DataFrame) -> DataFrame:
        """(id, fault) where the index and the usable rows (id, embedding) it was built from
        differ: \"missing\", \"extra\", \"changed\", or \"cell\" for a row in the wrong cell."""
        dim, shared = self.centroids.shape[1], rows.sparkSession.sparkContext.broadcast(self.centroids)

        def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x = unit_rows(b.column(1), dim)
                best = (x @ shared.value.T).max(1, initial=-2)
                own = (x * shared.value[b.column(2).to_numpy()]).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own < best - 1e-9)], names=["id", "mine", "off"])

        kind = dict(self.rows.dtypes)["embedding"]
        mine = self.rows.mapInArrow(off, f"id bigint, mine {kind}, off boolean")
        usable = rows.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").alias("theirs")).where((F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | F.abs(v).isin(float("inf"))))
        both = mine.join(usable, "id", "full_outer")
        fault = F.when(F.col("mine").isNull(), "missing").when(F.col("theirs").isNull(), "extra").when(F.col("mine") != F.col("theirs"), "changed").when(F.col("off"), "cell")
        return both.select("id", fault.alias("fault")).where("fault IS NOT NULL")

    def search(self, queries: list[tuple[int, list[float]]], k: int, probes: int, min_score: float | None = None, exclude_self: bool = False) -> DataFrame:
        """(query, id, score) for a block of queries; the cells probed are a filter of the scan."""
        spark, c = self.rows.sparkSession, self.centroids
        parts = []
        for first in range(0, len(queries) if k > 0 else 0, vectors.BLOCK):
            block = queries[first : first + vectors.BLOCK]
            q_ids = np.array([i for i, _ in block], np.int64)
            q = np.array([v for _, v in block], np.float64)
            n = np.linalg.norm(q, axis=1, keepdims=True)
            q = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
            probed = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, : max(1, probes)]
            asked = np.zeros((len(block), len(c)), bool)
            asked[np.arange(len(block))[:, None], probed] = True
            cells = np.flatnonzero(asked.any(0)).tolist()
            rows = self.rows if len(cells) == len(c) else self.rows.where(F.col("cell").isin(cells))
            parts.append(rows.mapInArrow(_probe(spark.sparkContext.broadcast((q_ids, q, asked)), k, min_score, exclude_self), RESULT))
        if not parts:
            return spark.createDataFrame([], RESULT)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return vectors.top_per_query(out, k)

    def search_many(self, queries: DataFrame, k: int, probes: int, min_score: float | None = None) -> DataFrame:
        """(query, id, score) for a table of queries (id, embedding) without the query itself:
        each goes to the cells it probes, which are searched in blocks."""
        c = self.centroids
        shared = queries.sparkSession.sparkContext.broadcast(c)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok, x = unit_rows(b.column(1), c.shape[1])
                own = pa.array(ok)
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, : max(1, probes)].astype(np.int32)
                cells = pa.ListArray.from_arrays(np.arange(0, near.size + 1, max(near.shape[1], 1), dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(own), b.column(1).filter(own), cells], names=["id", "embedding", "cells"])

        kind = dict(queries.dtypes)["embedding"]
        asked = queries.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInArrow(choose, f"id bigint, embedding {kind}, cells array<int>")
        asked = asked.select("id", "embedding", F.explode(F.col("cells").cast("array<bigint>")).alias("coll"))
        rows = self.rows.select("id", "embedding", F.col("cell").cast("bigint").alias("coll"))
        hits = hits_of_queries(rows, asked, k, c.shape[1])
        return vectors.top_per_query(hits if min_score is None else hits.where(F.col("score") >= min_score), k)


def _probe(shared, k: int, min_score: float | None, exclude_self: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, asked = shared.value
        for b in batches:
            _, x = unit_rows(b.column(1), q.shape[1])
            ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            for c in np.unique(cell).tolist():
                mine, want = np.flatnonzero(cell == c), np.flatnonzero(asked[:, c])
                for first in range(0, len(want), 1024):
                    w = want[first : first + 1024]
                    s = np.round(q[w] @ x[mine].T, 6) + 0.0
                    if exclude_self:
                        s[q_ids[w][:, None] == ids[mine][None, :]] = -np.inf
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    top = np.take_along_axis(s, best, 1)
                    r, j = np.nonzero(np.isfinite(top) if min_score is None else top >= min_score)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[w][r]), pa.array(ids[mine][best[r, j]]), pa.array(top[r, j])], names=["query", "id", "score"])

    return work


def recall_summary(recalls: DataFrame) -> DataFrame:
    """(n, mean, p05) of the recall (query, recall) of many queries."""
    return recalls.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("mean"), F.round(F.percentile("recall", 0.05), 6).alias("p05"))

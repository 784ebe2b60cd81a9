"""Texts whose shingle sets have a Jaccard similarity of at least a threshold.

One hash function orders each text's distinct shingles; the lowest ``k`` are its
sketch. Two similar texts keep mostly the same values, so their sketches agree in
stretches. The inverted lists hold runs of four neighbouring retained values:
single values of a corpus with much boilerplate give lists that grow with it, a
run of four is shared by hardly any texts but similar ones. A text with few
shingles gets the runs of several orders made from the same hash, about
``MIN_VALUES`` in all, as one order would leave too few. Texts that share a run
are candidates; the sketch of their union estimates the similarity, and what may
reach the threshold is verified on the whole sets.

The chance that a pair with similarity just 0.6 shares no run is about 0.2 %
(no stretch of four among 120 values, each shared with probability 0.6), and it
falls fast above that. Every reported similarity is exact. Thresholds under 0.55
would need shorter runs and are refused.

Texts with equal sets are one class: only one text per class and task enters the
lists, so that copies cost one list entry however many there are.

Defined results: null and blank texts and those with fewer words than a shingle
have an empty set and no links; ids must be unique, rows with null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm import textops
from memquarry.plans.bloom import id_filter
from memquarry.plans.scratch import written

SKETCH = 96
MIN_VALUES = 120
RUN = 4
#: Sets of up to so many shingles also get shorter runs: (run, size).
SHORT_RUNS = ((3, 5), (2, 3))
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _runs(doc: np.ndarray, value: np.ndarray, length: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of neighbouring values within each text."""
    n = len(value) - length + 1
    if n <= 0:
        return doc[:0], value[:0]
    h = np.full(n, np.uint64(order * 8 + length))
    with np.errstate(over="ignore"):
        for j in range(length):
            h = (h + value[j : j + n]) * _MULT[j]
    whole = doc[:n] == doc[length - 1 :]
    return doc[:n][whole], textops.mix64(h[whole])


def _lowest(doc: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """True for the k first of each text, in arrays sorted by text and value."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.append(first, len(doc)))
    return np.arange(len(doc)) - np.repeat(first, counts) < k


def sketch_runs(texts: list[str], n_words: int, k: int = SKETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: size of its shingle set, a hash of the set, and the number of
    runs of its sketch; then all runs, text by text."""
    doc, value = textops.shingles(texts, n_words)
    size = np.bincount(doc, minlength=len(texts))
    with np.errstate(over="ignore"):
        ends = np.cumsum(size)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        set_id = textops.mix64(running[ends] - running[ends - size] + size.astype(np.uint64))
    docs, runs = [], []
    orders = -(-MIN_VALUES // np.maximum(size, 1))
    for order in range(int(orders[size > 1].max(initial=0))):
        if order:
            pick = ((orders > order) & (size > 1))[doc]
            with np.errstate(over="ignore"):
                d, v = doc[pick], textops.mix64(value[pick] ^ (np.uint64(order) * _MULT[0]))
            by = np.lexsort((v, d))
            d, v = d[by], v[by]
        else:
            d, v = doc, value
        low = _lowest(d, v, k)
        parts = [_runs(d[low], v[low], RUN, order)]
        for length, most in SHORT_RUNS:
            small = size[d] <= most
            if small.any():
                parts.append(_runs(d[small], v[small], length, order))
        for dd, r in parts:
            docs.append(dd)
            runs.append(r)
    d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    r = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
    by = np.argsort(d, kind="stable")
    return size, set_id, np.bincount(d, minlength=len(texts)), r[by]


def list_entries(docs: DataFrame, n_words: int, k: int = SKETCH) -> DataFrame:
    """The entries of the inverted lists of the documents (id, text): run, set_id, n
    (size of the set), with null id; and for each document with a non-empty set one
    more row with its id, under a key of its own. Of the texts with one set, a task
    enters the runs of the first only; ``route`` parts the rows of runs that very many
    texts share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        routes = textops.Routes()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size, set_id, counts, runs = sketch_runs(texts, n_words, k)
            ids = set_id.view(np.int64)
            fresh = np.zeros(len(texts), bool)
            for i, x in enumerate(ids.tolist()):
                if size[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            doc = np.repeat(np.arange(len(texts)), np.where(fresh, counts, 0))
            filled = np.flatnonzero(size)
            own = b.column(0).to_numpy()[filled]
            row = np.concatenate((filled, doc))
            key = np.concatenate((textops.mix64(own.view(np.uint64)), runs[np.repeat(fresh, counts)]))
            id_of = np.concatenate((own, np.zeros(len(doc), np.int64)))
            route = np.concatenate((np.zeros(len(own), np.int32), routes.of(key[len(own) :], ids[doc])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(size[row].astype(np.int32)), pa.array(id_of, mask=np.arange(len(row)) >= len(own)), pa.array(route)],
                names=["run", "set_id", "n", "id", "route"],
            )

    return docs.mapInArrow(work, "run bigint, set_id bigint, n int, id bigint, route int")


def prefix_entries(docs: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """The entries of lists that lose nothing: of each set (run, set_id, n) its rarest
    shingles, as many as a set may lack and still reach the threshold, and one more. Two
    similar sets share one of them, whatever the hash does."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size, set_id, _, _ = sketch_runs(texts, n_words, 1)
            doc, value = textops.shingles(texts, n_words)
            fresh = np.zeros(len(texts), bool)
            for i, x in enumerate(set_id.tolist()):
                if size[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keep = fresh[doc]
            doc, value = doc[keep], value[keep]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(set_id.view(np.int64)[doc]), pa.array(size[doc].astype(np.int32))], names=["run", "set_id", "n"])

    every = written(docs.mapInArrow(work, "run bigint, set_id bigint, n int").distinct(), "shingles")
    counts = every.groupBy("run").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("f", "run"))
    few = F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    return every.join(counts, "run").withColumn("r", rank).where(few & (F.col("f") > 1)).select("run", "set_id", "n")


def _verify(threshold: float, n_words: int, k: int, estimate: bool = True):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_text, b_text = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            sets: dict[str, np.ndarray] = {}
            distinct = list(dict.fromkeys(a_text + b_text))
            doc, value = textops.shingles(distinct, n_words)
            at = np.searchsorted(doc, np.arange(len(distinct) + 1))
            for i, t in enumerate(distinct):
                sets[t] = value[at[i] : at[i + 1]]
            sims = np.zeros(len(a_text))
            for i, (x, y) in enumerate(zip(a_text, b_text)):
                x, y = sets[x], sets[y]
                if estimate:
                    low = np.union1d(x[:k], y[:k])[:k]
                    est = np.isin(low, x[:k], assume_unique=True) & np.isin(low, y[:k], assume_unique=True)
                    e = est.mean() if len(low) else 0.0
                    if e + 4 * np.sqrt(max(e * (1 - e), 0.05) / max(len(low), 1)) < threshold:
                        continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                sims[i] = common / max(len(x) + len(y) - common, 1)
            keep = sims >= threshold
            yield pa.RecordBatch.from_arrays([b.column("set_a"), b.column("set_b"), pa.array(sims)], names=["set_a", "set_b", "similarity"]).filter(pa.array(keep))

    return work


class NearDuplicates:
    """The links between the documents of a table.

    ``docs`` needs the columns named; others are ignored. ``classes`` has a row per
    document with a non-empty set: id, set_id. ``links`` has the pairs of classes
    with similarity >= threshold: set_a < set_b, similarity. Nothing is lost between
    different texts; copies are not expanded unless :meth:`pairs` is asked for.

    With ``exact`` the lists hold the rarest shingles of each set instead of runs, and
    every candidate is verified: no link is lost to chance, at the price of every shingle
    being counted and of far more candidates."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8, k: int = SKETCH, exact: bool = False) -> None:
        if threshold < 0.55 and not exact or not 0 < threshold <= 1:
            raise ValueError("the threshold must be at least 0.55, or above 0 with exact")
        docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
        w = Window.partitionBy("run", "route")
        entries = list_entries(docs, n_words, k).withColumns({"low": F.min("set_id").over(w), "high": F.max("set_id").over(w)})
        kept = written(entries.where(F.col("id").isNotNull() | (F.col("route") > 0) | (F.col("low") < F.col("high"))).select("run", "set_id", "n", "id").distinct(), "lists")
        self.classes = kept.where(F.col("id").isNotNull()).select("id", "set_id")
        shared = written(prefix_entries(docs, n_words, threshold), "prefixes") if exact else kept.where(F.col("id").isNull()).select("run", "set_id", "n")
        a = shared.select("run", F.col("set_id").alias("set_a"), F.col("n").alias("n_a"))
        b = shared.select("run", F.col("set_id").alias("set_b"), F.col("n").alias("n_b"))
        compatible = (F.col("set_a") < F.col("set_b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
        candidates = a.join(b, "run").where(compatible).select("set_a", "set_b").distinct()
        first = self.classes.groupBy("set_id").agg(F.min("id").alias("id"))
        candidates = written(
            candidates.join(first.select(F.col("set_id").alias("set_a"), F.col("id").alias("id_a")), "set_a").join(first.select(F.col("set_id").alias("set_b"), F.col("id").alias("id_b")), "set_b"),
            "candidates",
        )
        self.candidates = candidates
        wanted = id_filter(candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id")
        texts = docs.where(wanted("id"))
        both = candidates.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        self.links = written(both.select("set_a", "set_b", "text_a", "text_b").mapInArrow(_verify(threshold, n_words, k, not exact), "set_a bigint, set_b bigint, similarity double"), "links")

    def pairs(self) -> DataFrame:
        """All pairs of documents, copies included: id_a < id_b, similarity."""
        c = self.classes
        a, b = c.select(F.col("set_id").alias("set_a"), F.col("id").alias("x")), c.select(F.col("set_id").alias("set_b"), F.col("id").alias("y"))
        linked = self.links.join(a, "set_a").join(b, "set_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
        copied = c.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set_id")
        again = c.join(copied, "set_id")
        same = again.select("set_id", F.col("id").alias("id_a")).join(again.select("set_id", F.col("id").alias("id_b")), "set_id").where("id_a < id_b")
        return linked.unionAll(same.select("id_a", "id_b", F.lit(1.0).alias("similarity")))

    def documents(self) -> DataFrame:
        """A row per document with a non-empty set: id, class_id (smallest id with
        the same set), n_links (classes linked to its own)."""
        first = self.classes.groupBy("set_id").agg(F.min("id").alias("class_id"))
        degree = self.links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
        return self.classes.join(first.join(degree, "set_id", "left"), "set_id").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))

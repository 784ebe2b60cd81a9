"""The most similar vectors of every vector within its collection.

Multi-index hashing: rotations learned on a bounded sample (iterative
quantisation: the rotation for which the signs lose least) turn each vector into
a binary code of ``tables`` substrings, and each substring has its own index. A
pair is retrieved if some substring differs in at most ``reach`` bits. By the
pigeonhole principle that finds every pair of codes within a Hamming radius of
(reach + 1) * tables - 1; what it finds beyond is kept up to ``max_hamming`` and
all of it is ranked again with the vectors themselves. Cosines reported are exact.

Substrings are 8 * (reach + 1) bits: 16 bits and one bit of difference, 24 and two,
32 and three. Each of these finds a pair with cosine 0.9 by one table with a chance
of about 0.31 and by twelve with 0.99; closer pairs have more. What differs is the
work: short substrings share their values with n / 2**16 others, long ones are
looked up under more masks. ``reach_for`` takes the cheaper for the size of the
largest collection, so the recall is the same at every size and the compares of a
vector do not grow in step with its collection.

Within a substring the pigeonhole principle holds once more: a pair within reach
agrees in one of its reach + 1 bytes. An index is divided into cells by each of
them (by as many of its bits as make cells of about ``CELL`` codes), so every code has
tables * (reach + 1) entries, however large its collection.
A cell that is too large for one task, as when many vectors share a byte, is
divided into blocks, each pair of which is one unit of work. A collection that fits
one cell is not divided. Equal vectors are one class, which has one entry however
many they are.

That gives the neighbours above a cosine. ``complete`` gives every vector its k: those
for which the index has fewer are compared with their whole collection, exactly, in
blocks of queries and rows.

Defined results: of each id the row with the highest generation counts (null is
lowest; of equal ones any repeat, or else the one that hashes highest); it is live
if not a tombstone (null: it is not) and its embedding has ``dim`` finite numbers
not all zero; a null space is ``''``. Rows with null id are left out. Ties in
cosine are ranked by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.operators import blocks
from memquarry.plans.bloom import id_filter
from memquarry.plans.scratch import written

#: Rows of the sample on which the rotations are learned.
SAMPLE = 4096
#: Codes of a collection that is not divided, and codes that a unit of work may have.
CELL, UNIT = 8192, 1 << 16
#: Sizes of a collection above which longer substrings are cheaper: a compare takes about
#: 5 ns, a look-up 100 ns.
LONGER = (1 << 25, 1 << 33)
#: Pairs compared at once.
CHUNK = 1 << 20


def reach_for(n: int) -> int:
    """The reach that costs least for collections of up to ``n`` vectors."""
    return 1 + sum(n > size for size in LONGER)


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11, rounds: int = 20) -> np.ndarray:
    """A (dim, bits) matrix of rotations side by side, each fitted from another start."""
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // dim)):
        r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds if len(sample) >= dim else 0):
            u, _, vt = np.linalg.svd(sample.T @ np.sign(sample @ r))
            r = u @ vt
        out.append(r)
    return np.hstack(out)[:, :bits]


def _unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each embedding is usable, and the usable ones with length 1."""
    lists = lists.cast(pa.list_(pa.float64()))
    ok = (pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim)
    x = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good]
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(rotations: np.ndarray, dim: int):
    """(id, coll, same, words): ``same`` is the hash of the vector's content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _unit(b.column(3), dim)
            packed = np.packbits(x @ rotations > 0, axis=1, bitorder="little")
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
            words = pa.FixedSizeListArray.from_arrays(pa.array(packed.view(np.int64).ravel()), packed.shape[1]).cast(pa.list_(pa.int64()))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), b.column(2).filter(keep), words], names=["id", "coll", "same", "words"])

    return work


def _bytes(codes: np.ndarray) -> np.ndarray:
    """The codes' bytes, a row each; substring t has those from t * (reach + 1) on."""
    return np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), 8 * codes.shape[1])


def _spread(tables: int, reach: int):
    """The rows of the index: of each code its cells, or the one of its whole collection."""
    n_bytes = tables * (reach + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coll, words, lead = b.column(1).to_numpy(), b.column(2), b.column(3).to_numpy()
            codes = words.flatten().to_numpy().reshape(len(coll), -1).view(np.uint64) if len(coll) else np.zeros((0, 1), np.uint64)
            whole, divided = np.flatnonzero(lead == 0), np.flatnonzero(lead)
            row = np.concatenate((whole, np.repeat(divided, n_bytes)))
            part = np.concatenate((np.full(len(whole), -1), np.tile(np.arange(n_bytes), len(divided))))
            value = np.concatenate((np.zeros(len(whole), np.int64), (_bytes(codes[divided])[:, :n_bytes] >> (8 - lead[divided])[:, None]).ravel().astype(np.int64)))
            with np.errstate(over="ignore"):
                cell = coll[row].view(np.uint64) + (part + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (value + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), b.column(0).take(where), words.take(where), pa.array(part.astype(np.int32))], names=["cell", "id", "words", "part"])

    return work


def _near(codes: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bitwise_count(codes[x] ^ codes[y]).sum(1, dtype=np.int64) <= most
    return x[keep], y[keep]


def _expand(codes: np.ndarray, x: np.ndarray, start: np.ndarray, count: np.ndarray, order: np.ndarray, most: int):
    """Near pairs of each x with order[start : start + count], a chunk at a time."""
    has = count > 0
    x, start, count = x[has], start[has], count[has]
    ends = np.cumsum(count)
    first = 0
    while first < len(x):
        base = ends[first - 1] if first else 0
        past = max(first + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        c = count[first:past]
        # A long list is compared in stretches, so that no array outgrows the chunk.
        for skip in range(0, int(c.max()), CHUNK):
            part = np.minimum(np.maximum(c - skip, 0), CHUNK)
            e = np.cumsum(part)
            at = np.arange(e[-1]) - np.repeat(e - part, part) + np.repeat(start[first:past] + skip, part)
            yield _near(codes, np.repeat(x[first:past], part), order[at], most)
        first = past


@lru_cache(maxsize=None)
def masks(wide: int, reach: int, fixed: int = -1) -> np.ndarray:
    """All differences of 1 to ``reach`` bits in so many bytes, none in the byte ``fixed``."""
    free = [j for j in range(8 * wide) if j // 8 != fixed]
    return np.array([sum(1 << j for j in js) for k in range(1, reach + 1) for js in combinations(free, k)], np.int64)


def _pairs_by(codes: np.ndarray, value: np.ndarray, steps: np.ndarray, most: int):
    """Near pairs whose values are equal or differ by one of the ``steps``. Few codes are
    compared all with all, which costs less than the look-ups and finds no less."""
    n, order = len(value), np.argsort(value, kind="stable")
    place = np.arange(n)
    if 8 * (1 + len(steps)) >= n:
        yield from _expand(codes, order, place + 1, n - place - 1, order, most)
        return
    ordered = value[order]
    # Equal values: each with those after it in the order.
    yield from _expand(codes, order, place + 1, np.searchsorted(ordered, ordered, side="right") - place - 1, order, most)
    for m in steps.tolist():
        x = order[ordered ^ m > ordered]
        wanted = value[x] ^ m
        first = np.searchsorted(ordered, wanted, side="left")
        yield from _expand(codes, x, first, np.searchsorted(ordered, wanted, side="right") - first, order, most)


def _pairs_of_cell(codes: np.ndarray, part: int, tables: int, reach: int, most: int):
    """Near pairs of the codes of a cell, which share bits of byte ``part``, or of a collection."""
    wide = reach + 1
    own = _bytes(codes)
    substring = lambda t: sum((own[:, t * wide + i].astype(np.int64) << (8 * i) for i in range(wide)), np.zeros(len(own), np.int64))
    if part < 0:
        for t in range(tables):
            yield from _pairs_by(codes, substring(t), masks(wide, reach), most)
        return
    table, byte = divmod(part, wide)
    for x, y in _pairs_by(codes, substring(table), masks(wide, reach, byte), most):
        # Those that agree in an earlier byte too are found by its cell.
        new = (own[x, table * wide : part] != own[y, table * wide : part]).all(1)
        yield x[new], y[new]


def _search(tables: int, reach: int, most: int):
    """Reads rows sorted by unit of work and gives each unit's pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id_a", "id_b"]

        def unit(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, side = t["id"].to_numpy(), t["side"].to_numpy()
            codes = np.ascontiguousarray(t["words"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64))
            seen = []
            for x, y in _pairs_of_cell(codes, t["part"][0].as_py(), tables, reach, most):
                apart = (side[x] != side[y]) | (side[x] == 0)  # of two blocks, only pairs between them
                a, b = ids[x[apart]], ids[y[apart]]
                seen.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
            if seen:
                p = np.unique(np.concatenate(seen), axis=0)
                p = p[p[:, 0] < p[:, 1]]
                return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=names)
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=names)

        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            key = np.stack((b.column(0).to_numpy(), b.column(1).to_numpy()), 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if y <= x:
                    continue
                k = tuple(key[x].tolist())
                if current is not None and k != current:
                    yield unit(held)
                    held = []
                current = k
                held.append(b.slice(x, y - x))
        if held:
            yield unit(held)

    return work


class SimilarVectors:
    """Neighbours among the live vectors of ``vectors`` (tenant_id, index_name, space,
    id, embedding, generation, tombstone).

    ``members``: id, coll, same, rep (the smallest id with the same vector in the
    collection). ``edges``: rep_a < rep_b, cosine >= min_cosine."""

    def __init__(self, vectors: DataFrame, dim: int = 64, k: int = 10, min_cosine: float = 0.9, tables: int = 12, max_hamming: int | None = None, reach: int | None = None) -> None:
        self.k, self.dim, self.min_cosine, self.tables = k, dim, min_cosine, tables
        self.vectors = vectors.where(F.col("id").isNotNull()).select(
            F.col("id").cast("bigint").alias("id"),
            F.xxhash64("tenant_id", "index_name", F.coalesce("space", F.lit(""))).alias("coll"),
            "embedding",
            "generation",
            F.coalesce("tombstone", F.lit(False)).alias("tombstone"),
        )
        if reach is None:
            reach = reach_for(self.vectors.groupBy("coll").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
        bits = tables * 8 * (reach + 1)
        # Bits at which a pair with the least cosine would differ, and four deviations more.
        share = np.arccos(min_cosine) / np.pi
        most = max_hamming if max_hamming is not None else int(np.ceil(bits * share + 4 * np.sqrt(bits * share * (1 - share)) + 6))
        sample = self.vectors.where(F.size("embedding") == dim).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        _, rows = _unit(sample["embedding"].combine_chunks(), dim) if sample.num_rows else (None, np.zeros((0, dim)))
        rotations = learn_rotations(rows, bits)
        live = self._live(self.vectors).select("id", "coll", F.xxhash64("embedding").alias("same"), "embedding")
        codes = written(live.mapInArrow(_codes(rotations, dim), "id bigint, coll bigint, same bigint, words array<bigint>"), "codes")
        first = codes.groupBy("coll", "same").agg(F.min("id").alias("rep"))
        self.members = codes.select("id", "coll", "same").join(first, ["coll", "same"])
        entries = codes.join(first.select("coll", "same", F.col("rep").alias("id")), ["coll", "same", "id"], "left_semi")
        lead = F.ceil(F.log2(F.count(F.lit(1)) / CELL))
        sizes = first.groupBy("coll").agg(F.least(F.lit(8), F.greatest(F.lit(0), lead)).cast("int").alias("lead"))
        spread = entries.join(sizes, "coll").select("id", "coll", "words", "lead").mapInArrow(_spread(tables, reach), "cell bigint, id bigint, words array<bigint>, part int")
        hot = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > UNIT).select("cell", F.ceil(F.col("rows") / (UNIT // 2)).cast("int").alias("blocks"))
        hot = written(hot, "hot-cells")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        # Block i of a cell takes part in the units (i, i), (i, j) and (j, i): unit = low * blocks + high.
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct((F.least(block, j) * F.col("blocks") + F.greatest(block, j)).cast("int").alias("unit"), F.when(j == block, 0).when(block < j, 1).otherwise(2).alias("side")))
        units = (
            spread.join(hot, "cell", "left")
            .withColumn("u", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("unit"), F.lit(0).alias("side")))).otherwise(others)))
            .select("cell", "u.unit", "id", "words", "part", "u.side")
        )
        pairs = units.repartition("cell", "unit").sortWithinPartitions("cell", "unit").mapInArrow(_search(tables, reach, most), "id_a bigint, id_b bigint")
        self.candidates = written(pairs.distinct(), "candidates")
        wanted = id_filter(self.candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id")
        vectors_of = self._live(self.vectors.where(wanted("id"))).select("id", "embedding")
        a = vectors_of.select(F.col("id").alias("id_a"), F.col("embedding").alias("x"))
        b = vectors_of.select(F.col("id").alias("id_b"), F.col("embedding").alias("y"))
        ranked = self.candidates.join(a, "id_a").join(b, "id_b").mapInArrow(_cosines(dim), "rep_a bigint, rep_b bigint, cosine double")
        self.edges = written(ranked.where(F.col("cosine") >= min_cosine), "edges")

    def _live(self, rows: DataFrame) -> DataFrame:
        best = rows.groupBy("id").agg(F.max_by(F.struct("coll", "embedding", "tombstone"), F.struct("generation", F.xxhash64("coll", "embedding", "tombstone"))).alias("r"))
        return best.where(~F.col("r.tombstone") & (F.size("r.embedding") == self.dim)).select("id", "r.coll", "r.embedding")

    def neighbours(self) -> DataFrame:
        """(id, other, cosine, place): for each vector its at most ``k`` most similar with
        cosine >= min_cosine, place from 1."""
        members = written(self.members, "members")
        return self._placed(self._links(), members, members)

    def complete(self, wanted: Column | None = None) -> DataFrame:
        """(id, other, cosine, place): for each vector (``wanted``: a condition on ``id``) its
        ``k`` most similar, or all others of a smaller collection, whatever their cosine."""
        members = written(self.members, "members")
        mine = members if wanted is None else members.where(wanted)
        indexed = written(self._placed(self._links(), members, mine), "indexed")
        full = indexed.where(F.col("place") == self.k).select("id")
        short = mine.join(full, "id", "left_anti")
        scanned = self._scanned(members, short.select("rep").distinct())
        return indexed.join(full, "id", "left_semi").unionAll(self._placed(scanned, members, short))

    def _links(self) -> DataFrame:
        return self.edges.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("to"), "cosine").unionAll(self.edges.select("rep_b", "rep_a", "cosine"))

    def _placed(self, links: DataFrame, members: DataFrame, mine: DataFrame) -> DataFrame:
        """The best of ``links`` (rep, to, cosine) and of the own class for each of ``mine``."""
        k = self.k
        classes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        both = links.unionAll(classes.where("n > 1").select("rep", F.col("rep").alias("to"), F.lit(1.0).alias("cosine")))
        # Of a class, only its first k + 1 ids can be among the k of a vector.
        heads = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("other"))
        by = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
        best = both.join(heads, "to").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("rep", "other", "cosine")
        each = mine.select("rep", "id").join(best, "rep").where(F.col("id") != F.col("other"))
        own = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        return each.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).select("id", "other", "cosine", "place")

    def _scanned(self, members: DataFrame, reps: DataFrame) -> DataFrame:
        """(rep, to, cosine): of each block of its collection the k classes most similar to
        each of ``reps``."""
        asked = reps.select(F.col("rep").alias("id"), F.lit(True).alias("asked"))
        ids = members.where(F.col("id") == F.col("rep")).select("id", "coll").join(asked, "id", "left")
        ids = written(ids.select("coll", "id", F.coalesce("asked", F.lit(False)).alias("asks")), "classes")
        hits = blocks.hits_by_unit(ids, self._live(self.vectors), self.k, self.dim, digits=12)
        return written(hits.select(F.col("query").alias("rep"), F.col("id").alias("to"), F.col("score").alias("cosine")), "scanned")


def _cosines(dim: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _unit(b.column("x"), dim)
            _, y = _unit(b.column("y"), dim)
            yield pa.RecordBatch.from_arrays([b.column("id_a"), b.column("id_b"), pa.array((x * y).sum(1))], names=["rep_a", "rep_b", "cosine"])

    return work

"""Whether the beginning of one tenant's text stands anywhere in another tenant's.

Rolling hashes of the windows of a text are looked up in a filter of fixed size of
the heads' hashes; the windows that pass are joined with the heads as text, so what
is found is exact. A head may be shorter than ``size``: a window is first looked up
with the largest power of two of characters that its length holds, and with each
length only if that passes.

Defined results: case does not count; a head is taken from the text without blanks
around it and may not be empty; rows without tenant or text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.operators.text import stripped

#: Bits of the filter: 2 MB.
BITS = 24
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters hashed at once.
CHUNK = 1 << 19


class _Hashes:
    """Hashes of the windows of a row of characters; equal windows have equal ones."""

    def __init__(self, chars: np.ndarray) -> None:
        powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(chars), b, np.uint64))), dtype=np.uint64)
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * powers(BASE)[:-1], dtype=np.uint64)))
        self.back = powers(INVERSE)

    def slots(self, at: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.back[at] + np.uint64(length * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _prefix(length: int) -> int:
    return 1 << length.bit_length() - 1


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the filter for each head: of its prefix and of itself."""
    for b in batches:
        out = []
        for t in b.column(0).to_pylist():
            h, zero = _Hashes(_chars(t)), np.zeros(1, np.int64)
            out += [h.slots(zero, _prefix(len(t)))[0], h.slots(zero, len(t))[0]]
        slots = np.unique(np.array(out, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.uint64(1) << (slots & 63).astype(np.uint64)).view(pa.int64())], names=["word", "bits"])


def _found(text: str, lengths: list[int], holds) -> set[str]:
    out = set()
    longest = max(lengths, default=0)
    for first in range(0, len(text), CHUNK):
        part = text[first : first + CHUNK + longest]
        h = _Hashes(_chars(part))
        near: dict[int, np.ndarray] = {}
        for n in lengths:
            if n > len(part):
                continue
            p = _prefix(n)
            if p not in near:
                at = np.arange(len(part) - p + 1)
                near[p] = at[holds(h.slots(at, p))]
            at = near[p][near[p] + n <= len(part)]
            out.update(part[i : i + n] for i in at[holds(h.slots(at, n))].tolist())
    return out


def leaked_heads(texts: DataFrame, tenant: str, text: str, size: int = 80) -> DataFrame:
    """(tenant, head, leaked) for each distinct head of each tenant: the first ``size``
    characters of a text of it; leaked if a text of another tenant contains them."""
    rows = texts.select(F.col(tenant).alias("tenant"), F.lower(text).alias("text")).where("tenant IS NOT NULL AND text IS NOT NULL")
    heads = rows.select("tenant", F.substring(stripped(F.col("text")), 1, size).alias("head")).where("head <> ''").distinct()
    words = heads.select("head").distinct().mapInArrow(_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    lengths = sorted(r["n"] for r in heads.select(F.length("head").alias("n")).distinct().collect())
    filled = np.zeros(1 << BITS - 6, np.int64)
    filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        holds = lambda s: (table[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
        for b in batches:
            pairs = {(o, w) for o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in _found(t, lengths, holds)}
            owners, windows = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(windows, pa.string())], names=["owner", "head"])

    windows = rows.mapInArrow(work, "owner string, head string")
    held = windows.groupBy("head").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    other = (F.col("least") != F.col("tenant")) | (F.col("most") != F.col("tenant"))
    return heads.join(held, "head").select("tenant", "head", other.alias("leaked"))

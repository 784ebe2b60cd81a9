"""The engine as clients use it: a tenant's memory, and the vector command language.

``Memory`` holds named DataFrames and gives DataFrames; nothing is computed until a
result is asked for. Isolation is a filter on ``tenant_id`` in every plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.operators import ivf, keyspace, vectors
from memquarry.operators.change_store import DELETE, SET, VADD, VTOMBSTONE, ChangeStore, merge
from memquarry.operators.text import embed_text
from memquarry.plans.scratch import written

CHANGE = "tenant_id string, seq bigint, effect_no int, ts_ns bigint, type int, key string, space string, id string, value string, vector array<float>, expires_at bigint"
MAX_ID, MAX_DIM, MAX_BATCH = 512, 4096, 1000


def check_vector(id_: str, vector: list[float]) -> None:
    """The limits of a vector: id of 1..512 bytes, 1..4096 finite numbers."""
    if not 1 <= len(id_.encode()) <= MAX_ID:
        raise ValueError("vector id must have 1 to 512 bytes")
    if not 1 <= len(vector) <= MAX_DIM or not all(math.isfinite(x) for x in vector):
        raise ValueError("a vector has 1 to 4096 finite numbers")


@dataclass
class Memory:
    """One tenant's view of a change store."""

    store: ChangeStore
    tenant: str
    now_ns: int = 0
    next_seq: int = 1
    _waiting: list[tuple] = field(default_factory=list)
    _states: dict[tuple, DataFrame] = field(default_factory=dict)
    _cells: dict[tuple[str, str], ivf.CellIndex] = field(default_factory=dict)

    # Writes collect until ``commit``, which appends them as one run: one frame each.
    def _effect(self, kind: int, key: str, space: str | None = None, id_: str | None = None, value: str | None = None, vector: list[float] | None = None, expires_at: int = 0) -> None:
        self._waiting.append((self.tenant, self.next_seq, 0, self.now_ns, kind, key, space, id_, value, vector, expires_at))
        self.next_seq += 1

    def set(self, key: str, value: str, ttl_ns: int = 0) -> None:
        self._effect(SET, key, value=value, expires_at=self.now_ns + ttl_ns if ttl_ns else 0)

    def delete(self, key: str) -> None:
        self._effect(DELETE, key)

    def remember(self, index: str, id_: str, text: str | None = None, vector: list[float] | None = None, space: str = "") -> None:
        """A vector (of the text, if none is given) and its text beside it."""
        v = vector if vector is not None else embed_text(text or "")
        check_vector(id_, v)
        self._effect(VADD, index, space, id_, vector=[float(x) for x in v])
        if text is not None:
            self.set(f"doc:{index}:{id_}", text)

    def remember_all(self, index: str, rows: list[tuple[str, list[float]]], space: str = "") -> None:
        """All or nothing; of repeated ids the last holds."""
        if len(rows) > MAX_BATCH:
            raise ValueError(f"at most {MAX_BATCH} vectors")
        if len({len(v) for _, v in rows}) > 1:
            raise ValueError("the vectors differ in dimension")
        for i, v in rows:
            check_vector(i, v)
        for i, v in rows:
            self._effect(VADD, index, space, i, vector=[float(x) for x in v])

    def forget(self, index: str, id_: str, space: str = "") -> None:
        self._effect(VTOMBSTONE, index, space, id_)
        self.delete(f"doc:{index}:{id_}")

    def commit(self) -> None:
        if self._waiting:
            self.store.append(self.store.spark.createDataFrame(self._waiting, CHANGE))
            self._waiting = []
            self._states.clear()
            self._cells.clear()

    # Reads
    def state(self, as_of_ns: int | None = None) -> DataFrame:
        """The tenant's state, folded once per commit and time and read from then on."""
        self.commit()
        at = (self.now_ns, as_of_ns)
        if at not in self._states:
            log = self.store.changes().where(F.col("tenant_id") == self.tenant)
            if as_of_ns is not None:
                log = log.where(F.col("ts_ns") <= as_of_ns)
            self._states[at] = written(merge(log, self.now_ns, payload=True).withColumn("row", F.monotonically_increasing_id()), "state")
        return self._states[at]

    def keys(self, pattern: str = "*") -> DataFrame:
        return keyspace.matching(self.state().where("vector IS NULL"), pattern).select("key", "value", "expires_at")

    def get(self, *keys: str) -> DataFrame:
        return keyspace.mget(self.state().where("vector IS NULL"), list(keys))

    def index(self, name: str, space: str = "", as_of_ns: int | None = None) -> DataFrame:
        rows = self.state(as_of_ns).where((F.col("key") == name) & (F.col("space") == space) & F.col("vector").isNotNull())
        return rows.select("id", F.col("vector").alias("embedding"), "row")

    def build_index(self, name: str, dim: int, space: str = "", cells: int | None = None) -> ivf.CellIndex:
        """An index of cells over an index's vectors; searches with EF look into that many of
        its cells until the next commit."""
        rows = self.index(name, space).select(F.col("row").alias("id"), "embedding")
        self._cells[name, space] = ivf.CellIndex.build(rows, dim, cells)
        return self._cells[name, space]

    def documents(self, prefix: str) -> DataFrame:
        docs = self.state().where(F.startswith("key", F.lit(prefix + ":")) & F.col("vector").isNull())
        return docs.select(F.substring("key", len(prefix) + 2, 1 << 30).alias("id"), F.col("value").alias("doc"))

    def _search(self, rows: DataFrame, query: list[float], k: int, min_score: float | None, leave_out: str | None = None, probed: tuple[str, str, int] | None = None) -> DataFrame:
        """Ids are text here: the kernel sees the number of the row in the stored state."""
        cells = self._cells.get(probed[:2]) if probed else None
        if cells is not None:
            hits = cells.search([(-1, query)], k + (leave_out is not None), probed[2], min_score)
        else:
            kept = rows if leave_out is None else rows.where(F.col("id") != leave_out)
            hits = vectors.search(kept.select(F.col("row").alias("id"), "embedding"), [(-1, query)], k, min_score)
        named = hits.withColumnRenamed("id", "row").join(rows.select("row", F.col("id").alias("name")), "row")
        if leave_out is not None:
            named = named.where(F.col("name") != leave_out)
        return named.select(F.col("name").alias("id"), "score").orderBy(F.desc("score"), "id").limit(k)

    def recall(self, index: str, query: str | list[float], k: int = 4, min_score: float | None = None, contains: str | None = None, space: str = "", with_docs: str | None = None, as_of_ns: int | None = None, ef: int | None = None) -> DataFrame:
        q = embed_text(query) if isinstance(query, str) else query
        rows = self.index(index, space, as_of_ns)
        if contains is not None:
            rows = vectors.containing(rows, self.documents(f"doc:{index}"), contains)
        # A filter or another time is not what the cells were made for: those searches are exact.
        probed = (index, space, ef) if ef and contains is None and as_of_ns is None else None
        hits = self._search(rows, q, k, min_score, probed=probed)
        return hits if with_docs is None else vectors.with_documents(hits, self.documents(with_docs)).orderBy(F.desc("score"), "id")

    def similar(self, index: str, id_: str, k: int = 4, min_score: float | None = None, space: str = "", ef: int | None = None) -> DataFrame:
        rows = self.index(index, space)
        found = rows.where(F.col("id") == id_).first()
        if found is None:
            raise KeyError(f"vector id not found: {id_}")
        return self._search(rows, found["embedding"], k, min_score, leave_out=id_, probed=(index, space, ef) if ef else None)

    def fuse(self, index: str, queries: dict[str, list[float]], k: int = 4, weights: list[float] | None = None, min_score: float | None = None) -> DataFrame:
        w = weights or [1.0] * len(queries)
        if len(queries) < 2 or len(w) != len(queries) or any(not math.isfinite(x) or x < 0 for x in w) or sum(w) <= 0:
            raise ValueError("a fusion needs two spaces and as many weights >= 0, not all 0")
        hits = None
        for (space, q), x in zip(queries.items(), w):
            part = self._search(self.index(index, space), q, vectors.clamp_fetch(k), None).withColumn("score", F.col("score") * (x / sum(w)))
            hits = part if hits is None else hits.unionAll(part)
        fused = hits.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))
        if min_score is not None:
            fused = fused.where(F.col("score") >= min_score)
        return fused.orderBy(F.desc("score"), "id").limit(k)

    def run(self, command: str | list[str]) -> DataFrame:
        """A search command: VSEARCH index f… k, VSIM index id k, VFUSE index (SPACE s f…)… k,
        each with flags in any order behind (WITHDOCS p, FILTER_CONTAINS s, MIN_SCORE x,
        EF n, SPACE s, AS_OF ns; WEIGHTS w,… for VFUSE). EF is the number of cells to look
        into where ``build_index`` has made them; other searches are exact. AS_OF holds for
        VSEARCH only, as other commands ignore it."""
        words = command.split() if isinstance(command, str) else list(command)
        name = words[0].upper() if words else ""
        if name not in ("VSEARCH", "VSIM", "VFUSE"):
            raise ValueError(f"unknown command: {name or 'none'}")
        index, rest = words[1], words[2:]
        names = {"WITHDOCS", "FILTER_CONTAINS", "MIN_SCORE", "EF", "AS_OF", "WEIGHTS"} | ({"SPACE"} if name != "VFUSE" else set())
        flags: dict[str, str] = {}
        while len(rest) >= 2 and rest[-2].upper() in names:
            flags[rest[-2].upper()] = rest[-1]
            rest = rest[:-2]
        if name != "VFUSE" and "WEIGHTS" in flags:
            raise ValueError("WEIGHTS needs VFUSE")
        if "EF" in flags and int(flags["EF"]) < 1 or "AS_OF" in flags and int(flags["AS_OF"]) <= 0:
            raise ValueError("EF and AS_OF must be positive")
        k, least = int(rest[-1]), float(flags["MIN_SCORE"]) if "MIN_SCORE" in flags else None
        space, ef = flags.get("SPACE", ""), int(flags["EF"]) if "EF" in flags else None
        if name == "VSIM":
            out = self.similar(index, rest[0], k, least, space, ef)
        elif name == "VSEARCH":
            return self.recall(index, [float(x) for x in rest[:-1]], k, least, flags.get("FILTER_CONTAINS"), space, flags.get("WITHDOCS"), int(flags["AS_OF"]) if "AS_OF" in flags else None, ef)
        else:
            queries: dict[str, list[float]] = {}
            current: str | None = None
            if rest[:1] and rest[0].upper() != "SPACE":
                raise ValueError("VFUSE begins with SPACE")
            for w in rest[:-1]:
                if w.upper() == "SPACE":
                    current = None
                elif current is None:
                    current = w
                    if current in queries:
                        raise ValueError(f"space given twice: {current}")
                    queries[current] = []
                else:
                    queries[current].append(float(w))
            out = self.fuse(index, queries, k, [float(x) for x in flags["WEIGHTS"].split(",")] if "WEIGHTS" in flags else None, least)
        return vectors.with_documents(out, self.documents(flags["WITHDOCS"])).orderBy(F.desc("score"), "id") if "WITHDOCS" in flags else out

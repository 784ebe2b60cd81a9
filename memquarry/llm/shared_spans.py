"""Spans of at least ``min_chars`` characters that stand verbatim in several records.

Windows are hashed only at *cover positions*: those whose remainder modulo a
period lies in a difference cover. For any two positions there is a shift below
the period that brings both to cover positions, so two records that share a span
of ``period + window - 1`` characters share a hashed window within it. Records
that share one are candidates; from each shared window the match is extended to
windows of the full length, at every position around it, in both texts.

The cover is a perfect difference set (a line of the projective plane over a prime
field): q + 1 of q*q + q + 1 remainders, the fewest possible.

A passage may stand in very many texts. Pairs are not made from an anchor that more
than ``HOT`` texts share; instead, the windows of the full length around it are hashed,
which is linear in the texts. What a record shares is told from these windows and from
the pairs of the other anchors, at most ``HOT`` for each, so its cost does not grow with
the square of a group. Only where all pairs are asked for do shared windows make pairs
too; windows with the same set of texts count once.

Records with the same text are one class: a task lists the windows of a text once,
and lists are reduced to classes before pairs are made. Pairs are between classes;
they are expanded to records only where all pairs are asked for.

Defined results: null texts and texts shorter than ``min_chars`` share nothing;
characters are code points, nothing is trimmed; rows with null id are left out;
repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm import textops
from memquarry.plans.bloom import id_filter
from memquarry.plans.scratch import written

MAX_KINDS = 16
#: Texts that may share one anchor before its pairs are made from whole spans.
HOT = 256


@lru_cache(maxsize=None)
def difference_set(q: int) -> tuple[int, ...]:
    """A perfect difference set modulo q*q + q + 1, for a prime q (Singer's construction):
    the powers of a generator of the field with q**3 elements that lie in a plane."""
    v = q * q + q + 1
    for code in range(q**3):
        c = (code % q, code // q % q, code // q // q)  # x**3 = c0 + c1 x + c2 x**2
        p, line = (1, 0, 0), [0]
        for i in range(1, v + 1):
            top = p[2]
            p = (top * c[0] % q, (p[0] + top * c[1]) % q, (p[1] + top * c[2]) % q)
            if p[1] == 0 and p[2] == 0:
                break
            if p[2] == 0:
                line.append(i)
        if i == v and len(line) == q + 1 and len({(a - b) % v for a in line for b in line}) == v:
            return tuple(line)
    raise ValueError(f"{q} is not a prime")


def plan(min_chars: int) -> tuple[int, int]:
    """The prime q and the window length for spans of ``min_chars``: the period takes
    up to three fifths of it, so that windows stay long enough to be rare."""
    primes = [p for p in range(2, 200) if all(p % d for d in range(2, p)) and p * p + p + 1 <= 0.62 * min_chars]
    if not primes:
        raise ValueError("spans of at least 12 characters are needed")
    q = primes[-1]
    return q, min_chars - (q * q + q + 1) + 1


class _Cover:
    """Cover positions in ascending order, as far as they have been needed."""

    def __init__(self, q: int) -> None:
        self.period = q * q + q + 1
        self.line = np.sort(np.array(difference_set(q), np.int64))
        self.positions = np.zeros(0, np.int64)

    def upto(self, length: int) -> np.ndarray:
        if not len(self.positions) or self.positions[-1] < length:
            blocks = np.arange(2 * length // self.period + 2, dtype=np.int64) * self.period
            self.positions = (blocks[:, None] + self.line).ravel()
        return self.positions


def _anchors(p: np.ndarray, off: np.ndarray, cover: _Cover, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts at ``off`` in one array with prefix hashes ``p``: text number,
    start (in the array) and hash of each anchor."""
    room = np.diff(off) - window
    places = cover.upto(int(room.max(initial=0)) + 1)
    counts = np.where(room >= 0, np.searchsorted(places, room, side="right"), 0)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = places[np.arange(len(doc)) - np.repeat(ends - counts, counts)] + off[doc]
    return doc, start, textops.span_hashes(p, start, start + window)


def _list_anchors(min_chars: int):
    q, window = plan(min_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, routes = _Cover(q), textops.Routes()
        seen: set[tuple[int, int]] = set()
        for b in batches:
            kinds, ids, hashes, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3)
            fresh = []
            for i, key in enumerate(zip(kinds.tolist(), hashes)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            texts = texts.take(pa.array(fresh, pa.int32())).to_pylist()
            kinds, ids = kinds[fresh].astype(np.uint64), ids[fresh]
            for x, y in textops.batches(texts):
                cp, off = textops.codepoints(texts[x:y])
                doc, _, h = _anchors(textops.prefix_hashes(cp), off, cover, window)
                h = h & np.uint64(0xFFFFFFFFFFFFFFFF - MAX_KINDS + 1) | kinds[x:y][doc]
                own = ids[x:y][doc]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own), pa.array(routes.of(h, own))], names=["anchor", "id", "route"])

    return work


def _windows_around(min_chars: int):
    """(window, id, start) of all windows of the full length around the given anchors of each text."""
    q, window = plan(min_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = _Cover(q)
        for b in batches:
            for kind, rep, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                cp, off = textops.codepoints([text])
                p = textops.prefix_hashes(cp)
                _, start, h = _anchors(p, off, cover, window)
                h = h & np.uint64(0xFFFFFFFFFFFFFFFF - MAX_KINDS + 1) | np.uint64(kind)
                s = _starts_around(start[np.isin(h, np.array(wanted, np.int64).view(np.uint64))], len(text), min_chars, window)
                w = textops.span_hashes(p, s, s + min_chars) & np.uint64(0xFFFFFFFFFFFFFFFF - MAX_KINDS + 1) | np.uint64(kind)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), rep)), pa.array(s)], names=["anchor", "id", "start"])

    return work


def _starts_around(at: np.ndarray, size: int, min_chars: int, window: int) -> np.ndarray:
    """Starts of the windows of the full length that hold an anchor at one of the places."""
    n = size - min_chars + 1
    if n <= 0 or not len(at):
        return np.zeros(0, np.int64)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.minimum(np.maximum(at - (min_chars - window), 0), n), 1)
    np.add.at(mark, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(mark[:n]) > 0)


def shared_windows(a: str, b: str, min_chars: int, cover: _Cover, window: int, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The starts in ``a`` and in ``b`` of windows of ``min_chars`` that the other has too."""

    def read(t: str):
        if cache is not None and t in cache:
            return cache[t]
        cp, off = textops.codepoints([t])
        p = textops.prefix_hashes(cp)
        _, start, h = _anchors(p, off, cover, window)
        got = (p, start, h, np.unique(h))
        if cache is not None:
            cache[t] = got
        return got

    none = np.zeros(0, np.int64)
    ra, rb = read(a), read(b)
    common = np.intersect1d(ra[3], rb[3], assume_unique=True)
    if not len(common):
        return none, none

    def around(r) -> tuple[np.ndarray, np.ndarray]:
        p, start, h, _ = r
        s = _starts_around(start[np.isin(h, common)], len(p) - 1, min_chars, window)
        return s, textops.span_hashes(p, s, s + min_chars)

    (sa, ha), (sb, hb) = around(ra), around(rb)
    same = np.intersect1d(ha, hb)
    if not len(same):
        return none, none
    return sa[np.isin(ha, same)], sb[np.isin(hb, same)]


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows of one length joined where they overlap or touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + length).tolist()))


def _extend(min_chars: int):
    q, window = plan(min_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = _Cover(q)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        for batch in batches:
            cache: dict = {}
            size, keep, left, right = 0, [], [], []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if size > 1 << 21:
                    cache.clear()
                    size = 0
                size += len(a) + len(b)
                sa, sb = shared_windows(a, b, min_chars, cover, window, cache)
                keep.append(bool(len(sa)))
                left.append([{"first": x, "past": y} for x, y in spans(sa, min_chars)])
                right.append([{"first": x, "past": y} for x, y in spans(sb, min_chars)])
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id_a"), batch.column("id_b"), pa.array(left, kind), pa.array(right, kind)], names=["kind", "id_a", "id_b", "spans_a", "spans_b"]).filter(pa.array(keep, pa.bool_()))

    return work


class SharedSpans:
    """Shared spans among the records of each of several tables.

    ``tables`` maps a kind to (rows, id column, text column, column of the group or
    None): records of one group are not compared with each other. ``members`` has a
    row per record that is long enough: kind, id, grp, size (characters), rep (smallest
    id with the same text)."""

    def __init__(self, tables: dict[str, tuple[DataFrame, str, str, str | None]], min_chars: int = 300) -> None:
        if len(tables) > MAX_KINDS:
            raise ValueError(f"at most {MAX_KINDS} kinds")
        self.kinds = list(tables)
        self.min_chars = min_chars
        records = None
        for i, (df, id_col, text_col, group) in enumerate(tables.values()):
            part = df.select(
                F.lit(i).cast("bigint").alias("kind"),
                F.col(id_col).cast("bigint").alias("id"),
                (F.col(group) if group else F.col(id_col)).cast("string").alias("grp"),
                F.col(text_col).alias("text"),
            ).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
            records = part if records is None else records.unionAll(part)
        self.records = records
        text_id = F.xxhash64("text", F.length("text"))
        ids = records.select("kind", "id", "grp", F.length("text").alias("size"), text_id.alias("text_id")).distinct()
        first = ids.groupBy("kind", "text_id").agg(F.min("id").alias("rep"))
        self.members = written(ids.join(first, ["kind", "text_id"]).select("kind", "id", "grp", "size", "rep"), "members")
        anchors = records.select("kind", "id", text_id.alias("text_id"), "text").mapInArrow(_list_anchors(min_chars), "anchor bigint, id bigint, route int")
        w = Window.partitionBy("anchor", "route")
        shared = anchors.withColumns({"low": F.min("id").over(w), "high": F.max("id").over(w)}).where("route > 0 OR low < high").select("anchor", "id")
        kind_of = F.col("anchor").bitwiseAND(MAX_KINDS - 1)
        reps = self.members.select("kind", "id", "rep").distinct()
        self.lists = written(shared.withColumn("kind", kind_of).join(reps, ["kind", "id"]).select("anchor", "kind", "rep").distinct(), "anchors")
        groups = self.members.groupBy("kind", "rep").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"))
        self.groups = groups
        self.hot = self.lists.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor")
        hot_of = written(self.lists.join(self.hot, "anchor", "left_semi").groupBy("kind", "rep").agg(F.collect_list("anchor").alias("anchors")), "hot")
        texts_of_hot = records.where(id_filter(hot_of, "rep")("id")).select("kind", F.col("id").alias("rep"), "text")
        around = texts_of_hot.join(hot_of, ["kind", "rep"]).select("kind", "rep", "text", "anchors").mapInArrow(_windows_around(min_chars), "anchor bigint, rep bigint, start bigint")
        around = around.withColumn("kind", kind_of).dropDuplicates(["anchor", "kind", "rep", "start"]).join(groups, ["kind", "rep"])
        # A window counts if texts of two groups have it.
        around = written(around, "windows")
        none = lambda c: F.coalesce(c, F.lit(""))
        several = around.groupBy("anchor").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1"), F.min(none("g0")).alias("m0"), F.max(none("g1")).alias("m1")).where("r0 < r1 AND m0 < m1").select("anchor")
        self.windows = around.join(several, "anchor", "left_semi").select("anchor", "kind", "rep", "start")
        self._close: DataFrame | None = None

    def _verified(self, keyed: DataFrame) -> DataFrame:
        """(kind, id_a < id_b, spans_a, spans_b): the pairs of classes that share a key and,
        in fact, a span."""
        a, b = keyed.select("anchor", "kind", F.col("rep").alias("id_a")), keyed.select("anchor", F.col("rep").alias("id_b"))
        pairs = a.join(b, "anchor").where("id_a < id_b").select("kind", "id_a", "id_b").distinct()
        ga = self.groups.select("kind", F.col("rep").alias("id_a"), F.col("g0").alias("a0"), F.col("g1").alias("a1"))
        gb = self.groups.select("kind", F.col("rep").alias("id_b"), F.col("g0").alias("b0"), F.col("g1").alias("b1"))
        one_group = F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1")) & F.col("a0").eqNullSafe(F.col("b0"))
        candidates = written(pairs.join(ga, ["kind", "id_a"]).join(gb, ["kind", "id_b"]).where(~one_group).select("kind", "id_a", "id_b"), "candidates")
        wanted = id_filter(candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id")
        texts = self.records.select("kind", "id", "text").where(wanted("id"))
        # A record may be delivered twice: one row of each is enough.
        left = candidates.join(texts.select("kind", F.col("id").alias("id_a"), F.col("text").alias("text_a")), ["kind", "id_a"])
        both = left.join(texts.select("kind", F.col("id").alias("id_b"), F.col("text").alias("text_b")), ["kind", "id_b"])
        span = "array<struct<first bigint, past bigint>>"
        found = both.select("kind", "id_a", "id_b", "text_a", "text_b").mapInArrow(_extend(self.min_chars), f"kind bigint, id_a bigint, id_b bigint, spans_a {span}, spans_b {span}")
        return written(found.dropDuplicates(["kind", "id_a", "id_b"]), "links")

    @property
    def close(self) -> DataFrame:
        """The pairs of classes that share an anchor of at most ``HOT`` texts and a span."""
        if self._close is None:
            self._close = self._verified(self.lists.join(self.hot, "anchor", "left_anti"))
        return self._close

    def links(self) -> DataFrame:
        """All pairs of classes that share a span: kind, id_a < id_b (representatives)."""
        whole = self.windows.select("anchor", "kind", "rep").distinct()
        member = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "rep"))
        once = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), member(1).alias("x"), member(2).alias("y")).groupBy("n", "x", "y").agg(F.min("anchor").alias("anchor")).select("anchor")
        keyed = self.lists.join(self.hot, "anchor", "left_anti").select("anchor", "kind", "rep").unionAll(whole.join(once, "anchor", "left_semi").select("anchor", "kind", "rep"))
        return self._verified(keyed).select("kind", "id_a", "id_b")

    def _named(self):
        return F.element_at(F.array(*[F.lit(k) for k in self.kinds]), F.col("kind").cast("int") + 1).alias("kind")

    def pairs(self) -> DataFrame:
        """All pairs of records of different groups, copies included: kind, id_a < id_b."""
        a = self.members.select("kind", F.col("rep").alias("id_a"), F.col("id").alias("x"), F.col("grp").alias("gx"))
        b = self.members.select("kind", F.col("rep").alias("id_b"), F.col("id").alias("y"), F.col("grp").alias("gy"))
        apart = ~F.col("gx").eqNullSafe(F.col("gy"))
        linked = self.links().join(a, ["kind", "id_a"]).join(b, ["kind", "id_b"]).where(apart)
        copied = self.members.groupBy("kind", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "rep")
        again = self.members.join(copied, ["kind", "rep"])
        same = again.select("kind", "rep", F.col("id").alias("x"), F.col("grp").alias("gx")).join(again.select("kind", "rep", F.col("id").alias("y"), F.col("grp").alias("gy")), ["kind", "rep"]).where(apart & (F.col("x") < F.col("y")))
        every = linked.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionAll(same.select("kind", "x", "y"))
        return every.where("id_a < id_b").distinct().select(self._named(), "id_a", "id_b")

    def _copies(self) -> DataFrame:
        """members with ``n_copies``: other records with the same text, of another group."""
        sizes = self.members.groupBy("kind", "rep").agg(F.count(F.lit(1)).alias("n"))
        in_group = self.members.groupBy("kind", "rep", "grp").agg(F.count(F.lit(1)).alias("n_grp")).select(F.col("kind").alias("k"), F.col("rep").alias("r"), F.col("grp").alias("g"), "n_grp")
        same_group = (F.col("kind") == F.col("k")) & (F.col("rep") == F.col("r")) & F.col("grp").eqNullSafe(F.col("g"))
        return self.members.join(sizes, ["kind", "rep"]).join(in_group, same_group).select("kind", "rep", "id", "size", (F.col("n") - F.col("n_grp")).alias("n_copies"))

    def _islands(self) -> DataFrame:
        """(kind, rep, first, past): the stretches of each class that stand in other texts."""
        span = lambda side, rep: self.close.select("kind", F.col(rep).alias("rep"), F.explode(side).alias("s")).select("kind", "rep", "s.first", "s.past")
        parts = span("spans_a", "id_a").unionAll(span("spans_b", "id_b"))
        parts = parts.unionAll(self.windows.select("kind", "rep", F.col("start").alias("first"), (F.col("start") + self.min_chars).alias("past"))).distinct()
        by = Window.partitionBy("kind", "rep").orderBy("first", "past")
        fresh = F.col("first") > F.coalesce(F.max("past").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
        numbered = parts.withColumn("new", fresh.cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy("kind", "rep", "island").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("island")

    def spans_by_record(self) -> DataFrame:
        """(kind, id, first, past): the stretches of each record's text that occur in other
        records, from 0, ``past`` excluded; the whole text of a record that has copies in
        another group."""
        out = self._copies()
        apart = out.where("n_copies = 0").join(self._islands(), ["kind", "rep"]).select("kind", "id", "first", "past")
        whole = out.where("n_copies > 0").select("kind", "id", F.lit(0).cast("bigint").alias("first"), F.col("size").cast("bigint").alias("past"))
        return apart.unionAll(whole).distinct().select(self._named(), "id", "first", "past")

    def shared_by_record(self) -> DataFrame:
        """Per record that is long enough: kind, id, n_copies, shared_chars and n_spans
        (characters of its text that occur in other records, and how many stretches they
        form; a record with copies in another group is shared whole)."""
        n = self._islands().groupBy("kind", "rep").agg(F.sum(F.col("past") - F.col("first")).alias("chars"), F.count(F.lit(1)).alias("spans"))
        out = self._copies().join(n, ["kind", "rep"], "left")
        of = lambda whole, part, name: F.when(F.col("n_copies") > 0, whole).otherwise(F.coalesce(part, F.lit(0))).cast("bigint").alias(name)
        return out.select(self._named(), "id", F.col("n_copies").cast("bigint").alias("n_copies"), of(F.col("size"), F.col("chars"), "shared_chars"), of(F.lit(1), F.col("spans"), "n_spans")).distinct()

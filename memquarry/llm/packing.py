"""Items of varying size combined into containers of fixed capacity.

Bounded-space online packing: each task keeps ``open_bins`` containers open, puts
an item into the fullest one that has room (best fit), and closes the fullest when
none has room. What is still open at a task's end is merged in a second round, in
which an open container is itself an item. The second round is divided so that no
task gets more than ``merge_items`` of them; with more tasks than one, each leaves
at most ``open_bins`` containers that might have been merged further.

An item is cut only if it exceeds the capacity by itself: into full parts and a
rest, and only the rest shares a container.

Defined results: items with null or zero size are left out (nothing to place);
negative sizes are an error; every other item is placed exactly once, repeated
rows as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.plans.scratch import written

OPEN_BINS = 64
MERGE_ITEMS = 1 << 16


class BoundedPacker:
    """Best fit over a bounded number of open bins, numbered in the order they were opened."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.rooms: list[tuple[int, int]] = []  # (room, bin), ascending

    def place(self, size: int) -> int:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.open_bins:
                self.rooms.pop(0)
            room, number = self.capacity, self.next
            self.next += 1
        if room > size:
            insort(self.rooms, (room - size, number))
        return number


def _first_round(capacity: int, open_bins: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BoundedPacker(capacity, open_bins, TaskContext.get().partitionId() << 32)
        held: list[tuple] = []
        names = ["item", "part", "size", "bin", "closed"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            rows = []
            for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not size:
                    continue
                if size < 0:
                    raise ValueError(f"item {item} has size {size}")
                part = 0
                while size > capacity:
                    rows.append((item, part, capacity, packer.next, True))
                    packer.next += 1
                    size -= capacity
                    part += 1
                held.append((item, part, size, packer.place(size)))
            still = {number for _, number in packer.rooms}
            rows += [(*h, True) for h in held if h[3] not in still]
            held = [h for h in held if h[3] in still]
            yield out(rows)
        yield out([(*h, False) for h in held])

    return work


def _merge_round(capacity: int, open_bins: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = [(s, b) for batch in batches for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        packer = BoundedPacker(capacity, max(open_bins, len(bins)))
        into: dict[int, int] = {}
        left, right = [], []
        for size, b in sorted(bins, key=lambda x: (-x[0], x[1])):
            right.append(into.setdefault(packer.place(size), b))
            left.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["bin", "container"])

    return work


def pack(items: DataFrame, item_col: str, size_col: str, capacity: int, open_bins: int = OPEN_BINS, merge_items: int = MERGE_ITEMS) -> DataFrame:
    """(item, part, size, container) for every item of positive size."""
    sized = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(size_col).cast("bigint").alias("size"))
    placed = written(sized.mapInArrow(_first_round(capacity, open_bins), "item bigint, part int, size bigint, bin bigint, closed boolean"), "bins")
    left = placed.where(~F.col("closed")).groupBy("bin").agg(F.sum("size").alias("size"))
    tasks = -(-max(left.count(), 1) // merge_items)
    merged = written(left.repartition(tasks, F.col("bin")).mapInArrow(_merge_round(capacity, open_bins), "bin bigint, container bigint"), "merged")
    done = placed.where("closed").select("item", "part", "size", F.col("bin").alias("container"))
    return done.unionAll(placed.where(~F.col("closed")).join(merged, "bin").select("item", "part", "size", "container"))


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, n_items, used, unused) of a packing."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity).cast("bigint") - F.col("used"))

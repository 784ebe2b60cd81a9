"""Sources mixed to target shares of the total size.

Each source has a mean number of uses per document: its share of the wanted total
over its own size, at most ``max_repeats``. How often a document is used is drawn
from a Poisson distribution by inverting it at a number hashed from seed and
document, cut off at ``max_repeats``; the rate is solved so that the mean after
the cut is the wanted one. The draw is the same in any order and on any number of
executors, nothing is counted across documents but the sources' sizes, and
documents are multiplied by their count and put in an order hashed from seed,
document and copy.

A source that cannot fill its share gives all it may; the others keep theirs, and
the report has the shares really reached.

Defined results: documents of unlisted or null sources, and of null or no size,
are not used; listed sources without text contribute nothing and are reported; a
target without share or with max_repeats < 1 contributes nothing; of several
targets for one source the one with the largest share, then repeats, holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate at which min(count, cap) has the given mean."""
    if mean >= cap:
        return math.inf

    def expected(rate: float) -> float:
        p, below, total = math.exp(-rate), 0.0, 0.0
        for j in range(cap):
            below += p
            total += 1 - below
            p *= rate / (j + 1)
        return total

    low, high = 0.0, 1.0
    while expected(high) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < mean else (low, mid)
    return high


def thresholds(mean: float, cap: int) -> list[float]:
    """For a uniform u, the count is the number of thresholds that u reaches."""
    rate = rate_for(mean, cap)
    if math.isinf(rate):
        return [0.0] * cap
    out, p, below = [], math.exp(-rate), 0.0
    for j in range(cap):
        below += p
        out.append(min(below, 1.0))
        p *= rate / (j + 1)
    return out


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target: source, target_share, max_repeats, available (size of its documents),
    mean_uses and the draw's thresholds. ``total`` defaults to the size of all
    documents of the targets' sources."""
    best = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats"))).alias("t")).select("source", "t.*")
    sizes = docs.where(F.col("size") > 0).groupBy("source").agg(F.sum("size").alias("available"))
    known = best.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    wanted = F.lit(float(total)) if total is not None else F.col("sum_available")
    sums = known.agg(F.sum("available").cast("double").alias("sum_available"))

    def draw(parts):
        for p in parts:
            p["thresholds"] = [thresholds(m, max(int(c), 0)) if m > 0 and c > 0 else [] for m, c in zip(p["mean_uses"], p["max_repeats"])]
            yield p

    planned = known.crossJoin(sums).withColumn(
        "mean_uses", F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.least(F.col("max_repeats").cast("double"), F.col("target_share") * wanted / F.col("available"))).otherwise(0.0)
    )
    return planned.select("source", "target_share", "max_repeats", "available", "mean_uses").mapInPandas(draw, "source string, target_share double, max_repeats int, available bigint, mean_uses double, thresholds array<double>")


def mix(docs: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """Every use of a document: all columns of ``docs`` (source, doc_id, size and others),
    copy_no from 0 and place, the key of the global order; ordered by place."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    counted = docs.where(F.col("size") > 0).join(planned.select("source", F.col("thresholds").alias("_thresholds")), "source")
    uses = F.size(F.filter("_thresholds", lambda t: t <= F.col("_u")))
    copies = counted.withColumn("_u", u).withColumn("_n", uses).where("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_u", "_n", "_thresholds")
    return copies.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")).orderBy("place", "doc_id", "copy_no")


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target: source, target_share, actual_share, size used, documents used, uses,
    most uses of one document, whether the source ran short."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"))
    used = per_doc.groupBy("source").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_uses"), F.max("k").alias("most_uses"))
    joined = planned.drop("thresholds").join(used, "source", "left")
    total = used.agg(F.sum("used").alias("sum_used"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.crossJoin(total).select(
        "source",
        "target_share",
        F.coalesce(F.col("used") / F.col("sum_used"), F.lit(0.0)).alias("actual_share"),
        *[zero(c) for c in ("used", "n_docs", "n_uses", "most_uses", "available")],
        "max_repeats",
        "mean_uses",
        ((F.col("target_share") > 0) & (F.col("mean_uses") >= F.col("max_repeats"))).alias("short"),
    )

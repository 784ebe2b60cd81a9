"""Places, running sums and values before, within keys that may hold any share of the rows.

A window over a key would bring all its rows into one task. Here rows are divided by
ranges of (key, order), so a large key lies in several stretches. Within a stretch a
window does the work; what the stretches before it add is told by one row for each
stretch and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.plans.scratch import written


@dataclass
class Stretches:
    """``rows`` with the stretch of each (``_st_part``) and its order columns (``_st_o0``, ...)."""

    rows: DataFrame
    key: str
    by: list[Column]
    columns: list[str]

    @staticmethod
    def of(rows: DataFrame, key: str, order: list[str | Column], descending: bool = False) -> "Stretches":
        marked = rows.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_st_o{i}") for i, c in enumerate(order)])
        by = [F.col(f"_st_o{i}").desc() if descending else F.col(f"_st_o{i}").asc() for i in range(len(order))]
        parts = written(marked.repartitionByRange(F.col(key), *by).withColumn("_st_part", F.spark_partition_id()), "stretches")
        return Stretches(parts, key, by, rows.columns)

    def own(self):
        """The window over a key's rows in one stretch."""
        return Window.partitionBy("_st_part", self.key).orderBy(*self.by)

    def joined(self, within: Column, per: Column, over: Column, made: Column, name: str) -> DataFrame:
        """The rows with ``name``: ``made`` of ``_st_own`` (``within`` the stretch) and ``_st_before``
        (``over`` the ``_st_per`` of the key's stretches before)."""
        stats = self.rows.groupBy("_st_part", self.key).agg(per.alias("_st_per"))
        earlier = Window.partitionBy(self.key).orderBy("_st_part").rowsBetween(Window.unboundedPreceding, -1)
        stats = stats.select(F.col("_st_part").alias("_st_p"), F.col(self.key).alias("_st_k"), over.over(earlier).alias("_st_before"))
        out = self.rows.withColumn("_st_own", within).join(stats, (F.col("_st_part") == F.col("_st_p")) & F.col(self.key).eqNullSafe(F.col("_st_k")))
        return out.withColumn(name, made).select(*[c for c in self.columns if c != name], name)


def numbered(rows: DataFrame, key: str, order: list[str | Column], name: str = "pos", descending: bool = False) -> DataFrame:
    """Adds ``name``, the place from 0 of each row within its key by the given order."""
    s = Stretches.of(rows, key, order, descending)
    place = (F.col("_st_own") + F.coalesce("_st_before", F.lit(0))).cast("int")
    return s.joined(F.row_number().over(s.own()) - 1, F.count(F.lit(1)), F.sum("_st_per"), place, name)


def running_sum(rows: DataFrame, key: str, order: list[str | Column], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the key's rows up to each one, or before it."""
    s = Stretches.of(rows.withColumn("_st_value", value), key, order)
    s.columns = rows.columns
    own = F.sum("_st_value").over(s.own().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    both = F.when(F.col("_st_own").isNotNull() | F.col("_st_before").isNotNull(), F.coalesce("_st_own", F.lit(0)) + F.coalesce("_st_before", F.lit(0)))
    return s.joined(own, F.sum("_st_value"), F.sum("_st_per"), both, name)


def last_known(rows: DataFrame, key: str, order: list[str | Column], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``, the last ``value`` that is not null of the key's rows up to each one, or
    before it. A struct keeps a null of its own: see ``value_before``."""
    s = Stretches.of(rows.withColumn("_st_value", value), key, order)
    s.columns = rows.columns
    own = F.last("_st_value", ignorenulls=True).over(s.own().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    at = F.struct(*[F.col(f"_st_o{i}") for i in range(len(order))])
    last = F.max_by("_st_value", F.when(F.col("_st_value").isNotNull(), at))
    return s.joined(own, last, F.last("_st_per", ignorenulls=True), F.coalesce("_st_own", "_st_before"), name)


def value_before(rows: DataFrame, key: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``, the ``value`` of the key's row before each one, null for the first."""
    held = last_known(rows, key, order, F.struct(value.alias("v")), "_st_held", inclusive=False)
    return held.withColumn(name, F.col("_st_held.v")).select(*[c for c in rows.columns if c != name], name)

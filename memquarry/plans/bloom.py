"""A filter of fixed size on the ids that a later join needs.

Wide rows (whole texts) are shuffled only for ids that may be wanted. The filter
has the same number of bits for any input, so what is sent to the executors does
not grow; more ids only raise the share of needless rows that pass, and the join
that follows drops those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MB.
BITS = 1 << 24
PROBES = 2


def id_filter(ids: DataFrame, column: str, bits: int = BITS):
    """A function that gives, for a column of ids, whether each may be among ``ids``.

    The words of the filter are combined on the executors; at most bits / 64 of
    them come to the driver."""
    slots = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(p), F.col(column).cast("bigint")), F.lit(bits)) for p in range(PROBES)]))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(slots.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("set"))
        .toPandas()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
    shared = ids.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_hold(a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.ones(len(a), bool)
        for s in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            found &= (shared.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(found)

    def test(c: str) -> Column:
        return may_hold(*[F.pmod(F.xxhash64(F.lit(p), F.col(c).cast("bigint")), F.lit(bits)) for p in range(PROBES)])

    return test

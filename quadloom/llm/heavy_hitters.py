"""Most frequent values of a huge column by exact, spillable aggregation.

`groupBy` combines map-side, so a hot value reaches the shuffle once per task;
the hash partitions of the shuffle aggregate with spilling to disk; the ordered
limit keeps the top k of every partition and merges only those.

Defined results: nulls are no values; the empty string is one. Ties at the last
place are broken by value order. An empty table gives no rows. Only the named
column is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, value: str, k: int, keep: Column | None = None) -> DataFrame:
    """(value, n): the `k` most frequent non-null values among the rows with `keep`."""
    rows = df.filter(F.col(value).isNotNull() if keep is None else F.col(value).isNotNull() & keep)
    return rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def frequent_values(df: DataFrame, value: str, share: float, keep: Column | None = None) -> DataFrame:
    """(value, n): every value that makes up at least `share` of all rows of `df`.

    No more than 1 / share values can, so the top 1 / share hold all of them.
    """
    total = df.count()
    return top_values(df, value, math.floor(1 / share + 1e-9), keep).filter(F.col("n") >= share * total)

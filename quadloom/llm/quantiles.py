"""Percentiles of huge numeric columns from signed logarithmic buckets.

A value v lies in the bucket ceil(log_gamma |v|) of its sign, gamma being
(1 + a) / (1 - a); every value of a bucket is within the share `a` of the bucket's
representative 2 gamma^i / (gamma + 1). Zero has a bucket of its own. A sketch is a
table of bucket counts, so sketches of partitions, days or loads combine by adding
counts. A 64-bit column has at most 2 * log_gamma(2^63) + 1 buckets a group (about
8,800 at a = 0.005), however many rows it has.

Defined results: null and NaN values are not counted, infinities are errors of
the caller and not counted either; groups may have null keys; an empty table gives
no rows; ties and repeated rows count as often as stored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sketch(df: DataFrame, groups: list[str], fields: list[str], error: float = 0.005) -> DataFrame:
    """(groups, field_name, sign, bucket, n): the bucket counts of each of `fields` in one pass."""
    gamma = (1 + error) / (1 - error)
    cells = df.select(*groups, F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("v")) for f in fields))).alias("cell"))
    v = F.col("cell.v")
    magnitude = F.abs(v)
    return (
        cells.filter(v.isNotNull() & ~F.isnan(v) & (magnitude < float("inf")))
        .select(
            *groups, F.col("cell.field_name").alias("field_name"), F.signum(v).cast("int").alias("sign"),
            F.when(v == 0, 0).otherwise(F.ceil(F.log(magnitude) / math.log(gamma))).cast("int").alias("bucket"),
        )
        .groupBy(*groups, "field_name", "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of the rows of all; they must have the same groups and error."""
    all_rows = sketches[0]
    for s in sketches[1:]:
        all_rows = all_rows.unionByName(s)
    keys = [c for c in all_rows.columns if c != "n"]
    return all_rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, pcts: list[int], error: float = 0.005, least_values: int = 1) -> DataFrame:
    """(groups, field_name, pct, value, n): value is within the share `error` of the exact percentile.

    The percentile is the smallest value that at least pct % of the values don't
    exceed. Windows run over one group's buckets, whose number is bounded.
    """
    gamma = (1 + error) / (1 - error)
    keys = [c for c in counts.columns if c not in ("sign", "bucket", "n")]
    by = Window.partitionBy(*keys)
    upward = by.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("total", F.sum("n").over(by)).withColumn("seen", F.sum("n").over(upward))
    wanted = upto.filter(F.col("total") >= least_values).withColumn("pct", F.explode(F.array(*(F.lit(p).cast("int") for p in pcts))))
    hit = wanted.filter((F.col("seen") * 100 >= F.col("pct") * F.col("total")) & ((F.col("seen") - F.col("n")) * 100 < F.col("pct") * F.col("total")))
    value = F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    return hit.select(*keys, "pct", value.alias("value"), F.col("total").alias("n"))

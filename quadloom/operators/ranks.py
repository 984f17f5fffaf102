"""Number the rows of each group without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.groups import codes_of
from quadloom.runtime import cut_lineage


def number_within(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with a number from 1 to n within each group of `keys`, in no particular order.

    A row's number is its rank within its task plus the counts of earlier tasks;
    only these counts are grouped, one per task and group.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            code = codes_of(*(batch.column(k) for k in keys))
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
            sizes = np.diff(np.append(starts, len(order)))
            firsts = batch.take(pa.array(order[starts])).select(keys).to_pylist()
            base = np.empty(len(starts), np.int64)
            for i, (row, n) in enumerate(zip(firsts, sizes.tolist(), strict=True)):
                key = tuple(row.values())
                base[i] = seen.get(key, 0)
                seen[key] = int(base[i]) + n
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(starts - base, sizes)
            yield batch.append_column("__task", pa.array(np.full(len(order), task, np.int32))).append_column("__local", pa.array(rank))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranked = cut_lineage(df.mapInArrow(local, fields + ", __task int, __local bigint"))
    counts = ranked.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__task").alias("__t"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    same = F.col("__task") == F.col("__t")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ranked.join(offsets, same).withColumn(name, F.col("__before") + F.col("__local") + 1).select(*df.columns, name)

"""Tab-separated logs of leaning and labelling runs.

Nulls and empty texts are written as NULL, so that no cell is empty: logs of other
tools double a tab here and there, which reading undoes. A NOBNODES row has 0 blank
nodes and the status OK, whatever it was made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cell of a null.
NULL = "\\N"
#: Columns of a typed log row.
COLUMNS = ("op", "doc", "triples", "bnodes", "ms", "status", "out_triples", "out_bnodes", "joins", "depth", "solutions", "rounds", "leaves")


def lean_rows(stats: DataFrame, ms: str | None = None) -> DataFrame:
    """Log rows of a leaning's stats."""
    time = F.col(ms) if ms else F.lit(None).cast("bigint")
    op = F.when(F.col("bnodes") == 0, "NOBNODES").otherwise("LEAN")
    none = F.lit(None).cast("bigint")
    return stats.select(op.alias("op"), F.col("g").alias("doc"), "triples", "bnodes", time.alias("ms"), "status", "out_triples", "out_bnodes", "joins", "depth", "solutions", none.alias("rounds"), none.alias("leaves"))


def label_rows(stats: DataFrame, triples: DataFrame) -> DataFrame:
    """Log rows of a labelling's stats; `triples` has (g, triples)."""
    none = F.lit(None).cast("bigint")
    rows = triples.join(stats, "g", "left")
    op = F.when(F.coalesce("bnodes", F.lit(0)) == 0, "NOBNODES").otherwise("LABEL")
    return rows.select(op.alias("op"), F.col("g").alias("doc"), "triples", F.coalesce("bnodes", F.lit(0)).alias("bnodes"), none.alias("ms"), F.coalesce("status", F.lit("OK")).alias("status"), *(none.alias(c) for c in ("out_triples", "out_bnodes", "joins", "depth", "solutions")), "rounds", "leaves")


def as_lines(rows: DataFrame) -> DataFrame:
    """(value): the log's lines; failures have a negative sixth field and the status after it."""
    shown = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NULL))
    cell = lambda *names: [shown(F.col(n)) for n in names]
    head = cell("op", "doc", "triples", "bnodes", "ms")
    removed = [shown(F.col(a) - F.col(b)) for a, b in (("triples", "out_triples"), ("bnodes", "out_bnodes"))]
    lean = F.concat_ws("\t", *head, *cell("out_triples", "out_bnodes", "joins", "depth", "solutions"), *removed)
    label = F.concat_ws("\t", *head, *cell("rounds", "leaves"))
    failed = F.concat_ws("\t", *head, F.lit("-1"), *cell("status"))
    none = F.concat_ws("\t", *cell("op", "doc", "triples"), F.lit("0"), F.col("ms").cast("string"))  # a null time has no cell
    line = F.when(F.col("op") == "NOBNODES", none).when(~F.col("status").eqNullSafe("OK"), failed).when(F.col("op") == "LEAN", lean).when(F.col("op") == "LABEL", label).otherwise(F.concat_ws("\t", *head, "status"))
    return rows.select(line.alias("value"))


def read_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Typed rows of log lines; doubled tabs count as one, NULL and numbers that aren't are null."""
    t = F.split(F.regexp_replace(line, "\t\t+", "\t"), "\t")
    at = lambda i: F.nullif(F.get(t, F.lit(i)), F.lit(NULL))
    number = lambda i: at(i).try_cast("bigint")
    bad = F.coalesce((at(0) != "NOBNODES") & (number(5) < 0), F.lit(False))
    lean, label = (at(0) == "LEAN") & ~bad, (at(0) == "LABEL") & ~bad
    status = F.when(bad, at(6)).when(at(0) == "TEST", at(5)).otherwise("OK")
    return lines.select(
        at(0).alias("op"), at(1).alias("doc"), number(2).alias("triples"), number(3).alias("bnodes"), number(4).alias("ms"), status.alias("status"),
        *(F.when(lean, number(i)).alias(c) for i, c in enumerate(("out_triples", "out_bnodes", "joins", "depth", "solutions"), 5)),
        *(F.when(label, number(i)).alias(c) for i, c in enumerate(("rounds", "leaves"), 5)),
    )

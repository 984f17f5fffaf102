"""Reports on runs: histograms, sums, extremes, failures; one pass each, combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Inclusive bounds of the runtime bins in milliseconds.
BINS = ((0, 9), (10, 99), (100, 999), (1_000, 9_999), (10_000, 99_999), (100_000, 1_000_000))


def runtime_bins(runs: DataFrame, groups: list[str], ms: str) -> DataFrame:
    """(groups, bin, n): runs in each bin; larger times are in the bin `over`, null and negative ones in `none`."""
    name = F.when(F.col(ms).isNull() | (F.col(ms) < 0), "none")
    for low, high in BINS:
        name = name.when(F.col(ms).between(low, high), f"{low}-{high}")
    return runs.groupBy(*groups, name.otherwise("over").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def totals(runs: DataFrame, groups: list[str], fields: list[str], failed: Column, leaned: Column) -> DataFrame:
    """Rows and sums of `fields` by group, failure and whether the run removed anything."""
    return runs.groupBy(*groups, F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(leaned, F.lit(False)).alias("leaned")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"sum_{f}") for f in fields))


def extremes(runs: DataFrame, groups: list[str], metrics: dict[str, Column], first: str, companions: list[str]) -> DataFrame:
    """(groups, metric, value, companions) of the row with each metric's largest value, the least `first` among equals."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("bigint").alias("value")) for k, v in metrics.items())))
    rows = runs.select(*groups, first, *companions, each.alias("x")).filter(F.col("x.value").isNotNull())
    top = rows.groupBy(*groups, F.col("x.metric").alias("metric")).agg(F.max_by(F.struct(F.col("x.value").alias("value"), *companions), F.struct(F.col("x.value"), -F.col(first))).alias("top"))
    return top.select(*groups, "metric", "top.*")


def exceptions(runs: DataFrame, groups: list[str], status: str, fine: tuple[str, ...] = ("OK", "NOBNODES")) -> DataFrame:
    """(groups, status, n), the most frequent first."""
    bad = runs.filter(F.col(status).isNotNull() & ~F.col(status).isin(*fine))
    return bad.groupBy(*groups, status).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), status)


def both_times(runs: DataFrame, doc: str, op: str, ms: str, first: str = "LEAN", second: str = "LABEL") -> DataFrame:
    """(doc, ms): the summed time of a document's two runs, joined by document; null times count 0."""
    time = lambda o: F.sum(F.when(F.col(op) == o, F.greatest(F.col(ms), F.lit(0))))
    both = runs.filter(F.col(op).isin(first, second)).groupBy(doc).agg(time(first).alias("a"), time(second).alias("b"), F.count_if(F.col(op) == first).alias("n1"), F.count_if(F.col(op) == second).alias("n2"))
    return both.filter((F.col("n1") > 0) & (F.col("n2") > 0)).select(doc, (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("ms"))


def statements(triples: DataFrame) -> DataFrame:
    """(g, statements) of each graph, every row counted."""
    return triples.groupBy("g").agg(F.count(F.lit(1)).alias("statements"))


def runs_of_graphs(triples: DataFrame, order: str) -> DataFrame:
    """(g, run, statements): contiguous runs of a graph in the order of reading, as a reader that cuts at each change sees them.

    Chunks of the order are numbered first, so that only one row for each chunk's
    border is ordered in one place.
    """
    span = F.floor(F.col(order) / 1_000_000)
    own = Window.partitionBy("chunk").orderBy(order)
    rows = triples.select("g", order, span.alias("chunk")).withColumn("new", (F.lag(order).over(own).isNull() | ~F.col("g").eqNullSafe(F.lag("g").over(own))).cast("int"))
    first = rows.groupBy("chunk").agg(F.min_by("g", order).alias("head"), F.max_by("g", order).alias("tail"), F.sum("new").alias("n"), F.min_by("new", order).alias("n0"))
    between = Window.orderBy("chunk")
    # A chunk's first row opens no run if the chunk before ended in the same graph.
    first = first.withColumn("joined", F.coalesce((F.col("head").eqNullSafe(F.lag("tail").over(between)) & F.lag("chunk").over(between).isNotNull()).cast("int"), F.lit(0)))
    first = first.withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("joined")).over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = rows.join(first.select("chunk", "before", "joined"), "chunk").withColumn("run", F.col("before") - F.col("joined") + F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("g", "run").agg(F.count(F.lit(1)).alias("statements"))

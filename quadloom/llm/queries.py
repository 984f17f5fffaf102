"""Queries of the training-data operators; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.components import group_nodes
from quadloom.llm.heavy_hitters import frequent_values, top_values
from quadloom.llm.packing import pack
from quadloom.llm.quantiles import merge, percentiles, sketch
from quadloom.llm.term_counts import mark_terms
from quadloom.llm.text_quality import text_statistics
from quadloom.llm.tokens import count_tokens, encode_texts
from quadloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Predicates in too few or too many graphs to be of use."""
    return mark_terms(table(spark, d, "triples"), "p", "g").filter(F.col("mark").isNotNull()).select(F.col("term").alias("p"), "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statements and graphs of every predicate."""
    return mark_terms(table(spark, d, "triples"), "p", "g").withColumnRenamed("term", "p")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Objects, no blank nodes, that make up at least 0.5 % of all rows."""
    return frequent_values(table(spark, d, "triples"), "o", 0.005, ~F.col("o").startswith("_:")).select(F.col("value").alias("o"))


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent objects."""
    return top_values(table(spark, d, "triples"), "o", 100).withColumnRenamed("value", "o")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every blank node of each graph with the least node of its group."""
    rows = table(spark, d, "triples").filter(F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()).select("g", "s", "o")
    blank = lambda c: F.col(c).startswith("_:")
    nodes = rows.filter(blank("s") | blank("o")).select("g", F.explode(F.filter(F.array("s", "o"), lambda x: x.startswith("_:"))).alias("node"))
    return group_nodes(nodes, rows.filter(blank("s") & blank("o")), "g", "node", "s", "o")


P4_KEYS, P4_FIELDS, P4_ERROR = ["op", "workload"], ["runtime", "bnodes"], 0.005


def _p4_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = {f: F.when(F.col(f) >= 0, F.col(f)) for f in P4_FIELDS}
    return table(spark, d, "run_metrics").filter(F.col("workload").isNotNull()).select(*P4_KEYS, "row_id", *(v.alias(f) for f, v in kept.items()))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups, fields and percentiles of at least 1,000."""
    counts = sketch(_p4_rows(spark, d), P4_KEYS, P4_FIELDS, P4_ERROR)
    found = percentiles(counts, [50, 95, 99], P4_ERROR, least_values=50)
    return found.filter(F.col("value") >= 1000).select(*P4_KEYS, "field_name", "pct")


def p4_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The bucket counts, made of the sketches of two separate loads."""
    rows = _p4_rows(spark, d)
    loads = [sketch(rows.filter(F.col("row_id") % 2 == i), P4_KEYS, P4_FIELDS, P4_ERROR) for i in range(2)]
    return merge(*loads)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every notebook, or piece of one, for each token budget."""
    budgets = table(spark, d, "token_budgets").select("budget", "tokenizer", "capacity").limit(1001).collect()
    if len(budgets) > 1000:
        raise ValueError("more than 1,000 token budgets")
    found = None
    for tokenizer in sorted({b.tokenizer for b in budgets}):
        sizes = count_tokens(table(spark, d, "documents"), "doc_id", "text", tokenizer)
        packed, _ = pack(sizes, "doc_id", "tokens", [(b.budget, b.capacity) for b in budgets if b.tokenizer == tokenizer])
        found = packed if found is None else found.unionByName(packed)
    return found.withColumnsRenamed({"bin": "budget", "start": "token_from", "size": "tokens"})


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and kind of every document's text."""
    return text_statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document's text that SQL can count."""
    return p8_stats(spark, d).select("doc_id", "lines", "words", "mean_word_length", "letter_ratio", "symbol_ratio", "punctuated_share")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents, not blank, in which running sentences make up less than half of the non-blank lines."""
    return p8_stats(spark, d).filter(F.col("prose_share") < 0.5).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_top": p2_top,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sketch": p4_sketch,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p8_counts": p8_counts,
}

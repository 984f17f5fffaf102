"""The core queries by name; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.hashing import combine_ordered, term_hash
from quadloom.functions.terms import is_bnode, parts
from quadloom.operators import graphs, metrics
from quadloom.operators.components import bnode_components
from quadloom.operators.edges import candidates, fix_bnodes, predicate_counts
from quadloom.operators.label import canonicalise, isomorphic_graphs, triple_sums
from quadloom.operators.lean import lean
from quadloom.operators.parse_rows import load_terms, reject_reasons
from quadloom.operators.refine import digest_refine, digest_round
from quadloom.plans import fixtures
from quadloom.runtime import table
from quadloom.sources import edgelist, ntriples, run_log
from quadloom.sources.direct_map import lines_graph, nations_graph, orders_graph, paths_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _crawl(spark: SparkSession, d: str) -> DataFrame:
    return graphs.normalise(table(spark, d, "triples"))


# --- rows that fail to parse ---


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reject_reasons(table(spark, d, "raw_lines")).select("line_id")


@query
def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    return reject_reasons(table(spark, d, "raw_lines")).select("line_id", F.array_join("reasons", "; ").alias("reasons"))


@query
def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_terms(table(spark, d, "raw_lines"))


# --- sources and sinks ---


@query
def rdf_direct_map_orders(spark: SparkSession, d: str) -> DataFrame:
    return orders_graph(table(spark, d, "orders"))


@query
def rdf_direct_map_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_graph(table(spark, d, "lineitem"))


@query
def rdf_direct_map_nations(spark: SparkSession, d: str) -> DataFrame:
    return nations_graph(table(spark, d, "nation"))


@query
def rdf_direct_map_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths_graph(table(spark, d, "events"))


@query
def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """The crawl as N-Quads text."""
    return ntriples.as_lines(_crawl(spark, d), with_graph=True)


@query
def scanned_statements(spark: SparkSession, d: str) -> DataFrame:
    """Text written and scanned again."""
    lines = ntriples.as_lines(_crawl(spark, d), with_graph=True).withColumnRenamed("value", "line")
    return ntriples.triples_of(lines)[0]


@query
def bench_cases(spark: SparkSession, d: str) -> DataFrame:
    return edgelist.cases(table(spark, d, "bench_files"))


@query
def run_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Successful leaning runs written as log lines and read again."""
    rows = table(spark, d, "run_metrics").filter("op = 'LEAN' and status = 'OK' and runtime >= 0 and doc is not null and triples is not null and bnodes is not null and out_triples is not null and out_bnodes is not null")
    typed = rows.select("op", "doc", "triples", "bnodes", F.col("runtime").alias("ms"), "status", "out_triples", "out_bnodes", F.coalesce("joins", F.lit(0)).alias("joins"), F.coalesce("search_depth", F.lit(0)).alias("depth"), F.coalesce("solutions", F.lit(0)).alias("solutions"), F.lit(None).cast("bigint").alias("rounds"), F.lit(None).cast("bigint").alias("leaves"))
    return run_log.read_rows(run_log.as_lines(typed)).drop("rounds", "leaves")


@query
def run_log_round_trip_all(spark: SparkSession, d: str) -> DataFrame:
    """All runs, failures and nulls included, written as log lines and read again."""
    rows = table(spark, d, "run_metrics").withColumnsRenamed({"runtime": "ms", "search_depth": "depth"})
    return run_log.read_rows(run_log.as_lines(rows.select(*run_log.COLUMNS)))


# --- projections, filters, sets ---


@query
def ground_split(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ground(_crawl(spark, d))


@query
def bnode_link_rows(spark: SparkSession, d: str) -> DataFrame:
    return graphs.bnode_links(_crawl(spark, d))


@query
def skolem_iris(spark: SparkSession, d: str) -> DataFrame:
    return graphs.skolemised(_crawl(spark, d), "urn:bn:", as_bnode=False)


@query
def term_parts(spark: SparkSession, d: str) -> DataFrame:
    """Kinds, languages and datatypes of the crawl's objects."""
    p = table(spark, d, "triples").filter(F.col("o").isNotNull()).select(parts("o").alias("x"))
    return p.groupBy("x.kind", "x.lang", "x.datatype").agg(F.count(F.lit(1)).alias("n"))


@query
def symmetrise_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.symmetrised(table(spark, d, "events").select(F.col("user_id").cast("string").alias("u"), "event_type"), "u", "event_type")


@query
def triple_difference(spark: SparkSession, d: str) -> DataFrame:
    """Statements only in odd, and only in even rows of the crawl."""
    rows = table(spark, d, "triples")
    left, right = graphs.difference(rows.filter("stmt_id % 2 = 1"), rows.filter("stmt_id % 2 = 0"))
    return left.withColumn("side", F.lit("odd")).unionByName(right.withColumn("side", F.lit("even")))


@query
def graphs_without_bnodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.split_by_bnodes(_crawl(spark, d))[1].groupBy("g").agg(F.count(F.lit(1)).alias("n"))


# --- hashes ---


def _hashes(scheme: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = table(spark, d, "triples").select("o").filter(F.col("o").isNotNull()).distinct()
        return terms.select("o", term_hash("o", scheme).alias("h"))

    return run


for _scheme in ("md5", "sha1", "sha256", "sha512", "murmur3_128"):
    QUERIES[f"term_hash_{_scheme}"] = _hashes(_scheme)


@query
def combine_ordered_triples(spark: SparkSession, d: str) -> DataFrame:
    rows = graphs.ground(_crawl(spark, d))
    return rows.select("g", "s", "p", "o", combine_ordered(term_hash("s"), term_hash("p"), term_hash("o")).alias("h"))


@query
def ground_hash(spark: SparkSession, d: str) -> DataFrame:
    return triple_sums(graphs.ground(_crawl(spark, d)), "md5").withColumnRenamed("sum", "h")


# --- counts ---


@query
def graph_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return predicate_counts(_crawl(spark, d))


@query
def bnode_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs.count_bnodes(_crawl(spark, d))


@query
def control_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.statements(table(spark, d, "triples"))


@query
def control_runs(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous runs of graphs in the order of reading."""
    return metrics.runs_of_graphs(table(spark, d, "triples"), "stmt_id").select("g", "statements")


# --- components, colours, labels ---


@query
def crawl_components(spark: SparkSession, d: str) -> DataFrame:
    return bnode_components(_crawl(spark, d))


@query
def path_components(spark: SparkSession, d: str) -> DataFrame:
    return bnode_components(paths_graph(table(spark, d, "events"), by_segment=False)).select("node", "comp")


@query
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return bnode_components(paths_graph(table(spark, d, "events"), by_segment=False)).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


def _blank_colours(triples: DataFrame) -> DataFrame:
    return graphs.bnodes(triples).select("g", F.col("bnode").alias("node"), F.md5(F.lit("")).alias("h"))


@query
def colour_round_1(spark: SparkSession, d: str) -> DataFrame:
    rows = _crawl(spark, d)
    return digest_round(rows, _blank_colours(rows))


@query
def colour_round_2(spark: SparkSession, d: str) -> DataFrame:
    rows = _crawl(spark, d)
    return digest_round(rows, digest_round(rows, _blank_colours(rows)))


@query
def colour_classes_final(spark: SparkSession, d: str) -> DataFrame:
    """Every path node with the least node of its stable colour."""
    colours, _ = digest_refine(paths_graph(table(spark, d, "events"), by_segment=False))
    least = colours.groupBy("h").agg(F.min("node").alias("least"))
    return colours.join(least, "h").select("node", "least")


@query
def iso_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of two and more isomorphic paths: the least member and the size."""
    found = isomorphic_graphs(canonicalise(paths_graph(table(spark, d, "events"))))
    return found.select(F.element_at("graphs", 1).alias("g"), "n")


@query
def iso_dedup_graph(spark: SparkSession, d: str) -> DataFrame:
    """All paths as one graph in which isomorphic ones merge."""
    found = canonicalise(paths_graph(table(spark, d, "events"), by_segment=False), distinguish_iso=False)
    return found.triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query
def iso_rank(spark: SparkSession, d: str) -> DataFrame:
    """How many paths are the first, second ... copy of theirs."""
    found = canonicalise(paths_graph(table(spark, d, "events"), by_segment=False))
    return found.parts.groupBy("copy").agg(F.count(F.lit(1)).alias("n"))


@query
def label_orders_compat(spark: SparkSession, d: str) -> DataFrame:
    found = canonicalise(orders_graph(table(spark, d, "orders")))
    labels = found.labels.groupBy("g").agg(F.count_distinct("label").alias("labels"))
    return found.stats.join(labels, "g").select("g", "bnodes", "parts", "labels", "status")


@query
def label_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Canonical hash of every crawled graph."""
    return canonicalise(table(spark, d, "triples")).graphs


@query
def label_golden(spark: SparkSession, d: str) -> DataFrame:
    return canonicalise(fixtures.golden(spark)).triples.select("s", "p", "o")


# --- leaning ---


@query
def lean_orders(spark: SparkSession, d: str) -> DataFrame:
    return lean(orders_graph(table(spark, d, "orders"))).triples


@query
def lean_lines_superset(spark: SparkSession, d: str) -> DataFrame:
    return lean(lines_graph(table(spark, d, "lineitem"))).triples


@query
def lean_witness(spark: SparkSession, d: str) -> DataFrame:
    return lean(orders_graph(table(spark, d, "orders"))).mapping


@query
def lean_apply_map(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_graph(table(spark, d, "orders"))
    return graphs.apply_map(rows, lean(rows).mapping)


@query
def lean_paths(spark: SparkSession, d: str) -> DataFrame:
    """Directed paths are lean."""
    return lean(paths_graph(table(spark, d, "events"))).stats.select("g", "triples", "bnodes", "out_triples", "out_bnodes", "status")


@query
def ground_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_graph(table(spark, d, "lineitem"))
    none = rows.select("g", F.col("s").alias("bnode")).filter(F.lit(False))
    return candidates(rows, none)


@query
def fixed_bnodes(spark: SparkSession, d: str) -> DataFrame:
    return fix_bnodes(lines_graph(table(spark, d, "lineitem")))[1]


def _core(algorithm: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lean(fixtures.synthetic(spark), algorithm=algorithm).stats.select("g", "triples", "bnodes", "out_triples", "out_bnodes")

    return run


QUERIES["core_synthetic"] = _core("dfs")
QUERIES["core_synthetic_bfs"] = _core("bfs")


# --- reports on runs ---


@query
def runtime_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.runtime_bins(table(spark, d, "run_metrics"), ["op", "workload"], "runtime")


@query
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    leaned = (F.col("op") == "LEAN") & (F.col("out_bnodes") < F.col("bnodes"))
    failed = ~F.col("status").isin("OK", "NOBNODES")
    return metrics.totals(table(spark, d, "run_metrics"), ["op"], ["triples", "bnodes", "runtime"], failed, leaned)


@query
def argmax_stats(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"triples": F.col("triples"), "bnodes": F.col("bnodes"), "runtime": F.col("runtime"), "removed": F.col("bnodes") - F.col("out_bnodes")}
    return metrics.extremes(table(spark, d, "run_metrics"), ["op"], wanted, "row_id", ["doc", "status"])


@query
def exception_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exceptions(table(spark, d, "run_metrics"), ["op"], "status")


@query
def both_times(spark: SparkSession, d: str) -> DataFrame:
    return metrics.both_times(table(spark, d, "run_metrics"), "doc", "op", "runtime")


FLAGSHIP = lean_orders

__all__ = ["FLAGSHIP", "QUERIES", "is_bnode"]

"""Command line: python -m quadloom TOOL ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.hashing import WIDTH
from quadloom.operators import graphs, metrics
from quadloom.operators.label import canonicalise, isomorphic_graphs, output_labels
from quadloom.operators.lean import lean
from quadloom.runtime import session, ship
from quadloom.sources import edgelist, ntriples, run_log


def _input(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Triples of the input; gzip is told by the suffix, `std` is standard input."""
    if a.input == "std":
        return ntriples.from_stdin(spark)
    return ntriples.read_triples(spark, a.input, encoding=a.input_encoding, partitions=a.partitions)


def _output(lines: DataFrame, a: argparse.Namespace) -> None:
    if a.output == "std":
        ntriples.to_stdout(lines.toLocalIterator())
    else:
        lines.write.mode("overwrite").options(**({"compression": "gzip"} if a.gzip else {})).text(a.output)


def _labelled(triples: DataFrame, a: argparse.Namespace):
    return canonicalise(triples, scheme=a.scheme, distinguish_iso=not a.merge_copies, unique_per_graph=not a.shared_labels, prune=not a.no_prune, timeout=a.timeout)


def _leaned(triples: DataFrame, a: argparse.Namespace):
    return lean(triples, algorithm=a.algorithm, prune=not a.no_prune, seed=a.seed, timeout=a.timeout)


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    """Canonical labels, of the lean graph on request."""
    triples = _input(spark, a)
    if a.lean or a.lean_only:
        triples = _leaned(triples, a).triples
    rows = triples if a.lean_only else output_labels(_labelled(triples, a), a.prefix, a.bnodes)
    _output(ntriples.as_lines(rows, a.quads), a)


def batch(spark: SparkSession, a: argparse.Namespace) -> None:
    """Log rows of leaning and labelling every graph, and classes of isomorphic ones."""
    triples = graphs.normalise(_input(spark, a))
    rows = None
    if a.mode in ("LEAN", "BOTH"):
        done = _leaned(triples, a)
        rows, triples = run_log.as_lines(run_log.lean_rows(done.stats)), done.triples
    if a.mode in ("LABEL", "BOTH"):
        found = _labelled(triples, a)
        counts = triples.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))
        more = run_log.as_lines(run_log.label_rows(found.stats, counts))
        rows = more if rows is None else rows.unionByName(more)
        same = isomorphic_graphs(found).select(F.concat_ws("\t", F.lit("SAME"), F.col("n").cast("string"), F.array_join("graphs", " ")).alias("value"))
        rows = rows.unionByName(same)
    if a.mode == "TEST":
        rows = _tested(triples, a)
    _output(rows, a)


def _tested(triples: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Do renamed and reordered copies get the same labels, and does leaning keep one class?"""
    names = None
    for seed in range(4):
        copy = triples if seed == 0 else graphs.renamed(triples, seed)
        for kind, rows in (("LABEL", copy), ("LEAN", _leaned(copy, a).triples)):
            part = _labelled(rows, a).graphs.select(F.lit(kind).alias("kind"), "g", "ghash")
            names = part if names is None else names.unionByName(part)
    result = names.groupBy("kind", "g").agg(F.count_distinct("ghash").alias("n"))
    verdict = F.when(F.col("n") == 1, "OKAY").otherwise("ERROR")
    return result.select(F.concat_ws("\t", F.lit("TEST"), "g", "kind", verdict).alias("value"))


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lean and label edge-list files of growing size; a family ends at its first failure."""
    skipped = set()
    for case in edgelist.read_cases(spark, a.input).toLocalIterator():
        if case.family in skipped:
            continue
        triples = edgelist.read_edges(spark, case.file_path)
        began, status = time.monotonic(), "OK"
        if a.mode in ("LEAN", "BOTH"):
            done = _leaned(triples, a)
            status, triples = done.stats.agg(F.max("status")).first()[0] or "OK", done.triples
        if a.mode in ("LABEL", "BOTH") and status == "OK":
            status = _labelled(triples, a).stats.agg(F.max("status")).first()[0] or "OK"
        n = triples.count()
        print(a.mode, case.file_path, case.family, case.k, n, int(1000 * (time.monotonic() - began)), status, sep="\t", flush=True)
        if status != "OK":
            skipped.add(case.family)


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reports on a log of runs."""
    runs = run_log.read_rows(spark.read.text(a.input))
    failed = F.col("status") != "OK"
    leaned = (F.col("op") == "LEAN") & (F.col("out_bnodes") < F.col("bnodes"))
    reports = {
        "totals": metrics.totals(runs, ["op"], ["triples", "bnodes", "ms"], failed, leaned),
        "bins": metrics.runtime_bins(runs, ["op"], "ms"),
        "both": metrics.runtime_bins(metrics.both_times(runs, "doc", "op", "ms"), [], "ms"),
        "exceptions": metrics.exceptions(runs, ["op"], "status"),
        "largest": metrics.extremes(runs.withColumn("row_id", F.monotonically_increasing_id()), ["op"], {c: F.col(c) for c in ("triples", "bnodes", "ms")} | {"leaned": F.col("bnodes") - F.col("out_bnodes")}, "row_id", ["doc"]),
    }
    for name, df in reports.items():
        print(f"# {name}")
        df.show(1000, truncate=False)


def control(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statements of every graph."""
    _output(metrics.statements(_input(spark, a)).select(F.concat_ws("\t", "g", F.col("statements").cast("string")).alias("value")), a)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Edge lists to N-Triples."""
    _output(ntriples.as_lines(edgelist.read_edges(spark, a.input), a.quads), a)


TOOLS = {f.__name__: f for f in (label, batch, bench, analyse, control, convert)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadloom", description=__doc__)
    tools = p.add_subparsers(dest="tool", required=True)
    for name, f in TOOLS.items():
        t = tools.add_parser(name, help=f.__doc__)
        t.add_argument("-i", "--input", required=True)
        t.add_argument("-o", "--output", default="std")
        t.add_argument("--input-encoding", default="UTF-8")
        t.add_argument("--partitions", type=int, help="spread the lines of files that can't be split")
        t.add_argument("--gzip", action="store_true", help="gzip the output")
        t.add_argument("--quads", action="store_true", help="write graphs too")
        t.add_argument("-s", "--scheme", default="md5", choices=sorted(WIDTH))
        t.add_argument("-p", "--prefix", default="")
        t.add_argument("-b", "--bnodes", action="store_true", help="write labels as blank nodes, not IRIs")
        t.add_argument("-l", "--lean", action="store_true")
        t.add_argument("--lean-only", action="store_true")
        t.add_argument("--algorithm", default="dfs", choices=("dfs", "bfs"))
        t.add_argument("--seed", type=int)
        t.add_argument("--no-prune", action="store_true")
        t.add_argument("--merge-copies", action="store_true", help="let isomorphic components merge")
        t.add_argument("--shared-labels", action="store_true", help="labels that don't depend on the whole graph")
        t.add_argument("-t", "--timeout", type=float, default=600.0)
        t.add_argument("--mode", default="BOTH", choices=("LEAN", "LABEL", "BOTH", "TEST"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or session()
    ship(spark)
    TOOLS[args.tool](spark, args)


if __name__ == "__main__":
    main()

"""Lean graphs: drop redundant blank nodes and tell by a map what each stands for.

1. Trivial stage, by joins over all graphs: blank nodes whose edges another term
   has too, until there are none. The first round reads a table of nodes
   (operators.gather); there are more only where triples link blank nodes.
2. Graphs in which blank nodes still link blank nodes are folded to their core:
   those that fit in a task by a depth-first or breadth-first search
   (core.GraphCore), many graphs a task; larger ones by breadth-first joins over
   their components.

Which lean subgraph is found isn't unique; it is up to isomorphism.

Defined results: as in operators.label for nulls, repeats, blank predicates, empty
input and further columns. A graph whose search runs out of time has the status
`TIMEOUT`; its result is equivalent to it, but perhaps not lean.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.operators import graphs
from quadloom.operators.components import components_of_links
from quadloom.operators.core import GraphCore, solutions
from quadloom.operators.edges import closed, compose, fix_bnodes, redundant, redundant_nodes
from quadloom.operators.gather import kinds_of, node_table, triples_of
from quadloom.operators.groups import codes_of, map_groups
from quadloom.runtime import cut_lineage

_LONG = "kind string, g string, a string, b string, c string, joins bigint, depth bigint, solutions bigint, status string"


@dataclass
class Leaning:
    """Lean triples (g, s, p, o); the map (g, bnode, term), total on the input's blank nodes; stats, one row a graph."""

    triples: DataFrame
    _mapping: Callable[[], DataFrame]
    _stats: Callable[[], DataFrame]

    @cached_property
    def mapping(self) -> DataFrame:
        """Made when it is first asked for."""
        return self._mapping()

    @cached_property
    def stats(self) -> DataFrame:
        return self._stats()


@dataclass
class _Look:
    """Distinct triples; their blank nodes (g, bnode); the map (g, bnode, term) of blank nodes whose edges another term has too; whether triples link blank nodes; the triples left without the mapped ones, if none do."""

    rows: DataFrame
    bnodes: DataFrame
    found: DataFrame
    linked: bool
    left: DataFrame


def _first_look(triples: DataFrame) -> _Look:
    nodes = cut_lineage(node_table(triples), "zstd")
    kinds = cut_lineage(kinds_of(nodes))
    any_large = not nodes.filter("large").isEmpty()
    linked = not kinds.filter("link").isEmpty()
    rows = triples_of(nodes, any_large)
    if linked:
        rows = cut_lineage(rows)
    found = cut_lineage(redundant_nodes(nodes, rows, kinds))
    bnodes = nodes.filter(is_bnode("node")).select("g", F.col("node").alias("bnode"))
    # Hashing the few that go spares the others a sort.
    gone = found.select("g", F.col("bnode").alias("node")).hint("shuffle_hash")
    return _Look(rows, bnodes.distinct() if any_large else bnodes, found, linked, triples_of(nodes.join(gone, ["g", "node"], "left_anti"), any_large))


def lean_trivially(triples: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The triples without blank nodes that another term makes redundant, and the map (g, bnode, term) of those."""
    look = _first_look(triples)
    return _further_looks(look, max_rounds) if look.linked else (look.left, closed(look.found))


def _further_looks(look: _Look, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    rows, found = look.rows, look.found
    total = rows.select("g", F.col("s").alias("bnode"), F.col("s").alias("term")).filter(F.lit(False))
    done = 0
    while True:
        done += 1
        if found.isEmpty():
            return rows, total
        step = closed(found)
        left = cut_lineage(graphs.without_nodes(rows, step))
        total = cut_lineage(compose(total, step).unionByName(step))
        # Only blank nodes that were linked to a removed one have lost edges, and only they can have become redundant.
        gone = step.select("g", F.col("bnode").alias("x"))
        links = graphs.bnode_links(rows)
        ends = links.select("g", F.col("s").alias("x"), F.col("o").alias("bnode")).unionByName(links.select("g", F.col("o").alias("x"), F.col("s").alias("bnode")))
        touched = ends.join(gone, ["g", "x"], "left_semi").select("g", "bnode").distinct()
        changed = cut_lineage(touched.join(step.select("g", "bnode"), ["g", "bnode"], "left_anti"))
        rows = left
        if done == max_rounds or changed.isEmpty():
            return rows, total
        found = cut_lineage(redundant(rows, changed))


def _core_runner(algorithm: str, prune: bool, seed: int | None, timeout: float):
    def run(table: pa.Table) -> pa.Table:
        code = codes_of(table["g"])
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        columns = [table[c].to_pylist() for c in ("g", "s", "p", "o")]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            g = columns[0][a]
            core = GraphCore(set(zip(*(c[a:b] for c in columns[1:]), strict=True)), algorithm, prune, seed, time.monotonic() + timeout).lean()
            rows += [("t", g, s, p, o, None, None, None, None) for s, p, o in core.triples]
            rows += [("m", g, x, y, None, None, None, None, None) for x, y in core.map.items()]
            rows.append(("s", g, None, None, None, core.joins, core.depth, core.solutions, core.status))
        fields = [("kind", pa.string()), ("g", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("joins", pa.int64()), ("depth", pa.int64()), ("solutions", pa.int64()), ("status", pa.string())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return run


def _lean_large(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, map and (g, joins, depth, solutions) of graphs too large for a task, one round of folds at a time."""
    total = cut_lineage(graphs.bnodes(rows).withColumn("term", F.col("bnode")))
    none = rows.select("g").filter(F.lit(False))
    stats = none.select("g", *(F.lit(0).cast("bigint").alias(c) for c in ("joins", "depth", "solutions")))
    while True:
        can, fixed = fix_bnodes(rows)
        free = can.select("g", "bnode").distinct()
        patterns = graphs.query_patterns(rows, fixed)
        lone = free.select("g", F.col("bnode").alias("a"), F.col("bnode").alias("b"))
        comp = cut_lineage(components_of_links(patterns.select("g", F.col("s").alias("a"), F.col("o").alias("b")).unionByName(lone)))
        placed = patterns.join(comp.withColumnRenamed("node", "s"), ["g", "s"])
        found = solutions(rows, placed, can)
        missing = F.size(F.array_except(F.map_keys("m"), F.map_values("m"))) > 0
        blanks = F.size(F.array_distinct(F.filter(F.map_values("m"), lambda x: x.startswith("_:"))))
        text = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))), ",")
        folds = found.filter(missing).groupBy("g", "comp").agg(F.min_by("m", F.struct(blanks, text)).alias("m")).select("g", "comp", F.explode("m").alias("bnode", "term"))
        linked = placed.select("g", F.col("comp").alias("node")).distinct()
        alone = can.filter(F.col("bnode") != F.col("term")).join(linked, (can.g == linked.g) & (can.bnode == linked.node), "left_anti")
        alone = alone.join(comp.filter(F.col("node") == F.col("comp")).select("g", F.col("node").alias("bnode")), ["g", "bnode"], "left_semi")
        inner = comp.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1).select("g", F.col("comp").alias("bnode"))
        alone = alone.join(inner, ["g", "bnode"], "left_semi").groupBy("g", "bnode").agg(F.min("term").alias("term")).select("g", F.col("bnode").alias("comp"), "bnode", "term")
        folds = cut_lineage(folds.unionByName(alone))
        round_ = found.groupBy("g").agg(F.count(F.lit(1)).alias("solutions")).select("g", F.lit(1).cast("bigint").alias("joins"), F.lit(1).cast("bigint").alias("depth"), "solutions")
        stats = cut_lineage(stats.unionByName(round_).groupBy("g").agg(*(F.sum(c).alias(c) for c in ("joins", "depth", "solutions"))))
        if folds.isEmpty():
            return rows, total, stats
        # Two folds conflict if one's image touches the other's component; a fold stands if all it conflicts with have larger names.
        folding = folds.select("g", "comp").distinct()
        touches = folds.join(comp.select("g", F.col("node").alias("term"), F.col("comp").alias("other")), ["g", "term"]).filter(F.col("comp") != F.col("other")).select("g", "comp", "other").distinct()
        touches = touches.join(folding.withColumnRenamed("comp", "other"), ["g", "other"], "left_semi")
        both = touches.unionByName(touches.select("g", F.col("other").alias("comp"), F.col("comp").alias("other")))
        yields = both.filter(F.col("other") < F.col("comp")).select("g", "comp").distinct()
        step = cut_lineage(folds.join(yields, ["g", "comp"], "left_anti").filter(F.col("bnode") != F.col("term")).select("g", "bnode", "term"))
        rows = cut_lineage(graphs.apply_map(rows, step))
        total = cut_lineage(compose(total, step))


def lean(triples: DataFrame, algorithm: str = "dfs", prune: bool = True, seed: int | None = None, timeout: float = 600.0, max_graph_triples: int = 200_000) -> Leaning:
    """Lean all graphs of (g, s, p, o).

    `algorithm` is `dfs` (stop at the first fold) or `bfs` (all homomorphisms, the
    one with the fewest blank nodes); `seed` makes the order of trials random.
    """
    if algorithm not in ("dfs", "bfs"):
        raise ValueError(f"unknown algorithm {algorithm}")
    look = _first_look(graphs.checked(triples))
    rows = look.rows
    if not look.linked:
        # No blank node has lost edges, and each is a component of its own.
        none = rows.select("g").filter(F.lit(False)).select("g", *(F.lit(0).cast("bigint").alias(c) for c in ("joins", "depth", "solutions")), F.lit("OK").alias("status"))
        return Leaning(look.left, lambda: cut_lineage(_witness(look.bnodes, closed(look.found))), lambda: _stats(rows, look.left, none))
    reduced, trivial = _further_looks(look)
    linked = graphs.bnode_links(reduced).select("g").distinct()
    sizes = reduced.join(linked, "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    small = sizes.filter(F.col("n") <= max_graph_triples).select("g")
    large = sizes.filter(F.col("n") > max_graph_triples).select("g")
    done = cut_lineage(map_groups(reduced.join(small, "g", "left_semi"), ["g"], _core_runner(algorithm, prune, seed, timeout), _LONG))
    out = reduced.join(linked, "g", "left_anti").select(*graphs.TRIPLE).unionByName(done.filter("kind = 't'").select("g", F.col("a").alias("s"), F.col("b").alias("p"), F.col("c").alias("o")))
    cores = done.filter("kind = 'm'").select("g", F.col("a").alias("bnode"), F.col("b").alias("term"))
    work = done.filter("kind = 's'").select("g", "joins", "depth", "solutions", "status")
    if not large.isEmpty():
        big, big_map, big_work = _lean_large(cut_lineage(reduced.join(large, "g", "left_semi").select(*graphs.TRIPLE)))
        out, cores, work = out.unionByName(big.select(*graphs.TRIPLE)), cores.unionByName(big_map), work.unionByName(big_work.withColumn("status", F.lit("OK")))
    out = cut_lineage(out)
    return Leaning(out, lambda: cut_lineage(compose(_witness(look.bnodes, trivial), cores)), lambda: _stats(rows, out, work))


def _witness(bnodes: DataFrame, found: DataFrame) -> DataFrame:
    """(g, bnode, term): `found`, and each other of `bnodes` to itself."""
    return bnodes.join(found, ["g", "bnode"], "left").select("g", "bnode", F.coalesce("term", "bnode").alias("term"))


def _stats(rows: DataFrame, out: DataFrame, work: DataFrame) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("joins", "depth", "solutions")]
    count = lambda df, name: df.groupBy("g").agg(F.count(F.lit(1)).alias(name))
    return (
        count(rows, "triples").join(count(graphs.bnodes(rows), "bnodes"), "g", "left").join(count(out, "out_triples"), "g", "left").join(count(graphs.bnodes(out), "out_bnodes"), "g", "left").join(work, "g", "left")
        .select("g", "triples", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bnodes", "out_triples", "out_bnodes")), *zero, F.coalesce("status", F.lit("OK")).alias("status"))
    )

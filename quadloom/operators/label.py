"""Canonical labels of blank nodes: equal outputs just for isomorphic graphs.

All graphs are labelled in one job. Triples are gathered by component of blank
nodes, and many components at a time are refined and, where needed, searched
(operators.search). Labels are then made distinct between isomorphic components and
between graphs by hashing in the component's and the graph's hash.

Defined results: rows with a null are left out, repeated rows count once, blank
predicates are an error; graphs without blank nodes come out unchanged; an empty
input gives empty results; only the columns g, s, p, o are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.hashing import WIDTH, blank_hash, combine_ordered, combine_unordered, fold, hexed, int_hash, rows_of
from quadloom.functions.terms import is_bnode
from quadloom.operators import graphs
from quadloom.operators.components import bnode_components, with_component
from quadloom.operators.groups import codes_of, map_groups
from quadloom.operators.ranks import number_within
from quadloom.operators.refine import refine_large
from quadloom.operators.search import Chunk, graph_hash, hash_terms, search
from quadloom.runtime import cut_lineage

_NODES = "g string, comp string, node string, h string, gh string, triples bigint, bnodes bigint, rounds bigint, leaves bigint, distinct_leaves bigint, status string"


@dataclass
class Labelling:
    """Canonical triples (g, s, p, o); labels (g, node, label); parts, one row a component; graphs (g, ghash).

    Labels are made when they or the triples are first asked for; `rows` and `named` are what they are made of.
    """

    rows: DataFrame
    named: DataFrame
    parts: DataFrame
    graphs: DataFrame

    @cached_property
    def labels(self) -> DataFrame:
        return cut_lineage(self.named)

    @cached_property
    def triples(self) -> DataFrame:
        mapping = self.labels.select("g", F.col("node").alias("bnode"), F.concat(F.lit("_:"), "label").alias("term"))
        return graphs.apply_map(self.rows, mapping)

    @property
    def stats(self) -> DataFrame:
        """(g, bnodes, parts, rounds, leaves, distinct_leaves, status) of every graph with blank nodes."""
        bad = F.max(F.when(F.col("status") != "OK", F.col("status")))
        return self.parts.groupBy("g").agg(
            F.sum("bnodes").alias("bnodes"), F.count(F.lit(1)).alias("parts"), F.sum("rounds").alias("rounds"),
            F.sum("leaves").alias("leaves"), F.sum("distinct_leaves").alias("distinct_leaves"), F.coalesce(bad, F.lit("OK")).alias("status"),
        )


def chunk_of(table: pa.Table, scheme: str, start: str | None = None) -> tuple[Chunk, pa.Table, np.ndarray, np.ndarray]:
    """The table's triples as a chunk, its nodes (part, node) in order, the part of each row, and the nodes' starting colours."""
    part = codes_of(table["g"], table["comp"]) if table.num_rows else np.zeros(0, np.int64)
    part = np.unique(part, return_inverse=True)[1]
    s, o = table["s"].combine_chunks(), table["o"].combine_chunks()
    ends = []
    for terms in (s, o):
        blank = pc.starts_with(terms, "_:")
        ends.append((terms, blank.to_numpy(zero_copy_only=False)))
    rows = np.concatenate([np.flatnonzero(b) for _, b in ends])
    names = pa.concat_arrays([t.filter(pa.array(b)) for t, b in ends])
    keys = pa.table({"part": pa.array(part[rows]), "node": names})
    nodes = keys.group_by(["part", "node"]).aggregate([]).sort_by([("part", "ascending"), ("node", "ascending")])
    at = keys.append_column("row", pa.array(np.arange(len(rows)))).join(nodes.append_column("i", pa.array(np.arange(nodes.num_rows))), ["part", "node"]).sort_by("row")["i"].to_numpy()
    numbers, done = [], 0
    for _, b in ends:
        n = np.full(table.num_rows, -1)
        n[b] = at[done : done + int(b.sum())]
        done += int(b.sum())
        numbers.append(n)
    hashes = []
    for c in (s, table["p"].combine_chunks(), o):
        coded = c.dictionary_encode()
        hashes.append(hash_terms(coded.dictionary.to_pylist(), scheme)[coded.indices.to_numpy()])
    chunk = Chunk(nodes.num_rows, numbers[0], numbers[1], *hashes, nodes["part"].to_numpy(), scheme)
    colours = np.tile(rows_of([blank_hash(scheme)], WIDTH[scheme]), (nodes.num_rows, 1))
    if start is not None:
        of_node = np.zeros_like(colours)
        for i, c in ((0, "hs0"), (1, "ho0")):
            there = numbers[i] >= 0
            if there.any():
                of_node[numbers[i][there]] = rows_of([bytes.fromhex(x) for x in table[c].filter(pa.array(there)).to_pylist()], WIDTH[scheme])
        colours = of_node
    return chunk, nodes, part, colours


def _labeller(scheme: str, prune: bool, timeout: float, refined: bool = False):
    def run(table: pa.Table) -> pa.Table:
        chunk, nodes, part, colours = chunk_of(table, scheme, "h" if refined else None)
        colours, count, rounds, broken = chunk.refine(colours)
        sizes = np.bincount(chunk.part, minlength=len(count))
        leaves, distinct = np.ones(len(count), np.int64), np.ones(len(count), np.int64)
        status = np.where(broken, "COLLISION", "OK").astype(object)
        texts = None
        for c in np.flatnonzero((count < sizes) & ~broken):
            own_rows, own_nodes = np.flatnonzero(part == c), np.flatnonzero(chunk.part == c)
            alone = chunk.alone(c, own_rows, own_nodes)
            if texts is None:
                texts = [table[k].to_pylist() for k in "spo"]

            def leaf_of(h: np.ndarray, alone=alone, own_rows=own_rows):
                name = [f"_:SK00{x}" for x in hexed(h)]
                end = lambda i, k, at: name[at[i]] if at[i] >= 0 else texts[k][own_rows[i]]
                return tuple(sorted({(end(i, 0, alone.s), texts[1][own_rows[i]], end(i, 2, alone.o)) for i in range(len(own_rows))}))

            found = search(alone, colours[own_nodes], lambda h, f=leaf_of: (len(x := f(h)), x), prune, time.monotonic() + timeout, int(rounds[c]))
            colours[own_nodes] = found.colours
            rounds[c], leaves[c], distinct[c], status[c] = found.rounds, found.leaves, found.distinct_leaves, found.status
        gh = np.array(hexed(graph_hash(chunk, colours)), object)
        first = np.unique(part, return_index=True)[1]
        p = chunk.part
        of_part = lambda k: pc.take(table[k].combine_chunks(), pa.array(first[p]))
        counts = np.bincount(part, minlength=len(count))
        return pa.table({
            "g": of_part("g"), "comp": of_part("comp"), "node": nodes["node"], "h": pa.array(hexed(colours)), "gh": pa.array(gh[p], pa.string()),
            "triples": counts[p], "bnodes": sizes[p], "rounds": rounds[p], "leaves": leaves[p], "distinct_leaves": distinct[p], "status": pa.array(status[p], pa.string()),
        })

    return run


def _int_hashes(column: Column, scheme: str) -> Column:
    @F.pandas_udf(T.StringType())
    def hashed(values: pd.Series) -> pd.Series:
        known = {v: int_hash(int(v), scheme).hex() for v in values.unique()}
        return values.map(known)

    return hashed(column)


def triple_sums(triples: DataFrame, scheme: str) -> DataFrame:
    """(g, sum): unordered combination of the blank hash and every ground triple's hash.

    Tasks add up their own triples by graph before anything is shuffled.
    """
    width = WIDTH[scheme]

    def partial(batches):
        for batch in batches:
            hashes = []
            for k in "spo":
                coded = batch.column(k).dictionary_encode()
                hashes.append(hash_terms(coded.dictionary.to_pylist(), scheme)[coded.indices.to_numpy()])
            graph = batch.column("g").dictionary_encode()
            total = np.zeros((len(graph.dictionary), width), np.int64)
            np.add.at(total, graph.indices.to_numpy(), fold(*hashes).astype(np.int64))
            yield pa.RecordBatch.from_arrays([graph.dictionary, *(pa.array(total[:, i] % 256) for i in range(width))], names=["g", *(f"b{i}" for i in range(width))])

    lanes = triples.select("g", "s", "p", "o").mapInArrow(partial, "g string, " + ", ".join(f"b{i} bigint" for i in range(width)))
    blank = blank_hash(scheme)
    total = lambda i: F.lower(F.lpad(F.hex((F.sum(f"b{i}") + blank[i]) % 256), 2, "0"))
    return lanes.groupBy("g").agg(F.concat(*(total(i) for i in range(width))).alias("sum"))


def canonicalise(
    triples: DataFrame,
    scheme: str = "md5",
    distinguish_iso: bool = True,
    unique_per_graph: bool = True,
    prune: bool = True,
    timeout: float = 600.0,
    max_chunk_triples: int = 500_000,
) -> Labelling:
    """Label the blank nodes of all graphs of (g, s, p, o).

    `distinguish_iso` keeps isomorphic components of a graph apart; without it
    they merge. `unique_per_graph` makes labels depend on the whole graph; without
    it isomorphic components have the same labels in every graph. Components with
    more than `max_chunk_triples` triples are refined by joins before the search.
    A component that isn't settled within `timeout` seconds has the status
    `TIMEOUT` and labels that aren't canonical.
    """
    rows = cut_lineage(graphs.normalise(triples))
    components = cut_lineage(bnode_components(rows))
    placed = with_component(rows, components)
    sizes = placed.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_chunk_triples).select("g", "comp")
    if sizes.isEmpty():
        found = map_groups(placed, ["g", "comp"], _labeller(scheme, prune, timeout), _NODES, then_by=("s", "p", "o"))
    else:
        # Few components can be that large; the rest doesn't wait for them.
        large = cut_lineage(placed.join(F.broadcast(sizes), ["g", "comp"], "left_semi"))
        small = placed.join(F.broadcast(sizes), ["g", "comp"], "left_anti")
        refined = refine_large(large, scheme)
        coloured = large
        for end in ("s", "o"):
            coloured = coloured.join(refined.select("g", F.col("node").alias(end), F.col("h").alias(f"h{end}0")), ["g", end], "left")
        found = map_groups(small, ["g", "comp"], _labeller(scheme, prune, timeout), _NODES, then_by=("s", "p", "o")).unionByName(
            map_groups(coloured, ["g", "comp"], _labeller(scheme, prune, timeout, refined=True), _NODES, then_by=("s", "p", "o"))
        )
    nodes = cut_lineage(found)
    # A component is named after its least node, so each has just one such row.
    parts = nodes.filter(F.col("node") == F.col("comp")).drop("node", "h").withColumn("c0", combine_ordered("gh", F.lit(int_hash(0, scheme).hex())))
    same = ["g", "c0", "triples", "bnodes"]
    if distinguish_iso:
        ranked = number_within(parts, same, "copy")
        mux = F.when(F.col("copy") == 1, 0).otherwise(F.col("copy")).cast("int")
        parts = cut_lineage(ranked.withColumn("c", combine_ordered("gh", _int_hashes(mux, scheme))))
        kept = parts
    else:
        parts = cut_lineage(parts.withColumn("copy", F.lit(1).cast("bigint")).withColumn("c", F.col("c0")))
        kept = parts.dropDuplicates(same)
    colours = nodes.select("g", "comp", "node", "h").join(parts.select("g", "comp", "c"), ["g", "comp"])
    colours = colours.select("g", "node", combine_ordered("h", "c").alias("h"))
    everything = rows.select("g").distinct()
    ground_sum = everything.join(triple_sums(graphs.ground(rows), scheme), "g", "left").select("g", F.coalesce("sum", F.lit(blank_hash(scheme).hex())).alias("c"))
    by_graph = kept.select("g", "c").unionByName(ground_sum).groupBy("g").agg(combine_unordered("c", scheme).alias("ghash"))
    by_graph = cut_lineage(by_graph)
    if unique_per_graph:
        colours = colours.join(by_graph, "g").select("g", "node", combine_ordered("h", "ghash").alias("h"))
    return Labelling(rows, colours.select("g", "node", F.concat(F.lit("SK00"), "h").alias("label")), parts, by_graph)


def output_labels(labelling: Labelling, prefix: str = "", as_bnode: bool = True) -> DataFrame:
    """The canonical triples with prefixed labels, as blank nodes or IRIs."""
    return graphs.skolemised(labelling.triples, prefix, as_bnode)


def collisions(labelling: Labelling) -> DataFrame:
    """(g, nodes, labels) of graphs with fewer labels than labelled nodes, none unless hashes collide or copies were merged."""
    counts = labelling.labels.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("label").alias("labels"))
    return counts.filter(F.col("nodes") != F.col("labels"))


def isomorphic_graphs(labelling: Labelling) -> DataFrame:
    """(ghash, graphs, n): classes of two and more isomorphic graphs, the largest first."""
    classes = labelling.graphs.groupBy("ghash").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("g")).alias("graphs"))
    return classes.filter(F.col("n") > 1).orderBy(F.desc("n"), F.element_at("graphs", 1)).select("ghash", "graphs", "n")


__all__ = ["Labelling", "canonicalise", "chunk_of", "collisions", "is_bnode", "isomorphic_graphs", "output_labels", "triple_sums"]

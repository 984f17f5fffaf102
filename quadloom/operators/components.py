"""Split graphs into components of blank nodes that triples link.

Components never cross graphs. Graphs of up to `max_graph_links` links (all but a
few) are solved whole where their links are gathered, in NumPy, many graphs at a
time. Larger graphs are contracted by joins first: every node takes its least
neighbour as parent, parents are followed by pointer doubling, and links between
the roots remain, round by round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.operators.groups import map_groups
from quadloom.runtime import cut_lineage, release

_SCHEMA = "g string, node string, comp string"


def least_of_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each of `n` nodes' component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while not np.array_equal(jump := root[root], root):
            root = jump
        if np.array_equal(before, root):
            return root


def _solve(table: pa.Table) -> pa.Table:
    n = table.num_rows
    ends = pa.table({"g": pa.concat_arrays([*table["g"].chunks, *table["g"].chunks]), "node": pa.concat_arrays([*table["a"].chunks, *table["b"].chunks])})
    distinct = ends.group_by(["g", "node"]).aggregate([]).sort_by([("g", "ascending"), ("node", "ascending")])
    distinct = distinct.append_column("i", pa.array(np.arange(distinct.num_rows)))
    ends = ends.append_column("row", pa.array(np.arange(2 * n)))
    at = ends.join(distinct, ["g", "node"]).sort_by("row")["i"].to_numpy()
    root = least_of_components(distinct.num_rows, at[:n], at[n:])
    return pa.table({"g": distinct["g"], "node": distinct["node"], "comp": pc.take(distinct["node"], pa.array(root))})


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node, up): a parent for each linked node that isn't its neighbourhood's least; and the links between roots."""
    both = links.select("g", F.col("a").alias("node"), F.col("b").alias("n")).unionByName(links.select("g", F.col("b").alias("node"), F.col("a").alias("n")))
    up = cut_lineage(both.groupBy("g", "node").agg(F.min("n").alias("up")).filter(F.col("up") < F.col("node")))
    while True:
        further = up.select("g", F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = up.join(further, ["g", "up"], "left").select("g", "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        new = cut_lineage(jumped)
        release(up)
        up = new.drop("moved")
        up._cut_path = new._cut_path
        if new.filter("moved").isEmpty():
            break
    a = up.select("g", F.col("node").alias("a"), F.col("up").alias("ra"))
    b = up.select("g", F.col("node").alias("b"), F.col("up").alias("rb"))
    moved = links.join(a, ["g", "a"], "left").join(b, ["g", "b"], "left").select("g", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return up, cut_lineage(moved.filter(F.col("a") != F.col("b")).distinct())


def _largest(links: DataFrame) -> int:
    return links.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def components_of_links(links: DataFrame, max_graph_links: int = 2_000_000) -> DataFrame:
    """(g, node, comp) of every end of a link (g, a, b); comp is the least node by string order.

    Rows with a null are left out, links of a node with itself are kept as nodes.
    """
    links = links.select("g", "a", "b").dropna().distinct()
    sizes = links.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > max_graph_links).select("g")
    # There are at most links / max_graph_links large graphs; a first look saves the rest of the work where there are none.
    if large.isEmpty():
        return map_groups(links, ["g"], _solve, _SCHEMA)
    small = map_groups(links.join(F.broadcast(large), "g", "left_anti"), ["g"], _solve, _SCHEMA)
    rest = cut_lineage(links.join(F.broadcast(large), "g", "left_semi"))
    nodes = rest.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    ups = []
    while _largest(rest) > max_graph_links:
        up, rest = _contract(rest)
        ups.append(up)
    top = map_groups(rest, ["g"], _solve, _SCHEMA).withColumnsRenamed({"node": "at", "comp": "c"})
    found = nodes.withColumn("at", F.col("node"))
    for up in ups:
        found = found.join(up.select("g", F.col("node").alias("at"), "up"), ["g", "at"], "left").select("g", "node", F.coalesce("up", "at").alias("at"))
    return small.unionByName(found.join(top, ["g", "at"], "left").select("g", "node", F.coalesce("c", "at").alias("comp")))


def bnode_components(triples: DataFrame, max_graph_links: int = 2_000_000) -> DataFrame:
    """(g, node, comp) of every blank node of (g, s, p, o); a blank node without blank neighbours is alone."""
    s, o = is_bnode("s"), is_bnode("o")
    ends = triples.select("g", F.when(s, F.col("s")).otherwise(F.col("o")).alias("a"), F.when(o, F.col("o")).otherwise(F.col("s")).alias("b")).filter(is_bnode("a") & is_bnode("b"))
    return components_of_links(ends, max_graph_links)


def with_component(triples: DataFrame, components: DataFrame) -> DataFrame:
    """The triples that hold a blank node, with `comp`: that of the subject if it is a blank node, else of the object."""
    node = F.when(is_bnode("s"), F.col("s")).when(is_bnode("o"), F.col("o"))
    return triples.withColumn("node", node).filter(F.col("node").isNotNull()).join(components, ["g", "node"]).drop("node")

"""Edge sets of nodes, containment joins between them, and what leaning does with these.

An edge of a node is a string of direction (`+` if the node is the subject),
predicate and neighbour. Edge sets are compared by mergeable signatures or by
counting joined rows, so that a hub is no special case; candidates and the first
round of leaning gather small sets (operators.contain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.operators.contain import MOST, best_supersets, contained_sets, edge_sets
from quadloom.operators.gather import edges_of, ground_kinds, ground_table, hashed_sets
from quadloom.runtime import cut_lineage, release

_SEP = "\u0001"
#: Neighbour of the edges that stand for any edge with their direction and predicate; no term.
ANY = "\u0002any"


def _edge(sign: str, p: Column | str, v: Column | str) -> Column:
    return F.concat(F.lit(sign), F.col(p) if isinstance(p, str) else p, F.lit(_SEP), F.col(v) if isinstance(v, str) else v)


def node_edges(triples: DataFrame) -> DataFrame:
    """(g, node, e): the distinct edges of every term of the graph; read by `e` it is the index of nodes by edge."""
    both = F.explode(F.array(F.struct(F.col("s").alias("node"), _edge("+", "p", "o").alias("e")), F.struct(F.col("o").alias("node"), _edge("-", "p", "s").alias("e"))))
    return triples.select("g", both.alias("x")).select("g", "x.node", "x.e").distinct()


def _known_ends(triples: DataFrame, fixed: DataFrame) -> DataFrame:
    """(g, node, sign, p, v, known): both ends of each triple, and whether the neighbour `v` is no unfixed blank node."""
    f = fixed.select("g", F.col("bnode").alias("v"), F.lit(True).alias("is_fixed"))
    ends = F.explode(F.array(
        F.struct(F.lit("+").alias("sign"), F.col("s").alias("node"), F.col("o").alias("v")),
        F.struct(F.lit("-").alias("sign"), F.col("o").alias("node"), F.col("s").alias("v")),
    ))
    all_ends = triples.select("g", "p", ends.alias("x")).select("g", "p", "x.*").join(f, ["g", "v"], "left")
    return all_ends.select("g", "node", "sign", "p", "v", (~is_bnode("v") | F.col("is_fixed").isNotNull()).alias("known"))


def ground_edges(triples: DataFrame, fixed: DataFrame) -> DataFrame:
    """(g, node, e): edges whose neighbour is no unfixed blank node, and one edge to ANY for each direction and predicate."""
    own, some = F.concat("sign", "p", F.lit(_SEP), "v"), F.concat("sign", "p", F.lit(_SEP + ANY))
    return _known_ends(triples, fixed).select("g", "node", F.explode(F.when(F.col("known"), F.array(own, some)).otherwise(F.array(some))).alias("e")).distinct()


def edge_signatures(edges: DataFrame) -> DataFrame:
    """(g, node, degree, sig1, sig2): equal just for equal edge sets, up to a 128-bit hash; combined map-side."""
    total = lambda x: F.sum(x.cast("decimal(38,0)"))
    return edges.groupBy("g", "node").agg(
        F.count(F.lit(1)).alias("degree"), total(F.xxhash64("e")).alias("sig1"), total(F.xxhash64(F.lit("salt"), F.col("e"))).alias("sig2")
    )


def rarest_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, bnode, e, degree, n): the edge of each of `nodes` (g, bnode) that fewest nodes have, and how many do."""
    frequency = edges.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n"))
    own = edges.join(nodes.select("g", F.col("bnode").alias("node")), ["g", "node"], "left_semi").join(frequency, ["g", "e"])
    return own.groupBy("g", F.col("node").alias("bnode")).agg(F.min_by("e", F.struct("n", "e")).alias("e"), F.count(F.lit(1)).alias("degree"), F.min("n").alias("n"))


def contained_in(edges: DataFrame, nodes: DataFrame, degrees: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(g, bnode, term): terms, other than itself, whose edges include all edges of the node of `nodes`.

    Candidates share the node's rarest edge; they stay if as many of the node's
    edges are found with them as it has. A node with an edge that no other has is
    done at once. `degrees` (g, node, degree) asks for strictly more edges; `terms`
    (g, node) are the only terms looked at.
    """
    held = (edges if terms is None else edges.join(terms, ["g", "node"], "left_semi")).withColumnRenamed("node", "term")
    rare = rarest_edges(edges, nodes).filter(F.col("n") > 1).drop("n")
    pairs = rare.join(held, ["g", "e"]).filter(F.col("term") != F.col("bnode")).select("g", "bnode", "term", "degree")
    if degrees is not None:
        other = degrees.select("g", F.col("node").alias("term"), F.col("degree").alias("other"))
        pairs = pairs.join(other, ["g", "term"]).filter(F.col("other") > F.col("degree")).drop("other")
    wanted = pairs.join(edges.withColumnRenamed("node", "bnode"), ["g", "bnode"])
    there = wanted.join(held, ["g", "term", "e"], "left_semi")
    return there.groupBy("g", "bnode", "term", "degree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("degree")).select("g", "bnode", "term")


def predicate_counts(triples: DataFrame) -> DataFrame:
    """(g, p, triples, subjects, objects): cardinality and selectivity of each predicate."""
    return triples.groupBy("g", "p").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(g, bnode, term): `first` followed by `second`; what `second` doesn't map stays."""
    then = second.select("g", F.col("bnode").alias("term"), F.col("term").alias("last"))
    return first.join(then, ["g", "term"], "left").select("g", "bnode", F.coalesce("last", "term").alias("term"))


def closed(mapping: DataFrame) -> DataFrame:
    """The transitive closure of an acyclic map, by pointer doubling."""
    now = cut_lineage(mapping.select("g", "bnode", "term"))
    while True:
        then = now.select("g", F.col("bnode").alias("term"), F.col("term").alias("last"))
        new = cut_lineage(now.join(then, ["g", "term"], "left").select("g", "bnode", F.coalesce("last", "term").alias("term"), F.col("last").isNotNull().alias("moved")))
        release(now)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")
        now._cut_path = new._cut_path


def redundant(triples: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(g, bnode, term): blank nodes whose edges another term has too, and that term.

    Of nodes with equal edges, a non-blank one or else the least blank one stays;
    the others map to it. The nodes that stay map to one with strictly more
    edges, the one with most of them, then the least. Only nodes of `changed`
    (g, bnode), those that lost edges, need be looked at for the latter.
    """
    edges = cut_lineage(node_edges(triples))
    signed = cut_lineage(edge_signatures(edges))
    classes = signed.groupBy("g", "degree", "sig1", "sig2").agg(F.min(F.struct(is_bnode("node").alias("b"), "node")).alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    kept = signed.filter(is_bnode("node")).join(classes, ["g", "degree", "sig1", "sig2"], "left")
    kept = cut_lineage(kept.select("g", F.col("node").alias("bnode"), F.coalesce("least.node", "node").alias("term")))
    equal = kept.filter(F.col("bnode") != F.col("term"))
    stay = kept.filter(F.col("bnode") == F.col("term")).select("g", "bnode")
    if changed is not None:
        stay = stay.join(changed.select("g", "bnode"), ["g", "bnode"], "left_semi")
    larger = contained_in(edges, stay, signed)
    degrees = signed.select("g", F.col("node").alias("term"), F.col("degree").alias("d"))
    best = larger.join(degrees, ["g", "term"]).groupBy("g", "bnode").agg(F.min_by("term", F.struct(-F.col("d"), F.col("term"))).alias("term"))
    return equal.unionByName(best)


def _redundant_by_large(held: DataFrame) -> DataFrame:
    """(g, bnode, term, n, equal): blank nodes of a node table whose edges a large node has too, that node, its degree, and whether it has no others; by joins."""
    edges = cut_lineage(edges_of(held).distinct())
    signed = cut_lineage(edge_signatures(edges))
    large = held.filter("large").select("g", "node").distinct()
    sized = cut_lineage(signed.join(large, ["g", "node"], "left_semi"))
    classes = sized.groupBy("g", "degree", "sig1", "sig2").agg(F.min(F.struct(is_bnode("node").alias("b"), "node")).alias("least"))
    kept = sized.filter(is_bnode("node")).join(classes, ["g", "degree", "sig1", "sig2"]).select("g", F.col("node").alias("bnode"), F.col("least.node").alias("term"), F.col("degree").alias("n"))
    equal = kept.filter(F.col("bnode") != F.col("term"))
    stay = signed.filter(is_bnode("node")).select("g", F.col("node").alias("bnode")).join(equal, ["g", "bnode"], "left_anti")
    larger = contained_in(edges, stay, signed, sized.select("g", "node"))
    larger = larger.join(sized.select("g", F.col("node").alias("term"), F.col("degree").alias("n")), ["g", "term"])
    return equal.withColumn("equal", F.lit(True)).unionByName(larger.withColumn("equal", F.lit(False)))


def redundant_nodes(nodes: DataFrame, triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """(g, bnode, term): as `redundant`, from a node table, its triples and its kinds of edges.

    Of ground terms only edges with a direction and predicate that blank nodes have
    too are looked at and counted. Sets of up to MOST edges meet at a rare edge.
    """
    held = nodes.filter(is_bnode("node"))
    shared = cut_lineage(ground_kinds(kinds))
    if not shared.isEmpty():
        held = held.unionByName(cut_lineage(ground_table(triples, shared)))
    found = best_supersets(hashed_sets(held))
    if not held.filter("large").isEmpty():
        found = found.unionByName(_redundant_by_large(held))
    return found.groupBy("g", "bnode").agg(F.min_by("term", F.struct(~F.col("equal"), -F.col("n"), F.col("term"))).alias("term"))


def _others(triples: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g, bnode, term): candidates of the unfixed blank nodes other than themselves; those nodes (g, bnode); the table that both read."""
    hashed = lambda *c: F.xxhash64("g", "sign", "p", *c)
    ends = _known_ends(triples, fixed).select("g", "node", F.when(F.col("known"), hashed(F.col("v"))).alias("known"), hashed(F.lit(ANY)).alias("any"))
    sets = cut_lineage(edge_sets(ends))
    free = sets.filter(is_bnode("node")).select("g", F.col("node").alias("bnode")).join(fixed.select("g", "bnode"), ["g", "bnode"], "left_anti")
    found = contained_sets(sets)
    large = sets.filter(F.size("e") > MOST).select("g", "node")
    if not large.isEmpty():
        found = found.unionByName(contained_in(cut_lineage(ground_edges(triples, fixed)), free, terms=large))
    return found.join(fixed.select("g", "bnode"), ["g", "bnode"], "left_anti"), free, sets


def candidates(triples: DataFrame, fixed: DataFrame) -> DataFrame:
    """(g, bnode, term): what each unfixed blank node could map to as far as known edges tell, itself included."""
    others, free, _ = _others(triples, fixed)
    return others.unionByName(free.select("g", "bnode", F.col("bnode").alias("term")))


def fix_bnodes(triples: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of the unfixed blank nodes, and the fixed ones (g, bnode).

    A blank node with no candidate but itself is fixed; its edges then count as
    known for its neighbours, which may fix them, until nothing changes. Nothing
    can change where no unfixed blank node is linked to one just fixed.
    """
    from quadloom.operators.graphs import bnode_links

    fixed = triples.select("g", F.col("s").alias("bnode")).filter(F.lit(False))
    links = cut_lineage(bnode_links(triples))
    near = links.select("g", F.col("s").alias("bnode"), F.col("o").alias("far")).unionByName(links.select("g", F.col("o").alias("bnode"), F.col("s").alias("far")))
    linked = not links.isEmpty()
    done = 0
    while True:
        others, free, sets = _others(triples, fixed)
        others = cut_lineage(others)
        alone = cut_lineage(free.join(others.select("g", "bnode"), ["g", "bnode"], "left_anti"))
        release(sets)
        done += 1
        found = others.unionByName(others.select("g", "bnode").distinct().unionByName(alone).select("g", "bnode", F.col("bnode").alias("term")))
        if done == max_rounds or alone.isEmpty():
            return found, fixed
        fixed = cut_lineage(fixed.unionByName(alone)) if done > 1 else alone
        changed = near.join(alone, ["g", "bnode"], "left_semi").select("g", F.col("far").alias("bnode"))
        if not linked or changed.join(fixed, ["g", "bnode"], "left_anti").isEmpty():
            return others.unionByName(others.select("g", "bnode").distinct().select("g", "bnode", F.col("bnode").alias("term"))), fixed

"""Projections, filters and set operations on graphs as rows (g, s, p, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode, skolem

TRIPLE = ["g", "s", "p", "o"]


def checked(triples: DataFrame) -> DataFrame:
    """Rows without nulls. Blank predicates are an error."""
    p = F.when(is_bnode("p"), F.raise_error(F.concat(F.lit("blank predicate: "), F.col("p")))).otherwise(F.col("p"))
    return triples.select(*TRIPLE).dropna().select("g", "s", p.alias("p"), "o")


def normalise(triples: DataFrame) -> DataFrame:
    """Distinct rows without nulls, as RDF graphs are sets. Blank predicates are an error."""
    return checked(triples).distinct()


def is_ground() -> Column:
    """Neither subject nor object is a blank node."""
    return ~is_bnode("s") & ~is_bnode("o")


def ground(triples: DataFrame) -> DataFrame:
    return triples.filter(is_ground())


def unground(triples: DataFrame) -> DataFrame:
    return triples.filter(~is_ground())


def bnode_links(triples: DataFrame) -> DataFrame:
    """Triples that link two different blank nodes."""
    return triples.filter(is_bnode("s") & is_bnode("o") & (F.col("s") != F.col("o")))


def query_patterns(triples: DataFrame, fixed: DataFrame) -> DataFrame:
    """Triples, loops included, whose ends are both blank nodes not in `fixed` (g, bnode)."""
    both = triples.filter(is_bnode("s") & is_bnode("o"))
    return both.join(fixed.select("g", F.col("bnode").alias("s")), ["g", "s"], "left_anti").join(fixed.select("g", F.col("bnode").alias("o")), ["g", "o"], "left_anti").select(*TRIPLE)


def bnodes(triples: DataFrame) -> DataFrame:
    """(g, bnode): the distinct blank nodes."""
    ends = F.explode(F.filter(F.array("s", "o"), lambda t: t.startswith("_:")))
    return triples.select("g", ends.alias("bnode")).distinct()


def count_bnodes(triples: DataFrame) -> DataFrame:
    """(g, bnodes) of every graph, 0 for those without."""
    counts = bnodes(triples).groupBy("g").agg(F.count(F.lit(1)).alias("bnodes"))
    return triples.select("g").distinct().join(counts, "g", "left").select("g", F.coalesce("bnodes", F.lit(0)).alias("bnodes"))


def split_by_bnodes(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples of graphs with blank nodes, and those of graphs without, which pass every operator unchanged."""
    with_any = unground(triples).select("g").distinct()
    return triples.join(with_any, "g", "left_semi"), triples.join(with_any, "g", "left_anti")


def apply_map(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples with subject and object replaced by (g, bnode, term); terms that aren't mapped stay. Distinct."""
    m = mapping.select("g", "bnode", "term")
    found = triples
    for end in ("s", "o"):
        found = found.join(m.withColumnsRenamed({"bnode": end, "term": f"{end}_to"}), ["g", end], "left")
    return found.select("g", F.coalesce("s_to", "s").alias("s"), "p", F.coalesce("o_to", "o").alias("o")).distinct()


def is_identity(mapping: DataFrame) -> bool:
    return mapping.filter(F.col("bnode") != F.col("term")).isEmpty()


def skolemised(triples: DataFrame, prefix: str = "", as_bnode: bool = True) -> DataFrame:
    """Blank nodes as prefixed blank nodes or IRIs."""
    return triples.select("g", skolem("s", prefix, as_bnode).alias("s"), "p", skolem("o", prefix, as_bnode).alias("o"))


def symmetrised(links: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) in both directions, distinct."""
    both = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))
    return links.select(both.alias("e")).select("e.a", "e.b").distinct()


def renamed(triples: DataFrame, seed: int = 0) -> DataFrame:
    """Blank nodes renamed at random, distinct within each graph, and rows in random order."""
    names = bnodes(triples).withColumn("term", F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(str(seed)), "g", "bnode"), 256), 1, 32)))
    return apply_map(triples, names).orderBy(F.rand(seed))


def difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in `a`, and only in `b`, as sets."""
    return a.select(*TRIPLE).subtract(b.select(*TRIPLE)), b.select(*TRIPLE).subtract(a.select(*TRIPLE))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*TRIPLE).unionByName(b.select(*TRIPLE)).distinct()


def same_graphs(a: DataFrame, b: DataFrame) -> bool:
    left, right = difference(a, b)
    return left.isEmpty() and right.isEmpty()


def contains(a: DataFrame, b: DataFrame) -> bool:
    """Are all rows of `b` in `a`?"""
    return difference(a, b)[1].isEmpty()


def without_nodes(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples that touch none of `nodes` (g, bnode)."""
    return triples.join(nodes.select("g", F.col("bnode").alias("s")), ["g", "s"], "left_anti").join(nodes.select("g", F.col("bnode").alias("o")), ["g", "o"], "left_anti").select(*TRIPLE)

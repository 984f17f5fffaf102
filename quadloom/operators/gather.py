"""Graphs as one row a node, with the node's edges in one text.

A triple is held by its blank nodes, or by its subject if both ends are ground. So
the distinct triples, the edge sets of all blank nodes and what is left when some go
are read from one table, which is shuffled by nodes and not by triples. A text holds
up to `MOST` edges; a node with more has several rows, marked `large`, in which edges
may recur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.operators.contain import MOST
from quadloom.operators.groups import codes_of

#: Between predicate and neighbour; between edges; before the letter that stands for one of the three in a term.
_SEP, _NEXT, _ESCAPE = "\u0001", "\u0002", "\u0003"
_ESCAPED = ((_ESCAPE, "c"), (_SEP, "a"), (_NEXT, "b"))
_SCHEMA = "g string, node string, edges string, large boolean"


def _escaped(terms: pa.Array) -> pa.Array:
    for c, letter in _ESCAPED:
        if pc.any(pc.match_substring(terms, c)).as_py():
            terms = pc.replace_substring(terms, c, _ESCAPE + letter)
    return terms


def _plain(text: Column) -> Column:
    plain = text
    for c, letter in reversed(_ESCAPED):
        plain = F.replace(plain, F.lit(_ESCAPE + letter), F.lit(c))
    return F.when(text.contains(_ESCAPE), plain).otherwise(text)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, node, k, v) to rows with the distinct edges of a node in the batch, up to MOST in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g, node = batch.column("g"), batch.column("node")
        edge = pc.binary_join_element_wise(_escaped(batch.column("k")), _escaped(batch.column("v")), _SEP)
        first, of = np.unique(codes_of(g, node), return_index=True, return_inverse=True)[1:]
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        of = rank[of.ravel()]
        which = edge.dictionary_encode().indices.to_numpy().astype(np.int64)
        at = np.sort(np.unique(of * (which.max() + 1) + which, return_index=True)[1])
        at = at[np.argsort(of[at], kind="stable")]
        of = of[at]
        sizes = np.bincount(of, minlength=len(first))
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins = np.flatnonzero(place % MOST == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), edge.take(pa.array(at)))
        rows = pa.array(at[begins])
        yield pa.RecordBatch.from_arrays([g.take(rows), node.take(rows), pc.binary_join(lists, _NEXT)], names=["g", "node", "edges"])


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of nodes to a row a node, or to rows marked `large`."""
    key: tuple[str, str] | None = None
    held: dict[str, None] = {}
    large = False
    out: list[tuple[str, str, str, bool]] = []

    def made() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["g", "node", "edges", "large"])
        out.clear()
        return rows

    for batch in batches:
        if not batch.num_rows:
            continue
        code = codes_of(batch.column("g"), batch.column("node"))
        begins = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
        sizes = np.diff(np.append(begins, len(code)))
        alone = sizes == 1
        alone[[0, -1]] = False
        for begin, size in zip(begins[~alone].tolist(), sizes[~alone].tolist(), strict=True):
            rows = batch.slice(begin, size)
            own = rows.column("g")[0].as_py(), rows.column("node")[0].as_py()
            if own != key:
                if held:
                    out.append((*key, _NEXT.join(held), large))
                key, held, large = own, {}, False
            for text in rows.column("edges").to_pylist():
                held.update(dict.fromkeys(text.split(_NEXT)))
                if large or len(held) > MOST:
                    out.append((*key, _NEXT.join(held), True))
                    held, large = {}, True
        single = batch.take(pa.array(begins[alone]))
        yield pa.RecordBatch.from_arrays([*single.columns, pa.array(np.zeros(single.num_rows, bool))], names=["g", "node", "edges", "large"])
        if out:
            yield made()
    if held:
        out.append((*key, _NEXT.join(held), large))
    if out:
        yield made()


def gather(ends: DataFrame) -> DataFrame:
    """(g, node, edges, large) of rows (g, node, k, v): the direction and predicate of an edge, and its neighbour."""
    return ends.mapInArrow(_near, "g string, node string, edges string").repartition("g", "node").sortWithinPartitions("g", "node").mapInArrow(_far, _SCHEMA)


def _end(sign: str, node: str, v: str) -> Column:
    return F.struct(F.col(node).alias("node"), F.concat(F.lit(sign), F.col("p")).alias("k"), F.col(v).alias("v"))


def node_table(triples: DataFrame) -> DataFrame:
    """(g, node, edges, large) of the blank nodes of (g, s, p, o), and of the subjects of ground triples."""
    held = F.when(is_bnode("s") & is_bnode("o"), F.array(_end("+", "s", "o"), _end("-", "o", "s"))).when(is_bnode("o"), F.array(_end("-", "o", "s"))).otherwise(F.array(_end("+", "s", "o")))
    return gather(triples.select("g", F.explode(held).alias("x")).select("g", "x.*"))


def ground_table(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """(g, node, edges, large) of ground terms, of their edges of `kinds` (k)."""
    both = triples.select("g", F.explode(F.array(_end("+", "s", "o"), _end("-", "o", "s"))).alias("x")).select("g", "x.*")
    return gather(both.filter(~is_bnode("node")).join(kinds, "k", "left_semi").select("g", "node", "k", "v"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """(g, node, e): the edges as texts, distinct but for those of large nodes."""
    return nodes.select("g", "node", F.explode(F.split("edges", _NEXT)).alias("e"))


def hashed_sets(nodes: DataFrame) -> DataFrame:
    """(g, node, e): the edges of nodes that aren't large as 64-bit hashes."""
    return nodes.filter(~F.col("large")).select("g", "node", F.transform(F.split("edges", _NEXT), lambda x: F.xxhash64("g", x)).alias("e"))


def _ends(nodes: DataFrame) -> DataFrame:
    """(g, node, k, v) of each edge."""
    return edges_of(nodes).select("g", "node", _plain(F.substring_index("e", _SEP, 1)).alias("k"), _plain(F.substring_index("e", _SEP, -1)).alias("v"))


def triples_of(nodes: DataFrame, any_large: bool) -> DataFrame:
    """The distinct triples (g, s, p, o) of a node table; one of two blank nodes is read at its subject."""

    def read(part: DataFrame) -> DataFrame:
        out = F.col("k").startswith("+")
        ends = _ends(part).filter(out | ~is_bnode("v"))
        return ends.select("g", F.when(out, F.col("node")).otherwise(F.col("v")).alias("s"), F.expr("substring(k, 2)").alias("p"), F.when(out, F.col("v")).otherwise(F.col("node")).alias("o"))

    if not any_large:
        return read(nodes)
    return read(nodes.filter(~F.col("large"))).unionByName(read(nodes.filter("large")).distinct())


def kinds_of(nodes: DataFrame) -> DataFrame:
    """(k, blank, blank_v, link): the directions and predicates of edges, of which ends, and whether they link two blank nodes; distinct."""
    blank, far = is_bnode("node"), is_bnode("v")
    return _ends(nodes).select("k", blank.alias("blank"), far.alias("blank_v"), (blank & far & (F.col("node") != F.col("v"))).alias("link")).distinct()


def ground_kinds(kinds: DataFrame) -> DataFrame:
    """(k): the directions and predicates that both blank nodes and ground terms have."""
    turned = F.concat(F.when(F.col("k").startswith("+"), "-").otherwise("+"), F.expr("substring(k, 2)"))
    ground = kinds.filter("not blank").select("k").unionByName(kinds.filter("not blank_v").select(turned.alias("k")))
    return ground.join(kinds.filter("blank").select("k"), "k", "left_semi").distinct()

"""Colour refinement by joins, for components too large for one task's memory.

A round joins each edge with its other end's colour and hashes the edge; edges are
then sorted by node and hash, and each node's sorted hashes are folded as they
stream by, so that a hub needs no more memory than any other node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.hashing import WIDTH, blank_hash, combine_ordered, hexed, mark, rows_of, term_hash
from quadloom.functions.terms import is_bnode
from quadloom.runtime import cut_lineage, release

_FOLDED = "g string, comp string, node string, h string"


def edge_hash_rows(placed: DataFrame, scheme: str) -> DataFrame:
    """(g, comp, node, other, static, hp, sign): each blank node's edges; `other` is null for ground ends, whose hash is `static`."""
    edge = lambda node, other, sign: F.struct(
        F.col(node).alias("node"), F.when(is_bnode(other), F.col(other)).alias("other"),
        F.when(~is_bnode(other), term_hash(other, scheme)).alias("static"), F.lit(mark(sign, scheme).hex()).alias("sign"),
    )
    both = placed.select("g", "comp", term_hash("p", scheme).alias("hp"), F.explode(F.array(edge("s", "o", "+"), edge("o", "s", "-"))).alias("e"))
    return both.select("g", "comp", "hp", "e.*").filter(is_bnode("node"))


def _folder(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        for batch in batches:
            hashes = rows_of([bytes.fromhex(h) for h in batch.column("eh").to_pylist()], width)
            out = []
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "comp", "node")), strict=True)):
                if k != key:
                    if key is not None:
                        out.append((*key, value))
                    key, value = k, np.zeros(width, np.uint8)
                value = (value * np.uint8(37)) ^ hashes[i]
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(*key, value)])

    return run


def _batch(rows: list) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(hexed(np.array([r[3] for r in rows])))], names=["g", "comp", "node", "h"])


def refine_round(edges: DataFrame, colours: DataFrame, scheme: str) -> DataFrame:
    """(g, comp, node, h): the next colour of every node."""
    far = colours.select("g", F.col("node").alias("other"), F.col("h").alias("far"))
    hashed = edges.join(far, ["g", "other"], "left").select("g", "comp", "node", combine_ordered(F.coalesce("far", "static"), "hp", "sign").alias("eh"))
    entries = hashed.unionByName(colours.select("g", "comp", "node", F.col("h").alias("eh")))
    return entries.repartition("g", "comp", "node").sortWithinPartitions("g", "comp", "node", "eh").mapInArrow(_folder(WIDTH[scheme]), _FOLDED)


def refine_large(placed: DataFrame, scheme: str = "md5", max_rounds: int | None = None) -> DataFrame:
    """(g, comp, node, h): the colours before the last round that split a class, of triples (g, comp, s, p, o).

    A component leaves the loop when its number of colours stops growing or all
    its nodes differ. Running one more round on these colours, as the search does
    first, tells the same classes.
    """
    edges = cut_lineage(edge_hash_rows(placed, scheme))
    colours = cut_lineage(edges.select("g", "comp", "node").distinct().withColumn("h", F.lit(blank_hash(scheme).hex())))
    count = lambda c: c.groupBy("g", "comp").agg(F.count_distinct("h").alias("n"), F.count(F.lit(1)).alias("nodes"))
    before = cut_lineage(count(colours))
    settled: list[DataFrame] = []
    done = 0
    while True:
        fresh = cut_lineage(refine_round(edges, colours, scheme))
        after = count(fresh).join(before.select("g", "comp", F.col("n").alias("was")), ["g", "comp"])
        after = cut_lineage(after.withColumn("stop", (F.col("n") == F.col("was")) | (F.col("n") == F.col("nodes"))))
        done += 1
        stop = after.filter("stop").select("g", "comp")
        settled.append(cut_lineage(colours.join(stop, ["g", "comp"], "left_semi")))
        going = after.filter(~F.col("stop")).select("g", "comp")
        if going.isEmpty() or done == max_rounds:
            break
        old, old_edges = colours, edges
        colours = cut_lineage(fresh.join(going, ["g", "comp"], "left_semi"))
        if not stop.isEmpty():
            edges = cut_lineage(edges.join(going, ["g", "comp"], "left_semi"))
            release(old_edges)
        release(old, fresh)
        before = after.select("g", "comp", "n")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def digest_round(triples: DataFrame, colours: DataFrame) -> DataFrame:
    """(g, node, h): the next colours in the `digest` mode, which stays in the JVM.

    A node's colour is the md5 of its old one, its number of edges and the sums of
    the four words of the edges' md5. Sums combine map-side, so hubs don't matter.
    """
    ends = F.explode(F.array(
        F.struct(F.col("s").alias("node"), F.col("o").alias("far"), F.lit("+").alias("sign")), F.struct(F.col("o").alias("node"), F.col("s").alias("far"), F.lit("-").alias("sign"))
    ))
    edges = triples.select("g", "p", ends.alias("e")).select("g", "p", "e.*").filter(is_bnode("node"))
    seen = edges.join(colours.select("g", F.col("node").alias("far"), "h"), ["g", "far"], "left")
    eh = F.md5(F.concat("sign", "p", F.lit("\u0001"), F.coalesce("h", F.md5("far"))))
    word = lambda i: F.sum(F.conv(F.substring("eh", 8 * i + 1, 8), 16, 10).cast("bigint"))
    sums = seen.select("g", "node", eh.alias("eh")).groupBy("g", "node").agg(F.count(F.lit(1)).alias("n"), *(word(i).alias(f"w{i}") for i in range(4)))
    text = F.concat_ws(",", "h", *(F.col(c).cast("string") for c in ("n", "w0", "w1", "w2", "w3")))
    return colours.join(sums, ["g", "node"]).select("g", "node", F.md5(text).alias("h"))


def digest_refine(triples: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Stable `digest` colours (g, node, h) of all blank nodes, and the rounds taken."""
    ends = F.explode(F.filter(F.array("s", "o"), lambda t: t.startswith("_:")))
    colours = cut_lineage(triples.select("g", ends.alias("node")).distinct().withColumn("h", F.md5(F.lit(""))))
    count = lambda c: c.groupBy("g").agg(F.count_distinct("h").alias("n")).agg(F.sum("n")).first()[0] or 0
    before, done = count(colours), 0
    while True:
        new = cut_lineage(digest_round(triples, colours))
        after, done = count(new), done + 1
        release(colours)
        colours = new
        if after == before or done == max_rounds:
            return colours, done
        before = after

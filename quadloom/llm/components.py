"""Consolidate pairwise links into groups by alternating large-star and small-star.

Nodes are numbered in the order of (g, label), so that the least number of a group
is its least label and the rounds move numbers only. An edge is a row (a, b) with
a > b. A round rewrites

* large-star: every neighbour larger than u is linked to the least of u and its neighbours;
* small-star: every neighbour not larger than u, and u, are linked to the least of them;

until each component is a star around its least node, which is then its group.
Rows never multiply, as both stars emit one row for each they read. Components
that a round left as they were are stars; they leave the rounds, so that late rounds
only read what still changes.

The least neighbours come from aggregations with map-side combining. The joins
that carry them back are guarded against hubs: nodes with over `hub_degree` edges
(there are at most edges / hub_degree of them) are looked up by broadcast, and
their rows are spread by the other end of the edge instead of meeting in one task.
Rounds are written to the shared checkpoint folder.

Defined results: links with a null in any part are left out, a link of a node to
itself makes the node known and links nothing; repeated and reversed links don't
matter; an empty table gives no rows; only the named columns are read. Order is
that of the strings' code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import cut_lineage, release


def _carry(rows: DataFrame, key: str, other: str, values: DataFrame, name: str, hub_degree: int) -> DataFrame:
    """`rows` with `name`, the value that `values` (node, degree, value) has for column `key`, null where it has none.

    Rows of hubs take it from a broadcast; for the join their key is replaced by
    one that matches nothing and differs by column `other`, so no task gets a hub.
    """
    hubs = values.filter(F.col("degree") > hub_degree).select(F.col("node").alias(key), F.col("value").alias("__hub"))
    known = rows.join(F.broadcast(hubs), key, "left").withColumn("__key", F.when(F.col("__hub").isNull(), F.col(key)).otherwise(-1 - F.col(other)))
    joined = known.join(values.select(F.col("node").alias("__key"), F.col("value").alias("__value")), "__key", "left")
    return joined.select(*rows.columns, F.coalesce("__hub", "__value").alias(name))


def star_roots(edges: DataFrame, hub_degree: int = 200_000, max_rounds: int = 60) -> tuple[DataFrame, int]:
    """(node, root) of every node of the edges (a, b), a > b >= 0, but the roots themselves, and the rounds taken.

    Raises an error after `max_rounds`; the method needs about log2(nodes) ** 2 at worst, and few in practice.
    """
    active, settled = cut_lineage(edges.select("a", "b")), []
    for done in range(max_rounds):
        if active.isEmpty():
            break
        below = active.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("value"), F.count(F.lit(1)).alias("degree"))
        # Only a node with a smaller neighbour has another least one than itself.
        large = cut_lineage(_carry(active, "b", "a", below, "m", hub_degree).select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("changed")))
        if done == 0:
            release(active)
        least = large.groupBy(F.col("a").alias("node")).agg(
            F.struct(F.min("b").alias("m"), (F.max("changed") | (F.min("b") < F.max("b"))).alias("changed")).alias("value"), F.count(F.lit(1)).alias("degree")
        )
        carried = _carry(large, "a", "b", least, "v", hub_degree)
        small = carried.filter(F.col("b") != F.col("v.m")).select(F.col("b").alias("a"), F.col("v.m").alias("b"), F.lit(True).alias("changed"))
        stars = small.unionByName(least.select(F.col("node").alias("a"), F.col("value.m").alias("b"), F.col("value.changed").alias("changed")))
        stars = cut_lineage(stars.groupBy("a", "b").agg(F.max("changed").alias("changed")))
        release(large)
        # A star is done if no changed edge has its centre at either end.
        centres = stars.select(F.col("b").alias("node"), "changed", F.lit(1).alias("n"))
        ends = stars.filter("changed").select(F.col("a").alias("node"), "changed", F.lit(0).alias("n"))
        moved = centres.unionByName(ends).groupBy("node").agg(F.max("changed").alias("value"), F.sum("n").alias("degree"))
        split = cut_lineage(_carry(stars, "b", "a", moved, "active", hub_degree))
        release(stars)
        settled.append(split.filter(~F.col("active")).select(F.col("a").alias("node"), F.col("b").alias("root")))
        active = split.filter("active").select("a", "b")
    else:
        raise RuntimeError(f"not converged after {max_rounds} rounds")
    roots = active.select(F.col("a").alias("node"), F.col("b").alias("root")).filter(F.lit(False)) if not settled else settled[0]
    for more in settled[1:]:
        roots = roots.unionByName(more)
    return roots, done


def group_nodes(nodes: DataFrame, links: DataFrame, g: str, node: str, a: str, b: str, hub_degree: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """(g, group_node, node): every distinct node of `nodes`, which hold all ends of `links`, with the least node of its group."""
    known = nodes.select(F.col(g).alias("g"), F.col(node).alias("node")).dropna().distinct()
    ids = cut_lineage(known.sort("g", "node").withColumn("id", F.monotonically_increasing_id()))
    ends = links.select(F.col(g).alias("g"), F.col(a).alias("x"), F.col(b).alias("y")).dropna().filter(F.col("x") != F.col("y")).distinct()
    numbered = (
        ends.join(ids.select("g", F.col("node").alias("x"), F.col("id").alias("i")), ["g", "x"])
        .join(ids.select("g", F.col("node").alias("y"), F.col("id").alias("j")), ["g", "y"])
        .select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b"))
    )
    roots, _ = star_roots(numbered, hub_degree, max_rounds)
    rooted = ids.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = roots.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    names = ids.select(F.col("id").alias("node"), F.col("node").alias("value")).join(sizes, "node")
    named = _carry(rooted, "root", "id", names, "group_node", hub_degree)
    return named.select("g", F.coalesce("group_node", "node").alias("group_node"), "node")

"""Containment of small edge sets where they are gathered, one row a node.

The edges of a node are 64-bit hashes in one array. Nodes meet at an edge that is rare
for the smaller set, its pivot, so that a pair is compared in one place and neither
edges nor pairs are shuffled one by one. Of a set of over `MOST` edges just `MOST` + 1
are kept; such terms are for `edges.contained_in`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.operators.groups import codes_of, map_groups
from quadloom.runtime import cut_lineage, shuffles_removed

#: Edges of a set that is gathered; frequencies of edges that are kept exactly; terms with one edge that are compared in one place; pairs compared at once.
MOST, KNOWN, TOGETHER, BLOCK = 32, 1 << 17, 50_000, 1 << 20


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the row of each."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _gathered(g: pa.ChunkedArray | pa.Array, node: pa.ChunkedArray | pa.Array, row: np.ndarray, edge: np.ndarray) -> pa.Table:
    """One row a node, in the order of first rows, with its distinct edges or MOST + 1 of them."""
    code = codes_of(g, node)
    first, inverse = np.unique(code, return_index=True, return_inverse=True)[1:]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    of = rank[inverse.ravel()][row]
    order = np.lexsort((edge, of))
    of, edge = of[order], edge[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (edge[1:] != edge[:-1])
    of, edge = of[new], edge[new]
    sizes = np.bincount(of, minlength=len(first))
    kept = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= MOST
    at = pa.array(np.sort(first))
    return pa.table({"g": g.take(at), "node": node.take(at), "e": _lists(edge[kept], np.minimum(sizes, MOST + 1))})


def edge_sets(ends: DataFrame) -> DataFrame:
    """(g, node, e): the distinct edges of every node of (g, node, known, any), two hashes of which the first may be null."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(batch.column("known").is_valid().to_numpy(zero_copy_only=False))
            edges = np.concatenate([batch.column("known").drop_null().to_numpy(), batch.column("any").to_numpy()])
            yield from _gathered(batch.column("g"), batch.column("node"), np.concatenate([known, np.arange(batch.num_rows)]), edges).combine_chunks().to_batches()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            edges, row = _flat(rows["e"])
            found = _gathered(rows["g"], rows["node"], row, edges)
            if found.num_rows > 1:
                yield from found.slice(0, found.num_rows - 1).combine_chunks().to_batches()
            held = pa.Table.from_batches(found.slice(found.num_rows - 1).combine_chunks().to_batches(), found.schema)
        if held is not None and held.num_rows:
            yield from held.to_batches()

    schema = "g string, node string, e array<bigint>"
    return ends.mapInArrow(near, schema).repartition("g", "node").sortWithinPartitions("g", "node").mapInArrow(far, schema)


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The KNOWN most frequent edges, ascending, and how many nodes have each."""
    top = sets.select(F.explode("e").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).orderBy(F.desc("n"), "e").limit(KNOWN).toArrow().sort_by("e")
    return top["e"].to_numpy(), top["n"].to_numpy()


def _lookup(edges: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each edge, 0 if it isn't among the keys."""
    if not len(keys):
        return np.zeros(len(edges), np.int64)
    at = np.minimum(np.searchsorted(keys, edges), len(keys) - 1)
    return np.where(keys[at] == edges, values[at], 0)


def _pivots(edges: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the edge of each row is that fewest nodes have; rows ascend and have edges."""
    order = np.lexsort((edges, n, row))
    return order[np.unique(row[order], return_index=True)[1]]


def contained_sets(sets: DataFrame) -> DataFrame:
    """(g, bnode, term): terms of (g, node, e), other than itself, whose edges include all edges of a blank node; of sets up to MOST edges."""
    sets = sets.filter(F.size("e") <= MOST)
    return _compared(sets, *_frequent_pivots(sets), _compare, "g string, bnode string, term string")


def best_supersets(sets: DataFrame) -> DataFrame:
    """(g, bnode, term, n, equal): of the terms of (g, node, e) whose edges include all edges of a blank node, the best of each place; of sets up to MOST edges.

    Of nodes with equal sets a ground term or else the least stays, and is the best
    of the others; the best of one that stays has the most edges `n`, then the least name.
    """
    sets = sets.filter(F.size("e") <= MOST)
    keys, counts, wanted = _frequent_pivots(sets)
    equal = None
    if (_lookup(wanted, keys, counts) > TOGETHER).any():
        # Equal sets meet in one place; where that could hold too many, they are merged before.
        sets = sets.select("g", "node", F.array_sort("e").alias("e"))
        classes = sets.groupBy("g", "e").agg(F.min(F.struct(is_bnode("node").alias("b"), "node")).alias("least"))
        classes = cut_lineage(classes.select("g", F.col("least.node").alias("node"), "e"))
        equal = sets.join(classes.withColumnRenamed("node", "term"), ["g", "e"]).filter(is_bnode("node") & (F.col("node") != F.col("term"))).select("g", F.col("node").alias("bnode"), "term", F.size("e").cast("bigint").alias("n"), F.lit(True).alias("equal"))
        sets = classes
    found = _compared(sets, keys, counts, wanted, _best, "g string, bnode string, term string, n bigint, equal boolean", by_set=True)
    return found if equal is None else found.unionByName(equal)


def _frequent_pivots(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent edges, how many nodes have each, and those of them at which blank nodes are looked for."""
    with shuffles_removed(sets.sparkSession):
        keys, counts = _frequent(sets)

    def frequent_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, row = _flat(batch.column("e"))
            if len(edges):
                n = _lookup(edges, keys, counts)
                at = _pivots(edges, row, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(edges[at[n[at] > 0]]))], names=["e"])

    blank = sets.filter(F.col("node").startswith("_:"))
    with shuffles_removed(sets.sparkSession):
        return keys, counts, np.sort(blank.select("e").mapInArrow(frequent_pivots, "e bigint").distinct().toArrow()["e"].to_numpy())


def _compared(sets: DataFrame, keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray, compare: Callable[[pa.Table], pa.Table], schema: str, by_set: bool = False) -> DataFrame:
    """`compare` over the sets that meet at an edge; a place that many terms share is split by rows, or so that equal sets stay together."""
    yes = np.ones(len(wanted), np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each place where a set is a term, and for each place where it is looked for."""
        for batch in batches:
            edges, row = _flat(batch.column("e"))
            if not len(edges):
                continue
            n = _lookup(edges, keys, counts)
            parts = -(-np.maximum(n, 1) // TOGETHER)
            here = np.flatnonzero((n == 0) | (_lookup(edges, wanted, yes) > 0))
            pivot = np.zeros(len(edges), bool)
            pivot[_pivots(edges, row, n)] = True
            starts = pc.starts_with(batch.column("node"), "_:").to_numpy(zero_copy_only=False)
            pivot &= starts[row]
            own = row[here] * np.int64(7919) % parts[here]
            if by_set and (parts > 1).any():
                total = np.zeros(batch.num_rows, np.uint64)
                np.add.at(total, row, edges.astype(np.uint64))
                own = ((total[row[here]] >> np.uint64(20)) % parts[here].astype(np.uint64)).astype(np.int64)
            asks = np.flatnonzero(pivot & (parts > 1))
            again = np.repeat(asks, parts[asks])
            part = np.concatenate([own, np.arange(len(again)) - np.repeat(np.cumsum(parts[asks]) - parts[asks], parts[asks])])
            at = np.concatenate([here, again])
            term = np.concatenate([np.ones(len(here), bool), np.zeros(len(again), bool)])
            ask = np.concatenate([pivot[here] & (parts[here] == 1), np.ones(len(again), bool)])
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g").take(rows), pa.array(edges[at]), pa.array(part.astype(np.int32)), pa.array(term), pa.array(ask), batch.column("node").take(rows), batch.column("e").take(rows)], names=["g", "pivot", "part", "is_term", "asks", "node", "e"]
            )

    return map_groups(sets.mapInArrow(placed, "g string, pivot bigint, part int, is_term boolean, asks boolean, node string, e array<bigint>"), ["g", "pivot", "part"], compare, schema, chunk_rows=20_000)


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of a row that asks and a term of its group that has all its edges."""
    a, b = _contained(table, codes_of(table["g"], table["pivot"], table["part"]))
    names = table["node"].combine_chunks()
    out = pa.table({"g": table["g"].combine_chunks().take(pa.array(a)), "bnode": names.take(pa.array(a)), "term": names.take(pa.array(b))})
    return out.filter(pc.not_equal(out["bnode"], out["term"]))


def _best(table: pa.Table) -> pa.Table:
    """The best term of its group that has all edges of each row that asks; equal sets are compared once."""
    names = table["node"].combine_chunks()
    blank = pc.starts_with(names, "_:").to_numpy(zero_copy_only=False)
    by_name = np.empty(len(names), np.int64)
    by_name[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    place = codes_of(table["g"], table["pivot"], table["part"])
    edges, row = _flat(table["e"])
    numbers = np.unique(edges, return_inverse=True)[1].ravel()
    order = np.lexsort((numbers, row))
    sizes = np.bincount(row, minlength=len(names))
    starts = np.cumsum(sizes) - sizes
    alike = np.unique(place, return_inverse=True)[1].ravel()
    for i in range(int(sizes.max(initial=0))):
        there = sizes > i
        nth = np.full(len(names), -1)
        nth[there] = numbers[order[starts[there] + i]]
        alike = np.unique(alike * (len(edges) + 1) + nth + 1, return_inverse=True)[1].ravel()
    is_term, asks = (table[c].to_numpy() for c in ("is_term", "asks"))
    # The node that stays of each class; where equal sets are just looked for, the class has no term here.
    order = np.lexsort((by_name, blank, ~is_term, alike))
    stays = order[np.unique(alike[order], return_index=True)[1]]
    asked = np.zeros(len(stays), bool)
    asked[alike[asks]] = True
    one = table.take(pa.array(stays))
    one = one.set_column(one.column_names.index("asks"), "asks", pa.array(asked))
    a, b = _contained(one, place[stays])
    larger = sizes[stays][b] > sizes[stays][a]
    a, b = a[larger], b[larger]
    order = np.lexsort((by_name[stays][b], -sizes[stays][b], a))
    a, b = a[order], b[order]
    firsts = np.unique(a, return_index=True)[1]
    above = np.full(len(stays), -1)
    above[a[firsts]] = stays[b[firsts]]
    rows, name = np.flatnonzero(asks), codes_of(names)
    least = stays[alike[rows]]
    equal = is_term[least] & (name[least] != name[rows])
    to = np.where(equal, least, above[alike[rows]])
    at = pa.array(rows[to >= 0])
    equal, to = equal[to >= 0], to[to >= 0]
    return pa.table({"g": table["g"].combine_chunks().take(at), "bnode": names.take(at), "term": names.take(pa.array(to)), "n": pa.array(sizes[to]), "equal": pa.array(equal)})


def _contained(table: pa.Table, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ask, and of each the terms of its group, itself included or not, that have all its edges."""
    edges, row = _flat(table["e"])
    sizes = np.bincount(row, minlength=table.num_rows)
    starts = np.cumsum(sizes) - sizes
    numbers = np.unique(edges, return_inverse=True)[1].ravel()
    span = int(numbers.max(initial=0)) + 1
    there = np.sort(row * span + numbers)
    bits = np.zeros(table.num_rows, np.uint64)
    np.bitwise_or.at(bits, row, np.left_shift(np.uint64(1), (numbers % 64).astype(np.uint64)))
    terms = np.flatnonzero(table["is_term"].to_numpy())
    terms = terms[np.argsort(code[terms], kind="stable")]
    asks = np.flatnonzero(table["asks"].to_numpy())
    first, last = (np.searchsorted(code[terms], code[asks], side) for side in ("left", "right"))
    upto = np.cumsum(last - first)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, int(upto[-1]) if len(upto) else 0, BLOCK):
        pair = np.arange(begin, min(begin + BLOCK, int(upto[-1])))
        k = np.searchsorted(upto, pair, "right")
        a, b = asks[k], terms[last[k] - (upto[k] - pair)]
        maybe = (a != b) & (sizes[a] <= sizes[b]) & (bits[a] & ~bits[b] == 0)
        a, b = a[maybe], b[maybe]
        of = np.repeat(np.arange(len(a)), sizes[a])
        step = np.arange(len(of)) - np.repeat(np.cumsum(sizes[a]) - sizes[a], sizes[a])
        want = b[of] * span + numbers[starts[a[of]] + step]
        have = there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want
        whole = np.bincount(of[~have], minlength=len(a)) == 0
        found.append((a[whole], b[whole]))
    return tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))

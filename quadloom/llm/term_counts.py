"""Frequency of every distinct term: occurrences and records, counted in burst tries.

1. Rows are reduced to (term, record, rows) by a hash aggregation that combines
   map-side, so that a hot term or record moves once per task and pair.
2. Every task feeds its pairs into a burst trie: containers of suffixes hang on a
   trie of prefixes, and a container that outgrows `burst` is split by its next
   character. Tries are flushed when they hold `flush_terms`, so memory is bounded.
3. The prefixes at which the workers' tries burst form the routing table. It is
   bounded by `max_routes`; it decides where a term is merged, never whether.
   A prefix with more than `route_terms` entries is divided further by a hash.
4. Containers are cut along the routes, the matching subtrees of all workers meet
   in one task each and are merged one route at a time.

Defined results
---------------
Rows with a null term or record are not counted; an empty string is a term like
any other. Repeated rows count as occurrences, their record once. An empty table
gives no rows. Only the two named columns are read, so further columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import cut_lineage

_SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Prefix nodes are dicts by character; leaves are containers {suffix: [occurrences, records]}."""

    def __init__(self, burst: int):
        self.burst, self.size = burst, 0
        self.root: _Node = _Node()

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while node.children is not None:
            if at == len(term):
                break
            nxt = node.children.get(term[at])
            if nxt is None:
                nxt = node.children[term[at]] = _Node()
            node, at = nxt, at + 1
        counts = node.held.get(suffix := term[at:])
        if counts is None:
            node.held[suffix] = [occurrences, records]
            self.size += 1
            if node.children is None and len(node.held) > self.burst:
                node.split()
        else:
            counts[0] += occurrences
            counts[1] += records

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, container) of every node that holds terms."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.held:
                yield prefix, node.held
            stack += [(prefix + c, x) for c, x in (node.children or {}).items()]


class _Node:
    __slots__ = ("children", "held")

    def __init__(self):
        self.children: dict[str, _Node] | None = None
        self.held: dict[str, list[int]] = {}

    def split(self) -> None:
        held, self.held, self.children = self.held, {}, {}
        for suffix, counts in held.items():
            if not suffix:
                self.held[""] = counts
                continue
            child = self.children.get(suffix[0])
            if child is None:
                child = self.children[suffix[0]] = _Node()
            child.held[suffix[1:]] = counts


def _subtree_batch(rows: list[tuple[str, dict[str, list[int]]]]) -> pa.RecordBatch:
    i64 = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in rows], pa.string()),
            pa.array([list(h) for _, h in rows], pa.list_(pa.string())),
            pa.array([[c[0] for c in h.values()] for _, h in rows], i64),
            pa.array([[c[1] for c in h.values()] for _, h in rows], i64),
        ],
        names=["prefix", "suffixes", "occurrences", "records"],
    )


def _build(burst: int, flush_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in batches:
            local = pa.Table.from_batches([batch]).group_by("term").aggregate([("n", "sum"), ("n", "count")])
            for term, n, records in zip(local["term"].to_pylist(), local["n_sum"].to_pylist(), local["n_count"].to_pylist(), strict=True):
                trie.add(term, n, records)
            if trie.size >= flush_terms:
                yield _subtree_batch(list(trie.subtrees()))
                trie = BurstTrie(burst)
        if trie.size:
            yield _subtree_batch(list(trie.subtrees()))

    return run


class Routes:
    """The shortest prefix of a term at which no worker burst, or the term itself, and a hash part of it."""

    def __init__(self, sizes: list[tuple[str, int]], route_terms: int):
        self.inner = {p[:i] for p, _ in sizes for i in range(len(p))}
        totals: dict[str, int] = {}
        for prefix, n in sizes:
            totals[r] = totals.get(r := self.prefix(prefix), 0) + n
        self.parts = {p: -(-n // route_terms) for p, n in totals.items() if n > route_terms}

    def prefix(self, term: str) -> str:
        i = 0
        while i < len(term) and term[:i] in self.inner:
            i += 1
        return term[:i]

    def part(self, prefix: str, term: str) -> int:
        parts = self.parts.get(prefix, 1)
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) % parts if parts > 1 else 0


def _split(routes: Routes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], dict[str, list[int]]] = {}
            for row in batch.to_pylist():
                prefix = row["prefix"]
                whole = prefix not in routes.inner and routes.prefix(prefix) == prefix and prefix not in routes.parts
                for suffix, n, records in zip(row["suffixes"], row["occurrences"], row["records"], strict=True):
                    term = prefix + suffix
                    route = prefix if whole else routes.prefix(term)
                    key = (route, 0 if whole else routes.part(route, term))
                    held = found.setdefault(key, {})
                    counts = held.setdefault(term[len(route) :], [0, 0])
                    counts[0] += n
                    counts[1] += records
            if found:
                keys = list(found)
                out = _subtree_batch([(k[0], found[k]) for k in keys])
                yield out.append_column("part", pa.array([k[1] for k in keys], pa.int32()))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by route; one route's merged subtree is held at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (prefix, _), group in groupby(rows, key=lambda r: (r["prefix"], r["part"])):
        merged: dict[str, list[int]] = {}
        for row in group:
            for suffix, n, records in zip(row["suffixes"], row["occurrences"], row["records"], strict=True):
                counts = merged.get(suffix)
                if counts is None:
                    merged[suffix] = [n, records]
                else:
                    counts[0] += n
                    counts[1] += records
        suffixes = pa.array(list(merged), pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pc.binary_join_element_wise(pa.scalar(prefix), suffixes, ""),
                pa.array([c[0] for c in merged.values()], pa.int64()),
                pa.array([c[1] for c in merged.values()], pa.int64()),
            ],
            names=["term", "occurrences", "records"],
        )


def count_terms(
    df: DataFrame,
    term: str,
    record: str,
    burst: int = 4096,
    flush_terms: int = 400_000,
    max_routes: int = 20_000,
    route_terms: int = 1_000_000,
) -> DataFrame:
    """(term, occurrences, records) of every distinct non-null term over rows with a non-null record."""
    pairs = (
        df.select(F.col(term).alias("term"), F.col(record).alias("record"))
        .filter(F.col("term").isNotNull() & F.col("record").isNotNull())
        .groupBy("term", "record").agg(F.count(F.lit(1)).alias("n"))
        .select("term", "n")
    )
    tries = cut_lineage(pairs.mapInArrow(_build(burst, flush_terms), _SUBTREE))
    sizes = tries.groupBy("prefix").agg(F.sum(F.size("suffixes")).alias("n")).orderBy(F.desc("n"), "prefix").limit(max_routes)
    routes = Routes([(r.prefix, r.n) for r in sizes.collect()], route_terms)
    cut = tries.mapInArrow(_split(routes), _SUBTREE + ", part int")
    return cut.repartition("prefix", "part").sortWithinPartitions("prefix", "part").mapInArrow(_merge, "term string, occurrences bigint, records bigint")


def mark_terms(df: DataFrame, term: str, record: str, rare_records: int = 2, common_share: float = 0.3, **options) -> DataFrame:
    """The counts of every term with `mark`: `rare`, `common` or null.

    A term is rare if at most `rare_records` records hold it, else common if more
    than `common_share` of all distinct non-null records of `df` do, whether or
    not those records hold any term.
    """
    total = df.select(record).filter(F.col(record).isNotNull()).distinct().count()
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * total, "common")
    return count_terms(df, term, record, **options).withColumn("mark", mark)

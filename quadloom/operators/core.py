"""The search for an endomorphism of a graph that loses a blank node.

If a graph has one, it has one that moves the blank nodes of a single component
only, so components are searched one by one, against the whole graph.

`GraphCore` leans a graph that fits in a task; `extend_bindings` runs the same
search breadth-first as joins, all partial solutions of all graphs at a time.
"""

from __future__ import annotations

import random
import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_bnode
from quadloom.runtime import cut_lineage, release

Triple = tuple[str, str, str]
_ANY = "\u0002any"


def blank(term: str) -> bool:
    return term.startswith("_:")


class OutOfTime(Exception):
    pass


class GraphCore:
    """One graph in memory."""

    def __init__(self, triples: set[Triple], algorithm: str = "dfs", prune: bool = True, seed: int | None = None, deadline: float | None = None):
        self.triples = set(triples)
        self.algorithm, self.prune, self.deadline = algorithm, prune, deadline
        self.random = random.Random(seed) if seed is not None else None
        self.map: dict[str, str] = {b: b for t in self.triples for b in (t[0], t[2]) if blank(b)}
        self.joins = self.depth = self.solutions = 0
        self.status = "OK"

    # --- indexes and candidates ---

    def _index(self) -> None:
        self.outs: dict[tuple[str, str], set[str]] = defaultdict(set)
        self.ins: dict[tuple[str, str], set[str]] = defaultdict(set)
        self.count: dict[str, int] = defaultdict(int)
        for s, p, o in self.triples:
            self.outs[s, p].add(o)
            self.ins[o, p].add(s)
            self.count[p] += 1

    def _candidates(self) -> dict[str, set[str]]:
        """Of each blank node: itself and what has all its edges to known terms; found alone, it is known itself."""
        free = {b for t in self.triples for b in (t[0], t[2]) if blank(b)}
        while True:
            edges: dict[str, set] = defaultdict(set)
            for s, p, o in self.triples:
                edges[s].add(("+", p, _ANY))
                edges[o].add(("-", p, _ANY))
                if o not in free:
                    edges[s].add(("+", p, o))
                if s not in free:
                    edges[o].add(("-", p, s))
            having: dict[tuple, set[str]] = defaultdict(set)
            for x, own in edges.items():
                for e in own:
                    having[e].add(x)
            found = {}
            for b in free:
                sets = sorted((having[e] for e in edges[b]), key=len)
                both = set(sets[0])
                for other in sets[1:]:
                    if len(both) == 1:
                        break
                    both &= other
                found[b] = both | {b}
            alone = {b for b, c in found.items() if len(c) == 1}
            if not alone:
                return found
            free -= alone

    def _components(self, free: set[str]) -> list[list[str]]:
        root = {b: b for b in free}

        def find(x: str) -> str:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for s, _, o in self.triples:
            if s in root and o in root:
                a, b = find(s), find(o)
                if a != b:
                    root[max(a, b)] = min(a, b)
        groups = defaultdict(list)
        for b in free:
            groups[find(b)].append(b)
        return [sorted(groups[k]) for k in sorted(groups)]

    def _order(self, nodes: list[str], near: dict[str, list[Triple]], can: dict[str, set[str]]) -> list[str]:
        """Greedy and connected: next the node with the fewest candidates, then the rarest predicate, that touches one before."""
        weight = lambda v: (len(can[v]), min((self.count[t[1]] for t in near[v]), default=0), v)
        left, order, edge = set(nodes), [], set()
        while left:
            v = min(edge or left, key=weight)
            order.append(v)
            left.discard(v)
            edge.discard(v)
            edge |= {w for t in near[v] for w in (t[0], t[2]) if w in left}
        return order

    # --- search ---

    def _values(self, v: str, near: list[Triple], can: dict[str, set[str]], bound: dict[str, str]) -> list[str]:
        """What `v` may be bound to next, the most promising first."""
        self.joins += 1
        if self.deadline is not None and time.monotonic() > self.deadline:
            raise OutOfTime
        options = can[v]
        for s, p, o in near:
            if s == o:
                options = {x for x in options if x in self.outs.get((x, p), ())}
            elif s == v and o in bound:
                options = options & self.ins.get((bound[o], p), set())
            elif o == v and s in bound:
                options = options & self.outs.get((bound[s], p), set())
            if not options:
                return []
        if self.random is not None:
            out = sorted(options)
            self.random.shuffle(out)
            return out
        times: dict[str, int] = defaultdict(int)
        for x in bound.values():
            times[x] += 1
        return sorted(options, key=lambda x: (blank(x), -times[x], x == v, x))

    def _dfs(self, nodes: list[str], near: dict[str, list[Triple]], can: dict[str, set[str]]) -> dict[str, str] | None:
        """The first homomorphism whose image misses one of `nodes`, or None."""
        order, own = self._order(nodes, near, can), set(nodes)
        bound: dict[str, str] = {}
        stack = [iter(self._values(order[0], near[order[0]], can, bound))]
        tried: list[list[str]] = [[]]
        turns: list[dict[str, str]] = []
        while stack:
            v = order[len(stack) - 1]
            bound.pop(v, None)
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                tried.pop()
                continue
            if self.prune and tried[-1] and self._turned(x, tried[-1], set(bound.values()), turns):
                continue
            tried[-1].append(x)
            bound[v] = x
            if len(stack) == len(order):
                self.solutions += 1
                if own - set(bound.values()):
                    return dict(bound)
                turns.append({a: b for a, b in bound.items() if a != b})
                bound.pop(v)
                continue
            w = order[len(stack)]
            stack.append(iter(self._values(w, near[w], can, bound)))
            tried.append([])
        return None

    @staticmethod
    def _turned(x: str, tried: list[str], kept: set[str], turns: list[dict[str, str]]) -> bool:
        """Does an automorphism seen that leaves the values bound so far in place map a value tried in vain to `x`?"""
        root: dict[str, str] = {}

        def find(y: str) -> str:
            while root.get(y, y) != y:
                y = root[y]
            return y

        for t in turns:
            if not kept & t.keys():
                for a, b in t.items():
                    if find(a) != find(b):
                        root[find(a)] = find(b)
        return any(find(x) == find(y) for y in tried)

    def _bfs(self, nodes: list[str], near: dict[str, list[Triple]], can: dict[str, set[str]]) -> dict[str, str] | None:
        """Of all homomorphisms one with the fewest blank nodes in its image, if it misses one of `nodes`."""
        level: list[dict[str, str]] = [{}]
        for v in self._order(nodes, near, can):
            level = [{**b, v: x} for b in level for x in self._values(v, near[v], can, b)]
        self.solutions += len(level)
        own = set(nodes)
        proper = [b for b in level if own - set(b.values())]
        return min(proper, key=lambda b: (sum(map(blank, set(b.values()))), sorted(b.items())), default=None)

    def lean(self) -> GraphCore:
        """Fold the graph until it is lean, or the time is up."""
        try:
            while self._fold():
                self.depth += 1
        except OutOfTime:
            self.status = "TIMEOUT"
        return self

    def _fold(self) -> bool:
        """One round: the folds of components that don't get in each other's way, all at once."""
        self._index()
        can = self._candidates()
        touched: set[str] = set()
        moves: dict[str, str] = {}
        near: dict[str, list[Triple]] = defaultdict(list)
        for t in self.triples:
            for v in {t[0], t[2]} & can.keys():
                if t[0] in can and t[2] in can:
                    near[v].append(t)
        for nodes in self._components(set(can)):
            if touched & set(nodes) or all(len(can[v]) == 1 for v in nodes):
                continue
            found = (self._bfs if self.algorithm == "bfs" else self._dfs)(nodes, near, can)
            if found is None:
                continue
            image = {x for x in found.values() if blank(x)}
            if image & moves.keys():
                continue
            moves |= found
            touched |= image | set(nodes)
        if not any(a != b for a, b in moves.items()):
            return False
        self.triples = {(moves.get(s, s), p, moves.get(o, o)) for s, p, o in self.triples}
        self.map = {b: moves.get(x, x) for b, x in self.map.items()}
        return True


# --- breadth-first, by joins ---


def extend_bindings(bindings: DataFrame, patterns: DataFrame, triples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Extend each (g, comp, m) by its pattern (g, comp, ps, p, po) in every way; `m` maps blank nodes to terms.

    Triples are looked up by predicate and the ends already bound: both (a
    semi-join), one (an index lookup) or none (a scan of the predicate).
    Components without a pattern at this step keep their bindings.
    """
    todo = bindings.join(patterns, ["g", "comp"], "left").withColumns({"bs": F.col("m")[F.col("ps")], "bo": F.col("m")[F.col("po")]})
    idle = todo.filter(F.col("p").isNull()).select("g", "comp", "m")
    todo = todo.filter(F.col("p").isNotNull())
    may = candidates.select("g", F.col("bnode"), F.col("term"))
    s_can, o_can = may.withColumnsRenamed({"bnode": "ps", "term": "s"}), may.withColumnsRenamed({"bnode": "po", "term": "o"})
    both = todo.filter(F.col("bs").isNotNull() & F.col("bo").isNotNull()).withColumns({"s": F.col("bs"), "o": F.col("bo")}).join(triples, ["g", "s", "p", "o"], "left_semi")
    s_only = todo.filter(F.col("bs").isNotNull() & F.col("bo").isNull()).withColumn("s", F.col("bs")).join(triples, ["g", "s", "p"]).join(o_can, ["g", "po", "o"], "left_semi")
    o_only = todo.filter(F.col("bs").isNull() & F.col("bo").isNotNull()).withColumn("o", F.col("bo")).join(triples, ["g", "o", "p"]).join(s_can, ["g", "ps", "s"], "left_semi")
    none = todo.filter(F.col("bs").isNull() & F.col("bo").isNull()).join(triples, ["g", "p"]).filter((F.col("ps") != F.col("po")) | (F.col("s") == F.col("o")))
    none = none.join(s_can, ["g", "ps", "s"], "left_semi").join(o_can, ["g", "po", "o"], "left_semi")
    found = None
    for part in (both, s_only, o_only, none):
        part = part.select("g", "comp", F.map_from_entries(F.array_distinct(F.concat(F.map_entries("m"), F.array(*(F.struct(F.col(k).alias("key"), F.col(v).alias("value")) for k, v in (("ps", "s"), ("po", "o"))))))).alias("m"))
        found = part if found is None else found.unionByName(part)
    return found.unionByName(idle)


def order_patterns(patterns: DataFrame) -> DataFrame:
    """(g, comp, ps, p, po, step): connected order of each component's patterns, rare predicates first."""
    import pandas as pd

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        freq = pdf["p"].value_counts()
        left = sorted(pdf[["ps", "p", "po"]].itertuples(index=False), key=lambda t: (freq[t.p], t))
        seen, out = set(), []
        while left:
            at = next((i for i, t in enumerate(left) if t.ps in seen and t.po in seen), None)
            at = at if at is not None else next((i for i, t in enumerate(left) if t.ps in seen or t.po in seen), 0)
            t = left.pop(at)
            seen |= {t.ps, t.po}
            out.append(t)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "comp": pdf["comp"].iloc[0], "ps": [t.ps for t in out], "p": [t.p for t in out], "po": [t.po for t in out], "step": range(len(out))})

    return patterns.groupBy("g", "comp").applyInPandas(ordered, "g string, comp string, ps string, p string, po string, step int")


def solutions(triples: DataFrame, placed: DataFrame, candidates: DataFrame, max_bindings: int = 50_000_000) -> DataFrame:
    """(g, comp, m): all homomorphisms of each component's patterns, of triples (g, comp, s, p, o) between unfixed blank nodes.

    More than `max_bindings` partial solutions are refused with an error, never cut.
    """
    patterns = cut_lineage(order_patterns(placed.select("g", "comp", F.col("s").alias("ps"), "p", F.col("o").alias("po"))))
    steps = (patterns.agg(F.max("step")).first()[0] or 0) + 1 if not patterns.isEmpty() else 0
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    now = cut_lineage(patterns.select("g", "comp").distinct().withColumn("m", empty))
    for k in range(steps):
        step = patterns.filter(F.col("step") == k).drop("step")
        new = cut_lineage(extend_bindings(now, step, triples, candidates))
        release(now)
        now = new
        if now.count() > max_bindings:
            raise RuntimeError(f"over {max_bindings} partial solutions at step {k}")
    return now


def best_solutions(found: DataFrame) -> DataFrame:
    """(g, comp, m, range, domain): of each component the solution with the fewest blank nodes in its range; proper if range < domain."""
    blanks = F.size(F.array_distinct(F.filter(F.map_values("m"), lambda x: x.startswith("_:"))))
    scored = found.withColumns({"range": blanks, "domain": F.size("m"), "text": F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))), ",")})
    return scored.groupBy("g", "comp").agg(F.min_by(F.struct("m", "range", "domain"), F.struct("range", "text")).alias("x")).select("g", "comp", "x.*")


def multiplicity(m: str, value: str) -> Column:
    """How often a solution binds something to the value."""
    return F.size(F.filter(F.map_values(m), lambda x: x == F.col(value)))


__all__ = ["GraphCore", "best_solutions", "extend_bindings", "is_bnode", "order_patterns", "solutions"]

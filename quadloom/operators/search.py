"""Colour refinement and the search for a canonical colouring, on NumPy arrays.

`Chunk` holds the triples of many components at once and refines all of them
together; components whose colours don't become discrete are then searched one by
one: the smallest ambiguous class is branched on, each branch is refined again, and
branches that an automorphism maps to an earlier sibling are skipped. Automorphisms
are read off the refined colours of two siblings, so that independent symmetries cost
a refinement each and not a leaf each, and off the leaves found so far.
The least leaf graph, by number of triples and then by its sorted triples, wins.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from quadloom.functions.hashing import blank_hash, digest, fold, hexed, int_hash, mark, rows_of, words


#: How often a round's hash collision is mended before the component is given up.
RECOVERIES = 5


@dataclass
class Chunk:
    """Triples as numbers: `s`, `o` are nodes, or -1 with the static hashes `hs`, `ho`; `part` is each node's component."""

    n: int
    s: np.ndarray
    o: np.ndarray
    hs: np.ndarray
    hp: np.ndarray
    ho: np.ndarray
    part: np.ndarray
    scheme: str

    def __post_init__(self):
        sub, obj = np.flatnonzero(self.s >= 0), np.flatnonzero(self.o >= 0)
        plus, minus = (rows_of([mark(x, self.scheme)], self.hp.shape[1])[0] for x in "+-")
        self.node = np.concatenate([self.s[sub], self.o[obj], np.arange(self.n)])
        self.other = np.concatenate([self.o[sub], self.s[obj]])
        self.static = np.concatenate([self.ho[sub], self.hs[obj]])
        self.pred = np.concatenate([self.hp[sub], self.hp[obj]])
        self.sign = np.concatenate([np.broadcast_to(plus, (len(sub), len(plus))), np.broadcast_to(minus, (len(obj), len(minus)))])
        counts = np.bincount(self.node, minlength=self.n)
        self.first = np.cumsum(counts) - counts
        self.most = counts
        self.by_most = np.argsort(-counts, kind="stable")
        self.ascending = -counts[self.by_most]

    def round(self, colours: np.ndarray) -> np.ndarray:
        """Each node's colour from the sorted hashes of its edges and its own colour."""
        near = np.where((self.other >= 0)[:, None], colours[np.maximum(self.other, 0)], self.static)
        entries = np.concatenate([fold(near, self.pred, self.sign), colours])
        order = np.lexsort((*reversed(words(entries)), self.node))
        entries = entries[order]
        out = np.zeros_like(colours)
        for k in range(int(self.most.max(initial=0))):
            # Nodes with more than k entries come first in by_most.
            who = self.by_most[: np.searchsorted(self.ascending, -k, "left")]
            out[who] = (out[who] * np.uint8(37)) ^ entries[self.first[who] + k]
        return out

    def classes(self, colours: np.ndarray) -> np.ndarray:
        """The number of each node's class; classes ascend by component, then colour."""
        keys = [self.part, *words(colours)]
        order = np.lexsort(tuple(reversed(keys)))
        new = np.zeros(self.n, bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        out = np.empty(self.n, np.int64)
        out[order] = np.cumsum(new)
        return out

    @staticmethod
    def _joined(after: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Nodes whose new class holds nodes of several old ones, which only a hash collision can cause."""
        span = now.max(initial=0) + 1
        several = np.flatnonzero(np.bincount(np.unique(after * span + now) // span) > 1)
        return np.isin(after, several)

    def _recover(self, fresh: np.ndarray, colours: np.ndarray, joined: np.ndarray, attempt: int) -> None:
        """Hash the old colour and its rank among the component's collided ones into the new colour."""
        for c in np.unique(self.part[joined]):
            who = np.flatnonzero(joined & (self.part == c))
            ranks = np.unique(colours[who], axis=0, return_inverse=True)[1].ravel()
            salts = rows_of([int_hash(int(r) * (attempt + 1) * 37, self.scheme) for r in ranks], colours.shape[1])
            fresh[who] = fold(fresh[who], colours[who], salts)

    def refine(self, colours: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stable colours; per component the number of classes, of rounds, and whether hash collisions joined classes for good."""
        parts = int(self.part.max(initial=-1)) + 1
        sizes = np.bincount(self.part, minlength=parts)
        of = lambda c: np.bincount(self.part[np.unique(c, return_index=True)[1]], minlength=parts)
        now = self.classes(colours)
        count, rounds, broken = of(now), np.zeros(parts, np.int64), np.zeros(parts, bool)
        active = np.ones(parts, bool)
        colours = colours.copy()
        while active.any():
            fresh = self.round(colours)
            fresh[~active[self.part]] = colours[~active[self.part]]
            after = self.classes(fresh)
            rounds[active] += 1
            for attempt in range(RECOVERIES + 1):
                joined = self._joined(after, now)
                if not joined.any():
                    break
                if attempt == RECOVERIES:
                    broken[self.part[joined]] = True
                    break
                self._recover(fresh, colours, joined, attempt)
                after = self.classes(fresh)
            total = of(after)
            active &= ~broken & (total != count) & (total != sizes)
            colours, now, count = fresh, after, total
        return colours, count, rounds, broken

    @cached_property
    def _keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int] | None:
        """Subject, predicate and object of each triple as numbers, nodes first, how many of these there are, and predicates; none if a triple needs over 63 bits."""
        terms = np.concatenate([self.hs, self.ho])
        static = self.n + np.unique(terms, axis=0, return_inverse=True)[1].ravel()
        s, o = np.where(self.s >= 0, self.s, static[: len(self.s)]), np.where(self.o >= 0, self.o, static[len(self.s) :])
        p = np.unique(self.hp, axis=0, return_inverse=True)[1].ravel()
        many, kinds = int(static.max(initial=self.n)) + 1, int(p.max(initial=0)) + 1
        return (s, p, o, many, kinds) if many * many * kinds < 2**63 else None

    @cached_property
    def _there(self) -> np.ndarray:
        s, p, o, many, kinds = self._keys
        return np.sort((s * kinds + p) * many + o)

    def is_automorphism(self, image: np.ndarray) -> bool:
        """Does this permutation of the nodes of one component take each triple to a triple?"""
        if self._keys is None:
            return False
        s, p, o, many, kinds = self._keys
        whole = np.concatenate([image, np.arange(self.n, many)])
        moved = whole != np.arange(many)
        rows = np.flatnonzero(moved[s] | moved[o])
        keys = (whole[s[rows]] * kinds + p[rows]) * many + whole[o[rows]]
        at = np.minimum(np.searchsorted(self._there, keys), len(self._there) - 1)
        return bool((self._there[at] == keys).all())

    def alone(self, part: int, triples: np.ndarray, nodes: np.ndarray) -> Chunk:
        """The component of `nodes` with `triples` as a chunk of its own."""
        at = np.full(self.n, -1)
        at[nodes] = np.arange(len(nodes))
        pick = lambda x: np.where(x[triples] >= 0, at[np.maximum(x[triples], 0)], -1)
        return Chunk(len(nodes), pick(self.s), pick(self.o), self.hs[triples], self.hp[triples], self.ho[triples], np.zeros(len(nodes), np.int64), self.scheme)


@dataclass
class Found:
    colours: np.ndarray
    status: str
    rounds: int
    leaves: int
    distinct_leaves: int


def _cell(colours: np.ndarray) -> np.ndarray:
    """The smallest class of several nodes, the least colour first; empty if there is none."""
    kinds, inverse, counts = np.unique(colours, axis=0, return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts > 1)
    if not len(several):
        return np.zeros(0, np.int64)
    return np.flatnonzero(inverse.ravel() == several[np.argmin(counts[several])])


def search(chunk: Chunk, colours: np.ndarray, leaf_of, prune: bool = True, deadline: float | None = None, rounds: int = 0) -> Found:
    """The colouring of the least leaf below the stable `colours` of one component.

    `leaf_of(colours)` gives a leaf graph that can be compared and hashed. The
    tree is walked with an explicit stack. When `deadline` passes, the status is
    `TIMEOUT` and the colouring isn't canonical.
    """
    blank = rows_of([blank_hash(chunk.scheme)], colours.shape[1])[0]
    leaves: dict = {}
    explored = 0
    stack = [(colours, (), iter(_cell(colours).tolist()), {}, _Orbits(chunk.n))]
    status = "OK"
    while stack:
        here, path, siblings, visited, orbits = stack[-1]
        node = next(siblings, None)
        if node is None:
            stack.pop()
            continue
        if deadline is not None and time.monotonic() > deadline:
            status = "TIMEOUT"
            break
        if prune and visited and (orbits.same(node, visited, path, leaves) or any(orbits.swaps(chunk, v, node) for v in visited)):
            continue
        branch = here.copy()
        branch[node] = fold(branch[node], blank)
        stable, count, r, broken = chunk.refine(branch)
        rounds += int(r[0])
        if broken[0]:
            return Found(stable, "COLLISION", rounds, explored, len(leaves))
        if prune and any(orbits.maps(chunk, here, v, node, seen, stable) for v, seen in visited.items()):
            continue
        visited[node] = stable
        if count[0] == chunk.n:
            explored += 1
            leaves.setdefault(leaf_of(stable), []).append(stable)
        else:
            stack.append((stable, (*path, node), iter(_cell(stable).tolist()), {}, _Orbits(chunk.n)))
    if not leaves:
        return Found(colours, status, rounds, explored, 0)
    return Found(leaves[min(leaves)][0], status, rounds, explored, len(leaves))


class _Orbits:
    """Nodes that automorphisms fixing one path map to each other, as far as siblings and leaves seen tell."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.used: dict = {}

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def swaps(self, chunk: Chunk, a: int, b: int) -> bool:
        """Is it an automorphism to swap two nodes of a class and nothing else?"""
        image = np.arange(chunk.n)
        image[[a, b]] = b, a
        return chunk.is_automorphism(image) and self._join(image)

    def maps(self, chunk: Chunk, here: np.ndarray, a: int, b: int, at_a: np.ndarray, at_b: np.ndarray) -> bool:
        """Is there an automorphism that keeps the colours `here` and takes `a` to `b`, as the colours refined from each suggest?

        Nodes of one colour are matched in order, so that classes that both
        siblings leave alone stay in place. A no may be wrong.
        """
        before, after = (np.lexsort(tuple(reversed(words(x)))) for x in (at_a, at_b))
        if not np.array_equal(at_a[before], at_b[after]):
            return False
        image = np.empty(chunk.n, np.int64)
        image[before] = after
        return bool(image[a] == b) and np.array_equal(here[image], here) and chunk.is_automorphism(image) and self._join(image)

    def _join(self, image: np.ndarray) -> bool:
        for a in np.flatnonzero(image != np.arange(len(image))).tolist():
            self.root[self.find(a)] = self.find(int(image[a]))
        return True

    def same(self, node: int, visited: dict[int, np.ndarray], path: tuple[int, ...], leaves: dict) -> bool:
        if any(self.find(node) == self.find(v) for v in visited):
            return True
        for leaf, found in leaves.items():
            done, anchors = self.used.setdefault(leaf, [0, {}])
            for colours in found[done:]:
                self.used[leaf][0] += 1
                order = np.lexsort(tuple(reversed(words(colours))))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                key = tuple(place[list(path)].tolist())
                anchor = anchors.setdefault(key, order)
                if anchor is not order:
                    for a, b in zip(anchor.tolist(), order.tolist(), strict=True):
                        if a != b:
                            self.root[self.find(a)] = self.find(b)
                    if any(self.find(node) == self.find(v) for v in visited):
                        return True
        return False


def graph_hash(chunk: Chunk, colours: np.ndarray) -> np.ndarray:
    """Per component: the blank hash plus the ordered combination of every triple's hashes, byte by byte."""
    parts = int(chunk.part.max(initial=-1)) + 1
    hs = np.where((chunk.s >= 0)[:, None], colours[np.maximum(chunk.s, 0)], chunk.hs)
    ho = np.where((chunk.o >= 0)[:, None], colours[np.maximum(chunk.o, 0)], chunk.ho)
    owner = chunk.part[np.where(chunk.s >= 0, chunk.s, chunk.o)]
    total = np.zeros((parts, colours.shape[1]), np.uint64)
    np.add.at(total, owner, fold(hs, chunk.hp, ho).astype(np.uint64))
    return (total + rows_of([blank_hash(chunk.scheme)], colours.shape[1])[0]).astype(np.uint8)


def hash_terms(terms: list[str], scheme: str) -> np.ndarray:
    return rows_of([digest(t.encode(), scheme) for t in terms], len(blank_hash(scheme)))


__all__ = ["Chunk", "Found", "graph_hash", "hash_terms", "hexed", "int_hash", "search"]

import random

import pytest

from quadloom.functions import hashing as H
from quadloom.operators import graphs
from quadloom.operators.components import bnode_components, components_of_links
from quadloom.operators.label import canonicalise, collisions, isomorphic_graphs, output_labels

SCHEMA = "g string, s string, p string, o string"
CYCLES = [("_:a", "_:b"), ("_:b", "_:c"), ("_:c", "_:a"), ("_:x", "_:y"), ("_:y", "_:z"), ("_:z", "_:x")]
# Canonical labels of two directed 3-cycles and a ground triple under md5.
GOLDEN = {
    ("36cc1684b47a2ab9d572712e9bf6d4b6", "3e2cfe64ac8abefd0daec5da3bda7422"),
    ("3e2cfe64ac8abefd0daec5da3bda7422", "eea00e382802360d4926a9d2a3d2648a"),
    ("b18eb44df51d9d026169a1751071c678", "d9c27c19e1a5093ebd351941c8bd1664"),
    ("c122c4399935a5128591dd7d68d9b640", "b18eb44df51d9d026169a1751071c678"),
    ("d9c27c19e1a5093ebd351941c8bd1664", "c122c4399935a5128591dd7d68d9b640"),
    ("eea00e382802360d4926a9d2a3d2648a", "36cc1684b47a2ab9d572712e9bf6d4b6"),
}


def golden_rows(g="G"):
    return [(g, a, "<p>", b) for a, b in CYCLES] + [(g, "<u>", "<p>", "<v>")]


def rows_of(df):
    return {(r.g, r.s, r.p, r.o) for r in df.collect()}


def test_hash_vectors():
    assert H.blank_hash("md5").hex() == "d41d8cd98f00b204e9800998ecf8427e"
    assert H.mark("+", "md5").hex() == "21527669713000e766c10cb0ac69deb2"
    assert H.mark("-", "md5").hex() == "494e6cec7483a4ee0938895519a84bc7"
    assert H.int_hash(0, "md5").hex() == "f1d3ff8443297732862df21dc4e57262"
    assert H.int_hash(2, "md5").hex() == "f2dd0dedb2c260419ece4a9e03b2e828"
    assert H.murmur3_128(b"").hex() == "0" * 32
    assert H.murmur3_128(b"hello").hex() == "029bbd41b3a7d8cb191dae486a901e5b"


@pytest.mark.parametrize("limit", [500_000, 2])
def test_golden(spark, limit):
    found = canonicalise(spark.createDataFrame(golden_rows() + golden_rows()[:2], SCHEMA), max_chunk_triples=limit)
    want = {("G", f"_:SK00{a}", "<p>", f"_:SK00{b}") for a, b in GOLDEN} | {("G", "<u>", "<p>", "<v>")}
    assert rows_of(found.triples) == want
    assert found.graphs.first().ghash == "2cf71563fe03e8f58f73e8b4211334dd"
    assert {r.gh for r in found.parts.collect()} == {"474cb823d5c4716e84b0abdb4e3cf239"}
    assert {r.c for r in found.parts.collect()} == {"b22f678b8a7d22d4925d45ba8249885f", "b12195e27b9635a78abefd39451e1215"}
    assert found.stats.first().status == "OK" and collisions(found).count() == 0
    as_iri = rows_of(output_labels(found, "urn:x:", as_bnode=False))
    assert as_iri == {(g, s.replace("_:", "<urn:x:") + (">" if s.startswith("_:") else ""), p, o.replace("_:", "<urn:x:") + (">" if o.startswith("_:") else "")) for g, s, p, o in want}


def cycle(n, at=0):
    return [(f"_:n{at + i}", "<p>", f"_:n{at + (i + 1) % n}") for i in range(n)]


def both(rows):
    return rows + [(o, p, s) for s, p, o in rows]


def clique(n):
    return [(f"_:n{i}", "<p>", f"_:n{j}") for i in range(n) for j in range(n) if i != j]


def grid(w, h):
    right = [(f"_:n{x}.{y}", "<p>", f"_:n{x + 1}.{y}") for x in range(w - 1) for y in range(h)]
    down = [(f"_:n{x}.{y}", "<p>", f"_:n{x}.{y + 1}") for x in range(w) for y in range(h - 1)]
    return both(right + down)


K33 = both([(f"_:n{i}", "<p>", f"_:n{3 + j}") for i in range(3) for j in range(3)])
PRISM = both(cycle(3) + cycle(3, 3) + [(f"_:n{i}", "<p>", f"_:n{3 + i}") for i in range(3)])
FAMILIES = {
    "cycle": cycle(5), "two": cycle(3) + cycle(3, 3), "even": both(cycle(6)), "odd": both(cycle(5)), "k4": clique(4), "grid": grid(2, 3), "k33": K33, "prism": PRISM,
    "star": [("_:a", "<p>", f"_:b{i}") for i in range(3)], "loop": [*cycle(3), ("_:l", "<p>", "_:l"), ("_:l", "<q>", '"x"@en')], "ground": [("<a>", "<p>", "<b>")],
}


def shuffled(rows, seed):
    rng = random.Random(seed)
    names = sorted({t for r in rows for t in r if t.startswith("_:")})
    to = dict(zip(names, rng.sample([f"_:r{i}" for i in range(1000)], len(names)), strict=True))
    out = [tuple(to.get(t, t) for t in r) for r in rows]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("prune", [True, False])
def test_renaming_changes_nothing(spark, prune):
    rows = [(f"{name}/{v}", *r) for name, family in FAMILIES.items() for v in range(4) for r in (shuffled(family, v) if v else family)]
    found = canonicalise(spark.createDataFrame(rows, SCHEMA), prune=prune)
    classes = {}
    for r in found.triples.collect():
        classes.setdefault(r.g, set()).add((r.s, r.p, r.o))
    by_family = {}
    for g, triples in classes.items():
        by_family.setdefault(g.split("/")[0], set()).add(frozenset(triples))
    assert all(len(v) == 1 for v in by_family.values()), {k: len(v) for k, v in by_family.items()}
    assert len({next(iter(v)) for v in by_family.values()}) == len(FAMILIES)
    for name, family in FAMILIES.items():
        assert len(classes[f"{name}/0"]) == len(set(family))
    iso = isomorphic_graphs(found).collect()
    assert len(iso) == len(FAMILIES) and all(r.n == 4 for r in iso)


def test_large_components_by_joins(spark):
    rows = [(name, *r) for name, family in FAMILIES.items() for r in family]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(canonicalise(df, max_chunk_triples=1).triples) == rows_of(canonicalise(df).triples)


def test_options(spark):
    pairs = spark.createDataFrame([("G", "_:a", "<p>", "_:b"), ("G", "_:c", "<p>", "_:d")], SCHEMA)
    assert canonicalise(pairs).triples.count() == 2
    assert canonicalise(pairs, distinguish_iso=False).triples.count() == 1
    chain = [("1", "_:a", "<p>", "_:b"), ("1", "_:b", "<p>", "_:c")]
    two = spark.createDataFrame([*chain, ("2", "_:x", "<p>", "_:y"), ("2", "_:y", "<p>", "_:z"), ("2", "<q>", "<p>", "<w>")], SCHEMA)
    of = lambda df, g: {r[1:] for r in rows_of(df) if r[0] == g}
    apart, shared = canonicalise(two).triples, canonicalise(two, unique_per_graph=False).triples
    assert not of(apart, "1") & of(apart, "2")
    assert of(shared, "1") < of(shared, "2")
    for scheme, width in H.WIDTH.items():
        found = canonicalise(two, scheme=scheme)
        assert {len(r.label) for r in found.labels.collect()} == {4 + 2 * width}


def test_timeout_is_reported(spark):
    found = canonicalise(spark.createDataFrame([("G", *r) for r in clique(6)], SCHEMA), timeout=-1.0)
    assert found.stats.first().status == "TIMEOUT"


def test_dirty_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = canonicalise(empty)
    assert found.triples.count() == found.labels.count() == found.graphs.count() == 0
    dirty = spark.createDataFrame([("G", None, "<p>", "_:a"), (None, "_:a", "<p>", "_:b"), ("G", "_:a", "<p>", '""'), ("G", "_:a", "<p>", '""')], SCHEMA)
    assert canonicalise(dirty).triples.count() == 1
    with pytest.raises(Exception, match="blank predicate"):
        graphs.normalise(spark.createDataFrame([("G", "<a>", "_:p", "<b>")], SCHEMA)).count()


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_components(spark, limit):
    rng = random.Random(1)
    links = [(f"g{rng.randrange(3)}", f"_:n{rng.randrange(60)}", f"_:n{rng.randrange(60)}") for _ in range(90)] + [("g9", "_:z", "_:z"), (None, "_:a", "_:b")]
    links += [("chain", f"_:c{i:03}", f"_:c{i + 1:03}") for i in range(40)]
    want = {}
    for g in {x[0] for x in links if x[0]}:
        nodes = {n for x in links if x[0] == g for n in x[1:]}
        comp = {n: n for n in nodes}
        for _ in nodes:
            for x in links:
                if x[0] == g:
                    comp[x[1]] = comp[x[2]] = min(comp[x[1]], comp[x[2]])
        want |= {(g, n): c for n, c in comp.items()}
    got = components_of_links(spark.createDataFrame(links, "g string, a string, b string"), limit)
    assert {(r.g, r.node): r.comp for r in got.collect()} == want
    alone = bnode_components(spark.createDataFrame([("G", "_:a", "<p>", '"x"'), ("G", "<u>", "<p>", "_:b")], SCHEMA))
    assert {(r.node, r.comp) for r in alone.collect()} == {("_:a", "_:a"), ("_:b", "_:b")}


def test_collisions_are_mended():
    import numpy as np

    from quadloom.operators.search import Chunk

    class Colliding(Chunk):
        def round(self, colours):
            return np.zeros_like(colours)

    none = np.zeros((0, 16), np.uint8)
    chunk = Colliding(5, np.zeros(0, int), np.zeros(0, int), none, none, none, np.array([0, 0, 0, 1, 1]), "md5")
    start = np.zeros((5, 16), np.uint8)
    start[[0, 3]] = 7
    stable, count, _, broken = chunk.refine(start)
    assert not broken.any() and count.tolist() == [2, 2]
    assert (stable[1] == stable[2]).all() and (stable[0] != stable[1]).any() and (stable[3] != stable[4]).any()


def test_independent_symmetries_cost_no_leaf_each(spark):
    def hub(n):
        arms = [(i, x) for i in range(n) for x in "ab"]
        return [r for i, x in arms for r in (("_:hub", f"<p{i}>", f"_:{x}{i}"), (f"_:{x}{i}", "<next>", f"_:{x}{i}y"))] + [("_:hub", "<leaf>", f"_:leaf{i}") for i in range(n)]

    rows = [("large", *r) for r in hub(30)] + [("small", *r) for r in hub(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = canonicalise(df)
    stats, hashes = {r.g: r for r in found.stats.collect()}, {r.g: r.ghash for r in found.graphs.collect()}
    assert {g: (r.leaves, r.status) for g, r in stats.items()} == {"large": (1, "OK"), "small": (1, "OK")}
    assert {r.g: r.ghash for r in canonicalise(graphs.renamed(df, 3)).graphs.collect()} == hashes
    assert {r.ghash for r in canonicalise(df.filter("g = 'small'"), prune=False).graphs.collect()} == {hashes["small"]}

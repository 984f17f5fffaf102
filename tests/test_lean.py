import itertools
import random
import time
from pathlib import Path

import pytest

from quadloom.operators import contain, edges, graphs
from quadloom.operators.core import best_solutions, solutions
from quadloom.operators.edges import candidates, fix_bnodes, node_edges, rarest_edges
from quadloom.operators.label import canonicalise
from quadloom.operators.lean import _first_look, lean, lean_trivially
from quadloom.runtime import _shared_dir, cut_lineage
from tests.test_label import FAMILIES, SCHEMA, both, clique, cycle, grid, rows_of, shuffled

PATH = [(f"_:n{i}", "<p>", f"_:n{i + 1}") for i in range(4)]
#: family: (triples, blank nodes and triples of its core)
CORES = {
    "cycle5": (cycle(5), 5, 5), "two": (cycle(3) + cycle(3, 3), 3, 3), "2and4": (cycle(2) + cycle(4, 2), 2, 2), "even6": (both(cycle(6)), 2, 2), "odd5": (both(cycle(5)), 5, 10),
    "k4": (clique(4), 4, 12), "grid": (grid(2, 3), 2, 2), "path": (PATH, 5, 4), "loop": ([*PATH[:3], ("_:x", "<p>", "_:x")], 1, 1), "star": (FAMILIES["star"], 2, 1),
    "onto": ([("_:a", "<p>", "_:b"), ("<u>", "<p>", "<v>")], 0, 1), "none": ([("<u>", "<p>", "<v>"), ("<u>", "<p>", '"x"')], 0, 2),
}


def core_size(triples):
    """Fewest blank nodes of an endomorphism's image, by trying all."""
    nodes = sorted({t for r in triples for t in (r[0], r[2]) if t.startswith("_:")})
    terms = sorted({t for r in triples for t in (r[0], r[2])})
    have = set(triples)
    best = len(nodes)
    for image in itertools.product(terms, repeat=len(nodes)):
        m = dict(zip(nodes, image, strict=True))
        if all((m.get(s, s), p, m.get(o, o)) in have for s, p, o in triples):
            best = min(best, len({x for s, p, o in triples for x in (m.get(s, s), m.get(o, o)) if x.startswith("_:")}))
    return best


def random_graph(seed):
    rng = random.Random(seed)
    terms = [f"_:b{i}" for i in range(4)] + ["<u>", "<v>"]
    return sorted({(rng.choice(terms), rng.choice(["<p>", "<q>"]), rng.choice(terms)) for _ in range(rng.randrange(3, 8))})


RANDOM = {f"random{i}": random_graph(i) for i in range(25)}


def check(spark, found, rows):
    """The core is part of the graph, and the map leads to it and is total."""
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(found.triples) <= set(rows)
    assert graphs.same_graphs(graphs.apply_map(df, found.mapping), found.triples)
    assert {(r.g, r.bnode) for r in found.mapping.collect()} == {(g, t) for g, s, _, o in rows for t in (s, o) if t.startswith("_:")}
    return {r.g: r for r in found.stats.collect()}


@pytest.mark.parametrize("options", [{}, {"prune": False, "seed": 7}, {"algorithm": "bfs"}, {"max_graph_triples": 0}], ids=str)
def test_cores(spark, options):
    rows = [(name, *r) for name, (family, *_) in CORES.items() for r in family] + [(name, *r) for name, family in RANDOM.items() for r in family]
    found = lean(spark.createDataFrame(rows, SCHEMA), **options)
    stats = check(spark, found, rows)
    for name, (_, bnodes, triples) in CORES.items():
        assert (stats[name].out_bnodes, stats[name].out_triples, stats[name].status) == (bnodes, triples, "OK"), name
    for name, family in RANDOM.items():
        assert stats[name].out_bnodes == core_size(family), name


def test_shuffles_have_one_core_and_leaning_again_changes_nothing(spark):
    rows = [(f"{name}/{v}", *r) for name, (family, *_) in CORES.items() for v in range(2) for r in (shuffled(family, v) if v else family)]
    once = lean(spark.createDataFrame(rows, SCHEMA))
    assert graphs.same_graphs(lean(once.triples).triples, once.triples)
    hashes = {r.g: r.ghash for r in canonicalise(once.triples).graphs.collect()}
    assert all(hashes[f"{name}/0"] == hashes[f"{name}/1"] for name in CORES)


def test_trivial_stage(spark):
    rows = [("G", "_:a", "<p>", '"1"'), ("G", "_:b", "<p>", '"1"'), ("G", "_:b", "<q>", '"2"'), ("G", "_:c", "<p>", '"1"'), ("G", "<u>", "<q>", '"2"'), ("G", "_:d", "<q>", '"2"')]
    reduced, mapping = lean_trivially(spark.createDataFrame(rows, SCHEMA))
    assert {(r.bnode, r.term) for r in mapping.collect()} == {("_:a", "_:b"), ("_:c", "_:b"), ("_:d", "<u>")}
    assert {r.s for r in reduced.collect()} == {"_:b", "<u>"}


def test_fixing_spreads(spark):
    rows = [("G", "_:a", "<p>", '"1"'), ("G", "_:a", "<n>", "_:b"), ("G", "_:b", "<n>", "_:c"), ("G", "_:c", "<n>", "<end>")]
    df = spark.createDataFrame(rows, SCHEMA)
    none = df.select("g", "s").limit(0).withColumnRenamed("s", "bnode")
    assert {r.bnode for r in candidates(df, none).filter("bnode = term").collect()} == {"_:a", "_:b", "_:c"}
    can, fixed = fix_bnodes(df)
    assert {r.bnode for r in fixed.collect()} == {"_:a", "_:b", "_:c"} and can.count() == 0
    edges = node_edges(df)
    assert edges.count() == 8
    assert rarest_edges(edges, none.unionByName(df.select("g", "s").limit(1).withColumnRenamed("s", "bnode"))).first().degree == 2


def test_breadth_first_joins(spark):
    rows = [("G", "_:a", "<p>", "_:b"), ("G", "<u>", "<p>", "<v>"), ("G", "<v>", "<p>", "<u>")]
    df = spark.createDataFrame(rows, SCHEMA)
    can, _ = fix_bnodes(df)
    placed = spark.createDataFrame([("G", "_:a", "_:a", "<p>", "_:b")], "g string, comp string, s string, p string, o string")
    found = solutions(df, placed, can)
    assert {tuple(sorted(r.m.items())) for r in found.collect()} == {(("_:a", x), ("_:b", y)) for x, y in (("_:a", "_:b"), ("<u>", "<v>"), ("<v>", "<u>"))}
    best = best_solutions(found).first()
    assert (best.range, best.domain) == (0, 2)


def test_empty_and_timeout(spark):
    assert lean(spark.createDataFrame([], SCHEMA)).triples.count() == 0
    rows = [("G", *r) for r in both(cycle(6))]
    found = lean(spark.createDataFrame(rows, SCHEMA), timeout=-1.0)
    assert found.stats.first().status == "TIMEOUT" and rows_of(found.triples) == set(rows)


def candidates_of(rows, fixed):
    """What each unfixed blank node of a graph could map to, by comparing all edge sets."""
    known = lambda t: not t.startswith("_:") or t in fixed
    sets = {}
    for s, p, o in rows:
        for sign, node, v in (("+", s, o), ("-", o, s)):
            sets.setdefault(node, set()).update([(sign, p, None)] + [(sign, p, v)] * known(v))
    return {(a, b) for a in sets for b in sets if a.startswith("_:") and a not in fixed and sets[a] <= sets[b]}


@pytest.mark.parametrize("limits", [{}, {"TOGETHER": 2, "BLOCK": 3}, {"KNOWN": 1}], ids=str)
def test_candidates_are_those_of_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(contain, name, value)
    hub = [(f"_:{x}", "<p>", f"<u{i}>") for x, n in (("m", 40), ("n", 50), ("k", 31), ("l", 32)) for i in range(n)]
    same = [(f"_:t{i}", "<p>", f"<u{i % 2}>") for i in range(9)] + [("<s>", "<p>", "<u0>"), ("<s>", "<p>", "<u1>")]
    families = RANDOM | {"hub": hub, "same": same, "both": hub + same, "half": PATH + both(PATH)}
    df = spark.createDataFrame([(g, *r) for g, family in families.items() for r in family], SCHEMA)
    for fixed in (set(), {"_:b0", "_:n1", "_:m"}):
        got = candidates(df, spark.createDataFrame([(g, x) for g in families for x in fixed], "g string, bnode string")).collect()
        assert len(got) == len(set(got))
        assert {(r.g, r.bnode, r.term) for r in got} == {(g, *x) for g, family in families.items() for x in candidates_of(family, fixed)}


def test_fixing_ends_where_nothing_is_linked(spark, monkeypatch):
    """No second look at all sets where no blank node is linked to a fixed one."""
    looks = []
    once = edges._others
    monkeypatch.setattr(edges, "_others", lambda *a: looks.append(1) or once(*a))
    rows = [("G", "_:a", "<p>", '"1"'), ("G", "_:b", "<p>", '"1"'), ("G", "_:b", "<q>", '"2"'), ("G", "_:c", "<n>", '"3"'), ("G", "_:d", "<n>", "_:e"), ("G", "_:e", "<p>", '"4"')]
    can, fixed = fix_bnodes(spark.createDataFrame(rows[:4], SCHEMA))
    assert {r.bnode for r in fixed.collect()} == {"_:b", "_:c"} and {(r.bnode, r.term) for r in can.collect()} == {("_:a", "_:a"), ("_:a", "_:b")}
    assert len(looks) == 1
    can, fixed = fix_bnodes(spark.createDataFrame(rows, SCHEMA))
    assert {r.bnode for r in fixed.collect()} == {"_:b", "_:c", "_:d", "_:e"} and {r.bnode for r in can.collect()} == {"_:a"}


def test_cut_tables_leave_no_shuffle_files(spark):
    folders = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p.name for f in folders for p in f.rglob("shuffle_*.data")}
    before = files()
    cut = cut_lineage(spark.range(1000).repartition(4, "id"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and cut.count() == 1000


def redundant_of(rows):
    """Blank nodes of a graph whose edges another term has too, and all such terms, by comparing all edge sets; of equal sets a ground term or the least node stays."""
    sets = {}
    for s, p, o in rows:
        sets.setdefault(s, set()).add(("+", p, o))
        sets.setdefault(o, set()).add(("-", p, s))
    order = lambda t: (t.startswith("_:"), t)
    found = {}
    for a in sets:
        for b in sets if a.startswith("_:") else ():
            if a != b and sets[a] <= sets[b] and (sets[a] != sets[b] or order(b) < order(a)):
                found.setdefault(a, set()).add(b)
    return found


@pytest.mark.parametrize("limits", [{}, {"TOGETHER": 2}, {"KNOWN": 1}, {"batch": 3}], ids=str)
def test_first_look_is_that_of_all_pairs(spark, monkeypatch, limits):
    key, batch = "spark.sql.execution.arrow.maxRecordsPerBatch", limits.get("batch", 10_000)
    for name, value in limits.items():
        if name != "batch":
            monkeypatch.setattr(contain, name, value)
    hub = [(f"_:{x}", "<p>", f"<u{i}>") for x, n in (("m", 40), ("n", 50), ("k", 31), ("l", 32), ("o", 50), ("r", 33)) for i in range(n)]
    ground = [("<h>", "<p>", f"<u{i}>") for i in range(60)] + [("<h>", "<q>", '"1"')] + [(f"_:{x}", "<p>", f"<u{i}>") for x, n in (("a", 1), ("b", 45), ("c", 60)) for i in range(n)]
    same = [(f"_:t{i}", "<p>", f"<u{i % 2}>") for i in range(9)] + [("<s>", "<p>", "<u0>"), ("<s>", "<p>", "<u1>")]
    odd = [("_:a", "<p>", f'"{x}"') for x in ("\u0001", "\u0002", "\u0003", "\u0003a", "\u0003b", "\u0001\u0002\u0003c", "")] + [("_:b", "<p>", '"\u0002"'), ("_:b", "", ""), ("", "<\u0001>", "_:c"), ("\u0003b", "\u0002", "\u0001")]
    families = RANDOM | {"hub": hub, "ground": ground, "same": same, "both": hub + same, "odd": odd, "path": PATH, "none": [("<u>", "<p>", f"<v{i}>") for i in range(70)], "lines": lines(20)}
    spark.conf.set(key, str(batch))
    try:
        unlinked = {g: r for g, r in families.items() if not any(s.startswith("_:") and o.startswith("_:") and s != o for s, _, o in r)}
        for graph_rows in (families, unlinked):
            rows = [(g, *r) for g, family in graph_rows.items() for r in family]
            look = _first_look(spark.createDataFrame([*rows, *rows[::-1], *rows[::7]], SCHEMA))
            got = [tuple(r) for r in look.rows.collect()]
            assert len(got) == len(set(got)) and set(got) == set(rows)
            found = {(r.g, r.bnode): r.term for r in look.found.collect()}
            want = {(g, a): terms for g, family in graph_rows.items() for a, terms in redundant_of(family).items()}
            assert found.keys() == want.keys() and all(found[k] in want[k] for k in want)
            assert look.linked == (graph_rows is families)
            if not look.linked:
                left = [tuple(r) for r in look.left.collect()]
                assert len(left) == len(set(left)) and set(left) == {r for r in rows if (r[0], r[1]) not in found and (r[0], r[3]) not in found}
    finally:
        spark.conf.unset(key)


def lines(n):
    """Two kinds of lines of each of `n` orders, of which one has all edges of the other."""
    return [r for i in range(n) for k in range(2) for r in [(f"<order/{i}>", "<has>", f"_:l{i}x{k}"), (f"_:l{i}x{k}", "<flag>", '"N"'), (f"_:l{i}x{k}", "<lstatus>", '"O"')] + [(f"_:l{i}x{k}", "<discounted>", '"true"')] * k]


def test_tables_of_an_unlinked_graph_take_little_room(spark):
    """Together no more than its triples as a table, and the result is right."""
    folder = lambda: Path(_shared_dir(spark).removeprefix("file:"))
    size = lambda f: sum(p.stat().st_size for p in f.rglob("*.parquet"))
    rows = [("G", *r) for r in lines(5_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    before = size(folder())
    cut = cut_lineage(df)
    plain = size(folder()) - before
    found = lean(cut)
    assert rows_of(found.triples) == {r for r in rows if "x0" not in r[1] + r[3]}
    assert size(folder()) - before - plain <= plain
    assert {(r.bnode, r.term) for r in found.mapping.collect()} == {(f"_:l{i}x{k}", f"_:l{i}x1") for i in range(5_000) for k in range(2)}
    stats = found.stats.first()
    assert (stats.triples, stats.bnodes, stats.out_triples, stats.out_bnodes, stats.status) == (35_000, 10_000, 20_000, 5_000, "OK")

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.llm.components import group_nodes, star_roots
from quadloom.llm.heavy_hitters import frequent_values, top_values
from quadloom.llm.quantiles import merge, percentiles, sketch
from quadloom.llm.term_counts import BurstTrie, Routes, count_terms, mark_terms

TERMS = ["", "a", "ab", "abc", "abd", "b", "é", "日本", "x" * 5000, "x" * 5000 + "y", "\u0000", "a b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=6), st.integers(1, 5)), max_size=80), st.integers(1, 5))
def test_trie_counts_as_a_dict(rows, burst):
    trie, want = BurstTrie(burst), defaultdict(lambda: [0, 0])
    for term, n in rows:
        trie.add(term, n, 1)
        want[term][0] += n
        want[term][1] += 1
    got = {p + s: c for p, held in trie.subtrees() for s, c in held.items()}
    assert got == dict(want) and trie.size == len(want)


def test_routes_agree_on_terms_and_bound_parts():
    routes = Routes([("ab", 10), ("ac", 10), ("b", 100), ("", 1)], route_terms=30)
    assert routes.prefix("abz") == "ab" and routes.prefix("a") == "a" and routes.prefix("bzz") == "b" and routes.prefix("zq") == "z"
    assert routes.parts == {"b": 4} and len({routes.part("b", f"b{i}") for i in range(100)}) == 4


@pytest.mark.parametrize("options", [{}, {"burst": 2, "flush_terms": 5, "route_terms": 3}, {"burst": 1, "max_routes": 2}], ids=str)
def test_term_counts(spark, options):
    rng = random.Random(3)
    rows = [(rng.choice(TERMS + [f"t{i}" for i in range(200)]), f"g{rng.randrange(9)}", "clash") for _ in range(3000)]
    rows += [(None, "g1", "x"), ("only null", None, "x"), (None, None, "x")] + [("hot", f"g{i % 9}", "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "p string, g string, term string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in mark_terms(df, "p", "g", **options).collect()}
    want = {}
    for p in {r[0] for r in rows if r[0] is not None}:
        own = [r[1] for r in rows if r[0] == p and r[1] is not None]
        if own:
            n = len(set(own))
            want[p] = (len(own), n, "rare" if n <= 2 else "common" if n > 0.3 * 9 else None)
    assert got == want


def test_term_counts_of_nothing(spark):
    df = spark.createDataFrame([], "p string, g string")
    assert count_terms(df, "p", "g").count() == 0 and mark_terms(df, "p", "g").count() == 0


def test_top_values(spark):
    rows = [("b",)] * 5 + [("a",)] * 5 + [("c",)] * 2 + [(None,)] * 9 + [("",)] * 3 + [(f"u{i}",) for i in range(50)]
    df = spark.createDataFrame(rows, "o string").withColumns({"n": F.lit("clash"), "value": F.lit("clash")})
    assert [tuple(r) for r in top_values(df, "o", 3).collect()] == [("a", 5), ("b", 5), ("", 3)]
    counts = Counter(r[0] for r in rows if r[0] is not None)
    for share in (0.01, 0.04, 0.5):
        assert {r.value for r in frequent_values(df, "o", share).collect()} == {v for v, n in counts.items() if n >= share * len(rows)}
    assert frequent_values(df.limit(0), "o", 0.1).count() == 0


def brute_groups(nodes, links):
    group = {n: n for n in nodes}
    for _ in range(len(nodes)):
        for g, a, b in links:
            group[g, a] = group[g, b] = min(group[g, a], group[g, b])
    return group


@pytest.mark.parametrize("hub", [200_000, 3])
def test_groups(spark, hub):
    rng = random.Random(5)
    links = [(f"g{rng.randrange(2)}", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    links += [("chain", f"c{i:03}", f"c{i + 1:03}") for i in range(64)] + [("star", "hub", f"s{i}") for i in range(50)] + [("star", f"s{i}", f"t{i}") for i in range(20)]
    links += [("zig", f"z{i if i % 2 else 99 - i:02}", f"z{i + 1 if (i + 1) % 2 else 98 - i:02}") for i in range(30)]
    links += links[:5] + [(g, b, a) for g, a, b in links[:5]]
    nodes = {(g, x) for g, a, b in links for x in (a, b)} | {("g0", "alone"), ("g9", "alone")}
    dirty = [*links, (None, "a", "b"), ("g0", None, "n1"), ("g0", "n1", "n1")]
    df = spark.createDataFrame(dirty, "g string, a string, b string").withColumn("root", F.lit("clash"))
    known = spark.createDataFrame([*nodes, (None, "x"), ("g0", None), ("g0", "alone")], "g string, node string")
    got = {(r.g, r.node): r.group_node for r in group_nodes(known, df, "g", "node", "a", "b", hub_degree=hub).collect()}
    want = brute_groups({(g, x): 0 for g, x in nodes | {("g0", "n1")}}, [(g, a, b) for g, a, b in links])
    want = {k: (v[1] if isinstance(v, tuple) else v) for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if k in nodes}


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "g string, a string, b string")
    lone = spark.createDataFrame([("g", "x")], "g string, node string")
    assert [tuple(r) for r in group_nodes(lone, none, "g", "node", "a", "b").collect()] == [("g", "x", "x")]
    assert group_nodes(lone.limit(0), none, "g", "node", "a", "b").count() == 0
    with pytest.raises(RuntimeError, match="not converged"):
        star_roots(spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long"), max_rounds=1)


def test_percentiles_are_within_the_error_and_merge(spark):
    rng = random.Random(9)
    values = [(f"op{i % 3}", None if i % 5 == 0 else "w", i, float(f)) for i, f in enumerate([0, 0, 1, 1, 2, -5, -1e-3, 1e-9, 9e17] + [rng.lognormvariate(5, 3) for _ in range(3000)])]
    values += [("op0", "w", 10**6, None), ("op0", "w", 10**6 + 1, float("nan")), ("op0", "w", 10**6 + 2, float("inf"))]
    df = spark.createDataFrame(values, "op string, workload string, id long, runtime double").withColumn("bucket", F.lit("clash"))
    error = 0.01
    whole = sketch(df, ["op", "workload"], ["runtime"], error)
    parts = merge(*(sketch(df.filter(F.col("id") % 3 == i), ["op", "workload"], ["runtime"], error) for i in range(3)))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.select(whole.columns).collect()}
    pcts = [1, 25, 50, 75, 95, 99, 100]
    got = {(r.op, r.workload, r.pct): r.value for r in percentiles(parts, pcts, error).collect()}
    for op, w in {v[:2] for v in values}:
        own = sorted(v[3] for v in values if v[:2] == (op, w) and v[3] is not None and math.isfinite(v[3]))
        for p in pcts:
            exact = own[max(1, -(-p * len(own) // 100)) - 1]
            assert abs(got[op, w, p] - exact) <= error * abs(exact) * 1.0001, (op, w, p)
    assert percentiles(parts, pcts, error, least_values=10**9).count() == 0
    assert percentiles(sketch(df.limit(0), ["op"], ["runtime"]), [50]).count() == 0

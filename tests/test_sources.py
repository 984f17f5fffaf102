import gzip

from pyspark.sql import functions as F

from quadloom import __main__ as cli
from quadloom.functions.terms import parts, safe_label, skolem
from quadloom.operators import graphs, metrics
from quadloom.operators.ranks import number_within
from quadloom.sources import edgelist, ntriples, run_log
from quadloom.streaming.dedup import deduplicate, unseen
from tests.test_label import SCHEMA, cycle, golden_rows, rows_of

TEXT = '<a:s> <a:p> "é . \\" <x>"@en <a:g> .\n_:1x <a:p> _:b.c .\n# note\n\n<a:s> <a:p> .\n<a:s><a:p><a:o><a:g><a:more>.\n'
WANT = {("<a:g>", "<a:s>", "<a:p>", '"é . \\" <x>"@en'), ("<d>", "_:1x", "<a:p>", "_:b.c"), ("<a:g>", "<a:s>", "<a:p>", "<a:o>")}


def test_scan_and_sink(spark, tmp_path):
    (tmp_path / "in.nq").write_text(TEXT)
    with gzip.open(tmp_path / "in.nq.gz", "wt") as f:
        f.write(TEXT)
    (tmp_path / "latin.nq").write_text(TEXT, encoding="latin-1")
    assert rows_of(ntriples.read_triples(spark, str(tmp_path / "in.nq"), "<d>")) == WANT
    assert rows_of(ntriples.read_triples(spark, str(tmp_path / "in.nq.gz"), "<d>", partitions=3)) == WANT
    assert rows_of(ntriples.read_triples(spark, str(tmp_path / "latin.nq"), "<d>", encoding="ISO-8859-1")) == WANT
    _, rejects = ntriples.triples_of(ntriples.read_lines(spark, str(tmp_path / "in.nq")))
    assert [r.line for r in rejects.collect()] == ["<a:s> <a:p> ."]
    df = spark.createDataFrame(list(WANT), SCHEMA)
    for options in ({}, {"gzip": True}, {"encoding": "ISO-8859-1"}):
        ntriples.write_triples(df, str(tmp_path / "out"), with_graph=True, **options)
        assert rows_of(ntriples.read_triples(spark, str(tmp_path / "out"), encoding=options.get("encoding", "UTF-8"))) == WANT
    loaded, bad = ntriples.read_strict(spark, str(tmp_path / "in.nq"))
    assert loaded.count() == 1 and bad.count() == 3
    stats = spark.createDataFrame([("<a:g>", "TIMEOUT"), ("<d>", "OK")], "g string, status string")
    ntriples.write_failed(df, stats, str(tmp_path / "failed"))
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 2


def test_terms(spark):
    df = spark.createDataFrame([("_:1a",), ("<i:x>",), ('"v"@en',), ('"v\n"^^<d>',), ('""',), (None,)], "t string")
    got = [tuple(r.x) if r.x else None for r in df.select(parts("t").alias("x")).collect()]
    assert got == [("bnode", "1a", None, None), ("iri", "i:x", None, None), ("literal", "v", "en", None), ("literal", "v\n", None, "d"), ("literal", "", None, None), (None, None, None, None)]
    assert [tuple(r) for r in df.limit(2).select(safe_label("t"), skolem("t", "q", False), skolem("t", "q")).collect()] == [("_:j1a", "<q1a>", "_:q1a"), ("<i:x>",) * 3]


def test_edge_lists_and_cases(spark, tmp_path):
    (tmp_path / "grid").mkdir()
    (tmp_path / "grid" / "g-10").write_text("c x\ne 1 2\np 3\n")
    (tmp_path / "grid" / "g-2").write_text("e 1 2\ne 2 3\n")
    (tmp_path / "grid" / "g-x").write_text("")
    (tmp_path / "grid" / "g-3.zip").write_text("")
    assert [(r.family, r.k) for r in edgelist.read_cases(spark, str(tmp_path)).collect()] == [("grid", 2), ("grid", 10)]
    rows = edgelist.read_edges(spark, str(tmp_path / "grid" / "g-10")).collect()
    assert {(r.s, r.p, r.o) for r in rows} == {("_:b1", "<p>", "_:b2"), ("_:b2", "<p>", "_:b1")}
    cli.main(["convert", "-i", str(tmp_path / "grid" / "g-2"), "-o", str(tmp_path / "nt")], spark)
    assert spark.read.text(str(tmp_path / "nt")).count() == 4


def test_logs(spark):
    lines = ["LEAN\td1\t10\t4\t\t7\t8\t2\t3\t1\t1\t2\t2", "LABEL\td1\t8\t2\t5\t3\t1", "LEAN\td2\t9\t9\t600000\t-600000\tTimeout\tx", "NOBNODES\td3\t12\t0", "TEST\td1\t8\t2\t100\tOKAY"]
    got = {(r.op, r.doc): r for r in run_log.read_rows(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert (got["LEAN", "d1"].ms, got["LEAN", "d1"].out_triples, got["LEAN", "d1"].solutions) == (7, 8, 1)
    assert (got["LABEL", "d1"].rounds, got["LABEL", "d1"].leaves) == (3, 1)
    assert got["LEAN", "d2"].status == "Timeout" and got["NOBNODES", "d3"].triples == 12 and got["TEST", "d1"].status == "OKAY"


def test_logs_keep_nulls_and_failures(spark):
    rows = [
        ("LEAN", "g", 10, 3, None, "OK", 8, 2, 4, 1, 1, None, None), ("LEAN", None, 10, None, 5, "OK", None, 2, None, 1, 1, None, None),
        ("LABEL", "g", 10, 3, None, "OK", None, None, None, None, None, 2, 1), ("LABEL", "h", None, 3, -7, "OK", None, None, None, None, None, None, 1),
        ("LEAN", "g", 10, 3, None, "TIMEOUT", None, None, None, None, None, None, None), ("LABEL", "g", 10, None, 4, None, None, None, None, None, None, None, None),
        ("TEST", "g", None, 3, None, "OK", None, None, None, None, None, None, None), ("TEST", "g", 10, 3, None, "Failure", None, None, None, None, None, None, None),
        ("NOBNODES", "i", 12, 0, None, "OK", None, None, None, None, None, None, None), ("NOBNODES", "j", 12, 0, 6, "OK", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('op', 'doc', 'status') else 'bigint'}" for c in run_log.COLUMNS))
    lines = run_log.as_lines(df)
    assert not any("\t\t" in r.value for r in lines.collect())
    assert [tuple(r) for r in run_log.read_rows(lines).collect()] == rows


def test_batch_log_is_analysed_as_it_was_run(spark, tmp_path):
    ntriples.write_triples(spark.createDataFrame([("<h>", *r) for r in cycle(3)], SCHEMA), str(tmp_path / "in"), with_graph=True)
    cli.main(["batch", "-i", str(tmp_path / "in"), "--mode", "BOTH", "-o", str(tmp_path / "log")], spark)
    got = {r.op: r for r in run_log.read_rows(spark.read.text(str(tmp_path / "log"))).collect()}
    assert (got["LEAN"].ms, got["LEAN"].out_triples, got["LEAN"].out_bnodes) == (None, 3, 3)
    assert got["LABEL"].ms is None and got["LABEL"].rounds is not None and got["LABEL"].leaves is not None


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(100)], "k int, i int").repartition(4)
    found = {}
    for r in number_within(df, ["k"], "n").collect():
        found.setdefault(r.k, []).append(r.n)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in found.values()) and sum(map(len, found.values())) == 100


def test_runs(spark):
    order = ["a", "a", None, None, "b", "a", "a", "b"]
    df = spark.createDataFrame([(i * 400_000, g) for i, g in enumerate(order)], "i long, g string")
    got = sorted(((r.run, r.g, r.statements) for r in metrics.runs_of_graphs(df, "i").collect()), key=lambda x: x[0])
    assert [x[1:] for x in got] == [("a", 2), (None, 2), ("b", 1), ("a", 2), ("b", 1)]


def test_streamed_graphs_are_deduplicated(spark, tmp_path):
    rows = golden_rows("<1>") + [("<2>", s.replace("_:", "_:q"), p, o.replace("_:", "_:q")) for _, s, p, o in golden_rows()] + [("<3>", "_:a", "<p>", "<x>")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept, new = unseen(df, spark.createDataFrame([], "ghash string"))
    assert {r.g for r in new.collect()} == {"<1>", "<3>"} == {r.g for r in kept.collect()}
    df.write.parquet(str(tmp_path / "in"))
    run = deduplicate(str(tmp_path / "out"), str(tmp_path / "state"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination()
    run(df.filter("g = '<2>'"), 7)
    assert spark.read.parquet(str(tmp_path / "state")).count() == 2
    assert {r.g for r in spark.read.parquet(str(tmp_path / "out")).select("g").distinct().collect()} == {"<1>", "<3>"}


def test_command_line(spark, tmp_path, capsys):
    ntriples.write_triples(spark.createDataFrame(golden_rows("<g>") + [("<h>", *r) for r in cycle(3)], SCHEMA), str(tmp_path / "in"), with_graph=True)
    cli.main(["label", "-i", str(tmp_path / "in"), "-b", "-l"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 7
    cli.main(["batch", "-i", str(tmp_path / "in"), "--mode", "BOTH", "-o", str(tmp_path / "log")], spark)
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sum(x.startswith("LEAN") for x in lines) == 2 and sum(x.startswith("LABEL") for x in lines) == 2
    cli.main(["analyse", "-i", str(tmp_path / "log")], spark)
    assert "# totals" in capsys.readouterr().out
    cli.main(["control", "-i", str(tmp_path / "in")], spark)
    assert sorted(capsys.readouterr().out.splitlines()) == ["<g>\t7", "<h>\t3"]


def test_set_operations(spark):
    a = spark.createDataFrame(golden_rows(), SCHEMA)
    b = a.limit(3)
    left, right = graphs.difference(a, b)
    assert left.count() == 4 and right.count() == 0
    assert graphs.contains(a, b) and not graphs.contains(b, a) and graphs.same_graphs(graphs.union(a, b), a)
    assert graphs.renamed(a, 3).count() == 7 and not graphs.same_graphs(graphs.renamed(a, 3), a)
    mapping = graphs.bnodes(a).withColumn("term", F.col("bnode"))
    assert graphs.is_identity(mapping) and graphs.same_graphs(graphs.apply_map(a, mapping), a)

import re
from datetime import date

from quadloom.operators.parse_rows import load_terms, reject_reasons

IRI = r"<[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
BNODE = r"_:[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])?"
LIT = r'"(?:[^"\\\r\n]|\\[tbnrf"' + "'" + r"\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*" + '"'
OBJ = f"({IRI}|{BNODE}|{LIT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\\^\\^{IRI})?)"
W = r"[ \t]*"
TAIL = rf"{W}\.{W}(?:#.*)?"
FULL = {"nt": f"(?:{IRI}|{BNODE}){W}{IRI}{W}{OBJ}{TAIL}", "nq": f"(?:{IRI}|{BNODE}){W}{IRI}{W}{OBJ}{W}(?:{IRI}|{BNODE}){TAIL}"}


def valid(fmt, line):
    """Brute force: one backtracking expression for the whole line."""
    if line is None:
        return False
    t = line.strip(" \t\r")
    if not t or t.startswith("#"):
        return True
    m = re.fullmatch(FULL[fmt], t, re.S) if fmt in FULL else None
    if not m:
        return False
    typed = re.fullmatch(r'"(.*)"\^\^<http://types\.example/xs#(\w+)>', m[1], re.S)
    if not typed:
        return True
    v, kind = typed.groups()
    if kind == "integer":
        return bool(re.fullmatch(r"[+-]?[0-9]+", v))
    if kind == "decimal":
        return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", v))
    if kind == "boolean":
        return v in ("true", "false", "1", "0")
    if kind == "date":
        try:
            return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v)) and bool(date.fromisoformat(v))
        except ValueError:
            return False
    return True


X = "http://types.example/xs#"
LINES = [
    None, "", " \t\r", "# note", "  # note", "<a:b> <a:p> <a:c> .", "<a:b><a:p>_:c.", "_:a <a:p> _:a.b .", "_:a <a:p> _:a. .", "_:.a <a:p> _:b .",
    "_:a.<a:p><a:c>.", "<a:b> <a:p> <a:c>", "<a:b> <a:p> <a:c> . x", "<a:b> <a:p> <a:c> . # x . y", "<a:b> <a:p> . ", "<a:b> <a:p> <a:c> <a:d> .", "<a:b> <a:p> <a:c> <a:d> <a:e> .",
    '<a:b> <a:p> "x" .', '<a:b> <a:p> "x\\q" .', '<a:b> <a:p> "x\\"y" .', '<a:b> <a:p> "x .', '<a:b> <a:p> "x"@en .', '<a:b> <a:p> "x"@en-GB-1 .', '<a:b> <a:p> "x"@1 .', '<a:b> <a:p> "x"@en- .', '<a:b> <a:p> "x" @en .',
    '<a:b> <a:p> "x"@en_:g .', "<a:b> <a:p> _:a_:g .", "<a:b> <a:p> _:__:g .", '<a:b> "p" <a:c> .', "<a:b> _:p <a:c> .", '"s" <a:p> <a:c> .', "<b> <a:p> <a:c> .", "<a:b c> <a:p> <a:c> .", "<a:b <a:p> <a:c> .", "<a:\\u00e9> <a:p> <a:c> .", "<a:\\u00e> <a:p> <a:c> .",
    *(f'<a:b> <a:p> "{v}"^^<{X}{k}> .' for k in ("integer", "decimal", "boolean", "date", "other") for v in ("1", "+1", "-1.5", ".5", "5.", ".", "", "+", "1e3", "true", "TRUE", "0", "2024-02-29", "2023-02-29", "2023-2-09", "2023-13-01", "1.2.3", " 1")),
    '<a:b> <a:p> "x"^^<bad> .', '<a:b> <a:p> "x"^<a:b> .', '<a:b> <a:p> "tab\there" .', '<a:b> <a:p> "cr\rhere" .', "<a:b>\u00a0<a:p> <a:c> .", "a b c", ".", "...", "<a:b> <a:p> <a:c> ..", "\r<a:b> <a:p> <a:c> .\r\r", "<a:b>\r<a:p> <a:c> .",
    '<a:b> <a:p> "' + "y" * 300_000 + '" .', "<a:" + "z" * 300_000 + "> <a:p> _:" + "b." * 100_000 + "c .", '<a:b> <a:p> "' + "\\t" * 200_000, "<" * 50_000,
]


def test_rejects_match_brute_force(spark):
    rows = [(i, fmt, line, "extra") for i, (fmt, line) in enumerate((f, x) for f in ("nt", "nq", None, "ttl") for x in LINES)]
    df = spark.createDataFrame(rows, "line_id long, fmt string, line string, reason string")
    got = {r.line_id: r.reasons for r in reject_reasons(df).collect()}
    want = {i for i, fmt, line, _ in rows if not valid(fmt, line)}
    assert set(got) == want
    assert all(got.values())
    assert got[0] == ["null line"]
    loaded = load_terms(df).collect()
    assert {r.line_id for r in loaded} == {i for i, fmt, line, _ in rows if valid(fmt, line) and line.strip(" \t\r") and not line.strip(" \t\r").startswith("#")}
    assert all(r.s and r.p and r.o for r in loaded)


def test_null_keys_repeats_and_empty(spark):
    schema = "line_id long, fmt string, line string"
    df = spark.createDataFrame([(None, "nt", "x"), (1, "nt", "x"), (2, "nt", "x"), (3, "nt", "<a:b> <a:p> <a:c> .")], schema)
    got = reject_reasons(df).collect()
    assert sorted((r.line_id is None, r.line_id or 0) for r in got) == [(False, 1), (False, 2), (True, 0)]
    assert load_terms(df).count() == 1
    empty = spark.createDataFrame([], schema)
    assert reject_reasons(empty).count() == 0 and load_terms(empty).count() == 0

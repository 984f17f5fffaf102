"""Separate text rows that fail to parse from those that load.

Every line is cut into cells, the cells are exploded to (row, column, value),
joined with a table of rules, and the broken rules of a row are gathered as its
reasons. The rows without a reason are found by anti-join and load as terms.

Defined results
---------------
* A null line is rejected ("null line"). Blank lines and comments are valid and
  load no terms. Spaces, tabs and carriage returns around a line don't count.
* A null or unknown `fmt` is rejected ("unknown format") unless the line is
  blank or a comment.
* Repeated lines are judged one by one under their own key. The key must be
  unique; rows with a null key are rejected ("null key").
* An empty input gives empty results. Further columns of the input are ignored,
  whatever their names, as only key, format and line are selected.
* Every pattern is free of backtracking, so a line of any length is safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of the line format and the datatypes with checked values.
_ESC_U = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = r"<[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>\"{}|^`\\]|" + _ESC_U + ")*+>"
_BNODE = r"_:[A-Za-z0-9_](?:[A-Za-z0-9_\-]|\.+(?=[A-Za-z0-9_\-]))*+"
_QUOTED = r'"(?:[^"\\\r\n]|\\[tbnrf"' + r"'\\]|" + _ESC_U + r')*+"'
_LANG = r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*+"
_TYPES = "http://types.example/xs#"

#: The lexer is laxer than the rules, so that a broken term is still one cell.
_LEXER = (
    r"(?s)<[^>]*+>?"
    r"|_:(?:[A-Za-z0-9_\-](?!:)|\.(?=[.]*[A-Za-z0-9_\-]))*+"
    r'|"(?:[^"\\]|\\.)*+"?(?:@[A-Za-z0-9\-]*+|\^\^<[^>]*+>?)?'
    r"|\.|#.*+|[^ \t<\"_.#]++|_"
)


_KIND_NAMES = "IBL?"


@dataclass(frozen=True)
class Rule:
    """`check` is applied to the cells of `kind` in column `col` of the rows of `fmt`; column -1 holds the row's shape."""

    fmt: str
    col: int
    kind: str
    check: str
    reason: str


_COLUMNS = {"nt": ("subject", "predicate", "object"), "nq": ("subject", "predicate", "object", "graph")}
_KINDS = {"subject": "IB", "predicate": "I", "object": "IBL", "graph": "IB"}


def rules() -> list[Rule]:
    """The rule table of N-Triples (`nt`) and N-Quads (`nq`) lines."""
    found = []
    for fmt, names in _COLUMNS.items():
        n = len(names)
        found += [
            Rule(fmt, -1, "row", f"few{n}", f"fewer than {n} terms"),
            Rule(fmt, -1, "row", f"many{n}", f"more than {n} terms"),
            Rule(fmt, -1, "row", "dot", "no full stop at the end"),
            Rule(fmt, -1, "row", "rest", "text after the full stop"),
        ]
        for i, name in enumerate(names):
            for kind in _KIND_NAMES:
                if kind not in _KINDS[name]:
                    found.append(Rule(fmt, i, kind, "never", f"{name}: wrong kind of term"))
            found.append(Rule(fmt, i, "I", "iri", f"{name}: broken IRI"))
            found.append(Rule(fmt, i, "B", "bnode", f"{name}: broken blank node"))
            found.append(Rule(fmt, i, "L", "quote", f"{name}: broken quoting or escape"))
            found.append(Rule(fmt, i, "L", "suffix", f"{name}: broken language or datatype"))
            if "L" in _KINDS[name]:
                found += [Rule(fmt, i, "L", kind, f"{name}: no {kind}") for kind in ("integer", "decimal", "boolean", "date")]
    return found


def _kind(cell: Column) -> Column:
    return (
        F.when(cell.startswith("<"), "I").when(cell.startswith("_:"), "B").when(cell.startswith('"'), "L")
        .when(cell == ".", ".").when(cell.startswith("#"), "#").otherwise("?")
    )


def _violated(check: Column, v: Column) -> Column:
    """Is the rule `check` broken by the cell `v` of its kind? One literal pattern per check, compiled once."""
    terms = F.length(F.regexp_extract(v, r"^([^.#]*)", 1))
    value = lambda t: F.regexp_extract(v, f'^"([^"]*)"\\^\\^<{_TYPES}{t}>\\z', 1)
    typed = lambda t: v.endswith(f'"^^<{_TYPES}{t}>')
    return (
        F.when(check == "iri", ~v.rlike(f"^{_IRI}\\z"))
        .when(check == "bnode", ~v.rlike(f"^{_BNODE}\\z"))
        .when(check == "quote", ~v.rlike(f"^{_QUOTED}"))
        .when(check == "suffix", v.rlike(f"^{_QUOTED}") & ~v.rlike(f"^{_QUOTED}(?:{_LANG}|\\^\\^{_IRI})?\\z"))
        .when(check == "integer", typed("integer") & ~value("integer").rlike(r"^[+\-]?[0-9]++\z"))
        .when(check == "decimal", typed("decimal") & ~value("decimal").rlike(r"^[+\-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)\z"))
        .when(check == "boolean", typed("boolean") & ~value("boolean").isin("true", "false", "1", "0"))
        .when(check == "date", typed("date") & ~(value("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & value("date").try_cast("date").isNotNull()))
        .when(check.startswith("few"), terms < F.substring(check, 4, 1).cast("int"))
        .when(check.startswith("many"), terms > F.substring(check, 5, 1).cast("int"))
        .when(check == "dot", ~v.contains("."))
        .when(check == "rest", F.regexp_extract(v, r"^[^.#]*\.(.*)$", 1).rlike("[^#]"))
        .otherwise(check == "never")
    )


def _prepared(lines: DataFrame, key: str, fmt: str, line: str) -> DataFrame:
    text = F.regexp_replace(F.col(line), r"^[ \t\r]++|[ \t\r]++$", "")
    return (
        lines.select(F.col(key).alias("key"), F.col(fmt).alias("fmt"), F.col(line).alias("line"), text.alias("text"))
        .withColumn("idle", F.coalesce((F.col("text") == "") | F.col("text").startswith("#"), F.lit(False)))
    )


def _cells(rows: DataFrame) -> DataFrame:
    """(key, fmt, cells): the cells of every line that should be a statement."""
    return rows.filter(F.col("key").isNotNull() & F.col("text").isNotNull() & ~F.col("idle") & F.col("fmt").isin(*_COLUMNS)).select(
        "key", "fmt", F.regexp_extract_all("text", F.lit(_LEXER), F.lit(0)).alias("cells")
    )


def reject_reasons(lines: DataFrame, key: str = "line_id", fmt: str = "fmt", line: str = "line") -> DataFrame:
    """(key, reasons): every row that fails to parse with the sorted list of the rules it breaks.

    The rule table is a constant of some dozen rows and is broadcast. Broken
    rules are filtered before the only shuffle, which moves nothing of the valid
    rows; a row has at most as many reasons as there are rules.
    """
    spark = lines.sparkSession
    rows = _prepared(lines, key, fmt, line)
    whole = rows.filter(F.col("key").isNotNull()).select(
        "key",
        F.when(F.col("text").isNull(), "null line").when(~F.col("idle") & ~F.coalesce(F.col("fmt").isin(*_COLUMNS), F.lit(False)), "unknown format").alias("reason"),
    )
    shape = F.array_join(F.transform("cells", _kind), "")
    cells = _cells(rows).select(
        "key", "fmt", F.explode(F.concat(
            F.array(F.struct(F.lit(-1).alias("col"), F.lit("row").alias("kind"), shape.alias("value"))),
            F.transform(F.slice("cells", 1, 4), lambda v, i: F.struct(i.cast("int").alias("col"), _kind(v).alias("kind"), v.alias("value"))),
        )).alias("cell"),
    ).select("key", "fmt", "cell.col", "cell.kind", "cell.value")
    table = spark.createDataFrame([(r.fmt, r.col, r.kind, r.check, r.reason) for r in rules()], "fmt string, col int, kind string, check string, reason string")
    broken = cells.join(F.broadcast(table), ["fmt", "col", "kind"]).filter(_violated(F.col("check"), F.col("value"))).select("key", "reason")
    nameless = rows.filter(F.col("key").isNull()).select("key", F.lit("null key").alias("reason"))
    return (
        whole.filter(F.col("reason").isNotNull()).unionByName(broken).groupBy("key").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
        .unionByName(nameless.select("key", F.array("reason").alias("reasons")))
        .withColumnRenamed("key", key)
    )


def load_terms(lines: DataFrame, key: str = "line_id", fmt: str = "fmt", line: str = "line") -> DataFrame:
    """(key, s, p, o, g): the terms of the valid statements; `g` is null for triples.

    The clean rows are the anti-join of all rows with the rejected ones.
    """
    bad = reject_reasons(lines, key, fmt, line).filter(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    good = _cells(_prepared(lines, key, fmt, line)).join(bad, "key", "left_anti")
    return good.select(
        F.col("key").alias(key), F.get("cells", F.lit(0)).alias("s"), F.get("cells", F.lit(1)).alias("p"), F.get("cells", F.lit(2)).alias("o"),
        F.when(F.col("fmt") == "nq", F.get("cells", F.lit(3))).alias("g"),
    )

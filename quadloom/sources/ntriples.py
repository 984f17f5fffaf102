"""N-Triples and N-Quads text: scan and sink."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import safe_label
from quadloom.operators.parse_rows import load_terms, reject_reasons

_TERM = r'<[^>]*+>|_:(?:[A-Za-z0-9_\-](?!:)|\.(?=[.]*[A-Za-z0-9_\-]))++|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9\-]++|\^\^<[^>]*+>)?'


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", partitions: int | None = None) -> DataFrame:
    """(line, src_file) of text files, gzipped ones by their suffix.

    Gzip can't be split, so a few large files need `partitions` to spread their
    lines. Other encodings than UTF-8 are read through the CSV source, which
    decodes them, with neither separator nor quotes.
    """
    if encoding.upper().replace("-", "") == "UTF8":
        lines = spark.read.text(path).withColumnRenamed("value", "line")
    else:
        lines = spark.read.schema("line string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("escape", "").option("comment", "").csv(path)
    lines = lines.select("line", F.col("_metadata.file_path").alias("src_file"))
    return lines.repartition(partitions) if partitions else lines


def tuples(lines: DataFrame) -> DataFrame:
    """(line, terms): the terms of each line that isn't blank or a comment, however many."""
    text = F.trim("line")
    return lines.filter(F.col("line").isNotNull() & (text != "") & ~text.startswith("#")).select("line", F.regexp_extract_all("line", F.lit("(?s)" + _TERM), F.lit(0)).alias("terms"))


def triples_of(lines: DataFrame, graph: str | None = None, safe_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(g, s, p, o) of lines with at least three terms, further ones cut off, and the lines with fewer.

    The graph is the fourth term; lines without one belong to `graph`. With
    `safe_labels`, blank labels that start with a digit get a letter in front.
    """
    found = tuples(lines)
    good = found.filter(F.size("terms") >= 3)
    term = lambda i: F.get("terms", F.lit(i))
    end = (lambda c: safe_label(c)) if safe_labels else (lambda c: c)
    g = F.coalesce(term(3), F.lit(graph)) if graph is None or graph != "" else term(3)
    return good.select(g.alias("g"), end(term(0)).alias("s"), term(1).alias("p"), end(term(2)).alias("o")), found.filter(F.size("terms") < 3).select("line")


def read_triples(spark: SparkSession, path: str | list[str], graph: str = "<default>", encoding: str = "UTF-8", partitions: int | None = None) -> DataFrame:
    """(g, s, p, o) of N-Triples or N-Quads files; every file's blank nodes belong to their graph."""
    return triples_of(read_lines(spark, path, encoding, partitions), graph)[0]


def read_strict(spark: SparkSession, path: str | list[str], fmt: str = "nq") -> tuple[DataFrame, DataFrame]:
    """The terms of the valid lines, and (line_id, reasons) of the others."""
    lines = read_lines(spark, path).withColumns({"line_id": F.monotonically_increasing_id(), "fmt": F.lit(fmt)})
    return load_terms(lines), reject_reasons(lines)


def as_lines(triples: DataFrame, with_graph: bool = False) -> DataFrame:
    """(value): one statement a line."""
    terms = ["s", "p", "o", "g"] if with_graph else ["s", "p", "o"]
    return triples.select(F.concat_ws(" ", *terms, F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str, with_graph: bool = False, gzip: bool = False, encoding: str = "UTF-8") -> None:
    """Write statements as text; gzipped on request."""
    lines = as_lines(triples, with_graph)
    options = {"compression": "gzip"} if gzip else {}
    if encoding.upper().replace("-", "") == "UTF8":
        lines.write.mode("overwrite").options(**options).text(path)
    else:
        lines.write.mode("overwrite").options(**options, encoding=encoding, sep="\u0001", quote="", escape="", escapeQuotes="false").csv(path)


def write_failed(triples: DataFrame, stats: DataFrame, path: str) -> None:
    """The triples of graphs whose status isn't OK, in a folder for each graph."""
    failed = stats.filter(F.col("status") != "OK").select("g")
    triples.join(failed, "g", "left_semi").withColumn("graph", F.url_encode("g")).select("graph", "s", "p", "o").write.mode("overwrite").partitionBy("graph").parquet(path)


def from_stdin(spark: SparkSession, graph: str = "<stdin>") -> DataFrame:
    """Triples from standard input, for use on one machine."""
    return triples_of(spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "line string"), graph)[0]


def to_stdout(lines: Iterable) -> None:
    for row in lines:
        sys.stdout.write(row[0] + "\n")

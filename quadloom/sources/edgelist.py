"""Undirected edge lists (`e <i> <j>` lines) and folders of such benchmark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the predicate of converted edges.
EDGE_PREDICATE = "<p>"


def edges_of(lines: DataFrame, by: str = "src_file") -> DataFrame:
    """(g, s, p, o): both directions of each edge line as blank nodes; other lines don't count."""
    token = F.split(F.trim("line"), r"\s+")
    edges = lines.filter(F.col("line").startswith("e") & (F.size(token) >= 3)).select(F.col(by).alias("g"), F.concat(F.lit("_:b"), F.get(token, F.lit(1))).alias("a"), F.concat(F.lit("_:b"), F.get(token, F.lit(2))).alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o"))))
    return edges.select("g", both.alias("e")).select("g", "e.s", F.lit(EDGE_PREDICATE).alias("p"), "e.o")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """One graph for each file below `path`."""
    return edges_of(spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("src_file")))


def cases(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(file_path, family, k): folder and the number after the last `-` of each file name; archives and other names are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(
        F.col(path).alias("file_path"), F.element_at(F.split(path, "/"), -2).alias("family"), F.element_at(F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "-"), -1).try_cast("int").alias("k"), name.alias("name")
    ).filter(F.col("k").isNotNull() & ~F.col("name").endswith(".zip") & F.col("name").contains("-")).drop("name")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The benchmark files below `path`, small ones of each family first."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_path"))
    return cases(listed).orderBy("family", "k")

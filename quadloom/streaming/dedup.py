"""Arriving documents, kept if no isomorphic one came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.label import canonicalise


def unseen(triples: DataFrame, seen: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The triples of one graph of each new isomorphism class, and (ghash, g) of these classes.

    Of isomorphic graphs that arrive together the one with the least name stays.
    """
    found = canonicalise(triples, **options)
    new = found.graphs.groupBy("ghash").agg(F.min("g").alias("g")).join(seen.select("ghash"), "ghash", "left_anti")
    return found.triples.join(new.select("g"), "g", "left_semi"), new


def deduplicate(out: str, state: str, **options) -> Callable[[DataFrame, int], None]:
    """A function for `writeStream.foreachBatch` of a stream of (g, s, p, o).

    `out` gets the canonical triples of new classes and `state` their hashes, in a
    folder for each batch, so that a batch that runs again replaces its own rows.
    A document must arrive within one batch.
    """
    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        schema = "ghash string, g string, batch long"
        jvm = session._jvm
        path = jvm.org.apache.hadoop.fs.Path(state)
        there = path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(path)
        seen = session.read.schema(schema).parquet(state).filter(F.col("batch") != number) if there else session.createDataFrame([], schema)
        kept, new = unseen(rows, seen, **options)
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return batch

"""Relational tables as RDF graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))


def _rows(df: DataFrame, *triples) -> DataFrame:
    each = F.explode(F.array(*(F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in triples)))
    return df.select("g", each.alias("t")).select("g", "t.s", "t.p", "t.o").filter(F.col("o").isNotNull() & F.col("s").isNotNull())


def orders_graph(orders: DataFrame) -> DataFrame:
    """Each order is a blank node with status and priority, placed by its customer."""
    node = F.concat(F.lit("_:o"), F.col("o_orderkey").cast("string"))
    customer = F.concat(F.lit("<cust/"), F.col("o_custkey").cast("string"), F.lit(">"))
    return _rows(orders.withColumn("g", F.lit("<orders>")), (customer, "<placed>", node), (node, "<status>", _text(F.col("o_orderstatus"))), (node, "<priority>", _text(F.col("o_orderpriority"))))


def lines_graph(lineitem: DataFrame) -> DataFrame:
    """Each kind of line of an order is a blank node; only lines with a discount of over 5 % say so."""
    kinds = lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", (F.col("l_discount") > 0.05).alias("d")).distinct().withColumn("g", F.lit("<lines>"))
    order = F.col("l_orderkey").cast("string")
    node = F.concat(F.lit("_:l"), F.concat_ws("x", order, "l_returnflag", "l_linestatus", F.col("d").cast("int").cast("string")))
    return _rows(
        kinds, (F.concat(F.lit("<order/"), order, F.lit(">")), "<has>", node), (node, "<flag>", _text(F.col("l_returnflag"))), (node, "<lstatus>", _text(F.col("l_linestatus"))), (node, "<discounted>", F.when(F.col("d"), F.lit('"true"')))
    )


def nations_graph(nation: DataFrame) -> DataFrame:
    """A graph without blank nodes."""
    n, r = (F.concat(F.lit(f"<{k}/"), F.col(c).cast("string"), F.lit(">")) for k, c in (("nation", "n_nationkey"), ("region", "n_regionkey")))
    return _rows(nation.withColumn("g", F.lit("<nations>")), (n, "<inRegion>", r), (n, "<name>", _text(F.col("n_name"))))


def paths_graph(events: DataFrame, by_segment: bool = True, length: int = 4) -> DataFrame:
    """Each user's events as directed paths of up to `length` blank nodes with types; a graph for each path, or one for all."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_id", "event_type", (F.row_number().over(order) - 1).alias("i"), F.lead("event_id").over(order).alias("then"))
    rows = rows.withColumn("segment", F.floor(F.col("i") / length)).withColumn("inner", F.col("i") % length < length - 1)
    name = lambda c: F.concat(F.lit("_:e"), F.col(c).cast("string"))
    g = F.concat(F.lit("<paths/"), F.col("user_id").cast("string"), F.lit("/"), F.col("segment").cast("string"), F.lit(">")) if by_segment else F.lit("<paths>")
    return _rows(rows.withColumn("g", g), (name("event_id"), "<type>", _text(F.col("event_type"))), (name("event_id"), "<next>", F.when(F.col("inner") & F.col("then").isNotNull(), name("then"))))

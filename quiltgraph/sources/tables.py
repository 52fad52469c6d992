"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from quiltgraph.sources.catalog import Graph


MOST_TURNS = 1 << 20  # of a conversation


def star_graph(spark: SparkSession, folder: str) -> Graph:
    """Ten labels and seven edge types over the Parquet tables of a folder, whose rows are distinct."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    strip = lambda prefix, names: {n: f"{prefix}_{n}" for n in names.split()}
    g = Graph(spark)
    one = {"distinct_rows": True}
    nation, customer, supplier, orders, lines, events, turns = (read(n) for n in ("nation", "customer", "supplier", "orders", "lineitem", "events", "conversations"))
    g.node("Region", read("region"), "r_regionkey", strip("r", "regionkey name"))
    g.node("Nation", nation, "n_nationkey", strip("n", "nationkey name"))
    g.node("Customer", customer, "c_custkey", strip("c", "custkey name acctbal mktsegment"))
    g.node("Supplier", supplier, "s_suppkey", strip("s", "suppkey name acctbal"))
    g.node("Part", read("part"), "p_partkey", strip("p", "partkey name brand type size retailprice"))
    g.node("Order", orders, "o_orderkey", {"orderkey": "o_orderkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"})
    g.node("User", events.select("user_id").distinct(), "user_id", {"user_id": "user_id"})
    g.node("Event", events, "event_id", {n: n for n in "event_id ts event_type value props".split()})
    labels = read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    documents = read("documents").join(labels, "doc_id", "left")  # dropped by the optimizer where no label is read, as the ids are distinct
    labelled = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    g.node("Document", documents, "doc_id", {n: n for n in "doc_id text lang source n_chars quality toxic".split()}, {"Labeled": labelled})
    turns = turns.withColumn("key", F.col("conv_id") * MOST_TURNS + F.col("turn"))
    g.node("Turn", turns, "key", {n: n for n in "conv_id turn role text".split()})
    g.edge("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), **one)
    g.edge("IN_NATION", customer.select("c_custkey", "c_nationkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), **one)
    g.edge("IN_NATION", supplier.select("s_suppkey", "s_nationkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), **one)
    g.edge("PLACED", orders.select("o_custkey", "o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), **one)
    g.edge("CONTAINS", lines, ("Order", "l_orderkey"), ("Part", "l_partkey"), strip("l", "linenumber quantity extendedprice discount tax returnflag linestatus shipdate suppkey"), **one)
    g.edge("SUPPLIED_BY", lines, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), strip("l", "quantity"), **one)
    g.edge("EMITTED", events.select("user_id", "event_id"), ("User", "user_id"), ("Event", "event_id"), **one)
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g.edge("NEXT", events.select("event_id", after.alias("next_id")).where("next_id is not null"), ("Event", "event_id"), ("Event", "next_id"), **one)
    later = F.lead("key").over(Window.partitionBy("conv_id").orderBy("turn"))
    g.edge("NEXT", turns.select("key", later.alias("next_key")).where("next_key is not null"), ("Turn", "key"), ("Turn", "next_key"), **one)
    return g

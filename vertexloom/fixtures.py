"""Graphs derived from the test tables: hop, trade, session, sparse; their Spark form and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertexloom.functions.ordered import next_in_order
from vertexloom.graph import Graph

SQL = {
    "hop": "select distinct s, d from (select o_custkey s, lead(o_custkey) over (partition by o_orderstatus, o_orderdate order by o_orderkey) d from orders) where d is not null and s <> d",
    "trade": """select distinct o_custkey s, (select count(*) from customer) + l_partkey d from lineitem join orders on l_orderkey = o_orderkey
        union select distinct (select count(*) from customer) + l_partkey, (select count(*) from customer) + (select count(*) from part) + l_suppkey from lineitem""",
    "session": "select s, d from (select user_id s, lead(user_id) over (order by ts, event_id) d from events) where d is not null",
    "sparse": "select distinct s, d from (select o_custkey s, lead(o_custkey) over (partition by o_orderdate order by o_orderkey) d from orders where o_orderpriority like '1%') where d is not null and s <> d",
}
VERTICES = {
    "hop": "select range id from range((select count(*) from customer))",
    "trade": "select range id from range((select count(*) from customer) + (select count(*) from part) + (select count(*) from supplier))",
    "session": "select range id from range((select max(user_id) + 1 from events))",
    "sparse": "select range id from range((select count(*) from customer))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _followers(orders: DataFrame, by: list[str]) -> DataFrame:
    after = F.lead("o_custkey").over(W.partitionBy(*by).orderBy("o_orderkey"))
    return orders.select(F.col("o_custkey").alias("src"), after.alias("dst")).where("dst is not null and src <> dst").distinct()


def hop(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(_followers(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate"]), n=table(spark, sf_dir, "customer").count())


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1"))
    return Graph.from_edges(_followers(urgent, ["o_orderdate"]), n=table(spark, sf_dir, "customer").count())


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    c, p, s = (table(spark, sf_dir, t).count() for t in ("customer", "part", "supplier"))
    lines = table(spark, sf_dir, "lineitem")
    bought = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + c).alias("dst")).distinct()
    supplied = lines.select((F.col("l_partkey") + c).alias("src"), (F.col("l_suppkey") + c + p).alias("dst")).distinct()
    return Graph.from_edges(bought.unionByName(supplied), n=c + p + s)


def session(spark: SparkSession, sf_dir: str) -> Graph:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    n = events.agg(F.max("user_id")).first()[0] + 1
    steps = next_in_order(events, "user_id", ["ts", "event_id"])
    return Graph.from_edges(steps.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).where("dst is not null"), n=n)


GRAPHS = {"hop": hop, "trade": trade, "session": session, "sparse": sparse}

"""The star schema as a knowledge graph: rows are nodes, foreign keys are edges, events attest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trust as tr
from ..operators.lineage import in_parts

TODAY = "2000-06-01"
_NODES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name"),
    "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name"),
    "part": ("p_partkey", "p_name"),
    "orders": ("o_orderkey", "o_orderpriority"),
}
_EDGES = [
    ("nation", "n_nationkey", "region", "n_regionkey", "in_region"),
    ("customer", "c_custkey", "nation", "c_nationkey", "in_nation"),
    ("supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"),
    ("orders", "o_orderkey", "customer", "o_custkey", "placed_by"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, by, at, is_human): each event attests its user's customer; a purchase is a person's doing."""
    e = table(spark, sf_dir, "events")
    by = F.when(F.col("event_type") == "purchase", F.concat(F.lit("human:"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("process:"), "event_type"))
    return e.select(node_id("customer", "user_id").alias("id"), by.alias("by"), F.date_format("ts", "yyyy-MM-dd").alias("at")).withColumn("is_human", tr.is_human(F.col("by")))


def bare_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, type, stale_after): orders go stale 500 days after their date."""
    parts = []
    for kind, (key, title) in _NODES.items():
        after = F.date_format(F.date_add(F.to_date("o_orderdate"), 500), "yyyy-MM-dd") if kind == "orders" else F.lit("")
        parts.append(table(spark, sf_dir, kind).select(node_id(kind, key).alias("id"), F.col(title).alias("title"), F.lit(kind).alias("type"), after.alias("stale_after")))
    return reduce(DataFrame.unionByName, parts)


def full_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with tier and stale, and their ``stale_after``."""
    n = stamps(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_human").alias("h"))
    x = bare_nodes(spark, sf_dir).join(n, "id", "left")
    return x.select("id", "title", "type", tr.tier_of_counts(F.col("n"), F.col("h")).alias("tier"), tr.stale(F.col("stale_after"), F.lit(TODAY)).alias("stale"), "stale_after")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_nodes(spark, sf_dir).drop("stale_after")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, kind).select(node_id(kind, key).alias("from"), node_id(to, fk).alias("to"), F.lit(text).alias("text")) for kind, key, to, fk, text in _EDGES]
    lines = in_parts(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey")
    for to, key, text in (("part", "l_partkey", "contains"), ("supplier", "l_suppkey", "supplied_by")):
        pairs = lines.select("l_orderkey", key).distinct()  # of numbers, before they become texts
        parts.append(pairs.select(node_id("orders", "l_orderkey").alias("from"), node_id(to, key).alias("to"), F.lit(text).alias("text")))
    return reduce(DataFrame.unionByName, parts)


NODES_SQL = f"""
ev AS (SELECT 'customer/' || user_id AS id, CASE WHEN event_type = 'purchase' THEN 'human:' || user_id ELSE 'process:' || event_type END AS "by", strftime(ts, '%Y-%m-%d') AS "at" FROM events),
bare AS (
  SELECT 'region/' || r_regionkey AS id, r_name AS title, 'region' AS type, '' AS stale_after FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'nation', '' FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, c_name, 'customer', '' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'supplier', '' FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, p_name, 'part', '' FROM part
  UNION ALL SELECT 'orders/' || o_orderkey, o_orderpriority, 'orders', strftime(CAST(o_orderdate AS DATE) + 500, '%Y-%m-%d') FROM orders),
st AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE "by" LIKE 'human:%') AS h FROM ev GROUP BY id),
nodes AS (SELECT bare.id, title, type, CASE WHEN coalesce(n, 0) = 0 THEN 'unverified' WHEN h > 0 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS tier,
  stale_after <> '' AND '{TODAY}' >= stale_after AS stale, stale_after FROM bare LEFT JOIN st ON bare.id = st.id)"""

EDGES_SQL = """
edges AS (
  SELECT 'nation/' || n_nationkey AS "from", 'region/' || n_regionkey AS "to", 'in_region' AS "text" FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'in_nation' FROM supplier
  UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey, 'placed_by' FROM orders
  UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'part/' || l_partkey, 'contains' FROM lineitem
  UNION ALL SELECT DISTINCT 'orders/' || l_orderkey, 'supplier/' || l_suppkey, 'supplied_by' FROM lineitem),
st2 AS (SELECT "from" AS a, "to" AS b, "from" AS f, "to" AS t, "text" AS r FROM edges),
both_ AS (SELECT * FROM st2 UNION ALL SELECT t AS a, f AS b, f, t, r FROM st2 WHERE f <> t)"""

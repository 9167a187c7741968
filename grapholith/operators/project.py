"""The graph as tables: nodes, edges and stamps, their files, and the view that derives trust from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.trust import is_human, tier_of_counts

NODE_COLUMNS = {"node_key": "STRING(MAX) NOT NULL", "title": "STRING(MAX)", "type": "STRING(MAX)", "tier": "STRING(MAX)", "stale": "BOOL", "stale_after": "DATE"}
EDGE_COLUMNS = {"from_key": "STRING(MAX) NOT NULL", "to_key": "STRING(MAX) NOT NULL", "rel": "STRING(MAX)"}
STAMP_COLUMNS = {"node_key": "STRING(MAX) NOT NULL", "seq": "INT64 NOT NULL", "by": "STRING(MAX)", "at": "STRING(MAX)", "is_human": "BOOL"}

DERIVED = """
SELECT n.node_key,
  CASE WHEN coalesce(v.stamps, 0) = 0 THEN 'unverified' WHEN coalesce(v.humans, 0) > 0 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS tier,
  (n.stale_after IS NOT NULL AND {as_of} >= n.stale_after) AS stale
FROM {nodes} n LEFT JOIN (SELECT node_key, count(*) AS stamps, count_if(is_human) AS humans FROM {stamps} GROUP BY node_key) v ON v.node_key = n.node_key
"""


def node_key(authored: Column, id_: Column) -> Column:
    """An authored key that is a text and not empty, else the path."""
    return F.coalesce(F.nullif(authored, F.lit("")), id_)


def node_rows(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(node_key, title, type, tier, stale, stale_after) of nodes with a text ``stale_after``; empty texts are null."""
    n = nodes if keys is None else nodes.join(keys, "id", "left")
    key = node_key(F.col("authored_key"), F.col("id")) if keys is not None else F.col("id")
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    return n.select(key.alias("node_key"), none("title").alias("title"), none("type").alias("type"), "tier", "stale", F.try_to_date("stale_after", "yyyy-MM-dd").alias("stale_after"))


def edge_rows(edges: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(from_key, to_key, rel); an absent target keeps its path."""
    rel = F.nullif(F.col("text"), F.lit("")).alias("rel")
    if keys is None:
        return edges.select(F.col("from").alias("from_key"), F.col("to").alias("to_key"), rel)
    k = keys.select(F.col("id").alias("__id"), node_key(F.col("authored_key"), F.col("id")).alias("__key"))
    out = edges
    for end in ("from", "to"):
        out = out.join(k, F.col(end) == F.col("__id"), "left").withColumn(f"{end}_key", F.coalesce("__key", end)).drop("__id", "__key")
    return out.select("from_key", "to_key", rel)


def stamp_rows(concepts: DataFrame) -> DataFrame:
    """(node_key, seq, by, at, is_human): each stamp of (node_key, verified), counted from 0."""
    x = concepts.select("node_key", F.posexplode("verified").alias("seq", "v"))
    return x.select("node_key", F.col("seq").cast("bigint").alias("seq"), F.col("v")["by"].alias("by"), F.col("v")["at"].alias("at"), F.coalesce(is_human(F.col("v")["by"]), F.lit(False)).alias("is_human"))


def derived_trust(nodes: DataFrame, stamps: DataFrame, today: str) -> DataFrame:
    """The derivation view over the tables, as of a day."""
    spark = nodes.sparkSession
    return spark.sql(DERIVED.format(nodes="{nodes}", stamps="{stamps}", as_of=f"DATE '{today}'"), nodes=nodes, stamps=stamps)


def derived_trust_api(nodes: DataFrame, stamps: DataFrame, today: str) -> DataFrame:
    """The same by the DataFrame API; tests hold both against each other."""
    n = stamps.groupBy("node_key").agg(F.count(F.lit(1)).alias("stamps"), F.count_if("is_human").alias("humans"))
    stale = F.coalesce(F.lit(today).cast("date") >= F.col("stale_after"), F.lit(False))
    return nodes.join(n, "node_key", "left").select("node_key", tier_of_counts(F.col("stamps"), F.col("humans")).alias("tier"), stale.alias("stale"))


def identity_stability(keys: DataFrame) -> DataFrame:
    """One row (path_fallback_count, strategy, re_rooting_stable) of (id, authored_key)."""
    own = F.coalesce(F.col("authored_key") != "", F.lit(False))
    a = keys.agg(F.count_if(~own).alias("path_fallback_count"), F.count_if(own).alias("__own"))
    strategy = F.when(F.col("__own") > 0, "frontmatter").otherwise("path")
    return a.select("path_fallback_count", strategy.alias("strategy"), ((F.col("__own") > 0) & (F.col("path_fallback_count") == 0)).alias("re_rooting_stable"))


def insert_tuples(df: DataFrame, columns: list[str]) -> DataFrame:
    """(values): one SQL tuple a row: quoted texts, NULL, numbers and booleans, DATE literals."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if kinds[c] == "date":
            return F.coalesce(F.concat(F.lit("DATE '"), F.date_format(c, "yyyy-MM-dd"), F.lit("'")), F.lit("NULL"))
        if kinds[c] == "boolean":
            return F.coalesce(F.upper(F.col(c).cast("string")), F.lit("NULL"))
        return t.sql_literal(c) if kinds[c] == "string" else F.coalesce(F.col(c).cast("string"), F.lit("NULL"))

    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *map(one, columns)), F.lit(")")).alias("values"))


def load_statement(df: DataFrame, table: str, columns: list[str]) -> str:
    """One INSERT for a bounded table, or a comment where it has no rows."""
    rows = [r["values"] for r in insert_tuples(df, columns).toLocalIterator()]
    if not rows:
        return f"-- {table}: no rows\n"
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES\n" + ",\n".join(f"  {r}" for r in rows) + ";\n"


def schema_ddl() -> str:
    """CREATE TABLE for the three tables and CREATE PROPERTY GRAPH."""
    out = []
    for table, columns, key in (("Nodes", NODE_COLUMNS, "node_key"), ("Edges", EDGE_COLUMNS, "from_key, to_key, rel"), ("NodeVerified", STAMP_COLUMNS, "node_key, seq")):
        wide = max(map(len, columns))
        out.append(f"CREATE TABLE {table} (\n" + "".join(f"  {c.ljust(wide)} {k},\n" for c, k in columns.items()) + f") PRIMARY KEY ({key});\n")
    out.append("CREATE PROPERTY GRAPH KnowledgeGraph\n  NODE TABLES (Nodes KEY (node_key) LABEL Concept)\n  EDGE TABLES (Edges KEY (from_key, to_key, rel)\n    SOURCE KEY (from_key) REFERENCES Nodes (node_key)\n    DESTINATION KEY (to_key) REFERENCES Nodes (node_key) LABEL LINKS);\n")
    return "\n".join(out)


def derivation_sql() -> str:
    return "CREATE VIEW NodeTrustDerived AS" + DERIVED.format(nodes="Nodes", stamps="NodeVerified", as_of="CURRENT_DATE()").replace("count_if", "COUNTIF").rstrip() + ";\n"



"""The labelled property graph and its bounded verbs.

``nodes``: (id, title, type, tier, stale). ``edges``: (from, to, text); equal edges and
edges to absent nodes stay. Verbs walk raw edges and drop absent nodes at the end only.
All results are DataFrames; nothing is collected but a number of rows a level. Each level
joins the frontier to the raw edges in one scan, drops what was seen, and is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spec import MAX_DEPTH, MAX_RESULTS, NODE_COLUMNS, NODE_PROPERTIES
from .lineage import cut, near

EDGE_COLUMNS = ("from", "to", "text")


@dataclass
class Answer:
    """A verb's tables; ``depths`` for neighbourhoods only. ``capped``: nodes before the cap, at most one more."""

    nodes: DataFrame
    edges: DataFrame | None = None
    depths: DataFrame | None = None
    limit: int = MAX_RESULTS
    capped: DataFrame | None = None

    def truncated(self) -> bool:
        return self.capped is not None and self.capped.count() > self.limit


def nodes_of(concepts: DataFrame, today: str) -> DataFrame:
    """Nodes of concepts (id, title, type, trust)."""
    from ..functions import trust as tr

    title = F.coalesce(F.nullif("title", F.lit("")), F.col("id"))
    verified, after = F.col("trust")["verified"], F.coalesce(F.col("trust")["stale_after"], F.lit(""))
    return concepts.select("id", title.alias("title"), F.coalesce("type", F.lit("")).alias("type"), tr.tier(verified).alias("tier"), tr.stale(after, F.lit(today)).alias("stale"))


def edges_of(links: DataFrame) -> DataFrame:
    """Edges of links (concept_id, target_id, text, resolved): resolved ones with a target; their targets may be absent."""
    return links.where(F.col("resolved") & (F.col("target_id") != "")).select(F.col("concept_id").alias("from"), F.col("target_id").alias("to"), "text")


def steps(edges: DataFrame, direction: str = "out", rel: str = "") -> DataFrame:
    """(a, b, from, to, text): one hop from a to b; a self-loop once in either direction."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r} is not out, in or both")
    e = edges.select(*EDGE_COLUMNS)
    if rel:
        e = e.where(F.col("text") == rel)
    out = e.select(F.col("from").alias("a"), F.col("to").alias("b"), *EDGE_COLUMNS)
    back = e.select(F.col("to").alias("a"), F.col("from").alias("b"), *EDGE_COLUMNS)
    if direction == "out":
        return out
    return back if direction == "in" else out.unionByName(back.where(F.col("from") != F.col("to")))


def _hops(edges: DataFrame, direction: str, rel: str = "") -> DataFrame:
    """:func:`steps` for a join with a frontier: the edges are read once whatever the direction."""
    if direction != "both":
        return steps(edges, direction, rel)
    e = edges.select(*EDGE_COLUMNS)
    if rel:
        e = e.where(F.col("text") == rel)
    out, back = F.struct(F.col("from").alias("a"), F.col("to").alias("b")), F.struct(F.col("to").alias("a"), F.col("from").alias("b"))
    return e.withColumn("x", F.explode(F.when(F.col("from") == F.col("to"), F.array(out)).otherwise(F.array(out, back)))).select("x.a", "x.b", *EDGE_COLUMNS)


def _levels(edges: DataFrame, start: DataFrame, depth: int, direction: str, rel: str, key: list[str]) -> DataFrame:
    """``start`` (``key`` with id, depth 0) and what lies within ``depth`` hops, each at its least depth."""
    hop = _hops(edges, direction, rel).select("a", "b")
    frontier = seen = cut(start)
    rows = frontier.count()
    total = rows
    for d in range(1, depth + 1):
        if not rows:
            break
        on = hop.join(near(frontier.select(*key), rows), F.col("id") == F.col("a"))
        new = on.select(*[F.col("b").alias(c) if c == "id" else F.col(c) for c in key]).distinct()
        frontier = cut(new.join(near(seen.select(*key), total), key, "left_anti").withColumn("depth", F.lit(d)))
        rows = frontier.count()
        total += rows
        seen = seen.unionByName(frontier)
    return seen


def _first(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.orderBy("id").limit(limit)


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``, which a verb's cap bounds."""
    one, other = F.broadcast(ids.select(F.col("id").alias("from"))), F.broadcast(ids.select(F.col("id").alias("to")))
    return edges.join(one, "from", "left_semi").join(other, "to", "left_semi").select(*EDGE_COLUMNS)


def lookup(nodes: DataFrame, id: str = "", label: str = "", limit: int = MAX_RESULTS) -> Answer:  # noqa: A002
    """The node of an id, or the nodes of a type."""
    if id:
        return Answer(nodes.where(F.col("id") == id), limit=limit)
    found = nodes.where(F.col("type") == label)
    return Answer(_first(found, limit), limit=limit, capped=found.limit(limit + 1))


def neighbors(nodes: DataFrame, edges: DataFrame, id: str, direction: str = "out", rel: str = "", limit: int = MAX_RESULTS) -> Answer:  # noqa: A002
    """Distinct nodes one hop away, and the edges walked between what is kept and the node itself."""
    walked = steps(edges, direction, rel).where(F.col("a") == id)
    here = nodes.where(F.col("id") == id)
    found = nodes.join(walked.select(F.col("b").alias("id")), "id", "left_semi").join(here.select(F.lit(1)).limit(1), how="left_semi")
    kept = cut(_first(found, limit))  # read three times
    ends = kept.select("id").unionByName(here.select("id")).distinct()
    return Answer(kept, _inside(walked, ends), limit=limit, capped=found.limit(limit + 1))


def neighborhood(nodes: DataFrame, edges: DataFrame, id: str, depth: int = 1, direction: str = "out", rel: str = "", limit: int = MAX_RESULTS) -> Answer:  # noqa: A002
    """Nodes within ``depth`` hops at their least depth, and all edges among those kept."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth {depth} is not within 1 and {MAX_DEPTH}")
    start = nodes.where(F.col("id") == id).select("id", F.lit(0).alias("depth"))
    found = nodes.join(_levels(edges, start, depth, direction, rel, ["id"]), "id")
    kept = cut(_first(found, limit))
    pool = edges.where(F.col("text") == rel) if rel else edges
    return Answer(kept.select(*NODE_COLUMNS), _inside(pool.select(*EDGE_COLUMNS), kept), kept.select("id", "depth"), limit, found.limit(limit + 1))


def where_prop(prop: str, eq: str) -> Column:
    if prop not in ("type", "tier", "stale"):
        raise ValueError(f"where.prop {prop!r} is not type, tier or stale")
    return F.col(prop).cast("string") == eq


def pattern(nodes: DataFrame, edges: DataFrame, label: str, to_label: str = "", rel: str = "", where: tuple[str, str] | None = None, limit: int = MAX_RESULTS) -> Answer:
    """Nodes of a type with an edge to an existing node of another type and property, and those edges."""
    if not label or not (to_label or where):
        raise ValueError("pattern needs label, and to_label or where")
    targets = nodes
    if to_label:
        targets = targets.where(F.col("type") == to_label)
    if where:
        targets = targets.where(where_prop(*where))
    pool = edges.where(F.col("text") == rel) if rel else edges
    met = pool.join(targets.select(F.col("id").alias("to")), "to", "left_semi").select(*EDGE_COLUMNS)
    found = nodes.where(F.col("type") == label).join(met.select(F.col("from").alias("id")), "id", "left_semi")
    kept = _first(found, limit)
    return Answer(kept, met.join(kept.select(F.col("id").alias("from")), "from", "left_semi").select(*EDGE_COLUMNS), limit=limit, capped=found.limit(limit + 1))


def path(nodes: DataFrame, edges: DataFrame, start: str, end: str, max_depth: int = MAX_DEPTH, direction: str = "out") -> DataFrame:
    """One row (exists, length, path, not_found): of the shortest paths the one whose edges (from, to, text) sort first."""
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} is not within 1 and {MAX_DEPTH}")
    spark = nodes.sparkSession
    schema = "exists boolean, length int, path array<string>, not_found boolean"
    ends = {r["id"] for r in nodes.where(F.col("id").isin(start, end)).select("id").distinct().collect()}
    if not {start, end} <= ends:
        return spark.createDataFrame([(False, 0, [], True)], schema)
    if start == end:
        return spark.createDataFrame([(True, 0, [start], False)], schema)
    hop = _hops(edges, direction)
    rows = 1
    seen = frontier = spark.range(1).select(F.lit(start).alias("id"), F.array().cast("array<struct<from: string, to: string, text: string>>").alias("walk"))
    for d in range(1, max_depth + 1):
        on = hop.join(near(frontier, rows), F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.array_append("walk", F.struct(*EDGE_COLUMNS)).alias("walk"))
        frontier = cut(on.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("walk").alias("walk")))
        if not (rows := frontier.count()):
            break
        hit = frontier.where(F.col("id") == end)
        if not hit.isEmpty():
            other = lambda acc, e: F.array_append(acc, F.when(F.element_at(acc, -1) == e["from"], e["to"]).otherwise(e["from"]))
            return hit.select(F.lit(True).alias("exists"), F.lit(d).alias("length"), F.aggregate("walk", F.array(F.lit(start)), other).alias("path"), F.lit(False).alias("not_found"))
        seen = seen.select("id").unionByName(frontier.select("id"))
    return spark.createDataFrame([(False, 0, [], False)], schema)


def reach(edges: DataFrame, anchors: DataFrame, depth: int, direction: str = "out", rel: str = "") -> DataFrame:
    """(anchor, id, depth) for many anchors (id) at once: the batch form of :func:`neighborhood`, without a cap."""
    start = anchors.select(F.col("id").alias("anchor"), "id", F.lit(0).alias("depth")).distinct()
    return _levels(edges, start, depth, direction, rel, ["anchor", "id"])


def degrees(edges: DataFrame, loops: bool = True) -> DataFrame:
    """(id, inbound, outbound): one shuffle for both."""
    e = edges if loops else edges.where(F.col("from") != F.col("to"))
    ends = e.select(F.explode(F.array(F.struct(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("inbound"), F.sum("x.o").alias("outbound"))


def out_degree_by_rel(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from").alias("id"), F.col("text").alias("rel")).agg(F.count(F.lit(1)).alias("n"))


def labels(nodes: DataFrame) -> DataFrame:
    """(label, n, properties): the node labels of a graph."""
    return nodes.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("properties", F.array(*map(F.lit, NODE_PROPERTIES)))


def describe(nodes: DataFrame, edges: DataFrame, strategy: Column | None = None) -> DataFrame:
    """One row: counts of nodes and edges, and the labels by name."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    by = labels(nodes).agg(F.sort_array(F.collect_list(F.struct("label", "n", "properties"))).alias("node_labels"))
    return n.crossJoin(e).crossJoin(by)  # three single rows

"""Writing graphs, tables and concept files.

Tables are written by Spark. Exports for viewers are one text in the driver: graphs of
more than ``MOST_EXPORTED`` nodes and edges are refused; their lines can be written as tables.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


MOST_EXPORTED = 200_000


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """CSV with a header, null and empty both as ``""``; sorted by range over many files where an order is given."""
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    out = texts.repartitionByRange(*order).sortWithinPartitions(*order) if order else texts
    out.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of the body of a Graphviz graph, in order."""
    label = F.coalesce(F.nullif("title", F.lit("")), F.col("id"))
    n = nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.concat(F.lit("  "), t.dot_literal("id"), F.lit(" [label="), t.dot_literal(label), F.lit("];")).alias("line"))
    e = edges.select(F.lit(1).alias("k"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("text").alias("c"), F.concat(F.lit("  "), t.dot_literal("from"), F.lit(" -> "), t.dot_literal("to"), F.when(F.col("text") != "", F.concat(F.lit(" [label="), t.dot_literal("text"), F.lit("]"))).otherwise(""), F.lit(";")).alias("line"))
    return n.unionByName(e).orderBy("k", "a", "b", "c").select("line")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    data = lambda key, c: F.concat(F.lit(f'      <data key="{key}">'), t.xml_escape(F.col(c).cast("string")), F.lit("</data>\n"))
    n = nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.concat(F.lit('    <node id="'), t.xml_escape("id"), F.lit('">\n'), *[data(c, c) for c in ("title", "type", "tier", "stale")], F.lit("    </node>")).alias("line"))
    rel = F.when(F.col("text") != "", F.concat(F.lit("\n"), data("rel", "text"), F.lit("    "))).otherwise("")
    e = edges.select(F.lit(1).alias("k"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("text").alias("c"), F.concat(F.lit('    <edge source="'), t.xml_escape("from"), F.lit('" target="'), t.xml_escape("to"), F.lit('">'), rel, F.lit("</edge>")).alias("line"))
    return n.unionByName(e).orderBy("k", "a", "b", "c").select("line")


def html_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), t.xml_escape(F.col(c).cast("string")), F.lit("</td>"))
    n = nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.concat(F.lit("<tr>"), *map(cell, ("id", "title", "type", "tier", "stale")), F.lit("</tr>")).alias("line"))
    e = edges.select(F.lit(1).alias("k"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("text").alias("c"), F.concat(F.lit("<tr>"), *map(cell, ("from", "to", "text")), F.lit("</tr>")).alias("line"))
    return n.unionByName(e).orderBy("k", "a", "b", "c").select("k", "line")


def _lines(df: DataFrame) -> Iterator[str]:
    return (r["line"] for r in df.toLocalIterator())


def export(nodes: DataFrame, edges: DataFrame, kind: str) -> str:
    """A bounded graph as ``dot``, ``json``, ``graphml`` or ``html`` text."""
    rows = nodes.select(F.lit(1)).unionAll(edges.select(F.lit(1))).limit(MOST_EXPORTED + 1).count()
    if rows > MOST_EXPORTED:
        raise ValueError(f"the graph has more than {MOST_EXPORTED} nodes and edges: write dot_lines, graphml_lines or the tables")
    if kind == "dot":
        return "digraph knowledge {\n  rankdir=LR;\n  node [shape=box];\n" + "".join(f"{x}\n" for x in _lines(dot_lines(nodes, edges))) + "}\n"
    if kind == "json":
        n = [r.asDict() for r in nodes.orderBy("id").toLocalIterator()]
        e = [{k: v for k, v in r.asDict().items() if k != "text" or v} for r in edges.orderBy("from", "to", "text").toLocalIterator()]
        return json.dumps({"nodes": n or None, "edges": e or None}, indent=2, ensure_ascii=False) + "\n"
    if kind == "graphml":
        keys = "".join(f'  <key id="{k}" for="{"edge" if k == "rel" else "node"}" attr.name="{k}" attr.type="{"boolean" if k == "stale" else "string"}"></key>\n' for k in ("title", "type", "tier", "stale", "rel"))
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}  <graph edgedefault="directed">\n' + "".join(f"{x}\n" for x in _lines(graphml_lines(nodes, edges))) + "  </graph>\n</graphml>\n"
    if kind == "html":
        rows: list[list[str]] = [[], []]
        for r in html_lines(nodes, edges).toLocalIterator():
            rows[r["k"]].append(r["line"])
        heads = ("<th>id</th><th>title</th><th>type</th><th>tier</th><th>stale</th>", "<th>from</th><th>to</th><th>relationship</th>")
        tables = "".join(f"<table>\n<caption>{name}</caption>\n<tr>{h}</tr>\n" + "\n".join(r) + "\n</table>\n" for name, h, r in zip(("Concepts", "Edges"), heads, rows))
        island = export(nodes, edges, "json").replace("<", "\\u003c")
        return f'<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>graph</title></head>\n<body>\n{tables}<script type="application/json" id="graph-data">\n{island}</script>\n</body>\n</html>\n'
    raise ValueError(f"unknown graph format {kind!r}: dot, json, graphml or html")


def envelope(command: str, result: dict, schema: str = "report/v1", version: str = "0.1.0") -> str:
    """A report: its producer, command and schema before the result, fields in declared order."""
    return json.dumps({"grapholith": version, "command": command, "schema": schema, "result": result}, indent=2, ensure_ascii=False) + "\n"


def atomic_write(path: str, text: str) -> None:
    """Replace a file at once, keeping its mode."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    mode = os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".new-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, mode)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def write_files(rows: DataFrame, root: str) -> None:
    """Write (path, text) rows under ``root``, a folder that all executors share; a repeated task writes the same bytes."""

    def run(part: Iterator) -> None:
        for r in part:
            target = os.path.normpath(os.path.join(root, r["path"]))
            if os.path.commonpath([os.path.abspath(target), os.path.abspath(root)]) != os.path.abspath(root):
                raise ValueError(f"{r['path']!r} leaves the folder")
            atomic_write(target, r["text"])

    rows.select("path", "text").foreachPartition(run)

"""Resolving links: wiki links by path, file name or title; markdown links by path; longest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def index(files: DataFrame) -> DataFrame:
    """(stage, key, target, ambiguous) of (source_path, output_path, title), paths without ``.md``; one shuffle for all stages."""
    stem = F.lower(F.element_at(F.split("source_path", "/"), -1))
    entry = lambda stage, key: F.struct(F.lit(stage).alias("stage"), key.alias("key"))
    keys = F.array(entry(1, F.col("source_path")), entry(1, F.col("output_path")), entry(2, stem), entry(3, t.title_slug(F.coalesce("title", F.lit("")))))
    rows = files.select(F.explode(keys).alias("k"), "output_path").where(F.col("k")["key"] != "")
    return rows.groupBy("k.stage", "k.key").agg(F.max("output_path").alias("target"), (F.min("output_path") != F.max("output_path")).alias("ambiguous"))


def path_candidates(target: Column, from_dir: Column) -> Column:
    """Bundle paths that a reference may mean, in order."""
    raw = F.trim(target)
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/", ""), r"\.md$", "")
    near = F.when(raw.startswith("/"), F.lit(None)).when(raw.contains("/") | raw.startswith("."), F.concat(from_dir, F.lit("/"), raw))
    found = F.transform(F.array(near, raw), lambda c: t.clean_path(bare(c)))
    return F.filter(found, lambda c: c.isNotNull() & (c != "") & (c != ".") & ~c.startswith("..") & ~c.startswith("/"))


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (link_id, from_dir, target, ...) with ``target_id`` (empty if unresolved) and ``resolved``.

    A path wins over a file name over a title; an ambiguous name or title ends the search.
    """
    want = links.select("link_id", path_candidates(F.col("target"), F.col("from_dir")).alias("paths"), F.lower(F.trim("target")).alias("name"), t.title_slug("target").alias("slug"))
    n = F.size("paths")
    keys = F.concat(
        F.transform("paths", lambda p, i: F.struct(F.lit(1).alias("stage"), p.alias("key"), i.alias("at"))),
        F.array(F.struct(F.lit(2).alias("stage"), F.regexp_replace("name", r"\.md$", "").alias("key"), n.alias("at")), F.struct(F.lit(3).alias("stage"), F.col("slug").alias("key"), (n + 1).alias("at"))),
    )
    asked = want.select("link_id", F.explode(keys).alias("k")).select("link_id", "k.*")
    hits = asked.join(index(files), ["stage", "key"])
    first = hits.groupBy("link_id").agg(F.min_by(F.struct("target", F.when(F.col("stage") == 1, F.lit(False)).otherwise(F.col("ambiguous")).alias("ambiguous")), "at").alias("h"))
    out = F.when(F.col("h")["ambiguous"] | F.col("h").isNull(), "").otherwise(F.col("h")["target"])
    return links.join(first, "link_id", "left").withColumn("target_id", out).withColumn("resolved", F.col("target_id") != "").drop("h")


def resolve_markdown(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (from_dir, raw_target, ...) with ``target_id``: ``.md`` targets, relative or rooted, of existing sources."""
    local = F.element_at(F.split("raw_target", "#"), 1)
    wanted = F.lower(local).endswith(".md") & ~t.is_external_reference("raw_target")
    joined = F.when(local.startswith("/"), F.regexp_replace(local, "^/+", "")).otherwise(F.concat(F.col("from_dir"), F.lit("/"), local))
    key = F.when(wanted, F.regexp_replace(t.clean_path(joined), r"(?i)\.md$", ""))
    known = files.select(F.col("source_path").alias("__path"), F.col("output_path").alias("__out"))
    out = links.withColumn("__key", key).join(known, F.col("__key") == F.col("__path"), "left")
    return out.withColumn("target_id", F.coalesce("__out", F.lit(""))).withColumn("resolved", F.col("target_id") != "").drop("__key", "__path", "__out")


def leaves(path: Column, root: str) -> Column:
    """Whether a cleaned absolute path is outside ``root``, by whole segments."""
    return ~t.under(path, F.lit(root.rstrip("/"))) if root.rstrip("/") else F.lit(False)


def workspace_target(target: Column, root: str, workspace: str) -> Column:
    """``file:`` addresses of markdown files inside the workspace as paths from the corpus folder ``root``; other targets as they are.

    Paths are compared as they are written: symbolic links aren't followed. Without a root nothing changes.
    """
    if not root:
        return target
    p = t.file_address(target)
    inside = p.isNotNull() & F.lower(p).endswith(".md") & ~leaves(p, workspace)
    base = root.rstrip("/")
    rel = F.when(t.under(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))).otherwise(F.lit("/.outside.md"))  # no concept: an unresolved link
    return F.when(inside, F.concat(rel, F.regexp_extract(target, "(#.*)$", 1))).otherwise(target)


def address_note(target: Column, root: str, workspace: str, external_roots: tuple[str, ...]) -> Column:
    """Why a ``file:`` address stays external, if it points at another machine or out of the workspace and of the declared roots."""
    if not root:
        return F.lit(None).cast("string")
    p, remote = t.file_address(target), target.rlike("(?i)^file://[^/]") & ~target.rlike("(?i)^file://localhost/")
    out = p.isNotNull() & F.lower(p).endswith(".md") & leaves(p, workspace)
    for other in external_roots:
        out = out & leaves(p, other)
    return F.when(remote, F.concat(F.lit("left external, another machine's file: "), target)).when(out, F.concat(F.lit("left external, outside the workspace: "), target))


def read_target(raw: Column, concept_id: Column) -> Column:
    """What a bundle's own link points at, whether or not it exists: ``.md`` by exact case, ``..`` stops at the root."""
    local = F.element_at(F.split(raw, "#"), 1)
    full = F.when(local.startswith("/"), local).otherwise(F.concat(F.lit("/"), t.directory(concept_id), F.lit("/"), local))
    ok = local.endswith(".md") & ~t.is_external_when_read(raw)
    return F.when(ok, F.regexp_replace(F.regexp_replace(t.clean_path(full), "^/+", ""), r"\.md$", "")).otherwise("")


def longest_prefix(rows: DataFrame, path: str, mapping: dict[str, str], default: Column | None = None) -> Column:
    """The value of the longest key that is the path's folder or above it, by whole segments.

    The mapping is an argument of a command, so it becomes a literal: no join at all.
    """
    p = F.col(path)
    out = default if default is not None else F.lit(None).cast("string")
    for key in sorted(mapping, key=lambda k: (len(k), k)):
        out = F.when(t.under(p, F.lit(key.strip("/"))), F.lit(mapping[key])).otherwise(out)
    return out


def longest_prefix_join(rows: DataFrame, path: str, table: DataFrame) -> DataFrame:
    """The same against a table (prefix, value) of any size: the path's own prefixes meet it in an equi-join."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = rows.select(path).distinct()
    met = own.select(path, F.explode(above).alias("prefix")).join(table, "prefix")
    best = met.groupBy(path).agg(F.max_by("value", F.length("prefix")).alias("value"))
    return rows.join(best, path, "left")

"""Corpus health: review, lint, validation, catalogs, folder indexes and type inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import trust as tr
from ..functions.spec import TRUST
from .graph import degrees

CATALOG_EDGES, SAMPLE_FILES = 20, 3


# review


def by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.when(F.col("type") == "", "(none)").otherwise(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def tiers(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target doesn't exist."""
    return edges.join(nodes.select(F.col("id").alias("to")), "to", "left_anti").select("from", "to", "text")


def node_roles(nodes: DataFrame, edges: DataFrame, loops: bool, entrypoints: tuple[str, ...] = ()) -> DataFrame:
    """(id, role): entrypoint, orphan or linked. Review ignores self-loops and edges to absent nodes, lint counts both."""
    pool = edges if loops else edges.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    d = degrees(pool, loops)
    chosen = F.col("id").isin(*[e.removesuffix(".md") for e in entrypoints]) if entrypoints else F.lit(False)
    named = F.lower(F.col("id")) == "readme"
    no_in = F.coalesce(F.col("inbound"), F.lit(0)) == 0
    role = F.when(no_in & ((F.coalesce(F.col("outbound"), F.lit(0)) > 0) | chosen | named), "entrypoint").when(no_in, "orphan").otherwise("linked")
    return nodes.join(d, "id", "left").select("id", role.alias("role"))


def review(nodes: DataFrame, edges: DataFrame, broken: DataFrame, unparsed: DataFrame, entrypoints: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The parts of a review; ``broken``: (from, raw_target) of unresolved links."""
    roles = node_roles(nodes, edges, False, entrypoints)
    gone = dangling(edges, nodes).select("from", F.col("to").alias("raw_target")).unionByName(broken)
    return {
        "by_type": by_type(nodes),
        "tiers": tiers(nodes),
        "orphans": roles.where("role = 'orphan'").select("id").orderBy("id"),
        "entrypoints": roles.where("role = 'entrypoint'").select("id").orderBy("id"),
        "stale": nodes.where("stale").select("id").orderBy("id"),
        "attested": nodes.where(tr.attested(F.col("type"))).select("id").orderBy("id"),
        "unresolved": gone.orderBy("from", "raw_target"),
        "unparsed_frontmatter": unparsed.orderBy("rel_path"),
    }


def strict_counts(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("orphans", "stale", "unresolved", "unparsed_frontmatter")) -> DataFrame:
    """(part, n): what fails a strict run."""
    out = None
    for k in keys:
        one = parts[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# lint and validation


def broken_links(links: DataFrame, ids: DataFrame, anchors: DataFrame) -> DataFrame:
    """(concept, detail) of links (concept_id, raw_target, target_id, resolved): absent target, absent anchor, or unresolved reference."""
    fragment = F.regexp_extract("raw_target", "#(.*)$", 1)
    l = links.withColumn("fragment", fragment)
    known = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("there"))
    slugs = anchors.select(F.col("concept_id").alias("target_id"), F.col("slug").alias("fragment"), F.lit(True).alias("anchored")).distinct()
    own = F.when(F.col("raw_target").startswith("#"), F.col("concept_id")).otherwise(F.col("target_id"))
    joined = l.withColumn("target_id", own).join(known, "target_id", "left").join(slugs, ["target_id", "fragment"], "left")
    same = F.col("raw_target").startswith("#")
    absent = F.col("resolved") & F.col("there").isNull()
    unanchored = (F.col("resolved") | same) & F.col("there").isNotNull() & (F.col("fragment") != "") & F.col("anchored").isNull()
    reference = ~F.col("resolved") & ~same & t.is_concept_reference("raw_target")
    return joined.where(absent | unanchored | reference).select(F.col("concept_id").alias("concept"), F.col("raw_target").alias("detail"))


def residual_wikilinks(concepts: DataFrame) -> DataFrame:
    """(concept, detail) of wiki links that stayed in a body."""
    left = concepts.select(F.col("id").alias("concept"), F.explode("md.wikilinks").alias("w"))
    return left.select("concept", F.concat(F.lit("[["), F.col("w")["target"], F.when(F.col("w")["alias"] != "", F.concat(F.lit("|"), F.col("w")["alias"])).otherwise(""), F.lit("]]")).alias("detail"))


LINT = ("broken_links", "missing_titles", "orphans", "stale", "schema_violations")


def lint(concepts: DataFrame, facts: DataFrame, today: str, entrypoints: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All buckets over a converted corpus: ``concepts`` as :func:`bundle.concepts` reads its files, ``facts`` of the files as authored.

    ``strict_counts(parts, LINT)`` says what fails a strict run; entrypoints don't.
    """
    from ..sources import bundle as bd
    from .graph import edges_of, nodes_of
    from .lineage import kept

    concepts, facts = kept(concepts, "concepts"), kept(facts, "facts")  # every bucket reads them, by column
    links = bd.bundle_links(concepts)
    nodes = nodes_of(concepts, today)
    roles = node_roles(nodes, edges_of(links), True, entrypoints)
    broken = broken_links(links, nodes, bd.anchors(concepts)).unionByName(residual_wikilinks(concepts))
    return {
        "broken_links": broken.orderBy("concept", "detail"),
        **{k: x.orderBy(*x.columns) for k, x in source_findings(facts).items()},
        **{f"{r}s": roles.where(F.col("role") == r).select(F.col("id").alias("concept")).orderBy("concept") for r in ("orphan", "entrypoint")},
        "stale": nodes.where("stale").select(F.col("id").alias("concept")).orderBy("concept"),
    }


def source_findings(facts: DataFrame) -> dict[str, DataFrame]:
    """Missing titles and schema violations of facts (concept_id, title_present, type_present, recovered, error)."""
    c = F.col("concept_id").alias("concept")
    error = F.regexp_replace(F.coalesce("error", F.lit("")), "^invalid frontmatter:? ?", "")
    bad = F.when(F.col("recovered"), F.concat(F.lit("invalid frontmatter"), F.when(error != "", F.concat(F.lit(": "), error)).otherwise(""))).when(~F.col("type_present"), "missing type")
    return {"missing_titles": facts.where(~F.col("title_present")).select(c), "schema_violations": facts.select(c, bad.alias("detail")).where("detail is not null")}


def validate(concepts: DataFrame) -> DataFrame:
    """(rel_path, severity, message) of concepts (rel_path, trust, type, has_runtime, error): one scan, no shuffle."""
    f = tr.findings(F.col("trust"), F.col("type"), F.col("has_runtime"), F.col("error"))
    return concepts.select("rel_path", F.posexplode(f).alias("at", "f")).select("rel_path", "at", "f.severity", "f.message")


def conformance(findings: DataFrame) -> DataFrame:
    """One row (errors, advisories, conformant)."""
    n = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "advisory").alias("advisories"))
    return n.withColumn("conformant", F.col("errors") == 0)


def link_tally(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


# catalogs


def catalog_edges(nodes: DataFrame, edges: DataFrame, inbound: bool, most: int = CATALOG_EDGES) -> DataFrame:
    """(id, pos, other, text, more): a node's first edges by (from, to, text), and how many are left out."""
    own, other = ("to", "from") if inbound else ("from", "to")
    rank = F.row_number().over(Window.partitionBy(own).orderBy("from", "to", "text"))
    kept = edges.select("from", "to", "text", rank.alias("pos")).where(F.col("pos") <= most)  # a group limit: a hub's edges are cut before they are shuffled
    n = edges.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    x = kept.select(F.col(own).alias("id"), "pos", F.col(other).alias("other"), "text").join(nodes.select("id"), "id", "left_semi")
    return x.join(n, "id", "left").select("id", "pos", "other", "text", F.coalesce(F.col("n") - most, F.lit(0)).cast("bigint").alias("more"))


def catalog(concepts: DataFrame, backlinks: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(type, lines): concepts (id, title, type, rel_path) under their types, each with its bounded edges; untyped ones last."""
    lines = concepts.withColumn("line", F.concat(F.lit("* ["), "title", F.lit("](/"), "rel_path", F.lit(")")))
    for label, e in (("backlink", backlinks), ("link", links)):
        if e is None:
            continue
        names = concepts.select(F.col("id").alias("other"), F.col("title").alias("other_title"), F.col("rel_path").alias("other_path"))
        x = e.join(names, "other", "left")
        row = F.concat(F.lit(f"  * {label}: ["), F.coalesce("other_title", "other"), F.lit("](/"), F.coalesce("other_path", F.concat("other", F.lit(".md"))), F.lit(")"), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(" ("), "text", F.lit(")"))).otherwise(""))
        per = x.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows"), F.max("more").alias("more"))  # at most CATALOG_EDGES a list
        tail = F.when(F.col("more") > 0, F.array(F.format_string("  * … and %d more", "more"))).otherwise(F.array().cast("array<string>"))
        lines = lines.join(per.select("id", F.array_join(F.concat("rows.row", tail), "\n").alias("sub")), "id", "left").withColumn("line", F.concat_ws("\n", "line", "sub")).drop("sub")
    name = F.when(F.coalesce("type", F.lit("")) == "", "(untyped)").otherwise(F.col("type"))
    return lines.select(name.alias("type"), "rel_path", "line").orderBy(name == "(untyped)", "type", "rel_path")


def folder_index(concepts: DataFrame) -> DataFrame:
    """(dir, kind, name): what each folder holds, every folder above a concept included."""
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), (i == F.size(parts) - 1).alias("leaf"), F.element_at(parts, i + 1).alias("name")))
    x = concepts.select(F.explode(up).alias("u")).select("u.*").distinct()
    return x.select("dir", F.when(F.col("leaf"), "concept").otherwise("folder").alias("kind"), "name")


def catalog_text(lines: DataFrame) -> DataFrame:
    """(text): the catalog's lines (type, rel_path, line) as the block that follows the root's index."""
    groups = lines.groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rel_path", "line"))), lambda x: x["line"]), "\n").alias("body"))
    group = F.struct((F.col("type") == "(untyped)").alias("last"), "type", F.concat(F.lit("\n## "), "type", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    return groups.agg(F.concat(F.lit("\n# Catalog\n"), F.array_join(F.transform(F.sort_array(F.collect_list(group)), lambda x: x["text"]), "")).alias("text"))


# type inference

FILE_RULES = (
    ("Specification", "spec-%", "%-spec.md", "%_spec.md"),
    ("Runbook", "%-runbook.md", "%_runbook.md", "troubleshooting%", "runbook-%"),
    ("Decision", "adr-%", "adr_%", "%-adr.md"),
    ("Proposal", "rfc-%", "rfc_%", "%-rfc.md"),
    ("Guide", "%-guide.md", "%_guide.md", "guide-%", "howto%"),
    ("Benchmark", "benchmark-%", "%-benchmark.md"),
    ("Tutorial", "tutorial-%", "%-tutorial.md"),
    ("APIReference", "api-%", "%-api.md"),
)
_FOLDERS = {
    "Subsystem": "subsystem subsystems", "Runbook": "runbook runbooks", "Playbook": "playbook playbooks", "Proposal": "proposal proposals rfc rfcs",
    "Guide": "guide guides doc docs documentation developer developers", "Decision": "decision decisions adr adrs", "Specification": "spec specs specification specifications",
    "Metric": "metric metrics", "Table": "table tables", "Dataset": "dataset datasets", "Reference": "reference references", "Computation": "computation computations",
    "Policy": "policy policies", "Benchmark": "benchmark benchmarks", "Capability": "capability capabilities", "Journal": "journal journals", "Post": "post posts",
    "Article": "article articles", "Tutorial": "tutorial tutorials", "Architecture": "architecture", "APIReference": "api apis",
}
FOLDERS = {w: k for k, ws in _FOLDERS.items() for w in ws.split()}


def type_of_file(name: Column) -> Column:
    """The first file-name rule that matches; null for none."""
    f, out = F.lower(name), None
    for kind, *likes in FILE_RULES:
        hit = F.lit(False)
        for p in likes:
            hit = hit | f.like(p.replace("_", r"\_"))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def type_of_folder(folder: Column) -> Column:
    """A known folder name, from the last segment up; else the last segment as a singular title."""
    table = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    known = F.filter(F.transform(F.reverse(F.split(F.lower(folder), "/")), lambda s: F.try_element_at(table, s)), lambda k: k.isNotNull())
    last = F.element_at(F.split(folder, "/"), -1)
    single = F.when(last.rlike("(?i)ies$"), F.regexp_replace(last, "(?i)ies$", "y")).when(last.rlike("(?i)(ss|us|is)$"), last).when(last.rlike("(?i)(s|x|z|ch|sh)es$"), F.regexp_replace(last, "(?i)es$", "")).otherwise(F.regexp_replace(last, "(?i)s$", ""))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.replace(t.humanise(single), F.lit(" "), F.lit("")))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, total): the most frequent value, the least of equals; null values count in the total only."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    ranked = n.withColumn("total", F.sum("n").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col(value).isNull(), F.desc("n"), value)))
    return ranked.where((F.col("__r") == 1) & F.col(value).isNotNull()).select(group, value, "n", "total")


KEY_TYPES = {"Proposal": "goal", "Attested Computation": "runtime entrypoint", "Table": "sql query", "Schema": "schema", "Metric": "metric formula"}


def keyed(files: DataFrame) -> DataFrame:
    """(dir, k): the type that the frontmatter keys of half the files and more suggest, the first by name of equals."""
    hints = F.array_compact(F.array(*[F.when(F.arrays_overlap("keys", F.array(*map(F.lit, ks.split()))), k) for k, ks in KEY_TYPES.items()]))
    total = F.count(F.lit(1)).over(Window.partitionBy("dir"))
    n = files.select("dir", total.alias("total"), hints.alias("h")).select("dir", "total", F.explode("h").alias("k")).groupBy("dir", "total", "k").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.where(F.col("n") * 2 >= F.col("total")).withColumn("__r", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "k")))
    return ranked.where("__r = 1").select("dir", "k")


def infer_types(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(dir, type, tier, samples) of files (dir, name, authored[, keys]): authored majority, then frontmatter keys, then file names, then the folder.

    ``keys``, if there, is an array of each file's frontmatter keys; null for none.
    """
    from .lineage import kept

    files = kept(files, "named")  # each vote reads them
    clean = files.withColumn("authored", F.nullif(F.trim("authored"), F.lit(""))).withColumn("named", type_of_file(F.col("name")))
    wrote = majority(clean, "dir", "authored").where(F.col("n") * 2 >= F.col("total")).select("dir", F.col("authored").alias("a"))
    named = majority(clean, "dir", "named").where((F.col("n") * 2 >= F.col("total")) | (F.col("n") >= 2)).select("dir", F.col("named").alias("p"))
    dirs = clean.groupBy("dir").agg(F.slice(F.sort_array(F.collect_set("name")), 1, SAMPLE_FILES).alias("samples"))
    x = dirs.join(wrote, "dir", "left").join(named, "dir", "left")
    x = x.join(keyed(files), "dir", "left") if "keys" in files.columns else x.withColumn("k", F.lit(None).cast("string"))
    given = F.lit(None).cast("string")
    for d, k in (overrides or {}).items():
        given = F.when(F.col("dir") == d, k).otherwise(given)
    tier = F.when(given.isNotNull(), "override").when(F.col("a").isNotNull() | F.col("k").isNotNull(), "frontmatter").when(F.col("p").isNotNull(), "pattern").otherwise("folder")
    return x.select("dir", F.coalesce(given, "a", "k", "p", type_of_folder(F.col("dir"))).alias("type"), tier.alias("tier"), "samples")

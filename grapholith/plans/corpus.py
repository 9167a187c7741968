"""Markdown files made of the tables' rows, and the corpus operators over them.

Nations are complete concepts, customers lack a type every other time and link to
nations, suppliers are plain notes or, every fifth, files whose frontmatter has no end.
Templates are filled in Spark for the query and in SQL for what it must give.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import trust as tr
from ..operators import analytics as an
from ..operators import convert as cv
from ..operators import graph as g
from ..operators.lineage import kept, spread
from ..sources import bundle as bd
from .star import TODAY, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = f"{TODAY}T00:00:00Z"

_NATION = '---\ntype: Nation\ntitle: {n_name}\nverified:\n  - by: human:{n_regionkey}\n    at: "2000-01-01"\n---\n'
_NATION_BODY = "# {n_name}\n\n## Region\n\nIn region {n_regionkey} #region-{n_regionkey}\n"
_CUSTOMER = '---\ntitle: {c_name}\nstatus: {status}\nstale_after: "{after}"\n{typed}---\n'
_CUSTOMER_BODY = "# Profile\n\nLives in [home]({home}#region), near {wiki}, not in `[code](no.md)` #seg-{c_nationkey} #all\n\n## Profile\n\n[gone](missing-{c_custkey}.md)\n\n# Citations\n\n- [Ledger {c_custkey}](http://ledger/{c_custkey})\n- http://plain/{c_custkey}\n- note {c_custkey}\n"
_SUPPLIER = "# {s_name}\n\nSupplies, see [[customer missing]].\n"
_BAD = "---\nx: 1\nbody\n"
_STATUS = "CASE c_custkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'stable' ELSE 'odd' END"
_AFTER = "CASE WHEN c_custkey % 2 = 0 THEN '1999-01-01' ELSE '2030-01-01' END"
_TYPED = "CASE WHEN c_custkey % 2 = 0 THEN 'type: Customer\n' ELSE '' END"
_HOME, _WIKI = "'../nations/' || c_nationkey || '.md'", "'[[' || n_name || ']]'"


def _filled(template: str, **computed: str) -> str:
    """The template as an SQL expression of Spark and DuckDB alike."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = ["'" + x.replace("'", "''") + "'" if k % 2 == 0 else f"CAST({computed.get(x, x)} AS VARCHAR(99))" for k, x in enumerate(parts)]
    return " || ".join(quoted)


def _spark(sql: str):
    return F.expr(sql.replace("VARCHAR(99)", "STRING"))


_CUSTOMER_SQL = _filled(_CUSTOMER + _CUSTOMER_BODY, status=_STATUS, after=_AFTER, typed=_TYPED, home=_HOME, wiki=_WIKI)
_ROWS = "customers AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def files(spark, d) -> DataFrame:
    """(rel_path, text)."""
    nation, customer, supplier = (table(spark, d, x) for x in ("nation", "customer", "supplier"))
    customer, supplier = spread(customer, "c_custkey"), spread(supplier, "s_suppkey")  # before the texts are filled in
    people = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    path = lambda folder, key, end=".md": F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(end)).alias("rel_path")
    plain = F.when(F.col("s_suppkey") % 5 == 0, _BAD).otherwise(_spark(_filled(_SUPPLIER)))
    out = nation.select(path("nations/", "n_nationkey"), _spark(_filled(_NATION + _NATION_BODY)).alias("text"))
    out = out.unionByName(people.select(path("customers/", "c_custkey"), _spark(_CUSTOMER_SQL).alias("text")))
    return out.unionByName(supplier.select(path("suppliers/s-", "s_suppkey", "-guide.md"), plain.alias("text")))


def concepts(spark, d) -> DataFrame:
    return bd.concepts(files(spark, d))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {_ROWS} {sql}"
        return f

    return add


_C, _N, _S = "'customers/' || c_custkey", "'nations/' || n_nationkey", "'suppliers/s-' || s_suppkey || '-guide'"


# reading


@query(f"""SELECT {_C} AS concept_id, 0 AS ordinal, '../nations/' || c_nationkey || '.md#region' AS raw_target, 'home' AS "text", 'nations/' || c_nationkey AS target_id, true AS resolved FROM customers
UNION ALL SELECT {_C}, 1, 'missing-' || c_custkey || '.md', 'gone', 'customers/missing-' || c_custkey, true FROM customers
UNION ALL SELECT {_C}, 2, 'http://ledger/' || c_custkey, 'Ledger ' || c_custkey, '', false FROM customers""")
def corpus_links(spark, d):
    return bd.bundle_links(concepts(spark, d))


@query(f"""SELECT {_C} AS concept_id, unnest(['profile', 'profile-1', 'citations']) AS slug FROM customers
UNION ALL SELECT {_N}, unnest([replace(lower(n_name), ' ', '-'), 'region']) FROM nation UNION ALL SELECT {_S}, replace(lower(s_name), '#', '') FROM supplier WHERE s_suppkey % 5 <> 0""")
def corpus_anchors(spark, d):
    return bd.anchors(concepts(spark, d))


@query(f"""SELECT {_C} AS id, 'seg-' || c_nationkey || ',all' AS tags FROM customers UNION ALL SELECT {_N}, 'region-' || n_regionkey FROM nation UNION ALL SELECT {_S}, '' FROM supplier""")
def corpus_hashtags(spark, d):
    return concepts(spark, d).select("id", F.array_join("md.hashtags", ",").alias("tags"))


@query(f"""SELECT {_C} AS id, unnest([['Ledger ' || c_custkey, 'http://ledger/' || c_custkey], ['', 'http://plain/' || c_custkey], ['note ' || c_custkey, '']])[1] AS title,
unnest([['Ledger ' || c_custkey, 'http://ledger/' || c_custkey], ['', 'http://plain/' || c_custkey], ['note ' || c_custkey, '']])[2] AS resource FROM customers""")
def corpus_citations(spark, d):
    return concepts(spark, d).select("id", F.inline("md.citations"))


@query(f"""SELECT {_C} AS id, strpos(b, '`') - 1 AS start, strpos(b, '`') + 14 AS "end", '`[code](no.md)`' AS code FROM (SELECT *, {_filled(_CUSTOMER_BODY, home=_HOME, wiki=_WIKI)} AS b FROM customers)""")
def corpus_code(spark, d):
    x = concepts(spark, d).select("id", "body", F.inline("md.code"))
    return x.select("id", F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.expr("substr(body, start + 1, end - start)").alias("code"))


@query(f"""SELECT {_C} AS id, n_name AS target, '' AS alias FROM customers UNION ALL SELECT {_S}, 'customer missing', '' FROM supplier WHERE s_suppkey % 5 <> 0""")
def corpus_wikilinks(spark, d):
    return concepts(spark, d).select("id", F.explode("md.wikilinks").alias("w")).select("id", "w.target", "w.alias")


@query(f"""SELECT {_C} AS id, 'unverified' AS tier, '' AS basis, c_custkey % 2 = 0 AS stale, {_STATUS} AS status, false AS recovered FROM customers
UNION ALL SELECT {_N}, 'human-reviewed', 'human:' || n_regionkey || '@2000-01-01', false, '', false FROM nation UNION ALL SELECT {_S}, 'unverified', '', false, '', s_suppkey % 5 = 0 FROM supplier""")
def corpus_trust(spark, d):
    v = F.col("trust")["verified"]
    basis = F.array_join(F.transform(tr.tier_basis(v), lambda s: F.concat(s["by"], F.lit("@"), s["at"])), ",")
    return concepts(spark, d).select("id", tr.tier(v).alias("tier"), basis.alias("basis"), tr.stale(F.col("trust")["stale_after"], F.lit(TODAY)).alias("stale"), "trust.status", "recovered")


@query(f"""SELECT {_C} AS concept_id, true AS title_present, c_custkey % 2 = 0 AS type_present, false AS recovered, '' AS error FROM customers
UNION ALL SELECT {_N}, true, true, false, '' FROM nation UNION ALL SELECT {_S}, false, false, s_suppkey % 5 = 0, CASE WHEN s_suppkey % 5 = 0 THEN 'frontmatter has no end' ELSE '' END FROM supplier""")
def corpus_facts(spark, d):
    return bd.facts(concepts(spark, d)).withColumn("error", F.coalesce("error", F.lit("")))


@query(f"""SELECT {_C} || '.md' AS rel_path, CASE WHEN c_custkey % 2 = 0 THEN 'Customer' ELSE 'Person' END AS type, c_name AS title FROM customers
UNION ALL SELECT {_N} || '.md', 'Nation', n_name FROM nation UNION ALL SELECT {_S} || '.md', 'Thing', CASE WHEN s_suppkey % 5 = 0 THEN 'S ' || s_suppkey || ' Guide' ELSE s_name END FROM supplier""")
def corpus_defaults(spark, d):
    return bd.with_defaults(concepts(spark, d), {"customers": "Person", "default": "Thing"}).select("rel_path", "type", "title")


@query("""SELECT 'r/' || r_regionkey || '/index.md' AS rel_path, 'r/' || r_regionkey || CASE r_regionkey % 3 WHEN 0 THEN '/index-note.md' WHEN 1 THEN '/index-note-2.md' ELSE '/index-note-3.md' END AS output_path FROM region
UNION ALL SELECT 'r/' || r_regionkey || '/index-note.md', 'r/' || r_regionkey || '/index-note.md' FROM region WHERE r_regionkey % 3 > 0 UNION ALL SELECT 'r/' || r_regionkey || '/index-note-2.md', 'r/' || r_regionkey || '/index-note-2.md' FROM region WHERE r_regionkey % 3 > 1""")
def corpus_reserved_names(spark, d):
    r = table(spark, d, "region")
    names = F.slice(F.array(*map(F.lit, ("index", "index-note", "index-note-2"))), 1, (F.col("r_regionkey") % 3 + 1).cast("int"))
    return bd.output_paths(r.select(F.explode(names).alias("n"), "r_regionkey").select(F.format_string("r/%s/%s.md", F.col("r_regionkey").cast("string"), "n").alias("rel_path")))


# graph


@query(f"""SELECT {_C} AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Customer' ELSE '' END AS type, 'unverified' AS tier, c_custkey % 2 = 0 AS stale FROM customers
UNION ALL SELECT {_N}, n_name, 'Nation', 'human-reviewed', false FROM nation UNION ALL SELECT {_S}, {_S}, '', 'unverified', false FROM supplier""")
def corpus_nodes(spark, d):
    return g.nodes_of(concepts(spark, d), TODAY)


@query(f"""SELECT {_C} AS "from", 'nations/' || c_nationkey AS "to", 'home' AS "text" FROM customers UNION ALL SELECT {_C}, 'customers/missing-' || c_custkey, 'gone' FROM customers""")
def corpus_edges(spark, d):
    return g.edges_of(bd.bundle_links(concepts(spark, d)))


# conversion


_MADE = f"generated:\n  by: grapholith/0.1.0\n  at: '{NOW}'\n"
_DONE = _filled(_CUSTOMER[:-4], status=_STATUS, after=_AFTER, typed=_TYPED) + " || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'type: Note\n' END || " + _filled(
    "tags:\n  - seg-{c_nationkey}\n  - all\n" + _MADE + "---\n" + _CUSTOMER_BODY, home="'/nations/' || c_nationkey || '.md'", wiki="'[' || n_name || '](/nations/' || c_nationkey || '.md)'"
)


@query(f"""SELECT {_C} || '.md' AS output_path, {_DONE} AS "text" FROM customers UNION ALL SELECT {_N} || '.md', {_filled(_NATION[:-4] + "tags:\n  - region-{n_regionkey}\n" + _MADE + "---\n" + _NATION_BODY)} FROM nation
UNION ALL SELECT {_S} || '.md', CASE WHEN s_suppkey % 5 = 0 THEN {_filled("---\ntype: Note\ntitle: S {s_suppkey} Guide\n" + _MADE + "x_recovery:\n  recovered: true\n  reason: frontmatter has no end\n---\n\n" + _BAD)}
ELSE {_filled("---\ntype: Note\ntitle: {s_name}\n" + _MADE + "---\n\n" + _SUPPLIER)} END FROM supplier""")
def corpus_converted(spark, d):
    return cv.convert(files(spark, d), NOW).files.select("output_path", "text")


@query(f"""SELECT {_C} || '.md' AS rel_path, 'markdown' AS kind, '../nations/' || c_nationkey || '.md#region' AS target, 'nations/' || c_nationkey AS target_id, true AS resolved FROM customers
UNION ALL SELECT {_C} || '.md', 'markdown', 'missing-' || c_custkey || '.md', '', false FROM customers UNION ALL SELECT {_C} || '.md', 'markdown', 'http://ledger/' || c_custkey, '', false FROM customers
UNION ALL SELECT {_C} || '.md', 'wiki', n_name, 'nations/' || c_nationkey, true FROM customers UNION ALL SELECT {_S} || '.md', 'wiki', 'customer missing', '', false FROM supplier WHERE s_suppkey % 5 <> 0""")
def corpus_resolved(spark, d):
    return cv.convert(files(spark, d), NOW).links


@query(f"""SELECT {_C} || '.md' AS rel_path, 'would-enrich' AS status, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'type,' END || 'tags,sources,verified,generated' AS added, CASE WHEN c_custkey % 3 = 2 THEN 'status' ELSE '' END AS overwritten FROM customers
UNION ALL SELECT {_N} || '.md', 'would-enrich', 'tags,status,generated', 'verified' FROM nation
UNION ALL SELECT {_S} || '.md', CASE WHEN s_suppkey % 5 = 0 THEN 'skipped' ELSE 'would-enrich' END, 'type,title,status,verified,generated' || CASE WHEN s_suppkey % 5 = 0 THEN ',x_recovery' ELSE '' END, '' FROM supplier""")
def corpus_enriched(spark, d):
    """Statuses by folder, recomputed; citations become sources; an actor signs."""
    options = cv.Options(statuses={"customers": "wip", "default": "archived"}, canonical=True, map_citations=True, verified_by="human:me", stale={"nations/none": "+1y"})
    forget = files(spark, d).withColumn("text", F.replace("text", F.lit("status: odd\n"), F.lit("status: ' '\n")))  # a blank status counts as none
    return cv.enrich(forget, NOW, dry_run=True, options=options).select("rel_path", "status", F.array_join("added", ",").alias("added"), F.array_join("overwritten", ",").alias("overwritten"))


_ORDERED = "string_agg(line, '' ORDER BY name)"


@query(f"""SELECT 'customers/index.md' AS rel_path, '# Concepts\n\n' || {_ORDERED} AS "text" FROM (SELECT c_custkey || '.md' AS name, '* [' || c_name || '](' || c_custkey || '.md)\n' AS line FROM customers)
UNION ALL SELECT 'nations/index.md', '# Concepts\n\n' || {_ORDERED} FROM (SELECT n_nationkey || '.md' AS name, '* [' || n_name || '](' || n_nationkey || '.md)\n' AS line FROM nation)
UNION ALL SELECT 'suppliers/index.md', '# Concepts\n\n' || {_ORDERED} FROM (SELECT 's-' || s_suppkey || '-guide.md' AS name, '* [' || CASE WHEN s_suppkey % 5 = 0 THEN 'S ' || s_suppkey || ' Guide' ELSE s_name END || '](s-' || s_suppkey || '-guide.md)\n' AS line FROM supplier)
UNION ALL SELECT 'index.md', '---\nbundle_version: "0.2"\n---\n\n# Subdirectories\n\n* [customers](customers/index.md)\n* [nations](nations/index.md)\n* [suppliers](suppliers/index.md)\n'""")
def corpus_index(spark, d):
    return cv.convert(files(spark, d), NOW).index


# health


@query(f"""SELECT {_C} || '.md' AS rel_path, 'error' AS severity, 'missing type' AS message FROM customers WHERE c_custkey % 2 = 1
UNION ALL SELECT {_C} || '.md', 'advisory', 'status "odd" is not one of draft|stable|deprecated' FROM customers WHERE c_custkey % 3 = 2
UNION ALL SELECT {_S} || '.md', 'error', CASE WHEN s_suppkey % 5 = 0 THEN 'invalid frontmatter: frontmatter has no end' ELSE 'missing type' END FROM supplier""")
def corpus_validation(spark, d):
    return an.validate(concepts(spark, d)).select("rel_path", "severity", "message")


@query(f"""SELECT 'broken_links' AS bucket, {_C} AS concept, 'missing-' || c_custkey || '.md' AS detail FROM customers UNION ALL SELECT 'broken_links', {_S}, '[[customer missing]]' FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'missing_titles', {_S}, '' FROM supplier UNION ALL SELECT 'schema_violations', {_C}, 'missing type' FROM customers WHERE c_custkey % 2 = 1
UNION ALL SELECT 'schema_violations', {_S}, CASE WHEN s_suppkey % 5 = 0 THEN 'invalid frontmatter: frontmatter has no end' ELSE 'missing type' END FROM supplier
UNION ALL SELECT 'orphans', {_S}, '' FROM supplier UNION ALL SELECT 'orphans', {_N}, '' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'entrypoints', {_C}, '' FROM customers UNION ALL SELECT 'stale', {_C}, '' FROM customers WHERE c_custkey % 2 = 0""")
def corpus_lint(spark, d):
    done = cv.convert(files(spark, d), NOW)
    made = bd.concepts(done.files.select(F.col("output_path").alias("rel_path"), "text"))
    parts = an.lint(made, done.facts, TODAY)
    out = None
    for bucket, rows in parts.items():
        x = rows.select(F.lit(bucket).alias("bucket"), "concept", F.col("detail") if "detail" in rows.columns else F.lit("").alias("detail"))
        out = x if out is None else out.unionByName(x)
    return out


@query("""SELECT 'orphans' AS part, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS n
UNION ALL SELECT 'stale', count(*) FROM customers WHERE c_custkey % 2 = 0 UNION ALL SELECT 'unresolved', count(*) FROM customers UNION ALL SELECT 'unparsed_frontmatter', count(*) FROM supplier WHERE s_suppkey % 5 = 0""")
def corpus_review_gate(spark, d):
    c = kept(concepts(spark, d), "concepts")  # every part reads them
    links = bd.bundle_links(c)
    broken = links.where(~F.col("resolved") & t.is_concept_reference("raw_target")).select(F.col("concept_id").alias("from"), "raw_target")
    return an.strict_counts(an.review(g.nodes_of(c, TODAY), g.edges_of(links), broken, c.where("error is not null").select("rel_path")))


@query("""SELECT 'customers' AS dir, 'Customer' AS type, 'frontmatter' AS tier, (SELECT array_to_string(list_sort(list(c_custkey || '.md'))[1:3], ',') FROM customer) AS samples
UNION ALL SELECT 'nations', 'Nation', 'frontmatter', (SELECT array_to_string(list_sort(list(n_nationkey || '.md'))[1:3], ',') FROM nation)
UNION ALL SELECT 'suppliers', 'Guide', 'pattern', (SELECT array_to_string(list_sort(list('s-' || s_suppkey || '-guide.md'))[1:3], ',') FROM supplier)""")
def corpus_types(spark, d):
    c = concepts(spark, d)
    named = c.select(t.directory("rel_path").alias("dir"), F.element_at(F.split("rel_path", "/"), -1).alias("name"), F.col("type").alias("authored"), F.transform("fm", lambda e: e["key"]).alias("keys"))
    return an.infer_types(named).withColumn("samples", F.array_join("samples", ","))


@query(f"""SELECT 'Customer' AS type, {_C} || '.md' AS rel_path, '* [' || c_name || '](/' || {_C} || '.md)' AS line FROM customers WHERE c_custkey % 2 = 0
UNION ALL SELECT '(untyped)', {_C} || '.md', '* [' || c_name || '](/' || {_C} || '.md)' FROM customers WHERE c_custkey % 2 = 1 UNION ALL SELECT 'Nation', {_N} || '.md', '* [' || n_name || '](/' || {_N} || '.md)' FROM nation
UNION ALL SELECT '(untyped)', {_S} || '.md', '* [](/' || {_S} || '.md)' FROM supplier""")
def corpus_catalog(spark, d):
    return an.catalog(concepts(spark, d))

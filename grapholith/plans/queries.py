"""Registered graph and corpus queries, and their SQL. All run over whole tables; limits are the verbs' own caps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import trust as tr
from ..operators import analytics as an
from ..operators import graph as g
from ..operators import project as pr
from ..operators import resolve as rs
from ..sources import sinks
from . import corpus, star
from .star import EDGES_SQL, NODES_SQL, TODAY, edges, nodes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_N, _E = f"WITH RECURSIVE {NODES_SQL}", f"WITH RECURSIVE {EDGES_SQL}"
_NE = f"{_N}, {EDGES_SQL}"
_COLUMNS = "id, title, type, tier, stale"
_EDGE = 'SELECT "from", "to", "text" FROM'


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# graph verbs


@query(f"{_N} SELECT {_COLUMNS} FROM nodes WHERE id = 'customer/7'")
def lookup_by_id(spark, d):
    return g.lookup(nodes(spark, d), id="customer/7").nodes


@query(f"{_N} SELECT {_COLUMNS} FROM nodes WHERE type = 'customer' ORDER BY id LIMIT 1000")
def lookup_by_label(spark, d):
    return g.lookup(nodes(spark, d), label="customer").nodes


def _neighbors(sql_steps: str, condition: str) -> str:
    return f"{_NE} SELECT {_COLUMNS} FROM nodes WHERE id IN (SELECT b FROM {sql_steps} WHERE {condition}) ORDER BY id LIMIT 1000"


@query(_neighbors("st2", "a = 'orders/3'"))
def neighbors_out(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "orders/3", "out").nodes


@query(_neighbors("both_", "t = 'nation/3' AND a = 'nation/3'"))
def neighbors_in(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "nation/3", "in").nodes


@query(_neighbors("both_", "a = 'customer/5'"))
def neighbors_both(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "customer/5", "both").nodes


@query(_neighbors("st2", "a = 'orders/3' AND r = 'contains'"))
def neighbors_rel(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "orders/3", "out", "contains").nodes


@query(f"""{_NE}, k AS (SELECT id FROM nodes WHERE id IN (SELECT b FROM both_ WHERE a = 'nation/3') ORDER BY id LIMIT 1000), e AS (SELECT id FROM k UNION SELECT 'nation/3')
SELECT f AS "from", t AS "to", r AS "text" FROM both_ WHERE a = 'nation/3' AND f IN (SELECT id FROM e) AND t IN (SELECT id FROM e)""")
def neighbors_edges(spark, d):
    return g.neighbors(nodes(spark, d), edges(spark, d), "nation/3", "both").edges


def _within(start: str, steps: str, k: int) -> str:
    return f"""{_NE}, w AS (SELECT '{start}' AS id, 0 AS d UNION SELECT b, d + 1 FROM w JOIN {steps} s ON s.a = w.id WHERE d < {k}),
m AS (SELECT id, min(d) AS depth FROM w GROUP BY id), kept AS (SELECT nodes.*, depth FROM nodes JOIN m ON nodes.id = m.id ORDER BY nodes.id LIMIT 1000)"""


@query(f"{_within('region/0', 'both_', 2)} SELECT {_COLUMNS} FROM kept")
def neighborhood_d2(spark, d):
    return g.neighborhood(nodes(spark, d), edges(spark, d), "region/0", 2, "both").nodes


@query(f"{_within('customer/5', 'st2', 3)} SELECT id, depth FROM kept")
def neighborhood_d3_depths(spark, d):
    return g.neighborhood(nodes(spark, d), edges(spark, d), "customer/5", 3, "out").depths


@query(f"{_within('supplier/1', 'both_', 2)} {_EDGE} edges WHERE \"from\" IN (SELECT id FROM kept) AND \"to\" IN (SELECT id FROM kept)")
def neighborhood_d2_edges(spark, d):
    return g.neighborhood(nodes(spark, d), edges(spark, d), "supplier/1", 2, "both").edges


@query(f"{_NE} SELECT {_COLUMNS} FROM nodes WHERE type = 'orders' AND id IN (SELECT f FROM st2 JOIN nodes x ON x.id = t WHERE x.type = 'part') ORDER BY id LIMIT 1000")
def pattern_to_label(spark, d):
    return g.pattern(nodes(spark, d), edges(spark, d), "orders", "part").nodes


@query(f"""{_NE}, met AS (SELECT st2.* FROM st2 JOIN nodes x ON x.id = t WHERE x.tier = 'human-reviewed' AND r = 'placed_by'),
k AS (SELECT id FROM nodes WHERE type = 'orders' AND id IN (SELECT f FROM met) ORDER BY id LIMIT 1000) SELECT f AS "from", t AS "to", r AS "text" FROM met WHERE f IN (SELECT id FROM k)""")
def pattern_where_tier(spark, d):
    return g.pattern(nodes(spark, d), edges(spark, d), "orders", "", "placed_by", ("tier", "human-reviewed")).edges


@query(f"""{_NE}, w AS (SELECT 'customer/5' AS id, 0 AS d, CAST([] AS STRUCT(s VARCHAR, t VARCHAR, r VARCHAR)[]) AS ep, ['customer/5'] AS np
  UNION ALL SELECT s.b, d + 1, list_append(ep, {{'s': s.f, 't': s.t, 'r': s.r}}), list_append(np, s.b) FROM w JOIN both_ s ON s.a = w.id WHERE d < 2 AND NOT list_contains(np, s.b)),
best AS (SELECT np, d FROM w WHERE id = 'region/1' OR id = 'customer/5' AND d > 0 ORDER BY d, ep LIMIT 1)
SELECT count(*) > 0 AS "exists", CAST(coalesce(max(d), 0) AS INTEGER) AS length, coalesce(max(array_to_string(np, ' ')), '') AS path, false AS not_found FROM best""")
def path_shortest(spark, d):
    return _flat(g.path(nodes(spark, d), edges(spark, d), "customer/5", "region/1", 2, "both"))


@query(f"""{_NE}, w AS (SELECT 'region/0' AS id, 0 AS d UNION SELECT s.b, d + 1 FROM w JOIN st2 s ON s.a = w.id WHERE d < 5)
SELECT count(*) > 0 AS "exists", CAST(coalesce(min(d), 0) AS INTEGER) AS length, '' AS path, false AS not_found FROM w WHERE id = 'region/1'""")
def path_unreachable(spark, d):
    return _flat(g.path(nodes(spark, d), edges(spark, d), "region/0", "region/1", 5, "out"))


@query(f"""{_N} SELECT false AS "exists", 0::INTEGER AS length, '' AS path, count(*) < 2 AS not_found FROM nodes WHERE id IN ('region/0', 'region/none')""")
def path_not_found(spark, d):
    return _flat(g.path(nodes(spark, d), edges(spark, d), "region/0", "region/none", 2, "both"))


def _flat(p: DataFrame) -> DataFrame:
    return p.withColumn("path", F.array_join("path", " "))


@query(f"{_E}, a AS (SELECT 'nation/' || n_nationkey AS id FROM nation), w AS (SELECT id AS anchor, id, 0 AS d FROM a UNION SELECT anchor, s.a, d + 1 FROM w JOIN st2 s ON s.b = w.id WHERE d < 2) SELECT anchor, CAST(min_d AS INTEGER) AS depth, count(*) AS n FROM (SELECT anchor, id, min(d) AS min_d FROM w GROUP BY ALL) GROUP BY ALL")
def reach_all_nations(spark, d):
    anchors = table(spark, d, "nation").select(star.node_id("nation", "n_nationkey").alias("id"))
    return g.reach(edges(spark, d), anchors, 2, "in").groupBy("anchor", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_N} SELECT type AS label, count(*) AS n, 'id,stale,tier,title,type' AS properties FROM nodes GROUP BY type")
def list_graphs_labels(spark, d):
    return g.labels(nodes(spark, d)).withColumn("properties", F.array_join("properties", ","))


@query(f"{_NE} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT type) FROM nodes) AS labels")
def list_graphs_counts(spark, d):
    return g.describe(nodes(spark, d), edges(spark, d)).select("nodes", "edges", F.size("node_labels").cast("bigint").alias("labels"))


@query(f'{_E} SELECT "from" AS id, "text" AS rel, count(*) AS n FROM edges GROUP BY ALL')
def degree_out_by_rel(spark, d):
    return g.out_degree_by_rel(edges(spark, d))


# trust and projection


@query(f"{_N} SELECT id, tier FROM nodes")
def trust_tier(spark, d):
    s = star.stamps(spark, d).groupBy("id").agg(F.collect_list(F.struct("by", "at")).alias("verified"))
    return star.bare_nodes(spark, d).join(s, "id", "left").select("id", tr.tier(F.col("verified")).alias("tier"))


@query(f"{_N} SELECT id, stale FROM nodes WHERE type = 'orders'")
def stale_asof(spark, d):
    return nodes(spark, d).where("type = 'orders'").select("id", "stale")


def _relational(spark, d):
    n = pr.node_rows(star.full_nodes(spark, d))
    s = star.stamps(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("at", "by")).cast("bigint") - 1)
    return n, s.select(F.col("id").alias("node_key"), "seq", "by", "at", "is_human")


@query(f"{_N} SELECT id AS node_key, tier, stale FROM nodes")
def trust_derivation_view(spark, d):
    return pr.derived_trust(*_relational(spark, d), TODAY)


@query(f"{_N} SELECT id AS node_key, row_number() OVER (PARTITION BY id ORDER BY \"at\", \"by\") - 1 AS seq, \"by\", \"at\", \"by\" LIKE 'human:%' AS is_human FROM ev")
def node_verified_rows(spark, d):
    s = star.stamps(spark, d).groupBy(F.col("id").alias("node_key")).agg(F.sort_array(F.collect_list(F.struct("at", "by"))).alias("v"))
    return pr.stamp_rows(s.select("node_key", F.transform("v", lambda v: F.struct(v["by"].alias("by"), v["at"].alias("at"))).alias("verified")))


@query(f"{_N} SELECT id AS node_key, nullif(title, '') AS title, type, tier, stale, CASE WHEN stale_after <> '' THEN stale_after END AS stale_after FROM nodes")
def nodes_csv_rows(spark, d):
    return pr.node_rows(star.full_nodes(spark, d)).withColumn("stale_after", F.date_format("stale_after", "yyyy-MM-dd"))


@query(f"""{_E}, k AS (SELECT 'part/' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'sku-' || p_partkey ELSE '' END AS a FROM part)
SELECT coalesce(nullif(x.a, ''), "from") AS from_key, coalesce(nullif(y.a, ''), "to") AS to_key, nullif("text", '') AS rel FROM edges LEFT JOIN k x ON x.id = "from" LEFT JOIN k y ON y.id = "to" """)
def edges_csv_rows(spark, d):
    return pr.edge_rows(edges(spark, d), _keys(spark, d))


def _keys(spark, d):
    return table(spark, d, "part").select(star.node_id("part", "p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.concat(F.lit("sku-"), F.col("p_partkey").cast("string"))).otherwise("").alias("authored_key"))


@query("SELECT count(*) FILTER (WHERE p_size <= 25) AS path_fallback_count, 'frontmatter' AS strategy, count(*) FILTER (WHERE p_size <= 25) = 0 AS re_rooting_stable FROM part")
def identity_stability(spark, d):
    return pr.identity_stability(_keys(spark, d))


@query(f"""{_N} SELECT '(''' || id || ''', ' || coalesce('''' || replace(title, '''', '\\''') || '''', 'NULL') || ', ''' || type || ''', ''' || tier || ''', ' || upper(CAST(stale AS VARCHAR)) || ', '
|| CASE WHEN stale_after <> '' THEN 'DATE ''' || stale_after || '''' ELSE 'NULL' END || ')' AS "values" FROM nodes""")
def insert_tuples(spark, d):
    return pr.insert_tuples(pr.node_rows(star.full_nodes(spark, d)), list(pr.NODE_COLUMNS))


@query(f"""{_NE} SELECT '  "' || id || '" [label="' || coalesce(nullif(title, ''), id) || '"];' AS line FROM nodes UNION ALL SELECT '  "' || "from" || '" -> "' || "to" || '" [label="' || "text" || '"];' FROM edges""")
def dot_lines(spark, d):
    return sinks.dot_lines(nodes(spark, d), edges(spark, d))


# corpus analytics


@query(f"{_N} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def review_by_type(spark, d):
    return an.by_type(nodes(spark, d))


@query(f"{_N} SELECT tier, count(*) AS n FROM nodes GROUP BY tier")
def review_tiers(spark, d):
    return an.tiers(nodes(spark, d))


def _roles(loops: bool) -> str:
    pool = "edges" if loops else 'edges WHERE "from" <> "to" AND "to" IN (SELECT id FROM nodes)'
    return f"""{_NE}, p AS (SELECT * FROM {pool}), i AS (SELECT DISTINCT "to" AS id FROM p), o AS (SELECT DISTINCT "from" AS id FROM p)
SELECT id, CASE WHEN id IN (SELECT id FROM i) THEN 'linked' WHEN id IN (SELECT id FROM o) THEN 'entrypoint' ELSE 'orphan' END AS role FROM nodes"""


@query(_roles(False))
def node_roles(spark, d):
    return an.node_roles(star.bare_nodes(spark, d), edges(spark, d), False)


@query(_roles(True))
def node_roles_lint(spark, d):
    return an.node_roles(star.bare_nodes(spark, d), edges(spark, d), True)


@query(f"""{_NE} SELECT id FROM nodes WHERE id NOT IN (SELECT "to" FROM edges WHERE "text" = 'placed_by') AND id NOT IN (SELECT "from" FROM edges WHERE "text" = 'placed_by')""")
def orphans(spark, d):
    """Nodes that no order relation touches."""
    return an.node_roles(star.bare_nodes(spark, d), edges(spark, d).where("text = 'placed_by'"), False).where("role = 'orphan'").select("id")


@query("SELECT 'user/' || user_id AS \"from\", 'customer/' || user_id AS \"to\", event_type AS \"text\" FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_edges(spark, d):
    e = table(spark, d, "events").select(star.node_id("user", "user_id").alias("from"), star.node_id("customer", "user_id").alias("to"), F.col("event_type").alias("text"))
    return an.dangling(e, table(spark, d, "customer").where("c_acctbal > 0").select(star.node_id("customer", "c_custkey").alias("id")))


@query(f"""{_NE}, w AS (SELECT *, row_number() OVER (PARTITION BY "to" ORDER BY "from", "to", "text") AS pos, count(*) OVER (PARTITION BY "to") AS n FROM edges)
SELECT "to" AS id, CAST(pos AS INTEGER) AS pos, "from" AS other, "text", greatest(n - 20, 0) AS more FROM w WHERE pos <= 20""")
def catalog_top20(spark, d):
    return an.catalog_edges(nodes(spark, d), edges(spark, d), True)


@query("""WITH p AS (SELECT string_split(lang || '/' || source || '/' || doc_id || '.md', '/') AS s FROM documents),
u AS (SELECT s, unnest(range(0, len(s))) AS i FROM p)
SELECT DISTINCT array_to_string(s[1:i], '/') AS dir, CASE WHEN i = len(s) - 1 THEN 'concept' ELSE 'folder' END AS kind, s[i + 1] AS name FROM u""")
def dir_index(spark, d):
    return an.folder_index(table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path")))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS resolved, count(*) FILTER (WHERE c_custkey IS NULL) AS unresolved FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0")
def link_tally(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return an.link_tally(table(spark, d, "events").join(c, F.col("user_id") == F.col("c_custkey"), "left").withColumn("resolved", F.col("c_custkey").isNotNull()))


@query("""WITH n AS (SELECT c_nationkey::VARCHAR AS dir, c_mktsegment AS authored, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY dir)::BIGINT AS total, row_number() OVER (PARTITION BY dir ORDER BY n DESC, authored) AS k FROM n)
SELECT dir, authored, n, total FROM r WHERE k = 1""")
def infer_majority(spark, d):
    return an.majority(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("dir"), F.col("c_mktsegment").alias("authored")), "dir", "authored")


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'advisory' END AS severity, count(*) AS n FROM events GROUP BY 1")
def validate_events(spark, d):
    """Events as concepts: errors lack a type, the others' stamps name no actor."""
    e = table(spark, d, "events")
    none = F.lit(None)
    trust = F.struct(F.array().alias("sources"), none.alias("usage_window"), none.alias("generated"), F.array(F.struct(F.when(F.col("event_type") == "error", "human:x").otherwise(F.col("event_type")).alias("by"), F.lit("").alias("at"))).alias("verified"), F.lit("").alias("status"), F.lit("").alias("stale_after")).cast(an.TRUST)
    c = e.select(F.col("event_id").cast("string").alias("rel_path"), trust.alias("trust"), F.when(F.col("event_type") == "error", "").otherwise("Note").alias("type"), F.lit(True).alias("has_runtime"), F.lit(None).cast("string").alias("error"))
    return an.validate(c).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# text and resolution


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def title_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", t.title_slug(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"))


@query("SELECT p_partkey, array_to_string([upper(w[1:1]) || w[2:] for w in string_split(p_name || ' ' || lower(p_type), ' ') if w <> ''], ' ') AS title FROM part")
def humanise(spark, d):
    return table(spark, d, "part").select("p_partkey", t.humanise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.lower("p_type"), F.lit(".md"))).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def href_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE h = '' OR h LIKE '#%' OR h LIKE '%://%' OR regexp_matches(lower(h), '^(mailto|tel|ftp):')) AS external FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)")
def href_internal(spark, d):
    return href_extract(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(t.is_external_reference("href")).alias("external"))


_ACTORS = ("event_type || '/' || user_id", "'human:'", "' process:' || event_type", "event_type || ' x/' || user_id", "'team:a b'", "event_type", "event_type || '/'")
_ACTOR = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_ACTORS)) + " END"


@query(f"SELECT event_id, {_ACTOR} AS actor, event_id % 7 IN (0, 2, 4) AS ok FROM events")
def actor_valid(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_ACTOR).alias("actor")).select("event_id", "actor", t.is_actor("actor").alias("ok"))


@query("""WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || (15 + o_orderkey % 20) AS s, CAST(o_orderkey % 30 AS VARCHAR) AS h FROM orders)
SELECT o_orderkey, s, try_cast(s AS DATE) IS NOT NULL AS ok, try_cast(s AS DATE) IS NOT NULL AND o_orderkey % 30 BETWEEN 10 AND 23 AS timed, try_cast(s AS DATE) IS NOT NULL AND o_orderkey % 3 = 0 AS cut_off FROM x""")
def iso_date_valid(spark, d):
    o = table(spark, d, "orders")
    x = o.select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), (15 + F.col("o_orderkey") % 20).cast("string")).alias("s"), (F.col("o_orderkey") % 30).cast("string").alias("h"))
    kept = F.when(F.col("o_orderkey") % 3 == 0, F.col("s")).otherwise(F.substring("s", 1, 7))
    return x.select("o_orderkey", "s", t.is_iso_date("s").alias("ok"), t.is_iso_datetime(F.concat("s", F.lit("T"), "h", F.lit(":30:00Z"))).alias("timed"), t.is_iso_date(kept).alias("cut_off"))


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 45, '%Y-%m-%d') AS plus_days, strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER), '%Y-%m-%d') AS plus_month,
strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER), '%Y-%m-%d') AS plus_year FROM orders""")
def relative_date(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[t.shifted_date("o_orderdate", F.lit(r)).alias(n) for r, n in (("+45d", "plus_days"), ("+1m", "plus_month"), ("+1y", "plus_year"))])


_PREFIXES = {"en": "English", "en/src1": "First", "de": "German", "fr/src2": "Second", "en/src1/1": "Deep"}


@query("""WITH m(k, v) AS (VALUES ('en', 'English'), ('en/src1', 'First'), ('de', 'German'), ('fr/src2', 'Second'), ('en/src1/1', 'Deep')),
p AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS p FROM documents),
r AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY length(k) DESC) AS n FROM p JOIN m ON p = k OR starts_with(p, k || '/'))
SELECT p.doc_id, v AS value FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND n = 1""")
def prefix_map_longest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("p"))
    return docs.select("doc_id", rs.longest_prefix(docs, "p", _PREFIXES).alias("value"))


@query(ORACLE["prefix_map_longest"])
def prefix_map_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("p"))
    return rs.longest_prefix_join(docs, "p", spark.createDataFrame(list(_PREFIXES.items()), "prefix string, value string")).select("doc_id", "value")


@query("""WITH f AS (SELECT 'parts/' || p_partkey AS path, p_name AS title FROM part UNION ALL SELECT 'people/' || c_name, c_name FROM customer),
k AS (SELECT path, lower(string_split(path, '/')[2]) AS stem, regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM f),
a AS (SELECT stem, max(path) AS o, min(path) <> max(path) AS m FROM k GROUP BY stem), b AS (SELECT slug, max(path) AS o, min(path) <> max(path) AS m FROM k GROUP BY slug),
l AS (SELECT 'p' || p_partkey AS link_id, 'parts/' || p_partkey AS t FROM part UNION ALL SELECT 'n' || p_partkey, p_name FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'x' || n_nationkey, n_name FROM nation)
SELECT link_id, coalesce(CASE WHEN k.path IS NOT NULL THEN k.path WHEN a.stem IS NOT NULL THEN CASE WHEN a.m THEN '' ELSE a.o END WHEN b.m THEN '' ELSE b.o END, '') AS target_id
FROM l LEFT JOIN k ON k.path = l.t LEFT JOIN a ON a.stem = lower(trim(l.t)) LEFT JOIN b ON b.slug = regexp_replace(regexp_replace(lower(trim(l.t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')""")
def wiki_resolve(spark, d):
    part, customer, nation = (table(spark, d, x) for x in ("part", "customer", "nation"))
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("parts/"), key)
    who = F.concat(F.lit("people/"), "c_name")
    files = part.select(path.alias("source_path"), path.alias("output_path"), F.col("p_name").alias("title")).unionByName(customer.select(who.alias("source_path"), who.alias("output_path"), F.col("c_name").alias("title")))
    links = part.select(F.concat(F.lit("p"), key).alias("link_id"), path.alias("target")).unionByName(part.select(F.concat(F.lit("n"), key).alias("link_id"), F.col("p_name").alias("target")))
    links = links.unionByName(customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("link_id"), F.col("c_name").alias("target"))).unionByName(nation.select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("link_id"), F.col("n_name").alias("target")))
    return rs.resolve(links.withColumn("from_dir", F.lit(".")), files).select("link_id", "target_id")


QUERIES |= corpus.QUERIES
ORACLE |= corpus.ORACLE

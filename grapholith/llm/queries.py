"""One query per operator, over its whole table with production parameters, and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chaining, ngram_join, packing, pii, quality, spm, topk, toxicity, urls


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _labelled(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_BLOCKED = "(^|[./-])(casino|bets?|pills|poker|viagra|porn)([./-]|$)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a listed URL; the list: the canonical URLs of all pages of hosts that are named for gambling, pills or porn."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host = F.regexp_extract(F.lower(F.col("url")), "^[a-z]+://([^/?#]*)", 1)
    listed = pages.where(host.rlike(_BLOCKED)).select("url")
    return urls.listed_pages(pages, listed)


ASKED = 50  # the searches' queries: all rows whose id is a multiple, each against all rows


def _search(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return f(rows, queries=rows.where(F.col("vec_id") % ASKED == 0))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": _search(topk.top_k),
    "op2_sentencepiece": _table("documents", spm.encode_documents),
    "op3_ngram_jaccard": _table("documents", ngram_join.classes),
    "op4_ann": _search(ann.neighbours),
    "op5_pii": _table("documents", pii.detect),
    "op6_toxicity": _labelled(toxicity.toxic),
    "op7_packing": _table("documents", packing.pack),
    "op8_url_filter": _pages,
    "op9_quality": _labelled(quality.classify),
    "op10_substring_chains": _table("documents", chaining.passages),
}

_WORDS = "regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')"

_CANONICAL = """
WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages WHERE url IS NOT NULL),
p AS (SELECT page_id, url, regexp_extract(u, '^([^?]*)', 1) AS main, regexp_extract(u, '\\?(.*)$', 1) AS q FROM u),
h AS (SELECT page_id, url, lower(regexp_extract(main, '^([^/]*)', 1)) AS h, regexp_extract(main, '^[^/]*(.*)$', 1) AS path,
        regexp_replace(regexp_replace(q, '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM p),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '^.*@', ''), ':(80|443)$', ''), '^(www\\d?|m)\\.', '')
        || regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM h)
"""

ORACLE: dict[str, str] = {
    "op1_exact_topk": f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {ASKED} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM r WHERE rank <= {topk.K}
""",
    "op8_url_filter": f"""{_CANONICAL}
SELECT page_id, url, canonical_url FROM c WHERE canonical_url IN
  (SELECT canonical_url FROM c WHERE regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '{_BLOCKED}'))
""",
    "op3_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {ngram_join.N} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {ngram_join.N} - 1], ' ') for i in range(1, len(w) - {ngram_join.N} + 2)] END)) AS g
      FROM w WHERE len(w) > 0),
c AS (SELECT g, min(doc_id) AS rep, count(DISTINCT doc_id) AS copies FROM s GROUP BY g),
m AS (SELECT DISTINCT s.doc_id, c.rep, c.copies FROM s JOIN c ON s.g = c.g),
u AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
o AS (SELECT a.rep AS doc_a, b.rep AS doc_b, a.n AS na, b.n AS nb, count(*) AS k
      FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
p AS (SELECT doc_a, doc_b FROM o WHERE k::DOUBLE / (na + nb - k) >= {ngram_join.T}),
e AS (SELECT doc_a AS x, doc_b AS y FROM p UNION ALL SELECT doc_b, doc_a FROM p),
l AS (SELECT e.x AS rep, sum(c.copies) AS k FROM e JOIN c ON c.rep = e.y GROUP BY e.x),
r(rep, root) AS (SELECT rep, rep FROM c UNION SELECT r.rep, e.y FROM r JOIN e ON r.root = e.x),
k AS (SELECT rep, min(root) AS class_id FROM r GROUP BY rep)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(m.copies - 1, 0) + coalesce(l.k, 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.rep = m.rep LEFT JOIN l ON l.rep = m.rep
""",
}

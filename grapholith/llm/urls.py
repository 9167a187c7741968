"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A canonical URL's 64-bit hash names one block of 512 bits, in which a second hash sets
``PROBES`` bits, so a look-up touches one cache line. Segments of blocks are built on the
executors. The filter is broadcast and has ``MOST_BYTES`` at most: a longer list gets fewer
bits a URL and passes more. What passes is joined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

PROBES, BITS = 6, 16  # bits set per URL; bits of filter per URL
MOST_BYTES = 64 << 20
_SEGMENT = 1024  # blocks built in one task: 64 KB
_U = np.uint64

_TRACKING = "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical(url: Column) -> Column:
    """Host without www or m, path without end slash or .html, query without tracking; null for null.

    Scheme, user, default port and fragment go; the host is in lower case, the rest as
    it is. A text that isn't a URL is treated as host and path.
    """
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    main, query = F.regexp_extract(u, "^([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    host = F.lower(F.regexp_extract(main, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^(www\d?|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(main, "^[^/]*(.*)$", 1), "/+$", ""), r"\.html?$", "")
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _second(h: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def places(h: np.ndarray, blocks: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(block, bit positions[n, probes]) of 64-bit hashes."""
    s = _second(h)
    return ((h >> _U(32)) % _U(blocks)).astype(np.int64), np.stack([(s >> _U(9 * k)) & _U(511) for k in range(probes)], 1).astype(np.int64)


def shape(n: int, most_bytes: int) -> tuple[int, int]:
    """(blocks, probes) for n keys: ``BITS`` a key, or as many as the memory holds; fewer bits take fewer probes and pass more."""
    blocks = max(1, min(-(-n * BITS // 512), most_bytes // 64))
    return blocks, max(1, min(PROBES, round(0.69 * blocks * 512 / max(n, 1))))


def _build(blocks: int, probes: int):
    def run(t: pa.Table) -> pa.Table:
        h = t["h"].to_numpy().view(np.uint64)
        seg = t["segment"][0].as_py()
        block, bits = places(h, blocks, probes)
        out = np.zeros((min(_SEGMENT, blocks - seg * _SEGMENT), 64), np.uint8)
        np.bitwise_or.at(out, (np.repeat(block - seg * _SEGMENT, probes), bits.ravel() >> 3), (1 << (bits.ravel() & 7)).astype(np.uint8))
        return pa.table([pa.array([seg], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["segment", "bits"])

    return run


def bloom(listed: DataFrame, column: str, blocks: int, probes: int) -> np.ndarray:
    """The filter of ``listed``'s strings, as blocks of 64 bytes, in the driver."""
    h = listed.select(F.xxhash64(column).alias("h"))
    seg = h.withColumn("segment", F.expr(f"cast(floor(((h >> 32) & 4294967295) % {blocks} / {_SEGMENT}) as bigint)"))
    out = np.zeros((blocks, 64), np.uint8)
    for r in seg.groupBy("segment").applyInArrow(_build(blocks, probes), "segment bigint, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8).reshape(-1, 64)
        out[r["segment"] * _SEGMENT : r["segment"] * _SEGMENT + len(part)] = part
    return out


def may_hold(filter_: np.ndarray, h: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """False only for hashes that aren't in the filter."""
    block, bits = places(h, len(filter_), probes)
    hit = np.ones(len(h), bool)
    for k in range(probes):
        hit &= (filter_[block, bits[:, k] >> 3] >> (bits[:, k] & 7).astype(np.uint8)) & 1 > 0
    return hit


def listed_pages(pages: DataFrame, listed: DataFrame, url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``pages`` whose canonical URL is that of a listed one, with it as ``canonical_url``.

    ``listed`` has a column ``url``. A null URL is in no list; URLs of equal canonical
    form, repeated ones included, count once in the list and come back each from
    the pages. An empty list finds nothing. A column of the pages that is itself
    named ``canonical_url`` is replaced. The filter never takes more than ``most_bytes``: a longer list passes
    more false hits to the join, which removes them.
    """
    spark = pages.sparkSession
    key = scratch.fresh(pages, "listed")
    keys = scratch.table(listed.select(canonical(F.col("url")).alias(key)).where(F.col(key).isNotNull()).distinct(), "listed")
    rows = pages.withColumn("canonical_url", canonical(F.col(url_col))).where("canonical_url is not null")
    n = keys.count()
    if not n:
        return rows.where("false")
    blocks, probes = shape(n, most_bytes)
    shared = spark.sparkContext.broadcast(bloom(keys, key, blocks, probes))

    @F.arrow_udf("boolean")
    def passes(h: pa.Array) -> pa.Array:
        return pa.array(may_hold(shared.value, h.to_numpy(zero_copy_only=False).view(np.uint64), probes))

    return rows.where(passes(F.xxhash64("canonical_url"))).join(keys, F.col("canonical_url") == F.col(key), "left_semi")

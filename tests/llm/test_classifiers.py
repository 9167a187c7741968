import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grapholith.llm import quality, toxicity, trees, urls

from .conftest import prose

SF = "/root/testdata/sf0.01"


def test_additive_tables_and_pairs():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    m = trees.fit_additive(x[:2000], y[:2000], pairs=2)
    assert ((m.score(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.95 and (1, 0) in m.pairs
    one = m.base + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(m.cuts, m.tables, x[0])) + sum(t[np.searchsorted(m.coarse[i], x[0, i], "right"), np.searchsorted(m.coarse[j], x[0, j], "right")] for (i, j), t in m.pairs.items())
    assert m.score(x[:1])[0] == pytest.approx(trees.sigmoid(np.array(one)))


def test_isotonic_is_monotone_and_fits():
    z = np.array([0.0, 1, 1, 2, 3, 4, 5])
    y = np.array([0, 1, 0, 0, 1, 1, 1])
    at, p = trees.isotonic(z, y)
    assert (np.diff(p) >= 0).all() and trees.calibrated(np.array([-9.0, 9.0]), (at, p)).tolist() == [0, 1]
    assert p[at == 2][0] == pytest.approx(1 / 3)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("pmod(xxhash64(doc_id, 3), 3) > 0"), labels.where("pmod(xxhash64(doc_id, 3), 3) = 0")
    q = quality.classify(docs, train).join(held, "doc_id").toPandas()
    assert ((q["quality_x"] if "quality_x" in q else q.iloc[:, 1]) >= 0).all() and (q["kept"] == (q.iloc[:, 3] == 1)).mean() > 0.93
    t = toxicity.scores(docs, train).join(held, "doc_id").toPandas()
    assert ((t["toxicity"] >= 0.5) == (t["toxic"] == 1)).mean() > 0.9


def labelled_rows(n):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        bad, rude = k % 5 == 0, k % 4 == 1
        text = " ".join(w + "$$$" for w in prose(k, 60).split()) if bad else prose(k, 60)
        if rude:
            w = text.split()
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "you moron", "st*pid", "1diot", "qqblarg"]))
            text = " ".join(w)
        rows.append((1000 + k, text))
        labels.append((1000 + k, int(not bad), int(rude)))
    return rows, labels


def test_classifiers_on_odd_rows(spark, make, odd):
    rows, labels = labelled_rows(400)
    docs = make([*odd, *rows])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (1000, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(docs, lab).collect()
    assert len(out) == len(odd) + 400
    for r in out:
        if r["doc_id"] in (1, 2, 3):
            assert r["quality"] == 0 and not r["kept"]
    good = {r["doc_id"]: r["kept"] for r in out}
    assert np.mean([good[i] == bool(q) for i, q, _ in labels]) > 0.97
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    tox = {r["doc_id"] for r in toxicity.toxic(docs, lab).collect()}
    assert np.mean([(i in tox) == bool(t) for i, _, t in labels]) > 0.95 and not tox & {1, 2, 3, 6, 7, 8}
    none = lab.where("false")
    assert toxicity.toxic(docs, none).count() == 0 and quality.classify(docs, none).where("kept").count() == len([1 for _, t in odd if t and t.strip()]) + 400
    assert quality.classify(make([]), lab).count() == 0 and toxicity.scores(make([]), none).count() == 0


def test_disguises_are_undone():
    data = np.frombuffer(b"you are an 1d10t and st.u.p.i.d m0r0n!", np.uint8)
    x = toxicity.features(data, np.array([0, len(data)]), np.zeros(0, np.uint64))[0]
    assert x[toxicity.NAMES.index("disguised")] > 0 and x[toxicity.NAMES.index("insults")] == 0


# URL filter


def test_canonical_urls_and_the_join(spark):
    pages = [(1, "http://WWW.A.com:80/x/?utm_source=f#t"), (2, "https://a.com/x.html"), (3, "https://b.com/y?page=2&ref=q"), (4, None), (5, ""), (6, "https://c.com/z"), (2, "https://a.com/x.html"), (7, "m.a.com/x")]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in pages], "page_id bigint, url string, html string, listed int")
    lst = spark.createDataFrame([("a.com/x",), ("http://b.com/y?page=2",), (None,), ("a.com/x/",)], "url string")
    for most in (urls.MOST_BYTES, 0):
        got = urls.listed_pages(df, lst, most_bytes=most)
        assert sorted(r["page_id"] for r in got.collect()) == [1, 2, 2, 3, 7]
        assert got.columns == [*df.columns, "canonical_url"]
    assert urls.listed_pages(df, lst.where("false")).count() == 0 and urls.listed_pages(df.where("false"), lst).count() == 0


def test_bloom_has_no_false_negatives(spark):
    lst = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("u"))
    blocks, probes = urls.shape(20_000, urls.MOST_BYTES)
    b = urls.bloom(lst, "u", blocks, probes)
    inside = np.array([r["h"] for r in lst.select(F.xxhash64("u").alias("h")).collect()], np.int64).view(np.uint64)
    outside = np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert urls.may_hold(b, inside).all() and urls.may_hold(b, outside).mean() < 0.02
    for most in (20_000, 5_000, 64):  # 8 bits a key, 2, and one block for all: still none lost
        blocks, probes = urls.shape(20_000, most)
        b = urls.bloom(lst, "u", blocks, probes)
        assert b.nbytes <= most and urls.may_hold(b, inside, probes).all()

import numpy as np
import pytest

from grapholith.llm import ann, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cell int, v string, id int, nn int")


def rows_of(x):
    return [(i, [float(a) for a in v], 0, 1, "v", 2, 3) for i, v in enumerate(x)]


def brute(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("search", [topk.top_k, ann.neighbours])
def test_recall_and_ties(spark, search):
    r = np.random.default_rng(0)
    x = (r.standard_normal((12, 32))[r.integers(0, 12, 600)] + 0.3 * r.standard_normal((600, 32))).astype(np.float32).astype(float)
    x[100:140] = x[100]  # ties
    ids, dist = brute(x, 5)
    got = search(table(spark, rows_of(x)), k=5, cell=64).toPandas().sort_values(["vec_id", "rank"])
    assert len(got) == 3000 and (got["rank"].to_numpy().reshape(-1, 5) == np.arange(1, 6)).all()
    found = got["neighbor_id"].to_numpy().reshape(-1, 5)
    if search is topk.top_k:
        assert (found == ids).all() and np.allclose(got["distance"].to_numpy().reshape(-1, 5), dist)
    else:
        assert np.mean(got["distance"].to_numpy().reshape(-1, 5) <= dist + 1e-6) >= 0.9


@pytest.mark.parametrize("search", [topk.top_k, ann.neighbours])
def test_odd_rows(spark, search):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (2, [3.0, 4.0]), (2, [9.0, 9.0]), (8, [float("inf"), 0.0])]
    got = search(table(spark, [(i, v, 0, 1, "v", 2, 3) for i, v in rows]), k=3).collect()
    assert sorted((r["vec_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert search(table(spark, []), k=3).collect() == []


@pytest.mark.parametrize("search", [topk.top_k, ann.neighbours])
def test_queries_against_all_rows(spark, search):
    """Waves over many small cells, hot equal rows among them, against brute force."""
    r = np.random.default_rng(3)
    x = (3 * r.standard_normal((20, 16))[r.integers(0, 20, 900)] + 0.5 * r.standard_normal((900, 16))).astype(np.float32).astype(float)
    x[300:600] = x[300]
    all_ = table(spark, rows_of(x))
    got = search(all_, k=4, cell=8, queries=all_.where("vec_id % 50 = 0")).toPandas().sort_values(["vec_id", "rank"])
    ids, dist = brute(x, 4)
    asked = np.arange(0, 900, 50)
    assert got["vec_id"].tolist() == np.repeat(asked, 4).tolist()
    if search is topk.top_k:
        assert (got["neighbor_id"].to_numpy().reshape(-1, 4) == ids[asked]).all() and np.allclose(got["distance"].to_numpy().reshape(-1, 4), dist[asked])
    else:
        assert np.mean(got["distance"].to_numpy().reshape(-1, 4) <= dist[asked] + 1e-6) >= 0.9
    assert search(all_, k=4, queries=all_.where("vec_id < 0")).collect() == []
    stranger = search(all_, k=2, queries=table(spark, [(-7, [0.0] * 16, 0, 1, "v", 2, 3), (-8, [0.0] * 3, 0, 1, "v", 2, 3)])).collect()
    assert [(r["vec_id"], r["rank"]) for r in stranger] == [(-7, 1), (-7, 2)]


def test_equal_vectors_split_a_cell(spark):
    x = np.zeros((300, 4))
    got = topk.top_k(table(spark, rows_of(x)), k=2, cell=16).toPandas()
    assert len(got) == 600 and (got["distance"] == 0).all()
    first = got[got["rank"] == 1].set_index("vec_id")["neighbor_id"]
    assert first[0] == 1 and (first[1:] == 0).all()


def test_bounds_and_quantile():
    r = np.random.default_rng(1)
    a, b = r.standard_normal((50, 37)), r.standard_normal((50, 37))
    true = ((a - b) ** 2).sum(1)
    for s in topk.LEVELS:
        assert (((topk.statistics(a, s) - topk.statistics(b, s)) ** 2).sum(1) <= true + 1e-9).all()
    assert abs(ann.chi_square(ann.quantile(0.95, 8), 8) - 0.95) < 1e-9 and abs(ann.quantile(0.95, 8) - 15.507) < 0.01

from __future__ import annotations

import math

import numpy as np
import pytest

from tillage.llm.lsh_forest import Bands, Forest, nearest

ROWS = "vec_id long, embedding array<float>, label int, score string, rank string, block string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], ROWS)


def exact(rows, asked, k):
    """The k best for each query by trying all, on float32 values in doubles."""
    good = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q in asked:
            best = sorted(((-float(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out[q] = [i for _, i in best]
    return out


def test_small_tables_are_searched_whole(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0, None] + [0.0] * 6), (63, [math.nan] * 8), (64, [math.inf] * 8), (None, [1.0] * 8), (80, []), (81, [1.0, 2.0])]
    rows += [(90, rows[5][1]), (40, rows[40][1])]  # equal vectors tie, equal rows count once
    df = frame(spark, rows)
    out = nearest(df, df.where("vec_id % 20 = 0 or vec_id is null"), k=7).orderBy("query_id", "rank").collect()
    want = exact(rows, {0, 20, 40}, 7)
    assert {q: [r.vec_id for r in out if r.query_id == q] for q in {r.query_id for r in out}} == want
    assert all(r.rank == 1 + [x.vec_id for x in out if x.query_id == r.query_id].index(r.vec_id) for r in out)


def test_fewer_candidates_than_wanted_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []
    assert nearest(df.where("false"), df.where("false")).collect() == []


def test_ties_go_to_the_smaller_id_across_blocks(spark):
    df = frame(spark, [(i, [1.0, 1.0]) for i in range(300)])
    out = nearest(df, df.where("vec_id = 100"), k=5, block_rows=40).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 1, 2, 3, 4]


def test_recall_on_vectors_without_structure(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((12_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows)
    out = nearest(df, df.where("vec_id % 200 = 0")).collect()
    hit = 0
    for q in range(0, 12_000, 200):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -9
        hit += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (60 * 20) >= 0.9


def recall(spark, x, step=200, k=20):
    """The share of the k places that hold a row as good as the k-th best by trying all."""
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found, hit = {}, 0
    for r in nearest(df, df.where(f"vec_id % {step} = 0"), k=k).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, len(x), step):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hit += int((s[found[q]] >= np.sort(s)[-k] - 1e-9).sum())
    return hit / (len(found) * k)


def test_recall_on_vectors_of_unequal_length_and_with_a_third_equal(spark):
    draw = np.random.default_rng(6)
    x = draw.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lengths = np.exp(0.5 * draw.standard_normal((len(x), 1)))
    assert recall(spark, (x * lengths).astype(np.float32)) >= 0.95
    x[draw.permutation(len(x))[:4000]] = x[1]
    assert recall(spark, x.astype(np.float32)) >= 0.95
    assert recall(spark, (x * lengths).astype(np.float32)) >= 0.95


@pytest.mark.parametrize("n", [500, 2000])
def test_small_tables_are_searched_like_large_ones(spark, n):
    draw = np.random.default_rng(n)
    x = draw.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x.astype(np.float32), step=20) >= 0.93
    found = Bands(x, 64, 20, 11).search(x[:50], np.arange(n), np.arange(50), 20, int(0.7 * n))
    assert all(0.5 * n < len(rows) < 0.8 * n for rows, _ in found)  # through the forest, not all rows


def test_trees_climb_until_so_many_different_rows_are_found():
    x = np.random.default_rng(2).standard_normal((600, 16))
    assert all(300 <= len(rows) < 600 for rows in Forest(x, 32, 16, 3).candidates(x[:20], 300, 3))


def looked_at(x, queries, k=20):
    """The share of the rows that queries look at and of their k best that they find, in one block."""
    ids, rows, hit = np.arange(len(x)), 0, 0
    for q, (found, _) in zip(queries, Bands(x, 64, 20, 11).search(x[queries], ids, queries, k, int(0.55 * len(x)))):
        s = x @ x[q]
        s[q] = -np.inf
        rows, hit = rows + len(found), hit + len(set(found.tolist()) & set(np.argsort(-s)[:k].tolist()))
        assert q not in found and len(set(found.tolist())) == len(found)
    return rows / len(x) / len(queries), hit / k / len(queries)


def test_clustered_vectors_are_found_among_few_rows():
    draw = np.random.default_rng(4)
    x = draw.standard_normal((200, 64))[draw.integers(0, 200, 8000)] + 0.3 * draw.standard_normal((8000, 64))
    few, found = looked_at(x, draw.choice(8000, 50, replace=False))
    assert few < 0.4 and found >= 0.95
    few, found = looked_at(draw.standard_normal((8000, 64)) * np.exp(draw.standard_normal((8000, 1))), draw.choice(8000, 50, replace=False))
    assert few < 0.4 and found >= 0.95  # short rows can't be among the best


def test_very_large_and_very_small_components(spark):
    rows = [(i, [float(10.0 ** (i - 20)), float(10.0 ** (20 - i))]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    big = spark.createDataFrame([(i, [x * (1e-100 if i == 20 else 1e160) for x in v]) for i, v in rows], df.schema)
    order = lambda t: [r.vec_id for r in nearest(t, t.where("vec_id = 20"), k=5).orderBy("rank").collect()]
    assert order(df) == order(big) == [0, 1, 39, 2, 38]  # 1 and 39 tie, as do 2 and 38


def test_inner_product_is_not_cosine(spark):
    df = frame(spark, [(0, [1.0, 1.0]), (1, [1.0, 1.1]), (2, [10.0, 0.0])])
    assert nearest(df, df.where("vec_id = 0"), k=1).collect()[0].vec_id == 2


def test_forest_ranges_hold_equal_prefixes():
    x = np.random.default_rng(1).standard_normal((500, 6))
    f = Forest(x, 5, 12, 3)
    for rows in f.candidates(x[:20], 100, 3):
        assert len(rows) >= 20
    assert all(len(rows) == 500 for rows in f.candidates(x[:3], 500 * 5, 3))

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tillage.llm import dual_tree
from tillage.llm.dual_tree import Centroids, assign, cover_tree


def brute(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min((square(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = nearest()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, of) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    of = nearest()
    total = sum(d for d, _ in of)
    return sorted(repr((i, n, d, sum(e for e, m in of if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())) for (i, _), (d, n) in zip(kept, of))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.fixture
def table(spark):
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        for c in ("v", "ids", "nodes", "cluster", "distance", "n", "h"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


def some_rows(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    x = np.where(rng.random((n, 1)) < 0.5, centers[rng.integers(12, size=n)] + 0.05 * rng.normal(size=(n, dims)), rng.normal(size=(n, dims))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are equal
    return [(k, v) for k, v in enumerate(x.tolist())]


def test_matches_plain_lloyd(spark, table, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 100)
    odd = [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, []), (None, [0.5] * 8), (7, [0.25] * 8), (7, [0.125] * 8), (906, [0.0] * 8), ((1 << 60) + 1, [9.0] * 8)]
    rows = some_rows(500, 8) + odd
    assert got(dual_tree.clusters(table(rows).repartition(3), k=12, dims=8)) == brute(rows, 12, 5, 8)
    assert got(dual_tree.clusters(table(rows[:5]), k=12, dims=8)) == brute(rows[:5], 12, 5, 8)


def test_ties_go_to_the_smaller_number(spark, table):
    rows = [(k, [float(x % 3), float(x % 2)]) for k, x in enumerate(range(60))]  # equal seeds, too
    assert got(dual_tree.clusters(table(rows), k=9, dims=2)) == brute(rows, 9, 5, 2)


def test_every_kind_of_data_gives_the_nearest_and_clusters_are_pruned():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (40, 64))
    data = {
        "none": rng.integers(-300, 300, (2000, 64)),
        "clusters": np.repeat(centers, 50, 0) + rng.integers(-8, 9, (2000, 64)),
        "equal": np.repeat(centers[:1], 2000, 0),
        "line": np.arange(2000)[:, None] * np.ones((1, 64), np.int64),
        "large": rng.integers(-(1 << 27), 1 << 27, (300, 64)),
    }
    share = {}
    for name, x in data.items():
        order, nodes = cover_tree(x)
        assert sorted(order.tolist()) == list(range(len(x)))
        v = x[order]
        to = Centroids(x[rng.choice(len(x), 40)] if name != "clusters" else centers)
        label, looked = assign(v, nodes, to)
        squares = np.array([((v - c) ** 2).sum(1) for c in to.vectors]).T
        assert (label == squares.argmin(1)).all(), name
        share[name] = looked / squares.size
    assert share["clusters"] < 0.05 and share["equal"] == 0 and share["line"] < 0.5 and share["none"] <= 1


def test_tree_covers_and_separates():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (1500, 3))
    order, nodes = cover_tree(x)
    v = x[order]
    for n in nodes:
        assert (np.sqrt(((v[n["begin"] : n["end"]] - v[n["center"]]) ** 2).sum(1)) <= n["radius"]).all()
        below = nodes[n["first"] : n["first"] + n["count"]]
        if len(below):
            assert n["own"] == below["begin"][0] and (below["begin"][1:] == below["end"][:-1]).all() and below["end"][-1] == n["end"]
            reach = 2.0 ** (math.ceil(math.log2(n["radius"] / (1 + 1e-12))) - 1)
            assert (below["radius"] <= reach * 1.001).all()
            c = v[below["center"]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert (apart > reach * 0.999).all()


def test_empty_and_unusable_tables(spark, table):
    for rows in ([], [(1, None), (2, [1.0])]):
        df = dual_tree.clusters(table(rows))
        assert df.collect() == [] and dict(df.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    with pytest.raises(ValueError):
        dual_tree.clusters(table([]), k=1 << 30)

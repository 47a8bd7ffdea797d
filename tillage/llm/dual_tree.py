"""Operator 13: Lloyd's clustering with two trees, a cover tree over vectors and one over centroids, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch

#: Vectors of a block, which has a tree of its own.
BLOCK = 2048
#: A node of so many vectors is a leaf; a child of fewer than FEW becomes leaves of its parent; children of a node at most.
LEAF, FEW, NET = 24, 6, 128
#: Whole components up to this size give squared distances that fit a long.
LARGEST = 1 << 27
#: Centroids times components at most: what the driver holds and each task gets.
MOST = 1 << 22
#: A node covers the vectors begin to end; the first, up to own, are its own leaves, the others are its children's, which are numbered from first.
NODE = np.dtype([("center", "i4"), ("begin", "i4"), ("own", "i4"), ("end", "i4"), ("first", "i4"), ("count", "i4"), ("radius", "f8")])


def _squares(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    apart = vectors - to
    return np.einsum("ij,ij->i", apart, apart)


def cover_tree(vectors: np.ndarray, leaf: int = LEAF, few: int = FEW, net: int = NET) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of whole vectors, one at least: a cover tree, whose positions are those of vectors[order].

    Children of a node cover up to the power of two below its radius: its own center is the first one's, each other center is a vector
    that no earlier one covers. Vectors that `net` children don't cover, and those of children under `few`, are the node's own leaves.
    """
    nodes, order = [(0, 0, 0, len(vectors), 0, 0, 0.0)], np.empty(len(vectors), np.int64)
    todo = [(0, np.arange(len(vectors)), 0, _squares(vectors, vectors[0]))]
    while todo:
        k, rows, center, apart = todo.pop()
        begin, widest, own, children = nodes[k][1], int(apart.max()), [], []
        if len(rows) > leaf and widest:
            reach = 4.0 ** (np.ceil(np.log2(widest) / 2) - 1)
            reach = reach if reach < widest else reach / 4
            left, at, near = rows, center, apart
            for _ in range(net):
                covered = near <= reach
                (children if covered.sum() >= few else own).append((left[covered], at, near[covered]))
                left = left[~covered]
                if not len(left):
                    break
                at = left[0]
                near = _squares(vectors[left], vectors[at])
            own = np.concatenate([left, *(x[0] for x in own)])
        else:
            own = rows
        order[begin : begin + len(own)] = own
        nodes[k] = (center, begin, begin + len(own), begin + len(rows), len(nodes), len(children), float(np.sqrt(widest)) * (1 + 1e-12))
        at = begin + len(own)
        for child in children:
            todo.append((len(nodes), *child))
            nodes.append((child[1], at, 0, at + len(child[0]), 0, 0, 0.0))
            at += len(child[0])
    found = np.array(nodes, NODE)
    place = np.empty(len(vectors), np.int64)
    place[order] = np.arange(len(vectors))
    found["center"] = place[found["center"]]
    return order, found


class Centroids:
    """Whole centroids and their tree, whose leaves are single centroids (or equal ones)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order, self.nodes = cover_tree(vectors, leaf=1, few=1, net=len(vectors))
        self.center, self.radius = order[self.nodes["center"]], self.nodes["radius"]
        self.under = [np.sort(order[b:e]) for b, e in zip(self.nodes["begin"], self.nodes["end"])]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.nodes["first"][k], self.nodes["first"][k] + self.nodes["count"][k]) for k in nodes])


def assign(vectors: np.ndarray, nodes: np.ndarray, to: Centroids) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector (of several, the smallest number), and how many distances of single vectors that took.

    Pairs of nodes are visited from both roots. A centroid node goes if even its nearest possible distance from a vector node is
    above what another one reaches at most; a wider centroid node is opened before the vector node is. One centroid left: the
    whole vector node is its. Leaves are compared exactly with what is left.
    """
    label, looked = np.empty(len(vectors), np.int64), 0
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        k, others = todo.pop()
        center, begin, own, end, first, count, radius = nodes[k].item()
        while True:
            apart, wide = np.sqrt(_squares(to.vectors[to.center[others]], vectors[center])), to.radius[others]
            most = (apart + radius).min()
            others = others[apart - radius - wide - most <= 1e-9 * (apart + radius + wide + most)]
            open_ = to.radius[others] > radius
            if not open_.any():
                break
            others = np.concatenate([others[~open_], to.children(others[open_])])
        if len(others) == 1 and not to.radius[others[0]]:
            label[begin:end] = to.under[others[0]][0]
            continue
        if own > begin:
            numbers = np.sort(np.concatenate([to.under[x] for x in others]))
            some = to.vectors[numbers]
            squares = (some * some).sum(1) - 2 * (vectors[begin:own] @ some.T)  # what the vector adds is the same for all
            label[begin:own] = numbers[squares.argmin(1)]
            looked += squares.size
        todo.extend((x, others) for x in range(first, first + count))
    return label, looked


_BLOCKS = pa.schema([(c, pa.binary()) for c in ("ids", "named", "vectors", "nodes")])


def _blocks(kept: DataFrame, dims: int) -> DataFrame:
    """Rows of at most BLOCK vectors with their cover tree; whichever vectors a task reads one after the other."""

    def one(ids: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(vectors).astype(np.int64)
        order, nodes = cover_tree(rows)
        named = pa.chunked_array(ids).combine_chunks()
        number = named.fill_null(0).to_numpy(zero_copy_only=False)[order]
        there = named.is_valid().to_numpy(zero_copy_only=False)[order]
        return pa.RecordBatch.from_pylist([{"ids": number.tobytes(), "named": there.tobytes(), "vectors": rows[order].astype(np.int32).tobytes(), "nodes": nodes.tobytes()}], _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            rows = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for lo in range(0, len(rows), BLOCK):
                part, at = rows[lo : lo + BLOCK], lo
                while len(part):
                    some = part[: BLOCK - held]
                    ids.append(batch["vec_id"].slice(at, len(some)))
                    vectors.append(some)
                    part, at, held = part[len(some) :], at + len(some), held + len(some)
                    if held == BLOCK:
                        yield one(ids, vectors)
                        ids, vectors, held = [], [], 0
        if held:
            yield one(ids, vectors)

    return kept.mapInArrow(run, "ids binary, named binary, vectors binary, nodes binary")


def _opened(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, named, vectors, nodes in zip(*(batch[c].to_pylist() for c in ("ids", "named", "vectors", "nodes"))):
            yield np.frombuffer(ids, np.int64), np.frombuffer(named, bool), np.frombuffer(vectors, np.int32).reshape(-1, dims).astype(np.int64), np.frombuffer(nodes, NODE)


def _moved(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after a round: of each task come the sums and counts of its vectors by centroid, no more."""
    to = Centroids(np.array(centroids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for _, _, vectors, nodes in _opened(batches, dims):
            label, _ = assign(vectors, nodes, to)
            order = np.argsort(label, kind="stable")
            found, at = np.unique(label[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order], at, axis=0)
            counts += np.bincount(label, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("dim", "x"))
    moved = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect():  # a row a centroid and component
        moved[r.cluster][r.dim] = int(r.x) // r.n
    return moved


def whole(x: str) -> str:
    """SQL of a component as a whole number."""
    return f"CAST(floor(CAST(256 AS DOUBLE) * CAST({x} AS DOUBLE)) AS BIGINT)"


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2:") -> DataFrame:
    """k-means of embeddings(vec_id, embedding) in whole numbers: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly `dims` finite components take part; a component x becomes floor(256 * x). The first centroids are the k vectors
    with the smallest hex sha256 of seed and vec_id, in that order. Each round assigns every vector to the nearest centroid (squared
    Euclidean distance; of equal ones the smaller number), and puts every centroid that has vectors at their mean, rounded down by component; then
    vectors are assigned once more, which gives cluster and distance. Inertias are sums of distances; centroid_sha256 is of the
    final centroid's components, joined by commas.

    Each input task makes blocks of 2048 vectors, each with a cover tree, written once. A round makes a tree over the centroids, which every task gets (k * dims is
    bounded), and visits pairs of nodes (see assign); a task returns sums and counts by centroid. No vector is shuffled.

    Defined cases: null vectors, other lengths, null, NaN and infinite components take no part, nor do vectors with a component beyond 2^19 in size, whose
    distances a long could not hold; fewer than k vectors make as many centroids; rows that repeat a vec_id are vectors of their own, and
    of equal hashes the smaller vector comes first; a null vec_id is hashed as an empty string; extra columns are ignored; an empty table gives no rows.
    """
    if k < 1 or k * dims > MOST:
        raise ValueError(f"k * dims is 1 to {MOST}")
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "dual-tree")
    inside = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST // 256))
    kept = embeddings.where(F.coalesce((F.size("embedding") == dims) & inside, F.lit(False)))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> {whole('x')})").alias("v"))
    blocks = scratch.save(_blocks(kept, dims), "blocks")
    by_hash = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [r.v for r in kept.select(by_hash.alias("h"), "v").orderBy("h", "v").limit(k).collect()]  # k rows
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, dims)
    to = Centroids(np.array(centroids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, named, vectors, nodes in _opened(batches, dims):
            label, _ = assign(vectors, nodes, to)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64(), mask=~named), "cluster": pa.array(label, pa.int32()), "distance": pa.array(_squares(vectors, to.vectors[label]), pa.int64())})

    placed = scratch.save(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    scratch.drop("blocks")
    found = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row a centroid
    total = sum(int(r.d) for r in found)
    rows = [(r.cluster, int(r.d), total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in found]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def oracle(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL of the query's rows: every vector against every centroid, round by round."""
    nearest = "SELECT r, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, min(d) AS d FROM (SELECT v.r, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{0} k USING (j) GROUP BY v.r, k.c) GROUP BY r"
    parts = [
        "l AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256::DOUBLE * x::DOUBLE) AS BIGINT)) AS w"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > 524288)) = 0)",
        "v AS MATERIALIZED (SELECT r, j, w[j] AS x FROM l, range(1, 65) t(j))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), w) - 1 AS c FROM l QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, j, CAST(x AS HUGEINT) AS x FROM s JOIN v USING (r))",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(n)})")
        mean = "SELECT c, j, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.c, v.j, sum(v.x) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{0} a JOIN v USING (r) GROUP BY a.c, v.j)"
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN ({mean.format(n)}) m USING (c, j))")
    parts.append(f"f AS MATERIALIZED ({nearest.format(rounds)})")
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM f JOIN l USING (r) JOIN h USING (c)"""

"""Operator 3: approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "query_id long, vec_id long, score double"


def usable(embedding: str = "embedding") -> Column:
    """Vectors that take part: not null, without null or non-finite components, not all zero."""
    v = F.col(embedding)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of hash strings, one a tree; a string is the signs of a vector's products with random directions.

    For inner products, vectors get one more component that makes their lengths equal; a query's is 0.
    """

    START = 256

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
        self.n, self.bits, self.trees = len(vectors), bits, trees
        self.planes = np.random.default_rng(seed).standard_normal((trees, lifted.shape[1], bits))
        self.place = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        codes = [self._codes(lifted, p) for p in self.planes]
        self.order = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order)]

    def _codes(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return (x @ planes > 0) @ self.place

    def _ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, in each tree's array, of the strings that share so many first bits: level x query x tree."""
        begin = np.empty((self.bits + 1, len(codes), self.trees), np.int32)
        end = np.empty_like(begin)
        for t, tree in enumerate(self.sorted):
            for level in range(self.bits + 1):
                rest = self.bits - level
                low = (codes[:, t] >> rest) << rest
                begin[level, :, t], end[level, :, t] = np.searchsorted(tree, low), np.searchsorted(tree, low + (1 << rest))
        return begin, end

    def climbs(self, queries: np.ndarray, matches: int, least: int) -> Iterator[Iterator[np.ndarray]]:
        """For each query, the rows that its climb finds, level by level, each row once.

        Its trees start together at the longest prefixes that give START rows, and climb two levels at a time, tree after tree, until their ranges
        hold `matches` different rows; a range holds all rows of its prefix, so equal vectors come together. Under `least` different rows: all rows.
        """
        if matches >= self.n:
            yield from (iter([np.arange(self.n)]) for _ in queries)
            return
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        begin, end = self._ranges(np.column_stack([self._codes(lifted, p) for p in self.planes]))
        for q in range(len(queries)):
            yield self._climb(begin[:, q], end[:, q], matches, least)

    def _climb(self, begin: np.ndarray, end: np.ndarray, matches: int, least: int) -> Iterator[np.ndarray]:
        level = np.flatnonzero((end - begin).sum(1, dtype=np.int64) >= min(self.START, self.n))[-1]
        mark, seen = np.zeros(self.n, bool), 0
        while level >= 0 and seen < matches:
            before, sizes = mark.copy(), end[level] - begin[level]
            spans = [order[lo:hi] for order, lo, hi in zip(self.order, begin[level].tolist(), end[level].tolist())]
            whole = int(np.searchsorted(np.cumsum(sizes), matches - seen))  # so many ranges can't hold too many rows
            if whole:
                mark[np.concatenate(spans[:whole])] = True
            seen = np.count_nonzero(mark)
            for span in spans[whole:]:
                if seen >= matches:
                    break
                mark[span] = True
                seen = np.count_nonzero(mark)
            yield np.flatnonzero(mark & ~before)
            level -= 2 if level > 2 else 1
        if seen < least:
            yield np.flatnonzero(~mark)

    def candidates(self, queries: np.ndarray, matches: int, least: int) -> list[np.ndarray]:
        """Rows for each query: all that a climb to `matches` rows finds."""
        return [np.sort(np.concatenate(list(climb))) for climb in self.climbs(queries, matches, least)]


class Bands:
    """Forests of rows of similar length: a band's lengths differ by a factor of RATIO at most, or it has LEAST rows.

    The component that makes lengths equal is so a small one in each band, and short rows can't take the place of long ones.
    """

    RATIO, LEAST = 1.15, 256

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        order = np.argsort(-length, kind="stable")
        length = length[order]
        self.rows, self.length, at = [], [], 0
        while at < len(order):
            top = length[at]
            to = max(at + self.LEAST, int(np.searchsorted(-length, -top / self.RATIO, "right")))
            to = len(order) if len(order) - to < self.LEAST else to
            self.rows.append(np.sort(order[at:to]))
            self.length.append(top)
            at = to
        self.forests = [Forest(vectors[r], trees, bits, seed) for r in self.rows]
        self.small = vectors.astype(np.float32)

    def shares(self, matches: int) -> list[int]:
        """How many rows of each band: in all `matches`; a band's share grows with its length, up to all of its rows."""
        sizes = np.array([len(r) for r in self.rows])
        weight = sizes * np.array(self.length)
        take, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
        while open_.any():
            take[open_] = max(0, matches - take[~open_].sum()) * weight[open_] / max(weight[open_].sum(), 1e-300)
            full = open_ & (take >= sizes)
            if not full.any():
                break
            take[full], open_ = sizes[full], open_ & ~full
        return np.ceil(take).astype(int).tolist()

    def search(self, queries: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, matches: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the rows found and their inner products in single precision; rows of the query's own id are left out.

        Bands come by length downward. A band is passed over if even its longest row, in the query's direction, would not be among the k best
        so far. In a band the climb ends with its share of `matches`, or once as many rows as had brought the k best, 4 k at least, are followed by none that
        changes them.
        """
        reach = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        slack = 1e-4 * self.length[0] * reach
        best = np.full((len(queries), k), -np.inf)
        found = [[(np.empty(0, int), np.empty(0, np.float32))] for _ in queries]
        for forest, rows, top, share in zip(self.forests, self.rows, self.length, self.shares(matches)):
            open_ = np.flatnonzero(best.min(1) <= top * reach + slack)
            for i, climb in zip(open_, forest.climbs(queries[open_], share, k + 1)):
                asks, seen, idle = queries[i].astype(np.float32), 0, 0
                for new in climb:
                    new = rows[new]
                    new = new[ids[new] != asked[i]]
                    rough = self.small[new] @ asks
                    found[i].append((new, rough))
                    better = rough[rough > best[i].min()]
                    if len(better):
                        best[i] = np.sort(np.concatenate([best[i], better]))[-k:]
                        seen, idle = seen + idle + len(new), 0
                        continue
                    idle += len(new)
                    if idle >= max(seen, 4 * k) and np.isfinite(best[i].min()):
                        break
        return [tuple(np.concatenate(part) for part in zip(*parts)) for parts in found]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 64, bits: int = 20, share: float = 0.7, block_rows: int = 8192, query_rows: int = 4096, seed: int = 11) -> DataFrame:
    """The k rows of vectors(vec_id, embedding) with the largest inner product to each of queries(vec_id, embedding).

    Vectors are dealt by a hash into blocks of about block_rows, each with its own forests over all its rows, one for rows of similar length; queries in groups of
    query_rows meet every block, climb its trees until doubling the rows brings none of the k best any more, share times the block's rows at most (but START or 4 k rows, where that is more), all different, most of them among the long ones (see Bands), and keep the k best of the rows found; then the k best of all
    blocks stay. Returned: query_id, rank from 1, vec_id, score (in double precision on the original vectors), ties to the smaller vec_id. Vectors
    without structure in 64 dimensions, where the nearest are hardly nearer than others, are climbed to that share of a block, for a recall
    of 0.95 in 500 rows and more in larger blocks, whatever the table's size; clustered ones to a small part.

    Defined cases: vectors null, zero, or holding null or non-finite components take no part on either side, nor do null vec_ids; only
    vectors of the query's length are compared; a query's own vec_id is no candidate; rows that repeat a vec_id with other vectors are
    each candidates; exact repeats count once; fewer than k candidates: all; empty tables: no rows; extra columns are ignored.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    clean = lambda df: df.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v"), F.size("embedding").alias("dim")).distinct()
    data, asked = clean(vectors), clean(queries)
    blocks = max(1, -(-vectors.count() // block_rows))
    groups = max(1, -(-queries.count() // query_rows))
    data = data.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("grp", F.expr(f"cast(pmod(xxhash64(vec_id, 1), {groups}) as int)")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        ids, asks = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        # Searched in units of the largest component, so that no square overflows.
        unit = np.abs(x).max()
        forest, asking, out = Bands(x / unit, trees, bits, seed), q / np.abs(q).max(axis=1, keepdims=True), []
        for lo in range(0, len(q), 256):
            part = slice(lo, lo + 256)
            for i, (rows, rough) in enumerate(forest.search(asking[part], ids, asks[part], k, max(int(share * len(x)), Forest.START, 4 * k)), lo):
                take = min(k, len(rows))
                if not take:
                    continue
                edge = np.partition(rough, len(rough) - take)[len(rough) - take]
                near = rows[rough >= edge - 1e-4 * forest.length[0] * np.sqrt(asking[i] @ asking[i])]
                exact = (x[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:take]
                out.append((np.full(len(best), asks[i]), ids[near][best], exact[best]))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    found = data.groupBy("dim", "block", "grp").cogroup(asked.groupBy("dim", "block", "grp")).applyInPandas(meet, PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

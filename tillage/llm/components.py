"""Connected components by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch, split_join


def _jump(parents: DataFrame) -> DataFrame:
    """Each parent replaced by its own parent, where it has one."""
    up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
    return split_join(parents, up, "parent", "id").select("id", F.coalesce("above", "parent").alias("parent"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for each id in edges(a, b); component is the smallest id reachable.

    Each round, every vertex points to its smallest neighbour (or itself), pointers are doubled twice,
    and the edges are redrawn between what they point to; rounds grow with the logarithm of the diameter.
    A star's hub is one partly aggregated group, and joins on it are split. No edges: no rows. Null ends are dropped.
    """
    left = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    left, known, k = scratch.save(left, f"{name}-edges-0"), None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("parent"))
        parents = scratch.save(parents, f"{name}-low-{k}")
        for j in range(2):
            parents = scratch.save(_jump(parents), f"{name}-parents-{k}-{j}")
        if known is None:
            known = parents.withColumnRenamed("parent", "component")
        else:
            step = parents.select(F.col("id").alias("component"), "parent")
            known = split_join(known, step, "component", "id").select("id", F.coalesce("parent", "component").alias("component"))
        known = scratch.save(known, f"{name}-known-{k}")
        to_x = scratch.save(split_join(left, parents.toDF("a", "x"), "a", "b").select("x", "b"), f"{name}-half-{k}")
        drawn = split_join(to_x, parents.toDF("b", "y"), "b", "x").where("x <> y")
        left = scratch.save(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges-{k + 1}")
        scratch.drop(*(f"{name}-{n}" for n in (f"edges-{k}", f"low-{k}", f"parents-{k}-0", f"parents-{k}-1", f"half-{k}")), *([f"{name}-known-{k - 1}"] if k else []))
        k += 1
    return known if known is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))

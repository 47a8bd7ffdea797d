"""Keys found by code, name, alias or likeness, and layers of values merged by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.operators.grams import names_inside


def two_step(rows: DataFrame, first: DataFrame, second: DataFrame, first_on: Column, second_on: Column, out: str = "iso3") -> DataFrame:
    """rows with a key that the first lookup gives, or else the second; rows that neither knows go.

    first and second: (lookup, key), one row a lookup; a null key there says that the lookup is to be skipped.
    """
    a, b = first.toDF("first__", "a__"), second.toDF("second__", "b__")
    found = rows.join(a, first_on == F.col("first__"), "left").join(b, second_on == F.col("second__"), "left")
    return found.withColumn(out, F.coalesce("a__", "b__")).where(F.col(out).isNotNull()).drop("first__", "a__", "second__", "b__")


def by_priority(candidates: DataFrame, keys: list[str], priority: str, take: list[str]) -> DataFrame:
    """Of each key's candidates the one of the smallest priority number; of equal numbers the greatest take."""
    best = F.max_by(F.struct(*take), F.struct(-F.col(priority), *(F.col(c) for c in take))).alias("best__")
    return candidates.groupBy(*keys).agg(best).select(*keys, "best__.*")


def overlay(layers: list[tuple[str, DataFrame]], keys: list[str], value: str, superseded: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """keys, value, layer: the last layer that has a key's field wins.

    layers: (name, rows with keys and value), lowest first; the first layer says which key[0] values exist at all.
    superseded: layer -> layers that take its place: its rows go where one of those has the same keys, even if a later layer
    doesn't (so an old override never hides a sourced value). One grouping by key; no chain of joins.
    """
    ranks = {name: k for k, (name, _) in enumerate(layers)}
    stacked = None
    for name, rows in layers:
        part = rows.select(*keys, value, F.lit(ranks[name]).alias("rank__"), F.lit(name).alias("layer"))
        stacked = part if stacked is None else stacked.unionByName(part)
    ordered = F.col("rank__")
    for name, others in (superseded or {}).items():  # a superseded layer comes below the ones that take its place
        lowest = min(ranks[o] for o in others)
        if ranks[name] > lowest:
            ordered = F.when(F.col("layer") == name, F.lit(lowest) - 0.5).otherwise(ordered)
    known = layers[0][1].select(keys[0]).distinct()
    best = F.max_by(F.struct(value, "layer"), F.struct("order__", value)).alias("best__")
    return stacked.withColumn("order__", ordered).join(known, keys[0], "left_semi").groupBy(*keys).agg(best).select(*keys, "best__.*")


def closest_name(needles: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """needle, how, name, key of the best match of each needle, in lower case and trimmed: the same name, an alias of a name, or a name that holds it or that it holds.

    needles(needle), names(name, key, ord), aliases(alias, name). Of equal matches the smallest ord wins. An empty needle matches
    nothing. The third kind comes from an index of grams, either way (see names_inside), so a long text costs its length.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    asked = needles.select("needle", low("needle").alias("s")).where("s <> ''").distinct()
    known = names.select(low("name").alias("n"), "key", "ord").where("n <> ''")
    exact = asked.join(known, F.col("s") == F.col("n")).select("needle", F.lit(1).alias("class"), "ord", "n", "key")
    other = aliases.select(low("alias").alias("a"), low("name").alias("n"))
    alias = asked.join(other, F.col("s") == F.col("a")).join(known, "n").select("needle", F.lit(2).alias("class"), "ord", "n", "key")
    texts = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()
    held = names_inside(texts(asked, "s"), known.select(F.col("n").alias("name"))).toDF("s", "n").join(asked, "s").join(known, "n")
    holds = names_inside(texts(known, "n"), asked.select(F.col("s").alias("name"))).toDF("n", "s").join(asked, "s").join(known, "n")
    part = held.select("needle", "ord", "n", "key").union(holds.select("needle", "ord", "n", "key")).select("needle", F.lit(3).alias("class"), "ord", "n", "key")
    best = F.min_by(F.struct("class", "n", "key"), F.struct("class", "ord")).alias("best")
    found = exact.union(alias).union(part).groupBy("needle").agg(best)
    how = F.element_at(F.array(F.lit("exact"), F.lit("alias"), F.lit("partial")), F.col("best.class"))
    return found.select("needle", how.alias("how"), F.col("best.n").alias("name"), F.col("best.key").alias("key"))


def cube_cells(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """cells(pos, value) of a cube flattened row by row, with the labels of rows(row, row_pos) and columns(col, col_pos).

    A cell's place says its row and column, so both come by equi-joins; labels without a cell give nothing.
    """
    width = columns.agg(F.max(F.col("col_pos") + 1).alias("width__"))
    placed = cells.crossJoin(F.broadcast(width)).withColumn("row_pos", F.expr("pos div width__")).withColumn("col_pos", F.expr("pos % width__"))  # one row
    return placed.join(rows, "row_pos").join(columns, "col_pos").select("row", "col", "value")

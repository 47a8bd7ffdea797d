"""Between wide, long and nested forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_columns(df: DataFrame, pattern: str = r"(\d{4})") -> dict[int, str]:
    """Columns named by a year, from the header: year -> name."""
    import re

    found = {c: re.fullmatch(pattern, c.strip()) for c in df.columns}
    return {int(m[1]): c for c, m in found.items() if m}


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each key and column; nulls are kept."""
    return df.unpivot(keys, columns, name, value)


def to_wide(df: DataFrame, keys: list[str], name: str, names: list[str], value: Column) -> DataFrame:
    """A column for each listed name, by one pass of conditional aggregates."""
    return df.groupBy(*keys).pivot(name, names).agg(value)


def in_order(order: Column, *fields: Column | str) -> Column:
    """An aggregate: the group's fields as an array of structs in that order."""
    kept = F.array_sort(F.collect_list(F.struct(order.alias("o__"), F.struct(*fields).alias("v__"))))
    return F.transform(kept, lambda e: e["v__"])


def keyed(key: Column, value: Column) -> Column:
    """An aggregate: the group's rows as a map."""
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def zipped(names: Column, weights: Column, default: float) -> Column:
    """Two parallel arrays as one of (pos, name, weight); a missing or zero weight is the default. The first array's length counts."""
    def one(name: Column, k: Column) -> Column:
        return F.struct((k + 1).alias("pos"), name.alias("name"), F.coalesce(F.nullif(F.get(weights, k), F.lit(0.0)), F.lit(default)).alias("weight"))

    return F.transform(names, one)


def weighted(values: Column, weights: list[float]) -> Column:
    """The sum of values by weights, in order; a missing value counts 0."""
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        out = out + F.coalesce(F.get(values, F.lit(k)), F.lit(0.0)) * F.lit(w)
    return out


def mean_of(values: Column) -> Column:
    """The mean of an array's known elements; null if there are none."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))

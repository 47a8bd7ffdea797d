"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (spark, folder of the tables) -> rows.
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Query]:
    """Registers a function of the tables as the query of its name, with DuckDB SQL of the same rows where SQL can say it."""

    def add(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return add


class Tables:
    """The parquet tables of a folder, read when they are asked for: tables.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def literal(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small table of constants."""
        return self.spark.createDataFrame(rows, schema)


def rounded(x: str, places: int = 0) -> str:
    """SQL of functions.numeric.round_half_up."""
    return f"(floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE)"


def summed(x: str) -> str:
    """SQL of functions.numeric.money."""
    return f"CAST(sum(CAST({x} AS DECIMAL(12,2))) AS DOUBLE)"


def exactly(x: str) -> str:
    """SQL of a sum at four decimals."""
    return f"CAST(sum(CAST({x} AS DECIMAL(20,4))) AS DOUBLE)"

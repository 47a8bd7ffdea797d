"""Paged services and archives as data sources: Spark plans their pages or members as partitions, and tasks read them."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tillage.sources.landing import attempts


def planned(spark: SparkSession, schema: str, parts: Callable[[], list], read: Callable[[object], Iterator[tuple]]) -> DataFrame:
    """Rows of so many parts, each read by a task of its own: parts() is asked once, on the driver, when the table is read; read(part) runs in the tasks."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition((p,)) for p in parts()] or [InputPartition(())]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for p in partition.value:
                yield from read(p)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    label = f"planned_{uuid.uuid4().hex}"
    spark.dataSource.register(Source)
    return spark.read.format(label).load()


def _page(get: Callable[[], list], tries: int, backoff: float, strict: bool) -> Iterator[tuple]:
    try:
        yield from attempts(get, tries, backoff)
    except OSError:
        if strict:
            raise


def offset_rows(spark: SparkSession, get: Callable[[int, int], list[tuple]], total: Callable[[], int], schema: str, size: int = 1000, tries: int = 3, backoff: float = 2.0, strict: bool = False) -> DataFrame:
    """Rows of a service that gives pages by offset: get(offset, size) for each offset up to total(), which is asked for first; a page is a task.

    A page is tried again after growing waits (see attempts); one that fails for good is passed over, or, if `strict`, fails the read.
    """
    return planned(spark, schema, lambda: list(range(0, attempts(total, tries, backoff), size)), lambda offset: _page(lambda: get(offset, size), tries, backoff, strict))


def numbered_rows(spark: SparkSession, get: Callable[[int], list[tuple]], schema: str, most: int, tries: int = 3, backoff: float = 2.0, strict: bool = False) -> DataFrame:
    """Rows of a service that gives pages 1, 2, ... up to `most`, each a task; pages beyond the last one are empty. Failures are as in offset_rows."""
    return planned(spark, schema, lambda: list(range(1, most + 1)), lambda k: _page(lambda: get(k), tries, backoff, strict))


def member_lines(spark: SparkSession, path: str, wanted: str = r"\.csv$", encoding: str = "utf-8") -> DataFrame:
    """archive, member, line, value: the lines of every member whose name fits, of a ZIP file or of each in a folder that driver and executors can open by that path.

    The driver reads the archives' directories; each member is a task, which seeks to it and reads it line by line, so no archive is held and the members of one are read side by side.
    Archives in a store that only Spark's readers reach are landed by land_zip. What is missing gives no rows.
    """

    def members() -> list[tuple[str, str]]:
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".zip")) if os.path.isdir(path) else [path] if os.path.exists(path) else []
        return [(f, n) for f in files for n in zipfile.ZipFile(f).namelist() if re.search(wanted, n)]

    def read(part: tuple[str, str]) -> Iterator[tuple]:
        with zipfile.ZipFile(part[0]) as z, z.open(part[1]) as member:
            for k, line in enumerate(io.TextIOWrapper(member, encoding=encoding, errors="replace", newline="")):
                yield *part, k, line.rstrip("\r\n")

    return planned(spark, "archive string, member string, line long, value string", members, read)

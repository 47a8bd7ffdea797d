"""A keyed table that batches are merged into, by buckets of keys: a batch rewrites the buckets that it touches and no others.

Under the table's folder, data/ has a folder of bucket folders for each batch that was merged, and versions/ a small file for each version, which says where the rows
of each bucket are and how many there are. A version counts once its file is there under its own name; readers take the newest, or hold an older one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.latest import latest

#: Keys whose hash has the same remainder share a bucket; the remainder is part of the layout.
BUCKET = "bucket__"


class KeyedTable:
    """keys: what names a row; order: of a key's rows the greatest stays; versions: so many stay for readers that hold one.

    Choose `buckets` so that one bucket's rows are a file of a good size; each version's file lists them, so they are bounded by that. A key is in one bucket for good.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], schema: str, buckets: int = 64, versions: int = 2):
        self.spark, self.root, self.keys, self.order, self.schema, self.buckets, self.versions = spark, root.rstrip("/"), keys, order, schema, buckets, versions
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        """The versions that count, oldest first."""
        fs, p = self._fs(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _places(self, number: int | None) -> dict[int, tuple[str, int]]:
        """Where the rows of each bucket are in a version, and how many."""
        return {} if number is None else {int(b): (place, n) for b, (place, n) in self._version(number)["buckets"].items()}

    def _version(self, number: int) -> dict:
        fs, p = self._fs(f"{self.root}/versions/v{number:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, base: int | None, places: dict[int, tuple[str, int]]) -> None:
        fs, new = self._fs(f"{self.root}/versions/_v{number:09d}-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(json.dumps({"base": base, "buckets": {b: list(x) for b, x in sorted(places.items())}}).encode())
        out.close()
        target = self._fs(f"{self.root}/versions/v{number:09d}.json")[1]
        if fs.exists(target):  # the same batch again: it names the same rows
            fs.delete(target, False)
        if not fs.rename(new, target):
            raise OSError(f"can't put version {number} in its place")

    def _read(self, places: dict[int, tuple[str, int]]) -> DataFrame:
        paths = [f"{self.root}/{place}" for place, _ in places.values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest; none before the first."""
        held = self.numbers()
        return self._read(self._places(number if number is not None else held[-1] if held else None))

    def rows(self) -> int:
        """How many rows the newest version has; no data is read."""
        held = self.numbers()
        return sum(n for _, n in self._places(held[-1] if held else None).values())

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame, number: int) -> dict[int, tuple[str, int]]:
        """Rows with their bucket, a task a bucket, written to a place of their own; a bucket that gets none is left out."""
        place = f"data/v{number:09d}-{uuid.uuid4().hex[:12]}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.root}/{place}")
        counts = self.spark.read.parquet(f"{self.root}/{place}").groupBy(BUCKET).count().collect()  # from files' footers; a row a bucket
        return {r[BUCKET]: (f"{place}/{BUCKET}={r[BUCKET]}", r["count"]) for r in counts}

    def _dealt(self, rows: DataFrame, touched: int) -> DataFrame:
        return rows.repartition(max(1, min(touched, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), BUCKET)

    def _best(self, rows: DataFrame) -> DataFrame:
        take = [c for c in self.columns if c not in self.keys]
        return latest(rows, [BUCKET, *self.keys], [F.col(o) for o in self.order], take).select(*self.columns, BUCKET)

    def merge(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function: of each key the greatest row of the table and the batch stays.

        Read and written are the buckets of the batch's keys. The base is the newest version below the batch's own number, so a batch that runs again after a failure makes
        the same version again, whatever it had left behind. An empty batch makes a version with its base's places.
        """
        at = self._base(number)
        base, fresh = self._places(at), self._bucket(batch.select(self.columns))
        touched = {r[0] for r in fresh.select(BUCKET).distinct().collect()}  # numbers of buckets
        if touched:
            before = self._bucket(self._read({b: x for b, x in base.items() if b in touched}))
            base |= self._written(self._best(self._dealt(before.unionByName(fresh), len(touched))), number)
        self._commit(number, at, base)
        self._vacuum()

    def replace(self, batch: DataFrame, number: int, least: int = 5) -> bool:
        """Takes a batch as the whole table, unless it has fewer than `least` rows and the table more than it; says whether it did.

        A batch that is refused still makes a version, with its base's places, so that readers and later batches find one of every number.
        """
        at = self._base(number)
        base = self._places(at)
        found = self._written(self._best(self._dealt(self._bucket(batch.select(self.columns)), self.buckets)), number)
        n, had = sum(x for _, x in found.values()), sum(x for _, x in base.values())
        kept = n >= least or had <= n
        self._commit(number, at, found if kept else base)
        self._vacuum()
        return kept

    def _base(self, number: int) -> int | None:
        """The version below a number; an error if there was one that is gone, as what it held would be lost."""
        held = self.numbers()
        below = max((n for n in held if n < number), default=None)
        if below is None and held and (self._version(number)["base"] is not None if number in held else True):
            raise ValueError(f"the version below {number} is gone: keep more versions")
        return below

    def _vacuum(self) -> None:
        """Takes away versions beyond the newest ones, and data that none of these names."""
        held = self.numbers()
        stay, go = held[-self.versions :], held[: -self.versions]
        if not go:
            return
        fs, data = self._fs(f"{self.root}/data")
        named = {place for n in stay for place, _ in self._places(n).values()}
        for n in go:
            fs.delete(self._fs(f"{self.root}/versions/v{n:09d}.json")[1], False)
        for batch in fs.listStatus(data):
            at = f"data/{batch.getPath().getName()}"
            buckets = [b.getPath() for b in fs.listStatus(batch.getPath()) if b.isDirectory() and b.getPath().getName().startswith(BUCKET)]
            gone = [b for b in buckets if f"{at}/{b.getName()}" not in named]
            for b in [batch.getPath()] if len(gone) == len(buckets) else gone:
                fs.delete(b, True)


def upserts(root: str, keys: list[str], order: list[str], schema: str, buckets: int = 64, versions: int = 2) -> Callable[[DataFrame, int], None]:
    """merge() of a table, for foreachBatch."""
    return lambda batch, number: KeyedTable(batch.sparkSession, root, keys, order, schema, buckets, versions).merge(batch, number)


def snapshots(root: str, keys: list[str], order: list[str], schema: str, least: int = 5, buckets: int = 64, versions: int = 2) -> Callable[[DataFrame, int], None]:
    """replace() of a table, for foreachBatch."""

    def put(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, root, keys, order, schema, buckets, versions).replace(batch, number, least)

    return put

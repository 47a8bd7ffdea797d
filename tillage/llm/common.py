"""Shared folders and text rules of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, wherever a docstring speaks of words.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tillage-')}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one operator call under the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = hadoop_path(self.spark, self.path(name))
            fs.delete(p, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many _ behind it as it takes to be none of the taken ones."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name in held:
            name += "_"
        out.append(name)
    return out


#: Rows of one key that stay together in split_join at least, and keys that may have more than their share of rows, at most.
TOGETHER, HOT_KEYS = 1024, 100_000


def hot_limit(rows: int) -> int:
    """How many of so many rows one key may hold before it is dealt to several tasks; at most HOT_KEYS keys can hold more."""
    return max(TOGETHER, -(-rows // HOT_KEYS))


def cells(count: Column, limit: int) -> Column:
    """The cells, from 0, that the rows of a key of that count are dealt to."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(count / limit).cast("int") - 1, F.lit(0)))


class Split:
    """Joins of a table with one that has a row a key at most, where a third of the table's rows may have one key.

    Keys that hold more than hot_limit of the rows are dealt to several tasks by a hash of `by`, and the other table's row goes to
    each; which keys these are is broadcast, HOT_KEYS rows at most by the limit. Null keys, which match nothing, are dealt out too.
    The table is counted and grouped, so it should be a saved one.
    """

    def __init__(self, table: DataFrame, key: str, by: str):
        self.key, self.by, self.cell, rows = key, by, f"cell_{key}__", table.count()
        self.limit, self.hot = hot_limit(rows), None
        if rows > TOGETHER:  # else no key can be above the limit
            self.hot = F.broadcast(table.groupBy(key).agg(F.count("*").alias("held__")).where((F.col("held__") > self.limit) & F.col(key).isNotNull()))

    def _held(self, df: DataFrame) -> DataFrame:
        return df.withColumn("held__", F.lit(0)) if self.hot is None else df.join(self.hot, self.key, "left")

    def deal(self, df: DataFrame) -> DataFrame:
        """Rows of the table (with other columns as one likes), with their cell."""
        own = F.expr(f"pmod(xxhash64(`{self.by}`), if(`{self.key}` is null, 1000003, greatest(1, ceil(coalesce(held__, 0) / {self.limit}))))").cast("int")
        return self._held(df).withColumn(self.cell, own).drop("held__")

    def copy(self, one: DataFrame) -> DataFrame:
        """Rows of the other table, one for each cell of their key."""
        return self._held(one).withColumn(self.cell, F.explode(cells(F.coalesce("held__", F.lit(0)), self.limit))).drop("held__")

    @property
    def on(self) -> list[str]:
        return [self.key, self.cell]


def split_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """many.join(one, key, "left"), split (see Split)."""
    s = Split(many, key, by)
    return s.deal(many).join(s.copy(one), s.on, "left").drop(s.cell)


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows, `each` a task, but the session's shuffle partitions at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))

"""Places in a whole order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillage.session import work_folder

#: monotonically_increasing_id() is the partition shifted by so many bits, and the row's place in it.
_BITS = 33


def numbered(rows: DataFrame, order: list[Column], place: str = "ord", within: list[str] | None = None) -> DataFrame:
    """rows with their place, from 1, in an order; within: in the order of their group, which must be what the order begins with.

    Rows are sorted by ranges, a task a range, and written once; how many each task has says where the next one begins, so no window stands over
    all rows, nor over a group's. Rows that the order doesn't tell apart are numbered one after the other, whichever comes first.
    """
    spark, at = rows.sparkSession, F.monotonically_increasing_id()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = work_folder(spark, "numbered")
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at__", at).write.parquet(folder)
    placed = spark.read.schema(StructType([*rows.schema.fields, StructField("at__", LongType())])).parquet(folder).withColumn("part__", F.shiftright("at__", _BITS))
    before, starts = 0, []
    for r in placed.groupBy("part__").count().sort("part__").collect():  # a row a task
        starts.append((r["part__"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "part__ long, before__ long")
    number = F.col("before__") + (F.col("at__") - F.shiftleft("part__", _BITS)) + 1
    out = placed.join(F.broadcast(starts), "part__").withColumn(place, number).drop("part__", "at__", "before__")  # a row a task
    if within is None:
        return out
    firsts = out.groupBy(*within).agg(F.min(place).alias("first__"))
    return out.join(firsts, within).withColumn(place, F.col(place) - F.col("first__") + 1).drop("first__")

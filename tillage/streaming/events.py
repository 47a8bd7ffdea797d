"""Events as a stream: daily counts with late data, and scores over windows that slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tillage.functions.numeric import clamp, money, round_half_up

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Events of the Parquet files that land in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)


def table_stream(spark: SparkSession, folder: str, table: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table of a folder of tables, one file or a folder of files, as a stream of its files, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.option("pathGlobFilter", "*.parquet").parquet(path.toString())


def daily_counts(events: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """day, the keys, n, total: a row per day that is over; events that come again within the watermark count once, later ones are dropped.

    State is bounded by the watermark: ids of an hour, and open days.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = once.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"), money("value").alias("total"))
    return out.select(F.col("w.start").cast("date").alias("day"), *keys, "n", "total")


def rolling_intensity(days: DataFrame, today: Column, kind: str = "error", baseline: float = 500.0) -> DataFrame:
    """user_id, events_last_30d, events_last_90d, intensity_score from daily counts: what the batch query counts from events."""
    rows = days.where((F.col("event_type") == kind) & (F.col("day") >= F.date_sub(today, 90)))
    near = F.sum(F.when(F.col("day") >= F.date_sub(today, 30), F.col("n")).otherwise(0))
    out = rows.groupBy("user_id").agg(near.alias("events_last_30d"), F.sum("n").alias("events_last_90d"))
    return out.withColumn("intensity_score", clamp(round_half_up(F.col("events_last_30d") / baseline * 100.0, 1), high=100.0))


def sliding_intensity(events: DataFrame, kind: str = "error", short: int = 10, long: int = 25, baseline: float = 20.0, late: str = "1 hour") -> DataFrame:
    """as_of, user_id, events_short, events_long, value_short, intensity_score: what a user had in the short and long stretch before each midnight that is over.

    Two states that watermarks bound, one upon the other: events come once and are counted by day, and a day goes into the `long` windows that hold it when it is over,
    so no event does. A window comes out when its last day is over; midnights with nothing in the long stretch before give no row.
    """
    once = events.where(F.col("event_type") == kind).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    days = once.groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    placed = days.select("user_id", "n", "v", F.window_time("day").alias("at")).select("user_id", "n", "v", "at", F.window("at", f"{long} days", "1 day").alias("w"))
    near = F.col("at") >= F.col("w.end") - F.expr(f"interval {short} days")
    sums = {"events_short": F.sum(F.when(near, F.col("n")).otherwise(0)), "events_long": F.sum("n"), "value_short": F.coalesce(F.sum(F.when(near, F.col("v"))).cast("double"), F.lit(0.0))}
    out = placed.groupBy("w", "user_id").agg(*(c.alias(name) for name, c in sums.items()))
    out = out.select(F.col("w.end").cast("date").alias("as_of"), "user_id", *sums)
    return out.withColumn("intensity_score", clamp(round_half_up(F.col("events_short") / baseline * 100.0, 1), high=100.0))


def append_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to a Parquet folder and ends; run on a schedule, each run takes up where the last one ended."""
    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").format("parquet").start(path)


def finished(rows: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives of what is there now, written to a folder and read from it."""
    spark = rows.sparkSession
    append_available(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")

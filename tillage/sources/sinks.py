"""Writers of feed tables, with the guards that the scheduled run needs.

What is written goes to a folder of its own first and takes the old table's place by two renames: a run that fails before these leaves what was there. One that dies
between them leaves the old table under another name, from which the next writer, or recover(), brings it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.operators.health import Rule, Watched, rows_at_least
from tillage.sources.landing import exists

META = "feed string, generated_at timestamp, source string, notes string, version string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def recover(spark: SparkSession, path: str) -> bool:
    """Brings back the newest old table of a path where there is none, as after a writer that died while publishing; says whether it did."""
    fs, target = _path(spark, path.rstrip("/"))
    parent = target.getParent()
    if fs.exists(target) or not fs.exists(parent):
        return False
    old = [s for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"_old-{target.getName()}-")]
    return bool(old) and fs.rename(max(old, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath(), target)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, brought back if a writer died while publishing; empty if there never was one."""
    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str) -> str:
    """Writes rows as Parquet beside a path, under a name that readers of the folder pass over, and says where."""
    recover(rows.sparkSession, path)
    parent, _, name = path.rstrip("/").rpartition("/")
    place = f"{parent}/_new-{name}-{uuid.uuid4().hex[:12]}"
    try:
        rows.write.parquet(place)
    except Exception:
        discard(rows.sparkSession, place)
        raise
    return place


def discard(spark: SparkSession, place: str) -> None:
    fs, p = _path(spark, place)
    fs.delete(p, True)


def publish(spark: SparkSession, place: str, path: str) -> None:
    """Puts what was staged in a path's place; the old table goes last, and comes back if the new one can't be moved."""
    fs, new = _path(spark, place)
    target, (_, old) = _path(spark, path)[1], _path(spark, place.replace("/_new-", "/_old-"))
    fs.mkdirs(target.getParent())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't move {place}")
    if had:
        fs.delete(old, True)


def write_feed(rows: DataFrame, root: str, feed: str, source: str, notes: str, at: datetime, version: str = "1") -> None:
    """The feed's rows as Parquet under root/feed, and its row of root/_meta."""
    publish(rows.sparkSession, stage(rows, f"{root}/{feed}"), f"{root}/{feed}")
    write_meta(rows.sparkSession, root, feed, source, notes, at, version)


def write_meta(spark: SparkSession, root: str, feed: str, source: str, notes: str, at: datetime, version: str = "1") -> None:
    """The feed's row of root/_meta."""
    publish(spark, stage(spark.createDataFrame([(feed, at, source, notes, version)], META).coalesce(1), f"{root}/_meta/feed={feed}"), f"{root}/_meta/feed={feed}")


def write_json(rows: DataFrame, path: str, key: str) -> None:
    """The rows as JSON, one object a line, in the order of the key; fields keep the order of the columns."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), key).sort(key).select("value").write.mode("overwrite").text(path)


def write_envelope(rows: DataFrame, path: str, key: str, source: str, notes: str, at: datetime, version: str = "1") -> None:
    """One JSON document at a path, as envelope() reads it: _meta, and data as a map from the key to the other columns, in the order of the key.

    Rows are sorted in parts by ranges of the key; one task then writes part after part to the one file, a row at a time, so it holds no part whole. The file takes its place
    by a rename when it is complete. A key that is null or stands twice has no place in a map: that is an error, and leaves what is there.
    """
    spark = rows.sparkSession
    none = {"ignoreNullFields": "false"}
    name = F.expr("substring(j, 2, length(j) - 2)")
    fields = [c for c in rows.columns if c != key]
    body = rows.select(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*fields), none).alias("v")).withColumn("j", F.to_json(F.array("k")))
    lines = body.select(F.lit(1).alias("part"), "k", F.concat(name, F.lit(":"), "v").alias("value"))
    meta = spark.createDataFrame([(at, source, notes, version)], "generated_at timestamp, source string, notes string, version string")
    head = meta.select(F.lit(0).alias("part"), F.lit("").alias("k"), F.concat(F.lit('{"_meta":'), F.to_json(F.struct("*"), none), F.lit(',"data":{')).alias("value"))
    foot = spark.range(1).select(F.lit(2).alias("part"), F.lit("").alias("k"), F.lit("}}").alias("value"))
    first = rows.agg(F.min(F.col(key).cast("string")).alias("first"), F.count(key).alias("keys"), F.count("*").alias("n"), F.count_distinct(key).alias("different")).first()
    if not first["n"] == first["keys"] == first["different"]:
        raise ValueError(f"{key} is null or stands twice")
    lines = lines.withColumn("value", F.when(F.col("k") == F.lit(first["first"]), F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    place = f"{path.rstrip('/').rpartition('/')[0]}/_new-{path.rstrip('/').rpartition('/')[2]}-{uuid.uuid4().hex[:12]}"
    try:
        head.unionByName(lines).unionByName(foot).sort("part", "k").select("value").coalesce(1).write.text(place)
        fs, folder = _path(spark, place)
        [file] = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        target = _path(spark, path)[1]
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(file, target):
            raise OSError(f"can't move {file}")
    finally:
        discard(spark, place)


def gated(feed: str, settings: dict[str, str | None], needed: list[str], make: Callable[[], DataFrame], empty: DataFrame) -> tuple[DataFrame, str]:
    """make()'s rows and an empty note, or, where a setting that the feed needs is missing or blank, the empty table and a note that says so."""
    missing = [n for n in needed if not (settings.get(n) or "").strip()]
    return (empty, f"{feed} not configured: set {', '.join(missing)}") if missing else (make(), "")


def safely(feed: str, write: Callable[[], None]) -> str:
    """Runs a feed's making and writing, all of it, and gives an empty note; if it fails anywhere, a note of the failure, so the run goes on."""
    try:
        write()
        return ""
    except Exception as e:  # noqa: BLE001  a feed's failure of any kind must not stop the others
        return f"{feed} failed: {(str(e).splitlines() or [type(e).__name__])[0][:200]}"


def keep_better(rows: DataFrame, path: str, least: int = 5) -> bool:
    """Writes rows to a path unless they are fewer than `least` and what is there has more; says whether it wrote. They are counted as they are written."""
    spark, watched = rows.sparkSession, Watched(rows, [rows_at_least(least)])
    place = stage(watched.rows, path)
    [n] = watched.counts()
    if n < least and exists(spark, path) and spark.read.parquet(path).limit(n + 1).count() > n:
        discard(spark, place)
        return False
    publish(spark, place, path)
    return True


def write_watched(rows: DataFrame, rules: list[Rule], path: str) -> DataFrame:
    """Writes rows if they keep the rules, which the one pass that writes them tells, and returns the report; else raises with the failed ones and leaves what is there."""
    spark, watched = rows.sparkSession, Watched(rows, rules)
    place = stage(watched.rows, path)
    if watched.failed():
        discard(spark, place)
        raise ValueError(f"not written, checks failed: {', '.join(watched.failed()[:20])}")
    publish(spark, place, path)
    return watched.report()


def write_checked(rows: DataFrame, report: DataFrame | Callable[[DataFrame], DataFrame], path: str) -> None:
    """Writes rows if every check of the report passed; else raises with the failed ones and leaves what is there.

    A report that is a function is given the rows as they were written, before they take the path's place.
    """
    spark, place = rows.sparkSession, stage(rows, path)
    try:
        found = report(spark.read.schema(rows.schema).parquet(place)) if callable(report) else report
        failed = [r["check"] for r in found.where(~F.col("passed")).select("check").limit(20).collect()]
        if failed:
            raise ValueError(f"not written, checks failed: {', '.join(failed)}")
    except Exception:
        discard(spark, place)
        raise
    publish(spark, place, path)


class Step(NamedTuple):
    """A feed of the run: what makes it, its empty table, the settings it needs, and how many rows a run must bring before it takes the place of a longer table (0: any)."""

    feed: str
    make: Callable[[SparkSession], DataFrame]
    empty: DataFrame
    needs: tuple[str, ...] = ()
    least: int = 0
    rules: tuple[Rule, ...] = ()


def _take(spark: SparkSession, step: Step, root: str, at: datetime, settings: dict[str, str | None]) -> str:
    """Makes and writes one feed; the note says why it is empty or was left as it was."""
    rows, note = gated(step.feed, settings, list(step.needs), lambda: step.make(spark), step.empty)
    if note or not (step.rules or step.least):
        write_feed(rows, root, step.feed, step.feed, note, at)
        return note
    if step.rules:
        write_watched(rows, list(step.rules), f"{root}/{step.feed}")
    elif not keep_better(rows, f"{root}/{step.feed}", step.least):
        return f"{step.feed} kept: the run brought fewer than {step.least} rows"
    write_meta(spark, root, step.feed, step.feed, "", at)
    return ""


def run_steps(spark: SparkSession, steps: list[Step | tuple], root: str, at: datetime, allowed: int = 4, settings: dict[str, str | None] | None = None) -> DataFrame:
    """Runs feeds in order, each guarded to its last partition, and reports: feed, notes, ok. More than `allowed` failures raise after all have run.

    A feed whose settings are missing is written as its empty table, with a note, which is no failure. One that fails, early or late, is written as its empty table with
    the note of the failure; but where a table stands that its rules or its least rows guard, that table stays, and only its note tells.
    """
    report = []
    for step in (Step(*s) for s in steps):
        said: list[str] = []
        failure = safely(step.feed, lambda step=step, said=said: said.append(_take(spark, step, root, at, settings or {})))
        if failure and (step.rules or step.least) and exists(spark, f"{root}/{step.feed}"):
            write_meta(spark, root, step.feed, step.feed, failure, at)
        elif failure:
            write_feed(step.empty, root, step.feed, step.feed, failure, at)
        report.append((step.feed, failure or said[0], not failure))
    if sum(not ok for *_, ok in report) > allowed:
        raise RuntimeError("; ".join(note for _, note, ok in report if not ok))
    return spark.createDataFrame(report, "feed string, notes string, ok boolean")

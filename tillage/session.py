"""The session for local use and tests; on a cluster the session is the caller's."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that results depend on (the time zone) or that plans need at any size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(name: str = "tillage", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with so many threads (all by default); more settings by name, with __ for dots."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    settings = DEFAULTS | {"spark.master": f"local[{cpus}]", "spark.app.name": name, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tillage-')}")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application under the shared one, for tables that a query makes on its way: tillage-<application>/<name>-<number>.

    What is read from it must outlive the query, so nothing is taken away while the application runs; its folder can go when it has ended.
    """
    return f"{shared_folder(spark)}/tillage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

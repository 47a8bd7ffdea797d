"""Operator 8: sharding by size-tiered compaction with an atomically committed, versioned manifest. DataFrame functions only."""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm.common import free_names, hadoop_path

MANIFEST = "run string, tier int, shard string, n_rows long, n_bytes long, min_id long, max_id long"


class ShardStore:
    """A table kept as runs of immutable Parquet shards in one shared folder.

    append() writes arrivals as a new run of small shards; compact() merges `fanout` or more runs of similar size (one tier: sizes
    within a factor of fanout) into one run of files of about target_bytes; both end by committing the next manifest version.
    A version is a folder of its own plus a marker file that holds the folder's name. The marker is written under another name and
    renamed without overwriting: of two writers one wins, and a writer that dies leaves no half-made version. An append that loses
    commits again on the version that won; a merge that loses raises, and its run goes with vacuum(), which removes what the newest
    version no longer needs.
    A run is listed by one row per shard; the driver sees one row per run. The columns of a store without runs are kept beside them.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root, target_bytes, fanout
        self.fs, self.path = hadoop_path(spark, root)

    # --- manifest

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        folder = hadoop_path(self.spark, f"{self.root}/committed")[1]
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _name(self, version: int) -> str:
        marker = self.fs.open(hadoop_path(self.spark, f"{self.root}/committed/{version:08d}")[1])
        name = marker.readUTF()
        marker.close()
        return name

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._name(version)}")

    def commit(self, rows: DataFrame, base: int) -> int:
        """Makes rows the manifest of version base + 1; fails if another writer has made that version."""
        name = f"{base + 1:08d}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        marker, begun = (hadoop_path(self.spark, f"{self.root}/committed/{n}")[1] for n in (f"{base + 1:08d}", f"begun-{name}"))
        out = self.fs.create(begun, False)
        out.writeUTF(name)
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwriting = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(begun, marker, no_overwriting)
        return base + 1

    def _listed(self, runs: list[str]) -> DataFrame:
        """Manifest rows of written runs, from the shards themselves."""
        here = self.spark.read.parquet(*(f"{self.root}/data/{r}" for r in runs))
        shard = F.regexp_extract("_metadata.file_path", r"/data/(.*)$", 1)
        per = here.select(shard.alias("shard"), F.col("_metadata.file_size").alias("n_bytes"), F.col(self.key).cast("long").alias("k"))
        per = per.groupBy("shard").agg(F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes"), F.min("k").alias("min_id"), F.max("k").alias("max_id"))
        per = per.withColumn("run", F.regexp_extract("shard", r"^([^/]+)/", 1))
        sizes = per.groupBy("run").agg(F.sum("n_bytes").alias("total"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(F.col("total") / self.smallest, F.lit(1.0))))).cast("int")
        return per.join(sizes, "run").select("run", tier.alias("tier"), "shard", "n_rows", "n_bytes", "min_id", "max_id")

    key, smallest = "doc_id", 1 << 16

    # --- writers

    def append(self, arrivals: DataFrame, batch: str | None = None) -> int:
        """Writes arrivals as small shards and commits them; with batch, each value of that column is a run of its own."""
        base, name = self.version(), uuid.uuid4().hex[:12]
        if not self.manifest(base).head(1):  # what read() gives while there are no runs
            arrivals.drop(*([batch] if batch else [])).limit(0).write.mode("overwrite").parquet(f"{self.root}/columns")
        if batch is None:
            runs = [f"run-{name}"]
            arrivals.write.parquet(f"{self.root}/data/{runs[0]}")
        else:
            folder = f"{self.root}/incoming/{name}"
            arrivals.write.partitionBy(batch).parquet(folder)
            runs = []
            self.fs.mkdirs(hadoop_path(self.spark, f"{self.root}/data")[1])
            for s in self.fs.listStatus(hadoop_path(self.spark, folder)[1]):
                if s.isDirectory():
                    runs.append(f"run-{name}-{s.getPath().getName().partition('=')[2]}")
                    if not self.fs.rename(s.getPath(), hadoop_path(self.spark, f"{self.root}/data/{runs[-1]}")[1]):
                        raise OSError(f"can't move {s.getPath()}")
            self.fs.delete(hadoop_path(self.spark, folder)[1], True)
        return self._add(self._listed(runs) if runs else None, base)

    def _add(self, listed: DataFrame | None, base: int) -> int:
        """Commits the manifest of version base with these rows more; where another writer has been first, that of the version then newest."""
        while True:
            try:
                rows = self.manifest(base)
                return self.commit(rows if listed is None else rows.union(listed), base)
            except Exception:
                if self.version() <= base:  # no race was lost
                    raise
                base = self.version()

    def compact(self) -> bool:
        """One merge of the lowest tier that holds `fanout` runs or more; False if none does."""
        base = self.version()
        rows = self.manifest(base)
        runs = rows.groupBy("tier", "run").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
        full = runs.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout).orderBy("tier").limit(1)
        merge = runs.join(full, "tier").select("run", "n_bytes", "n_rows").collect()  # a row per run: their number is fanout - 1 a tier, and arrivals
        if not merge:
            return False
        names, total = [r["run"] for r in merge], sum(r["n_bytes"] for r in merge)
        out = f"run-{uuid.uuid4().hex[:12]}"
        data = self.spark.read.schema(self._schema(names)).parquet(*(f"{self.root}/data/{n}" for n in names))
        files = max(1, math.ceil(total / self.target))
        even = math.ceil(sum(r["n_rows"] for r in merge) / files)
        data.coalesce(files).write.option("maxRecordsPerFile", max(1, even)).parquet(f"{self.root}/data/{out}")
        self.commit(rows.where(~F.col("run").isin(names)).union(self._listed([out])), base)
        return True

    def _schema(self, names: list[str]):
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/data/{n}" for n in names)).schema

    def compact_all(self) -> int:
        n = 0
        while self.compact():
            n += 1
        return n

    def vacuum(self, keep: int = 1, age_seconds: float = 86_400.0) -> int:
        """Keeps the last so many versions; removes the others' manifests, and the runs that they name and no kept version does.

        What no version names is left of a writer that died, or of one that has yet to commit: it goes only at that age. Returns how
        many runs went. The driver sees a row per run.
        """
        newest = self.version()
        folder = lambda name: [s for s in (self.fs.listStatus(hadoop_path(self.spark, f"{self.root}/{name}")[1]) if self.fs.exists(hadoop_path(self.spark, f"{self.root}/{name}")[1]) else [])]
        markers = [s for s in folder("committed") if s.getPath().getName().isdigit()]
        versions = {int(s.getPath().getName()): s for s in markers}
        names = {v: self._name(v) for v in versions}
        runs = {v: {r["run"] for r in self.manifest(v).select("run").distinct().collect()} for v in versions}
        kept = {v for v in versions if v > newest - keep}
        live = {r for v in kept for r in runs[v]}
        past = {r for v in versions if v not in kept for r in runs[v]} - live
        old = {names[v] for v in versions if v not in kept}
        stale = lambda s: s.getModificationTime() < 1000 * (time.time() - age_seconds)
        gone = 0
        for s in folder("data"):
            name = s.getPath().getName()
            if name in past or (name not in live and stale(s)):
                gone += self.fs.delete(s.getPath(), True)
        # markers go before the manifests they name, so no reader finds a version without its manifest
        for s in [versions[v] for v in versions if v not in kept] + [s for s in folder("committed") if s.getPath().getName().startswith("begun-") and stale(s)]:
            self.fs.delete(s.getPath(), False)
        for s in folder("manifest"):
            if s.getPath().getName() in old or (s.getPath().getName() not in names.values() and stale(s)):
                self.fs.delete(s.getPath(), True)
        for s in folder("incoming"):
            if stale(s):
                self.fs.delete(s.getPath(), True)
        return gone

    # --- readers

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with run, tier and shard; a table that has such a column itself keeps it, and the added one gets a _ behind its name."""
        rows = self.manifest(version)
        runs = [r["run"] for r in rows.select("run").distinct().collect()]
        if not runs:
            if not self.fs.exists(hadoop_path(self.spark, f"{self.root}/columns")[1]):
                raise ValueError("nothing has been appended to the store")
            none = self.spark.createDataFrame([], self.spark.read.parquet(f"{self.root}/columns").schema)
            shard, run, tier = free_names(none.columns, "shard", "run", "tier")
            return none.select(F.lit("").alias(shard), "*", F.lit("").alias(run), F.lit(0).alias(tier))
        data = self.spark.read.schema(self._schema(runs)).parquet(*(f"{self.root}/data/{n}" for n in runs))
        shard, run, tier = free_names(data.columns, "shard", "run", "tier")
        placed = rows.select(F.col("shard").alias(shard), F.col("run").alias(run), F.col("tier").alias(tier))
        return data.withColumn(shard, F.regexp_extract("_metadata.file_path", r"/data/(.*)$", 1)).join(placed, shard)


def sharded(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = 64 << 20, fanout: int = 4) -> ShardStore:
    """documents appended as so many arrivals (by hash of doc_id and text) and compacted until no tier is full.

    Defined cases: nulls in any column, empty and long texts and repeated rows are kept as they are; extra columns are kept, whatever
    their names (see read);
    an empty table gives a store of one empty version, which reads as no rows of its columns.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes, fanout)
    arrival = F.expr(f"pmod(xxhash64(doc_id, text), {arrivals})")
    (name,) = free_names(docs.columns, "arrival")
    store.append(docs.withColumn(name, arrival), batch=name)
    store.compact_all()
    store.vacuum()
    return store

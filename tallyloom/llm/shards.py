"""Shards in a folder with size-tiered compaction and a versioned manifest.

An arrival is appended as a *run*: a folder of small immutable Parquet shards.
Runs of similar size form a tier; once a tier has ``FANOUT`` of them, they are
merged, a tier at a time, into one run of files of about the target size, which
the reader packs from whole shards without a shuffle. A run whose files have
that size already is settled and stays. A manifest lists the runs of a version,
never files, of which only executors and Spark's own file index hear. It is
written aside and committed by a rename that fails if the version exists, so
that readers see one version whole and of two writers one has to retry. Data
files are never changed or removed by a merge; ``vacuum`` removes the runs that
no kept version lists.

Arrivals that come mixed in one table are parted by a rebalancing shuffle, so
that an arrival's shards are few and a large arrival is spread over several.

Rows come back as they were: nulls, empty and very long texts, repeated rows and
extra columns of any name. An empty arrival commits a version without new runs;
a store without rows gives an empty table. Column names that differ only by case
are an error, as everywhere in Spark.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path

TARGET_BYTES = 128 << 20
FANOUT = 4
BASE_BYTES = 1 << 20

#: ``run`` is a folder's path below the store's own.
MANIFEST = "run string, files bigint, bytes bigint, n_rows bigint, tier int"


class VersionConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.target, self.fanout = spark, root.rstrip("/"), schema, target_bytes, fanout

    # Manifests

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs().exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs().listStatus(folder) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version, the last one by default: run, files, bytes, n_rows, tier."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version:010d}")

    def commit(self, runs: DataFrame, version: int) -> None:
        """The manifest of ``version``, whole or not at all."""
        aside = f"{self.root}/staging/{uuid.uuid4().hex}"
        runs.coalesce(1).write.parquet(aside)
        jvm = self.spark._jvm
        self._fs().mkdirs(self._path(f"{self.root}/manifests"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(aside), self._path(f"{self.root}/manifests/v{version:010d}"), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"version {version}") from e
            raise

    def tier_of(self, size: Column, files: Column) -> Column:
        """0 below the base size, then one more for each factor of ``fanout``; -1 for runs whose files have half the target or more."""
        steps = F.floor(F.log(F.greatest(size / BASE_BYTES, F.lit(1.0))) / math.log(self.fanout)).cast("int")
        return F.when(size >= files * (self.target // 2), F.lit(-1)).otherwise(steps)

    def _listed(self, folder: str) -> DataFrame:
        """(run, bytes) of each data file below a folder of the store; no file is opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.root}/{folder}")
        return files.select(_run_of(F.col("path")).alias("run"), F.col("length").alias("bytes"))

    def _described(self, folder: str) -> DataFrame:
        """Manifest rows of the runs that a write left in ``folder``; only their files' footers are read."""
        sizes = self._listed(folder).groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        rows = self._reader().load(f"{self.root}/{folder}").select(_run_of(F.col("_metadata.file_path")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n_rows"))
        return sizes.join(rows, sizes.run == rows.r).select("run", "files", "bytes", "n_rows", self.tier_of(F.col("bytes"), F.col("files")).alias("tier"))

    def _reader(self, spark: SparkSession | None = None):
        return (spark or self.spark).read.format("parquet").schema(self.schema).option("recursiveFileLookup", "true")

    # Data

    def append(self, arrivals: DataFrame, by: Column | None = None) -> int:
        """Writes rows as a new run, or as one for each value of ``by``, and commits a version; gives its number."""
        folder = f"data/append-{uuid.uuid4().hex}"
        columns = [F.col(f"`{c}`") for c in self.schema.names]
        if by is None:
            arrivals.select(*columns).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        else:
            key = f"arrival_{uuid.uuid4().hex}"
            dealt = arrivals.select(*columns, F.xxhash64(by).alias(key)).hint("rebalance", F.col(key))
            dealt.write.option("compression", "zstd").partitionBy(key).parquet(f"{self.root}/{folder}")
        version = max(self.versions(), default=0) + 1
        self.commit(self.manifest(version - 1).unionByName(self._described(folder)), version)
        return version

    def compact(self) -> int:
        """Merges due tiers, the smallest first, until none has ``fanout`` runs; gives the last version."""
        version = max(self.versions(), default=0)
        while True:
            runs = self.manifest(version)
            due = runs.where("tier >= 0").groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.fanout).agg(F.min("tier")).first()[0]
            if due is None:
                return version
            merged = [r.run for r in runs.where(F.col("tier") == due).select("run").toLocalIterator()]  # folders: as many as arrivals, not as files
            folder = f"data/merge-{uuid.uuid4().hex}"
            self._merge(merged, folder)
            version += 1
            self.commit(runs.where(F.col("tier") != due).unionByName(self._described(folder)), version)

    def _merge(self, runs: list[str], folder: str) -> None:
        """One output file for each read partition: the reader sorts files by size and packs them up to the target."""
        session = self.spark.newSession()  # of its own, so that no other query sees these settings
        for k, v in {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}.items():
            session.conf.set(f"spark.sql.files.{k}", str(v))
        self._reader(session).load([f"{self.root}/{r}" for r in runs]).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        runs = [r.run for r in self.manifest(version).select("run").toLocalIterator()]
        return self._reader().load([f"{self.root}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the runs that none of the last ``keep`` versions lists; gives their number."""
        live = self.spark.createDataFrame([], "run string")
        for v in self.versions()[-keep:]:
            live = live.unionByName(self.manifest(v).select("run"))
        gone = [r.run for r in self._listed("data").select("run").distinct().join(live, "run", "left_anti").toLocalIterator()]
        for run in gone:
            self._fs().delete(self._path(f"{self.root}/{run}"), True)
        return len(gone)


def _run_of(path: Column) -> Column:
    """A data file's folder below the store: data/append-..., data/append-.../<arrival> or data/merge-..."""
    return F.regexp_extract(path, r"(data/(?:append|merge)-[0-9a-f]+(?:/[^/]+)*)/[^/]+$", 1)


def shard(df: DataFrame, arrival: Column, root: str | None = None, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """A store with the rows of ``df``, appended as arrivals and compacted; what was merged away is removed."""
    spark = df.sparkSession
    store = ShardStore(spark, root or shared_path(spark, "shards"), df.schema, target_bytes, fanout)
    store.append(df, arrival)
    store.compact()
    store.vacuum()
    return store

"""A sharded table with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet shards, one or more per task, without a shuffle. Compaction takes
the shards of a size tier and merges runs of them into files of up to the target size, again and again until no tier has a
run: Spark's file scan itself packs small files into partitions of at most that size (partitions are put together where a
platform holds the size of scans lower), and each partition is written as one shard, so nothing is shuffled. Shards of over half the target are finished, as no two of them fit into one. The list of live shards is a Parquet table of its own for each version; a version exists once its pointer
has been renamed into place, which fails if another writer was first. Readers see the version they opened.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

_MANIFEST = "shard string, rows long, bytes long, tier int, born long"


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first; nothing of this commit is visible."""


class ShardStore:
    """A table of immutable shards below ``path``.

    target_bytes: size of a finished shard. fanout: shards of a tier that make a run worth merging, and the ratio
    between tiers. arrival_rows: most rows of an arriving shard. Rows are stored as they come: nulls, ties, repeated rows and
    very long texts included. The first arrival fixes the columns; without rows there are no shards, and read() gives no rows.
    Paths of shards are on the driver while they are read or merged, as Spark's own list of files is.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fanout: int = 4, arrival_rows: int = 20_000) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.arrival_rows = target_bytes, fanout, arrival_rows
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # -- files

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._file(self.path).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        folder = self._file(f"{self.path}/versions")
        if not self._fs().exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs().listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version: shard (path), rows, bytes, tier, born (version that added it)."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], _MANIFEST)
        pointer = self._fs().open(self._file(f"{self.path}/versions/{version:09d}"))
        try:
            name = pointer.readUTF()
        finally:
            pointer.close()
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def _commit(self, base: int, manifest: DataFrame) -> int:
        """Makes a manifest version base + 1: written in full, then its pointer renamed without overwriting."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        draft, final = self._file(f"{self.path}/versions/.{name}"), self._file(f"{self.path}/versions/{base + 1:09d}")
        out = self._fs().create(draft, False)
        out.writeUTF(name)
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, options)
        except Exception as error:
            if self._fs().exists(final):
                self._fs().delete(draft, False)
                raise ConcurrentCommit(f"version {base + 1} exists") from error
            raise
        return base + 1

    # -- shards

    def _tier(self, size: Column) -> Column:
        """0 for finished shards, of over half the target; else one more for each power of fanout that a shard is smaller."""
        short = F.floor(F.log(F.lit(self.target_bytes / 2) / F.greatest(size, F.lit(1))) / math.log(self.fanout)) + 1
        return F.when(2 * size > self.target_bytes, 0).otherwise(F.greatest(short, F.lit(1))).cast("int")

    def _written_shards(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files below a folder, from the files themselves."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("shard", "bytes").agg(F.count("*").alias("rows"))
        return found.select("shard", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"), F.lit(version).cast("long").alias("born"))

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as small shards in one commit; returns the version. No rows, no shards."""
        base = self.version()
        if not self._fs().exists(self._file(f"{self.path}/columns/_SUCCESS")):
            arrivals.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", self.arrival_rows).option("compression", "zstd").parquet(folder)
        added = self._written_shards(folder, base + 1) if arrivals.columns else self.manifest(0)
        return self._commit(base, self.manifest(base).unionByName(added))

    def compact(self) -> int:
        """Merges runs of at least ``fanout`` shards of a tier until there are none; one commit for each round."""
        version = self.version()
        while (newer := self._compact_once()) is not None:
            version = newer
        return version

    def _compact_once(self) -> int | None:
        base = self.version()
        live = written(self.manifest(base), "manifest")
        runs = live.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= max(2, self.fanout))
        tiers = {r.tier: r.bytes for r in runs.orderBy("tier").collect()}
        if not tiers:
            return None
        # A session of its own, so that the packing of files into partitions does not change the caller's settings.
        merging = self.spark.newSession()
        merging.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
        merging.conf.set("spark.sql.files.openCostInBytes", "0")
        merging.conf.set("spark.sql.files.minPartitionNum", "1")
        merged = live.where(~F.col("tier").isin(list(tiers)))
        for tier, size in tiers.items():
            paths = [r.shard for r in live.where(F.col("tier") == tier).select("shard").toLocalIterator()]
            folder = f"{self.path}/shards/{uuid.uuid4().hex}"
            rows, full = merging.read.parquet(*paths), -(-size // self.target_bytes)
            # Packed to the target, all partitions but one are over half full. More of them mean that the settings were not
            # taken; each round has to leave fewer shards than it found, or compaction never ends.
            if rows.rdd.getNumPartitions() > 2 * full + 1:
                rows = rows.coalesce(full)
            rows.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
            merged = merged.unionByName(self._written_shards(folder, base + 1))
        return self._commit(base, merged)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with hidden column ``_metadata`` telling the shard."""
        paths = [r.shard for r in self.manifest(version).select("shard").toLocalIterator()]
        return self.spark.read.parquet(*(paths or [f"{self.path}/columns"]))

    def vacuum(self) -> None:
        """Deletes folders of which no shard is in the newest version, those of failed commits too.

        Older versions can't be read after it. Not to be called while another writer works.
        """
        folder = F.regexp_extract("shard", "([^/]+)/[^/]+$", 1)
        live = {r[0] for r in self.manifest().select(folder).distinct().toLocalIterator()}
        shards = self._file(f"{self.path}/shards")
        for found in self._fs().listStatus(shards) if self._fs().exists(shards) else []:
            if found.getPath().getName() not in live:
                self._fs().delete(found.getPath(), True)

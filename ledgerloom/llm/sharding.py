"""Shards of a table with size-tiered compaction and a versioned manifest, in DataFrame operations only.

A store is a directory with ``data/<name>/*.parquet``, immutable shards, and ``manifests/<version>``,
tables of one row a shard: path (below the store), bytes, n_rows, tier. Its state is its highest
version. A writer stages everything under names of its own, moves the finished data below ``data`` and then a new
manifest to the next version, in one step that fails if the version exists; so readers see a whole version
or the one before, a lost executor or driver leaves the state as it was, and of two writers one starts again.

*Append* writes arrivals as small shards, of ``arrival_rows`` rows at most, without a shuffle.
*Compact* sorts shards into tiers by the logarithm of their size (base ``fan``). A tier of ``fan``
shards or more is read as one run of similarly sized shards and written as target-sized files,
again without a shuffle: scan partitions are put together, rows stay where they are. A shard of
half the target or more is final. Each row is rewritten about once a tier, log_fan(target / arrival)
times at most. *Vacuum* deletes manifests before a given version, data that was finished longer ago than
a given age and that no manifest read after the listing names, and what writers staged before that age.
The age must be more than a writer takes from its data to its manifest; data being written is never listed.

The driver holds one path a shard of what it reads or merges: some 100,000 for 100 TB in shards of 1 GB.

Rows are stored whole with all their columns, nulls, empty and very long texts and repeated rows
included; no column's name matters, and ids are never looked at. An empty batch adds no shard.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import ages, children, cut, drop_path, publish, shared_path, table

TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 2_000
FAN = 4
SMALLEST = 1 << 16
KEPT_SECONDS = 86_400.0

_MANIFEST = "path string, bytes long, n_rows long, tier int"


class Store:
    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS, fan: int = FAN):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.arrival_rows, self.fan = target_bytes, arrival_rows, fan

    # -- state

    def version(self) -> int:
        return max((int(v) for v in children(self.spark, f"{self.root}/manifests")), default=-1)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row a shard of a version, the latest by default."""
        v = self.version() if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{v:010d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [f"{self.root}/{r.path}" for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version in ``row``, with the manifest's path, bytes, n_rows and tier of their shard."""
        rows = self.read(version)
        if not self.manifest(version).take(1):
            return self.spark.createDataFrame([], self.manifest(version).schema.add("row", self.schema))
        path = F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), "/", -2))
        return rows.select(F.struct(*rows.columns).alias("row"), path.alias("path")).join(self.manifest(version), "path")

    # -- writing

    def _tier(self, size):
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / SMALLEST) / math.log(self.fan))).cast("int")

    def _listed(self, name: str) -> DataFrame:
        """Manifest rows of the files of data/name that have rows."""
        files = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{name}")
        size = F.col("_metadata.file_size")
        each = files.select(F.substring_index(F.col("_metadata.file_path"), "/", -2).alias("p"), size.alias("bytes")).groupBy("p", "bytes").agg(F.count(F.lit(1)).alias("n_rows"))
        return each.select(F.concat(F.lit("data/"), "p").alias("path"), "bytes", "n_rows", self._tier(F.col("bytes")).alias("tier"))

    def _commit(self, manifest: DataFrame, on: int) -> bool:
        """The manifest as version ``on`` + 1, unless another writer has been faster."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(staged)
        done = publish(self.spark, staged, f"{self.root}/manifests/{on + 1:010d}")
        if not done:
            drop_path(self.spark, staged)
        return done

    def _finish(self, writer, name: str) -> None:
        """Stage data and move it to its place."""
        staged = f"{self.root}/staged/{name}"
        writer.parquet(staged)
        if not publish(self.spark, staged, f"{self.root}/data/{name}"):
            raise FileExistsError(name)

    def append(self, batch: DataFrame) -> int:
        """Add a batch's rows as small shards; the new version."""
        name = uuid.uuid4().hex
        self._finish(batch.write.option("maxRecordsPerFile", self.arrival_rows), name)
        added = cut(self._listed(name))
        while True:
            on = self.version()
            if self._commit(self.manifest(on).unionByName(added), on):
                return on + 1

    def compact(self) -> int:
        """Merge full tiers until there is none; the version then."""
        while True:
            on = self.version()
            old = self.manifest(on)
            open_ = old.where(F.col("bytes") * 2 < self.target_bytes)
            tiers = open_.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fan).orderBy("tier").collect()
            if not tiers:
                return on
            new = old
            for t in tiers:  # a few: their number is a logarithm of the target's size
                name = uuid.uuid4().hex
                paths = [r.path for r in open_.where(F.col("tier") == t.tier).orderBy("path").select("path").collect()]
                rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{p}" for p in paths))
                self._finish(rows.coalesce(max(1, round(t.bytes / self.target_bytes))).write, name)
                new = new.where((F.col("tier") != t.tier) | (F.col("bytes") * 2 >= self.target_bytes)).unionByName(cut(self._listed(name)).withColumn("tier", F.greatest("tier", F.lit(t.tier + 1))))
            self._commit(new, on)

    def vacuum(self, keep_from: int, older_than: float = KEPT_SECONDS) -> int:
        """Delete manifests before ``keep_from``, and data and staged files older than ``older_than`` seconds that no manifest names; how many directories of data."""
        listed = {d for d, age in ages(self.spark, f"{self.root}/data").items() if age >= older_than}
        used, found = set(), 0
        for v in map(int, children(self.spark, f"{self.root}/manifests")):
            if v < keep_from:
                drop_path(self.spark, f"{self.root}/manifests/{v:010d}")
            else:
                used |= {r.d for r in self.manifest(v).select(F.split("path", "/")[1].alias("d")).distinct().collect()}
        for d in listed - used:
            drop_path(self.spark, f"{self.root}/data/{d}")
            found += 1
        for d, age in ages(self.spark, f"{self.root}/staged").items():
            if age >= older_than:
                drop_path(self.spark, f"{self.root}/staged/{d}")
        return found


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard that it ends in, after its arrival and compaction."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, shared_path(spark, "shards"), docs.schema)
    store.append(docs)
    store.vacuum(store.compact(), older_than=0)  # nobody else writes to this store
    rows = store.located()
    shard = F.dense_rank().over(W.orderBy("path")).cast("long")
    names = store.manifest().select("path", shard.alias("shard"))
    return rows.join(names, "path").select("row.doc_id", "shard", F.col("n_rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))

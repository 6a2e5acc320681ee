"""Sharding by size-tiered compaction, with Spark's own readers and writers only.

A store is a folder of immutable runs and of numbered manifests.  A run is a folder of
shard files of about one size; ``append`` writes an arrival as a run of small shards and
commits a manifest that lists its shards besides those of the older runs.  ``compact``
puts runs into tiers by the mean size of their shards (each tier ``fanout`` times as large
as the one before) and merges the runs of every tier that holds ``fanout`` shards or more
into one run of shards of at most the target size; what comes out belongs to a higher
tier or is full, and merging goes on until no tier has so many.  Shards of half the
target size or more are full and are never written again.

A manifest is a table of its own; it becomes a version when a file that names it is
renamed into place, which the file system allows one writer only.  Readers see a version
as a whole or not at all, and a lost executor or driver leaves at most files that no
version names.

Merging reads the runs with splits as large as the new shards and writes one file a
split: no shuffle, and no task holds more than one shard.  The driver handles names of
runs, of which there are an arrival each at most, and after compaction fewer than
``fanout`` in a tier besides the full ones.

Old versions stay readable: ``compact(expire=n)`` withdraws all but the newest n versions
first, and only then deletes the runs that just these named.

Defined results: rows come back as they were put in, nulls, repeats and all columns
with them; an empty arrival adds a version without new shards; a store without rows reads
as an empty table of the columns that came last, or with no columns if nothing ever came.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage

MANIFEST = "run string, shard string, bytes bigint, rows bigint, tier int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, small_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fanout = target_bytes, small_bytes, fanout
        fs, p = storage.hadoop(spark, f"{self.root}/versions")
        fs.mkdirs(p)

    def versions(self) -> list[int]:
        found = (n[1:] for n in storage.names(self.spark, f"{self.root}/versions") if n[:1] == "v")
        return sorted(int(n) for n in found if n.isdigit())

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self.versions(), default=0)

    def _details(self, version: int) -> dict:
        """Name of the version's manifest and schema of its rows."""
        if not version:
            return {"manifest": None, "schema": T.StructType([]).jsonValue()}
        return json.loads(storage.text_of(self.spark, f"{self.root}/versions/v{version}"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version: run, shard, bytes, rows, tier."""
        name = self._details(self.version() if version is None else version)["manifest"]
        if name is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def commit(self, manifest: DataFrame, after: int, schema: T.StructType | None = None) -> int:
        """Make the manifest version ``after`` + 1; an error if that exists by now."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        told = {"manifest": name, "schema": schema.jsonValue() if schema is not None else self._details(after)["schema"]}
        if not storage.publish(self.spark, f"{self.root}/versions/v{after + 1}", json.dumps(told)):
            storage.delete(self.spark, f"{self.root}/manifests/{name}")
            raise RuntimeError(f"version {after + 1} was committed by another writer")
        return after + 1

    def _shards(self, run: str) -> DataFrame:
        """Manifest rows of a run, from its files' metadata alone."""
        files = self.spark.read.schema("_none string").parquet(f"{self.root}/runs/{run}")
        sizes = files.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes")).groupBy("shard", "bytes").agg(F.count("*").alias("rows"))
        mean = sizes.agg(F.avg("bytes").alias("mean"))  # one row
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.col("mean") / self.small))).cast("int")
        return sizes.crossJoin(F.broadcast(mean)).select(F.lit(run).alias("run"), "shard", F.col("bytes").cast("bigint").alias("bytes"), "rows", tier.alias("tier"))

    def append(self, arrivals: DataFrame, batch: str | None = None) -> int:
        """Add rows as small shards.  With ``batch`` each value of that column is an arrival, committed one by one, in order."""
        name = uuid.uuid4().hex
        writer = arrivals.write.option("compression", "zstd")
        schema = T.StructType([f for f in arrivals.schema.fields if f.name != batch])
        if batch is None:
            writer.parquet(f"{self.root}/runs/{name}")
            return self._add(name, schema)
        writer.partitionBy(batch).parquet(f"{self.root}/runs/{name}")
        folders = [n for n in storage.names(self.spark, f"{self.root}/runs/{name}") if "=" in n]
        for folder in sorted(folders, key=lambda n: (len(n), n)):
            self._add(f"{name}/{folder}", schema)
        return self.version() if folders else self.commit(self.manifest(), self.version(), schema)

    def _add(self, run: str, schema: T.StructType) -> int:
        after = self.version()
        return self.commit(self.manifest(after).unionByName(self._shards(run)), after, schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with their shard in the column ``_shard``."""
        version = self.version() if version is None else version
        schema = T.StructType.fromJson(self._details(version)["schema"])
        runs = [r.run for r in self.manifest(version).select("run").distinct().collect()]  # an arrival each at most
        if not runs:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_shard", T.StringType())]))
        return self._rows(schema, runs).select("*", F.col("_metadata.file_path").alias("_shard"))

    def _rows(self, schema: T.StructType, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/runs/{r}" for r in sorted(runs)))

    def compact(self, expire: int | None = None) -> int:
        """Merge until no tier holds ``fanout`` shards that aren't full; with ``expire`` keep so many versions."""
        while self._merge():
            pass
        if expire is not None:
            self.expire(expire)
        return self.version()

    def _merge(self) -> bool:
        """One round: every tier that has enough shards becomes one run.  Says whether there was such a tier."""
        version = self.version()
        now = self.manifest(version)
        by_run = now.groupBy("run", "tier").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards")).filter(F.col("bytes") < F.col("shards") * (self.target // 2))
        tiers: dict[int, list] = {}
        for r in by_run.collect():  # runs that aren't full
            tiers.setdefault(r.tier, []).append(r)
        tiers = {t: runs for t, runs in tiers.items() if sum(r.shards for r in runs) >= self.fanout}
        if not tiers:
            return False
        schema, merged, gone = T.StructType.fromJson(self._details(version)["schema"]), [], []
        for _, runs in sorted(tiers.items()):
            total, name = sum(r.bytes for r in runs), uuid.uuid4().hex
            shards = math.ceil(total / self.target)
            self._write(self._rows(schema, [r.run for r in runs]), name, -(-total // shards))
            merged.append(name)
            gone += [r.run for r in runs]
        kept = now.join(F.broadcast(self.spark.createDataFrame([(r,) for r in gone], "run string")), "run", "left_anti")
        for name in merged:
            kept = kept.unionByName(self._shards(name))
        before = now.count()
        self.commit(kept, version)
        # splits can't be smaller than a file's row groups: where that leaves as many shards as before, merging ends
        return self.manifest().count() < before

    def _write(self, rows: DataFrame, run: str, split: int) -> None:
        """One shard for each split of so many bytes."""
        own = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        held = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            rows.write.option("compression", "zstd").parquet(f"{self.root}/runs/{run}")
        finally:
            for k, v in held.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def expire(self, keep: int = 1) -> None:
        """Withdraw all but the newest ``keep`` versions, then delete the runs that only these named."""
        versions = self.versions()
        gone, left = versions[: -max(1, keep)], versions[-max(1, keep) :]
        named = lambda vs: {r.run for v in vs for r in self.manifest(v).select("run").distinct().collect()}
        runs, manifests = named(gone) - named(left), [self._details(v)["manifest"] for v in gone]
        for v in gone:
            storage.delete(self.spark, f"{self.root}/versions/v{v}")
        for name in manifests:
            storage.delete(self.spark, f"{self.root}/manifests/{name}")
        for run in runs:
            storage.delete(self.spark, f"{self.root}/runs/{run}")

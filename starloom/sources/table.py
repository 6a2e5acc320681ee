"""A versioned table: immutable parquet folders, and numbered versions that name the folders they consist of.

A change writes a folder of its own and publishes the next version, so readers see the
table before or after it, never between.  An append names the old folders and the new
one; it neither reads nor writes the rest.  Other changes compute the next state and
name its folder alone.  Two writers of one version can't both publish it: the later one
gets an error and starts again from the version it missed.

A change may carry an id.  An id that ends in ``-<number>`` (a stream's batch) is in if
a change of that name with this number or a higher one is; others are remembered one by
one.  A change that is in is not made again, however many came after it.

Old versions stay readable until ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import storage
from ..errors import LoadError
from ..operators import loaders, scd

#: Appends after which a table's folders should be merged (``compact``), so that a version stays a small file.
MANY_FOLDERS = 1000


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by, self.cluster_by = spark, path.rstrip("/"), partition_by, cluster_by
        fs, p = storage.hadoop(spark, f"{self.path}/versions")
        fs.mkdirs(p)

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in storage.names(self.spark, f"{self.path}/versions") if re.fullmatch("v[0-9]+", n))

    def details(self, version: int | None = None) -> dict:
        """folders, schema, changes (ids that are in) and time of a version, the newest by default."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version not in found:
            raise LoadError(f"{self.path} has no such version")
        return {"version": version} | json.loads(storage.text_of(self.spark, f"{self.path}/versions/v{version}"))

    def read(self, version: int | None = None) -> DataFrame:
        d = self.details(version)
        schema = T.StructType.fromJson(d["schema"])
        if not d["folders"]:
            return self.spark.createDataFrame([], schema)
        data = f"{self.path}/data"
        df = self.spark.read.option("basePath", data).schema(schema).parquet(*(f"{data}/_change={f}" for f in d["folders"]))
        return df.select(*(f"`{c}`" for c in schema.names))

    def _has(self, details: dict, change: str) -> bool:
        name, _, number = change.rpartition("-")
        if name and number.isdigit():
            return int(number) <= details["changes"].get(name, -1)
        return change in details["changes"]

    def _commit(self, after: dict | None, df: DataFrame, change: str | None, append: bool) -> int:
        """Publish the version after ``after`` (None: the first)."""
        n = after["version"] + 1 if after else 1
        folder = uuid.uuid4().hex
        out = df.sortWithinPartitions(*self.cluster_by) if self.cluster_by else df
        writer = out.write.partitionBy(*self.partition_by) if self.partition_by else out.write
        writer.parquet(f"{self.path}/data/_change={folder}")
        changes = dict(after["changes"]) if after else {}
        if change:
            name, _, number = change.rpartition("-")
            changes |= {name: int(number)} if name and number.isdigit() else {change: 0}
        schema = df.schema
        if append and after:
            old = T.StructType.fromJson(after["schema"])
            schema = T.StructType([*old.fields, *(f for f in schema.fields if f.name not in old.names)])
        told = {"folders": [*(after["folders"] if append and after else []), folder], "schema": schema.jsonValue(), "changes": changes, "time": time.time()}
        if not storage.publish(self.spark, f"{self.path}/versions/v{n}", json.dumps(told)):
            storage.delete(self.spark, f"{self.path}/data/_change={folder}")
            raise LoadError(f"version {n} was committed by another writer")
        return n

    def _changed(self, make: Callable[[DataFrame], DataFrame], change: str | None) -> int:
        now = self.details()
        if change and self._has(now, change):
            return now["version"]
        return self._commit(now, make(self.read(now["version"])), change, False)

    # each of the following returns the number of the version that has the change

    def overwrite(self, df: DataFrame, change: str | None = None) -> int:
        """``df`` is the next version, whatever was there."""
        now = self.details() if self.versions() else None
        if now and change and self._has(now, change):
            return now["version"]
        return self._commit(now, df, change, False)

    def write(self, rows: DataFrame, change: str | None = None) -> int:
        """Append; the columns must be the table's."""
        now = self.details() if self.versions() else None
        if now:
            if change and self._has(now, change):
                return now["version"]
            old = T.StructType.fromJson(now["schema"])
            if set(old.names) != set(rows.columns):
                raise LoadError(f"columns {sorted(set(old.names) ^ set(rows.columns))} are on one side only")
            rows = rows.select(*(rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in old.fields))
        return self._commit(now, rows, change, True)

    def write_named(self, rows: DataFrame, columns: list[str], change: str | None = None) -> int:
        """Append the named columns; the others are null, and new ones are added to the table."""
        now = self.details()
        if change and self._has(now, change):
            return now["version"]
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(now["schema"]).fields}
        return self._commit(now, rows.select(*(rows[f"`{c}`"].cast(kinds.get(c, rows.schema[c].dataType)).alias(c) for c in columns)), change, True)

    def close_versions(self, keys: DataFrame, nk: list[str], as_of: str, change: str | None = None) -> int:
        return self._changed(lambda now: scd.close_versions(now, keys, nk, as_of), change)

    def update_attributes(self, rows: DataFrame, nk: list[str], columns: list[str], change: str | None = None) -> int:
        """Columns of current rows take the values of the rows with their key."""
        return self._changed(lambda now: scd.updated(now, rows, nk, columns), change)

    def rotate_attributes(self, rows: DataFrame, nk: list[str], pairs: list[tuple[str, str]], change: str | None = None) -> int:
        """Of each (current, previous) pair of columns the current value becomes the previous one and the row's the current."""
        return self._changed(lambda now: scd.rotated(now, rows, nk, pairs), change)

    def update_milestones(self, rows: DataFrame, key: list[str], milestones: list[str], change: str | None = None) -> int:
        return self._changed(lambda now: loaders.accumulate(now, rows, key, milestones), change)

    def scd(self, kind: int | str, rows: DataFrame, nk: list[str], tracked, as_of: str, change: str | None = None, **options) -> int:
        """One batch of a slowly changing dimension of type 1, 2, 3, 6 or "metadata" (see ``scd.applied``)."""
        return self._changed(lambda now: scd.applied(kind, now, rows, nk, tracked, as_of, **options), change)

    def merge(self, rows: DataFrame, nk: list[str], tracked: list[str], as_of: str, change: str | None = None) -> int:
        """Matched and changed rows close, changed and new ones come in."""
        return self.scd(2, rows, nk, tracked, as_of, change)

    def upsert(self, rows: DataFrame, key: list[str], change: str | None = None) -> int:
        return self._changed(lambda now: loaders.upsert(now, rows, key), change)

    def upsert_members(self, rows: DataFrame, profile: list[str], sk: str = "id", change: str | None = None) -> DataFrame:
        """Adds missing combinations and returns (profile, key) of the rows' combinations."""
        self._changed(lambda now: scd.upsert_profiles(now, rows, profile, sk), change)
        wanted = rows.select(*profile).distinct()
        return self.read().alias("m").join(wanted.alias("w"), scd.same_key(profile, "m", "w"), "left_semi").select(*profile, sk)

    def current_hashes(self, nk: list[str]) -> DataFrame:
        return self.read().filter("is_current").select(*nk, "checksum")

    def compact(self, files: int) -> int:
        """One folder of fewer, sorted files; by range of the cluster columns where there are some."""
        return self._changed(lambda df: df.repartitionByRange(files, *self.cluster_by) if self.cluster_by else df.repartition(files), None)

    def vacuum(self, keep: int, older_than_seconds: float = 7 * 86400) -> list[int]:
        """Removes all but the newest ``keep`` versions and the folders that only these named; returns their numbers.

        Folders younger than the given age stay: a writer may not have published them yet.
        """
        gone = self.versions()[: -max(1, keep)]
        live = {f for v in self.versions()[-max(1, keep) :] for f in self.details(v)["folders"]}
        for v in gone:
            storage.delete(self.spark, f"{self.path}/versions/v{v}")
        fs, data = storage.hadoop(self.spark, f"{self.path}/data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            name = status.getPath().getName().removeprefix("_change=")
            if name not in live and time.time() - status.getModificationTime() / 1000 >= older_than_seconds:
                fs.delete(status.getPath(), True)
        return gone

    def as_view(self, name: str) -> None:
        self.read().createOrReplaceTempView(name)

"""Sources outside files and tables: iterators, record streams by shard, databases as sinks, and named sets of tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import LoadError
from .readers import Source
from .table import VersionedTable


def _values(row, names: list[str]) -> tuple:
    return tuple(row.get(n) for n in names) if isinstance(row, dict) else tuple(row)


class _Piece(InputPartition):
    def __init__(self, value, start=None, end=None):
        super().__init__(value)
        self.start, self.end = start, end


def iterated(make: Callable[[int], Iterable], schema: T.StructType | str, parts: int = 1, name: str = "iterated") -> Source:
    """Rows (dicts or tuples) that ``make(part)`` yields, read in parallel on the executors; nothing passes the driver.

    ``make`` has to yield the same rows when a lost executor's part is read again.
    """

    def read(spark: SparkSession) -> DataFrame:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

        class Reader(DataSourceReader):
            def partitions(self):
                return [_Piece(i) for i in range(parts)]

            def read(self, partition):
                for row in make(partition.value):
                    yield _values(row, kind.names)

        class Iterated(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return kind

            def reader(self, schema):
                return Reader()

        spark.dataSource.register(Iterated)
        return spark.read.format(name).load()

    return read


def resource(extract: Callable[[], Iterable], schema: T.StructType | str | None = None) -> Source:
    """An extraction tool's resource: called once, its rows (dicts) become a frame; without a schema it is inferred."""

    def read(spark: SparkSession) -> DataFrame:
        rows = list(extract())
        if not rows and schema is None:
            raise LoadError("the resource gave no rows and has no schema")
        return spark.createDataFrame(rows, schema)

    return read


def bridge(run: Callable[[], dict[str, Iterable]], table: str, schema: T.StructType | str | None = None) -> Source:
    """One table of a pipeline that gives tables' rows by name."""

    def rows():
        found = run()
        if table not in found:
            raise LoadError(f"the pipeline has {', '.join(sorted(found))}, not {table}")
        return found[table]

    return resource(rows, schema)


def sharded(client: Callable[[], object], schema: T.StructType | str, name: str = "sharded") -> Callable[[SparkSession], DataFrame]:
    """A stream of JSON records kept in shards, such as a Kinesis stream, as a frame to stream from.

    ``client()`` is made where it is used and has ``shards()`` (names), ``latest(shard)``
    (the number after its last record) and ``records(shard, start, end)`` (JSON texts).
    Each batch reads every shard from where the one before ended, in parallel by shard.
    """

    def read(spark: SparkSession) -> DataFrame:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

        class Reader(DataSourceStreamReader):
            def initialOffset(self):
                return {}

            def latestOffset(self):
                c = client()
                return {s: c.latest(s) for s in c.shards()}

            def partitions(self, start, end):
                return [_Piece(s, start.get(s, 0), n) for s, n in sorted(end.items()) if n > start.get(s, 0)]

            def read(self, partition) -> Iterator[tuple]:
                for text in client().records(partition.value, partition.start, partition.end):
                    yield _values(json.loads(text), kind.names)

        class Sharded(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return kind

            def streamReader(self, schema):
                return Reader()

        spark.dataSource.register(Sharded)
        return spark.readStream.format(name).load()

    return read


class JdbcTable:
    """A database's table with the operations that need no rewrite of it, over Spark's JDBC writer (needs the driver's jar).

    Changes of rows go through a staging table and one statement, which ``execute(sql)`` runs in the database.
    """

    def __init__(self, url: str, name: str, execute: Callable[[str], object], **properties):
        self.url, self.name, self.execute, self.properties = url, name, execute, properties

    def _written(self, df: DataFrame, table: str, mode: str) -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=table, **self.properties).mode(mode).save()

    def write(self, df: DataFrame) -> None:
        self._written(df, self.name, "append")

    def write_named(self, df: DataFrame, columns: list[str]) -> None:
        self._written(df.select(*columns), self.name, "append")

    def _staged(self, df: DataFrame, statements: Callable[[str], list[str]]) -> None:
        stage = f"{self.name}_stage"
        self._written(df, stage, "overwrite")
        for s in statements(stage):
            self.execute(s)
        self.execute(f"DROP TABLE {stage}")

    @staticmethod
    def _same(nk: list[str]) -> str:
        return " AND ".join(f"s.{c} = t.{c}" for c in nk)

    def close_versions(self, keys: DataFrame, nk: list[str], as_of: str) -> None:
        self._staged(keys.select(*nk).distinct(), lambda s: [f"UPDATE {self.name} AS t SET is_current = FALSE, valid_to = '{as_of}' FROM {s} AS s WHERE t.is_current AND {self._same(nk)}"])

    def update_attributes(self, rows: DataFrame, nk: list[str], columns: list[str]) -> None:
        sets = ", ".join(f"{c} = s.{c}" for c in columns)
        self._staged(rows.select(*nk, *columns), lambda s: [f"UPDATE {self.name} AS t SET {sets} FROM {s} AS s WHERE t.is_current AND {self._same(nk)}"])

    def rotate_attributes(self, rows: DataFrame, nk: list[str], pairs: list[tuple[str, str]]) -> None:
        sets = ", ".join(f"{before} = t.{now}, {now} = s.{now}" for now, before in pairs)
        self._staged(rows.select(*nk, *(a for a, _ in pairs)), lambda s: [f"UPDATE {self.name} AS t SET {sets} FROM {s} AS s WHERE t.is_current AND {self._same(nk)}"])

    def update_milestones(self, rows: DataFrame, key: list[str], milestones: list[str]) -> None:
        sets = ", ".join(f"{c} = COALESCE(s.{c}, t.{c})" for c in milestones)
        columns = rows.columns
        missing = f"INSERT INTO {self.name} ({', '.join(columns)}) SELECT {', '.join(f's.{c}' for c in columns)} FROM {{s}} AS s WHERE NOT EXISTS (SELECT 1 FROM {self.name} AS t WHERE {self._same(key)})"
        self._staged(rows, lambda s: [f"UPDATE {self.name} AS t SET {sets} FROM {s} AS s WHERE {self._same(key)}", missing.format(s=s)])


class CatalogTable(VersionedTable):
    """A versioned table that the session's catalog knows by name while it is open (``with``): as a view of its newest version."""

    def __init__(self, spark: SparkSession, path: str, name: str, **options):
        super().__init__(spark, path, **options)
        self.name = name

    def __enter__(self) -> CatalogTable:
        if self.versions():
            self.as_view(self.name)
        return self

    def _commit(self, *arguments) -> int:
        version = super()._commit(*arguments)
        self.as_view(self.name)
        return version

    def __exit__(self, *error) -> None:
        self.spark.catalog.dropTempView(self.name)


class TableSet:
    """Named sources that a session can ask by SQL: ``setup`` makes views of them, ``teardown`` removes them."""

    def __init__(self, spark: SparkSession, sources: dict[str, Source]):
        self.spark, self.sources, self._open = spark, sources, False

    def setup(self) -> TableSet:
        for name, source in self.sources.items():
            source(self.spark).createOrReplaceTempView(name)
        self._open = True
        return self

    def table_names(self) -> list[str]:
        return sorted(self.sources)

    def sql(self, text: str) -> DataFrame:
        if not self._open:
            raise LoadError("the tables aren't set up")
        return self.spark.sql(text)

    def schemas(self) -> dict[str, dict[str, str]]:
        return {n: dict(self.spark.table(n).dtypes) for n in self.table_names()}

    def teardown(self) -> None:
        for name in self.sources:
            self.spark.catalog.dropTempView(name)
        self._open = False

    __enter__ = setup

    def __exit__(self, *error) -> None:
        self.teardown()


def of_folder(spark: SparkSession, folder: str, names: list[str]) -> TableSet:
    """The parquet files ``<folder>/<name>.parquet`` by name."""
    return TableSet(spark, {n: (lambda s, n=n: s.read.parquet(f"{folder.rstrip('/')}/{n}.parquet")) for n in names})


def of_tables(spark: SparkSession, tables: dict[str, VersionedTable]) -> TableSet:
    """Versioned tables by name, such as a layer's or an observatory's."""
    return TableSet(spark, {n: (lambda s, t=t: t.read()) for n, t in tables.items()})

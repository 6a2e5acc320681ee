"""Sources: each is a function of a session that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError

Source = Callable[[SparkSession], DataFrame]


def parquet(*paths: str, merge_schema: bool = False, file_name: str | None = None) -> Source:
    """Partition folders become columns; ``file_name`` names a column with each row's file."""

    def read(spark):
        df = spark.read.option("mergeSchema", merge_schema).parquet(*paths)
        return df.withColumn(file_name, F.col("_metadata.file_path")) if file_name else df

    return read


def csv(*paths: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, encoding: str = "UTF-8", null: str = "", skip_errors: bool = False) -> Source:
    def read(spark):
        r = spark.read.options(sep=sep, header=header, encoding=encoding, nullValue=null, mode="DROPMALFORMED" if skip_errors else "FAILFAST")
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(list(paths))

    return read


def table(name: str, schema: str | None = None) -> Source:
    if schema and "." in name:
        raise LoadError(f"{name} is qualified already")
    return lambda spark: spark.table(f"{schema}.{name}" if schema else name)


def query(sql: str) -> Source:
    return lambda spark: spark.sql(sql.strip().rstrip(";"))


def lake(form: str, path: str, **options) -> Source:
    """A table format (delta, iceberg) or other connector whose package the cluster has."""
    return lambda spark: spark.read.format(form).options(**options).load(path)


def jdbc(url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **properties) -> Source:
    """A table of a database, read in ``parts`` ranges of a column; filters and columns are pushed down."""

    def read(spark):
        r = spark.read.format("jdbc").options(url=url, dbtable=name, **properties)
        if column:
            r = r.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
        return r.load()

    return read


def rows(data, schema: T.StructType | str | None = None) -> Source:
    """Rows at hand: a list of dicts, a pandas frame or an Arrow table."""

    def read(spark):
        if isinstance(data, list) and not data and schema is None:
            raise LoadError("no rows and no schema")
        if not isinstance(data, list) and type(data).__module__.split(".")[0] not in ("pandas", "pyarrow"):
            raise LoadError(f"rows can't come from {type(data).__name__}")
        return spark.createDataFrame(data, schema)

    return read


def coerce(source: str | Source) -> Source:
    """A source as it is; a path by its ending; any other text as a table's name."""
    if callable(source):
        return source
    if not isinstance(source, str):
        raise LoadError(f"no source: {type(source).__name__}")
    name = source.rstrip("*").lower()
    if name.endswith((".parquet", ".parq", "/")) or ".parquet" in name or ".parq" in name:
        return parquet(source)
    if name.endswith((".csv", ".tsv", ".csv.gz", ".tsv.gz")):
        return csv(source, sep="\t" if ".tsv" in name else ",")
    return table(source)


def changes(log: DataFrame, message: str | Column, schema: T.StructType | str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Upserts and deleted keys of a change log with messages {"op": c|u|r|d, "before": {...}, "after": {...}}."""
    row = schema if isinstance(schema, str) else schema.simpleString()
    m = log.select(F.from_json(message, f"op string, before {_struct(row)}, after {_struct(row)}").alias("m"))
    upserts = m.filter(F.col("m.op").isin("c", "u", "r") & F.col("m.after").isNotNull()).select("m.after.*")
    return upserts, m.filter(F.col("m.op") == "d").select(*(F.col(f"m.before.{k}").alias(k) for k in key))


def _struct(schema: str) -> str:
    if schema.startswith("struct<"):
        return schema
    return "struct<" + ", ".join(":".join(f.split(None, 1)) for f in schema.split(",")) + ">"

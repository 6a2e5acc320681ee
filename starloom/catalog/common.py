"""Table access and small helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    def read(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = spark.read.parquet(path).schema
        return spark.read.schema(_schemas[path]).parquet(path)

    return read


#: Schemas of tables that have been read, by path: looking one up costs a job.
_schemas: dict = {}


class Topic:
    """Collects the queries of one topic: ``@topic.query(sql)`` registers a function under its own name."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            def run(spark, sf_dir, f=f):
                return f(tables(spark, sf_dir))

            run.__doc__ = f.__doc__
            self.QUERIES[name or f.__name__] = run
            if sql is not None:
                self.ORACLES[name or f.__name__] = sql
            return f

        return add


#: Two versions of customers whose key divides by three (segment changes at 1998-01-01), one of the others.
CUST_HIST_SQL = """
cust_hist AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, TIMESTAMP '1995-01-01' AS valid_from,
         CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1998-01-01' END AS valid_to, c_custkey % 3 <> 0 AS is_current FROM customer
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, 'MOVED', TIMESTAMP '1998-01-01', NULL, TRUE FROM customer WHERE c_custkey % 3 = 0
)"""


def cust_hist(t) -> DataFrame:
    c = t("customer")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    base = ["c_custkey", "c_name", "c_nationkey"]
    changes = F.col("c_custkey") % 3 == 0
    one = c.select(*base, "c_mktsegment", at("1995-01-01").alias("valid_from"), F.when(changes, at("1998-01-01")).alias("valid_to"), (~changes).alias("is_current"))
    two = c.filter(changes).select(*base, F.lit("MOVED").alias("c_mktsegment"), at("1998-01-01").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    return one.unionByName(two)


def rounded(expr: str, digits: int = 2) -> str:
    return f"round(cast({expr} as double), {digits})"

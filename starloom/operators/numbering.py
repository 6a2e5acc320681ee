"""Row numbers in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number from 1 on in the order of columns that tell them apart.

    Rows are dealt to partitions by range; each numbers its own, and starts after the
    rows of those before it (one row a partition is what a single task sees of the rest).
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt, "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")

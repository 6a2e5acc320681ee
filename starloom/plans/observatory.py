"""Reports on schema changes and rule violations of watched datasets.

Facts: changes (dataset_id, evo_type_id, column_name, detected_at) and checks
(dataset_id, rule_id, violation_count, checked_at); dimensions: datasets
(dataset_id, dataset_name, layer), kinds (evo_type_id, change_type, tier,
requires_migration, requires_backfill), rules (rule_id, rule_name, severity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def breaking_change_rate(changes: DataFrame, datasets: DataFrame, kinds: DataFrame) -> DataFrame:
    breaking = F.count(F.when(F.col("tier") == "breaking", 1))
    return changes.join(datasets, "dataset_id").join(kinds, "evo_type_id").groupBy("dataset_name", "layer").agg(F.count("*").alias("total_changes"), breaking.alias("breaking_changes"), F.round(100.0 * breaking / F.count("*"), 1).alias("breaking_pct"))


def worst_quality(checks: DataFrame, datasets: DataFrame, top: int = 10) -> DataFrame:
    """The datasets with most violations; of equal ones the first by name."""
    by = checks.groupBy("dataset_id").agg(F.sum("violation_count").alias("total_violations"), F.count_distinct("rule_id").alias("distinct_rules"), F.max("checked_at").alias("latest_check"))
    return by.join(datasets, "dataset_id").select("dataset_name", "layer", "total_violations", "distinct_rules", "latest_check").orderBy(F.desc("total_violations"), "dataset_name").limit(top)


def drift_velocity(changes: DataFrame, kinds: DataFrame, bucket: str = "day") -> DataFrame:
    return changes.join(kinds, "evo_type_id").groupBy(F.date_trunc(bucket, "detected_at").cast("timestamp_ntz").alias("period"), F.col("tier").alias("change_tier")).agg(F.count("*").alias("event_count"))


def quality_trend(checks: DataFrame, datasets: DataFrame, name: str, bucket: str = "day") -> DataFrame:
    """(period, total_violations, quality_score): 1 - violations / the worst period's."""
    one = checks.join(datasets.filter(F.col("dataset_name") == name), "dataset_id", "left_semi")
    daily = one.groupBy(F.date_trunc(bucket, "checked_at").cast("timestamp_ntz").alias("period")).agg(F.sum("violation_count").alias("total_violations"))
    most = F.nullif(F.max("total_violations").over(W.partitionBy()), F.lit(0))  # a row a period
    return daily.withColumn("quality_score", F.round(1.0 - F.col("total_violations") / most, 3))


def migration_backlog(changes: DataFrame, datasets: DataFrame, kinds: DataFrame) -> DataFrame:
    todo = kinds.filter("requires_migration or requires_backfill")
    return changes.join(todo, "evo_type_id").join(datasets, "dataset_id").select("dataset_name", "column_name", "change_type", "tier", "requires_migration", "requires_backfill", "detected_at")


def rule_heatmap(checks: DataFrame, datasets: DataFrame, rules: DataFrame) -> DataFrame:
    by = checks.groupBy("dataset_id", "rule_id").agg(F.count("*").alias("check_count"), F.sum("violation_count").alias("total_violations"))
    return by.join(datasets, "dataset_id").join(rules, "rule_id").groupBy("dataset_name", "rule_name", "severity").agg(F.sum("check_count").alias("check_count"), F.sum("total_violations").alias("total_violations"), F.round(F.sum("total_violations") / F.sum("check_count"), 1).alias("avg_violations"))

"""Gold tables of orders and of users' activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_sales(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """By day and segment: orders, revenue, and customers whose first day it is (new) or isn't (returning).

    ``orders`` is (order, customer, day, amount), ``customers`` (customer, segment).
    Orders become (customer, day) rows before anything is joined.
    """
    by_day = orders.groupBy("customer", "day").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))
    first = orders.groupBy("customer").agg(F.min("day").alias("first"))
    rows = by_day.join(first, "customer").join(customers, "customer")
    new = (F.col("day") == F.col("first")).cast("int")
    return rows.groupBy("day", "segment").agg(F.sum("n").alias("orders"), F.sum("amount").cast("double").alias("revenue"), F.sum(new).alias("new_customers"), F.sum(1 - new).alias("returning_customers"))


def cohort_retention(orders: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """By week of the first order: its customers, and how many ordered again within so many days of their first."""
    first = orders.groupBy("customer").agg(F.min("day").alias("first"))
    again = orders.join(first, "customer").filter("day > first").groupBy("customer").agg(F.min(F.date_diff("day", "first")).alias("after"))
    rows = first.join(again, "customer", "left")
    return rows.groupBy(F.date_trunc("week", "first").cast("date").alias("cohort")).agg(F.count("*").alias("size"), *(F.count(F.when(F.col("after") <= d, 1)).alias(f"day_{d}") for d in days))


def growth_accounting(daily: DataFrame) -> DataFrame:
    """(user, first_day, day, state) for each user and day from their first active day to the table's last.

    New, Retained (active the day before too) and Resurrected on active days; Churned
    on the first idle day and Stale on the later ones.  ``daily`` is (user, day), each once.
    """
    w = W.partitionBy("user").orderBy("day")
    last = daily.agg(F.max("day").alias("end"))  # one row
    rows = daily.select("user", "day", F.min("day").over(W.partitionBy("user")).alias("first_day"), F.lag("day").over(w).alias("before"), F.lead("day").over(w).alias("after")).join(F.broadcast(last), F.lit(True))
    active = F.when(F.col("before").isNull(), "New").when(F.date_diff("day", "before") == 1, "Retained").otherwise("Resurrected")
    until = F.coalesce(F.date_sub("after", 1), F.col("end"))
    spread = rows.select("user", "first_day", active.alias("active"), F.posexplode(F.sequence("day", until)).alias("n", "day"))
    return spread.select("user", "first_day", "day", F.when(F.col("n") == 0, F.col("active")).when(F.col("n") == 1, "Churned").otherwise("Stale").alias("state"))


def rolling_active(daily: DataFrame, days: int = 7) -> DataFrame:
    """(day, active, rolling, before): daily active users, their sum over the last days, and over as many days before those.

    The windows run over one row a day.
    """
    by_day = daily.groupBy("day").agg(F.count_distinct("user").alias("active"))
    w = W.orderBy("day")
    return by_day.select("day", "active", F.sum("active").over(w.rowsBetween(1 - days, 0)).alias("rolling"), F.sum("active").over(w.rowsBetween(1 - 2 * days, -days)).alias("before"))


def funnel(events: DataFrame, user: str, kind: str, steps: list[str]) -> DataFrame:
    """(step, users): users who have all steps up to this one, in whatever order."""
    has = events.groupBy(user).agg(*(F.max((F.col(kind) == s).cast("int")).alias(f"_{i}") for i, s in enumerate(steps)))
    rows = F.array(*(F.struct(F.lit(s).alias("step"), F.least(F.lit(1), *(F.col(f"_{j}") for j in range(i + 1))).alias("n")) for i, s in enumerate(steps)))
    return has.select(F.explode(rows).alias("r")).groupBy("r.step").agg(F.sum("r.n").alias("users"))

"""Threshold alerts on sales rows and on daily figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import columns as c


def alert_discount(df: DataFrame, threshold: float = 40) -> DataFrame:
    """Rows with a discount so high that it may be a pricing error; works on batches and streams."""
    return df.where(F.col("discount") > threshold)


def daily_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("records"))


def daily_units(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id", "date").agg(F.sum("units_sold").alias("units"))


def alert_revenue_drop(daily: DataFrame, days: int = 7, keep: float = 0.8) -> DataFrame:
    """Days whose revenue is below ``keep`` times the mean of the ``days`` daily rows before.

    ``daily`` has one row per day, so the ordered window runs over a few thousand rows at most.
    """
    before = Window.orderBy("date").rowsBetween(-days, -1)
    mean = F.sum("revenue").over(before).cast("double") / F.count("revenue").over(before)
    return (
        daily.withColumn("mean_before", mean)
        .withColumn("revenue", F.col("revenue").cast("double"))
        .where(F.col("revenue") < F.col("mean_before") * keep)
        .select("date", "revenue", c.rounded(F.col("mean_before"), 6).alias("mean_before"))
    )


def alert_zero_streak(daily: DataFrame, days: int = 3) -> DataFrame:
    """Runs of at least ``days`` sales days in a row without a unit sold, per product.

    ``daily`` has one row per product and day, so a product's window holds no more rows than days.
    """
    nth_day = F.row_number().over(Window.partitionBy("product_id").orderBy("date"))
    nth_zero_day = F.row_number().over(Window.partitionBy("product_id", "is_zero").orderBy("date"))
    return (
        daily.withColumn("is_zero", F.col("units") == 0)
        .withColumn("run", nth_day - nth_zero_day)  # constant along a run of zero days
        .where("is_zero")
        .groupBy("product_id", "run")
        .agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days"))
        .where(F.col("days") >= days)
        .drop("run")
    )

"""Named streaming queries: each runs over all data at hand, stops, and returns what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans.registry_sales import STAR_LABELS, Query, as_doubles
from shelfwise.sources import star
from shelfwise.sources.readers import stream_table
from shelfwise.streaming import alerts, ingest
from shelfwise.streaming.runs import run_to_table, work_folder


def _sales_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a stream, joined with the other tables at rest."""
    return star.line_items_as_sales(stream_table(spark, folder, "lineitem"), spark, folder).drop("l_orderkey")


def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    raw = star.messy_sales(spark, folder, stream_table(spark, folder, "lineitem"))
    return as_doubles(ingest.stream_ingest_staged(raw, work, f"{work}/checkpoint", **STAR_LABELS))


def _land(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    ingest.land_raw_copy(star.messy_sales(spark, folder, stream_table(spark, folder, "lineitem")), f"{work}/raw", f"{work}/checkpoint")
    landed = as_doubles(spark.read.parquet(f"{work}/raw"))
    return landed.withColumn("discount", F.col("discount").cast("double"))


def _dedup(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    events = stream_table(spark, folder, "events").withColumn("time", F.col("ts").cast("timestamp"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    run_to_table(ingest.stream_dedup(twice, ["event_id"], "time", "1 hour"), f"{work}/events", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/events").drop("time")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    return as_doubles(alerts.daily_revenue_stream(_sales_stream(spark, folder), work, f"{work}/checkpoint"))


def _drop(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    return alerts.stream_revenue_drop(_sales_stream(spark, folder), work, f"{work}/checkpoint")


def _streak(**params) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        work = work_folder(spark)
        return alerts.stream_zero_streak(_sales_stream(spark, folder), work, f"{work}/checkpoint", **params)

    return run


def _discount(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark)
    run_to_table(alerts.alert_discount(_sales_stream(spark, folder)), f"{work}/alerts", f"{work}/checkpoint")
    found = as_doubles(spark.read.parquet(f"{work}/alerts"))
    return found.select(
        "product_id", "store_id", "region", "date", "price", F.col("discount").cast("double").alias("discount"), "units_sold"
    )


def queries() -> dict[str, Query]:
    return {
        "stream_ingest_staged": _ingest,
        "land_raw_copy": _land,
        "stream_dedup": _dedup,
        "daily_revenue_stream": _daily,
        "stream_revenue_drop": _drop,
        "stream_zero_streak": _streak(days=2),
        "stream_zero_streak_default": _streak(),
        "stream_alert_discount": _discount,
    }

"""Daily figures and alerts on streams of staged sales rows, right for any order of arrival.

A batch adds its own sums per day; a day's figure is the sum of all of them, so rows may come late, in any file and
in any order, and none is dropped. A batch that is run again counts once: revenue lies in levelled runs whose list names
the newest batch, and units of a product's day under the batch's id, where a repeated batch replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.alerts import alert_discount, alert_revenue_drop  # noqa: F401  alert_discount needs no state
from shelfwise.streaming.levels import add_batch, read_runs, read_version, replace_version, valid_runs
from shelfwise.streaming.runs import read_or_empty, replace_batch, run_each_batch, spread_by_rows

DAILY_SCHEMA = "date date, revenue decimal(38,2), records long"
PRODUCT_DAY_SCHEMA = "product_id string, date date, units long, sales_month string, batch_id long"
DROP_SCHEMA = "date date, revenue double, mean_before double"
RUN_SCHEMA = (
    "product_id string, first_day date, last_day date, days long, from_start boolean, to_end boolean, sales_month string"
)


def _summed(rows: DataFrame) -> DataFrame:
    sums = F.sum("revenue").cast("decimal(38,2)").alias("revenue"), F.sum("records").cast("long").alias("records")
    return rows.groupBy("date").agg(*sums)


def _add_revenue(batch: DataFrame, batch_id: int, path: str) -> None:
    add_batch(_summed(batch.withColumn("records", F.lit(1))), path, batch_id, _summed, DAILY_SCHEMA)


def daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """``(date, revenue, records)`` of all batches so far."""
    return _summed(read_runs(spark, path, DAILY_SCHEMA))


def daily_revenue_stream(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    path = f"{folder}/daily"
    run_each_batch(stream, lambda batch, batch_id: _add_revenue(batch, batch_id, path), checkpoint)
    return daily_totals(stream.sparkSession, path)


def stream_revenue_drop(stream: DataFrame, folder: str, checkpoint: str, days: int = 7, keep: float = 0.8) -> DataFrame:
    """The days whose revenue falls short of the ``days`` before, judged anew after each batch."""
    spark = stream.sparkSession
    daily_path, alert_path = f"{folder}/daily", f"{folder}/alerts"

    def handle(batch: DataFrame, batch_id: int) -> None:
        _add_revenue(batch, batch_id, daily_path)
        found = alert_revenue_drop(daily_totals(spark, daily_path), days, keep)
        replace_version(found, alert_path, batch_id)

    run_each_batch(stream, handle, checkpoint)
    return read_version(spark, alert_path, valid_runs(spark, daily_path)[0], DROP_SCHEMA)


def month_runs(daily: DataFrame) -> DataFrame:
    """The runs of days without a unit sold inside each product's month, of ``(product_id, sales_month, date, units)``.

    ``from_start`` and ``to_end`` tell whether a run begins with the month's first sales day and ends with its last. A month
    without such a day gives one row of no days, which keeps the runs of the months beside it apart.
    """
    in_order = Window.partitionBy("product_id", "sales_month").orderBy("date")
    month = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered too: one sort serves both
    is_zero = F.coalesce(F.col("units") == 0, F.lit(False))
    days = daily.withColumn("is_zero", is_zero).withColumns(
        {
            "nth": F.row_number().over(in_order),
            "of": F.count(F.lit(1)).over(month),
            "busy": F.sum(F.when(F.col("is_zero"), 0).otherwise(1)).over(in_order),  # constant along a run
            "any": F.max("is_zero").over(month),
        }
    )
    runs = (
        days.where("is_zero or (not any and nth = 1)")
        .groupBy("product_id", "sales_month", "busy", "is_zero")
        .agg(
            F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("rows"),
            F.min("nth").alias("first_nth"), F.max("nth").alias("last_nth"), F.first("of").alias("of"),
        )
    )
    zero = F.col("is_zero")
    return runs.select(
        "product_id", "first_day", "last_day", F.when(zero, F.col("rows")).otherwise(0).cast("long").alias("days"),
        (zero & (F.col("first_nth") == 1)).alias("from_start"), (zero & (F.col("last_nth") == F.col("of"))).alias("to_end"), "sales_month",
    )


def joined_runs(runs: DataFrame, days: int) -> DataFrame:
    """Streaks of at least ``days`` days from the runs of all months: a run that reaches its month's end goes on in the next
    month with sales if one starts there. A product's window holds a few rows a month.
    """
    in_order = Window.partitionBy("product_id").orderBy("sales_month", "first_day")
    goes_on = F.col("from_start") & F.coalesce(F.lag("to_end").over(in_order), F.lit(False))
    numbered = runs.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("starts").over(in_order))
    return (
        numbered.groupBy("product_id", "run")
        .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("days").alias("days"))
        .where((F.col("days") >= days) & (F.col("days") > 0))
        .drop("run")
    )


def stream_zero_streak(stream: DataFrame, folder: str, checkpoint: str, days: int = 3) -> DataFrame:
    """Streaks of at least ``days`` sales days without a unit sold.

    A batch reads the days of the months it has rows of and replaces the runs of these months, however late its rows are;
    the streaks come from the runs of all months.
    """
    spark = stream.sparkSession
    day_path, run_path = f"{folder}/product_days", f"{folder}/runs"
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(""))  # rows without a date come first, as in a sort

    def handle(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy("product_id", "date").agg(F.sum("units_sold").cast("long").alias("units"))
        mine = partial.withColumn("sales_month", F.concat(F.lit("m"), month)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        replace_batch(mine, day_path, "sales_month", "batch_id")
        partials = read_or_empty(spark, day_path, PRODUCT_DAY_SCHEMA)
        touched = partials.where(F.col("batch_id") == batch_id).select("sales_month").distinct()
        months = [row[0] for row in touched.collect()]  # at most one a month of history
        mine = spread_by_rows(partials.where(F.col("sales_month").isin(months)), "product_id", "sales_month")
        sums = mine.groupBy("product_id", "sales_month", "date")
        replace_batch(month_runs(sums.agg(F.sum("units").alias("units"))), run_path, "sales_month")

    run_each_batch(stream, handle, checkpoint)
    return joined_runs(spread_by_rows(read_or_empty(spark, run_path, RUN_SCHEMA), "product_id"), days)

"""Incremental landing and staging of sales rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from shelfwise.functions import columns as c
from shelfwise.operators.cleaning import dedup_sales, stage_rows
from shelfwise.schema import CATEGORIES, MANDATORY_COLUMNS, REGIONS
from shelfwise.streaming.runs import read_or_empty, replace_batch, run_each_batch, run_to_table


def land_raw_copy(stream: DataFrame, raw_path: str, checkpoint: str) -> None:
    """Copies newly delivered rows to the raw zone, as they are."""
    run_to_table(stream, raw_path, checkpoint)


def stream_ingest_staged(
    stream: DataFrame, folder: str, checkpoint: str,
    categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS,
) -> DataFrame:
    """Stages raw rows as they arrive; all batches together hold what one batch run would.

    A raw row that any earlier batch has brought is left out, however long ago that was: each batch is
    compared with the rows seen before, kept by month so that only the months of the batch are read.
    A batch that is run again replaces its own output.
    """
    spark = stream.sparkSession
    seen_path, staged_path = f"{folder}/seen", f"{folder}/staged"
    raw_fields = [stream.schema[n] for n in MANDATORY_COLUMNS]
    seen_schema = StructType(
        [*raw_fields, StructField("sales_month", StringType()), StructField("batch_id", LongType())]
    )
    month = F.coalesce(F.date_format(c.sale_date(), "yyyy-MM"), F.lit("none"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        arrived = dedup_sales(batch.select(*MANDATORY_COLUMNS)).withColumn("sales_month", month)
        months = [r[0] for r in batch.select(month).distinct().collect()]  # at most one a month of history
        seen = read_or_empty(spark, seen_path, seen_schema).where(F.col("sales_month").isin(months) & (F.col("batch_id") != batch_id))
        same = F.col("new.sales_month") == F.col("old.sales_month")
        for name in MANDATORY_COLUMNS:
            same = same & F.col(f"new.{name}").eqNullSafe(F.col(f"old.{name}"))
        fresh = arrived.alias("new").join(seen.alias("old"), same, "left_anti")
        replace_batch(fresh.withColumn("batch_id", F.lit(batch_id).cast("long")), seen_path, "sales_month", "batch_id")
        kept = read_or_empty(spark, seen_path, seen_schema).where(F.col("batch_id") == batch_id)
        staged = stage_rows(kept, categories, regions).withColumn("batch_id", F.lit(batch_id))
        replace_batch(staged, staged_path, "batch_id")

    run_each_batch(stream, handle, checkpoint)
    schema = stage_rows(spark.createDataFrame([], seen_schema), categories, regions).schema
    staged_schema = StructType([*schema.fields, StructField("batch_id", IntegerType())])
    return read_or_empty(spark, staged_path, staged_schema).drop("batch_id")


def stream_dedup(stream: DataFrame, keys: Sequence[str], time: str, horizon: str) -> DataFrame:
    """Rows without the repeats that follow within ``horizon`` of event time.

    State is kept for ``horizon`` only, and rows later than that are dropped with it.
    """
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))

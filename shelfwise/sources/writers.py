"""Sinks. The storage format is a parameter; writes are parallel and replace what they cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.operators.curation import curated_in_turn
from shelfwise.session import shuffles_deleted
from shelfwise.sources.store import LOOKUP_ORDER

PARTITIONS = ("sale_year", "sale_month")


def write_staged(df: DataFrame, path: str, csv_path: str | None = None, format: str = "parquet") -> None:
    """STAGED table and, on request, a CSV copy made from the written table, not from a second cleaning."""
    with shuffles_deleted(df.sparkSession):
        df.write.mode("overwrite").format(format).save(path)
    if csv_path:
        df.sparkSession.read.format(format).load(path).write.mode("overwrite").option("header", True).csv(csv_path)


def laid_out(df: DataFrame) -> DataFrame:
    """Rows placed for the partitioned write, ordered for lookups by product and date.

    Rebalancing collects the rows of a month, so that it gets few files, and splits a month that is
    far larger than others over several tasks.
    """
    return df.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, *LOOKUP_ORDER)


def write_curated_partitioned(df: DataFrame, path: str, format: str = "parquet", laid: bool = False, goes_on: bool = False) -> None:
    """CURATED by year and month; only the months in ``df`` are replaced. ``laid``: its rows have been through ``laid_out``.

    ``goes_on``: its rows are added to those of its month.
    """
    writer = (df if laid else laid_out(df)).write.mode("append" if goes_on else "overwrite")
    with shuffles_deleted(df.sparkSession):
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).format(format).save(path)


def write_curated_in_turn(staged: DataFrame, path: str, format: str = "parquet", **sizes: int) -> None:
    """CURATED rows of the written STAGED table, some months after others: the disk never holds all that they shuffle.

    The months are replaced as their turn comes, so after a job that is lost midway the run is to be repeated.
    """
    for part, goes_on in curated_in_turn(staged, laid_out, **sizes):
        write_curated_partitioned(part, path, format, laid=True, goes_on=goes_on)


def save_table(
    df: DataFrame, name: str, format: str = "parquet", partition_by: Sequence[str] = (), buckets: int = 0,
    bucket_by: Sequence[str] = (),
) -> None:
    """Catalog table, optionally partitioned and bucketed for later joins without a shuffle."""
    writer = df.write.mode("overwrite").format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def write_analytics(results: Mapping[str, DataFrame], folder: str, format: str = "parquet") -> None:
    for name, df in results.items():
        with shuffles_deleted(df.sparkSession):
            df.write.mode("overwrite").format(format).save(f"{folder}/{name}")


def write_counted(df: DataFrame, path: str, format: str = "parquet") -> int:
    """Writes and returns the number of rows, counted while they are written."""
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").format(format).save(path)
    return int(written.get["rows"])


def write_model_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)

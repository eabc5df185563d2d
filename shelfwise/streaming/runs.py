"""Small helpers to run streams over what has arrived and stop."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shelfwise.session import shared_folder

ROWS_A_TASK = 250_000


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all data that has arrived into Parquet files, exactly once per batch, and stops."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at ``path``, or no rows when nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def spread_by_rows(rows: DataFrame, *keys: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Written rows placed by ``keys`` in a number of partitions that grows with them, so that what a task sorts does not.

    They are counted first, which reads the footers of their files only.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // rows_a_task)), *keys)


def replace_batch(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes a batch so that running it again replaces its own files and nothing else.

    Rebalancing keeps the files per partition few, and splits a partition that is much larger than others.
    """
    writer = rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)

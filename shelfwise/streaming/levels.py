"""Batch sums of a stream as levelled runs: however many batches there were, few directories hold them.

Every batch adds a run of level 0. As soon as ``FAN`` runs of one level lie side by side they are summed into one run of the
next level, so a row is rewritten once a level and the number of runs grows with the logarithm of the batches. The list of
valid runs is written anew after each batch and becomes valid as a whole; a job that is lost before leaves the old list and
its runs. What the newest two lists do not name is deleted, so a reader that began one batch ago still finds its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.streaming.runs import read_or_empty

FAN = 8
LIST_SCHEMA = "place int, level int, run string, batch long"


def valid_runs(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, str]]]:
    """The newest batch (-1: none) and the runs that hold all batches up to it, oldest first, as (level, name)."""
    listed = read_or_empty(spark, f"{path}/lists", LIST_SCHEMA).orderBy("batch", "place").collect()  # two lists at most
    newest = max((row["batch"] for row in listed), default=-1)
    return newest, [(row["level"], row["run"]) for row in listed if row["batch"] == newest]


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all valid runs; several rows of one key are yet to be summed."""
    return _rows(spark, path, [name for _, name in valid_runs(spark, path)[1]], schema)


def _rows(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/runs/{name}" for name in names])


def add_batch(
    rows: DataFrame, path: str, batch_id: int, merged: Callable[[DataFrame], DataFrame], schema: str, fan: int = FAN
) -> None:
    """Adds a batch's sums; ``merged`` sums the rows of several runs by key. A batch that is listed already adds nothing."""
    spark = rows.sparkSession
    newest, runs = valid_runs(spark, path)
    if batch_id <= newest:
        return
    before = [name for _, name in runs]
    runs = [*runs, (0, f"0-{batch_id}")]
    rows.write.mode("overwrite").parquet(f"{path}/runs/{runs[-1][1]}")
    while len(runs) >= fan and len({level for level, _ in runs[-fan:]}) == 1:
        level = runs[-1][0] + 1
        name = f"{level}-{batch_id}"
        merged(_rows(spark, path, [n for _, n in runs[-fan:]], schema)).write.mode("overwrite").parquet(f"{path}/runs/{name}")
        runs = [*runs[:-fan], (level, name)]
    listed = spark.createDataFrame([(i, level, name) for i, (level, name) in enumerate(runs)], "place int, level int, run string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/batch={batch_id}")
    keep_only(spark, f"{path}/lists", [f"batch={newest}", f"batch={batch_id}"])
    keep_only(spark, f"{path}/runs", [*before, *[name for _, name in runs]])


def replace_version(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes the rows as the version of a batch and deletes all versions but this one and the one before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    keep_only(rows.sparkSession, path, [f"batch={batch_id - 1}", f"batch={batch_id}"])


def read_version(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """The version of a batch, without rows if there is none."""
    return read_or_empty(spark, path, f"{schema}, batch long").where(F.col("batch") == batch_id).drop("batch")


def keep_only(spark: SparkSession, path: str, names: list[str]) -> None:
    """Deletes what ``path`` holds beside the given names."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        if status.getPath().getName() not in names:
            files.delete(status.getPath(), True)

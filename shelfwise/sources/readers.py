"""Batch and stream readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.cleaning import check_mandatory_columns
from shelfwise.schema import RAW_SCHEMA, TEXT_SCHEMA


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with the fixed nine-column schema; a value that does not fit its type becomes null."""
    return spark.read.option("header", True).schema(RAW_SCHEMA).csv(path)


def read_sales_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with any columns in any order, all as text; the cleaners coerce them.

    The mandatory columns are checked on the header, before any row is read.
    """
    df = spark.read.option("header", True).csv(path)
    check_mandatory_columns(df)
    return df


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, text)``: one row per ``.txt`` file of the folder with its whole text."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def stream_sales_csv(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New CSV files of a landing folder, as text columns."""
    reader = spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(TEXT_SCHEMA).csv(folder)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream over the Parquet file ``name.parquet`` of ``folder``, or over all files of a folder of that name."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may name a file; a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")

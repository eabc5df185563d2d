"""The whole run RAW -> STAGED -> CURATED -> ANALYTICS, and the ingest of one delivered file."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators import cleaning
from shelfwise.plans import analytics as a
from shelfwise.schema import CATEGORIES, REGIONS
from shelfwise.session import written_for_now
from shelfwise.sources import readers, store, writers

STORED_RESULTS = {
    "category_revenue": a.category_revenue_short,
    "monthly_trend": a.monthly_trend_short,
    "top_products": a.top_products_short,
    "region_performance": a.region_performance_short,
}


def run(
    raw: DataFrame, folder: str, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS,
    csv_copy: bool = True, joined: bool = False,
) -> dict[str, DataFrame]:
    """Each stage is written and the next one reads what was written, so no stage is computed twice.

    ``joined``: the raw rows come from joins, and are written until they are staged, so that the disk never holds
    what the joins shuffle beside what staging shuffles.
    Returns the stored tables, the four results among them, and a status table with rows per stage.
    """
    spark = raw.sparkSession
    paths = {name: f"{folder}/{name}" for name in ("staged", "curated", "analytics")}
    with written_for_now(raw) if joined else nullcontext(raw) as rows:
        staged = cleaning.stage_sales(rows, categories, regions)
        writers.write_staged(staged, paths["staged"], f"{folder}/staged_csv" if csv_copy else None)
    staged = spark.read.parquet(paths["staged"])
    writers.write_curated_in_turn(staged, paths["curated"])
    curated = spark.read.parquet(paths["curated"])
    writers.register_views({"retail_curated": curated})
    writers.write_analytics({name: job(curated) for name, job in STORED_RESULTS.items()}, paths["analytics"])
    stored = {name: spark.read.parquet(f"{paths['analytics']}/{name}") for name in STORED_RESULTS}
    status = a.stage_status({"raw": raw, "staged": staged, "curated": curated})
    return {"staged": staged, "curated": curated, **stored, "status": status}


def ingest_upload(
    spark: SparkSession, path: str, folder: str, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS
) -> dict[str, int]:
    """Lands a delivered CSV, cleans it with the imputing policy and replaces the sales store.

    The file is parsed once; cleaning reads the landed columns. Row counts are taken by the writes.
    """
    if not path.endswith(".csv"):
        raise ValueError("Only .csv files are accepted.")
    raw = readers.read_sales_csv_inferred(spark, path)
    original = writers.write_counted(raw, f"{folder}/raw")
    landed = spark.read.parquet(f"{folder}/raw")
    cleaned = cleaning.clean_sales_impute(landed, categories, regions)
    kept = store.replace_sales_store(cleaned, f"{folder}/sales")
    return {"original_row_count": original, "cleaned_row_count": kept}

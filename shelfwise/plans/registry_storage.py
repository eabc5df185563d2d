"""Named queries that go through a stored form: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import cleaning, retrieval
from shelfwise.plans import medallion
from shelfwise.plans.registry_sales import STAR_LABELS, Query, as_doubles, staged
from shelfwise.plans.registry_texts import asked, index
from shelfwise.session import shared_folder, written, written_for_now
from shelfwise.sources import readers, star, store, writers


#: one lookup per access path of the store
LOOKUPS = {
    "product_date": "product_id = 'PROD_77' and date between date'1995-01-01' and date'1995-12-31'",
    "store": "store_id = 'STORE_5'",
    "category": "category = 'PROMO'",
    "region": "region = 'ASIA'",
    "date": "date = date'1995-06-15'",
}


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stored/{uuid.uuid4().hex}"


def _delivered(spark: SparkSession, folder: str) -> str:
    path = f"{_place(spark)}.csv"
    star.messy_sales(spark, folder).write.option("header", True).csv(path)
    return path


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    raw = readers.read_sales_csv(spark, _delivered(spark, folder))
    return as_doubles(cleaning.stage_sales(raw, **STAR_LABELS))


def _csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    raw = readers.read_sales_csv_inferred(spark, _delivered(spark, folder))
    return as_doubles(cleaning.clean_sales_impute(raw, **STAR_LABELS), 6)


def _upload(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark)
    medallion.ingest_upload(spark, _delivered(spark, folder), place, **STAR_LABELS)
    return as_doubles(store.read_sales_store(spark, f"{place}/sales"), 6)


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    writers.write_staged(staged(spark, folder), path)
    return as_doubles(spark.read.parquet(path))


def _curated(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    with written_for_now(star.messy_sales(spark, folder)) as raw:
        clean = written(cleaning.stage_sales(raw, **STAR_LABELS))
    writers.write_curated_in_turn(clean, path)
    return as_doubles(spark.read.parquet(path), 6)


def _lookup(condition: str) -> Query:
    """Stored sales of one value of a lookup column."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = _place(spark)
        store.replace_sales_store(star.sales(spark, folder), path)
        return as_doubles(store.read_sales_store(spark, path).where(condition))

    return run


def _medallion(result: str) -> Query:
    return lambda spark, folder: medallion.run(
        star.messy_sales(spark, folder), _place(spark), **STAR_LABELS, csv_copy=False, joined=True
    )[result]


def _index(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    index(spark, folder).save(path)
    found = retrieval.search_topk(asked(spark, folder), retrieval.Index.load(spark, path))
    return found.withColumn("score", F.round("score", 6))


def queries() -> dict[str, Query]:
    return {
        "read_sales_csv": _csv,
        "read_sales_csv_inferred": _csv_inferred,
        "ingest_upload": _upload,
        "write_staged": _staged,
        "write_curated_partitioned": _curated,
        **{f"medallion_{name}": _medallion(name) for name in medallion.STORED_RESULTS},
        **{f"lookup_{name}": _lookup(condition) for name, condition in LOOKUPS.items()},
        "medallion_status": _medallion("status"),
        "save_load_index": _index,
    }

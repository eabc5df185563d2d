"""Named queries over features, the demand model and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import anomalies, features, forecasting
from shelfwise.operators.quantiles import exact_quantile
from shelfwise.plans.registry_sales import Query, as_doubles
from shelfwise.session import written
from shelfwise.sources import star

KEYS = ("product_id", "store_id", "region", "date", "units_sold")


_TABLES: dict[tuple[str, str], DataFrame] = {}


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    """The sales rows as a table of their own, written once per application: all jobs below read it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TABLES:
        _TABLES[key] = written(star.sales(spark, folder))
    return _TABLES[key]


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return as_doubles(df.select(*KEYS, F.col("discount").cast("double").alias("discount"), *names), 6)


def _sequenced(spark: SparkSession, folder: str) -> DataFrame:
    sales = _sales(spark, folder)
    return features.sequence_features(sales, exact_quantile(sales, "units_sold", 0.5).scalar())


def _engineer(spark: SparkSession, folder: str) -> DataFrame:
    return as_doubles(features.feature_frame(features.engineer_features(_sales(spark, folder).drop("revenue"))), 6)


def _split(mode: str) -> Query:
    return lambda spark, folder: _keyed(features.holdout_split(_sales(spark, folder), 0.2, mode), "is_holdout")


def _naive(spark: SparkSession, folder: str) -> DataFrame:
    scored = _sequenced(spark, folder)
    return as_doubles(forecasting.evaluate_model(scored, "units_sold", "roll_avg_30"), 6)


def requests_from_sales(sales: DataFrame) -> DataFrame:
    return sales.select("product_id", F.col("date").alias("target_date"), "price", "discount", "store_id", "region")


def _request_features(spark: SparkSession, folder: str) -> DataFrame:
    sales = _sales(spark, folder)
    # the star tables spell regions in capitals, requests are looked up by the spelling of staged rows
    codes = features.encode_labels(sales).withColumn(
        "label", F.when(F.col("column") == "region", F.initcap("label")).otherwise(F.col("label"))
    )
    out = forecasting.request_features(requests_from_sales(sales), codes)
    out = out.withColumn("region", F.upper("region")).withColumn("discount", F.col("discount").cast("double"))
    return as_doubles(
        out.select(
            "product_id", "target_date", "price", "discount", "store_id", "region", "sale_day", "weekday_num", "iso_week",
            "net_price", "price_x_discount", "units_lag_1", "roll_std_7", "momentum_ratio",
            "product_code", "category_code", "store_code", "region_code",
        ),
        6,
    )


def _model(spark: SparkSession, folder: str):
    sales = _sales(spark, folder)
    codes = features.encode_labels(sales)
    rows = features.training_rows(features.engineer_features(sales.drop("revenue"), codes), base=sales)
    model, metrics = forecasting.train_demand_model(rows)
    return sales, codes, model, metrics


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return _model(spark, folder)[3]


def _predict(spark: SparkSession, folder: str) -> DataFrame:
    sales, codes, model, _ = _model(spark, folder)
    return forecasting.predict_demand(requests_from_sales(sales), codes, model)


def _classify_all(df: DataFrame) -> DataFrame:
    return anomalies.classify_anomalies(df, anomalies.mean_units(df))


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    rows = _classify_all(_sales(spark, folder))
    return rows.select(
        "product_id", "store_id", "date", "units_sold", F.col("discount").cast("double").alias("discount"),
        "anomaly_label", "reason",
    )


def queries() -> dict[str, Query]:
    return {
        "unit_lags": lambda s, f: _keyed(_sequenced(s, f), *[f"units_lag_{n}" for n in features.LAGS]),
        "rolling_units": lambda s, f: _keyed(
            _sequenced(s, f), *[f"roll_avg_{n}" for n in features.ROLLING], "roll_std_7", "roll_high_7", "roll_low_7",
            "momentum_ratio",
        ),
        "encode_labels": lambda s, f: features.encode_labels(_sales(s, f)),
        "engineer_features": _engineer,
        "holdout_split": _split("positional"),
        "holdout_split_by_date": _split("chronological"),
        "evaluate_naive_forecast": _naive,
        "retrain_needed": lambda s, f: forecasting.retrain_needed(_naive(s, f)),
        "request_features": _request_features,
        "train_demand_model": _train,
        "predict_demand": _predict,
        "classify_anomalies": _classified,
        "anomaly_label_counts": lambda s, f: anomalies.anomaly_counts(_classify_all(_sales(s, f))),
        "detect_anomalies": lambda s, f: as_doubles(anomalies.detect_anomalies(_sales(s, f))),
        "anomaly_counts": lambda s, f: anomalies.anomaly_counts(anomalies.detect_anomalies(_sales(s, f))),
        "top_anomalies": lambda s, f: anomalies.top_anomalies(anomalies.detect_anomalies(_sales(s, f))),
    }

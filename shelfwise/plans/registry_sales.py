"""Named queries over the sales tables: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import columns as c
from shelfwise.operators import alerts, cleaning, curation
from shelfwise.operators.quantiles import exact_quantile, exact_quantiles, trim_to_quantile
from shelfwise.plans import analytics as a
from shelfwise.session import written
from shelfwise.sources import star

Query = Callable[[SparkSession, str], DataFrame]

# The cleaned labels of the star tables, given to the cleaners in place of the model's own sets.
STAR_CATEGORIES = ("Economy", "Large", "Medium", "Promo", "Small", "Standard")
STAR_REGIONS = ("Africa", "America", "Asia", "Europe", "Middle East")
STAR_LABELS = {"categories": STAR_CATEGORIES, "regions": STAR_REGIONS}


def as_doubles(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles and, on request, doubles rounded: the form results are compared in."""
    out = {}
    for name, dtype in df.dtypes:
        if dtype.startswith("decimal"):
            out[name] = F.col(name).cast("double")
        elif dtype == "double" and digits is not None:
            out[name] = F.round(name, digits)
    return df.withColumns(out) if out else df


def on_sales(job: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, folder: job(curation.enrich(star.sales(spark, folder)), **params)


def on_messy(job: Callable[..., DataFrame], digits: int | None = None, **params) -> Query:
    return lambda spark, folder: as_doubles(job(star.messy_sales(spark, folder), **params), digits)


def staged(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.stage_sales(star.messy_sales(spark, folder), **STAR_LABELS)


def _p99_trim(df: DataFrame) -> DataFrame:
    trimmed = trim_to_quantile(df, "units_sold", 0.99)
    return as_doubles(trimmed.select("product_id", "store_id", "date", "units_sold", "revenue"))


def _imputed_medians(spark: SparkSession, folder: str) -> DataFrame:
    raw = cleaning.dedup_sales(star.messy_sales(spark, folder))
    dated = cleaning.normalise(raw).where(F.col("date").isNotNull())
    medians = exact_quantiles(dated, {"price": 0.5, "units_sold": 0.5})
    return medians.withColumnsRenamed({"price": "price_median", "units_sold": "units_median"})


def _audit(df: DataFrame) -> DataFrame:
    checked = cleaning.audit_revenue(cleaning.normalise(cleaning.dedup_sales(df)))
    return checked.select(
        "product_id", "store_id", "date", "price", "discount", "units_sold", "revenue", "expected_revenue"
    )


def _ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.data_quality_counts(star.messy_sales(spark, folder), staged(spark, folder))


def _stage_status(spark: SparkSession, folder: str) -> DataFrame:
    clean = written(staged(spark, folder))
    return a.stage_status(
        {"raw": star.messy_sales(spark, folder), "staged": clean, "curated": curation.curate_sales(clean)}
    )


def _date_parts(df: DataFrame) -> DataFrame:
    from shelfwise.operators.features import calendar_flags

    return as_doubles(
        calendar_flags(df).select(
            "product_id", "store_id", "region", "date", "units_sold", "discount", "sale_day", "sale_month", "sale_year",
            "sale_quarter", "weekday_num", "is_weekend", "year_month", "iso_week", "early_month_flag", "late_month_flag",
        )
    ).withColumn("discount", F.col("discount").cast("double"))


def _price_columns(df: DataFrame) -> DataFrame:
    out = df.select(
        "product_id", "store_id", "date", "units_sold", F.col("discount").cast("double").alias("discount"), "net_price",
        "price_x_discount", F.pow("discount", F.lit(2)).alias("squared_discount"),
        c.discount_band().alias("discount_band"), c.money_text(F.col("revenue")).alias("revenue_text"),
    )
    return as_doubles(out)


def _curated(spark: SparkSession, folder: str) -> DataFrame:
    return as_doubles(curation.curate_sales(written(staged(spark, folder))), 6)


def _alert_discount(df: DataFrame) -> DataFrame:
    rows = alerts.alert_discount(df).select("product_id", "store_id", "region", "date", "price", "discount", "units_sold")
    return rows.withColumns({n: F.col(n).cast("double") for n in ("price", "discount")})


def queries() -> dict[str, Query]:
    return {
        "revenue_by_category": on_sales(a.revenue_by_category),
        "monthly_trend": on_sales(a.monthly_trend),
        "top_products": on_sales(a.top_products),
        "region_performance": on_sales(a.region_performance),
        "store_performance": on_sales(a.store_performance),
        "discount_impact": on_sales(a.discount_impact),
        "seasonal_quarter": on_sales(a.seasonal_quarter),
        "weekend_vs_weekday": on_sales(a.weekend_vs_weekday),
        "category_region_matrix": on_sales(a.category_region_matrix),
        "category_region_wide": on_sales(
            a.category_region_wide, regions=["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
        ),
        "zero_sales_anomalies": on_sales(a.zero_sales_anomalies),
        "high_discount": on_sales(a.high_discount),
        "mom_growth": on_sales(a.mom_growth),
        "category_revenue_short": on_sales(a.category_revenue_short),
        "monthly_trend_short": on_sales(a.monthly_trend_short),
        "top_products_short": on_sales(a.top_products_short),
        "region_performance_short": on_sales(a.region_performance_short),
        "alert_candidates": on_sales(a.alert_candidates),
        "product_aggregates": on_sales(lambda df: as_doubles(curation.product_aggregates(df), 6)),
        **{
            name: on_sales(lambda df, k=key, n=name: as_doubles(curation.average_units(df, k, n), 6))
            for key, name in curation.GROUP_AVERAGES.items()
        },
        "sales_overview": on_sales(a.sales_overview),
        "key_metrics": on_sales(a.key_metrics),
        "dashboard_trends": on_sales(a.dashboard_trends),
        "metrics_overview": on_sales(a.metrics_overview),
        "category_breakdown": on_sales(a.revenue_by, key="category"),
        "revenue_by_region": on_sales(a.revenue_by, key="region"),
        "revenue_by_month": on_sales(a.revenue_by, key="year_month"),
        "revenue_by_store": on_sales(a.revenue_by, key="store_id"),
        "ranked_top_n": on_sales(a.ranked_top_n),
        "product_detail": on_sales(a.product_detail, product_id="prod_7"),
        "overview_text": on_sales(a.overview_text),
        "category_lines": on_sales(a.breakdown_lines, key="category"),
        "product_text": on_sales(a.product_text, product_id="prod_7"),
        "overview_document": on_sales(lambda df: a.overview_document(a.metrics_overview(df))),
        "product_details": on_sales(a.product_details),
        "median_units": on_sales(exact_quantile, value="units_sold", q=0.5),
        "p99_units": on_sales(exact_quantile, value="units_sold", q=0.99),
        "median_revenue": on_sales(lambda df: as_doubles(exact_quantile(df, "revenue", 0.5), 6)),
        "p99_trim": on_sales(_p99_trim),
        "dedup_sales": on_messy(lambda df: cleaning.dedup_sales(df).withColumn("discount", F.col("discount").cast("double"))),
        "stage_sales": on_messy(cleaning.stage_sales, **STAR_LABELS),
        "clean_sales_impute": on_messy(cleaning.clean_sales_impute, 6, **STAR_LABELS),
        "imputed_medians": _imputed_medians,
        "quarantine_rejects": on_messy(
            lambda df: cleaning.quarantine_rejects(df, **STAR_LABELS).withColumn("discount", F.col("discount").cast("double"))
        ),
        "audit_revenue": on_messy(_audit, 6),
        "ingest_counts": _ingest_counts,
        "stage_status": _stage_status,
        "date_parts": on_sales(_date_parts),
        "price_columns": on_sales(_price_columns),
        "curate_sales": _curated,
        "alert_discount": on_sales(_alert_discount),
        "daily_revenue": on_sales(lambda df: as_doubles(alerts.daily_revenue(df))),
        "alert_revenue_drop": on_sales(lambda df: alerts.alert_revenue_drop(alerts.daily_revenue(df))),
        "alert_zero_streak_default": on_sales(lambda df: alerts.alert_zero_streak(alerts.daily_units(df))),
        "alert_zero_streak": on_sales(lambda df: alerts.alert_zero_streak(alerts.daily_units(df), days=2)),
    }

"""The two cleaning policies for raw sales rows, and checks on what they reject or repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as c
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.schema import CATEGORIES, CLEAN_MONEY, CLEAN_PERCENT, CLEAN_PRICE, MANDATORY_COLUMNS, REGIONS
from shelfwise.session import written

IMPUTED_UNITS = "decimal(20,6)"  # a median may lie halfway between two values

# The first values that the cleaned types cannot hold; such rows are rejected with their own reason.
BEYOND_PRICE, BEYOND_UNITS = 1e16, 2**31


def check_mandatory_columns(df: DataFrame) -> None:
    missing = [name for name in MANDATORY_COLUMNS if name not in df.columns]
    if missing:
        raise ValueError(f"Missing mandatory columns: {missing}")


def dedup_sales(df: DataFrame) -> DataFrame:
    """Distinct raw rows. Copies meet in the map-side combine, so a huge group of them stays cheap."""
    return df.dropDuplicates()


def normalise(df: DataFrame) -> DataFrame:
    """Names trimmed and cased, dates parsed, numbers coerced; what cannot be read becomes null."""
    return df.withColumns(
        {
            "product_id": c.identifier("product_id"),
            "store_id": c.identifier("store_id"),
            "category": c.label("category"),
            "region": c.label("region"),
            "date": c.sale_date(),
            "price": c.number("price"),
            "discount": c.number("discount"),
            "units_sold": c.number("units_sold"),
        }
    )


def first_failed_rule(categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS) -> Column:
    """Name of the first staging rule a normalised row fails, null when it passes all of them."""
    price, units = F.col("price"), F.col("units_sold")
    too_large = (price >= BEYOND_PRICE) | (units >= BEYOND_UNITS)
    return (
        F.when(F.col("date").isNull(), "bad_date")
        .when(price.isNull(), "missing_price")
        .when(units.isNull(), "missing_units")
        .when(price <= 0, "price_not_positive")
        .when(units < 0, "negative_units")
        .when(units != F.floor(units), "fractional_units")
        .when(too_large, "amount_out_of_range")
        .when(~discount_in_range(F.col("discount")), "discount_out_of_range")
        .when(~F.coalesce(F.col("category").isin(list(categories)), F.lit(False)), "unknown_category")
        .when(~F.coalesce(F.col("region").isin(list(regions)), F.lit(False)), "unknown_region")
    )


def as_staged(normal: DataFrame) -> DataFrame:
    """Exact types, missing discount as zero and the recomputed revenue, for rows that pass the rules."""
    typed = normal.withColumns(
        {
            "price": F.col("price").cast(CLEAN_PRICE),
            "discount": F.coalesce("discount", F.lit(0.0)).cast(CLEAN_PERCENT),
            "units_sold": F.col("units_sold").cast("int"),
        }
    )
    return typed.withColumn("revenue", c.revenue(CLEAN_MONEY)).select(*MANDATORY_COLUMNS)


def valid_rows(normal: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Normalised rows that pass every rule.

    One plain condition per column: the optimizer moves them below the normalising projection, where
    a condition that names a column several times would also compute it several times.
    """
    price, units, discount = F.col("price"), F.col("units_sold"), F.col("discount")
    return normal.where(
        F.col("category").isin(list(categories))
        & F.col("region").isin(list(regions))
        & discount_in_range(discount)
        & ((price > 0) & (price < BEYOND_PRICE))
        & ((units >= 0) & (units < BEYOND_UNITS) & (units == F.floor(units)))
        & F.col("date").isNotNull()
    )


def discount_in_range(discount: Column) -> Column:
    return discount.isNull() | discount.between(0, 100)


def stage_rows(df: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS) -> DataFrame:
    """The row-wise part of staging, without the dedup: a filter and a projection, no shuffle."""
    return as_staged(valid_rows(normalise(df), categories, regions))


def stage_sales(df: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS) -> DataFrame:
    """RAW to STAGED: distinct rows (before any repair), incomplete and out-of-range rows dropped."""
    return stage_rows(dedup_sales(df.select(*MANDATORY_COLUMNS)), categories, regions)


def quarantine_rejects(
    df: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS
) -> DataFrame:
    """The distinct raw rows staging leaves out, as they came, with the first rule each one fails."""
    raw = dedup_sales(df.select(*MANDATORY_COLUMNS))
    kept = F.struct(*[F.col(name).alias(name) for name in MANDATORY_COLUMNS]).alias("raw")
    judged = normalise(raw.select("*", kept)).withColumn("reason", first_failed_rule(categories, regions))
    return judged.where(F.col("reason").isNotNull()).select("raw.*", "reason")


def _imputed(df: DataFrame) -> DataFrame:
    """Distinct rows with gaps filled, beside the ``raw`` row; the medians are over all dated rows.

    The rows are written once, as both the medians and the result read them.
    """
    kept = F.struct(*[F.col(name).alias(name) for name in MANDATORY_COLUMNS]).alias("raw")
    rows = written(normalise(dedup_sales(df.select(*MANDATORY_COLUMNS)).select("*", kept)))
    medians = exact_quantiles(rows.where(F.col("date").isNotNull()), {"price": 0.5, "units_sold": 0.5})
    fills = {name: F.coalesce(F.col(name), medians.select(name).scalar()) for name in medians.columns}
    return rows.withColumns(fills).withColumn("discount", F.coalesce("discount", F.lit(0.0)))


def first_failed_imputing_rule(categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS) -> Column:
    """Name of the first rule a filled row fails, null when it passes all of them."""
    price, units = F.col("price"), F.col("units_sold")
    return (
        F.when(F.col("date").isNull(), "bad_date")
        .when(~F.coalesce(price > 0, F.lit(False)), "price_not_positive")
        .when(~F.coalesce(units >= 0, F.lit(False)), "negative_units")
        .when((price >= BEYOND_PRICE) | (units >= BEYOND_UNITS), "amount_out_of_range")
        .when(~F.col("discount").between(0, 100), "discount_out_of_range")
        .when(~F.coalesce(F.col("category").isin(list(categories)), F.lit(False)), "unknown_category")
        .when(~F.coalesce(F.col("region").isin(list(regions)), F.lit(False)), "unknown_region")
    )


def clean_sales_impute(
    df: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS
) -> DataFrame:
    """The imputing policy: missing price and units take the median over all distinct, dated rows.

    The medians are taken before the range and label filters, and revenue is not rounded.
    ``quarantine_imputed`` has the rows that this leaves out.
    """
    kept = _imputed(df).where(first_failed_imputing_rule(categories, regions).isNull())
    typed = kept.withColumns(
        {
            "price": F.col("price").cast(CLEAN_PRICE),
            "units_sold": F.col("units_sold").cast(IMPUTED_UNITS),
            "discount": F.col("discount").cast(CLEAN_PERCENT),
        }
    )
    return typed.withColumn("revenue", c.discounted(F.col("price") * F.col("units_sold"))).select(*MANDATORY_COLUMNS)


def quarantine_imputed(
    df: DataFrame, categories: Sequence[str] = CATEGORIES, regions: Sequence[str] = REGIONS
) -> DataFrame:
    """The distinct raw rows the imputing policy leaves out, as they came, with the first rule each one fails."""
    judged = _imputed(df).withColumn("reason", first_failed_imputing_rule(categories, regions))
    return judged.where(F.col("reason").isNotNull()).select("raw.*", "reason")


def audit_revenue(df: DataFrame, rtol: float = 0.01, atol: float = 1e-8) -> DataFrame:
    """Rows whose delivered revenue is off the recomputed one by more than the tolerance."""
    expected = c.discounted(F.col("price") * F.col("units_sold")).cast("double")
    gap = F.abs(F.col("revenue").cast("double") - expected)
    return df.withColumn("expected_revenue", expected).where(gap > F.lit(atol) + F.lit(rtol) * F.abs(expected))


def data_quality_counts(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows delivered and rows kept, the two counts an ingest reports."""
    return raw.agg(F.count(F.lit(1)).alias("original_row_count")).withColumn(
        "cleaned_row_count", staged.agg(F.count(F.lit(1)).alias("n")).scalar()
    )

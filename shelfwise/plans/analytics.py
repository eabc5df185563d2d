"""The business queries over CURATED sales rows.

Every limited query ends its ordering with the key columns, so that ties have one answer. Sums and
averages stay decimal until the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import columns as c
from shelfwise.session import cut_lineage, written


def _sum(name: str) -> Column:
    return c.rounded(F.sum(name))


def _avg(name: str) -> Column:
    return c.rounded(F.avg(name))


def _count() -> Column:
    return F.count(F.lit(1))


def revenue_by_category(df: DataFrame) -> DataFrame:
    revenue = F.sum("revenue")
    share = revenue * 100 / F.sum(revenue).over(Window.partitionBy())  # over one row per category
    return (
        df.groupBy("category")
        .agg(
            _sum("revenue").alias("total_revenue"),
            F.sum("units_sold").alias("total_units_sold"),
            _count().alias("record_count"),
            _avg("price").alias("avg_price"),
            _avg("discount").alias("avg_discount_pct"),
            c.rounded(share).alias("revenue_share_pct"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("year_month")
        .agg(
            _sum("revenue").alias("monthly_revenue"),
            F.sum("units_sold").alias("monthly_units"),
            F.countDistinct("product_id").alias("active_products"),
            F.countDistinct("store_id").alias("active_stores"),
            _avg("discount").alias("avg_discount_pct"),
        )
        .orderBy("year_month")
    )


def top_products(df: DataFrame, top_n: int = 15) -> DataFrame:
    """Stores and regions are counted for the rows of the ``top_n`` products only: distinct counts of all would deal every row out thrice."""
    best_first = (F.desc("total_revenue"), "product_id", "category")
    totals = df.groupBy("product_id", "category").agg(
        _sum("revenue").alias("total_revenue"),
        F.sum("units_sold").alias("total_units"),
        _avg("price").alias("avg_price"),
        _avg("discount").alias("avg_discount_pct"),
    )
    top = written(totals.orderBy(*best_first).limit(top_n))
    named = [row[0] for row in top.select("product_id").distinct().collect()]  # at most top_n
    asked = F.col("product_id").isin([n for n in named if n is not None])
    rows = df.where(asked | F.col("product_id").isNull() if None in named else asked)
    counts = rows.groupBy(F.col("product_id").alias("_product"), F.col("category").alias("_category")).agg(
        F.countDistinct("store_id").alias("stores_selling"), F.countDistinct("region").alias("regions_present")
    )
    same = F.col("product_id").eqNullSafe(F.col("_product")) & F.col("category").eqNullSafe(F.col("_category"))
    return top.join(counts, same).drop("_product", "_category").orderBy(*best_first)


def region_performance(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("region")
        .agg(
            _sum("revenue").alias("total_revenue"),
            F.sum("units_sold").alias("total_units"),
            F.countDistinct("store_id").alias("store_count"),
            F.countDistinct("product_id").alias("product_count"),
            _avg("discount").alias("avg_discount_pct"),
            c.rounded(F.sum("revenue") / F.countDistinct("store_id")).alias("revenue_per_store"),
        )
        .orderBy(F.desc("total_revenue"), "region")
    )


def store_performance(df: DataFrame, top_n: int = 20) -> DataFrame:
    return (
        df.groupBy("store_id", "region")
        .agg(
            _sum("revenue").alias("total_revenue"),
            F.sum("units_sold").alias("total_units"),
            F.countDistinct("product_id").alias("product_count"),
            _avg("discount").alias("avg_discount_pct"),
        )
        .orderBy(F.desc("total_revenue"), "store_id", "region")
        .limit(top_n)
    )


def discount_impact(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(c.discount_band().alias("discount_band"))
        .agg(
            _count().alias("transaction_count"),
            _avg("units_sold").alias("avg_units_sold"),
            _sum("revenue").alias("total_revenue"),
            _avg("revenue").alias("avg_revenue_per_txn"),
        )
        .orderBy("discount_band")
    )


def seasonal_quarter(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("sale_year", "sale_quarter")
        .agg(
            _sum("revenue").alias("quarterly_revenue"),
            F.sum("units_sold").alias("quarterly_units"),
            _count().alias("transaction_count"),
            _avg("discount").alias("avg_discount_pct"),
        )
        .orderBy("sale_year", "sale_quarter")
    )


def weekend_vs_weekday(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(c.day_type().alias("day_type"))
        .agg(
            _count().alias("transaction_count"),
            _sum("revenue").alias("total_revenue"),
            _avg("units_sold").alias("avg_units_per_txn"),
            _avg("discount").alias("avg_discount_pct"),
        )
        .orderBy("day_type")
    )


def category_region_matrix(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("category", "region")
        .agg(_sum("revenue").alias("total_revenue"), F.sum("units_sold").alias("total_units"))
        .orderBy("category", F.desc("total_revenue"), "region")
    )


def category_region_wide(df: DataFrame, regions: list[str]) -> DataFrame:
    """One column of revenue per region; the region list is given, so no extra pass looks for it."""
    return df.groupBy("category").pivot("region", regions).agg(_sum("revenue")).orderBy("category")


def zero_sales_anomalies(df: DataFrame, top_n: int = 20) -> DataFrame:
    keys = ["product_id", "category", "store_id", "region", "year_month"]
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(F.col("units_sold") == 0).alias("zero_sales_days"),
            _sum("revenue").alias("monthly_revenue"),
            F.max("discount").cast("double").alias("max_discount_applied"),
        )
        .where(F.col("zero_sales_days") > 0)
        .orderBy(F.desc("zero_sales_days"), *keys)
        .limit(top_n)
    )


def high_discount(df: DataFrame, threshold: float = 30, top_n: int = 50) -> DataFrame:
    columns = ["product_id", "category", "store_id", "region", "date", "price", "discount", "units_sold", "revenue"]
    ties = ["product_id", "store_id", "region", "date", "units_sold", "price"]
    top = (
        df.where(F.col("discount") >= threshold)
        .select(*columns)
        .orderBy(F.desc("discount"), F.desc("revenue"), *ties)
        .limit(top_n)
    )
    return top.withColumns({n: F.col(n).cast("double") for n in ("price", "discount", "revenue")})


def mom_growth(df: DataFrame) -> DataFrame:
    by_month = Window.orderBy("year_month")  # over one row per month
    return (
        df.groupBy("year_month")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
        .withColumn("previous", F.lag("revenue").over(by_month))
        .select(
            "year_month",
            F.col("revenue").cast("double").alias("monthly_revenue"),
            F.col("previous").cast("double").alias("prev_month_revenue"),
            c.rounded(c.growth_pct(F.col("revenue"), F.col("previous"))).alias("mom_growth_pct"),
        )
        .orderBy("year_month")
    )


# The shorter forms the medallion run stores.


def category_revenue_short(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("category")
        .agg(
            _sum("revenue").alias("total_revenue"),
            F.sum("units_sold").alias("total_units"),
            _count().alias("record_count"),
            _avg("discount").alias("avg_discount"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def monthly_trend_short(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("year_month")
        .agg(_sum("revenue").alias("monthly_revenue"), F.sum("units_sold").alias("monthly_units"))
        .orderBy("year_month")
    )


def top_products_short(df: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        df.groupBy("product_id")
        .agg(
            _sum("revenue").alias("total_revenue"),
            F.sum("units_sold").alias("total_units"),
            _avg("price").alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
        .limit(top_n)
    )


def region_performance_short(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("region")
        .agg(_sum("revenue").alias("total_revenue"), F.countDistinct("store_id").alias("store_count"))
        .orderBy(F.desc("total_revenue"), "region")
    )


def alert_candidates(df: DataFrame, zero_days: int = 3, max_discount: float = 40) -> DataFrame:
    """Product months with more than ``zero_days`` zero-sale rows or a discount above ``max_discount``."""
    return (
        df.groupBy("product_id", "year_month")
        .agg(
            _sum("revenue").alias("monthly_revenue"),
            F.count_if(F.col("units_sold") == 0).alias("zero_sales_days"),
            F.max("discount").cast("double").alias("max_discount"),
        )
        .where((F.col("zero_sales_days") > zero_days) | (F.col("max_discount") > max_discount))
        .orderBy(F.desc("zero_sales_days"), "product_id", "year_month")
    )


# Key figures and dashboard tables.


def sales_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        _count().alias("total_records"),
        _sum("revenue").alias("total_revenue"),
        F.sum("units_sold").cast("long").alias("total_units"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("store_id").alias("unique_stores"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def key_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        _sum("revenue").alias("total_revenue"),
        F.sum("units_sold").cast("long").alias("total_units_sold"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("store_id").alias("unique_stores"),
        F.countDistinct("category").alias("unique_categories"),
        F.countDistinct("region").alias("unique_regions"),
        _avg("price").alias("avg_price"),
        _avg("discount").alias("avg_discount_pct"),
        F.min("date").alias("date_range_start"),
        F.max("date").alias("date_range_end"),
        _count().alias("total_records"),
    )


SECTIONS = {
    "category": "by_category",
    "region": "by_region",
    "year_month": "monthly",
    "product_id": "top_products",
    "store_id": "by_store",
}


def revenue_sections(df: DataFrame, keys: list[str], top_n: int, totals: bool = False) -> DataFrame:
    """Revenue per value of each key as ``(section, key, value)``, products cut to the ``top_n``.

    One scan for all sections: grouping sets, each combined map-side, ``totals`` as one set more. The
    sums are written before the products are ranked, so that they are computed once.
    """
    sets = [[k] for k in keys] + [[]] * totals
    grouped = cut_lineage(
        df.groupingSets(sets, *keys).agg(
            _sum("revenue").alias("revenue"), F.sum("units_sold").cast("double").alias("units"), F.grouping_id().alias("gid")
        )
    )
    # grouping_id has one bit per key, highest first, that is 0 for the key grouped by
    full = (1 << len(keys)) - 1
    section, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("gid") == full - (1 << (len(keys) - 1 - i))
        section = F.when(here, SECTIONS[k]).otherwise(section)
        value = F.when(here, F.col(k)).otherwise(value)
    tidy = grouped.where(F.col("gid") != full).select(section.alias("section"), value.alias("key"), F.col("revenue").alias("value"))
    products = F.col("section") == SECTIONS["product_id"]
    top = tidy.where(products).orderBy(F.desc("value"), "key").limit(top_n)
    parts = tidy.where(~products).unionByName(top)
    if not totals:
        return parts
    whole = grouped.where(F.col("gid") == full).select(F.col("revenue").alias("total_revenue"), F.col("units").alias("total_units_sold"))
    return parts.unionByName(whole.unpivot([], whole.columns, "key", "value").select(F.lit("totals").alias("section"), "key", "value"))


def dashboard_trends(df: DataFrame, top_n: int = 10) -> DataFrame:
    return revenue_sections(df, list(SECTIONS), top_n)


def metrics_overview(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Totals and four breakdowns as one tidy table."""
    return revenue_sections(df, ["category", "region", "year_month", "product_id"], top_n, totals=True)


def overview_document(overview: DataFrame) -> DataFrame:
    """The overview as one JSON document with a map per section; the sections have few, already cut entries."""
    maps = overview.groupBy("section").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("entries")
    )
    names = ["totals", "by_category", "by_region", "monthly", "top_products"]
    fields = [F.first(F.when(F.col("section") == n, F.col("entries")), ignorenulls=True).alias(n) for n in names]
    return maps.agg(F.to_json(F.struct(*fields)).alias("document"))


def revenue_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(_sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), key)


def ranked_top_n(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Top products with their 1-based rank and a printable line; the rank runs over ``top_n`` rows only."""
    top = (
        df.groupBy("product_id")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "product_id")
        .limit(top_n)
    )
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "product_id")))
    line = F.concat(F.col("rank"), F.lit(". "), "product_id", F.lit(": "), c.money_text(F.col("revenue")))
    return ranked.select("rank", "product_id", F.col("revenue").cast("double").alias("revenue"), line.alias("line"))


def product_detail(df: DataFrame, product_id: str) -> DataFrame:
    """Figures of one product, with a status that says when the id is missing or unknown."""
    wanted = (product_id or "").upper()
    figures = df.where(F.col("product_id") == wanted).agg(
        _sum("revenue").alias("revenue"),
        F.sum("units_sold").cast("long").alias("units"),
        _avg("price").alias("avg_price"),
        c.rounded(F.avg("discount"), 1).alias("avg_discount"),
        _count().alias("records"),
    )
    if not wanted:
        status = F.lit("Please provide product_id parameter.")
    else:
        status = F.when(F.col("records") == 0, f"No data found for product: {wanted}").otherwise("ok")
    return figures.select(F.lit(wanted).alias("product_id"), "*", status.alias("status"))


def product_details(df: DataFrame) -> DataFrame:
    """The same figures for every product."""
    return df.groupBy("product_id").agg(
        _sum("revenue").alias("revenue"),
        F.sum("units_sold").cast("long").alias("units"),
        _avg("price").alias("avg_price"),
        _avg("discount").alias("avg_discount"),
        _count().alias("records"),
    )


def stage_status(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per stage."""
    counts = [d.agg(_count().alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, d in stages.items()]
    status = counts[0]
    for more in counts[1:]:
        status = status.unionByName(more)
    return status


def overview_text(df: DataFrame) -> DataFrame:
    """The overview as one printable line."""
    f = sales_overview(df)
    parts = {
        "Total Records": F.format_number("total_records", 0),
        "Total Revenue": c.money_text(F.col("total_revenue")),
        "Total Units Sold": F.format_number("total_units", 0),
        "Unique Products": F.col("unique_products").cast("string"),
        "Unique Stores": F.col("unique_stores").cast("string"),
        "Date Range": F.concat(F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string")),
    }
    return f.select(F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), v) for n, v in parts.items()]).alias("line"))


def breakdown_lines(df: DataFrame, key: str) -> DataFrame:
    """Revenue per value of ``key``, largest first, as printable lines."""
    totals = df.groupBy(key).agg(F.round(F.sum("revenue"), 2).alias("revenue")).orderBy(F.desc("revenue"), key)
    return totals.select(key, F.concat(F.col(key), F.lit(": "), c.money_text(F.col("revenue"))).alias("line"))


def product_text(df: DataFrame, product_id: str) -> DataFrame:
    """The figures of one product as a printable line, or what is wrong with the request."""
    f = product_detail(df, product_id)
    line = F.format_string(
        "Product %s: Revenue=%s | Units=%s | Avg Price=$%.2f | Avg Discount=%.1f%% | Records=%d",
        F.col("product_id"), c.money_text(F.col("revenue")), F.format_number("units", 0),
        F.col("avg_price"), F.col("avg_discount"), F.col("records"),
    )
    return f.select(F.when(F.col("status") == "ok", line).otherwise(F.col("status")).alias("line"))

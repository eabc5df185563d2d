"""Oracle queries for the stored forms: storing a result must not change it."""

from __future__ import annotations

from oracles.sales import Q as SALES_Q
from oracles.sales import REV, UNITS, over
from oracles.tables import SALES, STAGED, avg2, dbl
from oracles.texts import Q as TEXT_Q



def stored(condition: str) -> str:
    return over(SALES, f"""
SELECT product_id, category, region, store_id, date, {dbl('price')} AS price, discount, units_sold, {dbl('revenue')} AS revenue
FROM sales WHERE {condition}""")


Q: dict[str, str] = {
    "read_sales_csv": SALES_Q["stage_sales"],
    "read_sales_csv_inferred": SALES_Q["clean_sales_impute"],
    "ingest_upload": SALES_Q["clean_sales_impute"],
    "write_staged": SALES_Q["stage_sales"],
    "write_curated_partitioned": SALES_Q["curate_sales"],
    "medallion_category_revenue": over(STAGED, f"""
SELECT category, {REV} AS total_revenue, {UNITS} AS total_units, COUNT(*) AS record_count, {avg2('discount')} AS avg_discount
FROM staged GROUP BY category"""),
    "medallion_monthly_trend": over(STAGED, f"""
SELECT strftime(date, '%Y-%m') AS year_month, {REV} AS monthly_revenue, {UNITS} AS monthly_units FROM staged GROUP BY 1"""),
    "medallion_top_products": over(STAGED, f"""
SELECT product_id, {REV} AS total_revenue, {UNITS} AS total_units, {avg2('price')} AS avg_price
FROM staged GROUP BY product_id ORDER BY SUM(revenue) DESC, product_id LIMIT 10"""),
    "medallion_region_performance": over(STAGED, f"""
SELECT region, {REV} AS total_revenue, COUNT(DISTINCT store_id) AS store_count FROM staged GROUP BY region"""),
    "medallion_status": SALES_Q["stage_status"],
    "lookup_product_date": stored("product_id = 'PROD_77' AND date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"),
    "lookup_store": stored("store_id = 'STORE_5'"),
    "lookup_category": stored("category = 'PROMO'"),
    "lookup_region": stored("region = 'ASIA'"),
    "lookup_date": stored("date = DATE '1995-06-15'"),
    "save_load_index": TEXT_Q["search_topk"],
}

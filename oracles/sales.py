"""Oracle queries for cleaning, curation and the business queries."""

from __future__ import annotations

from oracles.tables import CATEGORIES, IMPUTED, MESSY, NORMAL, REGIONS, SALES, STAGED, avg2, big, dbl

Q: dict[str, str] = {}


def over(cte: str, query: str) -> str:
    return f"WITH {cte}\n{query}"


REV = dbl("SUM(revenue)")
UNITS = big("SUM(units_sold)")

Q["revenue_by_category"] = over(SALES, f"""
SELECT category, {REV} AS total_revenue, {UNITS} AS total_units_sold, COUNT(*) AS record_count,
       {avg2('price')} AS avg_price, {avg2('discount')} AS avg_discount_pct,
       ROUND({dbl('SUM(revenue)')} * 100 / SUM({dbl('SUM(revenue)')}) OVER (), 2) AS revenue_share_pct
FROM sales GROUP BY category""")

Q["monthly_trend"] = over(SALES, f"""
SELECT year_month, {REV} AS monthly_revenue, {UNITS} AS monthly_units,
       COUNT(DISTINCT product_id) AS active_products, COUNT(DISTINCT store_id) AS active_stores,
       {avg2('discount')} AS avg_discount_pct
FROM sales GROUP BY year_month""")

Q["top_products"] = over(SALES, f"""
SELECT product_id, category, {REV} AS total_revenue, {UNITS} AS total_units, {avg2('price')} AS avg_price,
       {avg2('discount')} AS avg_discount_pct, COUNT(DISTINCT store_id) AS stores_selling,
       COUNT(DISTINCT region) AS regions_present
FROM sales GROUP BY product_id, category ORDER BY SUM(revenue) DESC, product_id, category LIMIT 15""")

Q["region_performance"] = over(SALES, f"""
SELECT region, {REV} AS total_revenue, {UNITS} AS total_units, COUNT(DISTINCT store_id) AS store_count,
       COUNT(DISTINCT product_id) AS product_count, {avg2('discount')} AS avg_discount_pct,
       ROUND({REV} / COUNT(DISTINCT store_id), 2) AS revenue_per_store
FROM sales GROUP BY region""")

Q["store_performance"] = over(SALES, f"""
SELECT store_id, region, {REV} AS total_revenue, {UNITS} AS total_units,
       COUNT(DISTINCT product_id) AS product_count, {avg2('discount')} AS avg_discount_pct
FROM sales GROUP BY store_id, region ORDER BY SUM(revenue) DESC, store_id, region LIMIT 20""")

BAND = """CASE WHEN discount = 0 THEN '0% (No Discount)' WHEN discount BETWEEN 1 AND 10 THEN '1-10%'
     WHEN discount BETWEEN 11 AND 20 THEN '11-20%' WHEN discount BETWEEN 21 AND 30 THEN '21-30%' ELSE '30%+' END"""

Q["discount_impact"] = over(SALES, f"""
SELECT {BAND} AS discount_band, COUNT(*) AS transaction_count, {avg2('units_sold')} AS avg_units_sold,
       {REV} AS total_revenue, {avg2('revenue')} AS avg_revenue_per_txn
FROM sales GROUP BY 1""")

Q["seasonal_quarter"] = over(SALES, f"""
SELECT CAST(year(date) AS INT) AS sale_year, CAST(quarter(date) AS INT) AS sale_quarter, {REV} AS quarterly_revenue,
       {UNITS} AS quarterly_units, COUNT(*) AS transaction_count, {avg2('discount')} AS avg_discount_pct
FROM sales GROUP BY 1, 2""")

Q["weekend_vs_weekday"] = over(SALES, f"""
SELECT CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, COUNT(*) AS transaction_count,
       {REV} AS total_revenue, {avg2('units_sold')} AS avg_units_per_txn, {avg2('discount')} AS avg_discount_pct
FROM sales GROUP BY 1""")

Q["category_region_matrix"] = over(SALES, f"""
SELECT category, region, {REV} AS total_revenue, {UNITS} AS total_units FROM sales GROUP BY category, region""")

_wide = ", ".join(
    f"CAST(SUM(revenue) FILTER (region = '{r}') AS DOUBLE) AS \"{r}\""
    for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
)
Q["category_region_wide"] = over(SALES, f"SELECT category, {_wide} FROM sales GROUP BY category")

Q["zero_sales_anomalies"] = over(SALES, f"""
SELECT product_id, category, store_id, region, year_month, COUNT(*) FILTER (units_sold = 0) AS zero_sales_days,
       {REV} AS monthly_revenue, {dbl('MAX(discount)')} AS max_discount_applied
FROM sales GROUP BY product_id, category, store_id, region, year_month
HAVING COUNT(*) FILTER (units_sold = 0) > 0
ORDER BY zero_sales_days DESC, product_id, category, store_id, region, year_month LIMIT 20""")

Q["high_discount"] = over(SALES, f"""
SELECT product_id, category, store_id, region, date, {dbl('price')} AS price, {dbl('discount')} AS discount, units_sold,
       {dbl('revenue')} AS revenue
FROM sales s WHERE s.discount >= 30
ORDER BY s.discount DESC, s.revenue DESC, product_id, store_id, region, date, units_sold, s.price LIMIT 50""")

Q["mom_growth"] = over(SALES, f"""
, months AS (SELECT year_month, SUM(revenue) AS revenue FROM sales GROUP BY year_month),
lagged AS (SELECT *, LAG(revenue) OVER (ORDER BY year_month) AS previous FROM months)
SELECT year_month, {dbl('revenue')} AS monthly_revenue, {dbl('previous')} AS prev_month_revenue,
       ROUND(({dbl('revenue')} - {dbl('previous')}) / NULLIF({dbl('previous')}, 0) * 100, 2) AS mom_growth_pct
FROM lagged""")

Q["category_revenue_short"] = over(SALES, f"""
SELECT category, {REV} AS total_revenue, {UNITS} AS total_units, COUNT(*) AS record_count, {avg2('discount')} AS avg_discount
FROM sales GROUP BY category""")
Q["monthly_trend_short"] = over(SALES, f"""
SELECT year_month, {REV} AS monthly_revenue, {UNITS} AS monthly_units FROM sales GROUP BY year_month""")
Q["top_products_short"] = over(SALES, f"""
SELECT product_id, {REV} AS total_revenue, {UNITS} AS total_units, {avg2('price')} AS avg_price
FROM sales GROUP BY product_id ORDER BY SUM(revenue) DESC, product_id LIMIT 10""")
Q["region_performance_short"] = over(SALES, f"""
SELECT region, {REV} AS total_revenue, COUNT(DISTINCT store_id) AS store_count FROM sales GROUP BY region""")

Q["alert_candidates"] = over(SALES, f"""
SELECT product_id, year_month, {REV} AS monthly_revenue, COUNT(*) FILTER (units_sold = 0) AS zero_sales_days,
       {dbl('MAX(discount)')} AS max_discount
FROM sales GROUP BY product_id, year_month HAVING COUNT(*) FILTER (units_sold = 0) > 3 OR MAX(discount) > 40""")

Q["product_aggregates"] = over(SALES, f"""
SELECT product_id, ROUND(AVG(units_sold), 6) AS avg_units_by_product,
       ROUND(COALESCE(stddev_samp(units_sold), 0), 6) AS std_units_by_product, {REV} AS total_revenue_by_product
FROM sales GROUP BY product_id""")
for _key, _name in (("category", "category"), ("region", "region"), ("store_id", "store")):
    Q[f"avg_units_by_{_name}"] = over(SALES, f"""
SELECT {_key}, ROUND(AVG(units_sold), 6) AS avg_units_by_{_name} FROM sales GROUP BY {_key}""")

Q["sales_overview"] = over(SALES, f"""
SELECT COUNT(*) AS total_records, {REV} AS total_revenue, {UNITS} AS total_units,
       COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT store_id) AS unique_stores,
       MIN(date) AS first_date, MAX(date) AS last_date FROM sales""")
Q["key_metrics"] = over(SALES, f"""
SELECT {REV} AS total_revenue, {UNITS} AS total_units_sold, COUNT(DISTINCT product_id) AS unique_products,
       COUNT(DISTINCT store_id) AS unique_stores, COUNT(DISTINCT category) AS unique_categories,
       COUNT(DISTINCT region) AS unique_regions, {avg2('price')} AS avg_price, {avg2('discount')} AS avg_discount_pct,
       MIN(date) AS date_range_start, MAX(date) AS date_range_end, COUNT(*) AS total_records FROM sales""")


def _section(name: str, key: str, tail: str = "") -> str:
    return f"(SELECT '{name}' AS section, {key} AS key, {REV} AS value FROM sales GROUP BY {key} {tail})"


_four = [_section("by_category", "category"), _section("by_region", "region"), _section("monthly", "year_month")]


def _top(n: int) -> str:
    return _section("top_products", "product_id", f"ORDER BY SUM(revenue) DESC, product_id LIMIT {n}")


Q["dashboard_trends"] = over(SALES, "\nUNION ALL ".join([*_four, _top(10), _section("by_store", "store_id")]))
Q["metrics_overview"] = over(SALES, "\nUNION ALL ".join([
    *_four, _top(5),
    f"(SELECT 'totals' AS section, 'total_revenue' AS key, {REV} AS value FROM sales)",
    "(SELECT 'totals' AS section, 'total_units_sold' AS key, CAST(SUM(units_sold) AS DOUBLE) AS value FROM sales)",
]))
for _key, _name in (("category", "category"), ("region", "region"), ("year_month", "month"), ("store_id", "store")):
    Q[f"revenue_by_{_name}" if _name != "category" else "category_breakdown"] = over(SALES, f"""
SELECT {_key}, {REV} AS revenue FROM sales GROUP BY {_key}""")

Q["ranked_top_n"] = over(SALES, """
, top AS (SELECT product_id, SUM(revenue) AS revenue FROM sales GROUP BY product_id
          ORDER BY SUM(revenue) DESC, product_id LIMIT 5),
ranked AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, product_id) AS INT) AS rank, product_id, revenue FROM top)
SELECT rank, product_id, CAST(revenue AS DOUBLE) AS revenue,
       rank || '. ' || product_id || ': $' || format('{:,.2f}', CAST(revenue AS DOUBLE)) AS line FROM ranked""")

Q["product_detail"] = over(SALES, f"""
SELECT 'PROD_7' AS product_id, {REV} AS revenue, {UNITS} AS units, {avg2('price')} AS avg_price,
       ROUND(AVG(discount), 1) AS avg_discount, COUNT(*) AS records,
       CASE WHEN COUNT(*) = 0 THEN 'No data found for product: PROD_7' ELSE 'ok' END AS status
FROM sales WHERE product_id = 'PROD_7'""")
Q["product_details"] = over(SALES, f"""
SELECT product_id, {REV} AS revenue, {UNITS} AS units, {avg2('price')} AS avg_price, {avg2('discount')} AS avg_discount,
       COUNT(*) AS records
FROM sales GROUP BY product_id""")

Q["median_units"] = over(SALES, "SELECT quantile_cont(CAST(units_sold AS DOUBLE), 0.5) AS quantile FROM sales")
Q["p99_units"] = over(SALES, "SELECT quantile_cont(CAST(units_sold AS DOUBLE), 0.99) AS quantile FROM sales")
Q["median_revenue"] = over(SALES, "SELECT ROUND(quantile_cont(CAST(revenue AS DOUBLE), 0.5), 6) AS quantile FROM sales")
Q["p99_trim"] = over(SALES, """
, cut AS (SELECT quantile_cont(CAST(units_sold AS DOUBLE), 0.99) AS p99 FROM sales)
SELECT product_id, store_id, date, units_sold, CAST(revenue AS DOUBLE) AS revenue FROM sales, cut WHERE units_sold <= p99""")

# cleaning

_cols = f"product_id, category, region, store_id, date, {dbl('price')} AS price, {dbl('discount')} AS discount"
Q["dedup_sales"] = over(MESSY, f"""
SELECT DISTINCT {_cols}, units_sold, {dbl('revenue')} AS revenue FROM messy""")
Q["stage_sales"] = over(STAGED, f"SELECT {_cols}, units_sold, {dbl('revenue')} AS revenue FROM staged")
Q["clean_sales_impute"] = over(IMPUTED, f"SELECT {_cols}, units_sold, ROUND(revenue, 6) AS revenue FROM imputed")
Q["imputed_medians"] = over(IMPUTED, "SELECT price_median, units_median FROM medians")

_reason = f"""CASE WHEN TRY_CAST(date AS DATE) IS NULL THEN 'bad_date' WHEN price IS NULL THEN 'missing_price'
  WHEN units_sold IS NULL THEN 'missing_units' WHEN price <= 0 THEN 'price_not_positive'
  WHEN units_sold < 0 THEN 'negative_units' WHEN NOT COALESCE(discount, 0) BETWEEN 0 AND 100 THEN 'discount_out_of_range'
  WHEN array_to_string(list_transform(string_split(trim(category), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
       NOT IN {CATEGORIES} THEN 'unknown_category'
  WHEN array_to_string(list_transform(string_split(trim(region), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
       NOT IN {REGIONS} THEN 'unknown_region' END"""
Q["quarantine_rejects"] = over(MESSY, f"""
, judged AS (SELECT *, {_reason} AS reason FROM (SELECT DISTINCT * FROM messy))
SELECT {_cols}, units_sold, {dbl('revenue')} AS revenue, reason FROM judged WHERE reason IS NOT NULL""")
Q["audit_revenue"] = over(NORMAL, f"""
SELECT product_id, store_id, date, {dbl('price')} AS price, {dbl('discount')} AS discount, {dbl('units_sold')} AS units_sold,
       {dbl('given_revenue')} AS revenue,
       ROUND(price * units_sold * (100 - discount) / 100.0, 6) AS expected_revenue
FROM normal
WHERE abs({dbl('given_revenue')} - price * units_sold * (100 - discount) / 100.0)
      > 1e-8 + 0.01 * abs(price * units_sold * (100 - discount) / 100.0)""")
Q["ingest_counts"] = over(STAGED, """
SELECT (SELECT COUNT(*) FROM messy) AS original_row_count, (SELECT COUNT(*) FROM staged) AS cleaned_row_count""")
Q["stage_status"] = over(STAGED, """
SELECT 'raw' AS stage, COUNT(*) AS rows FROM messy UNION ALL SELECT 'staged', COUNT(*) FROM staged
UNION ALL SELECT 'curated', COUNT(*) FROM staged""")

Q["date_parts"] = over(SALES, f"""
SELECT product_id, store_id, region, date, units_sold, {dbl('discount')} AS discount,
       CAST(day(date) AS INT) AS sale_day, CAST(month(date) AS INT) AS sale_month, CAST(year(date) AS INT) AS sale_year,
       CAST(quarter(date) AS INT) AS sale_quarter, CAST(weekday_num AS INT) AS weekday_num, is_weekend, year_month,
       CAST(week(date) AS INT) AS iso_week, CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END AS early_month_flag,
       CASE WHEN day(date) >= 21 THEN 1 ELSE 0 END AS late_month_flag
FROM sales""")
Q["price_columns"] = over(SALES, f"""
SELECT product_id, store_id, date, units_sold, {dbl('discount')} AS discount, {dbl('net_price')} AS net_price,
       {dbl('price_x_discount')} AS price_x_discount, {dbl('discount * discount')} AS squared_discount,
       {BAND} AS discount_band, '$' || format('{{:,.2f}}', {dbl('revenue')}) AS revenue_text
FROM sales""")
Q["curate_sales"] = over(STAGED, f"""
SELECT s.product_id, s.category, s.region, s.store_id, date, {dbl('price')} AS price, {dbl('discount')} AS discount,
       units_sold, {dbl('revenue')} AS revenue,
       CAST(day(date) AS INT) AS sale_day, CAST(month(date) AS INT) AS sale_month, CAST(year(date) AS INT) AS sale_year,
       CAST(quarter(date) AS INT) AS sale_quarter, CAST(isodow(date) - 1 AS INT) AS weekday_num,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, strftime(date, '%Y-%m') AS year_month,
       {dbl('ROUND(price * (100 - discount) * 0.01, 2)')} AS net_price, {dbl('price * discount')} AS price_x_discount,
       ROUND(p.a, 6) AS avg_units_by_product, ROUND(p.d, 6) AS std_units_by_product, {dbl('p.r')} AS total_revenue_by_product,
       ROUND(c.a, 6) AS avg_units_by_category, ROUND(g.a, 6) AS avg_units_by_region, ROUND(t.a, 6) AS avg_units_by_store
FROM staged s
JOIN (SELECT product_id, AVG(units_sold) AS a, COALESCE(stddev_samp(units_sold), 0) AS d, SUM(revenue) AS r FROM staged GROUP BY 1) p
  ON s.product_id = p.product_id
JOIN (SELECT category, AVG(units_sold) AS a FROM staged GROUP BY 1) c ON s.category = c.category
JOIN (SELECT region, AVG(units_sold) AS a FROM staged GROUP BY 1) g ON s.region = g.region
JOIN (SELECT store_id, AVG(units_sold) AS a FROM staged GROUP BY 1) t ON s.store_id = t.store_id""")

# alerts on daily figures

Q["alert_discount"] = over(SALES, f"""
SELECT product_id, store_id, region, date, {dbl('price')} AS price, {dbl('discount')} AS discount, units_sold
FROM sales WHERE discount > 40""")
Q["daily_revenue"] = over(SALES, f"SELECT date, {REV} AS revenue, COUNT(*) AS records FROM sales GROUP BY date")
DROP_ALERT = f"""
, daily AS (SELECT date, SUM(revenue) AS revenue FROM sales GROUP BY date),
weekly AS (SELECT date, {dbl('revenue')} AS revenue,
  {dbl('SUM(revenue) OVER w')} / COUNT(revenue) OVER w AS mean_before
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT date, revenue, ROUND(mean_before, 6) AS mean_before FROM weekly WHERE revenue < 0.8 * mean_before"""
Q["alert_revenue_drop"] = over(SALES, DROP_ALERT)
STREAK = """
, daily AS (SELECT product_id, date, SUM(units_sold) AS units FROM sales GROUP BY product_id, date),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY date) AS nth,
                    SUM(CASE WHEN units > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY date) AS run FROM daily)
SELECT product_id, MIN(date) AS first_day, MAX(date) AS last_day, COUNT(*) AS days
FROM numbered WHERE units = 0 GROUP BY product_id, run HAVING COUNT(*) >= 2"""
STREAK_DEFAULT = STREAK.replace("COUNT(*) >= 2", "COUNT(*) >= 3")
Q["alert_zero_streak"] = over(SALES, STREAK)
Q["alert_zero_streak_default"] = over(SALES, STREAK_DEFAULT)

_money = "format('{:,.2f}', CAST(SUM(revenue) AS DOUBLE))"
Q["overview_text"] = over(SALES, f"""
SELECT 'Total Records: ' || format('{{:,}}', COUNT(*)) || ' | Total Revenue: $' || {_money} || ' | Total Units Sold: '
       || format('{{:,}}', CAST(SUM(units_sold) AS BIGINT)) || ' | Unique Products: ' || COUNT(DISTINCT product_id)
       || ' | Unique Stores: ' || COUNT(DISTINCT store_id) || ' | Date Range: ' || MIN(date) || ' to ' || MAX(date) AS line
FROM sales""")
Q["category_lines"] = over(SALES, f"""
SELECT category, category || ': $' || {_money} AS line FROM sales GROUP BY category""")
Q["product_text"] = over(SALES, f"""
SELECT 'Product PROD_7: Revenue=$' || {_money} || ' | Units=' || format('{{:,}}', CAST(SUM(units_sold) AS BIGINT))
       || ' | Avg Price=$' || printf('%.2f', {avg2('price')}) || ' | Avg Discount=' || printf('%.1f', ROUND(AVG(discount), 1))
       || '% | Records=' || COUNT(*) AS line
FROM sales WHERE product_id = 'PROD_7'""")

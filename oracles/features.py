"""Oracle queries for the model features."""

from __future__ import annotations

from oracles.tables import SALES, dbl

Q: dict[str, str] = {}

KEYS = f"product_id, store_id, region, date, units_sold, {dbl('discount')} AS discount"
SEQ = "PARTITION BY product_id ORDER BY date, store_id, region, units_sold, discount"


def _prior(n: int) -> str:
    return f"({SEQ} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


MEDIAN = SALES + """,
med AS (SELECT quantile_cont(CAST(units_sold AS DOUBLE), 0.5) AS m FROM sales)"""

_lags = ", ".join(
    f"COALESCE(CAST(LAG(units_sold, {n}) OVER ({SEQ}) AS DOUBLE), m) AS units_lag_{n}" for n in (1, 7, 14, 30)
)
_avgs = ", ".join(f"COALESCE(AVG(units_sold) OVER {_prior(n)}, m) AS roll_avg_{n}" for n in (7, 14, 30))
SEQUENCED = MEDIAN + f""",
seq AS (
  SELECT sales.*, {_lags}, {_avgs},
         COALESCE(stddev_samp(units_sold) OVER {_prior(7)}, 0) AS roll_std_7,
         COALESCE(CAST(MAX(units_sold) OVER {_prior(7)} AS DOUBLE), m) AS roll_high_7,
         COALESCE(CAST(MIN(units_sold) OVER {_prior(7)} AS DOUBLE), m) AS roll_low_7
  FROM sales, med
)"""
SEQ_COLUMNS = ["units_lag_1", "units_lag_7", "units_lag_14", "units_lag_30",
               "roll_avg_7", "roll_avg_14", "roll_avg_30", "roll_std_7", "roll_high_7", "roll_low_7"]

Q["unit_lags"] = f"WITH {SEQUENCED} SELECT {KEYS}, {', '.join(SEQ_COLUMNS[:4])} FROM seq"
Q["rolling_units"] = f"""WITH {SEQUENCED}
SELECT {KEYS}, {', '.join(f'ROUND({n}, 6) AS {n}' for n in SEQ_COLUMNS[4:])},
       ROUND(COALESCE(roll_avg_7 / NULLIF(roll_avg_30, 0), 1), 6) AS momentum_ratio FROM seq"""

CODED = """,
labels_long AS (SELECT DISTINCT 'product_id' AS "column", product_id AS label FROM sales
  UNION SELECT DISTINCT 'category', category FROM sales
  UNION SELECT DISTINCT 'store_id', store_id FROM sales
  UNION SELECT DISTINCT 'region', region FROM sales),
codes AS (SELECT "column", label,
  CAST(ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INT) AS code FROM labels_long)"""
Q["encode_labels"] = f"WITH {SALES}{CODED} SELECT \"column\", label, code FROM codes"

FRAME = SEQUENCED + CODED + """,
full_rows AS (
  SELECT s.*, pa.a AS avg_units_by_product, pa.d AS std_units_by_product, st.a AS avg_units_by_store,
         ca.a AS avg_units_by_category, ca.p AS category_price, ra.a AS avg_units_by_region,
         cp.code AS product_code, cc.code AS category_code, cs.code AS store_code, cr.code AS region_code
  FROM seq s
  JOIN (SELECT product_id, AVG(units_sold) AS a, COALESCE(stddev_samp(units_sold), 0) AS d FROM sales GROUP BY 1) pa
    ON s.product_id = pa.product_id
  JOIN (SELECT store_id, AVG(units_sold) AS a FROM sales GROUP BY 1) st ON s.store_id = st.store_id
  JOIN (SELECT category, AVG(units_sold) AS a, AVG(CAST(price AS DOUBLE)) AS p FROM sales GROUP BY 1) ca ON s.category = ca.category
  JOIN (SELECT region, AVG(units_sold) AS a FROM sales GROUP BY 1) ra ON s.region = ra.region
  JOIN codes cp ON cp."column" = 'product_id' AND cp.label = s.product_id
  JOIN codes cc ON cc."column" = 'category' AND cc.label = s.category
  JOIN codes cs ON cs."column" = 'store_id' AND cs.label = s.store_id
  JOIN codes cr ON cr."column" = 'region' AND cr.label = s.region
)"""
PRICE = "CAST(price AS DOUBLE)"
FEATURE_SQL = {
    "sale_day": "CAST(day(date) AS INT)", "sale_month": "CAST(month(date) AS INT)", "sale_year": "CAST(year(date) AS INT)",
    "weekday_num": "CAST(isodow(date) - 1 AS INT)", "is_weekend_flag": "is_weekend",
    "sale_quarter": "CAST(quarter(date) AS INT)", "iso_week": "CAST(week(date) AS INT)",
    "early_month_flag": "CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END",
    "late_month_flag": "CASE WHEN day(date) >= 21 THEN 1 ELSE 0 END",
    "net_price": f"ROUND({PRICE} * (1 - discount / 100), 6)", "squared_discount": dbl("discount * discount"),
    "price_x_discount": f"ROUND({PRICE} * discount, 6)",
    "price_ratio_to_category": f"ROUND(COALESCE({PRICE} / NULLIF(category_price, 0), 1), 6)",
    **{n: f"ROUND({n}, 6)" for n in SEQ_COLUMNS},
    "momentum_ratio": "ROUND(COALESCE(roll_avg_7 / NULLIF(roll_avg_30, 0), 1), 6)",
    **{n: f"ROUND({n}, 6)" for n in ("avg_units_by_product", "std_units_by_product", "avg_units_by_store",
                                     "avg_units_by_category", "avg_units_by_region")},
    "lag1_to_product_ratio": "ROUND(COALESCE(units_lag_1 / NULLIF(avg_units_by_product, 0), 1), 6)",
    **{n: n for n in ("product_code", "category_code", "store_code", "region_code")},
}
Q["engineer_features"] = f"""WITH {FRAME}
SELECT {', '.join(f'{e} AS {n}' for n, e in FEATURE_SQL.items())}, {dbl('units_sold')} AS label FROM full_rows"""

_WINDOWED = "ROW_NUMBER() OVER (ORDER BY {order}) > floor(COUNT(*) OVER () * 0.8)"
for _name, _order in (
    ("holdout_split", "product_id, date, store_id, region, units_sold, discount"),
    ("holdout_split_by_date", "date, product_id, store_id, region, units_sold, discount"),
):
    Q[_name] = f"WITH {SALES} SELECT {KEYS}, {_WINDOWED.format(order=_order)} AS is_holdout FROM sales"

Q["evaluate_naive_forecast"] = f"""WITH {SEQUENCED},
scored AS (SELECT CAST(units_sold AS DOUBLE) AS y, roll_avg_30 AS p FROM seq)
SELECT ROUND(AVG(abs(y - p)), 6) AS mae, ROUND(sqrt(AVG((y - p) * (y - p))), 6) AS rmse,
       ROUND(1 - SUM((y - p) * (y - p)) / (SELECT SUM((y - a) * (y - a)) FROM scored, (SELECT AVG(y) AS a FROM scored)), 6) AS r2,
       COUNT(*) AS rows
FROM scored"""

Q["retrain_needed"] = f"SELECT * FROM ({Q['evaluate_naive_forecast']}) WHERE r2 < 0.70"

# one request per sale of the table: its own product, date, price, discount, store and region
Q["request_features"] = f"""WITH {SALES}{CODED}
SELECT s.product_id, date AS target_date, {PRICE} AS price, {dbl('discount')} AS discount, store_id, s.region,
       {', '.join(f'{FEATURE_SQL[n]} AS {n}' for n in ('sale_day', 'weekday_num', 'iso_week', 'net_price', 'price_x_discount'))},
       20.0::DOUBLE AS units_lag_1, 0.0::DOUBLE AS roll_std_7, 1.0::DOUBLE AS momentum_ratio,
       cp.code AS product_code, 0 AS category_code, cs.code AS store_code, cr.code AS region_code
FROM sales s
JOIN codes cp ON cp."column" = 'product_id' AND cp.label = s.product_id
JOIN codes cs ON cs."column" = 'store_id' AND cs.label = s.store_id
JOIN codes cr ON cr."column" = 'region' AND cr.label = s.region"""

Q["classify_anomalies"] = f"""WITH {SALES},
m AS (SELECT AVG(units_sold) * 2.0 AS cut FROM sales)
SELECT product_id, store_id, date, units_sold, {dbl('discount')} AS discount,
       CASE WHEN units_sold >= cut THEN 'High Sales Anomaly' ELSE 'Low Sales Anomaly' END AS anomaly_label,
       CASE WHEN units_sold >= cut AND discount >= 20 THEN 'Discount driven spike'
            WHEN units_sold >= cut THEN 'Unexpected sales spike'
            WHEN units_sold = 0 THEN 'Stockout — zero units sold' ELSE 'Low demand issue' END AS reason
FROM sales, m"""
Q["anomaly_label_counts"] = f"""WITH {SALES},
m AS (SELECT AVG(units_sold) * 2.0 AS cut FROM sales)
SELECT COUNT(*) AS total_anomalies, COUNT(*) FILTER (units_sold >= cut) AS high_sales_anomalies,
       COUNT(*) FILTER (units_sold < cut) AS low_sales_anomalies FROM sales, m"""

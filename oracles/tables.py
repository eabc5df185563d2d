"""Common table expressions that the oracle queries start from, in DuckDB SQL."""

from __future__ import annotations

SALES = """
sales0 AS (
  SELECT 'PROD_' || l_partkey AS product_id, p_type AS category, r_name AS region,
         'STORE_' || l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS date,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CAST(ROUND(l_discount * 500, 0) AS INT) AS discount,
         CAST(l_quantity AS INT) - 1 AS units_sold, l_orderkey
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
sales AS (
  SELECT product_id, category, region, store_id, date, price, discount, units_sold,
         CAST(ROUND(CAST(price AS DECIMAL(12,2)) * units_sold * (100 - discount) * 0.01, 2) AS DECIMAL(18,2)) AS revenue,
         CAST(ROUND(price * (100 - discount) * 0.01, 2) AS DECIMAL(12,2)) AS net_price,
         CAST(price * discount AS DECIMAL(14,2)) AS price_x_discount,
         isodow(date) - 1 AS weekday_num,
         CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         strftime(date, '%Y-%m') AS year_month
  FROM sales0
)"""

MESSY = SALES + """,
messy0 AS (
  SELECT product_id,
         CASE WHEN l_orderkey % 29 = 0 THEN 'Unknown'
              WHEN l_orderkey % 7 = 0 THEN lower('  ' || category || ' ') ELSE category END AS category,
         region, lower(store_id) AS store_id,
         CASE WHEN l_orderkey % 17 = 0 THEN 'not-a-date' ELSE CAST(date AS VARCHAR) END AS date,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE price END AS price,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 101 ELSE discount END AS discount,
         units_sold,
         CAST(ROUND(price * units_sold * (100 - discount) * 0.01, 2) AS DECIMAL(18,2)) AS revenue,
         l_orderkey
  FROM sales0
),
messy AS (
  SELECT * EXCLUDE (l_orderkey) FROM messy0
  UNION ALL
  SELECT * EXCLUDE (l_orderkey) FROM messy0 WHERE l_orderkey % 50 = 0
)"""

CATEGORIES = "('Economy', 'Large', 'Medium', 'Promo', 'Small', 'Standard')"
REGIONS = "('Africa', 'America', 'Asia', 'Europe', 'Middle East')"


def title(x: str) -> str:
    """Capitalise each word of a trimmed text."""
    t = f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


NORMAL = MESSY + f""",
normal AS (
  SELECT upper(trim(product_id)) AS product_id, {title('category')} AS category, {title('region')} AS region,
         upper(trim(store_id)) AS store_id, TRY_CAST(date AS DATE) AS date, price, discount, units_sold,
         revenue AS given_revenue
  FROM (SELECT DISTINCT * FROM messy)
)"""

STAGED = NORMAL + f""",
staged AS (
  SELECT product_id, category, region, store_id, date, price, COALESCE(discount, 0) AS discount, units_sold,
         CAST(ROUND(price * units_sold * (100 - COALESCE(discount, 0)) * 0.01, 2) AS DECIMAL(18,2)) AS revenue
  FROM normal
  WHERE date IS NOT NULL AND price > 0 AND units_sold >= 0 AND COALESCE(discount, 0) BETWEEN 0 AND 100
    AND category IN {CATEGORIES} AND region IN {REGIONS}
)"""

IMPUTED = NORMAL + f""",
medians AS (
  SELECT quantile_cont(CAST(price AS DOUBLE), 0.5) AS price_median,
         quantile_cont(CAST(units_sold AS DOUBLE), 0.5) AS units_median
  FROM normal WHERE date IS NOT NULL
),
imputed AS (
  SELECT product_id, category, region, store_id, date, price, discount, units_sold,
         price * units_sold * (100 - discount) / 100.0 AS revenue
  FROM (SELECT product_id, category, region, store_id, date,
               COALESCE(CAST(price AS DOUBLE), price_median) AS price,
               COALESCE(CAST(discount AS DOUBLE), 0.0) AS discount,
               COALESCE(CAST(units_sold AS DOUBLE), units_median) AS units_sold
        FROM normal, medians WHERE date IS NOT NULL)
  WHERE price > 0 AND units_sold >= 0 AND discount BETWEEN 0 AND 100
    AND category IN {CATEGORIES} AND region IN {REGIONS}
)"""


def avg2(x: str) -> str:
    """Exact half-up average to two places of a non-negative column with at most two decimals."""
    s = f"CAST(SUM({x}) * 100 AS HUGEINT)"
    n = f"COUNT({x})"
    return f"CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 100"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"

"""Oracle queries for the streams: what the same job says about the tables at rest."""

from __future__ import annotations

from oracles.sales import DROP_ALERT, Q as SALES_Q, STREAK, STREAK_DEFAULT
from oracles.tables import MESSY, SALES, dbl

Q: dict[str, str] = {
    "stream_ingest_staged": SALES_Q["stage_sales"],
    "land_raw_copy": f"""WITH {MESSY} SELECT product_id, category, region, store_id, date, {dbl('price')} AS price,
      {dbl('discount')} AS discount, units_sold, {dbl('revenue')} AS revenue FROM messy""",
    "stream_dedup": "SELECT * FROM events",
    "daily_revenue_stream": f"WITH {SALES} SELECT date, {dbl('SUM(revenue)')} AS revenue, COUNT(*) AS records "
    "FROM sales GROUP BY date",
    "stream_revenue_drop": f"WITH {SALES}{DROP_ALERT}",
    "stream_zero_streak": f"WITH {SALES}{STREAK}",
    "stream_zero_streak_default": f"WITH {SALES}{STREAK_DEFAULT}",
    "stream_alert_discount": SALES_Q["alert_discount"],
}

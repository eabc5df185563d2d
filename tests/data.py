"""Inline rows for the tests."""

SAMPLE = [
    ("PROD_001", "Electronics", "North", "STORE_A", "2024-01-10", 299.99, 10.0, 5, 1349.96),
    ("PROD_002", "Clothing", "South", "STORE_B", "2024-02-15", 49.99, 5.0, 12, 569.89),
    ("PROD_003", "Groceries", "East", "STORE_C", "2024-03-20", 12.50, 0.0, 30, 375.00),
    ("PROD_001", "Electronics", "West", "STORE_A", "2024-04-05", 299.99, 20.0, 8, 1919.94),
    ("PROD_002", "Clothing", "Central", "STORE_B", "2024-05-12", 49.99, 15.0, 20, 849.83),
]

# message -> agent
MESSAGES = [
    ("What is the total revenue this month?", "AnalyticsAgent"),
    ("Show me the top 5 products by revenue", "AnalyticsAgent"),
    ("What is the return policy for electronics?", "PolicyAgent"),
    ("What are the promotion rules?", "PolicyAgent"),
    ("Forecast demand for next week", "ForecastAgent"),
    ("Predict units sold for PROD_001", "ForecastAgent"),
    ("Show me anomaly detection results", "ForecastAgent"),
]

POLICY = {
    "returns.txt": "Any product may be returned within 30 days with a receipt. Electronics may be returned within 15 days. "
    "Groceries cannot be returned. Refunds take seven days.\nStore credit is given without a receipt. ",
    "discounts.txt": "A discount code works at checkout only. Promotions end with the season. A discount is never combined with "
    "another promotion. Members earn points. Clearance discount items are final.",
    "stock.txt": "Stock levels are checked daily. Inventory counts are logged with a reason code. Dead stock is donated.",
}


def row(**changes):
    """One valid raw row with some values changed."""
    base = dict(zip(
        ("product_id", "category", "region", "store_id", "date", "price", "discount", "units_sold", "revenue"),
        ("PROD_001", "Electronics", "North", "STORE_A", "2024-01-10", 100.0, 10.0, 5, 450.0),
    ))
    assert set(changes) <= set(base)
    return tuple({**base, **changes}.values())

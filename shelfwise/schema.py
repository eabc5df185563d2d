"""Table shapes and fixed values of the retail model."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# The columns of a sales row, in order.
MANDATORY_COLUMNS = (
    "product_id", "category", "region", "store_id", "date", "price", "discount", "units_sold", "revenue",
)

RAW_SCHEMA = StructType(
    [StructField(name, StringType()) for name in MANDATORY_COLUMNS[:5]]
    + [
        StructField("price", DoubleType()),
        StructField("discount", DoubleType()),
        StructField("units_sold", IntegerType()),
        StructField("revenue", DoubleType()),
    ]
)

TEXT_SCHEMA = StructType([StructField(name, StringType()) for name in MANDATORY_COLUMNS])

# Money types: exact decimals from staging on, doubles only at the output edge.
PRICE = "decimal(12,2)"
MONEY = "decimal(18,2)"

# Cleaned types: wide enough to hold what is delivered, to eight decimals.
CLEAN_PRICE = "decimal(24,8)"
CLEAN_PERCENT = "decimal(11,8)"
CLEAN_MONEY = "decimal(38,2)"

# The label sets a sales row may carry. Every cleaner takes them as a parameter.
CATEGORIES = (
    "Electronics", "Clothing", "Groceries", "Furniture", "Sports",
    "Beauty", "Toys", "Books", "Automotive", "Health",
)
REGIONS = (
    "North", "South", "East", "West", "Central",
    "Northeast", "Northwest", "Southeast", "Southwest",
)

# The model input, in model order.
FEATURES = (
    "sale_day", "sale_month", "sale_year", "weekday_num", "is_weekend_flag",
    "sale_quarter", "iso_week", "early_month_flag", "late_month_flag",
    "net_price", "squared_discount", "price_x_discount", "price_ratio_to_category",
    "units_lag_1", "units_lag_7", "units_lag_14", "units_lag_30",
    "roll_avg_7", "roll_avg_14", "roll_avg_30", "roll_std_7", "roll_high_7", "roll_low_7",
    "momentum_ratio",
    "avg_units_by_product", "std_units_by_product", "avg_units_by_store",
    "avg_units_by_category", "avg_units_by_region", "lag1_to_product_ratio",
    "product_code", "category_code", "store_code", "region_code",
)

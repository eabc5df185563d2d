"""Column expressions for sales rows. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.schema import MONEY, PRICE


def trimmed(name: str) -> Column:
    """Strip every kind of blank, not only spaces."""
    return F.btrim(F.col(name), F.lit(" \t\r\n\f\u000b"))


def identifier(name: str) -> Column:
    return F.upper(trimmed(name))


def label(name: str) -> Column:
    return F.initcap(trimmed(name))


def number(name: str, dtype: str = "double") -> Column:
    """Numeric value of a column of any type; text that is no number, and NaN, become null."""
    as_double = F.col(name).try_cast("double")
    return F.when(~F.isnan(as_double), F.col(name).try_cast(dtype))


def sale_date(name: str = "date") -> Column:
    """Date of a ``yyyy-MM-dd`` text (or of a date column); anything else becomes null.

    The cast alone would also take shorter and longer forms; it is much cheaper than a pattern parser.
    """
    text = F.col(name).cast("string")
    return F.when(text.like("____-__-__"), text.try_cast("date"))


def discounted(amount: Column) -> Column:
    """``amount`` less the row's discount percentage, without rounding."""
    return amount * (F.lit(100) - F.col("discount")) * F.lit("0.01").cast("decimal(2,2)")


def revenue(dtype: str = MONEY) -> Column:
    return F.round(discounted(F.col("price") * F.col("units_sold")), 2).cast(dtype)


def net_price(dtype: str = PRICE) -> Column:
    return F.round(discounted(F.col("price")), 2).cast(dtype)


def is_weekend(day: Column) -> Column:
    """1 on Saturday and Sunday."""
    return (F.weekday(day) >= 5).cast("int")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 1 where the denominator is zero or either side is missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(1.0))


def growth_pct(current: Column, previous: Column) -> Column:
    return (current - previous) / F.nullif(previous, F.lit(0)) * 100


def discount_band() -> Column:
    """Bands are closed whole-number ranges: a value in a gap, such as 10.5, falls to the last band."""
    discount = F.col("discount")
    return (
        F.when(discount == 0, "0% (No Discount)")
        .when(discount.between(1, 10), "1-10%")
        .when(discount.between(11, 20), "11-20%")
        .when(discount.between(21, 30), "21-30%")
        .otherwise("30%+")
    )


def day_type() -> Column:
    return F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday")


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def rounded(value: Column, digits: int = 2) -> Column:
    """Half-up rounding, handed out as a double."""
    return F.round(value, digits).cast("double")

"""CURATED rows: date and price columns, and the averages of the groups a row belongs to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as c
from shelfwise.schema import CLEAN_MONEY
from shelfwise.session import written_for_now

TURN_ROWS, MOST_TURNS = 1_000_000, 8  # rows curated at a time, unless that makes more turns


def date_parts() -> dict[str, Column]:
    day = F.col("date")
    return {
        "sale_day": F.dayofmonth(day),
        "sale_month": F.month(day),
        "sale_year": F.year(day),
        "sale_quarter": F.quarter(day),
        "weekday_num": F.weekday(day),
        "is_weekend": c.is_weekend(day),
        "year_month": F.date_format(day, "yyyy-MM"),
    }


def with_date_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(date_parts())


def with_price_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "net_price": c.net_price(CLEAN_MONEY),
            "price_x_discount": F.round(F.col("price") * F.col("discount"), 2).cast(CLEAN_MONEY),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    return with_price_columns(with_date_parts(df))


def product_aggregates(df: DataFrame) -> DataFrame:
    """Average, sample standard deviation (0 for a single row) and revenue of each product."""
    return df.groupBy("product_id").agg(*_product_units(), F.sum("revenue").alias("total_revenue_by_product"))


def product_units(df: DataFrame) -> DataFrame:
    """``product_aggregates`` of rows without revenue."""
    return df.groupBy("product_id").agg(*_product_units())


def _product_units() -> list[Column]:
    return [
        F.avg("units_sold").alias("avg_units_by_product"),
        F.coalesce(F.stddev_samp("units_sold"), F.lit(0.0)).alias("std_units_by_product"),
    ]


def average_units(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg("units_sold").alias(name))


GROUP_AVERAGES = {
    "category": "avg_units_by_category",
    "region": "avg_units_by_region",
    "store_id": "avg_units_by_store",
}


def group_figures(staged: DataFrame) -> dict[str, DataFrame]:
    """The figures of each dimension's groups, a row a group."""
    averages = {key: average_units(staged, key, name) for key, name in GROUP_AVERAGES.items()}
    return {"store_id": averages["store_id"], "product_id": product_aggregates(staged), "category": averages["category"], "region": averages["region"]}


def curate_sales(
    staged: DataFrame, lay: Callable[[DataFrame], DataFrame] | None = None, figures: dict[str, DataFrame] | None = None
) -> DataFrame:
    """STAGED to CURATED, 24 columns.

    Each aggregate is combined map-side before its shuffle, so a product holding a third of the rows
    adds one partial row per task. The joins carry no hint: AQE broadcasts a dimension it has measured
    to be small, and otherwise splits the partitions of a heavy key. Pass the written STAGED table, so
    that the five reads of it are column-pruned scans and not five cleanings.

    The rows are shuffled with the staged columns only: stores come first, as they add one column, and what a row
    tells of itself is computed last. ``lay`` may place the rows for a write, by ``sale_year`` and ``sale_month`` too.
    ``figures`` gives the groups' figures where the rows are only some of those they are to be taken from.
    """
    rows = staged
    for key, groups in (figures or group_figures(staged)).items():
        rows = rows.join(groups, key, "left")
    aggregates = [n for n in rows.columns if n not in staged.columns]
    rows = rows.fillna(0.0, subset=aggregates)
    placing = {n: e for n, e in date_parts().items() if n in ("sale_year", "sale_month")} if lay else {}
    rows = lay(rows.withColumns(placing)) if lay else rows
    rows = with_price_columns(rows.withColumns({n: e for n, e in date_parts().items() if n not in placing}))
    keys = ["store_id", "region", "category", "product_id"]
    own = [n for n in (*staged.columns, *date_parts(), "net_price", "price_x_discount") if n not in keys]
    groups = ("avg_units_by_category", "avg_units_by_region", "avg_units_by_store")
    return rows.select(*keys, *own, *[n for n in aggregates if n not in groups], *groups)


def month_turns(staged: DataFrame, turn_rows: int = TURN_ROWS, most: int = MOST_TURNS) -> list[tuple[Column, bool]]:
    """Conditions that deal all rows out to turns of about as many rows, and whether a turn goes on with a month of the one before.

    A turn has whole months; a month that is larger than a turn by itself comes in parts, by a hash of its rows.
    """
    month = F.coalesce(F.year("date") * 12 + F.month("date"), F.lit(-1))
    counts = sorted(map(tuple, staged.groupBy(month).count().collect()))  # a row a month
    share = max(turn_rows, -(-sum(n for _, n in counts) // most))
    turns: list[tuple[Column, bool]] = []
    room = 0
    for number, rows in counts:
        if rows > share:
            part = F.pmod(F.xxhash64(*staged.columns), F.lit(-(-rows // share)))
            held = sorted(r[0] for r in staged.where(month == number).groupBy(part).count().collect())  # a row a part
            turns.extend(((month == number) & (part == p), p != held[0]) for p in held)
            room = 0
        elif rows > room:
            turns.append((month == number, False))
            room = share - rows
        else:
            turns[-1] = (turns[-1][0] | (month == number), False)
            room -= rows
    return turns or [(F.lit(True), False)]


def curated_in_turn(staged: DataFrame, lay: Callable[[DataFrame], DataFrame], **sizes: int) -> Iterator[tuple[DataFrame, bool]]:
    """``curate_sales`` of all rows, some months at a time, to be written one after another, marked as by ``month_turns``.

    What a turn shuffles may go before the next one begins, so the disk holds a turn's shuffles and not those of all rows. The
    groups' figures are of all rows and written once, and deleted after the last turn.
    """
    with ExitStack() as tables:
        figures = {key: tables.enter_context(written_for_now(groups)) for key, groups in group_figures(staged).items()}
        for turn, goes_on in month_turns(staged, **sizes):
            yield curate_sales(staged.where(turn), lay, figures), goes_on

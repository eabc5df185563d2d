"""What the sales jobs shuffle, seen in their plans."""

import os
import re

from pyspark.sql import functions as F

from shelfwise.operators import curation, features
from shelfwise.operators.ordering import row_windows
from shelfwise.plans import analytics as a
from shelfwise.session import shared_folder, written, written_for_now
from shelfwise.sources import star, writers

SF = "/root/testdata/sf0.001"


def lines_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def depth(lines, mark):
    return next(len(re.match(r"[ :+|-]*", line)[0]) for line in lines if "Join" in line and mark in line)


def staged(spark):
    rows = [("P1", "C", "R", "S1", "2024-01-05", "2.00", 10, 3, "5.40"), (None, "C", "R", "S2", "2024-02-05", "1.00", 0, 2, "2.00"), ("P1", None, "Q", "S1", None, "2.00", 0, 1, "2.00")]
    df = spark.createDataFrame(rows, "product_id string, category string, region string, store_id string, date string, price string, discount int, units_sold int, revenue string")
    return df.withColumns({"date": F.col("date").cast("date"), "price": F.col("price").cast("decimal(18,2)"), "revenue": F.col("revenue").cast("decimal(38,2)")})


def test_line_items_are_not_shuffled_by_customer(spark):
    lines = lines_of(star.sales(spark, SF))
    assert depth(lines, "o_custkey") > depth(lines, "l_orderkey")


def test_curated_columns_come_after_the_joins(spark):
    lines = lines_of(curation.curate_sales(staged(spark)))
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert joins and all(i < joins[0] for i, line in enumerate(lines) if "date_format" in line)


def test_curated_rows_placed_for_the_write_are_the_same(spark, tmp_path):
    plain, laid = curation.curate_sales(staged(spark)), curation.curate_sales(staged(spark), writers.laid_out)
    assert plain.schema == laid.schema and len(plain.columns) == 24
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, laid.collect()))
    writers.write_curated_partitioned(laid, f"{tmp_path}/t", laid=True)
    got = spark.read.parquet(f"{tmp_path}/t").select(*plain.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_top_products_deals_no_row_out_thrice(spark):
    df = staged(spark).unionAll(staged(spark).withColumn("store_id", F.lit("S3")))
    top = a.top_products(df, 3)
    got = [(r.product_id, r.category, r.total_units, r.stores_selling, r.regions_present) for r in top.collect()]
    assert got == [("P1", "C", 6, 2, 1), (None, "C", 4, 2, 1), ("P1", None, 2, 2, 1)]
    expands = [i for i, line in enumerate(lines_of(top)) if "Expand" in line]
    assert all("Filter" in "".join(lines_of(top)[i:]) for i in expands)
    assert not [r for r in a.top_products(df.limit(0)).collect()]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "/shuffle_" in name}


def tables(spark):
    folder = f"{shared_folder(spark).removeprefix('file:')}/tables"
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    assert written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    left = {re.search(r"shuffle_(\d+)_", name)[1] for name in shuffle_files(spark) - before}
    assert len(left) <= 1  # that of the count itself


def test_a_table_for_now_goes(spark):
    before = tables(spark)
    with written_for_now(spark.range(3)) as rows:
        assert rows.count() == 3 and len(tables(spark) - before) == 1
    assert tables(spark) == before


def test_features_shuffle_rows_narrow_and_once_for_windows_and_products(spark):
    """Calendar and price columns are computed behind all shuffles, and the join with the products' figures adds no shuffle of the rows."""
    rows = star.sales(spark, SF)
    before = tables(spark)
    found = features.engineer_features(rows, block_rows=400)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    window = next(i for i, line in enumerate(plan) if "Window" in line)
    assert not [line for line in plan[window:] if "weekofyear" in line or "sale_month" in line]
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\((?:store_id|category|region)#\d+, ", physical)
    read = "".join(found.inputFiles())
    assert len([t for t in tables(spark) - before if t in read]) == 2  # the numbered rows and the products' figures
    assert found.count() == rows.count()


def test_columns_beside_the_rows_of_a_key(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(9)] + [("a", 3)], "k string, i int")
    facts = spark.createDataFrame([("a", 1.5), ("c", 2.5)], "k string, fact double")
    got = row_windows(rows, "k", ["i"], lambda w: {"last": F.lag("i").over(w)}, 1, 4, beside=facts).collect()
    assert len(got) == 28 and {(r.k, r.fact) for r in got} == {("a", 1.5), ("b", None), (None, None)}
    assert sorted((r.k or "", r.last) for r in got if r.i == 5) == [("", 4), ("a", 4), ("b", 4)]


def months(spark):
    rows = [(f"P{i % 3}", "C", "R", f"S{i % 2}", f"2024-{m:02d}-05", "2.00", 10, i, "5.40") for m, n in ((1, 2), (2, 9), (3, 3), (4, 1)) for i in range(n)]
    rows += [("P1", None, "R", "S1", None, "2.00", 0, 1, "2.00"), (None, "C", "R", "S1", "2024-02-07", "2.00", 0, 1, "2.00")]
    df = spark.createDataFrame(rows, "product_id string, category string, region string, store_id string, date string, price string, discount int, units_sold int, revenue string")
    return df.withColumns({"date": F.col("date").cast("date"), "price": F.col("price").cast("decimal(18,2)"), "revenue": F.col("revenue").cast("decimal(38,2)")})


def test_turns_hold_each_row_once(spark):
    df = months(spark)
    turns = curation.month_turns(df, 4, 100)
    counts = [df.where(turn).count() for turn, _ in turns]
    assert sum(counts) == df.count() == 17 and len(turns) > 4
    for i, n in enumerate(df.select([F.count_if(turn).alias(f"t{i}") for i, (turn, _) in enumerate(turns)]).first()):
        assert n == counts[i] > 0
    assert len(curation.month_turns(df, 4, 1)) == 1 == len(curation.month_turns(df.limit(0)))
    alike = df.where("date = '2024-04-05'")
    assert len(curation.month_turns(alike.unionAll(alike).unionAll(alike), 1, 100)) == 1


def test_curated_in_turns_are_the_rows_curated_at_once(spark, tmp_path):
    df, path = months(spark), f"{tmp_path}/t"
    plain = curation.curate_sales(df)
    want, before = sorted(map(repr, map(tuple, plain.collect()))), tables(spark)
    for _ in range(2):  # again: every month is replaced
        writers.write_curated_in_turn(df, path, turn_rows=4, most=100)
        spark.catalog.refreshByPath(path)
        got = spark.read.parquet(path).select(*plain.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == want
    assert tables(spark) == before
    writers.write_curated_in_turn(df.where("date < '2024-02-01'"), path)
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).count() == len(want)  # other months stay

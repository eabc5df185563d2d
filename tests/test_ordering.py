"""Skew-safe building blocks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators.features import REACH, SEQUENCE, holdout_split, rolling_units, sequence_features, unit_lags
from shelfwise.operators.ordering import global_position, row_windows
from shelfwise.operators.quantiles import boundary, exact_quantile, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One product holds most rows."""
    rng = random.Random(7)
    rows = [
        (f"P{0 if rng.random() < 0.6 else rng.randrange(12)}", f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
         f"S{rng.randrange(4)}", "North", rng.randrange(50), rng.randrange(0, 40, 5), i)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "product_id string, date string, store_id string, region string, units_sold int, discount int, price int")
    return df.withColumn("date", F.to_date("date")).dropDuplicates(["product_id", *SEQUENCE]).repartition(6).cache()


def test_global_position_is_the_sorted_order(skewed):
    order = ["product_id", *SEQUENCE]
    got = [tuple(r[n] for n in order) for r in global_position(skewed, order, partitions=5).orderBy("position").collect()]
    assert got == sorted(got)
    positions = [r.position for r in global_position(skewed, order, partitions=5).select("position").collect()]
    assert sorted(positions) == list(range(skewed.count()))


def test_equal_rows_get_distinct_positions(spark):
    df = spark.range(1000).select(F.lit(1).alias("k")).repartition(7)
    positions = [r.position for r in global_position(df, ["k"], partitions=4).collect()]
    assert sorted(positions) == list(range(1000))


def plain_windows(rows):
    """Lags and rolling figures of each product's rows, one by one."""
    out, past = [], {}
    for r in sorted(rows, key=lambda r: tuple((r[n] is not None, r[n]) for n in ("product_id", *SEQUENCE))):
        seen = past.setdefault(r.product_id, [])
        lag = lambda n: float(seen[-n]) if len(seen) >= n else None
        week = seen[-7:]
        out.append((
            r.price, *[lag(n) for n in (1, 7, 14, 30)], *[round(float(np.mean(seen[-n:])), 6) if seen else None for n in (7, 14, 30)],
            round(float(np.std(week, ddof=1)), 6) if len(week) > 1 else None, float(max(week)) if week else None, float(min(week)) if week else None,
        ))
        seen.append(r.units_sold)
    return sorted(out)


def built(w):
    return {**unit_lags(w), **rolling_units(w)}


@pytest.mark.parametrize("block_rows", [REACH + 1, 64, 500, 1_000_000])
@pytest.mark.parametrize("keys", ["one", "skewed", "missing", "many"])
def test_windows_equal_plain_ones_for_any_keys_and_blocks(skewed, block_rows, keys):
    own = {"one": F.lit("P"), "skewed": F.col("product_id"), "missing": F.nullif("product_id", F.lit("P0")), "many": F.concat(F.lit("P"), F.col("price") % 400)}
    df = skewed.withColumn("product_id", own[keys])
    df = df.dropDuplicates(["product_id", *SEQUENCE])
    got = row_windows(df, "product_id", SEQUENCE, built, REACH, block_rows=block_rows)
    assert got.columns[: len(df.columns)] == df.columns
    new = [n for n in got.columns if n not in df.columns]
    rows = sorted(tuple(r) for r in got.select("price", *[F.round(n, 6) for n in new]).collect())
    assert rows == plain_windows(df.collect())


def test_one_plan_whatever_the_keys_hold(skewed):
    def plan(df):
        text = sequence_features(df, F.lit(1.0))._jdf.queryExecution().optimizedPlan().toString()
        return [line.strip(" +-:").split(" ")[0] for line in text.splitlines()]

    assert plan(skewed.withColumn("product_id", F.lit("P"))) == plan(skewed.withColumn("product_id", F.col("price").cast("string")))


def test_too_small_blocks_are_refused(skewed):
    with pytest.raises(ValueError):
        row_windows(skewed, "product_id", SEQUENCE, unit_lags, REACH, block_rows=REACH)


@pytest.mark.parametrize("rank", [0, 1, 700, 1234])
def test_boundary_is_the_row_of_that_rank(skewed, rank):
    order = ["product_id", *SEQUENCE]
    bare = skewed.withColumn("product_id", F.nullif("product_id", F.lit("P3")))
    rows = sorted((tuple(r) for r in bare.select(*order).collect()), key=lambda r: tuple((v is not None, v) for v in r))
    assert tuple(boundary(bare.select(*order), order, rank).values()) == rows[rank]
    assert boundary(bare, order, len(rows)) is None and boundary(bare.limit(0), order, 0) is None


@pytest.mark.parametrize("mode", ["positional", "chronological"])
def test_holdout_has_no_sort(skewed, mode):
    split = holdout_split(skewed, 0.3, mode)
    n = skewed.count()
    assert split.where("is_holdout").count() == n - int(n * 0.7)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.split("InMemoryRelation")[0] and "Exchange" not in plan.split("InMemoryRelation")[0]
    assert not holdout_split(skewed.limit(0), 0.3, mode).collect()


def test_quantile_passes_shuffle_counts_of_digits_only(spark):
    """Of a column of distinct values no shuffle carries the values: each task sends 65,536 counts at most."""
    rng = np.random.default_rng(2)
    values = [-0.0, 0.0, -1e-300, 1e300, -1e300, float("inf"), -float("inf"), 5e-324, *rng.normal(size=5000).tolist(), *(-np.exp(rng.normal(size=500) * 50)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for q in (0.0, 0.013, 0.5, 0.77, 1.0):
        ordered = np.sort(values)
        at = q * (len(values) - 1)
        a, b = ordered[int(at)], ordered[-int(-at // 1)]
        assert exact_quantile(df, "v", q).first()[0] == pytest.approx(a + (b - a) * (at - int(at)) if a != b else a, rel=1e-12)
    big = spark.createDataFrame([(v,) for v in (-(1 << 62), 3, 1 << 62)], "v long")
    assert [exact_quantile(big, "v", q).first()[0] for q in (0.0, 0.5, 1.0)] == [-float(1 << 62), 3.0, float(1 << 62)]


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.95, 0.99, 1.0])
def test_exact_quantile_matches_linear_interpolation(spark, q):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(2000, 7.25), rng.normal(size=1500) * 1e4, rng.integers(0, 5, 500)])
    rows = [(float(v),) for v in values] + [(None,)]
    df = spark.createDataFrame(rows, "v double").repartition(5)
    got = exact_quantile(df, "v", q).first()[0]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_quantiles_with_weights_and_without_rows(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (2, 20.0, 3)], "a int, b double, w int")
    assert exact_quantile(df, "b", 0.5, weight="w").first()[0] == 20.0
    got = exact_quantiles(df, {"a": 0.5, "b": 0.0}).first()
    assert (got.a, got.b) == (1.5, 10.0)
    assert exact_quantile(df.where("a > 9"), "a", 0.5).first()[0] is None


def test_one_absurd_value_does_not_gather_the_others_in_one_task(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(1e300,)], "v double"))
    values = np.array([*range(20_000), 1e300], float)
    assert exact_quantile(df, "v", 0.25).first()[0] == pytest.approx(np.quantile(values, 0.25))
    parts = df.groupBy("v").count().repartitionByRange(4, "v").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 0.6 * len(values)

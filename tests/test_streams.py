"""Streams over several deliveries equal the batch job over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import alerts as batch
from shelfwise.operators.cleaning import normalise, stage_sales
from shelfwise.schema import RAW_SCHEMA
from shelfwise.sources import readers
from shelfwise.streaming import alerts, ingest, levels
from shelfwise.streaming.runs import run_to_table, spread_by_rows
from tests.data import SAMPLE, row
from tests.test_sinks import csv_text

SALES = "product_id string, date string, units_sold int, revenue double"


def test_staged_stream_over_deliveries(spark, tmp_path):
    landing, work = tmp_path / "landing", str(tmp_path / "work")
    landing.mkdir()
    deliveries = [SAMPLE, [SAMPLE[0], row(date="bad"), row(price=None)], [row(date="2020-01-01"), row(product_id=" prod_001"), SAMPLE[4]]]
    for i, rows in enumerate(deliveries):
        (landing / f"{i}.csv").write_text(csv_text(rows))
        staged = ingest.stream_ingest_staged(readers.stream_sales_csv(spark, str(landing), 1), work, f"{work}/cp")
    everything = spark.createDataFrame([r for d in deliveries for r in d], RAW_SCHEMA)
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, stage_sales(everything).collect()))


def test_raw_copy_is_incremental(spark, tmp_path):
    landing, raw = tmp_path / "landing", str(tmp_path / "raw")
    landing.mkdir()
    for i in range(2):
        (landing / f"{i}.csv").write_text(csv_text(SAMPLE))
        ingest.land_raw_copy(readers.stream_sales_csv(spark, str(landing)), raw, str(tmp_path / "cp"))
        assert spark.read.parquet(raw).count() == 5 * (i + 1)


def _stream(spark, tmp_path, deliveries, schema=SALES):
    folder = tmp_path / "in"
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream.withColumn("date", F.to_date("date")).withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))


def _days(units, start=1, product="P"):
    return [(product, f"2024-01-{start + i:02d}", u, float(100 * u)) for i, u in enumerate(units)]


def test_zero_streak_across_deliveries(spark, tmp_path):
    days = [_days([5, 0, 0]), _days([0, 0, 3], 4), _days([0, 0, 0, 1, 1], 7)]
    stream = _stream(spark, tmp_path, days)
    got = alerts.stream_zero_streak(stream, str(tmp_path / "w"), str(tmp_path / "cp"), days=3).collect()
    assert sorted((str(r.first_day), str(r.last_day), r.days) for r in got) == [
        ("2024-01-02", "2024-01-05", 4), ("2024-01-07", "2024-01-09", 3),
    ]


def test_streaks_over_month_ends_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    days = [(p, m, d) for p in "PQRST" for m in (1, 2, 3, 5, 6) for d in range(1, 29) if rng.random() < (0.9 if p != "T" else 0.15)]
    rows = [(p, f"2024-{m:02d}-{d:02d}", rng.choice([0, 0, 0, 5]) if p < "S" else 0 if m != 3 else 1, 1.0) for p, m, d in days]
    rows += [("P", None, 0, 1.0), ("Q", None, 3, 1.0), (None, "2024-01-31", 0, 1.0), (None, "2024-02-01", 0, 1.0), ("P", "2024-01-30", None, 1.0)]
    rng.shuffle(rows)
    stream = _stream(spark, tmp_path, [rows[i::3] for i in range(3)])
    still = spark.createDataFrame(rows, SALES).withColumn("date", F.to_date("date"))
    for n in (1, 3):
        got = alerts.stream_zero_streak(stream, str(tmp_path / f"w{n}"), str(tmp_path / f"cp{n}"), n)
        want = batch.alert_zero_streak(batch.daily_units(still), n)
        columns = ["product_id", "first_day", "last_day", "days"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert any(r.first_day.month < r.last_day.month for r in got.where("days > 5").collect())


def test_a_batch_reads_the_days_of_its_months_only(spark, tmp_path):
    work, checkpoint = str(tmp_path / "w"), str(tmp_path / "cp")
    january, march = _days([0, 0, 0, 1]), [("P", f"2024-03-{d:02d}", 0, 0.0) for d in range(1, 6)]
    alerts.stream_zero_streak(_stream(spark, tmp_path, [january]), work, checkpoint)
    for file in (tmp_path / "w" / "product_days" / "sales_month=m2024-01").rglob("*.parquet"):
        file.write_bytes(b"no longer a table")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    got = alerts.stream_zero_streak(_stream(spark, tmp_path, [march]), work, checkpoint).collect()
    assert sorted((str(r.first_day), r.days) for r in got) == [("2024-01-01", 3), ("2024-03-01", 5)]


def test_batch_zero_streak(spark):
    rows = spark.createDataFrame(_days([5, 0, 0, 0, 1, 0, 0]) + _days([0, 0, 0], product="Q"), SALES).withColumn("date", F.to_date("date"))
    got = batch.alert_zero_streak(batch.daily_units(rows), days=3).collect()
    assert sorted((r.product_id, r.days) for r in got) == [("P", 3), ("Q", 3)]


def test_revenue_drop_across_deliveries(spark, tmp_path):
    days = [_days([10, 10, 10]), _days([10, 2, 10], 4), _days([9, 7, 1, 1], 7)]
    stream = _stream(spark, tmp_path, days)
    got = alerts.stream_revenue_drop(stream, str(tmp_path / "w"), str(tmp_path / "cp")).collect()
    rows = spark.createDataFrame([r for d in days for r in d], SALES).withColumn("date", F.to_date("date"))
    want = batch.alert_revenue_drop(batch.daily_revenue(rows)).collect()
    assert sorted((r.date, r.revenue) for r in got) == sorted((r.date, r.revenue) for r in want)
    assert len(got) == 3


KEYED = "key int, n long"


def _sums(df):
    return df.groupBy("key").agg(F.sum("n").alias("n"))


def _names(folder):
    return sorted(f.name for f in folder.iterdir() if f.is_dir())


def test_levels_hold_all_batches_in_few_runs(spark, tmp_path):
    path, want = str(tmp_path / "sums"), {}
    for batch_id in range(30):
        rows = [] if batch_id == 4 else [(batch_id % 5, 1), (None, batch_id)]
        for key, n in rows:
            want[key] = want.get(key, 0) + n
        levels.add_batch(spark.createDataFrame(rows, KEYED), path, batch_id, _sums, KEYED, fan=3)
        assert {r.key: r.n for r in _sums(levels.read_runs(spark, path, KEYED)).collect()} == want
        assert len(levels.valid_runs(spark, path)[1]) <= 8 and len(_names(tmp_path / "sums" / "runs")) <= 16
        assert len(_names(tmp_path / "sums" / "lists")) <= 2
    assert [level for level, _ in levels.valid_runs(spark, path)[1]] == [3, 1]  # 27 + 3


def test_a_repeated_batch_counts_once_and_a_lost_one_not_at_all(spark, tmp_path):
    path = str(tmp_path / "sums")
    one = spark.createDataFrame([(1, 1)], KEYED)

    def total():
        return levels.read_runs(spark, path, KEYED).agg(F.sum("n")).first()[0]

    for batch_id in (0, 1, 1, 0):
        levels.add_batch(one, path, batch_id, _sums, KEYED, fan=3)
    assert total() == 2

    def lost(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        levels.add_batch(one, path, 2, lost, KEYED, fan=3)  # the third run, so the three are merged
    assert total() == 2 and levels.valid_runs(spark, path)[0] == 1
    levels.add_batch(one, path, 2, _sums, KEYED, fan=3)
    assert total() == 3 and [level for level, _ in levels.valid_runs(spark, path)[1]] == [1]


def test_alerts_of_the_newest_batch_are_kept_with_one_before(spark, tmp_path):
    for batch_id in range(4):
        found = spark.createDataFrame([(batch_id,)] if batch_id < 3 else [], "n int")
        levels.replace_version(found, str(tmp_path / "v"), batch_id)
        got = levels.read_version(spark, str(tmp_path / "v"), batch_id, "n int").collect()
        assert [r.n for r in got] == ([batch_id] if batch_id < 3 else [])
    assert _names(tmp_path / "v") == ["batch=2", "batch=3"]
    assert levels.read_version(spark, str(tmp_path / "none"), -1, "n int").count() == 0


def test_stream_dedup(spark, tmp_path):
    rows = [("a", "2024-01-01", 1, 1.0), ("a", "2024-01-01", 1, 1.0), ("b", "2024-01-01", 1, 1.0)]
    stream = _stream(spark, tmp_path, [rows, rows]).withColumn("time", F.col("date").cast("timestamp"))
    run_to_table(ingest.stream_dedup(stream, ["product_id"], "time", "1 day"), str(tmp_path / "o"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_stream_discount_alert_is_stateless(spark, tmp_path):
    stream = normalise(readers.stream_sales_csv(spark, str(tmp_path)))
    assert batch.alert_discount(stream).isStreaming


@pytest.mark.parametrize("units,expected", [([0, 0], 0), ([0, 0, 0], 1)])
def test_streak_threshold(spark, units, expected):
    rows = spark.createDataFrame(_days(units), SALES).withColumn("date", F.to_date("date"))
    assert batch.alert_zero_streak(batch.daily_units(rows)).count() == expected


@pytest.mark.parametrize("files,per_trigger", [(1, 1), (8, 1), (8, 3)])
def test_streams_equal_the_batch_for_any_files_and_order(spark, tmp_path, files, per_trigger):
    rng = random.Random(files)
    rows = [(f"P{rng.randrange(4)}", f"2024-01-{rng.randrange(1, 29):02d}", rng.choice([0, 0, 0, 5]), rng.random() * 100) for _ in range(400)]
    for i in range(files):
        spark.createDataFrame(rows[i::files], SALES).coalesce(1).write.mode("append").parquet(str(tmp_path / "sales.parquet"))

    def shaped(df):
        return df.withColumn("date", F.to_date("date")).withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))

    def stream():
        return shaped(readers.stream_table(spark, str(tmp_path), "sales", per_trigger))

    def same(left, right):
        columns = sorted(left.columns)
        return sorted(map(tuple, left.select(columns).collect())) == sorted(map(tuple, right.select(columns).collect()))

    still = shaped(spark.createDataFrame(rows, SALES))
    work = lambda name: (str(tmp_path / name), str(tmp_path / f"{name}-cp"))
    assert same(alerts.daily_revenue_stream(stream(), *work("daily")), batch.daily_revenue(still))
    assert same(alerts.stream_revenue_drop(stream(), *work("drop")), batch.alert_revenue_drop(batch.daily_revenue(still)))
    streaks = batch.alert_zero_streak(batch.daily_units(still), 2)
    assert streaks.count() and same(alerts.stream_zero_streak(stream(), *work("streak"), days=2), streaks)


def test_months_are_sorted_once_and_spread_by_their_rows(spark, tmp_path):
    days = spark.range(1000).selectExpr("concat('P', id % 50) as product_id", "'m1995-01' as sales_month", "date_add(date'1995-01-01', cast(id / 50 as int)) as date", "id % 3 as units")
    days.write.parquet(str(tmp_path / "days"))
    rows = spread_by_rows(spark.read.parquet(str(tmp_path / "days")), "product_id", "sales_month", rows_a_task=90)
    assert rows.rdd.getNumPartitions() == 12 and rows.count() == 1000
    plan = alerts.month_runs(rows)._jdf.queryExecution().sparkPlan().toString()
    executed = alerts.month_runs(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and executed.count("Sort [product_id") == 1
    assert "REPARTITION_BY_NUM" in executed and executed.count("Exchange") == 1

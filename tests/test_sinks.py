import json

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import curation
from shelfwise.operators.cleaning import stage_sales
from shelfwise.plans import analytics, medallion, tools
from shelfwise.plans.registry_sales import STAR_LABELS
from shelfwise.schema import RAW_SCHEMA
from shelfwise.sources import readers, star, store, writers
from tests.data import SAMPLE

SF = "/root/testdata/sf0.001"
HEADER = "product_id,category,region,store_id,date,price,discount,units_sold,revenue\n"


def csv_text(rows):
    return HEADER + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows)


@pytest.fixture
def delivered(tmp_path):
    path = tmp_path / "retail.csv"
    path.write_text(csv_text(SAMPLE))
    return str(path)


def test_fixed_schema_reader(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEADER + "P,Toys,North,S,2024-01-01,abc,1,2,3\nP,Toys,North,S,2024-01-01,1.5,1,2,3\n")
    df = readers.read_sales_csv(spark, str(path))
    assert df.schema == RAW_SCHEMA
    assert [r.price for r in df.collect()] == [None, 1.5]


def test_upload(spark, delivered, tmp_path):
    out = str(tmp_path / "out")
    assert medallion.ingest_upload(spark, delivered, out) == {"original_row_count": 5, "cleaned_row_count": 5}
    assert store.read_sales_store(spark, f"{out}/sales").count() == 5


def test_upload_rejects(spark, tmp_path):
    with pytest.raises(ValueError, match="csv"):
        medallion.ingest_upload(spark, "data.txt", str(tmp_path))
    bad = tmp_path / "bad.csv"
    bad.write_text("col1,col2\n1,2\n")
    with pytest.raises(ValueError, match="Missing mandatory columns"):
        medallion.ingest_upload(spark, str(bad), str(tmp_path / "o"))


def test_empty_store_is_left_alone(spark, tmp_path):
    df = spark.createDataFrame(SAMPLE, RAW_SCHEMA)
    path = str(tmp_path / "sales")
    assert store.replace_sales_store(df, path) == 5
    assert store.replace_sales_store(df.where("price < 0"), path) == 0
    assert store.read_sales_store(spark, path).count() == 5


def test_store_survives_a_write_that_fails_midway(spark, tmp_path):
    df = spark.createDataFrame(SAMPLE, RAW_SCHEMA).withColumn("date", F.to_date("date"))
    path = str(tmp_path / "sales")
    with pytest.raises(FileNotFoundError):
        store.read_sales_store(spark, path)
    store.replace_sales_store(df, path)
    failing = df.withColumn("units_sold", F.when(F.col("price") < 20, F.raise_error("lost")).otherwise(F.col("units_sold")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.replace_sales_store(failing, path)
    assert sorted(map(str, store.read_sales_store(spark, path).collect())) == sorted(map(str, df.collect()))


def test_a_reader_keeps_the_rows_it_began_with(spark, tmp_path):
    df = spark.createDataFrame(SAMPLE, RAW_SCHEMA).withColumn("date", F.to_date("date"))
    path = str(tmp_path / "sales")
    for n in (1, 2, 3, 4):
        store.replace_sales_store(df.limit(n), path)
        if n == 3:
            reader = store.read_sales_store(spark, path)
    assert reader.count() == 3 and store.read_sales_store(spark, path).count() == 4
    assert len(list((tmp_path / "sales" / "versions").iterdir())) == 2


def test_lookups_read_few_rows(spark, tmp_path):
    n = F.col("id")
    pick = lambda seed, values: F.pmod(F.xxhash64(n, F.lit(seed)), F.lit(values)).cast("string")
    rows = spark.range(200_000).select(
        F.concat(F.lit("P"), pick(1, 3000)).alias("product_id"), F.concat(F.lit("S"), pick(2, 200)).alias("store_id"),
        F.when(n < 300, "Rare").otherwise(pick(3, 5)).alias("category"), F.when(n % 1000 == 7, None).otherwise(pick(4, 5)).alias("region"),
        F.date_add(F.lit("2024-01-01").cast("date"), pick(5, 250).cast("int")).alias("date"), n.alias("units_sold"),
    )
    path = str(tmp_path / "laid_out")
    assert store.write_for_lookups(rows, path, group_bytes=64 << 10) == 200_000
    stored = spark.read.parquet(path)
    assert stored.exceptAll(rows).isEmpty() and stored.count() == 200_000
    for condition, share in (
        ("product_id = 'P17' and date between date'2024-02-01' and date'2024-02-20'", 0.2), ("product_id = 'P17'", 0.4),
        ("store_id = 'S5'", 0.5), ("date = date'2024-03-05'", 0.5), ("product_id = 'absent' or store_id = 'absent'", 0.2),
    ):
        found = stored.where(condition)
        assert sorted(r.units_sold for r in found.collect()) == sorted(r.units_sold for r in rows.where(condition).collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert read <= share * 200_000, (condition, read)


def test_medallion_run(spark, tmp_path):
    out = medallion.run(star.messy_sales(spark, SF), str(tmp_path), **STAR_LABELS)
    status = {r.stage: r.rows for r in out["status"].collect()}
    assert status["raw"] > status["staged"] == status["curated"] > 0
    assert len(out["curated"].columns) == 24
    total = out["staged"].agg(F.sum("revenue")).first()[0]
    for name, measure in (("category_revenue", "total_revenue"), ("region_performance", "total_revenue"), ("monthly_trend", "monthly_revenue")):
        assert out[name].agg(F.sum(measure)).first()[0] == pytest.approx(float(total))
    assert out["top_products"].count() == 10
    assert spark.table("retail_curated").count() == status["curated"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/staged_csv").count() == status["staged"]


def test_partition_pruning_and_replacement(spark, tmp_path):
    path = str(tmp_path / "curated")
    curated = curation.curate_sales(stage_sales(spark.createDataFrame(SAMPLE, RAW_SCHEMA)))
    writers.write_curated_partitioned(curated, path)
    stored = spark.read.parquet(path)
    one = stored.where("sale_year = 2024 and sale_month = 2 and product_id = 'PROD_002'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan and "PushedFilters: [IsNotNull(product_id), EqualTo(product_id,PROD_002)]" in plan
    writers.write_curated_partitioned(curated.where("sale_month = 2").withColumn("units_sold", F.lit(99)), path)
    spark.catalog.refreshByPath(path)
    got = {r.sale_month: r.units_sold for r in spark.read.parquet(path).where("product_id <> 'PROD_001'").collect()}
    assert got == {2: 99, 3: 30, 5: 20}


def test_single_row_product_has_no_deviation(spark):
    got = curation.product_aggregates(stage_sales(spark.createDataFrame(SAMPLE, RAW_SCHEMA))).where("product_id = 'PROD_003'").first()
    assert got.std_units_by_product == 0.0 and got.avg_units_by_product == 30.0


def test_bucketed_table_joins_without_shuffle(spark, tmp_path):
    df = spark.createDataFrame(SAMPLE, RAW_SCHEMA)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sinks LOCATION '{tmp_path}/db'")
    for name in ("sinks.left_sales", "sinks.right_sales"):
        writers.save_table(df, name, buckets=4, bucket_by=["product_id"])
    joined = spark.table("sinks.left_sales").hint("merge").join(spark.table("sinks.right_sales"), "product_id")
    assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 9
    spark.sql("DROP DATABASE sinks CASCADE")


def test_metrics_record_and_overview_document(spark, tmp_path):
    writers.write_model_metrics(spark.createDataFrame([(1.5, 0.8)], "mae double, r2 double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().r2 == 0.8
    sales = curation.enrich(stage_sales(spark.createDataFrame(SAMPLE, RAW_SCHEMA)))
    document = json.loads(analytics.overview_document(analytics.metrics_overview(sales)).first().document)
    assert document["totals"]["total_units_sold"] == 75.0 and document["by_region"]["East"] == 375.0


def test_tools_run(spark):
    sales = curation.enrich(star.sales(spark, SF))
    store = tools.Store(sales)
    assert tools.run_tool("get_sales_overview", store).first().line.startswith("Total Records: 6,000 | Total Revenue: $")
    assert tools.run_tool("get_top_products", store, top_n="2").count() == 2
    assert tools.run_tool("get_product_detail", store).first().line == "Please provide product_id parameter."
    assert tools.run_tool("get_product_detail", store, product_id="nope").first().line == "No data found for product: NOPE"
    assert tools.run_tool("get_category_breakdown", store).count() == 6
    with pytest.raises(LookupError):
        tools.run_tool("get_demand_forecast", store)
    assert set(tools.dashboard(store)) == {"key_metrics", "anomaly_counts", "top_anomalies", "revenue_trends"}


def test_row_level_jobs_have_no_single_partition_step(spark):
    for df in (curation.curate_sales(star.sales(spark, SF)), stage_sales(star.messy_sales(spark, SF), **STAR_LABELS)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()

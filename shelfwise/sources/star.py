"""Sales rows read from a star schema: line items with their order, customer, place and part.

The six tables are joined without hints. Catalyst broadcasts nation, region and whatever else is
under the size threshold. Orders get their region before they meet the line items, of which there are several to an
order, so that these are shuffled on the order key and, where parts are many, on the part key, and never on the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import columns as c
from shelfwise.functions import routing as r
from shelfwise.schema import MANDATORY_COLUMNS, PRICE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """An input with fewer splits than cores, such as a single small file, is dealt out to all of them.

    An input with more splits than cores, as any large one has, is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def line_items_as_sales(lines: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows for a batch or a stream of line items, with the order key kept for tracing."""
    customers = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("PROD_"), "l_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("STORE_"), "l_suppkey").alias("store_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("p_retailprice").cast(PRICE).alias("price"),
            F.round(F.col("l_discount") * 500).cast("int").alias("discount"),
            (F.col("l_quantity").cast("int") - 1).alias("units_sold"),
            "l_orderkey",
        )
        .withColumn("revenue", c.revenue())
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Clean sales rows with the nine model columns."""
    lines = spread(table(spark, folder, "lineitem"))
    return line_items_as_sales(lines, spark, folder).select(*MANDATORY_COLUMNS)


def messy_sales(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """All sales rows again, as a careless source system would send them.

    Nothing is left out. The order key decides which rows get which defect (missing, zero or
    excessive numbers, odd spelling, bad dates, an unknown label), and some rows come twice.
    """
    lines = spread(table(spark, folder, "lineitem")) if lines is None else lines
    rows = line_items_as_sales(lines, spark, folder)

    def hits(n: int):
        return F.col("l_orderkey") % n == 0

    dirty = rows.select(
        "product_id",
        F.when(hits(29), "Unknown")
        .when(hits(7), F.lower(F.concat(F.lit("  "), "category", F.lit(" "))))
        .otherwise(F.col("category")).alias("category"),
        "region",
        F.lower("store_id").alias("store_id"),
        F.when(hits(17), "not-a-date").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(hits(13), None).when(hits(23), F.lit(0).cast(PRICE)).otherwise(F.col("price")).alias("price"),
        F.when(hits(11), None).when(hits(19), 101).otherwise(F.col("discount")).alias("discount"),
        "units_sold",
        "revenue",
        F.when(hits(50), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return dirty.withColumn("copies", F.explode("copies")).drop("copies")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per part, worded by the part's size: all kinds the message router knows."""
    part, kind = table(spark, folder, "part"), F.pmod(F.col("p_size"), F.lit(12))
    code = F.concat(F.lit("PROD_"), "p_partkey")
    wordings = [
        F.concat(F.lit("Show me the top "), "p_size", F.lit(" products by revenue")),
        F.concat(F.lit("What is the return policy for a "), "p_name", F.lit("?")),
        F.concat(F.lit("Predict units sold for "), code),
        F.concat(F.lit("Show me anomaly detection results for "), "p_name"),
        F.concat(F.lit("Give the detail of item "), code, F.lit(" please")),
        F.concat(F.lit("Revenue by category "), "p_type"),
        F.concat(F.lit("Monthly trend of "), "p_brand"),
        F.concat(F.lit("Which region sells most of "), "p_name"),
        F.lit("What are the promotion rules?"),
        F.concat(F.lit("Which algorithm is the model of demand for "), code),
        F.concat(F.lit("Hello, is "), "p_name", F.lit(" any good?")),
        F.concat(F.lit("Is sku "), code, F.lit(" in stock at all stores?")),
    ]
    text = F.lit(None).cast("string")
    for i, wording in enumerate(wordings):
        text = F.when(kind == i, wording).otherwise(text)
    return part.select(F.concat(F.lit("P"), "p_partkey").alias("session_id"), text.alias("text"), F.col("p_name").alias("answer"))


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns in the message shape: assistants get the agent and tool their text routes to."""
    talk, text = table(spark, folder, "conversations"), F.col("text")
    assistant = F.col("role") == "assistant"
    agent = r.agent(text)
    return talk.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("position"),
        F.when(assistant, "agent").otherwise(F.col("role")).alias("role"),
        F.when(assistant, agent).otherwise(F.col("role")).alias("agent_id"),
        text.alias("content"),
        F.when(assistant, r.tool(agent, text, in_session=True)).alias("tool_name"),
        F.lit(None).cast("string").alias("tool_result"),
    )

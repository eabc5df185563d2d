"""The stored sales rows: replaced as a whole, laid out so that lookups by any of five columns read little.

A replacement is written beside the rows it replaces and becomes valid by one appended row in ``pointers``; a job
that is lost before that leaves the store as it was. Readers follow the pointer with the highest number.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOOKUP_ORDER = ("product_id", "date")
BLOOM_COLUMNS = ("product_id", "store_id", "category", "region")
POINTER_SCHEMA = "number long, version string, rows long"
BITS = 8  # of each column in the place of a row


def place_on_curve(product: Column, store: Column, date: Column) -> Column:
    """A row's place on a curve through product, store and date, of ``BITS`` interleaved bits each.

    Equal values share their bits, so the rows of one product, of one store and of one stretch of days each lie in few
    stretches of the curve. Ids count by their hash, as they are looked up by value alone; 256 days are one cycle.
    """
    size = 1 << BITS
    coordinates = (
        F.pmod(F.xxhash64(product), F.lit(size)),
        F.pmod(F.xxhash64(store), F.lit(size)),
        F.pmod(F.coalesce(F.datediff(date, F.lit("1970-01-01")), F.lit(0)), F.lit(size)).cast("long"),
    )
    place = F.lit(0).cast("long")
    for bit in range(BITS):
        for n, coordinate in enumerate(coordinates):
            one = F.shiftright(coordinate, bit).bitwiseAND(F.lit(1).cast("long"))
            place = place + F.shiftleft(one, len(coordinates) * bit + len(coordinates) - 1 - n)
    return place


def laid_out_for_lookups(df: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted along the curve; the keys behind it split the rows of one place."""
    place = place_on_curve(F.col("product_id"), F.col("store_id"), F.col("date"))
    keyed = df.withColumn("_place", place).withColumn("_row", F.xxhash64(*df.columns))
    order = ("_place", *LOOKUP_ORDER, "_row")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place", "_row")


def write_for_lookups(df: DataFrame, path: str, format: str = "parquet", group_bytes: int = 32 << 20) -> int:
    """Writes the rows with a bloom filter on every id and label per row group; returns their number.

    Filters tell a reader which row groups cannot hold a value, dates are skipped by their smallest and largest one.
    """
    written = Observation()
    counted = laid_out_for_lookups(df).observe(written, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite").format(format).option("parquet.block.size", group_bytes)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # sized by the values that a group holds
    for name in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.save(path)
    return int(written.get["rows"])


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER_SCHEMA).parquet(f"{path}/pointers")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _newest(spark: SparkSession, path: str, n: int = 1) -> list:
    pointers = _pointers(spark, path)
    return [] if pointers is None else pointers.orderBy(F.desc("number"), F.desc("version")).limit(n).collect()


def read_sales_store(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The rows of the last replacement that was finished."""
    newest = _newest(spark, path)
    if not newest:
        raise FileNotFoundError(f"no sales store at {path}")
    return spark.read.format(format).load(f"{path}/versions/{newest[0]['version']}")


def replace_sales_store(df: DataFrame, path: str, format: str = "parquet") -> int:
    """Replaces the stored sales rows and returns their number; without rows nothing is touched.

    Readers that began before keep their rows: the replaced version stays, the one before it is deleted.
    """
    if df.isEmpty():
        return 0
    spark = df.sparkSession
    version = uuid.uuid4().hex
    rows = write_for_lookups(df, f"{path}/versions/{version}", format)
    before = _newest(spark, path, 2)
    number = before[0]["number"] + 1 if before else 0
    pointer = spark.createDataFrame([(number, version, rows)], POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    for old in before[1:]:
        _delete(spark, f"{path}/versions/{old['version']}")
    return rows


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

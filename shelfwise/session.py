"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python workers get this package's functions with their code: it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def build_session(app_name: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` overrides any of them.

    Shuffle partition counts are left to AQE on a cluster: start high, let it coalesce.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings that the jobs want in a session made elsewhere.

    The JVM never compiles a method of more than 8000 bytes. Beyond that size Spark is told to give up
    fusing a stage into one method, which otherwise runs interpreted, several times slower.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, because a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows.

    Used where a value depends on where a row was placed (a range partition, a sample), so that
    every later read, and every retry after a lost executor, sees the same placing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is deleted as soon as it ends, not when the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _new_table(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, for jobs that read them several times.

    Each later read is a scan of the columns it needs, a lost executor costs no earlier work, and what ``df`` shuffled is gone.
    """
    spark = df.sparkSession
    path = path or _new_table(spark)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written_for_now(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``df`` as a table like ``written``'s, deleted at the end: for a step whose rows are written again by the next one."""
    spark = df.sparkSession
    path = _new_table(spark)
    try:
        yield written(df, path)
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written_in_turn(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all ``parts``, of one schema, as one table in the shared folder.

    They are written one after another, and what a part has shuffled is deleted before the next one begins, so the parts
    never lie on the executors' disks side by side.
    """
    path = ""
    for df in parts:
        spark = df.sparkSession
        path = path or _new_table(spark)
        with shuffles_deleted(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

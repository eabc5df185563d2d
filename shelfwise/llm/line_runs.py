"""Line dedup against levelled sorted runs of line hashes. DataFrame functions only.

Documents are taken in batches of ascending id. A run is a table of the line hashes that one batch saw first, sorted
and cut into buckets by the hash, and all runs are cut alike. Each batch counts its lines into one row a hash, then
merge-anti-joins these rows with every run, bucket by bucket and without a shuffle of the runs; what no run holds
becomes a run of level 0. Before a batch, a level with ``fanout`` runs is merged into one run of the next level, so the
number of runs grows with the logarithm of the number of batches. The list of runs is a table of versions: a batch that
was lost midway leaves the version before it.

A line goes if a run holds its hash, or if a smaller id of its batch has it. Hashes with more than 1 / ``HEAVY`` of a
batch's lines are looked up in a broadcast of at most ``HEAVY`` rows, so no task gathers the lines of a frequent one.
Dropped lines meet their texts again by (id, hash of the text), as sorted line numbers; the kept stretches between them
are cut out as slices, so that a text of any number of lines is put together in one pass.

Rows: a missing or empty text is one empty line; rows with equal ids count as one document and keep a row each; rows
without id count as one document that comes last; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, new_table, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10
BATCHES, FANOUT = 4, 2
HEAVY = 2000
NO_ID = (1 << 63) - 1
HASH = ["h1", "h2"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(id, body, at, h1, h2)``: the 128-bit hash of the key of each line that is long enough, and the text's hash."""
    lines = docs.select(_id().alias("id"), F.xxhash64(_text()).alias("body"), F.posexplode(F.split(_text(), "\n")).alias("at", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    return keyed.select("id", "body", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """The levelled runs in a folder, from the shared folder where none is given. First come, first kept."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = folder or new_table(spark, "runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels = 0, []

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> Runs:
        """The last whole version of the runs in ``folder``, also one that another application wrote."""
        runs = cls(spark, folder, fanout)
        versions = spark.read.parquet(f"{folder}/versions")
        rows = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).orderBy("level", "turn").collect()  # a row a run
        runs.version, runs.buckets = rows[0]["version"], rows[0]["buckets"]
        runs.levels = [[] for _ in range(1 + max(r["level"] for r in rows))]
        for row in rows:
            runs.levels[row["level"]].append(row["name"])
            if not spark.catalog.tableExists(row["name"]):
                spark.sql(
                    f"CREATE TABLE {row['name']} (h1 BIGINT, h2 BIGINT) USING parquet "
                    f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{folder}/{row['name']}'"
                )
        return runs

    def _save(self, rows: DataFrame, kind: str = "run") -> str:
        """Writes a table cut into the common buckets and sorted in each; returns its name."""
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.folder}/{name}")

    def _publish(self) -> None:
        self.version += 1
        rows = [(self.version, level, turn, name, self.buckets) for level, names in enumerate(self.levels) for turn, name in enumerate(names)]
        versions = self.spark.createDataFrame(rows, "version long, level int, turn int, name string, buckets int").coalesce(1)
        versions.write.mode("append").parquet(f"{self.folder}/versions")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def compact(self) -> None:
        """Merges each level with ``fanout`` runs into one run of the next; runs share no hash."""
        old, level = [], 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.join(self.spark.table(name), HASH, "full")
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._save(merged))
                old += names
            level += 1
        if old:
            self._publish()
            for name in old:
                self._drop(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the new hashes of a batch; returns ``(id, body, at)`` of the lines of the batch that go."""
        self.compact()
        of_line = lines.groupBy(*HASH).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows"))
        batch = self._save(of_line, "batch")
        counted = self.spark.table(batch)
        fresh = counted
        for name in self.names():
            fresh = fresh.join(self.spark.table(name), HASH, "left_anti")
        run = self._save(fresh.select(*HASH))
        known = self.spark.table(run).withColumn("new", F.lit(True))
        judged = counted.join(known, HASH, "left").where("new IS NULL OR last > first")
        repeated = stored(judged.select(*HASH, "rows", F.when(F.col("new"), F.col("first")).alias("keeper")), "repeated")
        total = counted.agg(F.sum("rows")).first()[0] or 0
        gone = stored(_gone(lines, repeated, total), "gone")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._publish()
        self._drop(batch)
        return gone


def _gone(lines: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """The lines of ``lines`` that ``repeated`` takes out: all of a hash but those of the id that keeps it, if one does."""
    heavy = F.col("rows") * HEAVY >= total  # at most HEAVY hashes
    goes = F.col("keeper").isNull() | (F.col("id") > F.col("keeper"))
    frequent = F.broadcast(repeated.where(heavy).select(*HASH, "keeper"))
    found = lines.join(frequent, HASH).where(goes).select("id", "body", "at")
    others = lines.join(F.broadcast(repeated.where(heavy).select(*HASH)), HASH, "left_anti")
    return found.unionByName(others.join(repeated.where(~heavy), HASH).where(goes).select("id", "body", "at"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS, runs: Runs | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)``: each text without the lines that a smaller id, or a run in ``runs``, has.

    A row per row of ``docs``. Batches are ranges of ids with about equal numbers of rows.
    """
    spark = docs.sparkSession
    runs = runs or Runs(spark)
    cuts = docs.agg(F.percentile_approx(_id(), [i / batches for i in range(1, batches)] or [1.0])).first()[0] or []  # one a batch
    number = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts[: batches - 1]), F.lit(0))
    path = new_table(spark, "lines")
    hashed_lines(docs, least_chars).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, body long, at int, h1 long, h2 long, batch int").parquet(path)
    gone = [runs.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(batches)]
    rows = gone[0]
    for more in gone[1:]:
        rows = rows.unionByName(more)
    dropped = rows.groupBy("id", "body").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    texts = docs.select(F.col("doc_id").cast("long"), _id().alias("id"), _text().alias("text"), F.xxhash64(_text()).alias("body"))
    met = texts.join(dropped, ["id", "body"], "left").select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    stretches = F.transform("gone_edges", lambda e, i: F.when(i > 0, F.slice("lines", F.get("gone_edges", i - 1) + 2, e - F.get("gone_edges", i - 1) - 1)))
    kept = F.flatten(F.slice(stretches, 2, F.size("gone_edges")))
    return met.withColumn("gone_edges", edges).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )


def op11_line_dedup(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(str_split(COALESCE(text, ''), chr(10))) AS line,
         generate_subscripts(str_split(COALESCE(text, ''), chr(10)), 1) AS line_number
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, MIN(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, COALESCE(k.doc_id > f.keeper, FALSE) AS goes FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE goes) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY line_number) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""Exact quantiles and order boundaries by selection: values are counted, never shuffled or sorted as a whole."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfwise.session import written

DIGIT = 16  # bits of a value looked at in one pass
LOWEST = -(1 << 63)


def ordered_bits(value: Column) -> Column:
    """A long in the order of the doubles: the bits as they are, of negative numbers all but the sign turned over."""
    plain = value.cast("double") + F.lit(0.0)  # no negative zero
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(value.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1))))


def double_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ ((1 << 63) - 1)))[0]


def exact_quantiles(df: DataFrame, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row with, for each column in ``wanted``, its linearly interpolated quantile as a double.

    Radix selection. Each value is a 64-bit number in the order of the values; they are written once, a column of
    longs. A pass counts the rows by their next 16 bits within the stretch that holds a wanted rank, so a task
    passes on at most 65,536 counts a stretch whatever the number of distinct values, and the running sums
    of the counts give the next stretch. After four passes, or as soon as a stretch holds one value, it is found.
    """
    types = {name: isinstance(df.schema[name].dataType, IntegralType) for name in wanted}
    key = {name: F.col(name).cast("long") if whole else ordered_bits(F.col(name)) for name, whole in types.items()}
    names = list(wanted)
    entries = F.array(*[F.struct(F.lit(i).alias("c"), key[name].alias("k")) for i, name in enumerate(names)])
    rows = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w")
    keys = written(df.select(F.explode(entries).alias("e"), rows).select("e.c", "e.k", "w").where("k IS NOT NULL"))
    totals = dict(map(tuple, keys.groupBy("c").agg(F.sum("w")).collect()))  # a row a wanted column
    ranks = {c: wanted[names[c]] * (n - 1) for c, n in totals.items()}
    open_ranks = {(c, side): [LOWEST >> 63, int(r) if side == 0 else -int(-r // 1)] for c, r in ranks.items() for side in (0, 1)}
    found: dict[tuple[int, int], int] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if not open_ranks:
            break
        above = F.shiftright("k", min(63, shift + DIGIT))
        stretches = sorted({(c, prefix) for (c, _), (prefix, _) in open_ranks.items()})
        if shift == 64 - DIGIT:
            inside, above = F.col("c").isin([c for c, _ in stretches]), F.lit(LOWEST >> 63)
        else:
            inside = F.struct("c", above.alias("above")).isin([F.struct(F.lit(c).alias("c"), F.lit(p).cast("long").alias("above")) for c, p in stretches])
        counts = keys.where(inside).groupBy("c", above.cast("long").alias("above"), F.shiftright("k", shift).alias("prefix"))
        counts = counts.agg(F.sum("w").alias("n"), F.min("k").alias("least"), F.max("k").alias("most")).where("n > 0")
        upto = Window.partitionBy("c", "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows at most
        placed = counts.withColumn("end", F.sum("n").over(upto))
        holds = [
            (F.col("c") == c) & (F.col("above") == prefix) & (F.col("end") > rank) & (F.col("end") - F.col("n") <= rank)
            for (c, _), (prefix, rank) in open_ranks.items()
        ]
        wanted_rows = holds[0]
        for more in holds[1:]:
            wanted_rows = wanted_rows | more
        held = placed.where(wanted_rows).collect()  # one or two a wanted column
        for target, (prefix, rank) in list(open_ranks.items()):
            row = next(r for r in held if r["c"] == target[0] and r["above"] == prefix and r["end"] - r["n"] <= rank < r["end"])
            if row["least"] == row["most"]:
                found[target] = row["least"]
                del open_ranks[target]
            else:
                open_ranks[target] = [row["prefix"], rank - (row["end"] - row["n"])]
    values = {}
    for c, name in enumerate(names):
        if c in ranks:
            a, b = (float(found[c, side]) if types[name] else double_of(found[c, side]) for side in (0, 1))
            values[name] = a + (b - a) * (ranks[c] - int(ranks[c])) if a != b else a
    return df.sparkSession.range(1).select(*[F.lit(values.get(name)).cast("double").alias(name) for name in names])


def exact_quantile(df: DataFrame, value: str, q: float, weight: str | None = None) -> DataFrame:
    """One row, one column ``quantile``."""
    return exact_quantiles(df, {value: q}, weight).withColumnRenamed(value, "quantile")


def trim_to_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Rows whose value is at or below the quantile."""
    return df.where(F.col(value) <= exact_quantile(df, value, q).scalar())


def boundary(df: DataFrame, order: Sequence[str], rank: int) -> dict | None:
    """The values in ``order`` of the row with this 0-based rank in that order, nulls first; ``None`` beyond the last row.

    Column by column: the rows that agree so far are counted by their next value, and the running sums say which value
    holds the rank. A column may have any number of values; their counts are range-partitioned, and only the partition
    that holds the rank is summed row by row.
    """
    at: dict = {}
    for name in order:
        same = df
        for known, value in at.items():
            same = same.where(F.col(known).eqNullSafe(F.lit(value)))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = same.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        ranged = written(counts.repartitionByRange(parts, F.col("v").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
        for part, n in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("n")).collect())):  # a row a partition
            if rank < n:
                break
            rank -= n
        else:
            return None
        upto = Window.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        row = ranged.where(F.col("part") == part).withColumn("end", F.sum("n").over(upto)).where(F.col("end") > rank).orderBy("end").first()
        at[name] = row["v"]
        rank -= row["end"] - row["n"]
    return at

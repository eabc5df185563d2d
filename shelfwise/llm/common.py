"""Helpers the operators share: Arrow batches of texts, word hashes, tables and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import shared_folder

BLANK_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20  # bytes hashed at once


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a missing id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % divisor


def word_count(text: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def new_table(spark: SparkSession, kind: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back."""
    spark, path = df.sparkSession, new_table(df.sparkSession, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def superseded(table: DataFrame) -> None:
    """Deletes the tables behind ``table`` that ``stored`` wrote, once what was made from them is stored, too."""
    own = f"{urlparse(shared_folder(table.sparkSession)).path.rstrip('/')}/tables/"
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if urlparse(folder).path.startswith(own):
            discard(table.sparkSession, folder)


def mounted(path: str, mount: tuple[str, str] | None = None) -> str:
    """The path under which Python workers see a shared folder.

    ``file:`` paths are seen as they are. For another store, ``mount`` says which prefix of its
    addresses is mounted where, for example ``("s3a://bucket/", "/mnt/bucket/")``.
    """
    if mount and path.startswith(mount[0]):
        return mount[1] + path[len(mount[0]):]
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return parts.path
    raise ValueError(f"{path} cannot be memory-mapped; pass mount=(prefix, folder) for a mounted store")


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        lengths = np.asarray(pc.binary_length(column).fill_null(0))
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, empty where missing."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


# word hashes


def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, equal for A-Z and a-z, and whether the byte is a blank."""
    values = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[list(BLANK_BYTES)] = True
    return values, blank


BYTE_VALUE, IS_BLANK = _hash_tables()
BASE = np.uint64(6364136223846793005)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class WordHasher:
    """Finds the words of UTF-8 texts and gives each a 64-bit hash; A-Z count as a-z.

    The hash is a polynomial over the bytes modulo 2**64, read off running sums, and then mixed, so
    that all words of a block are hashed by a few array operations.
    """

    def __init__(self, blank: np.ndarray = IS_BLANK) -> None:
        """``blank``: for each byte, whether it parts words."""
        self.blank = blank
        self.up, self.down = powers(BASE, CHUNK + 2), powers(INVERSE, CHUNK + 2)

    def _room(self, n: int) -> None:
        if n + 2 > len(self.up):  # a single word longer than a chunk
            self.up, self.down = powers(BASE, n + 2), powers(INVERSE, n + 2)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words in an array of bytes."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.blank[data], [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            base = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
            stop = int(ends[last - 1])
            self._room(stop - base)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data[base:stop]] * self.up[: stop - base], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = mix((sums[e] - sums[s]) * self.down[s])
            first = last
        return starts, ends, out

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after another, and the number of words of each text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        starts, _, hashes = self.words(data)
        return hashes, np.diff(np.searchsorted(starts, offsets))

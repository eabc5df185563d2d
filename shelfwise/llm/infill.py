"""Fill-in-middle transformation: cuts by code points, found from memoised counts of content-defined chunks.

A rolling hash over the last 32 bytes cuts a text into chunks wherever its top bits are zero, so equal passages are cut
alike in any text. What a chunk adds to its text is a summary: its number of code points, whether it holds one of the
marks, and its first and last two bytes, which tell a mark that lies across two chunks. Summaries are kept in a
cache of bounded size whose key is the chunk itself, so a hash that two chunks share is told apart by their content.
The running sums of the counts give the chunk a cut lies in; only that chunk's bytes are looked at. A chunk may end
inside a character: a code point belongs to the chunk of its first byte.

Texts are worked on in their own rows without a shuffle, so a hot group costs no more than its rows.

Rows: a missing text counts as empty and is plain; a missing id counts as the text ``null``; ties and repeated rows
keep a row each; an empty table gives no rows; a very long text is hashed piece by piece. Extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
RATE, SUFFIX_FIRST = 90, 20  # per cent of the texts that are cut, and of those that begin with their suffix

REACH = 32  # bytes a hash looks back on
SHIFT = 24  # a chunk ends where the top 8 of 32 bits are zero: 256 bytes on average
LEAST, MOST = 64, 4096  # bytes a chunk
PIECE = 1 << 20
CACHE = 16 << 20  # bytes of chunks kept by a task
GEAR = np.random.default_rng(13).integers(0, 2**32, 256, dtype=np.uint32)


class Summary(NamedTuple):
    points: int
    marked: bool
    head: bytes
    tail: bytes


def _leads(chunk: bytes) -> np.ndarray:
    """Where the code points of a chunk begin."""
    return np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)


def _marked(data: bytes) -> bool:
    return any(mark in data for mark in MARKS)


def summary(chunk: bytes) -> Summary:
    return Summary(len(_leads(chunk)), _marked(chunk), chunk[:2], chunk[-2:])


class Cache:
    """Summaries by chunk; the oldest go when the chunks exceed ``room`` bytes."""

    def __init__(self, room: int = CACHE) -> None:
        self.room, self.held, self.known = room, 0, {}

    def __getitem__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = self.known[chunk] = summary(chunk)
            self.held += len(chunk)
            while self.held > self.room and len(self.known) > 1:
                oldest = next(iter(self.known))
                del self.known[oldest]
                self.held -= len(oldest)
        return found


def _candidates(data: np.ndarray) -> Iterator[int]:
    """Ends of stretches of bytes whose hash has its top bits zero."""
    for at in range(0, len(data), PIECE):
        begin = max(0, at - REACH + 1)
        rolled = GEAR[data[begin : at + PIECE]]
        for step in (1, 2, 4, 8, 16):
            rolled[step:] += rolled[:-step] << np.uint32(step)
        yield from (np.flatnonzero(rolled[at - begin :] >> np.uint32(SHIFT) == 0) + at + 1).tolist()


def chunk_ends(text: bytes) -> list[int]:
    """The end of each chunk, the last of which is the end of the text."""
    ends, last, size = [], 0, len(text)
    candidates = _candidates(np.frombuffer(text, np.uint8)) if size > LEAST else ()
    for end in (*candidates, size):
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or (end == size and end > last):
            ends.append(end)
            last = end
    return ends


class Chunked:
    """A text as chunks: how many code points it has, whether it holds a mark, and where a code point begins."""

    def __init__(self, text: bytes, cache: Cache) -> None:
        self.ends = chunk_ends(text)
        self.starts = [0, *self.ends[:-1]]
        parts = [cache[text[a:b]] for a, b in zip(self.starts, self.ends)]
        self.text = text
        self.before = [0, *accumulate(p.points for p in parts)]
        self.points = self.before[-1]
        self.marked = any(p.marked for p in parts) or any(_marked(a.tail + b.head) for a, b in zip(parts, parts[1:]))

    def offset(self, point: int) -> int:
        """The byte at which the code point with this number begins, the end of the text for the number of all."""
        if point >= self.points:
            return len(self.text)
        part = bisect_right(self.before, point) - 1
        start = self.starts[part]
        return start + int(_leads(self.text[start : self.ends[part]])[point - self.before[part]])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2^32 that the id decides."""
    digits = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: bytes, numbers: list[int], cache: Cache, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    whole = Chunked(text, cache)
    n = whole.points
    if not n or whole.marked or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = whole.offset(first), whole.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < suffix_first:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache()
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [transformed(t or b"", draws(i, seed), cache, rate, suffix_first) for i, t in zip(ids, batch.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    found = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text that holds marks is plain, so the marks found are those put in."""
    parts = F.split(output, "<[PSM]>")
    after_first = F.concat(F.get(parts, F.when(form == "psm", 1).otherwise(2)), F.get(parts, F.lit(3)))
    return F.when(form == "plain", output).otherwise(F.concat(after_first, F.get(parts, F.when(form == "psm", 2).otherwise(1))))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS text, CAST(length(COALESCE(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS bare,
         ('0x' || h[25:32])::BIGINT % 100 < 20 AS swapped
  FROM drawn),
cut AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q, substring(text, 1, least(a, b)) AS prefix,
         substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(text, greatest(a, b) + 1) AS suffix
  FROM numbers)
SELECT doc_id, n, CASE WHEN bare THEN 'plain' WHEN swapped THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT bare THEN p END AS prefix_chars, CASE WHEN NOT bare THEN q - p END AS middle_chars,
       sha256(CASE WHEN bare THEN text WHEN swapped THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

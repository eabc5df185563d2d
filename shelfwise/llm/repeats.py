"""Periodic runs of words, by uniting suffix classes in order of decreasing common prefix.

A run is a longest stretch of words that repeats with its smallest period q for at least 2 q words. If it starts at s,
the suffixes at s and s + q have exactly its length less q in common, and no place between them begins with as much.
So the suffixes of a text are put in order, the common prefixes of neighbours are taken from the longest down, and each
unites two classes of places (union-find; a class is an ordered set, and the smaller goes into the larger). Two places
of different classes that become neighbours at a distance d within the common prefix l seed the stretch of period d and
length d + l; it is a run if the word before it breaks the period, and of several periods of one stretch the smallest
counts. No stretch is ever extended word by word.

A run of ``least`` words shares at least half of that with itself, so only texts in which a stretch of half that length
occurs twice are put in order; others have no run. Every text is worked on in its own row without a shuffle: time grows
with n log n of a text's words, memory with 4 n log n bytes.

Rows: a missing, empty or blank text has no words and no run; a missing id counts as the text ``null``; repeated rows
keep a row each; an empty table gives no rows. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices

LEAST = 12  # words of the shortest run
BLOCK = 512  # places a block of an ordered set before it is cut
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
FACTORS = np.random.default_rng(12).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Places:
    """An ordered set of places in blocks, so that adding one never moves a whole large set."""

    def __init__(self, place: int) -> None:
        self.firsts, self.blocks, self.size = [place], [[place]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The nearest places before and after one that is not in the set."""
        at = bisect_right(self.firsts, place) - 1
        if at < 0:
            return None, self.firsts[0]
        block = self.blocks[at]
        k = bisect_right(block, place)
        if k < len(block):
            return block[k - 1], block[k]
        return block[-1], self.firsts[at + 1] if at + 1 < len(self.firsts) else None

    def add(self, place: int) -> None:
        at = max(0, bisect_right(self.firsts, place) - 1)
        block = self.blocks[at]
        insort(block, place)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.firsts.insert(at + 1, block[half])


def repeats_within(ids: np.ndarray, length: int) -> bool:
    """Whether a stretch of ``length`` words may occur twice; false only if none does."""
    n = len(ids) - length + 1
    if n < 2:
        return False
    mixed = np.zeros(n, np.uint64)
    values = ids.astype(np.uint64) + np.uint64(1)
    for k in range(length):
        mixed += (values[k : k + n] * FACTORS[k % 64]) ^ (values[k : k + n] << np.uint64(k % 31))
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their suffixes, and the number of words each has in common with the one before it.

    ``ids`` are whole numbers below the number of words, equal for equal words.
    """
    n = len(ids)
    rank = ids.astype(np.int64)
    ranks, step = [rank.astype(np.int32)], 1
    while True:
        after = np.zeros(n, np.int64)  # a suffix that ends comes first
        if step < n:
            after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        changes = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = changes
        if int(changes[-1]) == n - 1:
            break
        ranks.append(rank.astype(np.int32))
        step *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    shared = common[1:]
    for level in range(len(ranks) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = np.maximum(i, j) < n
        equal = inside.copy()
        equal[inside] = ranks[level][i[inside]] == ranks[level][j[inside]]
        shared += equal.astype(np.int64) << level
    return order, common


def seeds(ids: list[int], order: np.ndarray, common: np.ndarray, floor: int) -> Iterator[tuple[int, int, int]]:
    """``(start, period, common)`` of places of different classes that become neighbours within their common prefix."""
    edges = np.flatnonzero(common >= floor)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, Places] = {}

    def root(slot: int) -> int:
        top = slot
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[slot] != top:
            parent[slot], slot = top, parent[slot]
        return top

    for edge, length in zip(edges.tolist(), common[edges].tolist()):
        large, small = root(edge), root(edge - 1)
        for slot in (large, small):
            if slot not in classes:
                classes[slot] = Places(int(order[slot]))
        if classes[large].size < classes[small].size:
            large, small = small, large
        parent[small] = large
        into, places = classes[large], list(classes.pop(small))
        for place in places:
            for near in into.around(place):
                if near is not None and abs(near - place) <= length:
                    start, later = min(near, place), max(near, place)
                    if start == 0 or ids[start - 1] != ids[later - 1]:
                        yield start, later - start, length
        for place in places:
            into.add(place)


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a text, by start, then period."""
    floor = (least + 1) // 2
    if len(words) < max(2, least):
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    array = np.array(ids, np.int64)
    if not repeats_within(array, max(1, floor)):
        return []
    order, common = suffix_order(array)
    found: dict[tuple[int, int], int] = {}
    for start, period, length in seeds(ids, order, common, max(1, floor)):
        if period + length >= least:
            key = (start, start + period + length)
            found[key] = min(period, found.get(key, period))
    return sorted(((start, end - start, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, of each run only those that no run repeats, joined by one space."""
    if runs:
        table = np.array(runs, np.int64)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, table[:, 0] + table[:, 2], 1)
        np.add.at(change, table[:, 0] + table[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each text and its words without their repeats.

    ``edit(doc_id, words)`` may change the words of a text first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()  # bytes.split knows just the six ASCII blanks
                if edit:
                    words = edit(doc_id, words)
                found = runs_of(words, least)
                out[0].append(len(words))
                out[1].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                out[2].append(collapsed(words, found))
            place = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(place)), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes the end of one text in ten periodic, as its id decides."""
    chosen, n = crc32(str("null" if doc_id is None else doc_id).encode()), len(words)
    if chosen % 10 or not n:
        return words
    g = chosen // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + (words[start : start + period] * ((n - start) // period + 1))[: n - start]


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, edit=with_period)
    ordered = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    top = found.withColumn("top", F.get(ordered, F.lit(0)))
    length, period = -F.col("top.l"), F.col("top.p")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the shortest string from the current place that is no
phrase yet. The set of phrases describes the text much as its compressed form does. Each phrase is hashed;
the hash's upper bits choose one of ``SLOTS`` places, and the fingerprint holds the smallest hash of each
place (one-permutation minimum hashing). The share of equal places among those that are filled in either of
two fingerprints estimates the overlap of the two phrase sets.

To compare each document with the next one in order of id, the documents are put into contiguous ranges of
ids; each range also gets the first document of the following one, and the last range that of the first.
A task goes through a range in order and holds two documents at a time. There are at most ``MOST_RANGES``
ranges, so what the driver holds of them is bounded; beyond that they grow, as streams, not in memory.

Rows: a missing text counts as empty; the fingerprint of a text without phrases is all ``f``, and two such
texts are alike (1.0); a missing id comes first in order; rows with equal ids are ordered by text; a single
row is its own next. Texts are parsed whole; repeated rows keep a row each; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from shelfwise.llm.common import BASE, INVERSE, mix, powers, slices, texts_of

SLOTS = 128  # a power of two
DOCS_A_RANGE = 2000
MOST_RANGES = 10_000
EMPTY = np.uint32(0xFFFFFFFF)
SPAN = 1 << 20  # code points hashed at once
LEAST_ID = -(2**63)


def parse(text: str, known: set[str], phrase: str = "") -> tuple[list[int], str]:
    """Adds the phrases of ``text`` to ``known``; their lengths in order, and the unfinished one at the end."""
    lengths = []
    for letter in text:
        phrase += letter
        if phrase not in known:
            known.add(phrase)
            lengths.append(len(phrase))
            phrase = ""
    return lengths, phrase


class Signer:
    """Minimum hashes of the phrases of texts; all phrases of a text are hashed by a few array operations."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.slots, self.bits = slots, slots.bit_length() - 1
        self.up, self.down = powers(BASE, SPAN + 1), powers(INVERSE, SPAN + 1)

    def minima(self, text: str, lengths: list[int]) -> np.ndarray:
        """Smallest hash in each slot over the phrases, which make up the text."""
        low = np.full(self.slots, EMPTY, np.uint32)
        ends = np.cumsum(np.array(lengths, np.int64))
        starts = ends - np.array(lengths, np.int64)
        first = 0
        while first < len(ends):
            begin = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + SPAN, side="right")))
            stop = int(ends[last - 1])
            if stop - begin > SPAN:  # one phrase alone
                self.up, self.down = powers(BASE, stop - begin + 1), powers(INVERSE, stop - begin + 1)
            letters = np.frombuffer(text[begin:stop].encode("utf-32-le", "surrogatepass"), np.uint32)
            sums = np.zeros(stop - begin + 1, np.uint64)
            np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * self.up[: stop - begin], out=sums[1:])
            s, e = starts[first:last] - begin, ends[first:last] - begin
            keys = mix((sums[e] - sums[s]) * self.down[s])
            value = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            np.minimum.at(low, (keys >> np.uint64(64 - self.bits)).astype(np.int64), value)
            first = last
        return low

    def sign(self, text: str) -> np.ndarray:
        lengths, rest = parse(text, set())
        return self.minima(text, lengths + [len(rest)] * bool(rest))

    def sign_both(self, text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Minima of the text and of its edited form, and that form. The part in common is parsed once."""
        keep, edited = edited_text(text, following)
        known: set[str] = set()
        front, rest = parse(text[:keep], known)
        done = keep - len(rest)
        low = self.minima(text[:done], front)
        out = []
        for whole in (text, edited):
            lengths, left = parse(whole[keep:], set(known), rest)
            out.append(np.minimum(low, self.minima(whole[done:], lengths + [len(left)] * bool(left))))
        return out[0], out[1], edited


def edited_text(text: str, following: str) -> tuple[int, str]:
    """How many code points stay, and the text with the last quarter replaced by the start of the next one."""
    part = len(text) // 4
    return len(text) - part, text[: len(text) - part] + following[:part]


def alike(left: np.ndarray, right: np.ndarray) -> float:
    """Share of equal places among those filled in either fingerprint."""
    filled = (left != EMPTY) | (right != EMPTY)
    return float(((left == right) & filled).sum() / filled.sum()) if filled.any() else 1.0


def hex_of(low: np.ndarray) -> str:
    return low.astype(">u4").tobytes().hex()


RESULT = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
near_edited double, near_next double"""


def _range_of(cuts: list[int], before: dict[int, int]):
    """UDF from an id to its range and, for the first id of a range, the range before it."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf(ArrayType(IntegerType()))
    def ranges(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(edges, ids.to_numpy(np.int64), side="left")
        return pd.Series([[r, before[i]] if i in before else [r] for r, i in zip(own.tolist(), ids.tolist())])

    return ranges


def in_order(docs: DataFrame, per_range: int = DOCS_A_RANGE) -> DataFrame:
    """``(id, doc_id, text, range, copy)``, a partition per range, in order, with the next range's first rows last."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.select(key.alias("id"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("id")
    n = min(MOST_RANGES, ids.count() // per_range + 1)
    cuts = sorted({int(c) for c in ids.stat.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    place = F.element_at(_range_of(cuts, {})("id"), 1)
    heads = [r["head"] for r in ids.groupBy(place.alias("range")).agg(F.min("id").alias("head")).orderBy("range").collect()]
    own = np.searchsorted(np.array(cuts, np.int64), np.array(heads, np.int64), side="left").tolist()
    before = {head: own[i - 1] for i, head in enumerate(heads)}
    filed = rows.select("*", F.posexplode(_range_of(cuts, before)("id")).alias("copy", "range"))
    return filed.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "copy", "id", "text")


def fingerprint_pairs(docs: DataFrame, per_range: int = DOCS_A_RANGE, slots: int = SLOTS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness and that to the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(slots)
        waiting = None  # a document whose next one has not been seen
        ready = None  # a row that lacks the likeness to the next document, and its minima
        for batch in slices(batches, "text"):
            out = []
            ids, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "copy"))
            for doc_id, text, copy in zip(ids, texts_of(batch), copies):
                if waiting is not None:
                    low, changed, edited = signer.sign_both(waiting[1], text)
                    if ready is not None:
                        out.append({**ready[0], "near_next": alike(ready[1], low)})
                    ready = (
                        {
                            "doc_id": waiting[0], "n_chars": len(waiting[1]),
                            "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            "fingerprint": hex_of(low), "edited_fingerprint": hex_of(changed), "near_edited": alike(low, changed),
                        },
                        low,
                    )
                if not copy:
                    waiting = (doc_id, text)
                elif ready is not None:  # the first copy ends the range, more of them change nothing
                    out.append({**ready[0], "near_next": alike(ready[1], signer.sign(text))})
                    waiting = ready = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    return in_order(docs, per_range).select("doc_id", "text", "copy").mapInArrow(run, RESULT)


def op6_phrase_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprint_pairs(docs)

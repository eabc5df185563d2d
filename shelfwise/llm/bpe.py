"""Token counts by rank-synchronous merging of ragged arrays.

A piece vocabulary with scores defines the merges: two neighbouring symbols may merge if their join is a
piece, the piece with the best score first, the leftmost first among equals. No piece has a word mark
after another letter, so a text falls into independent pre-tokens at its word marks, and pre-tokens that
repeat within a batch are merged once. All pre-tokens of a batch lie in one ragged array; every round
merges, in each of them at once, its pair of lowest rank. Symbols that are no piece count by their bytes.

All occurrences of a sequence's lowest pair merge in one round unless the new piece could start or end a
piece of still lower rank; then only the leftmost does, as the library would do it.

Rows: a missing text counts as empty (0 bytes, 0 tokens); repeated rows and missing ids keep a row each;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices, texts_of

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, BYTE = 1, 6  # kinds of pieces
NONE = np.iinfo(np.int32).max
BLOCK = 1 << 16  # symbols merged at once; a single longer pre-token is a block of its own


class Pieces:
    """Merge tables of a vocabulary: symbols are numbered, and a pair of numbers looks up the joined piece."""

    def __init__(self, scored: list[tuple[str, float]]) -> None:
        ordered = sorted(range(len(scored)), key=lambda i: (-scored[i][1], i))
        self.rank = {scored[i][0]: r for r, i in enumerate(ordered)}  # piece -> rank, 0 merges first
        pieces = [scored[i][0] for i in ordered]
        self.number = dict(self.rank)  # symbols that are pieces carry their rank as number
        keys, joined = [], []
        lower: set[int] = set()
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                for part in (left, right):
                    if part is not None and rank < part:
                        lower.add(part)
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    joined.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.joined = np.array(joined, np.int32)[order]
        self.careful = np.zeros(len(pieces) + 1, bool)  # pieces that may be part of an earlier one
        self.careful[list(lower)] = True
        self.size = len(pieces)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair makes, ``NONE`` if it makes none."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left < self.size) & (right < self.size), self.joined[at], NONE).astype(np.int32)

    def symbols(self, token: str, other: dict[str, int]) -> list[int]:
        """Numbers of the characters; a character that is no piece gets one above all pieces."""
        number, size = self.number, self.size
        return [number[c] if c in number else other.setdefault(c, size + len(other)) for c in token]


def count_pieces(tokens: list[str], pieces: Pieces) -> np.ndarray:
    """Number of symbols each pre-token ends with; characters outside the vocabulary count as their bytes."""
    out = np.zeros(len(tokens), np.int64)
    start = 0
    while start < len(tokens):
        stop, total = start, 0
        while stop < len(tokens) and (stop == start or total + len(tokens[stop]) <= BLOCK):
            total += len(tokens[stop])
            stop += 1
        out[start:stop] = _merge(tokens[start:stop], pieces)
        start = stop
    return out


def _merge(tokens: list[str], pieces: Pieces) -> np.ndarray:
    other: dict[str, int] = {}
    flat = np.array([s for t in tokens for s in pieces.symbols(t, other)], np.int64)
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    weight = np.ones(pieces.size + len(other), np.int64)
    for c, number in other.items():
        weight[number] = len(c.encode("utf-8", "surrogatepass"))
    counts = np.zeros(len(tokens), np.int64)
    place = np.arange(len(flat))
    rank = np.full(len(flat), NONE, np.int32)  # of the pair that begins at a symbol
    fresh = place[:-1]
    while True:
        if len(fresh):
            same = owner[fresh] == owner[fresh + 1]
            rank[fresh] = np.where(same, pieces.pair_rank(flat[fresh], flat[fresh + 1]), NONE)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, int)
        if not len(first):
            return counts
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NONE
        size = np.diff(np.concatenate((first, [len(flat)])))
        if done.any():  # finished sequences leave the arrays
            gone = np.repeat(done, size)
            np.add.at(counts, owner[gone], weight[flat[gone]])
            flat, owner, rank = flat[~gone], owner[~gone], rank[~gone]
            lowest, size = lowest[~done], size[~done]
            if not len(flat):
                return counts
        target = np.repeat(lowest, size)
        hit = np.flatnonzero(rank == target)
        group = owner[hit]
        run = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (group[1:] != group[:-1])))
        in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        leftmost = np.concatenate(([True], group[1:] != group[:-1]))
        # of overlapping hits every second one merges; a careful piece merges once a round
        take = np.where(pieces.careful[target[hit]], leftmost, in_run % 2 == 0)
        hit = hit[take]
        flat[hit] = rank[hit]
        keep = np.ones(len(flat), bool)
        keep[hit + 1] = False
        flat, owner, rank = flat[keep], owner[keep], rank[keep]
        at = hit - np.arange(len(hit))  # where the merged symbols are now
        rank[at] = NONE
        fresh = np.unique(np.concatenate((at, at[at > 0] - 1)))
        last = fresh >= len(flat) - 1
        rank[fresh[last]] = NONE
        fresh = fresh[~last]


class TokenCounter:
    """Counts the tokens that a BPE piece model of the sentencepiece kind makes of a text."""

    def __init__(self, path: str, remembered: int = 500_000) -> None:
        """``remembered`` bounds the pre-tokens whose counts are kept from one batch to the next."""
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        kinds = {p.type for p in model.pieces} <= {1, 2, 3, BYTE}
        if spec.model_type != 2 or not spec.byte_fallback or not plain or not kinds or spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not a BPE model with byte fallback and without normalisation")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        scored = [(p.piece, p.score) for p in model.pieces if p.type == NORMAL]
        if any(MARK in p.lstrip(MARK) for p, _ in scored):
            raise ValueError("a piece crosses a word mark")
        self.pieces = Pieces(scored)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def pre_tokens(self, text: str) -> list[str]:
        return PRE_TOKEN.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        split = [Counter(self.pre_tokens(t)) for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        known.update(zip(new, count_pieces(new, self.pieces).tolist()))
        return [sum(known[w] * n for w, n in words.items()) for words in split]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``; ``path`` is read by each worker from its own install."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))

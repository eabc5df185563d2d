"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Counting goes in three aggregations, each of which combines within its tasks before anything is shuffled:

1. words: counts by 64-bit hash, range-partitioned into sorted arrays. A word's rank is its place in them.
2. bigrams: pairs of ranks. The running sum of word counts gives each context as much room on a line as it
   has tokens, and a bigram lies within its context's room at a place that depends on its second word. The
   line is cut into shards of equal length, so a shard holds about ``SHARD_TOKENS`` tokens, whatever the
   contexts are: a context with a third of all tokens lies in a third of all shards.
3. continuations: in how many contexts each word was seen, by ranges of ranks.

Every shard becomes sorted arrays in a folder that all workers see: word hashes with counts and running sums,
bigram keys with counts, per context its numbers of bigrams seen once, twice and more often, and per word its
number of contexts. Workers map these files and look up sorted blocks of keys, so a worker's memory does not
grow with the model. Counts, not probabilities, are stored; discounts are four numbers each.

A document is a run of words, then one end; the end is also the context of the first word. Letters A-Z count
as a-z. The unseen share of the lowest order is spread evenly over all words and one unknown word.

Rows: a missing text counts as empty and has one token, its end; a missing id has the id text ``null`` for
the split; repeated rows count as often as they come and keep a row each; texts are read whole; extra columns
are dropped. Without training rows every token has probability one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WordHasher, mix, mounted, new_table, remainder, slices, stored, texts_of

END = np.uint64(0x5E5E5E5E00000001)  # stands for the end of a text; no word's hash but by chance
SHARD_TOKENS = 4_000_000
PART_WORDS = 2_000_000
HELD = 1 << 21  # distinct keys a counting task holds before it hands them on
LOW = np.int64(0xFFFFFFFF)


# arrays as files


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under its name in one step, so that a repeated task replaces it by the same."""
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(draft, values)
    os.replace(draft, f"{folder}/{name}.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as compressed differences."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


def packed_counts(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.int64).tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int64)


class Tally:
    """Counts of keys, held as sorted arrays and merged when they grow."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.parts.append(summed(keys, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size += len(self.parts[-1][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.merged()
        self.parts, self.size = [], 0
        return keys, counts

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
            counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
            self.parts = [summed(keys, counts)]
        self.size = len(self.parts[0][0])
        return self.parts[0]

    def full(self) -> bool:
        """Whether there are too many keys, also once equal ones are merged."""
        if self.size < HELD:
            return False
        self.merged()
        return self.size >= HELD // 2


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# the model


@dataclass
class Model:
    """Where the arrays are, and the few numbers that belong to them."""

    folder: str
    tokens: int  # N
    parts: list[tuple[int, int, int, int]]  # of the words: first hash, words, first rank, tokens before
    shards: int
    span: int  # ranks in a range of continuations
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    types: int  # distinct bigrams
    unseen: float  # share of the lowest order spread evenly
    filled: frozenset[int] = frozenset()  # shards with bigrams; a bigram as frequent as a shard is long leaves its neighbours empty

    @property
    def words(self) -> int:
        return sum(p[1] for p in self.parts)


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries seen once to four times."""
    y = ones / (ones + 2 * twos) if ones + 2 * twos else 0.0
    pairs = ((1, ones, twos), (2, twos, threes), (3, threes, fours))
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 * k for k, a, b in pairs)


def off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(counts, 3)]


class Lookup:
    """Reads a model's arrays. Files are mapped when first needed; all look-ups go in sorted order."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        self.firsts = np.array([p[0] for p in model.parts], np.int64)

    def array(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = mapped(self.model.folder, name)
        return self.open[name]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of sorted word hashes (signed), -1 for words that were not seen."""
        out = np.full(len(hashes), -1, np.int64)
        part = np.searchsorted(self.firsts, hashes, side="right") - 1
        for p in np.unique(part[part >= 0]):
            mine = np.flatnonzero(part == p)
            words = self.array(f"words-{p}")
            at = np.minimum(np.searchsorted(words, hashes[mine]), len(words) - 1)
            out[mine] = np.where(words[at] == hashes[mine], at + self.model.parts[p][2], -1)
        return out

    def _of_rank(self, name: str, ranks: np.ndarray) -> np.ndarray:
        starts = np.array([p[2] for p in self.model.parts], np.int64)
        out = np.zeros(len(ranks), np.int64)
        part = np.searchsorted(starts, ranks, side="right") - 1
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            out[mine] = self.array(f"{name}-{p}")[ranks[mine] - starts[p]]
        return out

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        return self._of_rank("counts", ranks)

    def rooms(self, ranks: np.ndarray) -> np.ndarray:
        """Where each context's room begins on the line of all tokens."""
        return self._of_rank("before", ranks)

    def contexts(self, ranks: np.ndarray) -> np.ndarray:
        """In how many contexts each word was seen."""
        out, part = np.zeros(len(ranks), np.int64), ranks // self.model.span
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            out[mine] = self.array(f"contexts-{p}")[ranks[mine] - p * self.model.span]
        return out

    def shard(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each bigram."""
        left, right = keys >> 32, keys & LOW
        heads, place = np.unique(left, return_inverse=True)
        share = (mix(right.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        at = self.rooms(heads)[place] + (share * self.counts(heads)[place]).astype(np.int64)
        return at * self.model.shards // max(1, self.model.tokens)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram keys."""
        out, shard = np.zeros(len(keys), np.int64), self.shard(keys)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.unique(shard):
            mine = order[edges[s] : edges[s + 1]]
            if s in self.model.filled:
                known = self.array(f"bigrams-{s}")
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                out[mine] = np.where(known[at] == keys[mine], self.array(f"bigram-counts-{s}")[at], 0)
        return out

    def followers(self, ranks: np.ndarray) -> np.ndarray:
        """For each context, how many bigrams were seen once, twice and more often (columns)."""
        out = np.zeros((len(ranks), 3), np.int64)
        room, size = self.rooms(ranks), self.counts(ranks)
        first = room * self.model.shards // self.model.tokens
        last = (room + size - 1) * self.model.shards // self.model.tokens
        owner = np.repeat(np.arange(len(ranks)), last - first + 1)
        shard = np.arange(len(owner)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[owner]
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.unique(shard):
            mine = owner[order[edges[s] : edges[s + 1]]]
            if s in self.model.filled:
                heads = self.array(f"heads-{s}")
                at = np.minimum(np.searchsorted(heads, ranks[mine]), len(heads) - 1)
                hit = heads[at] == ranks[mine]
                out[mine[hit]] += self.array(f"head-counts-{s}")[at[hit]]
        return out


# counting


def _streams(texts: list[str], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (signed) of the tokens of all texts, each with its end, and the number of tokens of each."""
    hashes, sizes = hasher.documents(texts)
    return np.insert(hashes, np.cumsum(sizes), END).view(np.int64), sizes + 1


def count_words(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, tally = WordHasher(), Tally()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a) for a in tally.take()], ["word", "n"])

        for batch in slices(batches, "text"):
            tally.add(_streams(texts_of(batch), hasher)[0])
            if tally.full():
                yield rows()
        yield rows()

    return train.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_arrays(words: DataFrame, folder: str, parts: int) -> list[tuple[int, int, int, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            part = TaskContext.get().partitionId()
            hashes, counts = (np.concatenate(c) for c in zip(*got))
            save(folder, f"part-{part}-words", hashes)
            save(folder, f"part-{part}-counts", counts)
            row = [part, int(hashes[0]), len(hashes), int(counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], ["part", "first", "words", "tokens"])

    dealt = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    found = sorted(dealt.mapInArrow(run, "part long, first long, words long, tokens long").collect(), key=lambda r: r["first"])
    out, rank, before = [], 0, 0
    for place, row in enumerate(found):  # a few numbers a part; the arrays are renamed by their order
        out.append((row["first"], row["words"], rank, before))
        os.replace(f"{folder}/part-{row['part']}-words.npy", f"{folder}/words-{place}.npy")
        os.replace(f"{folder}/part-{row['part']}-counts.npy", f"{folder}/counts-{place}.npy")
        rank, before = rank + row["words"], before + row["tokens"]
    return out


def _running_sums(spark, model: Model) -> None:
    """Adds to each part of the words its running sums of counts."""
    folder, parts = model.folder, model.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                counts = mapped(folder, f"counts-{p}")
                save(folder, f"before-{p}", parts[p][3] + np.cumsum(counts) - counts)
            yield batch

    spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, "id long").count()


def _bigram_blocks(train: DataFrame, model: Model) -> DataFrame:
    """``(shard, keys, counts)``: each task's bigrams, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, tally, look = WordHasher(), Tally(), Lookup(model)

        def rows() -> pa.RecordBatch:
            keys, counts = tally.take()
            shard = look.shard(keys)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(model.shards + 1))
            some = np.unique(shard)
            cuts = [order[edges[s] : edges[s + 1]] for s in some]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()), pa.array([packed(keys[c]) for c in cuts], pa.binary()),
                    pa.array([packed_counts(counts[c]) for c in cuts], pa.binary()),
                ],
                ["shard", "keys", "counts"],
            )

        for batch in slices(batches, "text"):
            tokens, sizes = _streams(texts_of(batch), hasher)
            words, place = np.unique(tokens, return_inverse=True)
            ranks = look.ranks(words)[place]
            tally.add((_previous(ranks, sizes, look) << 32) | ranks)
            if tally.full():
                yield rows()
        yield rows()

    return train.select(F.col("text").cast("string")).mapInArrow(run, "shard long, keys binary, counts binary")


def _previous(ranks: np.ndarray, sizes: np.ndarray, look: Lookup) -> np.ndarray:
    """The rank before each token; before the first of a text, that of the end."""
    before = np.empty_like(ranks)
    before[1:] = ranks[:-1]
    before[np.cumsum(sizes) - sizes] = look.ranks(np.array([END]).view(np.int64))[0]
    return before


def _merge_bigrams(blocks: DataFrame, model: Model) -> DataFrame:
    """Writes the arrays of each shard; ``(part, words, contexts)`` and, with part -1, the shard and its counts of counts."""
    folder, span = model.folder, model.span

    def run(table: pa.Table) -> pa.Table:
        shard = table.column(0)[0].as_py()
        parts = [(unpacked(k.as_py()), unpacked_counts(c.as_py())) for k, c in zip(table.column(1), table.column(2))]
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        save(folder, f"bigrams-{shard}", keys)
        save(folder, f"bigram-counts-{shard}", counts)
        heads, first = np.unique(keys >> 32, return_index=True)
        kinds = np.stack([counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)
        save(folder, f"heads-{shard}", heads)
        save(folder, f"head-counts-{shard}", np.add.reduceat(kinds, first, axis=0).astype(np.int32) if len(first) else kinds)
        words, contexts = summed(keys & LOW, np.ones(len(keys), np.int64))
        part = words // span
        some, start = np.unique(part, return_index=True)
        ends = np.append(start[1:], len(words))
        ofs = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        return pa.table({
            "part": pa.array([-1, *some.tolist()], pa.int64()),
            "words": pa.array([packed(np.array([shard])), *[packed(words[a:b]) for a, b in zip(start, ends)]], pa.binary()),
            "contexts": pa.array([packed_counts(np.append(ofs, len(keys))), *[packed_counts(contexts[a:b]) for a, b in zip(start, ends)]], pa.binary()),
        })

    return blocks.groupBy("shard").applyInArrow(run, "part long, words binary, contexts binary")


def _merge_contexts(partial: DataFrame, model: Model) -> np.ndarray:
    """Writes the continuation counts; numbers of words with one to four contexts, with three or more, and their sum."""
    folder, span, words = model.folder, model.span, model.words

    def run(table: pa.Table) -> pa.Table:
        part = table.column(0)[0].as_py()
        out = np.zeros(max(0, min(span, words - part * span)), np.int64)
        for w, c in zip(table.column(1), table.column(2)):
            out[unpacked(w.as_py()) - part * span] += unpacked_counts(c.as_py())
        save(folder, f"contexts-{part}", out.astype(np.int64))
        ofs = np.bincount(np.minimum(out, 5), minlength=6)[1:5].tolist()
        return pa.table({"ofs": pa.array([[*ofs, int((out > 2).sum()), int(out.sum())]], pa.list_(pa.int64()))})

    found = partial.where("part >= 0").groupBy("part").applyInArrow(run, "ofs array<long>").collect()
    return np.sum([r["ofs"] for r in found], axis=0) if found else np.zeros(6, np.int64)


def train_model(train: DataFrame, shard_tokens: int = SHARD_TOKENS, part_words: int = PART_WORDS, mount: tuple[str, str] | None = None) -> Model:
    """Counts the texts of ``train`` and writes the model's arrays to the shared folder."""
    spark = train.sparkSession
    folder = mounted(new_table(spark, "ngrams"), mount)
    words = stored(count_words(train), "words")
    distinct, tokens = words.agg(F.count("word"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if distinct >= 2**31:
        raise ValueError("more words than two ranks of 32 bits can tell apart")
    parts = _word_arrays(words, folder, max(1, -(-distinct // part_words))) if distinct else []
    shards = max(1, -(-tokens // shard_tokens))
    span = max(1, -(-distinct // shards))
    model = Model(folder, tokens, parts, shards, span, (0.0,) * 3, (0.0,) * 3, 0, 1.0)
    if not distinct:
        return model
    _running_sums(spark, model)
    partial = stored(_merge_bigrams(_bigram_blocks(train, model), model), "contexts")
    of_shard = partial.where("part = -1").collect()  # a few numbers a shard
    model.filled = frozenset(int(unpacked(r["words"])[0]) for r in of_shard)
    ofs = np.sum([unpacked_counts(r["contexts"]) for r in of_shard], axis=0)
    lower = _merge_contexts(partial, model)
    model.discounts, model.lower = discounts(*ofs[:4].tolist()), discounts(*lower[:4].tolist())
    model.types = int(lower[5])
    model.unseen = float(model.lower[0] * lower[0] + model.lower[1] * lower[1] + model.lower[2] * lower[4]) / model.types
    return model


# scoring


def score_texts(texts: list[str], hasher: WordHasher, look: Lookup) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, and the base-10 logarithms of its base and model probability."""
    model = look.model
    tokens, sizes = _streams(texts, hasher)
    words, place = np.unique(tokens, return_inverse=True)
    ranks = look.ranks(words)
    seen = ranks >= 0
    counts, contexts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    counts[seen], contexts[seen] = look.counts(ranks[seen]), look.contexts(ranks[seen])
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    lowest = (contexts - off(contexts, model.lower)) / max(1, model.types) + model.unseen / (model.words + 1)
    likely = lowest[place]
    if seen.any():
        of_token = ranks[place]
        before = _previous(of_token, sizes, look)
        inside = np.flatnonzero(before >= 0)
        heads, head = np.unique(before[inside], return_inverse=True)
        size = look.counts(heads)
        spare = look.followers(heads) @ np.array(model.discounts) / size
        both = inside[of_token[inside] >= 0]
        keys, pair = np.unique((before[both] << 32) | of_token[both], return_inverse=True)
        pairs = look.bigrams(keys)
        upper = np.zeros(len(tokens))
        upper[both] = (pairs - off(pairs, model.discounts))[pair]
        likely = likely.copy()
        likely[inside] = upper[inside] / size[head] + spare[head] * likely[inside]
    first = np.cumsum(sizes) - sizes
    return {
        "n_tokens": sizes,
        "n_known": np.add.reduceat((counts > 0)[place].astype(np.int64), first),
        "base_score": np.add.reduceat(base[place], first),
        "score": np.add.reduceat(np.log10(likely), first),
    }


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)``, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, look = WordHasher(), Lookup(model)
        for batch in slices(batches, "text", 1 << 22):
            found = score_texts(texts_of(batch), hasher, look)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in found.values()]], ["doc_id", *found])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2


def op2_kneser_ney(docs: DataFrame) -> DataFrame:
    model = train_model(docs.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )

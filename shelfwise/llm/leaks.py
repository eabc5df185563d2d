"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items are cut into passages of words. Passages are TF-IDF vectors over the benchmark's
vocabulary, with document frequencies counted over the whole corpus. A randomised SVD of the benchmark's
passages (a sketch by random directions and a projection on its range, both summed over Spark tasks) gives
the latent space; the corpus passages are folded in. The SVD is of the benchmark's passages, as the leading
directions of the corpus are its function words and would not tell one item from another.

A corpus passage is a candidate for an item if their latent cosine is at least ``COSINE`` and it covers at
least ``COVER`` of the item's weight. Items of 6 to 20 words are compared with passages of their own size (``WINDOWS``), in
which other words do not outweigh them; and where a passage holds an item's weightiest word and covers ``NEAR`` of the
item, it is a candidate whatever their cosine, since a space of few dimensions cuts off the own direction of some items
among many. A term adds to the cover of an item at most its largest share of any item's weight; passages where these do
not add up to ``COVER`` are passed over beforehand, which loses nothing.
Candidates are then read word by word with the text around them: the longest common subsequence must hold
``COPY`` of the item passage's words, or ``PARAPHRASE`` of them if the item's answer (its last sentence, or
the column ``answer``) is there as well; of items of 6 to 10 words it must hold more, as few words meet by chance.

The benchmark is the query set: its passages are cut by Spark from its table, at most ``MOST_WORDS`` words of it (more are
refused) are held by every task. All documents run against it in blocks, in two passes without a shuffle of texts.
Letters A-Z count as a-z, punctuation parts words.

Rows: a missing text has no passages; a text shorter than a passage is one; whole texts are read; repeated
rows and missing ids keep their leaks each; a benchmark row without id or words is passed over; items alike
are each reported; an empty benchmark has no leaks. Extra columns of documents are kept by ``marked``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.llm.common import WordHasher, slices, stored, texts_of

PASSAGE, STRIDE = 40, 20  # words
RANK, SPARE = 256, 16  # latent dimensions, and random directions besides
COSINE, COVER, NEAR = 0.5, 0.3, 0.95
ANSWERED = 0.8
MOST_WORDS = 5_000_000  # of the benchmark's passages


@dataclass(frozen=True)
class Window:
    """How item passages of up to ``most`` words, and at least ``least``, are compared with a text."""

    least: int
    most: int
    size: int
    stride: int
    cover: float
    copy: float
    paraphrase: float


#: An item of 6 to 20 words lies whole in one of the passages of its size.
WINDOWS = (Window(6, 10, 16, 5, 0.6, 0.8, 0.6), Window(11, 20, 31, 10, COVER, 0.6, 0.4), Window(0, PASSAGE, PASSAGE, STRIDE, COVER, 0.6, 0.4))
BLOCK = 4096  # passages compared at once
PARTS_WORDS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SENTENCE = re.compile(r"[.!?]+")


def windows(n: int, size: int = PASSAGE, stride: int = STRIDE) -> np.ndarray:
    """Starts of the passages of ``n`` words; the last one ends with the last word."""
    if n <= size:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.append(np.arange(0, n - size, stride), n - size))


def common_length(left: list[int], right: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | (1 << i)
    row = full = (1 << len(left)) - 1
    for word in right:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(left) - row.bit_count()


@dataclass
class Items:
    """The benchmark's passages and their place in the latent space."""

    ids: list[int] = field(default_factory=list)  # of each passage
    words: list[list[int]] = field(default_factory=list)
    answers: list[list[int]] = field(default_factory=list)
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word hashes
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # term x dimension
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # passage x dimension, unit rows
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # squared length of each passage's vector
    sets: list[np.ndarray] = field(default_factory=list)  # the terms of each passage
    groups: list[Group] = field(default_factory=list)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


class Group:
    """The passages that are compared by one window."""

    def __init__(self, window: Window, chosen: np.ndarray, items: Items) -> None:
        self.window, self.chosen = window, chosen
        self.latent = np.ascontiguousarray(items.latent[chosen].T)
        self.most = np.zeros(len(items.terms))  # the largest part of a passage's weight that each term has
        weightiest = []
        for j in chosen:
            share = items.idf[items.sets[j]] ** 2 / items.weight[j]
            self.most[items.sets[j]] = np.maximum(self.most[items.sets[j]], share)
            weightiest.append(items.sets[j][share.argmax()])
        order = np.argsort(weightiest, kind="stable")
        self.anchored = chosen[order]  # the passages by their weightiest term
        self.first = np.searchsorted(np.array(weightiest)[order], np.arange(len(items.terms) + 1))

    def anchors(self, row: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in the list of passages, and an item passage whose weightiest term stands there."""
        counts = self.first[terms + 1] - self.first[terms]
        places = np.repeat(self.first[terms] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(row, counts), self.anchored[places]


def passages(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, answer)``: the word hashes of the passages of each item, and of its answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(PARTS_WORDS)
        for batch in slices(batches, "text"):
            out: tuple[list, list, list] = ([], [], [])
            for item_id, text, answer in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                last = [s for s in SENTENCE.split(text) if s.strip()][-1:]
                words, answered = (hasher.documents([t])[0].view(np.int64).tolist() for t in (text, answer or "".join(last)))
                for start in windows(len(words)):
                    for values, value in zip(out, (item_id, words[start : start + PASSAGE], answered)):
                        values.append(value)
            hashes = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], hashes), pa.array(out[2], hashes)], ["item_id", "words", "answer"])

    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.cast("string").alias("answer"))
    return rows.mapInArrow(run, "item_id long, words array<long>, answer array<long>")


def read_items(cut: DataFrame, most_words: int = MOST_WORDS) -> Items:
    """The benchmark's passages, which must not have more than ``most_words`` words."""
    size = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the benchmark's passages have {size} words; every task holds them, so at most {most_words} are taken: divide the benchmark")
    items = Items()
    for row in sorted(cut.collect()):
        items.ids.append(row["item_id"])
        items.words.append(row["words"])
        items.answers.append(row["answer"])
    items.words, items.answers = ([np.array(p, np.int64).view(np.uint64).tolist() for p in part] for part in (items.words, items.answers))
    items.terms = np.unique(np.array([w for p in items.words for w in p], np.uint64))
    return items


def numbered(cut: DataFrame, items: Items) -> DataFrame:
    """``(terms)``: the distinct term numbers of each passage."""
    known = Items(terms=items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(known.number(np.array(p, np.int64).view(np.uint64))) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["terms"])

    return cut.select("words").mapInArrow(run, "terms array<long>")


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    terms = items.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found, total = WordHasher(PARTS_WORDS), np.zeros(len(terms), np.int64), 0
        known = Items(terms=terms)
        for batch in slices(batches, "text"):
            hashes, sizes = hasher.documents(texts_of(batch))
            number = known.number(hashes)
            keep = number >= 0
            owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
            pairs = np.unique(owner * len(terms) + number[keep]) if len(terms) else np.zeros(0, np.int64)
            found += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))[: len(terms)]
            total += len(sizes)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(found[some], total), pa.int64())], ["term", "n"]
        )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(terms), np.int64), 0
    for term, n in counted.collect():  # a row a benchmark term
        if term < 0:
            total = n
        else:
            out[term] = n
    return out, total


def _summed(rows: DataFrame, make) -> np.ndarray | None:
    """Sum over tasks of the matrix that ``make(terms of each row)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = make(batch.column(0).to_pylist())
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part"])

    parts = [np.frombuffer(r["part"]) for r in rows.select("terms").mapInArrow(run, "part binary").toLocalIterator()]
    return sum(parts[1:], parts[0]) if parts else None


def latent_space(rows: DataFrame, idf: np.ndarray, rank: int = RANK, spare: int = SPARE, seed: int = 10) -> np.ndarray:
    """Term vectors (term x dimension) of a randomised SVD of the rows' TF-IDF vectors.

    ``rows`` has ``terms``, an array of term numbers. One pass sums the sketch A'(A O) for random directions
    O; a second one sums the Gram matrix of A on the sketch's range, whose eigenvectors turn it.
    """
    width = min(rank + spare, len(idf))
    directions = np.random.default_rng(seed).normal(size=(len(idf), width))

    def dense(sets: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sets), len(idf)))
        for i, terms in enumerate(sets):
            out[i, terms] = idf[terms]
        return out

    def blocks(sets: list[list[int]]) -> Iterator[np.ndarray]:
        for at in range(0, len(sets), 256):
            yield dense(sets[at : at + 256])

    sketch = _summed(rows, lambda sets: sum(a.T @ (a @ directions) for a in blocks(sets)))
    if sketch is None:
        return np.zeros((len(idf), 0), np.float32)
    span, _ = np.linalg.qr(sketch.reshape(len(idf), width))
    gram = _summed(rows, lambda sets: sum((a @ span).T @ (a @ span) for a in blocks(sets))).reshape(width, width)
    values, turns = np.linalg.eigh(gram)
    kept = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-9 * values.max()]
    return (span @ turns[:, kept]).astype(np.float32)


def prepare(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Items:
    """Everything the search needs to know of the benchmark."""
    cut = stored(passages(benchmark), "benchmark")
    items = read_items(cut)
    found, total = document_frequencies(docs, items)
    items.idf = np.log((total + 1) / (found + 1)) + 0.01
    sets = items.sets = [np.unique(items.number(np.array(p, np.uint64))) for p in items.words]
    items.weight = np.array([(items.idf[s] ** 2).sum() for s in sets])
    if not sets:
        return items
    items.basis = latent_space(numbered(cut, items), items.idf, rank)
    latent = np.array([items.idf[s] @ items.basis[s] for s in sets], np.float32)
    items.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    kinds = np.array([next(k for k, w in enumerate(WINDOWS) if w.least <= len(p) <= w.most) for p in items.words])
    items.groups = [Group(WINDOWS[k], np.flatnonzero(kinds == k), items) for k in np.unique(kinds)]
    return items


def _sets(number: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of the passages at ``starts``: the place of each passage in the list, and its terms."""
    spread = starts[:, None] + np.arange(size)
    terms = np.where(spread < len(number), number[np.minimum(spread, len(number) - 1)], -1)
    terms.sort(axis=1)
    fresh = terms >= 0
    fresh[:, 1:] &= terms[:, 1:] != terms[:, :-1]
    return np.nonzero(fresh)[0], terms[fresh]


def _candidates(number: np.ndarray, items: Items, group: Group) -> Iterator[tuple[int, int, float]]:
    """``(start, item passage, cosine)`` of the passages of a text that may copy an item passage of the group."""
    window = group.window
    mass = np.concatenate(([0.0], np.cumsum(np.where(number >= 0, group.most[number], 0.0))))
    starts = windows(len(number), window.size, window.stride)
    ends = np.minimum(starts + window.size, len(number))
    starts = starts[mass[ends] - mass[starts] >= window.cover - 1e-9]
    here = np.zeros(len(items.terms), bool)
    for at in range(0, len(starts), BLOCK):
        some = starts[at : at + BLOCK]
        row, terms = _sets(number, some, window.size)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        latent = np.add.reduceat(items.basis[terms] * items.idf[terms, None].astype(np.float32), first)
        length = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
        cosine = (latent / length[:, None]) @ group.latent
        ends = np.append(first[1:], len(terms))
        near, item = np.nonzero(cosine >= COSINE)
        least = {(i, j): window.cover for i, j in zip(near.tolist(), group.chosen[item].tolist())}
        for i, j in zip(*(a.tolist() for a in group.anchors(row, terms))):
            least.setdefault((i, j), NEAR)
        column = {j: k for k, j in enumerate(group.chosen.tolist())} if least else {}
        for (i, j), cover in least.items():
            here[terms[first[i] : ends[i]]] = True
            shared = items.sets[j][here[items.sets[j]]]
            here[terms[first[i] : ends[i]]] = False
            if (items.idf[shared] ** 2).sum() >= cover * items.weight[j]:
                yield int(some[i]), j, float(cosine[i, column[j]])


def find(hashes: np.ndarray, items: Items) -> list[dict]:
    """The leaks in a text, given the hashes of its words: the best passage for each item, by item."""
    best: dict[int, dict] = {}
    if not len(items.ids) or not len(hashes):
        return []
    number = items.number(hashes)
    for group in items.groups:
        window = group.window
        for start, j, cosine in _candidates(number, items, group):
            words = items.words[j]
            around = hashes[max(0, start - window.stride) : start + window.size + window.stride].tolist()
            copied = common_length(words, around) / len(words)
            answer = set(items.answers[j])
            answered = len(answer & set(around)) / len(answer) if answer else 0.0
            if copied >= window.copy or (copied >= window.paraphrase and answered >= ANSWERED):
                leak = {"item_id": items.ids[j], "start": start, "cosine": cosine, "copied": copied, "answered": answered}
                old = best.get(items.ids[j])
                if old is None or (leak["copied"], -leak["start"]) > (old["copied"], -old["start"]):
                    best[items.ids[j]] = leak
    return [best[k] for k in sorted(best)]


LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("cosine", pa.float64()), ("copied", pa.float64()), ("answered", pa.float64())])


def marked(docs: DataFrame, items: Items, name: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and an array with the leaks of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(PARTS_WORDS)
        for batch in slices(batches, "text"):
            hashes, sizes = hasher.documents(texts_of(batch))
            parts = np.split(hashes, np.cumsum(sizes)[:-1])
            found = pa.array([find(p, items) for p in parts], pa.list_(LEAK))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    kind = StructType.fromDDL(f"`{name}` array<struct<item_id:bigint,start:bigint,cosine:double,copied:double,answered:double>>")
    return docs.mapInArrow(run, StructType([*docs.schema, *kind]))


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per leaked item and document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = marked(rows, prepare(rows, benchmark)).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.start", F.round("leak.cosine", 4).alias("cosine"), "leak.copied", "leak.answered")

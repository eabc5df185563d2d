"""Document quality by Bradley-Terry ranking.

Each text is described by a fixed list of figures about its words, lines and letters; nothing else of a row
is an input. Every pair of a good and a bad labelled document is a comparison the good one wins, and the
weights are those under which such outcomes are likeliest: logistic loss on differences of features. Each
figure enters by the soft steps it has passed of the quantiles of that figure, so its effect needs not be
straight. A document's strength is its weighted sum. The cut is a quantile of the strengths of the labelled
sample, that at which good and bad are told apart best; the score is a logistic function of the distance
from the cut, with ``THRESHOLD`` at the cut.

The weights are fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and on
``PAIRS`` pairs drawn from them; all documents are scored, in one pass without a shuffle.

Rows: a missing text counts as empty and gets the score of an empty text; texts are read whole; repeated
rows keep a row each; a missing id is never labelled; labels that are missing or contradict each other for
an id are not used; without labels of both kinds every score is ``THRESHOLD``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfwise.llm.common import remainder, slices, texts_of

SAMPLE = 12_000
PAIRS = 20_000
THRESHOLD = 0.3
FIGURES = (
    "log_words", "word_length", "long_words", "distinct_words", "repeats", "top_word", "short_words",
    "upper", "digits", "marks", "bangs", "bars", "symbols", "marked_words", "capital_words", "upper_words",
    "line_length", "distinct_lines", "sentence_length", "outside_ascii", "packed", "distinct_pairs", "letters", "stops",
)
LEVELS = (0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.94, 0.97, 0.99, 1)  # quantiles between which steps rise
MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\x0b\x0c\r")
SYMBOLS = b"#$%&*@^~<>|\\{}[]=+"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
OUTSIDE = bytes(range(128, 256))
PACKED = 1 << 16  # bytes packed at once


def _packed(raw: bytes) -> float:
    """Compressed share of the bytes; parts of one size are packed apart, so that long texts compare with short ones."""
    sizes = [len(zlib.compress(raw[i : i + PACKED], 1)) for i in range(0, len(raw), PACKED)]
    return sum(sizes) / max(1, len(raw))


def figures(text: str) -> list[float]:
    """The figures of a text, in the order of ``FIGURES``."""
    words = text.split()
    raw = text.encode("utf-8", "surrogatepass")
    n, size = max(1, len(words)), max(1, len(raw))

    def share(letters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, letters))) / size

    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    stops = raw.count(b".")
    return [
        np.log1p(len(words)), lengths.sum() / n, (lengths > 12).sum() / n, len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values(), default=0) / n, (lengths < 4).sum() / n,
        share(UPPER), share(DIGITS), share(MARKS), raw.count(b"!") / size, raw.count(b"|") / n, share(SYMBOLS),
        sum(not w[-1].isalnum() for w in words) / n, sum(w[0].isupper() for w in words) / n, sum(map(str.isupper, words)) / n,
        np.log1p(size / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), np.log1p(n / (stops + 1)),
        share(OUTSIDE), _packed(raw), len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        share(UPPER + UPPER.lower()), stops / n,
    ]


@dataclass
class Ranking:
    """Strengths of texts from their figures."""

    knots: np.ndarray  # figure x quantile
    weights: np.ndarray
    cut: float
    slope: float

    def features(self, rows: np.ndarray) -> np.ndarray:
        low, high = self.knots[:, :-1], self.knots[:, 1:]
        width = np.where(high > low, high - low, 1.0)
        steps = np.clip((rows[:, :, None] - low) / width, 0, 1) * (high > low)
        return steps.reshape(len(rows), -1)

    def strength(self, rows: np.ndarray) -> np.ndarray:
        # summed row by row, so that equal texts have equal strengths whatever stands beside them
        return (self.features(rows) * self.weights).sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = self.slope * (self.strength(rows) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def fit(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, rounds: int = 12, seed: int = 4) -> Ranking:
    """Bradley-Terry weights by Newton steps over pairs, taken in blocks; then the cut and the slope."""
    knots = np.quantile(rows, LEVELS, axis=0).T if len(rows) else np.zeros((len(FIGURES), len(LEVELS)))
    model = Ranking(knots, np.zeros(knots.shape[0] * (knots.shape[1] - 1)), 0.0, 0.0)
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(winners) or not len(losers):
        return model
    rng = np.random.default_rng(seed)
    features = model.features(rows)
    left, right = rng.choice(winners, pairs), rng.choice(losers, pairs)
    for _ in range(rounds):
        gradient, curve = ridge * model.weights, ridge * np.eye(len(model.weights))
        for at in range(0, pairs, 4096):
            apart = features[left[at : at + 4096]] - features[right[at : at + 4096]]
            lost = 1 / (1 + np.exp(np.clip(apart @ model.weights, -30, 30)))
            gradient -= apart.T @ lost
            curve += apart.T @ (apart * (lost * (1 - lost))[:, None])
        step = np.linalg.solve(curve, gradient)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-4:
            break
    strength = model.strength(rows)
    order = np.sort(strength)
    levels = np.unique(np.linspace(0, 1, 201))
    cuts = np.quantile(order, levels)
    apart = [(strength[winners] >= c).mean() + (strength[losers] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(apart) >= max(apart) - 1e-9)
    model.cut = float(np.quantile(order, levels[best].mean()))
    spread = strength[winners].std() + strength[losers].std()
    model.slope = float(4 / spread) if spread > 0 else 1.0
    return model


def _figures_of(docs: DataFrame, keep: list[str], types: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = pa.array([figures(t) for t in texts_of(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [rows], [*keep, "figures"])

    return docs.mapInArrow(run, f"{types}, figures array<double>")


def learn(docs: DataFrame, labels: DataFrame, usable=None, sample: int = SAMPLE) -> Ranking:
    """Fits a ranking on at most ``sample`` labelled rows; ``usable`` is a condition on ``doc_id``."""
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    if usable is not None:
        given = given.where(usable)
    one = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"), F.max("quality").alias("most"))
    drawn = one.where("good = most AND good IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(drawn.select("doc_id", F.col("good").cast("int"))), "doc_id"  # at most ``sample`` rows
    )
    found = _figures_of(chosen, ["good"], "good int").toPandas()
    rows = np.array(found["figures"].tolist(), float).reshape(len(found), len(FIGURES))
    return fit(rows[np.lexsort(rows.T)], found["good"].to_numpy()[np.lexsort(rows.T)])


def scored(docs: DataFrame, model: Ranking, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score under a name that ``docs`` does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([figures(t) for t in texts_of(batch)], float).reshape(batch.num_rows, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))


def held_out(doc_id):
    return remainder(doc_id, 5) == 0


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    rows = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

"""Chunked documents, a TF-IDF index kept as plain tables, and top-k search by joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfwise.functions import text as t
from shelfwise.session import written, written_in_turn

MAX_TERMS = 8000
BUCKETS_A_TERM = 128  # of the bounds on the counts of pairs, for each term of the vocabulary
SLACK = 1e-8  # scores are rounded to nine places and summed in any order
ROWS = 10_000  # whose words a task counts at once
HELD = 1 << 19  # different terms whose counts a task holds
ASKED = 1000, 200_000  # queries, and terms of them, that meet the index in one pass
PART = 4096  # buckets whose counts go in one row
CELLS = 1 << 21  # scores, or products of weights, that a task holds at once

NO_DOCUMENTS = "No policy documents are available."
NO_CONTENT = "No relevant content found."
NO_CONTEXT = "No relevant documents found."


def chunk_sentences(docs: DataFrame, doc: str = "doc_id", size: int = 4, overlap: int = 1, min_len: int = 20) -> DataFrame:
    """``(chunk_id, doc, source, text)`` of overlapping sentence windows; numbering counts kept chunks."""
    split = docs.select(doc, "source", t.sentences(F.col("text")).alias("parts"))
    return _chunks(split, doc, t.sentence_windows(F.col("parts"), size, overlap, min_len), "_chunk_")


def chunk_chars(docs: DataFrame, doc: str = "doc_id", size: int = 500, overlap: int = 50) -> DataFrame:
    return _chunks(docs, doc, t.character_windows(F.col("text"), size, overlap), "_")


def _chunks(docs: DataFrame, doc: str, windows: Column, mark: str) -> DataFrame:
    return docs.select(doc, "source", F.posexplode(windows).alias("n", "text")).select(
        F.concat(F.col(doc).cast("string"), F.lit(mark), "n").alias("chunk_id"), doc, "source", "text"
    )


@dataclass(frozen=True)
class Index:
    """The tables of an index.

    ``chunks(chunk_id, source, text)``, ``vocabulary(term, count, df, idf)`` and ``postings(block, term, top, entries)``: a row
    per term and block of neighbouring chunks, with the chunks' weights (at most 100) and the largest of them. An index
    built here stores ``counted`` (``block_counts``) instead, a fraction of their size, from which a reader of the postings
    derives them and a search scores the chunks; an index with other postings is searched by these.
    """

    chunks: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    stop_words: tuple[str, ...]
    bigrams: bool
    counted: DataFrame | None = field(default=None, init=False)  # not handed on to a copy with other postings

    @classmethod
    def of_counts(cls, chunks: DataFrame, vocabulary: DataFrame, counted: DataFrame, stop_words: tuple[str, ...], bigrams: bool) -> Index:
        terms, idf = vocabulary_lists(vocabulary)
        index = cls(chunks, vocabulary, block_postings(counted, terms, idf), stop_words, bigrams)
        object.__setattr__(index, "counted", counted)
        return index

    @property
    def weights(self) -> DataFrame:
        """``(chunk_id, term, weight)``."""
        return self.postings.select("term", F.inline("entries")).select("chunk_id", "term", "weight")

    def save(self, folder: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        self.vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
        if self.counted is not None:
            self.counted.write.mode("overwrite").parquet(f"{folder}/counted")
        else:  # ordered by term and block, so that a search for a few terms skips most row groups
            placed = self.postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
            placed.write.mode("overwrite").parquet(f"{folder}/postings")
        spark = self.chunks.sparkSession  # queries must be cut into the same terms as the chunks were
        settings = spark.createDataFrame(
            [(list(self.stop_words), self.bigrams, self.counted is not None)], "stop_words array<string>, bigrams boolean, counted boolean"
        )
        settings.coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        settings = spark.read.parquet(f"{folder}/settings").first().asDict()
        stop_words, bigrams = tuple(settings["stop_words"]), settings["bigrams"]
        made, last = (cls.of_counts, "counted") if settings.get("counted") else (cls, "postings")
        return made(*[spark.read.parquet(f"{folder}/{n}") for n in ("chunks", "vocabulary", last)], stop_words, bigrams)


def with_places(vocab: DataFrame) -> DataFrame:
    """Adds ``place``: the number, from 0, of each term in order of count; a vocabulary has ``max_terms`` rows at most."""
    return vocab.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "term")) - 1)


def vocabulary_lists(vocab: DataFrame) -> tuple[list[str], list[float]]:
    """Its terms in order of place, and their inverse document frequencies."""
    rows = vocab.select("term", "count", "idf").orderBy(F.desc("count"), "term").collect()
    return [r["term"] for r in rows], [r["idf"] for r in rows]


def stop_word_list(given: Sequence[str] | None = None) -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english") if given is None else given)


def with_words(rows: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Adds ``words``: the words of ``text`` without stop words."""
    found = F.coalesce(t.words(F.col("text")), F.array().cast("array<string>"))
    return rows.withColumn("words", F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found)


def all_terms(bigrams: bool = True) -> Column:
    """Of rows with ``words``: the words, and pairs of words left side by side."""
    return t.with_pairs(F.col("words")) if bigrams else F.col("words")


def with_terms(rows: DataFrame, stop_words: Sequence[str], bigrams: bool = True) -> DataFrame:
    return with_words(rows, stop_words).withColumn("terms", all_terms(bigrams)).drop("words")


def term_counts(
    listed: DataFrame, keys: Sequence[str], bigrams: bool = True, among: DataFrame | None = None, buckets: int = 0
) -> DataFrame:
    """``(*keys, term, tf)`` of rows with ``words``; with ``among``, of the terms whose ``term_key`` it holds only.

    Words are placed by the first key before they become terms, which are several times their size.
    """
    placed = listed.select(*keys, "words").repartition(keys[0])
    terms = _exploded(placed, all_terms(bigrams), *keys)
    if among is not None:
        terms = terms.withColumn("key", term_key(F.col("term"), buckets)).join(among, "key", "left_semi")
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def _exploded(rows: DataFrame, entries: Column, *keep: str) -> DataFrame:
    # outer, as for an inner explode the optimizer would test the list for entries first and, to do so
    # below the shuffle, build every list several times more
    return rows.select(*keep, F.explode_outer(entries).alias("term")).where(F.col("term").isNotNull())


def term_key(term: Column, buckets: int) -> Column:
    """A word's hash, and a pair's bucket."""
    found = F.xxhash64(term)
    return F.when(term.contains(" "), F.pmod(found, F.lit(buckets))).otherwise(found)


def possible_terms(listed: DataFrame, bigrams: bool, max_terms: int, buckets: int) -> DataFrame:
    """The keys (``term_key``) of the terms that may be among the ``max_terms`` most frequent ones, of rows with ``words``.

    Words are counted, and pairs by bucket: no pair is more frequent than its bucket, and a task sends at most one number
    a bucket, however many different pairs there are. The least count that a word among the ``max_terms`` most frequent
    words has is one that every term of a vocabulary reaches; a pair whose bucket does not is in none.
    """
    uses = F.count(F.lit(1)).alias("total")
    words = written(_exploded(listed, F.col("words")).groupBy("term").agg(uses))
    least, found = words.orderBy(F.desc("total")).limit(max_terms).agg(F.min("total"), F.count(F.lit(1))).first()
    if found < max_terms:  # there are fewer words, so any pair may be in the vocabulary
        least = 0
    enough = F.col("total") >= least
    keys = words.where(enough).select(F.xxhash64("term").alias("key"))
    if bigrams:
        pairs = _exploded(listed, t.pairs(F.col("words"))).select(term_key(F.col("term"), buckets).alias("key"))
        keys = keys.unionByName(pairs.groupBy("key").agg(uses).where(enough).select("key"))
    return written(keys)


def ranked_terms(counts: DataFrame, documents: Column, max_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms of ``(term, tf)``, a row per text and term, with their smooth inverse document frequency."""
    top = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("count"), "term")
        .limit(max_terms)
    )
    return top.withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)


def vocabulary(
    rows: DataFrame, documents: Column, stop_words: Sequence[str], bigrams: bool = True, max_terms: int = MAX_TERMS
) -> DataFrame:
    """The most frequent terms of texts, with their counts and smooth inverse document frequency."""
    listed = written(with_words(rows.select("text"), stop_words).select(F.monotonically_increasing_id().alias("row"), "words"))
    return ranked_terms(_frequent_counts(listed, ["row"], bigrams, max_terms), documents, max_terms)


def _frequent_counts(listed: DataFrame, keys: Sequence[str], bigrams: bool, max_terms: int) -> DataFrame:
    buckets = max_terms * BUCKETS_A_TERM
    return term_counts(listed, keys, bigrams, possible_terms(listed, bigrams, max_terms, buckets), buckets)


def unit_weights(counts: DataFrame, vocab: DataFrame, *keys: str) -> DataFrame:
    """Damped term frequency times idf, scaled to length 1 per key.

    The window per key holds one row per distinct known term, so it is bounded by the vocabulary.
    """
    rows = counts.join(vocab.select("term", "idf"), "term")
    raw = rows.repartition(keys[0]).select(*keys, "term", ((F.log("tf") + 1) * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("raw") / length).alias("weight"))


def block_of(chunk_id: Column) -> Column:
    """The block of a chunk: its id without the last two digits, so up to 100 neighbouring chunks of a document.

    An id that ends in no digit is a block of its own. Any blocks give the same hits; these need no pass over the chunks.
    """
    return F.regexp_replace(chunk_id.cast("string"), "[0-9]{1,2}$", "")


def tfidf_index(
    chunks: DataFrame, max_terms: int = MAX_TERMS, stop_words: Sequence[str] | None = None, bigrams: bool = True
) -> Index:
    """Builds the index. Texts are cut into chunks and words once, and both written: all else is taken from them.

    The words of a chunk are written as one text, parted by blanks, as lists of them take several times the time. Terms
    that may be in the vocabulary are counted, and the most frequent ones go with the tasks (at most ``max_terms`` of
    them). The words are shuffled once, by block; each task counts the known terms of its chunks, a row per block. The
    document frequencies and the weights come from these rows without another shuffle of them.
    """
    stop = stop_word_list(stop_words)
    blocked = chunks.select(block_of(F.col("chunk_id")).alias("block"), "chunk_id", "source", "text")
    listed = written(with_words(blocked, stop).withColumn("words", _as_text()))
    total = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = written(top_terms(listed, bigrams, max_terms))
    terms = [row[0] for row in top.orderBy("place").select("term").collect()]  # at most max_terms
    counted = written(block_counts(listed, terms, bigrams))
    df = counted.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((total + 1) / (F.col("df") + 1)) + 1
    vocab = written(top.join(df, "place").select("term", "count", "df", idf.alias("idf")))
    return Index.of_counts(listed.select("chunk_id", "source", "text"), vocab, counted, stop, bigrams)


def _as_text() -> Column:
    return F.array_join("words", " ")


def top_terms(listed: DataFrame, bigrams: bool, max_terms: int) -> DataFrame:
    """``(term, count, place)`` of the ``max_terms`` most frequent terms of rows with ``words`` as text, numbered from 0 in that order.

    Words are counted exactly, and pairs by bucket as in ``possible_terms``; the pairs of buckets that reach the least count of
    the most frequent words are then counted exactly. The numbers of these buckets go with the tasks, a bit each.
    """
    buckets = max_terms * BUCKETS_A_TERM
    first = written(_first_counts(listed, buckets if bigrams else 0))
    uses = F.sum("total").alias("count")
    counts = written(first.where("term IS NOT NULL").groupBy("term").agg(uses))
    if bigrams:
        least, found = counts.orderBy(F.desc("count")).limit(max_terms).agg(F.min("count"), F.count(F.lit(1))).first()
        if found < max_terms:  # there are fewer words, so any pair may be in the vocabulary
            least = 1
        able = np.zeros(buckets, bool)
        able[_full_buckets(first, least).toArrow().column(0).to_numpy()] = True
        counts = counts.unionByName(_pair_counts(listed, able).groupBy("term").agg(uses))
    order = [F.desc("count"), F.col("term")]
    return with_places(counts.orderBy(*order).limit(max_terms))


MIXERS = np.array([0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class _Words:
    """The words of rows, as places in a list of the different ones."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        self.different: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy()
        self.rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row, the first and the second word of each pair of neighbours."""
        inside = self.rows[1:] == self.rows[:-1]
        return self.rows[1:][inside], self.codes[:-1][inside], self.codes[1:][inside]

    def buckets(self, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
        hashes = self._hashes()
        mixed = (hashes * MIXERS[1])[first] ^ (hashes * MIXERS[2])[second]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MIXERS[0]
        return ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)

    def _hashes(self) -> np.ndarray:
        """A hash of the bytes of each of the different words, the same in every task."""
        lengths = pc.binary_length(self.different).to_numpy().astype(np.int64)
        _, offsets, values = self.different.buffers()
        bounds = np.frombuffer(offsets, np.int32)[self.different.offset :][: len(lengths) + 1]
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values and len(bounds) else np.empty(0, np.uint8)
        ends = np.cumsum(lengths)
        place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, MIXERS[0]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])
        found = sums[ends] - sums[ends - lengths]
        return (found ^ (found >> np.uint64(32))) * MIXERS[1]


class _Totals:
    """Sums of counts by term, of which a task holds a bounded number."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []

    def add(self, terms: pa.Array, totals: np.ndarray) -> Iterator[pa.Table]:
        self.parts.append(pa.table([terms, pa.array(totals, pa.int64())], ["term", "total"]))
        if sum(map(len, self.parts)) > HELD:
            self.parts = [self.summed()]
            if len(self.parts[0]) > HELD // 2:
                yield self.parts.pop()

    def summed(self) -> pa.Table:
        found = pa.concat_tables(self.parts).group_by("term", use_threads=False).aggregate([("total", "sum")])
        return pa.table([found.column("term"), found.column("total_sum")], ["term", "total"])

    def rest(self) -> Iterator[pa.Table]:
        if self.parts:
            yield self.summed()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield _Words(batch.column("words").slice(i, ROWS))


def _first_counts(listed: DataFrame, buckets: int) -> DataFrame:
    """Uses of words ``(term, total)``, to be summed, and of pairs by bucket, ``PART`` buckets a row: ``(part, totals)``."""
    names = ["term", "total", "part", "totals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, pairs = _Totals(), np.zeros(-(-buckets // PART) * PART, np.int64)

        def rows(table: pa.Table) -> list[pa.RecordBatch]:
            none = [pa.nulls(len(table), t) for t in (pa.int32(), pa.list_(pa.int64()))]
            return pa.table([*table.columns, *none], names).to_batches()

        for words in _pieces(batches):
            real = pc.not_equal(words.different, "")  # of a row without words
            uses = np.bincount(words.codes, minlength=len(words.different))
            for table in totals.add(words.different.filter(real), uses[real.to_numpy(zero_copy_only=False)]):
                yield from rows(table)
            if buckets:
                _, first, second = words.pairs()
                pairs += np.bincount(words.buckets(first, second, buckets), minlength=len(pairs))
        for table in totals.rest():
            yield from rows(table)
        if pairs.any():
            n = len(pairs) // PART
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PART), pa.array(pairs))
            columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    return listed.select("words").mapInArrow(run, "term string, total long, part int, totals array<long>")


def _full_buckets(first: DataFrame, least: int) -> DataFrame:
    """The ``bucket`` numbers of ``_first_counts`` whose pairs have at least so many uses together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            totals = batch.column("totals").flatten().to_numpy().reshape(-1, PART)
            for part, row in zip(batch.column("part").to_pylist(), totals):
                sums[part] = sums.get(part, 0) + row
        for part, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(part * PART + np.flatnonzero(row >= least))], ["bucket"])

    placed = first.where("part IS NOT NULL").select("part", "totals").repartition("part")
    return placed.mapInArrow(run, "bucket long")


def _pair_counts(listed: DataFrame, able: np.ndarray) -> DataFrame:
    """``(term, total)``: uses of the pairs in buckets that are ``able``, to be summed."""
    size, bits = len(able), np.packbits(able)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, wanted = _Totals(), np.unpackbits(bits, count=size).astype(bool)
        for words in _pieces(batches):
            _, first, second = words.pairs()
            chosen = wanted[words.buckets(first, second, size)]
            n = max(len(words.different), 1)
            codes, uses = _counts_of(first[chosen].astype(np.int64) * n + second[chosen])
            names = [words.different.take(pa.array(c)) for c in (codes // n, codes % n)]
            for table in totals.add(pc.binary_join_element_wise(*names, " "), uses):
                yield from table.to_batches()
        for table in totals.rest():
            yield from table.to_batches()

    return listed.select("words").mapInArrow(run, "term string, total long")


def _counts_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs."""
    ordered = np.sort(values)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


class _Terms:
    """Finds the uses of known terms: words, and pairs of neighbours in a row."""

    def __init__(self, terms: Sequence[str], bigrams: bool) -> None:
        numbered = list(enumerate(terms))
        single = [(i, t) for i, t in numbered if " " not in t]
        double = [(i, *t.split(" ")) for i, t in numbered if bigrams and " " in t]
        self.words, self.word_places = pa.array([t for _, t in single], pa.string()), np.array([i for i, _ in single] + [-1])
        firsts, seconds = sorted({a for _, a, _ in double}), sorted({b for _, _, b in double})
        self.firsts, self.seconds = pa.array(firsts, pa.string()), pa.array(seconds, pa.string())
        at_first, at_second = ({w: i for i, w in enumerate(ws)} for ws in (firsts, seconds))
        codes = sorted((at_first[a] * len(seconds) + at_second[b], i) for i, a, b in double)
        self.codes, self.pair_places = np.array([c for c, _ in codes], np.int64), np.array([i for _, i in codes], np.int64)

    @staticmethod
    def _at(words: _Words, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words.different, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def uses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row and the place in the list of terms of every use of one of them."""
        words = _Words(texts)
        places = self.word_places[self._at(words, self.words)][words.codes]
        rows = [words.rows[places >= 0]]
        found = [places[places >= 0]]
        if len(self.codes):
            row, first, second = words.pairs()
            a, b = self._at(words, self.firsts)[first], self._at(words, self.seconds)[second]
            may = (a >= 0) & (b >= 0)
            code = a[may] * len(self.seconds) + b[may]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            rows.append(row[may][known])
            found.append(self.pair_places[at[known]])
        return np.concatenate(rows), np.concatenate(found)


COUNTED = "block string, chunk_ids array<string>, chunks array<int>, places array<int>, tfs array<int>"
POSTINGS = "block string, term string, top double, entries array<struct<chunk_id: string, weight: double>>"


def block_counts(listed: DataFrame, terms: Sequence[str], bigrams: bool) -> DataFrame:
    """``COUNTED``: a row per block with its chunks in order, and how often (``tfs``) a term (its place in ``terms``) is in a
    chunk (its place in ``chunk_ids``), in order of chunk and term.

    Rows come in order of block and chunk, in batches; the counts of a batch's last block are held back, as it may go on in
    the next one. Rows with the same chunk id count as one chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, known = max(len(terms), 1), _Terms(terms, bigrams)
        blocks, ids = pa.array([], pa.string()), pa.array([], pa.string())
        keys, uses = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            row, place = known.uses(batch.column("words"))
            held = len(ids)
            blocks = pa.concat_arrays([blocks, batch.column("block")])
            ids = pa.concat_arrays([ids, batch.column("chunk_id")])
            other_block = _differs(blocks)
            starts = np.flatnonzero(other_block | _differs(ids))
            chunk = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))  # of each row
            new, new_uses = _counts_of(chunk[held + row] * size + place)
            keys = np.concatenate([keys, new])
            order = np.argsort(keys, kind="stable")  # two runs in order
            keys, at = keys[order], np.flatnonzero(np.diff(keys[order], prepend=-1))
            uses = np.add.reduceat(np.concatenate([uses, new_uses])[order], at) if len(at) else uses
            keys = keys[at]
            firsts = pa.array(starts)
            blocks, ids, other_block = blocks.take(firsts), ids.take(firsts), other_block[starts]
            if not len(ids):
                continue
            last = int(np.flatnonzero(other_block)[-1])
            cut = np.searchsorted(keys, last * size)
            if last:
                yield _counted(blocks[:last], ids[:last], other_block[:last], keys[:cut], uses[:cut], size)
            blocks, ids, keys, uses = blocks[last:], ids[last:], keys[cut:] - last * size, uses[cut:]
        if len(ids):
            yield _counted(blocks, ids, np.arange(len(ids)) == 0, keys, uses, size)

    words = F.col("words") if listed.schema["words"].dataType == StringType() else _as_text()
    placed = listed.select("block", "chunk_id", words.alias("words")).repartition("block").sortWithinPartitions("block", "chunk_id")
    return placed.mapInArrow(run, COUNTED)


def _differs(values: pa.Array) -> np.ndarray:
    """Whether a value is another than the one before it; nulls are alike."""
    here, before = values[1:], values[:-1]
    other = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(here.is_null(), before.is_null()))
    return np.concatenate([np.ones(min(len(values), 1), bool), other.to_numpy(zero_copy_only=False)])


def _counted(blocks: pa.Array, ids: pa.Array, begins: np.ndarray, keys: np.ndarray, uses: np.ndarray, size: int) -> pa.RecordBatch:
    starts = np.flatnonzero(begins)
    chunk, place = keys // size, keys % size
    inside = chunk - starts[np.cumsum(begins)[chunk] - 1]
    bounds = np.append(starts, len(ids))
    ends = pa.array(np.searchsorted(chunk, bounds).astype(np.int32))

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))

    columns = [blocks.take(pa.array(starts)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids)]
    return pa.RecordBatch.from_arrays([*columns, lists(inside), lists(place), lists(uses)], ["block", "chunk_ids", "chunks", "places", "tfs"])


def block_postings(counted: DataFrame, terms: Sequence[str], idf: Sequence[float], blocks: int = 200) -> DataFrame:
    """``POSTINGS`` of ``COUNTED`` rows: damped term frequency times idf, scaled to length 1 per chunk, ``blocks`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, factors = pa.array(terms, pa.string()), np.array(idf, float)
        for batch in batches:
            for i in range(0, batch.num_rows, blocks):
                yield _weighed(batch.slice(i, blocks), names, factors)

    return counted.mapInArrow(run, POSTINGS)


def _weighed(batch: pa.RecordBatch, terms: pa.Array, idf: np.ndarray) -> pa.RecordBatch:
    chunk_ids, chunks, places, tfs = (batch.column(n) for n in ("chunk_ids", "chunks", "places", "tfs"))
    held, used = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (chunk_ids, places))
    block = np.repeat(np.arange(batch.num_rows), used)
    chunk = chunks.flatten().to_numpy() + (np.cumsum(held) - held)[block]
    place = places.flatten().to_numpy()
    weight = _unit(tfs, place, chunk, idf, int(held.sum()))
    order = np.lexsort((chunk, place, block))
    block, place, chunk, weight = block[order], place[order], chunk[order], weight[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1) | np.diff(place, prepend=-1))
    top = np.maximum.reduceat(weight, starts) if len(starts) else weight
    entries = pa.StructArray.from_arrays([chunk_ids.flatten().take(pa.array(chunk)), pa.array(weight)], ["chunk_id", "weight"])
    ends = pa.array(np.append(starts, len(weight)).astype(np.int32))
    columns = [batch.column("block").take(pa.array(block[starts])), terms.take(pa.array(place[starts])), pa.array(top)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, entries)], ["block", "term", "top", "entries"])


def _unit(tfs: pa.Array, place: np.ndarray, chunk: np.ndarray, idf: np.ndarray, chunks: int) -> np.ndarray:
    raw = (np.log(tfs.flatten().to_numpy()) + 1) * idf[place]
    return raw / np.sqrt(np.bincount(chunk, raw * raw, chunks))[chunk]


def as_postings(weights: DataFrame) -> DataFrame:
    entry = F.struct("chunk_id", "weight")
    return weights.groupBy("block", "term").agg(F.max("weight").alias("top"), F.sort_array(F.collect_list(entry)).alias("entries"))


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """``(query_id, term, query_weight)``, written as several joins read it."""
    counts = term_counts(with_words(queries, index.stop_words), ["query_id"], index.bigrams)
    return written(unit_weights(counts, index.vocabulary, "query_id").withColumnRenamed("weight", "query_weight"))


def scored(pairs: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """``(query_id, chunk_id, score)`` of all chunks in the given pairs of query and block.

    The pairs should be written: Spark then knows their size before it shuffles the postings that a query shares.
    """
    product = F.col("weight") * F.col("query_weight")
    if index.counted is None:
        shared = index.postings.join(asked, "term").join(pairs, ["query_id", "block"], "left_semi")
        met = shared.select("query_id", "query_weight", F.inline("entries"))
    else:  # the weights of the chunks of these blocks only
        held = index.counted.join(pairs.select("block").distinct(), "block", "left_semi")
        uses = held.select("block", "chunk_ids", F.inline(F.arrays_zip("chunks", "places", "tfs")))
        uses = uses.select("block", F.get("chunk_ids", F.col("chunks")).alias("chunk_id"), F.col("places").alias("place"), F.col("tfs").alias("tf"))
        known = uses.join(with_places(index.vocabulary).select("place", "term"), "place").drop("place")
        weighed = unit_weights(known, index.vocabulary, "chunk_id", "block")
        met = weighed.join(asked, "term").join(pairs, ["query_id", "block"], "left_semi")
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(product), 9).alias("score"))


def _best(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def candidate_blocks(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query_id, block)``: every block that may hold one of a query's ``k`` best chunks, and few others.

    With the counts of an index at hand, the tasks score all chunks of their blocks, some queries at once, and keep the
    ``k`` best of each query (``_task_best``); the blocks are those of the best of all.

    By postings alone: no chunk scores more than its block's largest weights would together. A query's ``k`` blocks with
    the highest such bounds are scored in full; as each holds a chunk with a positive score, their ``k``-th best score is
    one that the final ``k`` reach, too, and a block whose bound falls short of it can hold none of them.
    """
    if index.counted is not None:
        numbered = written(_passes(asked))
        passes = [row[0] for row in numbered.select("pass").distinct().orderBy("pass").collect()]
        terms, idf = vocabulary_lists(index.vocabulary)
        parts = (_task_best(asked.join(numbered.where(F.col("pass") == p), "query_id"), p, index.counted, terms, idf, k) for p in passes)
        found = written_in_turn(parts) if passes else None
        if found is None or k < 1:
            return asked.select("query_id", F.lit("").alias("block")).limit(0)
        best = _best(found.join(numbered, ["pass", "n"]), "score", "chunk_id", k)
        return best.select("query_id", "block").distinct()
    limit = F.sum(F.col("top") * F.col("query_weight")).alias("bound")
    bounds = written(index.postings.join(asked, "term").groupBy("query_id", "block").agg(limit))
    tried = scored(written(_best(bounds, "bound", "block", k)), asked, index)
    reached = _best(tried, "score", "chunk_id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    within = F.col("bound") >= F.coalesce("reached", F.lit(0.0)) - SLACK
    return bounds.join(reached, "query_id", "left").where(within).select("query_id", "block")


def _passes(asked: DataFrame) -> DataFrame:
    """``(query_id, pass, n)``: the queries dealt to passes of bounded size, and their numbers from 0 in them; without missing ids."""
    ids = asked.where(F.col("query_id").isNotNull())
    queries, terms = ids.agg(F.count_distinct("query_id"), F.count(F.lit(1))).first()
    passes = max(1, -(-queries // ASKED[0]), -(-terms // ASKED[1]))
    dealt = ids.select("query_id").distinct().withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)).cast("int"))
    return dealt.withColumn("n", F.row_number().over(Window.partitionBy("pass").orderBy("query_id")) - 1)


def _task_best(queries: DataFrame, number: int, counted: DataFrame, terms: Sequence[str], idf: Sequence[float], k: int) -> DataFrame:
    """``(pass, n, block, chunk_id, score)``: of each task the ``k`` best chunks of every query ``n`` of one pass, positive scores only."""
    place_of = {t: i for i, t in enumerate(terms)}
    rows = sorted((place_of[r["term"]], r["n"], r["query_weight"]) for r in queries.select("term", "n", "query_weight").collect())
    places, numbers, weights = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, float)))
    names = ["pass", "n", "block", "chunk_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.bincount(places, minlength=max(len(idf), 1))  # queries with each term, one after another
        lists = np.cumsum(uses) - uses, uses, numbers, weights
        count = int(numbers.max()) + 1
        best, reached = None, np.full(count, np.finfo(float).tiny)
        for batch in _by_chunks(batches, CELLS // count):
            ids, blocks, scores = _scores(batch, lists, np.array(idf, float), count)
            best = _kept(best, ids, blocks, scores, reached, k)
        if best is not None:
            yield from pa.table([pa.array(np.full(len(best), number), pa.int32()), *best.columns], names).to_batches()

    return counted.where(F.col("block").isNotNull()).mapInArrow(run, "pass int, n int, block string, chunk_id string, score double")


def _by_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of blocks with at most so many chunks, one block at least."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("chunk_ids")).to_numpy())
        start = 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _scores(batch: pa.RecordBatch, lists: tuple[np.ndarray, ...], idf: np.ndarray, count: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The chunks of some blocks, their blocks, and the score of each query (a row) and chunk, to nine places."""
    chunk_ids, chunks, places, tfs = (batch.column(n) for n in ("chunk_ids", "chunks", "places", "tfs"))
    held, used = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (chunk_ids, places))
    total = int(held.sum())
    chunk = chunks.flatten().to_numpy() + np.repeat(np.cumsum(held) - held, used)
    place = places.flatten().to_numpy()
    weight = _unit(tfs, place, chunk, idf, total)
    first, uses, numbers, weights = lists
    asked = uses[place] > 0
    place, chunk, weight = place[asked], chunk[asked], weight[asked]
    scores, ends, start = np.zeros(count * total), np.cumsum(uses[place]), 0
    while start < len(place):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, side="right")))
        n = uses[place[start:stop]]
        at = np.arange(n.sum()) + np.repeat(first[place[start:stop]] - (np.cumsum(n) - n), n)
        cell = numbers[at] * total + np.repeat(chunk[start:stop], n)
        scores += np.bincount(cell, weights[at] * np.repeat(weight[start:stop], n), len(scores))
        start = stop
    blocks = batch.column("block").take(pa.array(np.repeat(np.arange(len(held)), held)))
    return chunk_ids.flatten(), blocks, np.round(scores, 9).reshape(count, total)


def _kept(best: pa.Table | None, ids: pa.Array, blocks: pa.Array, scores: np.ndarray, reached: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best chunks of each query, of those kept so far and new ones; ``reached`` follows: what a hit must score."""
    if scores.shape[1] > k:
        number, chunk = np.nonzero(scores >= np.maximum(reached, np.partition(scores, -k, axis=1)[:, -k])[:, None])
    else:
        number, chunk = np.nonzero(scores >= reached[:, None])
    new = [pa.array(number, pa.int32()), blocks.take(pa.array(chunk)), ids.take(pa.array(chunk)), pa.array(scores[number, chunk])]
    rows = pa.table(new, ["n", "block", "chunk_id", "score"])
    rows = rows if best is None else pa.concat_tables([best, rows])
    rows = rows.take(pc.sort_indices(rows, [("n", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
    number = rows.column("n").to_numpy()
    rank = np.arange(len(number)) - np.searchsorted(number, number)
    last = np.flatnonzero(rank == k - 1)
    reached[number[last]] = rows.column("score").to_numpy()[last]
    return rows.filter(pa.array(rank < k)).combine_chunks()


def search_topk(queries: DataFrame, index: Index, k: int = 3) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the ``k`` chunks nearest to each query, positive scores only.

    Queries meet blocks of chunks where these lie, without a shuffle, and only blocks that can hold a hit are scored once more.
    The sums combine map-side, and the rank filter lets Spark cut every partition to ``k`` rows per query before the final ranking.
    """
    asked = query_terms(queries, index)
    return _best(scored(written(candidate_blocks(asked, index, k)), asked, index), "score", "chunk_id", k)


def filled(queries: DataFrame, found: DataFrame, index: Index, k: int) -> DataFrame:
    """Adds chunks of score 0 in the order of their ids to queries with fewer than ``k`` hits.

    Of the first ``k`` chunks by id at least as many are no hits of a query as it lacks, so only these are looked at.
    """
    first = [row[0] for row in index.chunks.select("chunk_id").orderBy("chunk_id").limit(k).collect()]  # k ids
    none = F.array().cast("array<string>")
    hits = found.groupBy("query_id").agg(F.collect_list("chunk_id").alias("had"))  # at most k
    each = queries.select("query_id").distinct().join(hits, "query_id", "left").withColumn("had", F.coalesce("had", none))
    spare = F.array_except(F.array([F.lit(i) for i in first]).cast("array<string>"), "had")
    listed = each.select("query_id", F.size("had").alias("hits"), F.posexplode(spare).alias("n", "chunk_id"))
    rank = F.col("hits") + F.col("n") + 1
    added = listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(0.0).alias("score"), "rank")
    return found.select("query_id", "chunk_id", "score", "rank").unionByName(added)


def search(queries: DataFrame, index: Index, k: int = 3) -> DataFrame:
    """Hits with their source and text."""
    return search_topk(queries, index, k).join(index.chunks, "chunk_id")


def distinct_sources(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def context_block() -> Column:
    head = F.format_string("[Source: %s | Relevance: %.2f]", F.col("source"), F.col("score"))
    return F.concat(head, F.lit("\n"), F.col("text"))


def build_context(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One text per query of its hits in rank order; at most ``k`` hits meet in a group."""
    return _with_hits(queries, found).select("query_id", F.coalesce(_joined_context(), F.lit(NO_CONTEXT)).alias("context"))


def _with_hits(queries: DataFrame, found: DataFrame) -> DataFrame:
    hit = F.struct("rank", "text", "source", "score", context_block().alias("block"))
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    return queries.join(lists, "query_id", "left")


def _joined_context() -> Column:
    return F.array_join(F.col("hits.block"), "\n\n---\n\n")


def retrieve_answers(queries: DataFrame, index: Index, k: int = 3) -> DataFrame:
    """Per query the best chunk as the answer, its context, the distinct sources and the chunk list.

    Every query gets ``k`` chunks as long as there are that many, those without a shared term with score 0.
    """
    found = filled(queries, written(search_topk(queries, index, k)), index, k).join(index.chunks, "chunk_id")
    rows = _with_hits(queries.withColumnRenamed("text", "query"), found)
    store_is_empty = index.chunks.limit(1).count() == 0
    nothing = NO_DOCUMENTS if store_is_empty else NO_CONTENT
    chunk = F.transform(F.col("hits"), lambda h: F.struct(h["text"].alias("text"), h["source"].alias("source"), h["score"].alias("score")))
    empty_chunks = F.array().cast("array<struct<text:string,source:string,score:double>>")
    return rows.select(
        "query_id", "query",
        F.coalesce(F.get(F.col("hits.text"), F.lit(0)), F.lit(nothing)).alias("answer"),
        _joined_context().alias("full_context"),
        F.coalesce(F.sort_array(F.array_distinct(F.col("hits.source"))), F.array().cast("array<string>")).alias("sources"),
        F.coalesce(chunk, empty_chunks).alias("chunks"),
    )


def sentiment(docs: DataFrame, text: str = "text") -> DataFrame:
    verdict = F.col("sentiment")
    return docs.withColumn("sentiment", t.sentiment(F.col(text))).withColumns(
        {name: t.confidence(verdict, i) for i, name in enumerate(("positive", "neutral", "negative"))}
    )


def key_phrases(docs: DataFrame, text: str = "text", limit: int = 8) -> DataFrame:
    return docs.withColumn("key_phrases", t.key_phrases(F.col(text), limit))

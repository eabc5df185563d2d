"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with one set of shingles are folded into one node first. Candidates share a bucket, of two kinds. One is a
component of fingerprints within four bits, as multi-index hashing finds them (``simhash``). Fingerprints that close are
rare at a similarity of 0.8, so the others complete them: the least values of the set under ``BANDS`` x ``ROWS`` orders are
hashed band by band. A pair of similarity 0.8 misses all these with a chance of 10^-4, one of 0.85 with 10^-7; a pair of
0.5 meets with 0.18, one of 0.4 with 0.03. Every link is then decided by the exact similarity of the two sets.

Two things keep the work in step with the rows, however many copies a text has. First, an exact bound: what a set
holds that no other candidate holds is missing from any partner, and a partner at 0.8 may miss only so much, so sets
with too much of their own go at once, and the bound of each side stands inside every join. Second, the nodes of a
bucket are not compared with each other but with one head, the node that shares most; what is near its head has one
root from then on. After ``TURNS`` turns the search lists pairs of different roots only, of which one side lies
outside its bucket's largest root, and which a sketch does not rule out: of ``BITS`` bits each says whether an odd number of
the set's shingles falls on it, and two sketches differ in no more bits than the sets do in shingles.

Rows: a missing text counts as empty, and texts without words are alike; a text of fewer than five words is one
shingle; repeated rows keep a row each; a missing ``doc_id`` takes the smallest id of its component (null if there
is none). Extra columns are dropped by ``near_copies`` and kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfwise.llm.common import WordHasher, free_name, mix, slices, stored, texts_of
from shelfwise.llm.simhash import _merged, fingerprint, rooted

SHINGLE = 5
BANDS, ROWS = 50, 8
PIECE = 256  # shingles put in order at once
TURNS = 2
BITS = 2048  # of a sketch: enough to tell sets of some 3,000 shingles apart, larger ones are compared in full
NO_ID = (1 << 63) - 1
_drawn = np.random.default_rng(8)
ORDERS = _drawn.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
WEIGHTS = _drawn.integers(0, 2**64, max(BANDS * ROWS, SHINGLE), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than a shingle has are one shingle."""
    words, counts = hasher.documents(texts)
    sums = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        sums += mix(words[k : k + len(sums)] + np.uint64(k)) * WEIGHTS[k]
    every = mix(sums)
    out, start = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(every[start : start + n - SHINGLE + 1]))
        elif n:
            short = sum((mix(words[start + k : start + k + 1] + np.uint64(k)) * WEIGHTS[k] for k in range(n)), np.zeros(1, np.uint64))
            out.append(mix(short + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def node_of(shingles: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def buckets(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band, none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), PIECE):
        least = np.minimum(least, (ORDERS[:, None] * high[at : at + PIECE]).min(axis=1))
    return mix((mix(least.astype(np.uint64)) * WEIGHTS[: BANDS * ROWS]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` bits the parity of the shingles that fall on it, as longs."""
    places = (shingles >> np.uint64(16)) % np.uint64(BITS)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=BITS) & 1).view(np.int64)


def _body() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _filed(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, node, size, values, fp)``: hash of the text, set, its number of shingles, its buckets, its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            sets = shingle_sets(texts, hasher)
            columns = [
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([buckets(s) for s in sets], pa.list_(pa.int64())),
                pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "body", "node", "size", "values", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), _body().alias("body"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, body long, node long, size long, values array<long>, fp long")


def _by_print(rows: DataFrame) -> DataFrame:
    """``(node, value)``: the component of fingerprints that a node's texts are in, as a bucket; alike sets may have several."""
    prints = rooted(rows.select(F.col("fp").alias("node"), "fp").distinct())
    return rows.select("node", "fp").join(prints.select("fp", F.col("root").alias("value")), "fp").select("node", "value").distinct()


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and the node of each row in ``near_copies``, under a name that ``docs`` does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, "text"):
            nodes = pa.array([node_of(s) for s in shingle_sets(texts_of(batch), hasher)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, LongType())]))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(node, shingles, sketch)`` of the texts of the chosen rows ``(id, body)``, one a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, longs = WordHasher(), pa.list_(pa.int64())
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch), hasher)
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], longs)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sketch(s) for s in sets], longs)], ["node", "shingles", "sketch"])

    texts = docs.select(_id().alias("id"), _body().alias("body"), F.col("text").cast("string")).join(chosen, ["id", "body"], "left_semi")
    once = texts.groupBy("id", "body").agg(F.first("text").alias("text")).select("text")
    return once.mapInArrow(run, "node long, shingles array<long>, sketch array<long>")


def _own(sets: DataFrame) -> DataFrame:
    """``(node, own)``: how many shingles of a set, at least, no other set has (32 bits of each decide)."""
    each = sets.select("node", F.explode("shingles").alias("s")).select("node", F.shiftright("s", 32).cast("int").alias("s"))
    alone = each.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _may_be_near(a: str, b: str) -> Column:
    """Whether two sets of these sizes, of which each has so many shingles of its own, can be similar, in whole numbers.

    At 0.8 two sets of a and b shingles differ in (a + b) / 9 of them at most, so the first holds at most half of
    (a + b) / 9 + a - b that the second lacks, and has no more of its own.
    """
    sa, sb, oa, ob = (F.col(f"{p}{c}") for c in ("size", "own") for p in (a, b))
    sizes = 5 * F.least(sa, sb) >= 4 * F.greatest(sa, sb)
    owns = (18 * oa <= sa + sb + 9 * (sa - sb)) & (18 * ob <= sa + sb + 9 * (sb - sa))
    return sizes & owns & (F.col(f"{a}root") != F.col(f"{b}root"))


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("value", *[F.col(c).alias(f"{prefix}{c}") for c in ("node", "size", "own", "root")])


def _proven(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The roots of those pairs that are similar: shared / (a + b - shared) >= 0.8, in whole numbers."""
    a, b = (sets.select(F.col("node").alias(f"{p}_node"), F.col("shingles").alias(f"{p}_set")) for p in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    near = 9 * shared >= 4 * (F.size("a_set") + F.size("b_set"))
    return pairs.join(a, "a_node").join(b, "b_node").where(near).select("a_root", "b_root")


def _head_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """Each node and that head of a bucket which it meets most often.

    A bucket's head is first the node with the smallest share of its own, then one that a hash of the turn picks.
    """
    order = (F.col("own") / F.col("size")) if turn == 0 else F.lit(0.0)
    first = F.struct(order.alias("share"), F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size", "own", "root")
    heads = rooted.groupBy("value").agg(F.min(first).alias("head")).select("value", "head.node", "head.size", "head.own", "head.root")
    pairs = _prefixed(rooted, "a_").join(_prefixed(heads, "b_"), "value").where(_may_be_near("a_", "b_"))
    met = pairs.groupBy("a_node", "a_root", "b_node", "b_root").count()
    best = met.groupBy("a_node", "a_root").agg(F.max(F.struct("count", "b_node", "b_root")).alias("best"))
    return best.select("a_node", "a_root", "best.b_node", "best.b_root")


def _other_pairs(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of nodes of different roots that share a bucket and can be near, once each.

    One of the two lies outside its bucket's largest root, so the nodes of that root do not meet each other.
    """
    by_root = rooted.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = by_root.groupBy("value").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"))
    rows = rooted.join(largest.where("roots > 1"), "value").join(sets.select("node", "sketch"), "node")
    names = ("node", "size", "own", "root", "sketch")
    minor = rows.where("root <> main").select("value", *[F.col(c).alias(f"a_{c}") for c in names])
    every = rows.select("value", *[F.col(c).alias(f"b_{c}") for c in names], (F.col("root") != F.col("main")).alias("b_minor"))
    once = ~F.col("b_minor") | (F.col("a_node") < F.col("b_node"))
    bits = sum((F.bit_count(F.get("a_sketch", F.lit(i)).bitwiseXOR(F.get("b_sketch", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    alike = 9 * bits <= F.col("a_size") + F.col("b_size")
    pairs = minor.alias("a").join(every.alias("b"), (F.col("a.value") == F.col("b.value")) & once & _may_be_near("a_", "b_") & alike)
    return pairs.select("a_node", "a_root", "b_node", "b_root").distinct()


def near_copies(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """``(doc_id, node, root, component_id)``: one row per document; the component's smallest reachable id."""
    rows = stored(_filed(docs), "shingles")
    folded = rows.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(_id().alias("id"), "body")).alias("row"), F.first("values").alias("values")
    )
    nodes = stored(folded.select("*", F.col("node").alias("root")), "nodes")
    filed = nodes.select("node", F.explode("values").alias("value")).unionByName(stored(_by_print(rows), "prints"))
    shared = filed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    met = stored(filed.join(shared, "value", "left_semi"), "buckets")
    chosen = nodes.join(met.select("node").distinct(), "node", "left_semi").select("row.id", "row.body")
    sets = stored(_sets(docs, chosen), "sets")
    sized = sets.select("node", F.size("shingles").cast("long").alias("size")).join(_own(sets), "node", "left").fillna(0, ["own"])
    able = stored(sized.where("5 * own <= size"), "able")  # a partner lacks a fifth of a set at most
    filed = stored(met.join(able, "node"), "filed")
    nodes = nodes.select("node", "first_id", "root")
    for turn in range(turns + 1):
        rooted = filed.join(nodes.select("node", "root"), "node")
        pairs = _head_pairs(rooted, turn) if turn < turns else _other_pairs(rooted, sets)
        nodes = _merged(nodes, _proven(pairs, sets))
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = nodes.join(smallest, "root").select("node", "root", "component_id")
    return rows.join(of_node, "node").select("doc_id", "node", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of near copies the row with the smallest id; of equal ids, or where no row has one, the first by its columns."""
    found = stored(near_copies(docs), "copies")
    order = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    turn = free_name(docs, "turn")
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    with_id = docs.join(keep, "doc_id", "left_semi").withColumn(turn, first).where(F.col(turn) == 1).drop(turn)
    bare = found.where("doc_id IS NULL AND component_id IS NULL").select("node", "root").distinct()
    node = free_name(docs, "node")
    marked = with_node(docs.where("doc_id IS NULL"), node)
    first = F.row_number().over(Window.partitionBy(bare["root"]).orderBy(*[marked[c] for c in order]))
    without = marked.join(bare, marked[node] == bare["node"]).withColumn(turn, first).where(F.col(turn) == 1)
    return with_id.select(*docs.columns).unionByName(without.select(*[marked[c] for c in docs.columns]))

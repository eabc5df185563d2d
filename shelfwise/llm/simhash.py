"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit majority fingerprint of its word shingles. Equal fingerprints are folded into one
row first, so that a group of copies of any size costs one row from there on. To find all fingerprints
within ``radius`` bits, the 64 bits are cut into segments, each with a small radius of its own; by the
pigeonhole principle two fingerprints within ``radius`` bits agree up to the small radius in one segment
at least. A fingerprint enumerates the Hamming ball of each of its segments, fetches the fingerprints
filed under those segment values by an equi-join, and the full distance is checked inside the join, so
that no unverified pair is ever written. In a dense group of near copies nearly all pairs are links; such a
group is first joined by links to one row a bucket, and the search then lists pairs of different groups only.

Rows: a missing text counts as empty; a text without words has fingerprint zero and is linked like any
other; repeated rows keep a row each; a missing ``doc_id`` keeps its fingerprint and takes the smallest
id of its component (null if there is none). Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices, stored, superseded, texts_of

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = 1 << 14  # shingles voted on at once
PLACE = np.arange(8) * 256
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

#: (bits, radius) of the segments from the lowest bit. Sound for links of up to 4 bits:
#: the (radius + 1) add up to 5.
SEGMENTS = ((22, 1), (21, 1), (21, 0))

HEAD_TURNS = 2


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(8 * 256, np.int64)  # how often each byte value stands at each place
    for at in range(0, len(hashes), PIECE):
        places = hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8) + PLACE
        counts += np.bincount(places.ravel(), minlength=8 * 256)
    votes = np.einsum("pv,vb->pb", counts.reshape(8, 256), BITS).ravel()
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def words_of(text: str) -> list[bytes]:
    """The words as bytes, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split knows just these blanks


def shingle_hashes(words: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 hashes of all runs of ``shingle`` words, repeats included; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    n = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), stops.tolist())], np.uint64)


def shingle_print(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """Majority of the hashes of all runs of ``shingle`` words."""
    return majority(shingle_hashes(words, shingle, seed))


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return shingle_print(words_of(text), shingle, seed)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, fingerprints as the signed longs with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(layout: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int]]:
    out, shift = [], 0
    for bits, radius in layout:
        out.append((shift, bits, radius))
        shift += bits
    if shift != 64:
        raise ValueError("the segments must cover 64 bits")
    return out


def _value(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _ball(bits: int, radius: int) -> list[int]:
    """All masks with at most ``radius`` of the ``bits`` set."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _moved(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _near(a: str, b: str, radius: int) -> Column:
    """Whether two rows, given by the prefixes of their columns, differ by few bits and are not in one group yet."""
    bits = F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp")))
    return (bits <= radius) & (F.col(f"{a}root") != F.col(f"{b}root"))


def _prefixed(nodes: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("node", "fp", "root")]


def links(nodes: DataFrame, radius: int = 4, layout: tuple[tuple[int, int], ...] = SEGMENTS) -> DataFrame:
    """Pairs of the rows of ``nodes`` (node, fp, root) that have different roots and differ by up to ``radius`` bits.

    ``a_node`` < ``b_node``. Every pair comes once: of the segments in which it could be found, the first reports it.
    """
    if sum(r + 1 for _, r in layout) <= radius:
        raise ValueError("the segment radii are too small for this radius")
    segments = _segments(layout)
    filed = nodes.select(
        *_prefixed(nodes, "b_"), F.posexplode(F.array(*[_value(F.col("fp"), s, n) for s, n, _ in segments])).alias("segment", "value")
    )
    probes = nodes.select(
        *_prefixed(nodes, "a_"),
        F.posexplode(F.array(*[_moved(_value(F.col("fp"), s, n), _ball(n, r)) for s, n, r in segments])).alias("segment", "values"),
    ).withColumn("value", F.explode("values")).drop("values")
    apart = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    earlier = F.lit(False)
    for i, (s, n, r) in enumerate(segments[:-1]):
        earlier = earlier | ((F.col("p.segment") > i) & (F.bit_count(_value(apart, s, n)) <= r))
    near = (F.col("a_node") < F.col("b_node")) & _near("a_", "b_", radius) & ~earlier
    same = (F.col("p.segment") == F.col("f.segment")) & (F.col("p.value") == F.col("f.value"))
    return probes.alias("p").join(filed.alias("f"), same & near).select("a_node", "b_node", "a_root", "b_root")


def head_links(nodes: DataFrame, turn: int, radius: int, layout: tuple[tuple[int, int], ...]) -> DataFrame:
    """Links of each row to one other row of each of its buckets, the first in an order that ``turn`` shuffles.

    All of them are links that ``links`` would find. They join a dense group of near copies, in which all
    pairs are links, by a few links a row, so that ``links`` need not list its pairs.
    """
    values = F.posexplode(F.array(*[_value(F.col("fp"), s, n) for s, n, _ in _segments(layout)])).alias("segment", "value")
    filed = nodes.select(*_prefixed(nodes, "a_"), values)
    first = F.struct(F.xxhash64("a_node", F.lit(turn)).alias("order"), *[F.col(f"a_{c}").alias(c) for c in ("node", "fp", "root")])
    heads = filed.groupBy("segment", "value").agg(F.min(first).alias("head"))
    heads = heads.select("segment", "value", *[F.col(f"head.{c}").alias(f"b_{c}") for c in ("node", "fp", "root")])
    same = (F.col("p.segment") == F.col("f.segment")) & (F.col("p.value") == F.col("f.value"))
    return filed.alias("p").join(heads.alias("f"), same & _near("a_", "b_", radius)).select("a_root", "b_root")


def components(edges: DataFrame, limit: int = 50) -> DataFrame:
    """``(node, root)`` for all nodes of the edges ``(a, b)``; the root is the component's smallest node.

    Alternates large-star and small-star steps, each a grouping and a join, until every node is linked to its root
    alone; every step's links are written to the shared folder, so nothing is recomputed, and those before them are
    deleted. Links that are such stars from the start take no step: each shuffle that a plan has costs the driver a thread.
    """
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v"))
    current = stored(current.distinct(), "links")
    for _ in range(limit):
        if _are_stars(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "links")
        superseded(current)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        current = stored(small.where(F.col("u") != F.col("v")).distinct(), "links")
        superseded(large)
    raise RuntimeError(f"components did not settle in {limit} rounds")


def _are_stars(links: DataFrame) -> bool:
    """Whether every ``u`` of the different links ``(u, v)``, ``u`` > ``v``, has one ``v`` only, which is no ``u`` itself."""
    ends = links.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))])))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return of_node.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0))).isEmpty()


def _merged(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with the roots that links between roots give them."""
    settled = components(found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    if settled.isEmpty():
        superseded(settled)
        return nodes
    moved = settled.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    joined = nodes.join(moved, "root", "left")
    kept = [c for c in nodes.columns if c != "root"]
    merged = stored(joined.select(*kept, F.coalesce("new_root", "root").alias("root")), "nodes")
    for old in (settled, nodes):
        superseded(old)
    return merged


def near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, layout: tuple[tuple[int, int], ...] = SEGMENTS, turns: int = HEAD_TURNS
) -> DataFrame:
    """``(doc_id, fp, node, root, component_id)``: one row per document; the component's smallest reachable id.

    ``layout`` gives (bits, radius) of each segment: a probe meets about one in 2^bits of all fingerprints by chance, so
    beyond 10^9 of them take fewer and longer segments, such as ((32, 2), (32, 1)).
    """
    return grouped(fingerprints(docs, shingle, seed), radius, layout, turns)


def grouped(prints: DataFrame, radius: int = 4, layout: tuple[tuple[int, int], ...] = SEGMENTS, turns: int = HEAD_TURNS) -> DataFrame:
    """``(doc_id, fp, node, root, component_id)`` from ``(doc_id, fp)``: components of the links between fingerprints."""
    rows = stored(prints.withColumn("node", F.col("fp")), "fingerprints")
    nodes = rooted(rows.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), radius, layout, turns)
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = nodes.join(smallest, "root").select("node", "root", "component_id")
    return rows.join(of_node, "node").select("doc_id", "fp", "node", "root", "component_id")


def rooted(prints: DataFrame, radius: int = 4, layout: tuple[tuple[int, int], ...] = SEGMENTS, turns: int = HEAD_TURNS) -> DataFrame:
    """Distinct fingerprints ``(node, fp, ...)``, ``node`` = ``fp``, with the ``root`` of their component of links."""
    nodes = stored(prints.withColumn("root", F.col("node")), "nodes")
    for turn in range(turns):
        nodes = _merged(nodes, head_links(nodes, turn, radius, layout))
    return _merged(nodes, links(nodes, radius, layout))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")

"""Near copies against brute force over the shingles themselves."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import copies, simhash
from shelfwise.llm.common import WordHasher
from tests.llm.data import SF, kept_by_brute_force, no_documents, odd_documents, plain_components, plain_near, plain_shingles, plain_similarity, rows_of


def changed(rng, words, n):
    copy = list(words)
    for at in rng.sample(range(len(copy)), n):
        copy[at] = f"new{rng.randrange(10**6)}"
    return copy


def family(seed, members, length, most):
    """Copies of one text, each with another number of changed words."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(5000)}" for _ in range(length)]
    return [(i, " ".join(changed(rng, text, rng.randrange(most + 1)))) for i in range(members)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_stage_of_documents_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, sf).collect()} == kept_by_brute_force(rows)


@pytest.mark.parametrize("turns", [0, 2])
def test_similarities_about_the_limit(spark, turns):
    """Copies of 60 to 400 words with a few words changed, at similarities from 0.5 to 1."""
    rng = random.Random(3)
    rows = []
    for group in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(4):
            share = rng.choice([0.003, 0.009, 0.011, 0.013, 0.016, 0.03])
            rows.append((len(rows), " ".join(changed(rng, text, round(len(text) * share)))))
    sets = [plain_shingles(t) for _, t in rows]
    similar = [plain_similarity(a, b) for a, b in itertools.combinations(sets, 2)]
    assert sum(0.8 <= s < 0.85 for s in similar) > 20 and sum(0.65 <= s < 0.8 for s in similar) > 20
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), turns)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(zip(range(len(rows)), plain_components([i for i, _ in rows], plain_near(rows))))


def pairs_asked(spark, rows, monkeypatch):
    """How many pairs are compared in each turn, and the components."""
    asked, plain = [], copies._proven

    def counted(pairs, sets):
        asked.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(copies, "_proven", counted)
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return asked, {r.doc_id: r.component_id for r in found}


@pytest.mark.parametrize("most", [5, 20])
def test_pairs_grow_with_the_members_of_a_family(spark, monkeypatch, most):
    """Members that are all near each other, and members of which few are: neither makes the pairs of the family."""
    for members in (100, 400):
        rows = family(5, members, 300, most)
        asked, found = pairs_asked(spark, rows, monkeypatch)
        assert found == dict(zip(range(members), plain_components(range(members), plain_near(rows))))
        assert max(asked) <= 4 * members, asked


def test_a_family_without_near_copies_lists_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(changed(rng, text, rng.randrange(14, 24)))) for i in range(300)]
    sets = [plain_shingles(t) for _, t in rows]
    assert max(plain_similarity(a, b) for a, b in itertools.combinations(sets[:80], 2)) < 0.8
    asked, found = pairs_asked(spark, rows, monkeypatch)
    assert sum(asked) <= 30 and found == {i: i for i in range(300)}


def test_buckets_find_pairs_at_the_limit():
    """Of pairs of similarity 0.8 to 0.82 at least 999 in 1000 share a bucket."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(1000):
        both, one, other = rng.integers(0, 2**64, 90, dtype=np.uint64), *rng.integers(0, 2**64, (2, 11), dtype=np.uint64)
        a, b = copies.buckets(np.union1d(both, one)), copies.buckets(np.union1d(both, other))
        met += bool((a == b).any())
    assert met >= 999


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (10, 100, 1000, 5000):
        both, one, other = rng.integers(0, 2**64, n, dtype=np.uint64), *rng.integers(0, 2**64, (2, n // 5), dtype=np.uint64)
        a, b = copies.sketch(np.union1d(both, one)), copies.sketch(np.union1d(both, other))
        bits = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        assert 0.4 * 2 * (n // 5) <= bits <= 2 * (n // 5)
    assert not copies.sketch(np.zeros(0, np.uint64)).any() and len(a) == copies.BITS // 64


def test_shingle_sets_are_those_of_the_words():
    texts = ["", "  ", "One", "one\n", "one two", "two one", "a b c d", "a b c d e", "A  b\tc d E", "x a b c d e f", "a b c d e f"]
    sets = copies.shingle_sets(texts, WordHasher())
    assert [len(s) for s in sets] == [len(plain_shingles(t)) for t in texts]
    plain = [plain_shingles(t) for t in texts]
    for (s, p), (t, q) in itertools.combinations(list(zip(sets, plain)), 2):
        assert len(np.intersect1d(s, t)) == len(p & q)


def test_one_of_each_on_odd_rows(spark):
    odd = odd_documents(spark)
    got = copies.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 2, 5, 7, 8, None], key=repr)
    assert copies.one_of_each(no_documents(spark)).collect() == []
    repeated = odd.unionByName(odd)
    assert rows_of(copies.one_of_each(repeated)) == rows_of(got)
    bare = copies.near_copies(spark.createDataFrame([(None, "some words here"), (None, "some words here"), (4, "some WORDS here")], "doc_id long, text string"))
    assert {r.component_id for r in bare.collect()} == {4}


def test_fingerprints_within_four_bits_are_candidates(spark, monkeypatch):
    """Without minimum hashes the links between fingerprints still find near copies, and the sets still decide."""
    monkeypatch.setattr(copies, "_filed", lambda docs, plain=copies._filed: plain(docs).withColumn("values", F.array().cast("array<long>")))
    rng = random.Random(9)
    text = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    near = " ".join(changed(rng, text, 2))
    echoed = ["one long line that stands here again and again " * 60 + f"tail {n} {n + 1} {n + 2} {n + 3} {n * 7}" for n in (1, 500)]
    rows = [(0, " ".join(text)), (1, near), *enumerate(echoed, 2)]
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert max((prints[i] ^ prints[i + 1]).bit_count() for i in (0, 2)) <= 4
    sets = [plain_shingles(t) for _, t in rows]
    assert plain_similarity(sets[0], sets[1]) >= 0.8 > plain_similarity(sets[2], sets[3])
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}

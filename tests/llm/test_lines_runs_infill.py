"""Line dedup, periodic runs and fill-in-middle against plain versions of the same rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import infill, line_runs, repeats
from tests.llm.data import SF, no_documents, odd_documents, rows_of

BLANKS = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# line dedup


def plain_lines(rows):
    """A document per id; those without id are one that comes last."""
    holder = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = low(line.strip(BLANKS))
            if len(key) >= 10:
                holder[key] = min(holder.get(key, 1 << 63), (1 << 63) - 1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = (1 << 63) - 1 if doc_id is None else doc_id
        kept = [x for x in lines if holder.get(low(x.strip(BLANKS)), own) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return sorted(out, key=repr)


def line_rows(seed, n=120):
    rng = random.Random(seed)
    pool = ["  A shared Line of text ", "a shared line of text", "short", "", "\ta shared LINE of text\r", "Übergröße 10 Zeichen ſK", *(f"line number {i} here" for i in range(40))]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_by_any_number_of_batches(spark, batches):
    rows = line_rows(1) + [(2000, "a shared line of text\n" * 3 + "only here, only here\nonly here, only here"), (None, "a shared line of text\nunseen before now"), (2001, None)]
    found = line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), batches)
    got = rows_of(found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)))
    assert got == plain_lines(rows) and any(r[2] for r in got)


def test_lines_of_odd_rows(spark):
    odd = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(line_runs.op11_line_dedup(odd)) == plain_lines(rows)
    assert line_runs.op11_line_dedup(no_documents(spark)).collect() == []


def test_runs_outlive_their_writer(spark, tmp_path):
    """Later batches, also of a store opened anew, lose what earlier ones had; levels are merged on the way."""
    batches = [[(b * 1000 + i, t) for i, t in line_rows(b, 60)] for b in range(5)]
    lines = lambda rows: line_runs.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    runs, gone = line_runs.Runs(spark, str(tmp_path / "store")), 0
    for rows in batches:
        gone += runs.add(lines(rows)).count()
        runs = line_runs.Runs.opened(spark, str(tmp_path / "store"))
        assert all(len(level) <= runs.fanout for level in runs.levels)
    assert len(runs.names()) <= 3
    assert gone == sum(r[2] for r in plain_lines([r for rows in batches for r in rows]))
    hashes = [tuple(r) for name in runs.names() for r in spark.table(name).collect()]
    assert len(hashes) == len(set(hashes))


def test_runs_are_joined_without_a_shuffle_of_the_runs(spark):
    runs = line_runs.Runs(spark)
    for b in range(2):
        runs.add(line_runs.hashed_lines(spark.createDataFrame(line_rows(b, 60), "doc_id long, text string")))
    a, b = (spark.table(n) for n in runs.names())
    joined = a.hint("merge").join(b, line_runs.HASH, "left_anti")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_runs_no_python(spark):
    plan = line_runs.op11_line_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


# periodic runs


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - start >= q and end + q - start >= least:
                found.setdefault((start, end + q), q)  # the smallest period comes first
            start = max(end, start) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_of_random_words(letters, least):
    rng = random.Random(letters * 100 + least)
    for _ in range(120):
        words = [b"abcdefgh"[(k := rng.randrange(letters)) : k + 1] for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.5 and words:
            words = repeats.with_period(next(i for i in range(10**6) if repeats.crc32(str(i).encode()) % 10 == 0 and i > rng.randrange(500)), words)
        runs = repeats.runs_of(words, least)
        assert runs == plain_runs(words, least), words
        assert repeats.collapsed(words, runs) == plain_collapse(words, runs)


def test_runs_in_runs():
    unit = [b"x", b"y"] * 7 + [b"z"]
    assert repeats.runs_of(unit * 4) == plain_runs(unit * 4)
    fib = [b"a"], [b"a", b"b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    assert repeats.runs_of(fib[1]) == plain_runs(fib[1]) and len(repeats.runs_of(fib[1])) > 20


def test_one_word_repeated_a_hundred_thousand_times():
    assert repeats.runs_of([b"w"] * 100_000) == [(0, 100_000, 1)]
    words = [b"%d" % (i % 30_000) for i in range(100_000)]
    assert repeats.runs_of(words) == [(0, 100_000, 30_000)]


def plain_period(doc_id, words):
    h, n = repeats.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_period("null" if doc_id is None else doc_id, (text or "").encode().split())
    runs = plain_runs(words) if len(words) < 3000 else repeats.runs_of(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(plain_collapse(words, runs)),
    )


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(repeats.op12_periodic_runs(docs))
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sum(r[1] for r in got) > 10


def test_periodic_runs_of_odd_rows(spark):
    odd = odd_documents(spark)
    assert rows_of(repeats.op12_periodic_runs(odd)) == sorted((plain_row(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert repeats.op12_periodic_runs(no_documents(spark)).collect() == []
    assert repeats.periodic_runs(odd).where("doc_id = 5").first()["runs"][0] == (0, 60_000, 3)


# fill-in-middle


def plain_infill(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, a, b - a, digest(out), digest(text)


def test_infill_of_odd_rows(spark):
    odd = odd_documents(spark)
    assert rows_of(infill.op13_fill_in_middle(odd)) == sorted((plain_infill(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert infill.op13_fill_in_middle(no_documents(spark)).collect() == []


def test_infill_of_texts_with_marks_and_wide_characters(spark):
    rng = random.Random(4)
    pieces = ["<P>", "<S", ">", "<M", "<", "P>", "é", "😀", "word ", "\n", "漢字", "a" * 50, "lorem ipsum " * 30]
    rows = [(i, "".join(rng.choice(pieces[1:] if i % 2 else pieces) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(1000 + k, "x" * k + "<M>" + "é" * 300) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(infill.op13_fill_in_middle(docs)) == sorted((plain_infill(*r) for r in rows), key=repr)
    made = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {r.doc_id: r.back for r in made} == dict(rows) and {r.form for r in made} == {"plain", "psm", "spm"}


def chunks_of(text):
    ends = infill.chunk_ends(text)
    return {text[a:b] for a, b in zip([0, *ends], ends)}


def test_chunks_are_decided_by_content():
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)).encode()
    assert infill.chunk_ends(text)[-1] == len(text) and 100 < len(text) / len(infill.chunk_ends(text)) < 600
    assert len(chunks_of(text) & chunks_of(b"something else before " + text)) > 0.95 * len(chunks_of(text))
    assert max(map(len, chunks_of(bytes(3 * infill.PIECE)))) <= infill.MOST


def test_piecewise_hashes_equal_whole_ones(monkeypatch):
    text = random.Random(2).randbytes(50_000)
    whole = infill.chunk_ends(text)
    monkeypatch.setattr(infill, "PIECE", 777)
    assert infill.chunk_ends(text) == whole


def test_cache_keeps_within_its_room():
    cache = infill.Cache(1000)
    for i in range(100):
        chunk = b"%03d" % i * 20
        assert cache[chunk] == cache[chunk] == infill.summary(chunk)
    assert cache.held <= 1000 and sum(map(len, cache.known)) == cache.held

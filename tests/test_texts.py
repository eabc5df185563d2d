import dataclasses
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import routing as r
from shelfwise.functions import text as t
from shelfwise.operators import retrieval, sessions
from shelfwise.plans import tools
from shelfwise.sources.readers import read_text_corpus
from tests.data import MESSAGES, POLICY


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, text in POLICY.items():
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "notes.md").write_text("not a text file")
    return read_text_corpus(spark, str(folder))


@pytest.fixture(scope="module")
def index(corpus):
    return retrieval.tfidf_index(retrieval.chunk_sentences(corpus, "source"))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_corpus_reads_txt_files_whole(corpus):
    assert {x.source: x.text for x in corpus.collect()} == POLICY


def test_chunks_overlap_by_one_sentence(spark):
    text = ". ".join(f"Sentence number {i} is here" for i in range(8)) + "."
    df = spark.createDataFrame([("d", "d", text)], "doc_id string, source string, text string")
    chunks = retrieval.chunk_sentences(df).orderBy("chunk_id").collect()
    assert [c.chunk_id for c in chunks] == ["d_chunk_0", "d_chunk_1", "d_chunk_2"]
    assert chunks[0].text.endswith("number 3 is here") and chunks[1].text.startswith("Sentence number 3")


def test_short_chunks_are_skipped_and_not_numbered(spark):
    df = spark.createDataFrame([(1, "a", "Hi. Yo. A. B"), (2, "b", ""), (3, "c", "This text is long enough, at version 1.0")], "doc_id int, source string, text string")
    assert [(c.chunk_id, c.text) for c in retrieval.chunk_sentences(df).collect()] == [
        ("3_chunk_0", "This text is long enough, at version 1. 0"),
    ]


def test_character_chunks(spark):
    df = spark.createDataFrame([(1, "a", "x" * 1000), (2, "b", "   ")], "doc_id int, source string, text string")
    assert [len(c.text) for c in retrieval.chunk_chars(df).orderBy("chunk_id").collect()] == [500, 500, 100]


@pytest.mark.parametrize("query", ["return policy electronics", "discount promotion", "inventory stock management"])
def test_search_scores(spark, index, query):
    hits = retrieval.search(ask(spark, query), index).orderBy("rank").collect()
    assert hits and all(0 < h.score <= 1 + 1e-9 for h in hits)
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert {"text", "source", "chunk_id"} <= set(hits[0].asDict())


def test_search_finds_the_right_document(spark, index):
    best = {h.query_id: h.source for h in retrieval.search(ask(spark, "discount promotion", "electronics returned"), index).where("rank = 1").collect()}
    assert best == {0: "discounts.txt", 1: "returns.txt"}


def test_a_chunk_finds_itself(spark, index):
    chunk = index.chunks.orderBy("chunk_id").first()
    hit = retrieval.search_topk(ask(spark, chunk.text), index, 1).first()
    assert hit.chunk_id == chunk.chunk_id and hit.score == pytest.approx(1.0)


def test_hits_do_not_depend_on_the_join(spark, index):
    asked = ask(spark, "discount promotion", "inventory stock")
    small = sorted(map(tuple, retrieval.search_topk(asked, index).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, retrieval.search_topk(asked, index).collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def all_scores(asked, index):
    met = index.weights.join(asked, "term").groupBy("query_id", "chunk_id")
    return met.agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), 9).alias("score"))


def best_of(rows, k):
    best = {}
    for row in sorted(rows, key=lambda r: (r.query_id, -r.score, r.chunk_id)):
        best.setdefault(row.query_id, []).append((row.chunk_id, row.score))
    return {q: hits[:k] for q, hits in best.items()}


@pytest.fixture(scope="module")
def topics(spark):
    """40 documents of one topic each; all share the words ``store`` and ``customer``, and some texts repeat."""
    docs = []
    for d in range(40):
        sentences = [f"The store customer topic{d % 20} item{d}x{i % 7} part{(d * 7 + i) % 11}" for i in range(60)]
        docs.append((d, f"s{d % 3}", ". ".join(sentences)))
    return retrieval.tfidf_index(retrieval.chunk_sentences(spark.createDataFrame(docs, "doc_id int, source string, text string")))


@pytest.mark.parametrize("k", [1, 3, 10])
def test_blocks_that_cannot_hold_a_hit_are_skipped(spark, topics, k):
    texts = [f"customer store topic{i} item{i}x3" for i in range(0, 20, 4)] + ["store customer", "part3 part4 part5", "item39x1 store"]
    asked = retrieval.query_terms(ask(spark, *texts), topics)
    every = all_scores(asked, topics).collect()
    tried = retrieval.scored(retrieval.candidate_blocks(asked, topics, k), asked, topics).collect()
    assert len(tried) < 0.7 * len(every)
    found = retrieval.search_topk(ask(spark, *texts), topics, k).collect()
    assert best_of(found, k) == best_of(every, k)


def test_any_blocks_give_the_same_hits(spark, topics):
    asked = ask(spark, "customer topic4 part3", "store")
    want = best_of(retrieval.search_topk(asked, topics, 5).collect(), 5)
    for block in (F.lit("one"), F.col("chunk_id"), F.pmod(F.xxhash64("chunk_id"), F.lit(5)).cast("string")):
        other = dataclasses.replace(topics, postings=retrieval.as_postings(topics.weights.withColumn("block", block)))
        assert best_of(retrieval.search_topk(asked, other, 5).collect(), 5) == want


@pytest.mark.parametrize("max_terms,factor", [(5, 128), (12, 1), (40, 2), (100_000, 128)])
def test_vocabulary_equals_the_counts_of_all_terms(spark, monkeypatch, max_terms, factor):
    rng = random.Random(max_terms)
    texts = [" ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["new york " * 30, "", "alpha", None]
    monkeypatch.setattr(retrieval, "BUCKETS_A_TERM", factor)
    uses, rows = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").split() if len(w) > 1]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        uses.update(terms)
        rows.update(set(terms))
    want = sorted(uses, key=lambda t: (-uses[t], t))[:max_terms]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = retrieval.vocabulary(df, F.lit(len(texts)), [], max_terms=max_terms).collect()
    assert [(x.term, x["count"], x.df) for x in got] == [(t, uses[t], rows[t]) for t in want]


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
def test_terms_are_counted_by_block_and_weighed_without_another_shuffle(spark, rows_a_batch):
    rng = random.Random(rows_a_batch)
    rows = [(f"{i % 7}_chunk_{rng.randrange(150)}", [f"w{rng.randrange(6)}" for _ in range(rng.randrange(9))]) for i in range(60)]
    rows += [(None, ["w1", "w2"]), (None, ["w2", "w1"]), ("", ["w1"]), ("plain", None)]
    terms = ["w1", "w2 w3", "w3", "w2 w1", "w5"]
    want = Counter()
    for chunk, words in rows:
        words = words or []
        want.update((chunk, t) for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])] if t in terms)
    listed = spark.createDataFrame(rows, "chunk_id string, words array<string>").withColumn("block", retrieval.block_of(F.col("chunk_id")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        counted = retrieval.block_counts(listed, terms, True)
        found = counted.collect()
        postings = retrieval.block_postings(counted, terms, [1.0, 2.0, 3.0, 4.0, 5.0], 2)
        weights = postings.select("block", "term", "top", F.explode("entries").alias("e")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(x.chunk_ids[c], terms[p]): n for x in found for c, p, n in zip(x.chunks, x.places, x.tfs)}
    assert got == dict(want) and len(found) == len({x.block for x in found})
    raw = {k: (math.log(n) + 1) * (terms.index(k[1]) + 1) for k, n in want.items()}
    length = {c: math.sqrt(sum(v * v for (d, _), v in raw.items() if d == c)) for c, _ in raw}
    assert {(x.e.chunk_id, x.term): x.e.weight for x in weights} == pytest.approx({k: v / length[k[0]] for k, v in raw.items()})
    top = {}
    for x in weights:
        top[x.block, x.term] = max(x.e.weight, top.get((x.block, x.term), 0))
    assert all(x.top == top[x.block, x.term] for x in weights)
    assert postings._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the words


def test_blocks_hold_neighbouring_chunks(spark):
    ids = ["7_chunk_3", "7_chunk_42", "7_chunk_142", "17_chunk_3", "plain", "5", ""]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select(retrieval.block_of(F.col("id"))).collect()
    assert [x[0] for x in got] == ["7_chunk_", "7_chunk_", "7_chunk_1", "17_chunk_", "plain", "", ""]


def test_answers_and_context(spark, index):
    asked = ask(spark, "discount promotion", "zzz qqq")
    got = {a.query_id: a for a in retrieval.retrieve_answers(asked, index).collect()}
    assert "discount" in got[0].answer.lower() and got[0].sources and got[0].chunks
    assert got[0].full_context.startswith("[Source: discounts.txt | Relevance: ")
    first = [c.chunk_id for c in index.chunks.orderBy("chunk_id").limit(3).collect()]
    texts = {c.chunk_id: c.text for c in index.chunks.collect()}
    assert [(c.text, c.score) for c in got[1].chunks] == [(texts[i], 0.0) for i in first] and got[1].answer == texts[first[0]]
    assert all(len(a.chunks) == 3 for a in got.values()) and "Relevance: 0.00" in got[1].full_context
    more = retrieval.retrieve_answers(asked, index, 100).collect()
    assert all(len(a.chunks) == len({(c.text, c.source) for c in a.chunks}) == len(texts) for a in more)
    assert retrieval.retrieve_answers(asked, index, 0).first().answer == retrieval.NO_CONTENT
    context = {c.query_id: c.context for c in retrieval.build_context(asked, retrieval.search(asked, index, 2)).collect()}
    assert len(context[0]) > 10 and context[1] == retrieval.NO_CONTEXT


def test_empty_store(spark):
    empty = spark.createDataFrame([], "doc_id string, source string, text string")
    index = retrieval.tfidf_index(retrieval.chunk_sentences(empty))
    assert retrieval.retrieve_answers(ask(spark, "anything"), index).first().answer == retrieval.NO_DOCUMENTS


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path))
    loaded = retrieval.Index.load(spark, str(tmp_path))
    asked = ask(spark, "return policy electronics")
    assert retrieval.search_topk(asked, loaded).collect() == retrieval.search_topk(asked, index).collect()


def test_index_keeps_its_settings(spark, corpus, tmp_path):
    own = retrieval.tfidf_index(retrieval.chunk_sentences(corpus, "source"), stop_words=["return"], bigrams=False)
    own.save(str(tmp_path))
    loaded = retrieval.Index.load(spark, str(tmp_path))
    assert (loaded.stop_words, loaded.bigrams) == (("return",), False)
    asked = ask(spark, "the policy of returns")
    assert retrieval.search_topk(asked, loaded).collect() == retrieval.search_topk(asked, own).collect() != []


@pytest.mark.parametrize("text,verdict", [("Great growth", "positive"), ("a bad problem", "negative"), ("stop", "positive"), ("good but bad", "neutral"), ("", "neutral")])
def test_sentiment(spark, text, verdict):
    got = retrieval.sentiment(spark.createDataFrame([(text,)], "text string")).first()
    assert got.sentiment == verdict and got.positive + got.neutral + got.negative == pytest.approx(1.0)


def test_key_phrases(spark):
    df = spark.createDataFrame([("Show me the Sales trend and the sales of café products, x2 ab one two three four five six",)], "text string")
    assert retrieval.key_phrases(df).first().key_phrases == ["sales", "trend", "and", "products", "one", "two", "three", "four"]


def test_classify(spark):
    df = spark.createDataFrame(MESSAGES, "text string, expected string")
    wrong = df.withColumn("agent", r.agent(F.col("text"))).where("agent <> expected").collect()
    assert wrong == []


def test_actions(spark):
    df = spark.createDataFrame([("top 7 best products",), ("details of item prod_12",), ("what is the return policy",), ("hi there",)], "text string")
    got = [(x.action, x.top_n, x.product_id) for x in sessions.route_actions(df).collect()]
    assert got == [("pull_top_earners", 7, None), ("pull_product_breakdown", None, "PROD_12"), ("search_policy_docs", None, None), ("pull_sales_overview", None, None)]


def test_tools_and_parameters(spark):
    df = spark.createDataFrame([("top 3 sellers",), ("sales of product PROD_77",), ("regional sales area",), ("hello",)], "text string")
    got = [(x.tool, x.top_n, x.product_id) for x in sessions.route_messages(df).collect()]
    assert got == [("get_top_products", 3, None), ("get_product_detail", None, "PRODUCT"), ("get_region_breakdown", None, None), ("get_sales_overview", None, None)]
    strict = df.select(r.product_token(F.col("text"), strict=True).alias("p")).collect()
    assert [x.p for x in strict] == [None, "PROD_77", None, None]


def test_session_rollup(spark):
    asked = spark.createDataFrame([("s1", "What is the total revenue?", "1"), ("s2", "Forecast demand", None)], "session_id string, text string, answer string")
    trail = sessions.session_messages(asked)
    got = {s.session_id: s for s in sessions.session_summary(trail).collect()}
    assert got["s1"].agents_involved == ["user", "AnalyticsAgent"] and got["s1"].message_count == 4
    assert got["s1"].tools_used == ["get_sales_overview"] and got["s2"].tools_used == ["get_demand_forecast"]
    history = sessions.history_for_llm(trail).orderBy("session_id", "position").collect()
    assert [h.role for h in history] == ["user", "assistant", "assistant", "assistant", "user", "assistant", "assistant"]
    assert history[2].content == "[Tool Result] 1"


def test_tool_calls_in_order_with_repeats(spark):
    tools = ["b", "a", None, "b", "", "b", "a", "c", "a"]
    rows = [("s", i, "agent", "X", "", t, None) for i, t in enumerate(tools)] + [("other", 0, "user", "user", "", None, None)]
    columns = "session_id string, position int, role string, agent_id string, content string, tool_name string, tool_result string"
    got = sessions.tool_call_lists(spark.createDataFrame(rows[::-1], columns), positions=4).collect()
    assert sorted((x.session_id, x.block, x.tools) for x in got) == [("s", 0, ["b", "a", "b"]), ("s", 1, ["b", "a", "c"]), ("s", 2, ["a"])]


def test_tool_registry(spark):
    assert len(tools.TOOLS) >= 10
    assert {"get_sales_overview", "search_policy", "get_anomaly_summary", "get_demand_forecast"} <= set(tools.TOOLS)
    with pytest.raises(KeyError, match="Unknown tool"):
        tools.run_tool("nonexistent_tool", tools.Store(spark.range(1)))


def test_no_python_workers_in_text_jobs(spark, corpus, index):
    for df in (retrieval.key_phrases(corpus), retrieval.sentiment(corpus), index.weights, retrieval.search(ask(spark, "x"), index)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_top_k_is_cut_before_the_shuffle(spark, index):
    plan = retrieval.search_topk(ask(spark, "discount"), index)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("k,passes", [(3, (1000, 200_000)), (10, (1000, 15))])
def test_search_by_counts_meets_the_index_without_a_shuffle(spark, topics, monkeypatch, tmp_path, k, passes):
    monkeypatch.setattr(retrieval, "ASKED", passes)
    monkeypatch.setattr(retrieval, "CELLS", 500)
    rows = [(i, f"customer store topic{i} item{i}x3") for i in range(6)] + [(6, "store"), (7, "nothing known"), (None, "store topic1"), (1, "part3")]
    asked = spark.createDataFrame(rows, "query_id int, text string")
    found = best_of(retrieval.search_topk(asked, topics, k).collect(), k)
    by_postings = dataclasses.replace(topics)
    assert topics.counted is not None and by_postings.counted is None
    assert found == best_of(retrieval.search_topk(asked, by_postings, k).collect(), k) and sorted(found) == list(range(7))
    topics.save(str(tmp_path))
    assert not (tmp_path / "postings").exists()
    assert best_of(retrieval.search_topk(asked, retrieval.Index.load(spark, str(tmp_path)), k).collect(), k) == found
    terms = retrieval.query_terms(asked, topics).join(retrieval._passes(retrieval.query_terms(asked, topics)), "query_id")
    best = retrieval._task_best(terms.where("pass = 0"), 0, topics.counted, *retrieval.vocabulary_lists(topics.vocabulary), k)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [3, 1 << 19])
def test_terms_of_words_kept_as_text(spark, monkeypatch, held):
    monkeypatch.setattr(retrieval, "HELD", held)
    monkeypatch.setattr(retrieval, "BUCKETS_A_TERM", 2)
    rng = random.Random(held)
    texts = [" ".join(f"wé{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(rng.randrange(30))) for _ in range(80)] + ["", None]
    uses = Counter()
    for text in texts:
        words = (text or "").split()
        uses.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    listed = spark.createDataFrame([(t,) for t in texts], "words string")
    for n in (5, 30, 10_000):
        got = retrieval.top_terms(listed, True, n).orderBy("place").collect()
        assert [(x.term, x["count"], x.place) for x in got] == [
            (t, uses[t], i) for i, t in enumerate(sorted(uses, key=lambda t: (-uses[t], t))[:n])
        ]

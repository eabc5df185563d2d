"""Named queries over documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import routing as r
from shelfwise.operators import retrieval, sessions
from shelfwise.plans.registry_sales import Query
from shelfwise.sources import star


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return star.spread(star.table(spark, folder, "documents").select("doc_id", "source", "text"))


def index(spark: SparkSession, folder: str) -> retrieval.Index:
    return retrieval.tfidf_index(retrieval.chunk_sentences(documents(spark, folder)))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return star.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _token_lists(spark: SparkSession, folder: str) -> DataFrame:
    listed = retrieval.with_terms(documents(spark, folder), retrieval.stop_word_list())
    return listed.select("doc_id", F.array_join("terms", "|").alias("terms"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.retrieve_answers(asked(spark, folder), index(spark, folder))
    return found.select(
        "query_id", "query", "answer", "full_context", F.array_join("sources", ",").alias("sources"),
        F.size("chunks").alias("chunk_count"),
    )


def _search(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.search_topk(asked(spark, folder), index(spark, folder)), "score")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.search(asked(spark, folder), index(spark, folder))
    return retrieval.distinct_sources(found).withColumn("sources", F.array_join("sources", ","))


def _context(spark: SparkSession, folder: str) -> DataFrame:
    queries = asked(spark, folder)
    return retrieval.build_context(queries, retrieval.search(queries, index(spark, folder)))


def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.key_phrases(documents(spark, folder))
    return found.select("doc_id", F.array_join("key_phrases", ",").alias("key_phrases"))


def _summary(messages: DataFrame) -> DataFrame:
    out = sessions.session_summary(messages)
    return out.withColumns({n: F.array_join(n, ",") for n in ("agents_involved", "tools_used")})


def _call_lists(messages: DataFrame) -> DataFrame:
    return sessions.tool_call_lists(messages).withColumn("tools", F.array_join("tools", ","))


def _classified(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r.agent(F.col("text")).alias("agent"), r.action(F.col("text")).alias("action"))


def _part_trail(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_messages(star.questions(spark, folder))


def queries() -> dict[str, Query]:
    return {
        "chunk_sentences": lambda s, f: retrieval.chunk_sentences(documents(s, f)),
        "chunk_chars": lambda s, f: retrieval.chunk_chars(documents(s, f)),
        "tokenize": _token_lists,
        "vocabulary": lambda s, f: _rounded(index(s, f).vocabulary, "idf"),
        "tfidf_index": lambda s, f: _rounded(index(s, f).weights, "weight"),
        "tfidf_blocks": lambda s, f: _rounded(index(s, f).postings.drop("entries"), "top"),
        "search_topk": _search,
        "distinct_sources": _sources,
        "build_context": _context,
        "retrieve_answers": _answers,
        "sentiment": lambda s, f: retrieval.sentiment(documents(s, f)).drop("text", "source"),
        "key_phrases": _phrases,
        "classify_messages": lambda s, f: _classified(star.table(s, f, "conversations"), "conv_id", "turn"),
        "classify_questions": lambda s, f: _classified(star.questions(s, f), "session_id"),
        "select_tool": lambda s, f: sessions.route_messages(star.questions(s, f)).drop("answer"),
        "pick_action": lambda s, f: sessions.route_actions(star.questions(s, f)).drop("answer"),
        "session_summary": lambda s, f: _summary(star.conversation_messages(s, f)),
        "session_summary_routed": lambda s, f: _summary(_part_trail(s, f)),
        "tool_calls": lambda s, f: sessions.tool_calls(star.conversation_messages(s, f)),
        "tool_call_lists": lambda s, f: _call_lists(star.conversation_messages(s, f)),
        "history_for_llm": lambda s, f: sessions.history_for_llm(star.conversation_messages(s, f)),
        "history_for_llm_routed": lambda s, f: sessions.history_for_llm(_part_trail(s, f)),
    }

"""Routed messages and session rollups.

Messages have ``session_id, position, role, agent_id, content, tool_name, tool_result``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import routing as r


def route_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds agent, tool and the parameters that the tool takes from the message; a plain projection."""
    message = F.col(text)
    return (
        df.withColumn("agent", r.agent(message))
        .withColumn("tool", r.tool(F.col("agent"), message))
        .withColumns(
            {
                "top_n": F.when(F.col("tool") == "get_top_products", r.first_number(message)),
                "product_id": F.when(F.col("tool") == "get_product_detail", r.product_token(message)),
                "query": F.when(F.col("agent") == r.POLICY, message),
            }
        )
    )


def route_actions(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the best action and its parameters."""
    message = F.col(text)
    return df.withColumn("action", r.action(message)).withColumns(
        {
            "top_n": F.when(F.col("action") == "pull_top_earners", r.first_number(message)),
            "product_id": F.when(F.col("action") == "pull_product_breakdown", r.short_product_token(message)),
            "query": F.when(F.col("action") == "search_policy_docs", message),
        }
    )


def session_summary(messages: DataFrame) -> DataFrame:
    """Per session: message count, agents and tools in the order they first appear, tool calls.

    Messages are first combined per session and agent or tool, so that a session with a third of all
    messages sends a few partial rows per task. The lists hold distinct names only; every single
    call, in order, is a row of ``tool_calls``.
    """
    kinds = F.array(
        F.struct(F.lit("message").alias("kind"), F.lit("").alias("name")),
        F.struct(F.lit("agent").alias("kind"), F.nullif("agent_id", F.lit("system")).alias("name")),
        F.struct(F.lit("tool").alias("kind"), F.nullif("tool_name", F.lit("")).alias("name")),
    )
    seen = (
        messages.select("session_id", "position", F.explode(kinds).alias("k"))
        .where(F.col("k.name").isNotNull())
        .groupBy("session_id", "k.kind", "k.name")
        .agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    )

    def names(kind: str):
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("first", "name")))
        return F.transform(F.sort_array(entries), lambda e: e["name"])

    return seen.groupBy("session_id").agg(
        names("agent").alias("agents_involved"),
        names("tool").alias("tools_used"),
        F.coalesce(F.sum(F.when(F.col("kind") == "tool", F.col("n"))), F.lit(0)).alias("tool_calls"),
        F.sum(F.when(F.col("kind") == "message", F.col("n"))).alias("message_count"),
    )


def tool_calls(messages: DataFrame) -> DataFrame:
    """Every tool call of every session; ``position`` gives the order."""
    return messages.where(F.nullif("tool_name", F.lit("")).isNotNull()).select("session_id", "position", "tool_name")


def tool_call_lists(messages: DataFrame, positions: int = 1000) -> DataFrame:
    """``(session_id, block, tools)``: the tools of all calls in order, repeats included.

    A list covers ``positions`` positions of a session, so one session's calls are spread over many lists; in the
    order of ``block`` they make the whole list.
    """
    call = F.struct("position", "tool_name")
    block = F.floor(F.col("position") / positions).cast("long").alias("block")
    lists = tool_calls(messages).groupBy("session_id", block).agg(F.sort_array(F.collect_list(call)).alias("calls"))
    return lists.select("session_id", "block", F.col("calls.tool_name").alias("tools"))


def history_for_llm(messages: DataFrame) -> DataFrame:
    """Chat history rows: user and agent texts and tool results, all others dropped. No shuffle."""
    role = F.col("role")
    has_result = (role == "tool") & (F.nullif("tool_result", F.lit("")).isNotNull())
    spoken = F.when(role == "user", "user").when((role == "agent") | has_result, "assistant")
    content = F.when(has_result, F.concat(F.lit("[Tool Result] "), "tool_result")).otherwise(F.col("content"))
    return messages.select("session_id", "position", spoken.alias("role"), content.alias("content")).where(
        F.col("role").isNotNull()
    )


def session_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """The message trail of answering each row of ``(session_id, text, answer)``.

    User message, tool choice, tool result, reply: four rows per question, in that order.
    """
    message, agent = F.col(text), r.agent(F.col(text))
    chosen = df.withColumn("_agent", agent).withColumn("_tool", r.tool(F.col("_agent"), message, in_session=True))
    none = F.lit(None).cast("string")

    def entry(position: int, role: str, who, content, tool_name=none, result=none):
        return F.struct(
            F.lit(position).alias("position"), F.lit(role).alias("role"), who.alias("agent_id"),
            content.alias("content"), tool_name.alias("tool_name"), result.alias("tool_result"),
        )

    choice = F.concat(F.lit("I will use the '"), F.col("_tool"), F.lit("' tool to answer your question."))
    done = F.concat(F.lit("Tool '"), F.col("_tool"), F.lit("' returned result."))
    trail = F.array(
        entry(0, "user", F.lit("user"), message),
        entry(1, "agent", F.col("_agent"), choice, F.col("_tool")),
        entry(2, "tool", F.col("_agent"), done, none, F.col("answer")),
        entry(3, "agent", F.col("_agent"), F.col("answer")),
    )
    return chosen.select("session_id", F.explode(trail).alias("m")).select("session_id", "m.*")

"""Column expressions that route a message to an agent, an action or a tool by its keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.fixed import (
    ACTION_KEYWORDS,
    AGENT_KEYWORDS,
    AGENT_TOOLS,
    ANALYTICS,
    ANSWERING_FALLBACK,
    FALLBACK_TOOL,
    FORECAST,
    POLICY,
    SESSION_TOOLS,
)
from shelfwise.functions.text import hits, hits_any


def agent(message: Column) -> Column:
    """Best keyword score; a tie goes to the forecast agent, then to policy; no hit means analytics."""
    lower = F.lower(message)
    forecast, policy, analytics = (hits(lower, AGENT_KEYWORDS[n]) for n in (FORECAST, POLICY, ANALYTICS))
    return (
        F.when((forecast > 0) & (forecast >= F.greatest(policy, analytics)), FORECAST)
        .when((policy > 0) & (policy >= analytics), POLICY)
        .otherwise(ANALYTICS)
    )


def action(message: Column) -> Column:
    """The action with the highest score, the earlier one on a tie, the first when nothing is hit."""
    scores = F.array(*[hits(F.lower(message), words) for words in ACTION_KEYWORDS.values()])
    names = F.array(*[F.lit(n) for n in ACTION_KEYWORDS])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def tool(agent_name: Column, message: Column, in_session: bool = False) -> Column:
    """The first tool of the agent one of whose words occurs, else the agent's fallback."""
    lower = F.lower(message)
    tools, fallback = (SESSION_TOOLS, FALLBACK_TOOL) if in_session else (AGENT_TOOLS, ANSWERING_FALLBACK)
    chosen = F.lit(None).cast("string")
    for name, choices in tools.items():
        picked = F.lit(fallback[name])
        for tool_name, words in reversed(choices.items()):
            picked = F.when(hits_any(lower, words), tool_name).otherwise(picked)
        chosen = F.when(agent_name == name, picked).otherwise(chosen)
    return chosen


def _tokens(message: Column) -> Column:
    return F.filter(F.split(message, r"\s+"), lambda w: w != "")


def first_number(message: Column) -> Column:
    """The first token that is all digits, as a number."""
    return F.get(F.filter(_tokens(message), lambda w: w.rlike("^[0-9]+$")), F.lit(0)).try_cast("bigint")


def product_token(message: Column, strict: bool = False) -> Column:
    """First token that starts with PROD and has six or more letters ("PRODUCT" does, too).

    ``strict`` asks for ``PROD_`` and a word after it.
    """
    upper = _tokens(F.upper(message))
    rule = (lambda w: w.rlike(r"^PROD_\w+$")) if strict else (lambda w: w.startswith("PROD") & (F.length(w) >= 6))
    return F.get(F.filter(upper, rule), F.lit(0))


def short_product_token(message: Column) -> Column:
    """The older rule: first token that starts with P and has three or more letters."""
    upper = _tokens(F.upper(message))
    return F.get(F.filter(upper, lambda w: w.startswith("P") & (F.length(w) >= 3)), F.lit(0))

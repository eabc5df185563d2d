"""Column expressions for texts: chunks, tokens, sentiment and key phrases. No UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.fixed import CONFIDENCE, NEGATIVE_WORDS, PHRASE_STOP_WORDS, POSITIVE_WORDS

WORD_RUN = r"([\p{L}\p{N}_]+)"
TERM_RUN = r"([\p{L}\p{N}_]{2,})"
BLANKS = " \t\r\n\f\u000b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in a lower-cased text, inside words too."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k)))


def hits_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether one of the keywords, which are plain words, occurs in a lower-cased text."""
    return text.rlike("|".join(keywords))


def sentences(text: Column) -> Column:
    """Parts between full stops, stripped; a stop inside a number ends a part as well."""
    parts = F.split(F.translate(text, "\n", " "), r"\.", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_windows(parts: Column, size: int = 4, overlap: int = 1, min_len: int = 20) -> Column:
    """Runs of ``size`` sentences that share ``overlap`` of them, longer than ``min_len`` characters.

    ``parts`` should be a column of its own: it is read once per window.
    """
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1, F.lit(size - overlap)))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, size), ". "))
    return F.coalesce(F.filter(joined, lambda t: F.length(t) > min_len), F.array().cast("array<string>"))


def character_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Runs of ``size`` characters that share ``overlap`` of them, stripped, empty ones left out."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    cut = F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size))))
    return F.coalesce(F.filter(cut, lambda t: t != ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-cased runs of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_RUN))


def pairs(single: Column) -> Column:
    """The pairs of words that are neighbours."""
    following = F.slice(single, F.lit(2), F.greatest(F.size(single), F.lit(1)))
    both = F.zip_with(single, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(both, lambda p: p.isNotNull())


def with_pairs(single: Column) -> Column:
    """The words, and the pairs of words that are neighbours."""
    return F.concat(single, pairs(single))


def sentiment(text: Column) -> Column:
    lower = F.lower(text)
    good, bad = hits(lower, POSITIVE_WORDS), hits(lower, NEGATIVE_WORDS)
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def confidence(verdict: Column, which: int) -> Column:
    value = F.lit(CONFIDENCE["neutral"][which])
    for name in ("negative", "positive"):
        value = F.when(verdict == name, F.lit(CONFIDENCE[name][which])).otherwise(value)
    return value


def key_phrases(text: Column, limit: int = 8) -> Column:
    """The first ``limit`` distinct words of three or more plain letters that are no stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN))
    plain = F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(list(PHRASE_STOP_WORDS)))
    return F.slice(F.array_distinct(plain), 1, limit)

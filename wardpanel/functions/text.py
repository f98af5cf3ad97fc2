"""Text helpers as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored by the token profile.
STOP_WORDS = (
    "able", "and", "are", "assessment", "care", "for", "from", "has", "left", "not", "normal", "note", "notes",
    "other", "patient", "performed", "right", "status", "the", "with",
)
TOKEN = r"([a-z][a-z0-9_/-]{2,})"


def safe_name(name: Column, fallback: Column) -> Column:
    """Lower case, runs of other characters become `_`, trimmed, 64 characters at most."""
    cleaned = F.regexp_replace(F.lower(F.trim(name)), "[^a-zA-Z0-9_]+", "_")
    short = F.substring(F.regexp_replace(cleaned, "^_+|_+$", ""), 1, 64)
    return F.when(F.length(short) > 0, short).otherwise(fallback)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of the keywords."""
    low = F.lower(text)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return hit


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), 1)
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def tags(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the patterns found in the text, in the order given."""
    found = [F.when(F.lower(text).rlike(rx), F.lit(name)) for name, rx in patterns.items()]
    return F.array_compact(F.array(*found))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(F.when(F.lower(c.cast("string")) != "nan", c.cast("string")), F.lit(""))


def not_empty(c: Column) -> Column:
    return c.isNotNull() & (F.length(c.cast("string")) > 0)

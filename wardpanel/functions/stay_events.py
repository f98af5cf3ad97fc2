"""Helpers for user factors over the events of one stay, as columns; no Python runs per row.

Events are an array of (text, hours) in the row of a stay, as `stay_events` makes it from the arrays of `group_text`.  Hours may be
missing; such an event counts for keywords but lies in no window.  A window holds its start and not its end.  Missing arrays are
empty, and a factor over no events is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardpanel.functions.text import has_any

EVENTS = "array<struct<text:string,hours:double>>"


def stay_events(texts: Column, offsets: Column, minutes: bool = True) -> Column:
    """Lower-cased texts with their hours; texts beyond the last offset have none."""
    hours = lambda i: F.get(offsets, i).cast("double") / F.lit(60.0 if minutes else 1.0)
    pairs = F.transform(texts, lambda t, i: F.struct(F.lower(t).alias("text"), hours(i).alias("hours")))
    return F.coalesce(pairs.cast(EVENTS), F.array().cast(EVENTS))


def inside(event: Column, start: float, end: float) -> Column:
    return F.coalesce((event["hours"] >= F.lit(float(start))) & (event["hours"] < F.lit(float(end))), F.lit(False))


def mentions(event: Column, keywords: Sequence[str]) -> Column:
    return F.coalesce(has_any(event["text"], [k.lower() for k in keywords]), F.lit(False))


def between(events: Column, start: float, end: float) -> Column:
    """The events of a window."""
    return F.filter(events, lambda e: inside(e, start, end))


def keyword_any(events: Column, keywords: Sequence[str]) -> Column:
    return F.exists(events, lambda e: mentions(e, keywords))


def keyword_count(events: Column, keywords: Sequence[str]) -> Column:
    """Events that hold a keyword; one with several counts once."""
    return F.size(F.filter(events, lambda e: mentions(e, keywords)))


def share(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the whole is 0, nearly 0 or missing."""
    return F.when(F.abs(whole) >= 1e-12, part / whole).otherwise(F.lit(0.0))


def keyword_density(events: Column, keywords: Sequence[str]) -> Column:
    return share(keyword_count(events, keywords), F.size(events))


def first_hours(events: Column, keywords: Sequence[str], start: float = 0.0, end: float = 48.0) -> Column:
    """Hours of the first event of the window with a keyword."""
    hits = F.filter(events, lambda e: inside(e, start, end) & mentions(e, keywords))
    return F.coalesce(F.array_min(F.transform(hits, lambda e: e["hours"])), F.lit(0.0))


def persistence(events: Column, keywords: Sequence[str], windows: Sequence[tuple[float, float]]) -> Column:
    """Share of the windows with a keyword; a window given twice counts twice."""
    if not windows:
        return F.lit(0.0)
    hits = [keyword_any(between(events, *w), keywords).cast("double") for w in windows]
    return sum(hits[1:], hits[0]) / len(windows)


def log_plus_one(value: Column) -> Column:
    """log(1 + value), values below 0 as 0, missing and NaN values too."""
    return F.log1p(F.greatest(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))

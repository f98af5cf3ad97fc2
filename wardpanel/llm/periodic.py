"""Maximal periodic runs of words, proposed by string synchronising sets and confirmed word by word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import mix, sliding_min, text_slices

#: Periods up to this one are read off directly; scale t, a power of two from 4 on, covers the periods 2t to 4t - 1.
SMALL_PERIODS = 7
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shortest run reported, and how many times a run holds its period at least.
LEAST_LENGTH, LEAST_POWER = 24, 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary"


class Runs:
    """Runs found so far in an array of tokens: per period the starts and ends, in order; all of at least three periods."""

    def __init__(self):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, period: int, first: np.ndarray, end: np.ndarray) -> None:
        """Stretches with `period`, less those that a run of a divisor holds: their smallest period is that divisor."""
        for p, (a, b) in self.of.items():
            if not len(first):
                return
            if p < period and period % p == 0:
                at = np.searchsorted(a, first, side="right") - 1
                held = (at >= 0) & (b[np.maximum(at, 0)] >= end)
                first, end = first[~held], end[~held]
        if len(first):
            self.of[period] = (first, end)

    def periodic(self, size: int, n: int) -> np.ndarray:
        """Places from which `size` tokens have a period of at most a third of `size`."""
        edge = np.zeros(n + 1, dtype=np.int32)
        for p, (a, b) in self.of.items():
            if p * 3 <= size:
                long = b - a >= size
                np.add.at(edge, a[long], 1)
                np.add.at(edge, b[long] - size + 1, -1)
        return np.cumsum(edge)[:n] > 0


def small_runs(tokens: np.ndarray, runs: Runs) -> None:
    """Runs of the smallest periods, by comparing the tokens with themselves shifted."""
    for p in range(1, min(SMALL_PERIODS, len(tokens) - 1) + 1):
        turn = np.diff(np.concatenate([[0], (tokens[p:] == tokens[:-p]).view(np.int8), [0]]))
        first, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = end - first >= (LEAST_POWER - 1) * p
        runs.add(p, first[long], end[long] + p)


def synchronising(names: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Places i chosen by the content of their 2t tokens alone, at least one in every t unless the text there has a period of at most t / 3.

    `names` are hashes of the t tokens from each place.  Of the places i to i + t that are not highly periodic the smallest
    name must be that of i or of i + t.
    """
    order = np.where(periodic[: len(names)], NONE, names)
    least = sliding_min(order, t + 1)
    return np.flatnonzero((least != NONE) & ((least == order[: len(least)]) | (least == order[t:])))


def stretch(tokens: np.ndarray, place: int, d: int) -> tuple[int, int]:
    """First and end place x around `place` with tokens[x] == tokens[x + d] throughout; empty if that fails at `place`."""
    n, step, end = len(tokens) - d, 64, place
    while end < n:
        part = tokens[end : min(end + step, n)] != tokens[end + d : min(end + step, n) + d]
        if part.any():
            end += int(part.argmax())
            break
        end, step = end + len(part), step * 2
    if end == place:
        return place, place
    step, first = 64, place
    while first > 0:
        low = max(0, first - step)
        part = (tokens[low:first] != tokens[low + d : first + d])[::-1]
        if part.any():
            first -= int(part.argmax())
            break
        first, step = low, step * 2
    return first, end


def scale_runs(tokens: np.ndarray, names: np.ndarray, t: int, runs: Runs) -> None:
    """Runs of the periods 2t to 4t - 1.

    In such a run some synchronising place lies one period before another with the same 2t tokens.  Equal ones are more than t / 3
    apart, so at most eleven lie between; all distances in range are proposed, and each is confirmed on the tokens themselves.
    """
    places = synchronising(names, runs.periodic(t, len(tokens)), t)
    if len(places) < 2:
        return
    context = mix(names[places] ^ (names[places + t] * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((places, context))
    places, context = places[order], context[order]
    found, k = [], 1
    while k < len(places):
        gap = places[k:] - places[:-k]
        near = (context[k:] == context[:-k]) & (gap < 4 * t)
        if not near.any():
            break
        pick = near & (gap >= 2 * t)
        found.append(np.stack([gap[pick], places[:-k][pick]], axis=1))
        k += 1
    if not found:
        return
    proposed = np.unique(np.concatenate(found), axis=0)
    cut = np.flatnonzero(np.diff(proposed[:, 0])) + 1
    for group in np.split(proposed, cut):
        if not len(group):
            continue
        d, at, i, out = int(group[0, 0]), group[:, 1], 0, []
        while i < len(at):
            first, end = stretch(tokens, int(at[i]), d)
            if end - first >= (LEAST_POWER - 1) * d:
                out.append((first, end + d))
            i = max(i + 1, int(np.searchsorted(at, end)))
        if out:
            first, end = np.array(out, dtype=np.int64).T
            runs.add(d, first, end)


def find_runs(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least three periods, in the order of start and period.

    `tokens` are the non-negative token numbers of several texts of `counts` tokens; no run crosses a border, as each text ends in a mark
    of its own, which the places count.
    """
    n, runs = len(tokens) + len(counts), Runs()
    ends = np.cumsum(counts + 1) - 1
    marked = np.full(n, -1, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    marked[inside] = tokens
    marked[ends] = -1 - np.arange(len(counts))
    small_runs(marked, runs)
    names, t = mix(marked.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), 1
    while LEAST_POWER * 2 * t <= counts.max(initial=0):
        if 2 * t > SMALL_PERIODS:
            scale_runs(marked, names, t, runs)
        names = mix(names[: len(names) - t] * np.uint64(0x9E3779B97F4A7C15) ^ mix(names[t:]))
        t *= 2
    rows = [np.stack([a, b - a, np.full(len(a), p)], axis=1) for p, (a, b) in runs.of.items()]
    table = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2]


def run_rows(texts: list[list[bytes]], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each list of words: how many, its runs (start, length, period), and the words that no run repeats."""
    counts = np.array([len(w) for w in texts], dtype=np.int64)
    known: dict[bytes, int] = {}
    tokens = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), dtype=np.int64, count=int(counts.sum()))
    start, length, period = find_runs(tokens, counts)
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    begin = np.cumsum(counts + 1) - (counts + 1)
    edges = np.searchsorted(start, np.concatenate([begin, [len(tokens) + len(counts)]]))
    for i, words in enumerate(texts):
        own = slice(edges[i], edges[i + 1])
        runs = list(zip((start[own] - begin[i]).tolist(), length[own].tolist(), period[own].tolist()))
        if runs:
            gone = np.zeros(len(words), dtype=bool)
            for a, n, p in runs:
                gone[a + p : a + n] = True
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        yield int(counts[i]), runs, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, prepare: Callable | None = None) -> DataFrame:
    """Runs of words of each text: stretches with smallest period q, of at least max(`least_length`, 3q) words, that no neighbouring word extends.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged, of the whole text.  At every scale a synchronising set picks places by the content around
    them, equal contexts propose periods, and each proposal is confirmed on the words; places in highly periodic stretches are left out, as
    their small periods are known from smaller scales.  The result is exact.  `prepare(id, words)` may replace the words of a row first.

    Returns one row per input row, without a shuffle: `id_col`, `n_words`, `runs` (start, length, period; by start, then period), `kept`
    (binary: words joined by one space, without those that a run holds after its first period).  Null or empty text: no words, no
    runs, empty `kept`.  Rows that repeat get the same result each.  A text is worked on in one task.  Empty table: no rows.
    Other columns are not read.
    """
    if least_length < 1:
        raise ValueError("least_length must be positive")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                words = [t.split() for t in texts]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words)]
                n, runs, kept = zip(*run_rows(words, least_length))
                lists = [[{"start": s, "length": c, "period": p} for s, c, p in r] for r in runs]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, type=pa.int64()), pa.array(lists, type=pa.list_(RUN)), pa.array(kept, type=pa.binary())], names=["id", "n_words", "runs", "kept"])

    source = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(rows, f"id bigint, {SCHEMA}").withColumnRenamed("id", id_col)


def with_digests(out: DataFrame) -> DataFrame:
    """Columns of the strongest run and digests of all runs and of the kept words, beside `runs` and `kept`."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | (
        (a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
    )
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        *[c for c in out.columns if c != "best"], F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )

"""Which fixed-length token windows of a corpus occur more than once, without a row per window.

Every window holds an anchor: its k-gram with the smallest hash.  Equal windows have equal anchors at the
same offset, so consecutive windows with one anchor form a run, and

* a run whose anchor occurs once in the corpus holds no repeated window;
* a run that occurs twice as a whole holds only repeated windows;
* only the rest, runs that share an anchor but differ, has to be compared window by window.

Runs are counted in Spark with map-side combining, so a passage in a third of all documents makes one row
per task, not a hot key.  Joins back to the runs are plain sort-merge joins over staged tables, which
adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import BYTE_TOKENS, PrimeRolling, documents, id_back, mix, row_texts, sliding_min, stage, text_slices

RUNS = "id bigint, v bigint, start int, n int, at int, anchor bigint, digest bigint"
LOW = np.uint64((1 << 28) - 1)


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the joined texts and the token count of each text: one token per byte."""
    return BYTE_TOKENS[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64)


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same with one token per word: a hash of its bytes, taken once for each distinct word."""
    lists = [t.split() for t in texts]
    coded = pa.array([w for words in lists for w in words], type=pa.binary()).dictionary_encode()
    values = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    tokens = values[coded.indices.to_numpy()] if len(values) else np.zeros(0, dtype=np.uint64)
    return tokens, np.array([len(w) for w in lists], dtype=np.int64)


def find_runs(tokens: np.ndarray, counts: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text number, first window, windows, anchor offset, anchor and content hash."""
    n = len(tokens)
    if n < size or counts.max() < size:
        return {}
    rolling = PrimeRolling(tokens)
    grams = mix(rolling.windows(gram))
    place = np.arange(len(grams), dtype=np.uint64)
    best = sliding_min((grams & ~LOW) | place, size - gram + 1) & LOW
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(best)]
    valid = np.arange(len(best)) + size <= ends[doc]
    cut = np.flatnonzero((best[1:] != best[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(best)]])
    good = valid[first]
    first, last = first[good], last[good]
    anchor = best[first].astype(np.int64)
    digest = mix(rolling.span(first, last - 1 + size) + (last - first).astype(np.uint64))
    owner = doc[first]
    return {"doc": owner, "start": first - (ends - counts)[owner], "n": last - first, "at": anchor - first, "anchor": grams[anchor], "digest": digest}


def run_rows(docs: DataFrame, units: Callable, size: int, gram: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, texts in text_slices(batch.column(2)):
                found = find_runs(*units(texts), size, gram)
                if found:
                    own = found["doc"] + a
                    columns = [pa.array(ids[own]), pa.array(v[own])]
                    columns += [pa.array(found[c].astype(np.int32)) for c in ("start", "n", "at")]
                    columns += [pa.array(found[c].view(np.int64)) for c in ("anchor", "digest")]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "start", "n", "at", "anchor", "digest"])

    return docs.select("id", "v", "text").mapInArrow(rows, RUNS)


def window_rows(parts: DataFrame, units: Callable, size: int) -> DataFrame:
    """Two independent Rabin-Karp hashes of every window of the given runs; `parts`: id, v, text, runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            for i, text in row_texts(batch.column(2)):
                own = runs[i].as_py()
                tokens, _ = units([text])
                hashes = [PrimeRolling(tokens, w).windows(size) for w in (0, 1)]
                starts = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in own])
                times = np.repeat(np.array([min(2, r["times"]) for r in own]), [r["n"] for r in own])
                key = [np.full(len(starts), batch.column(c)[i].as_py(), dtype=t) for c, t in ((0, np.int64), (1, np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*key, starts.astype(np.int32), *(h[starts].view(np.int64) for h in hashes), times.astype(np.int32))],
                    names=["id", "v", "start", "h0", "h1", "times"],
                )

    return parts.select("id", "v", "text", "runs").mapInArrow(rows, "id bigint, v bigint, start int, h0 bigint, h1 bigint, times int")


def count_windows(parts: DataFrame, units: Callable, size: int) -> DataFrame:
    """(id, v, start, n = 1) of the windows that occur again; only runs that occur once need an answer."""
    windows = stage(window_rows(parts, units, size))
    again = stage(windows.groupBy("h0", "h1").agg(F.sum("times").alias("total")).where("total > 1").select("h0", "h1"))
    return windows.where("times = 1").join(again.hint("merge"), ["h0", "h1"]).select("id", "v", "start", F.lit(1).alias("n"))


def settle_runs(runs: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, v, start, n): the repeated windows among `runs` (staged; id, v, start, n, at, anchor, digest, times).

    Runs alone with their anchor are dropped, runs that occur twice as a whole are repeated, and `compare` gets the different
    contents that share an anchor (id, v, start, n, at, anchor, times) and returns what this function returns.
    """
    anchors = runs.groupBy("anchor").agg(F.sum("times").alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    shared = stage(anchors.where("c > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("mixed")))
    near = stage(runs.join(shared.hint("merge"), "anchor"))
    content = stage(
        near.groupBy("anchor", "digest", "n", "mixed")
        .agg(F.sum("times").alias("times"), F.min(F.struct("id", "v", "start", "at")).alias("one"))
        .select("anchor", "digest", "n", "mixed", "times", "one.*")
    )
    whole = near.join(content.where("times > 1").select("anchor", "digest", "n").hint("merge"), ["anchor", "digest", "n"])
    mixed = content.where("mixed").select("id", "v", "start", "n", "at", "anchor", F.least("times", F.lit(2)).cast("int").alias("times"))
    return whole.select("id", "v", "start", "n").unionByName(compare(mixed))


def repeated_runs(docs: DataFrame, units: Callable, size: int, gram: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, v, start, n): runs of n windows, from window `start` on, that all occur somewhere else as well.

    `docs` as made by `documents`; `compare` as in `settle_runs`.
    """
    return settle_runs(stage(run_rows(docs, units, size, gram)).withColumn("times", F.lit(1)), compare)


BAND = 16


def band_rows(parts: DataFrame, units: Callable, size: int) -> DataFrame:
    """Runs cut into bands of `BAND` windows; `parts`: id, v, text, runs (start, n, at, times).

    A band is set by the offset of the anchor, so equal windows fall in the same band of their runs.  All windows of a band
    share a core of size - BAND + 1 tokens, whose hash stands in for the anchor: a far longer one, which few places share.
    """
    names = ["id", "v", "start", "n", "at", "anchor", "digest", "times"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            for i, text in row_texts(batch.column(2)):
                tokens, _ = units([text])
                rolling, out = PrimeRolling(tokens), []
                for r in runs[i].as_py():
                    place, low, high = r["start"] + r["at"], r["at"] - r["n"] + 1, r["at"]
                    for band in range(low // BAND, high // BAND + 1):
                        a, b = max(low, band * BAND), min(high, band * BAND + BAND - 1)
                        core = place - band * BAND
                        out.append((place - b, b - a + 1, core, core + size - BAND + 1, band, a, r["times"]))
                start, n, core, end, band, a, times = (np.array(c, dtype=np.int64) for c in zip(*out))
                anchor = mix(rolling.span(core, end) + band.astype(np.uint64))
                digest = mix(rolling.span(start, start + n - 1 + size) + (a * BAND + n).astype(np.uint64))
                same = [pa.array(np.full(len(out), batch.column(c)[i].as_py(), dtype=t)) for c, t in ((0, np.int64), (1, np.int64))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.zeros(len(out), dtype=np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(times.astype(np.int32))], names=names)

    return parts.select("id", "v", "text", "runs").mapInArrow(rows, RUNS + ", times int")


def settle_by_counting(docs: DataFrame, mixed: DataFrame, units: Callable, size: int) -> DataFrame:
    """Settle runs with crowded anchors by counts alone: bands first, and single windows where a band does not decide."""
    bands = stage(band_rows(with_text(docs, mixed.select("id", "v", "start", "n", "at", "times")), units, size))
    return settle_runs(bands, lambda rest: count_windows(with_text(docs, rest.select("id", "v", "start", "n", "times")), units, size))


def with_text(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, v, text, runs): the runs of a document beside its text, once for rows that repeat.

    Copies are cut to one a task before the shuffle that the join needs anyway.
    """
    lists = runs.groupBy("id", "v").agg(F.collect_set(F.struct(*[c for c in runs.columns if c not in ("id", "v")])).alias("runs"))
    return docs.groupBy("id", "v").agg(F.first("text").alias("text")).join(lists.hint("merge"), ["id", "v"])


def covered(docs: DataFrame, repeated: DataFrame, keep: Callable[[bytes, list], tuple], schema: str) -> DataFrame:
    """Apply `keep(text, runs)` to every document; its values follow the id."""
    lists = repeated.groupBy("id", "v").agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # rows that repeat bring the same runs
    joined = docs.join(lists.hint("merge"), ["id", "v"], "left").select("id", "v", "text", "runs")
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            for a, b, texts in text_slices(batch.column(2)):
                out = [keep(text, _pairs(runs[a + i])) for i, text in enumerate(texts)]
                columns = [batch.column(0).slice(a, b - a)]
                for j, name in enumerate(names):
                    columns.append(pa.array([x[j] for x in out], type=TYPES[name]))
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

    return joined.mapInArrow(rows, f"id bigint, {schema}")


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
TYPES = {"kept": pa.binary(), "spans": SPAN, "n_units": pa.int64(), "n_removed": pa.int64()}
SPAN_SCHEMA = "kept binary, spans array<struct<start:bigint,length:bigint>>, n_units bigint, n_removed bigint"


def _pairs(cell: pa.ListScalar) -> np.ndarray:
    if not cell.is_valid:
        return np.zeros((0, 2), dtype=np.int64)
    values = cell.values
    return np.stack([values.field(0).to_numpy(), values.field(1).to_numpy()], axis=1).astype(np.int64)


def removal(total: int, runs: np.ndarray, size: int) -> tuple[np.ndarray, list[dict]]:
    """Mask of removed tokens and their maximal intervals."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + size, -1)
    gone = np.cumsum(edge)[:total] > 0
    turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    first, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return gone, [{"start": int(a), "length": int(b - a)} for a, b in zip(first, end)]


__all__ = ["byte_units", "count_windows", "covered", "documents", "id_back", "removal", "repeated_runs", "settle_by_counting", "with_text", "word_units"]

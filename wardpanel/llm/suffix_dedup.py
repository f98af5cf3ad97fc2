"""Removal of byte strings that occur more than once, by sorting sampled suffixes in range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import documents, id_back, row_texts, stage
from wardpanel.llm.shared_runs import SPAN_SCHEMA, byte_units, covered, removal, repeated_runs, settle_by_counting, with_text

#: An anchor with more different runs than this is settled by counted window hashes, not in one bucket.
BUCKET_RUNS = 256
SORT_ROWS = 8192
#: No byte of UTF-8, so a short suffix never ties with a longer one.
PAD = b"\xff"


def sort_suffixes(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over 8-byte words: order, and common prefix of each row with the one before it (0 first).

    Only rows that still tie are looked at again, one word further on.
    """
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = words[order[1:], 0] == words[order[:-1], 0]
    for depth in range(1, words.shape[1]):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part = order[where]
        order[where] = part[np.lexsort((words[part, depth], np.cumsum(~same[where])))]
        word = words[order[where], depth]
        same[where[1:]] &= word[1:] == word[:-1]
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    prefix = np.minimum(prefix, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, np.concatenate([[0], prefix])


def compare_runs(left: list[bytes], right: list[bytes], n: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """Which windows of the runs occur again.

    A window with its anchor at offset d is the last d bytes of `left` (read backwards) and the first size - d bytes
    of `right`.  Sorted suffixes and their common prefixes give the class of both halves for each d; a window
    occurs again when another run has the same pair of classes.  Returns a (runs, offset) table of flags.
    """
    at = np.array([len(x) for x in left])
    matrices = []
    for strings, width in (([x[::-1] for x in left], -(-max(1, at.max()) // 8) * 8), (right, -(-size // 8) * 8)):
        lengths = np.array([min(len(x), width) for x in strings])
        flat = b"".join(x[:width].ljust(width, PAD) for x in strings)
        order, prefix = sort_suffixes(np.frombuffer(flat, dtype=np.uint8).reshape(len(strings), width), lengths)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        matrices.append((prefix, rank))
    (lp, lr), (rp, rr) = matrices
    again = np.zeros((len(left), int(at.max()) + 1), dtype=bool)
    for d in range(int((at - n + 1).min()), int(at.max()) + 1):
        own = np.flatnonzero((at - n + 1 <= d) & (d <= at))
        if not len(own):
            continue
        key = np.cumsum(rp < size - d)[rr[own]] * (len(left) + 1) + np.cumsum(lp < d)[lr[own]]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again[own, d] = (count[which] > 1) | (times[own] > 1)
    return again


def suffix_rows(parts: DataFrame, size: int, gram: int) -> DataFrame:
    """The sampled suffixes: leading bytes at the anchor, and the bytes on both sides that the run's windows reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, out = batch.column(3), []
            for i, text in row_texts(batch.column(2)):
                for r in runs[i].as_py():
                    p = r["start"] + r["at"]
                    right = text[p : r["start"] + r["n"] - 1 + size]
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), r["start"], r["n"], min(2, r["times"]), right[:gram], text[r["start"] : p], right))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["id", "v", "start", "n", "times", "lead", "left", "right"])

    return parts.mapInArrow(rows, "id bigint, v bigint, start int, n int, times int, lead binary, left binary, right binary")


def sort_buckets(suffixes: DataFrame, size: int) -> DataFrame:
    """Range-partition by leading bytes (Spark samples the splitters), sort each bucket, compare neighbours.

    Suffixes with equal leading bytes stay in one bucket, so no match crosses a splitter; inside a bucket
    a batch boundary never cuts a group, as the last group is carried on to the next batch.
    """
    names = ["id", "v", "start", "n"]

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        ids, v, start, n, times, _, left, right = zip(*rows)
        n, times, start = np.array(n), np.array(times), np.array(start)
        again = compare_runs(list(left), list(right), n, times, size)
        own, d = np.nonzero(again & (times == 1)[:, None])
        at = np.array([len(x) for x in left])
        where = start[own] + at[own] - d
        sort = np.lexsort((where, own))
        own, where = own[sort], where[sort]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(where) != 1)])) if len(own) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.concatenate([first, [len(own)]]))
        pick = own[first]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[pick]), pa.array(np.array(v, dtype=np.int64)[pick]), pa.array(where[first].astype(np.int32)), pa.array(count.astype(np.int32))], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) > SORT_ROWS:
                cut = SORT_ROWS
                while cut < len(held) and held[cut][5] == held[cut - 1][5]:
                    cut += 1
                if cut == len(held):
                    break
                yield settle(held[:cut])
                held = held[cut:]
        if held:
            yield settle(held)

    ordered = suffixes.repartitionByRange("lead").sortWithinPartitions("lead")
    return ordered.mapInArrow(rows, "id bigint, v bigint, start int, n int")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents, overlaps count, strings are judged on the input.
    Suffixes are sampled by content: every string of `length` bytes holds the smallest `gram`-byte hash of
    its own, so both copies of a string sample the same place.  Suffixes whose leading bytes are unique are
    dropped, equal ones are counted, the rest are range-partitioned by their leading bytes and sorted.
    Leading bytes with more than `BUCKET_RUNS` different suffixes (the border of a passage in very many
    documents) would fill one bucket; their strings are counted by hash in Spark instead, in bands of neighbours first.

    Returns one row per input row: `id_col`, `kept` (binary), `spans` (removed bytes), `n_units` (bytes), `n_removed`.
    Null text: empty.  Rows that repeat are copies of each other.  Short texts are kept.  Empty table: no rows.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must lie in 8..length")
    source = documents(docs, id_col, text_col)

    def compare(mixed: DataFrame) -> DataFrame:
        crowded = stage(mixed.groupBy("anchor").count().where(F.col("count") > BUCKET_RUNS).select("anchor", F.lit(True).alias("crowded")))
        marked = stage(mixed.join(crowded.hint("merge"), "anchor", "left"))
        few = marked.where("crowded IS NULL").drop("crowded", "anchor")
        many = marked.where("crowded").drop("crowded", "anchor")
        return sort_buckets(suffix_rows(with_text(source, few), length, gram), length).unionByName(settle_by_counting(source, many, byte_units, length))

    repeated = repeated_runs(source, byte_units, length, gram, compare)

    def keep(text: bytes, runs: np.ndarray) -> tuple:
        if not len(runs):
            return text, [], len(text), 0
        gone, spans = removal(len(text), runs, length)
        return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), spans, len(text), int(gone.sum())

    out = covered(source, repeated, keep, SPAN_SCHEMA)
    return out.select(id_back(out.id).alias(id_col), "kept", "spans", "n_units", "n_removed")

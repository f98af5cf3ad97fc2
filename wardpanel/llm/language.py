"""Language of texts by a convolutional network over bytes, trained in numpy on the driver and applied in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wardpanel.llm.common import text_slices

#: Bytes of a window, and how many of them the next window shares (so that no filter misses a border).
WINDOW, OVERLAP = 256, 8
#: Bounds of what the fit sees: windows in all, and windows of one text.
SAMPLE_WINDOWS, TEXT_WINDOWS = 12_000, 4
#: Most languages learned, the most frequent ones.
MOST_LANGUAGES = 200
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 5), 16
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 6, 800, 64, 0.004, 1e-4
PAD = 256
UNKNOWN = "und"
#: Windows scored at once (few: what one step makes stays in the cache), and windows gathered before.
SCORE_ROWS, HELD_ROWS = 8, 512


@dataclass
class Network:
    """Byte embedding, filters of several widths side by side, largest answer of each filter, softmax."""

    languages: list[str]
    table: np.ndarray  # (257, embedding): one row per byte, one for padding
    filters: np.ndarray  # (widest, embedding, all filters): narrower filters are zero beyond their width
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    training: bool = False

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Unscaled log scores of windows of byte numbers, one row each."""
        return self.pooled(windows)[0] @ self.out + self.bias

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled answers, the place each came from (in training only), and the unrolled input."""
        rows, length = windows.shape
        widest, size, total = self.filters.shape
        padded = np.concatenate([windows, np.full((rows, widest - 1), PAD, dtype=windows.dtype)], axis=1)
        embedded = self.table.take(padded.astype(np.intp), axis=0)
        unrolled = np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (rows, length, widest * size), (embedded.strides[0], embedded.strides[1], embedded.strides[2])))
        answers = (unrolled.reshape(rows * length, -1) @ self.filters.reshape(-1, total)).reshape(rows, length, total)
        if self.training:
            place = answers.argmax(axis=1)
            top = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0]
        else:
            place, top = np.zeros((0, 0), dtype=np.int64), largest(answers)
        return np.maximum(top + self.shift, 0), place, unrolled


def largest(answers: np.ndarray) -> np.ndarray:
    """Maximum over the second axis, by halving: large contiguous blocks are compared at once."""
    while answers.shape[1] > 1:
        half = -(-answers.shape[1] // 2)
        answers = np.maximum(answers[:, :half], answers[:, answers.shape[1] - half :])
    return answers[:, 0]


def filter_mask() -> np.ndarray:
    """Which weights exist: a filter of width w sees the first w bytes of each place."""
    mask = np.zeros((max(WIDTHS), EMBEDDING, FILTERS * len(WIDTHS)), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Train by Adam on cross-entropy; every language weighs the same.  Windows are shortened at random, so short texts are learned too."""
    rng = np.random.default_rng(seed)
    mask = filter_mask()
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages, normal(257, EMBEDDING, scale=0.5), normal(max(WIDTHS), EMBEDDING, total, scale=(2 / (max(WIDTHS) * EMBEDDING)) ** 0.5) * mask,
        np.zeros(total, dtype=np.float32), normal(total, len(languages), scale=total**-0.5), np.zeros(len(languages), dtype=np.float32), training=True,
    )
    net.table[PAD] = 0
    names = ("table", "filters", "shift", "out", "bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    share = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / (np.maximum(share, 1) * max(1, (share > 0).sum())))[labels].astype(np.float32)
    batches, step = -(-len(labels) // BATCH), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            x = windows[own].copy()
            keep = np.where(rng.random(len(own)) < 0.5, WINDOW, np.exp(rng.uniform(np.log(8), np.log(WINDOW), len(own)))).astype(np.int64)
            x[np.arange(WINDOW)[None, :] >= keep[:, None]] = PAD
            grads = gradients(net, x, labels[own], weight[own])
            grads["filters"] *= mask
            grads["table"][PAD] = 0
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for n in names:
                g = grads[n] + DECAY * getattr(net, n) * (n != "bias")
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    net.training = False
    return net


def gradients(net: Network, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted cross-entropy of one batch; only the places that won the pooling pass it on."""
    rows, length = x.shape
    widest, _, total = net.filters.shape
    pooled, place, unrolled = net.pooled(x)
    logits = pooled @ net.out + net.bias
    p = softmax(logits)
    p[np.arange(rows), labels] -= 1
    d_logits = (p * weight[:, None] / rows).astype(np.float32)
    d_pool = (d_logits @ net.out.T) * (pooled > 0)
    own = unrolled[np.arange(rows)[:, None], place]  # (rows, filters, widest * embedding)
    d_filters = np.einsum("rf,rfe->ef", d_pool, own, optimize=True).reshape(net.filters.shape)
    flat = net.filters.reshape(-1, total)
    d_seen = (d_pool[:, :, None] * flat.T[None]).reshape(rows, total, widest, EMBEDDING)
    at = place[:, :, None] + np.arange(widest)
    bytes_seen = np.where(at < length, np.take_along_axis(x[:, None, :], np.minimum(at, length - 1), axis=2), PAD)
    d_table = np.zeros_like(net.table)
    np.add.at(d_table, bytes_seen.reshape(-1), d_seen.reshape(-1, EMBEDDING))
    return {"table": d_table, "filters": d_filters, "shift": d_pool.sum(axis=0), "out": pooled.T @ d_logits, "bias": d_logits.sum(axis=0)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter (category L); bytes that are no UTF-8 are none."""
    return text.upper() != text.lower() or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def window_starts(size: int) -> np.ndarray:
    """First bytes of the windows that cover a text of `size` bytes."""
    return np.arange(0, max(1, size - OVERLAP), WINDOW - OVERLAP)


def window_rows(text: bytes, starts: np.ndarray) -> np.ndarray:
    flat = np.full(len(text) + WINDOW, PAD, dtype=np.int16)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return flat[starts[:, None] + np.arange(WINDOW)]


def predict(net: Network, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and score of each text: the mean of the log scores of its windows, by their bytes, as probabilities."""
    sums = np.zeros((len(texts), len(net.languages)))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    held, owners, held_rows = [], [], 0

    def settle() -> None:
        if held:
            windows, owner = np.concatenate(held), np.concatenate(owners)
            for a in range(0, len(windows), SCORE_ROWS):
                part = windows[a : a + SCORE_ROWS]
                weight = (part != PAD).sum(axis=1)
                np.add.at(sums, owner[a : a + SCORE_ROWS], net.scores(part) * weight[:, None])
            held.clear()
            owners.clear()

    spoken = [has_letter(t) for t in texts]
    for i, text in enumerate(texts):
        if not spoken[i]:
            continue
        starts = window_starts(len(text))
        for a in range(0, len(starts), HELD_ROWS):
            part = starts[a : a + HELD_ROWS]
            begin = int(part[0])
            held.append(window_rows(text[begin : int(part[-1]) + WINDOW], part - begin))
            owners.append(np.full(len(part), i))
            held_rows += len(part)
            if held_rows >= HELD_ROWS:
                settle()
                held_rows = 0
    settle()
    covered = np.array([(np.minimum(window_starts(n) + WINDOW, n) - window_starts(n)).sum() for n in sizes.tolist()])
    p = softmax(sums / np.maximum(covered, 1)[:, None])
    best = p.argmax(axis=1)
    return [(net.languages[b], float(row[b])) if s else (UNKNOWN, 0.0) for s, b, row in zip(spoken, best, p)]


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def sample_windows(docs: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(lang, window): up to `TEXT_WINDOWS` windows at places chosen by hash from the texts that a hash of the whole row picks.

    `docs`: lang, text.  `shares`: of each language, the share of its rows to take.
    """
    pick = F.lit(0.0)
    for lang, share in shares.items():
        pick = F.when(F.col("lang") == lang, share).otherwise(pick)
    chosen = docs.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < F.round(pick * 1_000_000))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = batch.column(0).to_pylist(), []
            for a, _, texts in text_slices(batch.column(1)):
                for i, text in enumerate(texts):
                    if has_letter(text):
                        starts = window_starts(len(text))
                        few = starts[np.random.default_rng(len(text)).permutation(len(starts))[:TEXT_WINDOWS]]
                        out += [(langs[a + i], text[s : s + WINDOW]) for s in few.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type=pa.string()), pa.array([o[1] for o in out], type=pa.binary())], names=["lang", "window"])

    return chosen.select("lang", "text").mapInArrow(rows, "lang string, window binary")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> Network | None:
    """Fit on windows of at most about `SAMPLE_WINDOWS` rows' worth of texts that are not held out, the same share of each language.

    Languages are counted over all rows; the `MOST_LANGUAGES` most frequent are learned.  Which rows are looked at is set by a hash
    of text and language, so equal rows are picked together; the sample is cut at twice `SAMPLE_WINDOWS` windows, by hash.  Rows with a null id,
    language or text are not learned from.  None if no row is left.  With one language the network always answers that one.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("id"), folds) != 0))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    each = SAMPLE_WINDOWS / TEXT_WINDOWS / len(counts)
    shares = {r["lang"]: min(1.0, each / r["count"]) for r in counts}
    found = sample_windows(rows, shares)
    picked = found.orderBy(F.xxhash64("window"), "window", "lang").limit(2 * SAMPLE_WINDOWS).collect()
    languages = sorted(shares)
    if not picked:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.full((len(picked), WINDOW), PAD, dtype=np.int16)
    for i, r in enumerate(picked):
        windows[i, : len(r["window"])] = np.frombuffer(r["window"], dtype=np.uint8)
    return fit(windows, np.array([number[r["lang"]] for r in picked]), languages)


def add_language(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """`docs` with the language of each whole text and its probability.

    A text is read in windows of `WINDOW` bytes that overlap by `OVERLAP`; their log scores are averaged.  A null text, one without a
    letter, and any text without a network get `und` and 0.  Every row is scored on its own; rows that repeat agree.  An empty table gives
    no rows.  Columns of the two names that are there already are replaced; all others are kept.
    """
    kept = docs.drop(lang_col, score_col)
    at, names = kept.columns.index(text_col), [*kept.columns, lang_col, score_col]
    model = kept.sparkSession.sparkContext.broadcast(net)  # some ten thousand weights
    schema = StructType([*kept.schema.fields, StructField(lang_col, StringType(), False), StructField(score_col, DoubleType(), False)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at).cast(pa.string())):
                found = predict(model.value, texts) if model.value else [(UNKNOWN, 0.0)] * len(texts)
                columns = [c.slice(a, b - a) for c in batch.columns] + [pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(rows, schema)

"""Quality classifier: a generalised additive model with pairwise interactions, scored by table lookups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wardpanel.llm.common import text_slices, word_spans, word_tokens

#: Most labelled rows that the fit looks at; which ones is decided by a hash of the id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES, RIDGE = 120, 0.15, 3, 4.0

FEATURES = (
    "log_words", "mean_word", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share", "bang_share", "space_share", "line_words",
    "distinct_words", "repeated_neighbours", "distinct_pairs", "distinct_lines", "short_words", "sentence_words", "other_letters",
)


def _class_table() -> np.ndarray:
    table = np.zeros((8, 256), dtype=np.float64)
    for row, codes in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b".,;:!?'\"()-", b"#$%&*@^~_=+<>[]{}\\/", b"|", b"!", b" \t\n\r", range(0x80, 0x100))):
        table[row, list(codes)] = 1
    return table


CLASSES = _class_table()


def _distinct_share(values: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values per text over values per text; 1 for a text without any."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.where(counts > 0, np.bincount(o[fresh], minlength=len(counts)) / np.maximum(counts, 1), 1.0)


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of `FEATURES` per text, from its bytes alone."""
    n = len(texts)
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    totals = np.maximum(sizes, 1)
    histogram = np.bincount(np.repeat(np.arange(n), sizes + 1) * 256 + flat, minlength=n * 256).reshape(n, 256).astype(np.float64)
    histogram[:, 0x0A] -= 1
    upper, digit, mark, symbol, bar, bang, space, other = (histogram @ CLASSES.T).T / totals

    first, end = word_spans(flat)
    words = word_tokens(flat, first, end)
    owner = np.searchsorted(edges, first, side="right") - 1
    counts = np.bincount(owner, minlength=n)
    some = np.maximum(counts, 1)
    length = (end - first).astype(np.float64)
    pair = words[:-1] * np.uint64(31) + words[1:] if len(words) else words
    inside = owner[:-1] == owner[1:] if len(words) else np.zeros(0, dtype=bool)
    pair_counts = np.bincount(owner[:-1][inside], minlength=n) if len(words) else counts
    twin = np.bincount(owner[:-1][inside & (words[:-1] == words[1:])], minlength=n) if len(words) else counts
    stops = np.isin(flat[end - 1], list(b".!?")) if len(words) else inside

    breaks = np.flatnonzero(flat == 0x0A)
    line_first = np.concatenate([[0], breaks[:-1] + 1])
    full = breaks > line_first
    lines = word_tokens(flat, line_first[full], breaks[full])
    line_owner = np.searchsorted(edges, line_first[full], side="right") - 1
    line_counts = np.bincount(line_owner, minlength=n)
    return np.stack(
        [
            np.log1p(counts), np.bincount(owner, length, n) / some, upper, digit, mark, symbol, bar, bang, space, np.log1p(counts / np.maximum(line_counts, 1)),
            _distinct_share(words, owner, counts), twin / some, _distinct_share(pair[inside], owner[:-1][inside], pair_counts) if len(words) else np.ones(n),
            _distinct_share(lines, line_owner, line_counts), np.bincount(owner, length <= 3, n) / some, np.log1p(counts / (1 + np.bincount(owner[stops], minlength=n))), other,
        ],
        axis=1,
    )


@dataclass
class Model:
    """A score is `base` plus one table entry per feature and one per chosen pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges behind the values at even quantiles, midway to the next value."""
    values = np.unique(x)
    at = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[:-1], method="lower")))
    at = at[at < len(values) - 1]
    return (values[at] + values[at + 1]) / 2


def _value(gradient, hessian):
    return gradient / (hessian + RIDGE)


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first tree over ordered bins: the step for each bin."""
    parts, out = [(0, len(gradient))], np.zeros(len(gradient))
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = gain_of(a, cut) + gain_of(cut, b) - gain_of(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (a, b), int(cut[i]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in parts:
        out[a:b] = _value(g[b] - g[a], h[b] - h[a])
    return out


def _grid_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """Best split of a grid into four quadrants: gain and the step for each cell."""
    pad = lambda t: np.pad(np.cumsum(np.cumsum(t, 0), 1), ((1, 0), (1, 0)))
    g, h = pad(gradient), pad(hessian)
    best, out = 0.0, np.zeros_like(gradient)
    n, m = gradient.shape
    whole = g[n, m] ** 2 / (h[n, m] + RIDGE)
    for i in range(1, n):
        for j in range(1, m):
            block = lambda t: (t[i, j], t[i, m] - t[i, j], t[n, j] - t[i, j], t[n, m] - t[i, m] - t[n, j] + t[i, j])
            gain = sum(a * a / (b + RIDGE) for a, b in zip(block(g), block(h))) - whole
            if gain > best:
                steps = [_value(a, b) for a, b in zip(block(g), block(h))]
                best, out = gain, np.zeros_like(gradient)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = steps
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round gives every feature one small tree; after half of the rounds the best pairs join in.

    Without rows of both labels every score is the share of label 1 (one half without rows).
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(base=float(np.log(share / (1 - share))))
    share = y.mean()
    model = Model(base=float(np.log(share / (1 - share))), edges=[_edges(c, BINS) for c in x.T], coarse=[_edges(c, PAIR_BINS) for c in x.T])
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    def main_cycle():
        nonlocal logit
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
            model.tables[j] += step
            logit = logit + step[b]

    for _ in range(ROUNDS // 2):
        main_cycle()

    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        n, m = shape(a, b)
        return np.bincount(coarse[a] * m + coarse[b], values, n * m).reshape(n, m)

    g, h = slopes()
    gains = sorted(((_grid_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(bins)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for i in range(ROUNDS // 2):
        main_cycle()
        for table, (a, b) in zip(model.pair_tables, model.pairs) if i % 4 == 0 else ():
            g, h = slopes()
            step = RATE * _grid_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            logit = logit + step[coarse[a], coarse[b]]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        parts = [text_features(texts) for _, _, texts in text_slices(batch.column(at))]
        yield batch, np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def held_out(id_col: Column) -> Column:
    """Whether a row is kept out of the fit: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents that are not held out.

    The sample is taken by hash of the id from the labels, so it is the same for any layout of the table, and its bound
    makes it safe to send to all tasks and to bring its features (17 numbers a row) to the driver.
    Ids with several labels take their mean, rows that repeat an id count once.
    """
    rows = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    means = rows.groupBy(labels[id_col].cast("bigint").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sample = means.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _feature_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), type=pa.list_(pa.float64()))], names=["id", "label", "x"])

    found = texts.select("id", "text", "label").mapInArrow(features, "id bigint, label int, x array<double>")
    found = found.groupBy("id").agg(F.min(F.struct("x", "label")).alias("r")).select("r.x", "r.label", "id").orderBy("id").collect()
    return fit(np.array([r["x"] for r in found], dtype=np.float64).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found], dtype=np.float64))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and `score_col`: how likely label 1 is, from the text alone.

    Null text: as empty; an empty text gets the score of its features (no words) like any other.  Rows are independent,
    none is moved; an empty table gives none.
    """
    at, names = docs.columns.index(text_col), docs.columns
    fields = [*docs.schema.fields, StructField(score_col, DoubleType(), True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _feature_batches(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), type=pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(rows, StructType(fields))

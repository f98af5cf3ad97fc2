"""Boosted trees grown leaf by leaf on histograms that Spark adds up.

Features are cut into at most 255 bins, bin 0 for missing values.  A task adds the gradients of its rows into one histogram per
(tree, node, feature); the histograms of all tasks meet in a shuffle, and only the best split of each comes to the driver: at most
leaves x features x classes rows at a time.  The leaf with the largest gain is split first.  Its children are needed before the
next choice, so a pass over the rows also prepares the children of the other leaves that can still be split: a tree takes about as
many passes as it is deep, and is the same as if grown one split at a time.  Gradients are added as whole numbers of a fixed unit,
so a model does not depend on the partitioning of the rows.  The state of the rows is kept in blocks of arrays, feature after feature,
and the leaf of a row is found by bit sets, one look-up per feature, so a pass makes no object per row and follows no branches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wardpanel.session import cut_lineage

BINS = 256
MAX_CLASSES = 200
#: Gradients are whole multiples of 1 / UNIT of the largest one at the start.
UNIT = float(1 << 24)
#: Scores of the rows are written again after this many rounds; the trees since then are applied while reading.
KEEP_ROUNDS = 10
#: Rows of a block of the state.
BLOCK_ROWS = 1 << 16


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1.  `value` is the step of a leaf, learning rate included."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, missing_left: bool) -> tuple[int, int]:
        pair = len(self.feature), len(self.feature) + 1
        for column, none in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([none, none])
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin, missing_left
        self.left[node], self.right[node] = pair
        return pair

    def bit_sets(self) -> tuple[list[int], dict[int, np.ndarray]]:
        """The leaves from left to right, and per feature and bin the set of the leaves (bits) that a row with this bin can reach."""
        ends: list[int] = []
        sets: dict[int, np.ndarray] = {}

        def below(node: int) -> int:
            f = self.feature[node]
            if f < 0:
                ends.append(node)
                return 1 << (len(ends) - 1)
            left, right = below(self.left[node]), below(self.right[node])
            to_left = np.arange(BINS) <= self.bin[node]
            to_left[0] = self.missing_left[node]
            sets[f] = sets.get(f, np.full(BINS, (1 << 64) - 1, dtype=np.uint64)) & ~np.where(to_left, np.uint64(right), np.uint64(left))
            return left | right

        below(0)
        return ends, sets

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row: the only one that no split on the row's bins rules out."""
        if self.feature.count(-1) > 64:
            return self.walk(bins)
        ends, sets = self.bit_sets()
        if len(ends) == 1:
            return np.zeros(len(bins), dtype=np.int64)
        left = None
        for f, reach in sets.items():
            part = reach.take(bins[:, f])
            left = part if left is None else np.bitwise_and(left, part, out=left)
        if len(ends) < 64:
            left &= np.uint64((1 << len(ends)) - 1)
        return np.array(ends)[np.bitwise_count(left - np.uint64(1))]

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """As `leaves`, from split to split; for trees of any size."""
        feature, cut, lost = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = bins[rows, np.maximum(f, 0)]
            to_left = np.where(b == 0, lost[at], b <= cut[at])
            at = np.where(inner, np.where(to_left, left[at], right[at]), at)


@dataclass
class BoostedModel:
    """`trees` holds one list per round, with one tree for each score."""

    kind: str
    features: list[str]
    edges: list[np.ndarray]
    classes: list
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def bin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for i, edges in enumerate(self.edges):
            out[:, i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(edges, x[:, i], side="left") + 1)
        return out

    def raw(self, bins: np.ndarray, rounds: Sequence[Sequence[Tree]] | None = None, start: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for trees in self.trees if rounds is None else rounds:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.leaves(bins)]
        return out

    def answer(self, raw: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or the predicted value alone."""
        if self.kind == "regression":
            return raw
        if self.kind == "binary":
            p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
            return np.hstack([1 - p, p])
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep` and `prob` (by class, in sorted order) and `pred` (the likeliest class), or `signal` for a regression."""
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(dtype=np.float64)
            return pd.Series(list(model.answer(model.raw(model.bin(x)))), dtype=object)

        out = df.select(*keep, score(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])).alias("__p"))
        if self.kind == "regression":
            return out.select(*keep, F.get("__p", 0).alias("signal"))
        names = F.array(*[F.lit(c) for c in self.classes])
        likeliest = F.get(names, (F.array_position("__p", F.array_max("__p")) - 1).cast("int"))
        return out.select(*keep, F.col("__p").alias("prob"), likeliest.alias("pred"))


def _gradients(kind: str, raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and curvature per score, and the weighted loss, of each row."""
    w = w[:, None]
    if kind == "regression":
        d = raw - y[:, None]
        return d * w, np.broadcast_to(w, d.shape), (d * d * w)[:, 0] / 2
    if kind == "binary":
        p, t = 1 / (1 + np.exp(-np.clip(raw, -700, 700))), y[:, None]
        return (p - t) * w, p * (1 - p) * w, ((np.logaddexp(0, raw) - t * raw) * w)[:, 0]
    top = raw.max(axis=1, keepdims=True)
    e = np.exp(raw - top)
    p, t = e / e.sum(axis=1, keepdims=True), y[:, None] == np.arange(raw.shape[1])
    loss = np.log(e.sum(axis=1)) + top[:, 0] - raw[np.arange(len(y)), y.astype(int)]
    return (p - t) * w, p * (1 - p) * w, loss * w[:, 0]


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, penalty: float) -> tuple | None:
    """(gain, bin, missing left, left sums, right sums) of one histogram; the smallest bin of equal gains."""
    total, best = (g.sum(), h.sum(), n.sum()), None
    worth = lambda a, b: a * a / np.maximum(b + penalty, 1e-12)
    for lost in (False, True) if n[0] else (False,):
        gl, hl, nl = (np.cumsum(v[1:]) + (v[0] if lost else 0) for v in (g, h, n))
        gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
        allowed = (nl >= least) & (nr >= least) & (hl >= 1e-3) & (hr >= 1e-3)
        gain = np.where(allowed, worth(gl, hl) + worth(gr, hr) - worth(total[0], total[1]), -np.inf)
        i = int(gain.argmax())
        if gain[i] > 1e-7 and (best is None or gain[i] > best[0]):
            to_left = lost if n[0] else bool(nl[i] >= nr[i])
            best = float(gain[i]), i + 1, to_left, (float(gl[i]), float(hl[i]), int(nl[i])), (float(gr[i]), float(hr[i]), int(nr[i]))
    return best


#: A block of rows: bins of one feature after the other, targets, weights, marks of the held-out rows, and the scores row after row.
STATE = "b binary, y binary, w binary, v binary, f binary"


def _arrays(block, width: int, scores: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(block.b, dtype=np.uint8).reshape(width, -1).T
    return bins, np.frombuffer(block.y), np.frombuffer(block.w), np.frombuffer(block.v, dtype=bool), np.frombuffer(block.f).reshape(-1, scores)


SPLITS = "tree int, node int, feature int, gain double, bin int, missing_left boolean, left array<double>, right array<double>, total array<double>"


def _pass(state: DataFrame, model: BoostedModel, pending: list[list[Tree]], trees: list[Tree], wanted: list[tuple[int, int]], units: tuple[float, float], least: int, penalty: float) -> list:
    """Best split of each wanted (tree, node) and feature; a row with tree -1 holds the held-out loss, its weight and count."""
    kind, width, scores = model.kind, len(model.features), len(model.base)
    slot = {k: {node: i for i, node in enumerate(sorted(n for t, n in wanted if t == k))} for k in range(scores)}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((len(nodes), width, 3, BINS), dtype=np.int64) for k, nodes in slot.items() if nodes}
        held = np.zeros(3, dtype=np.int64)
        for frame in batches:
            for block in frame.itertuples(index=False):
                bins, y, w, out, raw = _arrays(block, width, scores)
                raw = model.raw(bins, pending, raw)
                g, h, loss = _gradients(kind, raw, y, w)
                held += np.array([np.rint(loss[out] * UNIT).sum(), np.rint(w[out] * UNIT).sum(), out.sum()], dtype=np.int64)
                learn = ~out
                for k, total in sums.items():
                    place = np.full(len(trees[k].feature), -1)
                    for node, i in slot[k].items():
                        place[node] = i
                    at = place[trees[k].leaves(bins)]
                    used = np.flatnonzero(learn & (at >= 0))
                    first = at[used] * BINS
                    parts = np.rint(g[used, k] / units[0]), np.rint(h[used, k] / units[1]), None
                    for f in range(width):
                        cell = first + bins[:, f].take(used)
                        for j, part in enumerate(parts):
                            total[:, f, j] += np.bincount(cell, part, minlength=len(slot[k]) * BINS).astype(np.int64).reshape(-1, BINS)
        rows = [(k, node, f, total[i, f].tobytes()) for k, total in sums.items() for node, i in slot[k].items() for f in range(width)]
        yield pd.DataFrame([*rows, (-1, 0, 0, held.tobytes())], columns=["tree", "node", "feature", "sums"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for *key, sums in frame.itertuples(index=False):
                part = np.frombuffer(sums, dtype=np.int64)
                whole[tuple(key)] = whole[tuple(key)] + part if tuple(key) in whole else part
        rows = []
        for key, sums in whole.items():
            if key[0] < 0:
                best, total = None, sums.astype(np.float64) / [UNIT, UNIT, 1]
            else:
                g, h, n = sums.reshape(3, BINS)
                g, h = g * units[0], h * units[1]
                best, total = _best_split(g, h, n, least, penalty), np.array([g.sum(), h.sum(), n.sum()])
            rows.append((*key, *(best or (None, None, None, None, None)), total))
        yield pd.DataFrame(rows, columns=["tree", "node", "feature", "gain", "bin", "missing_left", "left", "right", "total"])

    packed = state.mapInPandas(add, "tree int, node int, feature int, sums binary")
    return packed.repartition("tree", "node", "feature").mapInPandas(choose, SPLITS).collect()


class _Growth:
    """One tree on the driver: known splits and the order in which leaves are taken."""

    def __init__(self, leaves: int, least: int):
        self.tree, self.leaves, self.least = Tree(), leaves, least
        self.best, self.stats, self.children = {}, {}, {}

    def learn(self, rows: list) -> None:
        for r in rows:
            self.stats.setdefault(r["node"], tuple(r["total"]))
            known = self.best.setdefault(r["node"], None)
            if r["gain"] is not None and (known is None or (-r["gain"], r["feature"]) < (-known["gain"], known["feature"])):
                self.best[r["node"]] = r

    def _open(self, node: int) -> None:
        r = self.best[node]
        pair = self.tree.split(node, r["feature"], r["bin"], r["missing_left"])
        self.children[node] = pair
        for child, stats in zip(pair, (r["left"], r["right"])):
            self.stats[child] = tuple(stats)
            if stats[2] < 2 * self.least:
                self.best[child] = None

    def advance(self) -> tuple[list[int], list[int]]:
        """Leaves taken so far in order of gain, and the nodes whose splits must be known to go on (none when grown)."""
        if 0 not in self.best:
            return [0], [0]
        front, inner = [0], []
        while len(front) < self.leaves:
            ready = sorted((n for n in front if self.best[n] is not None), key=lambda n: (-self.best[n]["gain"], n))
            if not ready:
                break
            for n in ready[: self.leaves - len(front)]:
                if n not in self.children:
                    self._open(n)
            pair = self.children[ready[0]]
            if len(front) + 1 < self.leaves and any(c not in self.best for c in pair):
                unknown = [c for n in ready[: self.leaves - len(front)] for c in self.children[n] if c not in self.best]
                return front, unknown
            inner.append(ready[0])
            front = [n for n in front if n != ready[0]] + list(pair)
        self.inner = inner
        return front, []

    def finish(self, rate: float, penalty: float, names: Sequence[str], gains: dict[str, float]) -> Tree:
        """The tree without the nodes that were only prepared."""
        out, place = Tree(), {0: 0}
        for n in self.inner:
            r = self.best[n]
            place.update(zip(self.children[n], out.split(place[n], r["feature"], r["bin"], r["missing_left"])))
            gains[names[r["feature"]]] = gains.get(names[r["feature"]], 0.0) + r["gain"]
        for n, at in place.items():
            if out.feature[at] < 0:
                g, h, _ = self.stats[n]
                out.value[at] = -rate * g / max(h + penalty, 1e-12)
        return out


def fit_trees(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "classes", rounds: int = 120, rate: float = 0.05, leaves: int = 31,
    least: int = 20, penalty: float = 0.0, held_out: int = 10, patience: int = 10, tolerance: float = 1e-7, balance: bool = True,
) -> BoostedModel:
    """Boosted trees; `kind` is "classes" (two or more, one model for all) or "regression".

    Rows without a label take no part; missing features go to the side that gains more.  One row in `held_out`, by hash of its values,
    only measures the loss; growth ends when none of the last `patience` rounds lowered it by `tolerance` (`held_out` 0: never).
    `balance` weighs classes alike.  Fewer than two classes, or no rows, are an error.
    """
    features = list(features)
    rows = train.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).alias("y"))
    probs = [i / 255 for i in range(1, 255)]
    finite = lambda i: F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))
    marks = rows.agg(*[F.percentile_approx(finite(i), probs, F.lit(10_000)).alias(f"e{i}") for i in range(len(features))]).first()
    edges = [np.unique(np.array(m if m is not None else [0.0], dtype=np.float64)) for m in marks]
    chosen = F.pmod(F.xxhash64(*[f"x{i}" for i in range(len(features))], "y"), F.lit(max(held_out, 1))) == 0
    out = chosen if held_out else F.lit(False)
    if kind == "regression":
        sums = rows.agg(F.avg(F.col("y").cast("double")).alias("m"), F.min(F.col("y").cast("double")).alias("a"), F.max(F.col("y").cast("double")).alias("b")).first()
        if sums["m"] is None:
            raise ValueError("no row has a label")
        classes, weights, base = [], {}, np.array([sums["m"]])
        top = max(abs(sums["a"] - sums["m"]), abs(sums["b"] - sums["m"]), 1e-12), 1.0
        target, weight = F.col("y").cast("double"), F.lit(1.0)
    else:
        sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
        if not 2 <= len(sizes) <= MAX_CLASSES:
            raise ValueError(f"a label needs 2 to {MAX_CLASSES} values, found {len(sizes)}")
        count = {r["y"]: r["n"] for r in sizes}
        classes, total = sorted(count), sum(count.values())
        weights = [total / (len(classes) * count[c]) if balance else 1.0 for c in classes]
        share = np.array([w * count[c] for w, c in zip(weights, classes)]) / total
        base = np.log(share) if len(classes) > 2 else np.array([np.log(share[1] / share[0])])
        kind, top = ("multi" if len(classes) > 2 else "binary"), (max(weights), max(weights))
        target = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("double") - 1
        weight = F.get(F.array(*[F.lit(w) for w in weights]), target.cast("int"))
    model = BoostedModel(kind, features, edges, classes, base)
    units, width = (top[0] / UNIT, top[1] / UNIT), len(features)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pd.DataFrame:
            bins, y, w, v = (np.concatenate(part) for part in zip(*held))
            held.clear()
            start = np.tile(base.astype(np.float64), (len(y), 1))
            return pd.DataFrame({"b": [np.ascontiguousarray(bins.T).tobytes()], "y": [y.tobytes()], "w": [w.tobytes()], "v": [v.tobytes()], "f": [start.tobytes()]})

        for frame in batches:
            if len(frame):
                x = frame[[f"x{i}" for i in range(width)]].to_numpy(dtype=np.float64)
                held.append((model.bin(x), frame["t"].to_numpy(dtype=np.float64), frame["w"].to_numpy(dtype=np.float64), frame["v"].to_numpy(dtype=bool)))
                if sum(len(part[1]) for part in held) >= BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    state = cut_lineage(rows.select(*[f"x{i}" for i in range(width)], target.alias("t"), weight.alias("w"), out.alias("v")).mapInPandas(binned, STATE))
    pending: list[list[Tree]] = []
    while len(model.trees) < rounds:
        growing = [_Growth(leaves, least) for _ in base]
        while True:
            wanted = [(k, n) for k, g in enumerate(growing) for n in g.advance()[1]]
            if not wanted:
                break
            found = _pass(state, model, pending, [g.tree for g in growing], wanted, units, least, penalty)
            for k, g in enumerate(growing):
                g.learn([r for r in found if r["tree"] == k])
            if len(model.losses) == len(model.trees):
                loss = next((r["total"] for r in found if r["tree"] < 0), [0, 0, 0])
                model.losses.append(loss[0] / loss[1] if loss[1] else 0.0)
                if loss[2] and len(model.losses) > patience and min(model.losses[-patience:]) > model.losses[-patience - 1] - tolerance:
                    return model
        if not any(g.inner for g in growing):
            return model
        made = [g.finish(rate, penalty, features, model.gains) for g in growing]
        model.trees.append(made)
        pending.append(made)
        if len(pending) == KEEP_ROUNDS and len(model.trees) < rounds:
            state = cut_lineage(state.mapInPandas(_rescore(model, list(pending)), STATE))
            pending = []
    return model


def _rescore(model: BoostedModel, rounds: list[list[Tree]]):
    """Function that adds the steps of `rounds` to the scores of the rows."""
    width, scores = len(model.features), len(model.base)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            blocks = (_arrays(block, width, scores) for block in frame.itertuples(index=False))
            yield frame.assign(f=[model.raw(bins, rounds, raw).tobytes() for bins, _, _, _, raw in blocks])

    return step

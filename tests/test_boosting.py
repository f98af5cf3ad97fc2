"""Boosted trees against a plain leaf-wise version in numpy, grown one split at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.operators import boosting as bo


def table(spark, kind, n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(0, 1, n).round(2), rng.integers(0, 7, n), rng.exponential(2, n).round(1)], axis=1).astype(float)
    x[rng.random(n) < 0.1, 0] = np.nan
    push = np.nan_to_num(x[:, 0], nan=1.5) * 2 + (x[:, 1] > 3) * 1.5 - x[:, 2] * np.where(x[:, 1] > 3, 0.2, 0.9) + rng.normal(0, 0.7, n)
    y = push if kind == "regression" else np.digitize(push, [-0.5] if kind == "binary" else [-1.5, 0.8])
    kept = [tuple(None if np.isnan(v) else float(v) for v in r) + (float(t) if kind == "regression" else int(t),) for r, t in zip(x, y)]
    return x, np.asarray(y, dtype=float), spark.createDataFrame(kept, f"a double, b double, c double, y {'double' if kind == 'regression' else 'int'}")


def plain_split(x, g, h, edges, least):
    best = None
    for f, e in enumerate(edges):
        lost = np.isnan(x[:, f])
        for cut in e:
            below = ~lost & (x[:, f] <= cut)
            for missing_left in (False, True) if lost.any() else (False,):
                left = below | lost if missing_left else below
                if min(left.sum(), (~left).sum()) < least:
                    continue
                part = lambda m: g[m].sum() ** 2 / h[m].sum()
                if min(h[left].sum(), h[~left].sum()) < 1e-3:
                    continue
                gain = part(left) + part(~left) - g.sum() ** 2 / h.sum()
                if gain > 1e-7 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, left)
    return best


def plain_fit(x, y, weight, kind, base, edges, rounds, rate, leaves, least):
    classes = len(base)
    raw = np.tile(base, (len(x), 1)).astype(float)
    for _ in range(rounds):
        if kind == "regression":
            grad, hess = (raw[:, 0] - y)[:, None], np.ones((len(y), 1))
        elif kind == "binary":
            p = 1 / (1 + np.exp(-raw))
            grad, hess = (p - y[:, None]) * weight[:, None], p * (1 - p) * weight[:, None]
        else:
            p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
            grad, hess = (p - (y[:, None] == np.arange(classes))) * weight[:, None], p * (1 - p) * weight[:, None]
        step = np.zeros_like(raw)
        for k in range(classes):
            g, h = grad[:, k], hess[:, k]
            front = [np.arange(len(x))]
            cuts = [plain_split(x, g, h, edges, least)]
            while len(front) < leaves and any(c is not None for c in cuts):
                i = max(range(len(front)), key=lambda j: -np.inf if cuts[j] is None else cuts[j][0])
                rows, (_, left) = front.pop(i), cuts.pop(i)
                for side in (rows[left], rows[~left]):
                    front.append(side)
                    cuts.append(plain_split(x[side], g[side], h[side], edges, least))
            for rows in front:
                step[rows, k] = -rate * g[rows].sum() / h[rows].sum()
        raw += step
    return raw


@pytest.mark.parametrize("kind", ["binary", "multi", "regression"])
def test_equals_the_plain_version(spark, kind):
    x, y, df = table(spark, kind)
    model = bo.fit_trees(df.repartition(5), ["a", "b", "c"], "y", "regression" if kind == "regression" else "classes", rounds=3, rate=0.3, leaves=6, held_out=0)
    count = {c: (y == c).sum() for c in np.unique(y)}
    weight = np.array([len(y) / (len(count) * count[v]) for v in y]) if kind != "regression" else np.ones(len(y))
    want = plain_fit(x, y, weight, kind, model.base, model.edges, 3, 0.3, 6, 20)
    got = model.raw(model.bin(x))
    assert len(model.trees) == 3 and max(len(t.feature) for r in model.trees for t in r) == 11
    np.testing.assert_allclose(got, want, atol=2e-5)


def test_same_model_for_any_partitioning_and_early_end(spark):
    x, _, df = table(spark, "binary", 600, 4)
    noise = df.withColumn("y", F.pmod(F.xxhash64("a", "b", "c"), F.lit(2)).cast("int"))
    one, two = (bo.fit_trees(d, ["a", "b", "c"], "y", rounds=25, rate=0.3, patience=3) for d in (noise.coalesce(1), noise.repartition(6)))
    assert len(one.trees) < 25 and one.losses == two.losses
    np.testing.assert_array_equal(one.raw(one.bin(x)), two.raw(two.bin(x)))


def test_scores_classes_and_missing_values(spark):
    _, _, df = table(spark, "multi", 900, 2)
    named = df.withColumn("y", F.get(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), F.col("y")))
    model = bo.fit_trees(named.unionByName(named.limit(5).withColumn("y", F.lit(None).cast("string"))), ["a", "b", "c"], "y", rounds=12, rate=0.3, leaves=8)
    rows = model.transform(named, ["y"]).collect()
    assert model.classes == ["low", "mid", "top"] and set(model.gains) == {"a", "b", "c"}
    assert np.mean([r["y"] == r["pred"] for r in rows]) > 0.8
    assert all(abs(sum(r["prob"]) - 1) < 1e-9 for r in rows)
    empty = spark.createDataFrame([(None, None, None, "x")], "a double, b double, c double, y string")
    assert len(model.transform(empty, ["y"]).first()["prob"]) == 3
    with pytest.raises(ValueError):
        bo.fit_trees(named.where("y = 'low'"), ["a"], "y")
    with pytest.raises(ValueError):
        bo.fit_trees(df.limit(0), ["a"], "y", "regression")


def test_leaves_by_bit_sets_are_those_of_the_walk():
    rng = np.random.default_rng(3)
    for splits in (0, 1, 30, 63, 90):
        tree = bo.Tree()
        for _ in range(splits):
            ends = [n for n, f in enumerate(tree.feature) if f < 0]
            tree.split(int(rng.choice(ends)), int(rng.integers(4)), int(rng.integers(1, 256)), bool(rng.integers(2)))
        bins = rng.integers(0, 256, (5_000, 4)).astype(np.uint8)
        np.testing.assert_array_equal(tree.leaves(bins), tree.walk(bins))


def test_state_is_kept_in_blocks(spark, monkeypatch):
    _, _, df = table(spark, "multi", 900, 5)
    sizes, cut = [], bo.cut_lineage
    monkeypatch.setattr(bo, "cut_lineage", lambda d: sizes.append((out := cut(d)).count()) or out)
    one = bo.fit_trees(df.repartition(3), ["a", "b", "c"], "y", rounds=12, leaves=6)
    assert sizes == [3, 3]
    monkeypatch.setattr(bo, "BLOCK_ROWS", 1)
    two = bo.fit_trees(df.repartition(7), ["a", "b", "c"], "y", rounds=12, leaves=6)
    assert one.losses == two.losses and one.trees == two.trees

"""Conformal thresholds and probability calibration on probability tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardpanel.operators.blocks import kernel_density
from wardpanel.operators.neighbours import nearest
from wardpanel.operators.metrics import argmax
from wardpanel.operators.order import positions, running_totals
from wardpanel.session import cut_lineage

INF = float("inf")


def true_probability(y: str = "y", probs: str = "prob") -> Column:
    return F.get(probs, F.col(y).cast("int"))


def conformal_threshold(cal: DataFrame, alpha: float, by: Sequence[str] = (), key: str = "sample_id", score: Column | None = None) -> DataFrame:
    """The ceil((1 - alpha)(n + 1))-th smallest score (1 - true probability) per group, +inf when there are too few."""
    by = list(by)
    scored = cal.select(*by, key, (score if score is not None else 1 - true_probability()).alias("s"))
    ranked = positions(scored, ["s", key], by, "pos")
    sizes = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else scored.agg(F.count(F.lit(1)).alias("n"))
    spot = F.ceil((1 - alpha) * (F.col("n") + 1)) - 1
    if by:
        hit = ranked.join(sizes, by).where(F.col("pos") == spot).select(*by, "s")
        return sizes.join(hit, by, "left").select(*by, F.coalesce("s", F.lit(INF)).alias("threshold"))
    wanted = sizes.select(spot.alias("spot")).scalar()
    return ranked.where(F.col("pos") == wanted).agg(F.coalesce(F.max("s"), F.lit(INF)).alias("threshold"))


def apply_threshold(df: DataFrame, thresholds: DataFrame, on: Sequence[str] = (), probs: str = "prob") -> DataFrame:
    """predset: classes whose 1 - probability is within the threshold."""
    if on:
        joined = df.join(thresholds, list(on), "left")
    else:
        joined = df.withColumn("threshold", thresholds.select("threshold").scalar())
    return joined.withColumn("predset", F.transform(probs, lambda p: (1 - p) <= F.col("threshold"))).drop("threshold")


def apply_class_thresholds(df: DataFrame, thresholds: DataFrame, classes: int, label: str = "y", probs: str = "prob") -> DataFrame:
    """predset with one threshold per class (a class without one accepts everything).  The threshold table has one row per class."""
    packed = thresholds.agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("int"), "threshold"))).alias("t"))
    limit = lambda i: F.coalesce(F.try_element_at("__t", i), F.lit(INF))
    joined = df.withColumn("__t", packed.scalar())
    return joined.withColumn("predset", F.transform(probs, lambda p, i: (1 - p) <= limit(i))).drop("__t")


def weighted_quantile(rows: DataFrame, alpha: float, by: Sequence[str], score: str, weight: str, key: str) -> DataFrame:
    """First score, in order, whose share of the running weight reaches alpha (the last score if none does)."""
    by = list(by)
    run = running_totals(rows.select(*by, key, score, weight), [score, key], {"__w": F.col(weight)}, by)
    total = rows.groupBy(*by).agg(F.sum(weight).alias("__t"), F.max(score).alias("__last")) if by else rows.agg(F.sum(weight).alias("__t"), F.max(score).alias("__last"))
    if by:
        joined = run.join(total, by)
    else:
        joined = run.withColumns({"__t": total.select("__t").scalar(), "__last": total.select("__last").scalar()})
    share = F.try_divide(F.col("__w") + F.col(weight), F.col("__t"))
    first = F.min(F.when(share >= alpha, F.col(score)))
    picked = F.when(F.max("__t") <= 0, F.lit(-INF)).otherwise(F.coalesce(first, F.max("__last"))).alias("threshold")
    return joined.groupBy(*by).agg(picked) if by else joined.agg(picked)


def scott_bandwidth(df: DataFrame, vector: str = "vector") -> float:
    """n^(-1 / (features + 4))."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    return float(row["n"]) ** (-1.0 / (row["d"] + 4))


def covariate_weights(cal: DataFrame, test: DataFrame) -> DataFrame:
    """(id, weight): density of the test vectors over density of the calibration vectors at each calibration point.

    cal: id, vector; test: id, vector.
    """
    as_ref = lambda d: d.select(F.col("id").alias("ref_id"), "vector")
    under_cal = kernel_density(cal, as_ref(cal), scott_bandwidth(cal)).withColumnRenamed("density", "c")
    under_test = kernel_density(cal, as_ref(test), scott_bandwidth(test)).withColumnRenamed("density", "t")
    return under_cal.join(under_test, "id").select("id", (F.col("t") / (F.col("c") + 1e-10)).alias("weight"))


def cluster_thresholds(train: DataFrame, cal: DataFrame, clusters: int, alpha: float, seed: int = 0):
    """k-means on train + calibration vectors, one threshold per cluster.  Returns (model, thresholds by cluster).

    An empty cluster gets +inf.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = lambda d: d.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    both = vec(train.select("vector")).select("features").unionByName(vec(cal.select("vector")).select("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(both)
    placed = model.transform(vec(cal))
    found = conformal_threshold(placed, alpha, ["cluster"])
    every = train.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    return model, every.join(found, "cluster", "left").select("cluster", F.coalesce("threshold", F.lit(INF)).alias("threshold"))


def neighbour_level(scored: DataFrame, alpha: float) -> float:
    """Adjusted level for neighbourhood thresholds.

    A calibration row is covered at level a exactly when the weight share of its neighbours with a score not above its own
    is at least a, so the search for the level needs one order statistic of that share instead of repeated passes.
    `scored`: id, score, neighbour score, weight (normalised).
    """
    share = scored.groupBy("id").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("n_score") <= F.col("score"), F.col("weight")).otherwise(0.0))).alias("c"))
    n = share.count()
    need = math.ceil((1.0 - alpha) * n - 1e-9)
    if need <= 0:
        return 1.0
    ranked = positions(share.select((-F.col("c")).alias("m"), "id", "c"), ["m", "id"], name="pos")
    limit = ranked.where(F.col("pos") == need - 1).first()["c"]
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if mid <= limit else (low, mid)
    return low


def neighbour_weights(points: DataFrame, cal: DataFrame, k: int, length: float) -> DataFrame:
    """(id, ref_id, n_score, weight): exp(-distance / length) over the k nearest calibration rows, normalised per point."""
    near = nearest(points, cal.select(F.col("id").alias("ref_id"), "vector"), k, "euclidean")
    raw = near.withColumn("w", F.exp(-F.col("score") / length)).drop("score", "rank")
    total = raw.groupBy("id").agg(F.sum("w").alias("t"))
    scores = cal.select(F.col("id").alias("ref_id"), F.col("score").alias("n_score"))
    return raw.join(total, "id").join(scores, "ref_id").select("id", "ref_id", "n_score", (F.col("w") / F.col("t")).alias("weight"))


def neighbourhood_sets(cal: DataFrame, test: DataFrame, alpha: float, k: int = 20, length: float = 100.0) -> DataFrame:
    """Prediction sets with a threshold per test row; an empty set falls back to the most likely class.

    cal: id, vector, score (true-class probability); test: id, vector, prob.
    """
    own = neighbour_weights(cal.select("id", "vector"), cal, k, length).join(cal.select("id", "score"), "id")
    level = neighbour_level(cut_lineage(own), alpha)
    local = neighbour_weights(test.select("id", "vector"), cal, k, length)
    cut = weighted_quantile(local, level, ["id"], "n_score", "weight", "ref_id")
    sets = test.join(cut, "id").withColumn("predset", F.transform("prob", lambda p: p >= F.col("threshold")))
    top = argmax(F.col("prob"))
    only = F.transform("predset", lambda b, i: i == top)
    return sets.withColumn("predset", F.when(F.exists("predset", lambda b: b), F.col("predset")).otherwise(only))


# ---- probability calibration ---------------------------------------------------------------------


def fit_histogram(cal: DataFrame, bins: int, key: str = "sample_id", y: str = "y", probs: str = "prob") -> tuple[DataFrame, DataFrame]:
    """(edges per class, mean label per class and bin) from equal-mass bins; larger bins first when counts do not divide."""
    rows = cal.select(key, F.col(y).alias("__y"), F.posexplode(probs).alias("k", "s"))
    ranked = positions(rows, ["s", key], ["k"], "pos").join(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    small, extra = F.floor(F.col("n") / bins), F.col("n") % bins
    head = extra * (small + 1)
    later = F.when(small > 0, extra + F.floor(F.try_divide(F.col("pos") - head, small))).otherwise(extra)
    group = F.when(F.col("pos") < head, F.floor(F.col("pos") / (small + 1))).otherwise(later)
    edges = ranked.groupBy("k", group.alias("g")).agg(F.max("s").alias("e")).where(F.col("g") < bins - 1)
    edges = edges.groupBy("k").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    placed = rows.join(edges, "k").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("s"))))
    means = placed.groupBy("k", "bin").agg(F.avg((F.col("__y") == F.col("k")).cast("double")).alias("mean"))
    return edges, means


def apply_histogram(df: DataFrame, edges: DataFrame, means: DataFrame, key: str = "sample_id", probs: str = "prob") -> DataFrame:
    """Bin means per class, normalised over classes; a bin without calibration rows gives 0.5."""
    rows = df.select(key, F.posexplode(probs).alias("k", "s")).join(edges, "k")
    hit = rows.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("s")))).join(means, ["k", "bin"], "left")
    got = hit.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("mean", F.lit(0.5)).alias("v")))).alias("r"))
    vals = F.transform("r", lambda x: x["v"])
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return got.select(key, F.transform(vals, lambda v: F.when(total > 0, F.try_divide(v, total)).otherwise(1.0 / F.size("r"))).alias("prob"))


def temperature(cal: DataFrame, y: str = "y", logits: str = "logits", rounds: int = 6, points: int = 17) -> float:
    """Temperature with the smallest mean negative log likelihood; each round tries a grid of values in one aggregate."""
    low, high = math.log(0.05), math.log(20.0)
    best = 1.0
    for _ in range(rounds):
        grid = [math.exp(low + (high - low) * i / (points - 1)) for i in range(points)]
        top = F.array_max(logits)
        loss = lambda t: F.avg(
            F.ln(F.aggregate(F.transform(logits, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, v: a + v)) - (F.get(logits, F.col(y).cast("int")) - top) / t)
        row = cal.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first()
        at = min(range(points), key=lambda i: row[f"l{i}"])
        best, step = grid[at], (high - low) / (points - 1)
        low, high = math.log(best) - step, math.log(best) + step
    return best


def scaled_softmax(logits: Column, t: float) -> Column:
    top = F.array_max(logits)
    raw = F.transform(logits, lambda x: F.exp((x - top) / t))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda x: x / total)


def fit_dirichlet(cal: DataFrame, reg: float = 1e-3, max_iter: int = 128, y: str = "y", probs: str = "prob"):
    """Multinomial regression on log-probabilities; `transform` adds the calibrated probability vector."""
    from pyspark.ml.classification import LogisticRegression

    rows = log_features(cal, probs).withColumn("label", F.col(y).cast("double"))
    return LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter, standardization=False, probabilityCol="calibrated").fit(rows)


def log_features(df: DataFrame, probs: str = "prob") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-12))))))

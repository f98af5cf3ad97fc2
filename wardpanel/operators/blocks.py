"""All-against-all numeric work (kernel sums) in bounded blocks.

Both sides are cut into blocks of an eighth of their rows by id hash, so each row is copied a fixed number of times; one task sees
one block of each, in tiles, and returns only partial results per point (its best k, or sums).  No pair rows are produced and nothing
passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.operators.neighbours import TILE_CELLS, block_rows, nearest


def _count_blocks(df: DataFrame, least: int) -> int:
    n = df.count()
    return max(1, math.ceil(n / block_rows(n)), min(least, n // 64))


def block_map(points: DataFrame, reference: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, key: str = "id", ref_key: str = "ref_id") -> DataFrame:
    """fn(points block, reference block) for every pair of blocks, cogrouped on the block numbers."""
    n, m = _count_blocks(points, 8), _count_blocks(reference, 1)
    left = points.withColumns({"__p": F.pmod(F.xxhash64(key), F.lit(n)), "__r": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    right = reference.withColumns({"__r": F.pmod(F.xxhash64(ref_key), F.lit(m)).cast("int"), "__p": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))})

    names = right.columns
    other = right.toDF(*[f"ref_{c}" for c in names])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return fn(a, b.set_axis(names, axis=1)) if len(a) and len(b) else pd.DataFrame()

    return left.groupBy("__p", "__r").cogroup(other.groupBy("ref___p", "ref___r")).applyInPandas(run, schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared euclidean distances, never below 0."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(d, 0.0)


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of x in stretches whose table against y has at most `TILE_CELLS` cells."""
    step = max(1, TILE_CELLS // max(1, len(y)))
    return (x[i : i + step] for i in range(0, len(x), step))


def similar_above(points: DataFrame, reference: DataFrame, k: int, threshold: float, strict: bool = True) -> DataFrame:
    """Top k by cosine among those above (or at) the threshold."""
    best = nearest(points, reference, k)
    return best.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def kernel_density(points: DataFrame, reference: DataFrame, bandwidth: float) -> DataFrame:
    """(id, density): mean of exp(-d^2 / (dim * h)) over the reference rows."""

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(a["vector"]), _matrix(b["vector"])
        s = np.concatenate([np.exp(-_distances(t, y) / (x.shape[1] * bandwidth)).sum(1) for t in _tiles(x, y)])
        return pd.DataFrame({"id": a["id"].to_numpy(), "s": s, "n": np.full(len(x), len(y))})

    part = block_map(points.select("id", "vector"), reference.select("ref_id", "vector"), sums, "id bigint, s double, n bigint")
    return part.groupBy("id").agg((F.sum("s") / F.sum("n")).alias("density"))


def kernel_vote(points: DataFrame, reference: DataFrame, classes: int, bandwidth: float, drop_self: bool = False, eps: float = 1e-10) -> DataFrame:
    """(id, prob): kernel-weighted class shares.  reference: ref_id, vector, y."""

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(a["vector"]), _matrix(b["vector"])
        hot = np.eye(classes)[b["y"].to_numpy().astype(int)]

        def vote(t: np.ndarray) -> np.ndarray:
            k = np.exp(-_distances(t, y) / (x.shape[1] * bandwidth))
            return (np.where(k < 1.0 - eps, k, 0.0) if drop_self else k) @ hot

        votes = np.concatenate([vote(t) for t in _tiles(x, y)])
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), classes), "k": np.tile(np.arange(classes), len(x)), "v": votes.ravel()})

    part = block_map(points.select("id", "vector"), reference.select("ref_id", "vector", "y"), sums, "id bigint, k int, v double")
    per = part.groupBy("id", "k").agg(F.sum("v").alias("v"))
    rows = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("r"), F.greatest(F.sum("v"), F.lit(eps)).alias("t"))
    return rows.select("id", F.transform("r", lambda x: x["v"] / F.col("t")).alias("prob"))

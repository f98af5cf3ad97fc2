"""Nearest neighbours over an inverted file, exact by the triangle inequality.

Reference rows are put into lists around centroids of a bounded sample.  A point first reads the lists around it that hold k
rows; the distance of its k-th row so far then rules out every list whose rim lies farther away, and only the rest is read.
Without `exact` the reading stops after a number of lists.  Lists that lie together form a shard, and a point goes once to each
shard in which it reads a list, with one bit per list; a list with a third of all rows is several shards.  Points and reference rows
meet in blocks of an eighth of their tables, so each row is copied a fixed number of times, and only the best k rows of a block leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardpanel.session import cut_lineage

#: Bounds of what is fitted and sent to all tasks, whatever the table: sampled rows and lists.
SAMPLE_ROWS, MOST_LISTS = 8192, 1024
#: Rows of a block at least and at most, blocks of a table between them, cells of a score matrix, pairs scored at once, points routed at once.
BLOCK_ROWS, MOST_ROWS, BLOCKS = 2048, 32768, 8
TILE_CELLS, PAIRS, SLICE = 2_000_000, 65536, 512
SLACK, ROUNDING = 1e-9, 1e-11


@dataclass
class Lists:
    """Centroids, the farthest row of each list, and how many rows it holds."""

    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    cosine: bool

    def place(self, vectors: np.ndarray, side: int) -> np.ndarray:
        """Points in which a smaller distance is a better score: unit vectors for the cosine.

        A zero vector has the cosine 0 with everything: it gets a direction of its own, another one on each side.
        """
        if not self.cosine:
            return vectors
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.concatenate([vectors / np.maximum(size, 1e-300), np.zeros((len(vectors), 2))], axis=1)
        out[(size == 0)[:, 0], vectors.shape[1] + side] = 1.0
        return out

    def distances(self, placed: np.ndarray) -> np.ndarray:
        d = (placed**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None, :] - 2.0 * placed @ self.centroids.T
        return np.sqrt(np.maximum(d, 0.0))

    def first(self, gaps: np.ndarray, k: int, least: int) -> list[np.ndarray]:
        """The nearest lists of each point, until they hold k rows, at least `least` of them that are not empty."""
        order = np.argsort(gaps, axis=1, kind="stable")
        order = [o[self.rows[o] > 0] for o in order]
        return [o[: max(least, int(np.searchsorted(np.cumsum(self.rows[o]), k)) + 1)] for o in order]

    def others(self, gaps: np.ndarray, bound: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
        """Lists that can hold a row within `bound` of a point, less those that it has read."""
        near = (gaps - self.radius[None, :] <= bound[:, None] * (1 + SLACK) + SLACK) & (self.rows > 0)
        for row, lists in zip(near, seen):
            row[lists] = False
        return [np.flatnonzero(row) for row in near]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, lists: int, steps: int = 6) -> np.ndarray:
    """Plain k-means from evenly spread rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(np.int64)].copy()
    for _ in range(steps):
        d = (centroids**2).sum(1)[None, :] - 2.0 * sample @ centroids.T
        home = d.argmin(1)
        for c in np.unique(home):
            centroids[c] = sample[home == c].mean(0)
    return centroids


def build_lists(reference: DataFrame, metric: str) -> tuple[Lists, DataFrame]:
    """(lists, reference rows with their list).  The sample is set by a hash of the row, so it is the same for any partitioning."""
    cosine = metric == "cosine"
    rows = reference.select("ref_id", F.col("vector").cast("array<double>").alias("vector"))
    picked = rows.orderBy(F.xxhash64("ref_id", "vector"), "ref_id").limit(SAMPLE_ROWS).select("vector").collect()
    n = rows.count() if len(picked) == SAMPLE_ROWS else len(picked)
    lists = Lists(np.zeros((0, 0)), np.zeros(0), np.zeros(0), cosine)
    if n:
        sample = lists.place(np.array([r["vector"] for r in picked], dtype=np.float64), 0)
        lists.centroids = fit_centroids(sample, int(min(MOST_LISTS, max(1, math.sqrt(n)), max(1, len(sample) // 8))))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = lists.distances(lists.place(_matrix(batch.column(1)), 0))
                home = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, type=pa.int64()), pa.array(gaps[np.arange(len(home)), home])], names=["ref_id", "vector", "list", "gap"])

    placed = cut_lineage(rows.mapInArrow(homes, "ref_id bigint, vector array<double>, list bigint, gap double"))
    count = len(lists.centroids)
    lists.radius, lists.rows = np.zeros(count), np.zeros(count, dtype=np.int64)
    for r in placed.groupBy("list").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LISTS rows
        lists.radius[r["list"]], lists.rows[r["list"]] = r["r"], r["n"]
    return lists, placed.drop("gap")


def best_rows(a: pd.DataFrame, b: pd.DataFrame, read: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The best k rows of a block for each point of a block, ties to the smaller id; `read` (points x rows' lists) says which lists a point reads.

    A matrix product picks the rows that can be among the best k up to its rounding; only their scores are worked out in full.  Points go in
    tiles, so that memory is bounded whatever the blocks hold.
    """
    x, y = (np.asarray(t["vector"].tolist(), dtype=np.float64) for t in (a, b))
    refs, home = b["ref_id"].to_numpy(), b["spot"].to_numpy()
    if metric == "cosine":
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    finite = bool(np.isfinite(xx).all() and np.isfinite(yy).all())
    ids = a["id"].to_numpy()
    order = np.lexsort(read.T[::-1])  # points that read the same lists go together
    tile = max(1, TILE_CELLS // len(y))
    found = []
    for at in range(0, len(x), tile):
        rows = order[at : at + tile]
        asked = read[rows]
        cols = np.flatnonzero(asked.any(0)[home])
        if not len(cols):
            continue
        near = yy[cols][None, :] - 2.0 * x[rows] @ y[cols].T
        if not finite:
            near = np.where(np.isfinite(near), near, np.finfo(np.float64).max)
        if not asked.all():
            near[~asked[:, home[cols]]] = np.inf
        top = min(k, len(cols))
        rim = np.partition(near, top - 1, axis=1)[:, top - 1]
        slack = ROUNDING * (xx[rows] + yy[cols].max()) if finite else np.zeros(len(rows))
        r, c = np.nonzero((near <= (rim + slack)[:, None]) & (near < np.inf))
        c = cols[c]
        score = np.empty(len(r))
        for i in range(0, len(r), PAIRS):
            left, right = x[rows[r[i : i + PAIRS]]], y[c[i : i + PAIRS]]
            score[i : i + PAIRS] = (left * right).sum(1) if metric == "cosine" else np.sqrt(((right - left) ** 2).sum(1))
        best = np.lexsort((refs[c], -score if metric == "cosine" else score, r))
        r, c, score = r[best], c[best], score[best]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((ids[rows[r[kept]]], refs[c[kept]], score[kept]))
    if not found:
        return pd.DataFrame()
    return pd.DataFrame({n: np.concatenate(v) for n, v in zip(("id", "ref_id", "score"), zip(*found))})


@dataclass
class Shards:
    """Neighbouring lists put together to blocks of reference rows; a list above the bound is several blocks of its own."""

    members: list[np.ndarray]  # the lists of each shard, in order
    of_list: np.ndarray  # first shard of each list
    split: np.ndarray  # shards of each list
    spot: np.ndarray  # place of each list in the members of its shards


def block_rows(rows: int) -> int:
    """Rows of a block: an eighth of the table, so that each row is copied a fixed number of times, inside bounds of memory."""
    return min(max(BLOCK_ROWS, math.ceil(rows / BLOCKS)), MOST_ROWS)


def group_lists(lists: Lists) -> Shards:
    count, most = len(lists.centroids), block_rows(int(lists.rows.sum()))
    split = np.maximum(1, np.ceil(lists.rows / most)).astype(np.int64)
    of_list, spot = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    members: list[np.ndarray] = []
    left = [c for c in range(count) if split[c] == 1]
    for c in np.flatnonzero(split > 1):
        of_list[c] = len(members)
        members.extend([np.array([c])] * int(split[c]))
    while left:
        gap = ((lists.centroids[left] - lists.centroids[left[0]]) ** 2).sum(1)
        order = np.asarray(left)[np.argsort(gap, kind="stable")]
        taken = order[: max(1, int(np.searchsorted(np.cumsum(lists.rows[order]), most, side="right")))]
        of_list[taken], spot[taken] = len(members), np.arange(len(taken))
        members.append(taken)
        left = [c for c in left if c not in set(taken.tolist())]
    return Shards(members, of_list, split, spot)


def read_lists(routes: DataFrame, placed: DataFrame, lists: Lists, shards: Shards, parts: int, k: int, metric: str) -> DataFrame:
    """(id, ref_id, score): the best k rows that each point finds in each shard it reads; `routes`: shard, id, vector, read (bits over the shard's lists)."""
    shared = placed.sparkSession.sparkContext.broadcast(shards)  # at most MOST_LISTS lists
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col("list") + 1).cast("int")) if len(values) else F.lit(0)
    cut = F.pmod(F.xxhash64("ref_id"), at(shards.split)).cast("int")
    left = routes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    right = placed.select(
        "ref_id", F.col("vector").alias("ref_vector"), at(shards.spot).alias("spot"), (at(shards.of_list) + cut).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p")
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        count = len(shared.value.members[int(a["shard"].iloc[0])])
        bits = np.frombuffer(b"".join(a["read"]), dtype=np.uint8).reshape(len(a), -1)
        read = np.unpackbits(bits, axis=1, count=count).astype(bool)
        return best_rows(a, b.rename(columns={"ref_vector": "vector"}), read, k, metric)

    return left.groupBy("shard", "part").cogroup(right.groupBy("s", "p")).applyInPandas(meet, "id bigint, ref_id bigint, score double")


def nearest(points: DataFrame, reference: DataFrame, k: int, metric: str = "cosine", exact: bool = True, least_lists: int = 1) -> DataFrame:
    """(id, ref_id, score, rank): the k most similar (cosine) or closest (euclidean, score = distance) reference rows, ties by ref_id.

    points: id, vector (ids unique); reference: ref_id, vector.  Exact results read every list that can hold one of the k rows; otherwise each
    point reads its `least_lists` nearest lists, or as many as hold k rows.  An empty side gives no rows.
    """
    by = [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc("ref_id")]
    lists, placed = build_lists(reference, metric)
    shards = group_lists(lists)
    shared = points.sparkSession.sparkContext.broadcast((lists, shards))  # at most MOST_LISTS centroids

    def route(bounded: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, shards = shared.value
            if not len(lists.centroids):
                return
            for whole in batches:
                for start in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(start, SLICE)
                    gaps = lists.distances(lists.place(_matrix(batch.column(1)), 1))
                    go = lists.first(gaps, k, least_lists)
                    if bounded:
                        go = lists.others(gaps, batch.column(2).to_numpy(zero_copy_only=False), go)
                    reads = np.zeros(gaps.shape, dtype=bool)
                    for row, some in zip(reads, go):
                        row[some] = True
                    for shard, members in enumerate(shards.members):
                        mine = np.flatnonzero(reads[:, members].any(1))
                        if len(mine):
                            bits = np.packbits(reads[np.ix_(mine, members)], axis=1)
                            spots = pa.array(mine)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(mine), shard, dtype=np.int32)), batch.column(0).take(spots), batch.column(1).take(spots), pa.array([b.tobytes() for b in bits], type=pa.binary())],
                                names=["shard", "id", "vector", "read"],
                            )

        return rows

    schema = "shard int, id bigint, vector array<double>, read binary"
    asked = points.select("id", F.col("vector").cast("array<double>").alias("vector"))
    count = asked.count()
    parts = max(1, math.ceil(count / block_rows(count)))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*by))).where(F.col("rank") <= k)  # at most k rows a shard
    first = cut_lineage(best(read_lists(asked.mapInArrow(route(False), schema), placed, lists, shards, parts, k, metric)))
    if not exact:
        return first
    far = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) if metric == "cosine" else F.col("score")
    border = first.where(F.col("rank") == k).select("id", far.alias("bound"))
    bounded = asked.join(border, "id")  # a point with fewer than k rows has read all lists
    more = read_lists(bounded.mapInArrow(route(True), schema), placed, lists, shards, parts, k, metric)
    return best(first.drop("rank").unionByName(more))


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(id, recall): the share of the true neighbours that were found."""
    hit = found.select("id", "ref_id", F.lit(1.0).alias("hit"))
    return true.join(hit, ["id", "ref_id"], "left").groupBy("id").agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.count(F.lit(1))).alias("recall"))

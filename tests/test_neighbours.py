"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.operators import neighbours
from wardpanel.operators.neighbours import nearest, recall


def sides(spark, seed, n=600, d=6):
    rng = np.random.default_rng(seed)
    spots = rng.normal(0, 4, (12, d))
    ref = spots[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, d))
    ref[: n // 3] = ref[0]  # one vector on a third of the rows
    ref[n // 2] = 0.0
    points = np.concatenate([ref[rng.integers(0, n, 40)] + rng.normal(0, 0.1, (40, d)), rng.normal(0, 20, (10, d)), np.zeros((1, d))])
    make = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, vector array<double>").repartition(3)
    return points, ref, make(points, "id"), make(ref, "ref_id")


def brute(points, ref, k, metric):
    out = {}
    for i, x in enumerate(points):
        if metric == "cosine":
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
            score = -(unit(ref) @ unit(x))
        else:
            score = np.sqrt(((ref - x) ** 2).sum(1))
        out[i] = np.sort(np.abs(score) if metric != "cosine" else score)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [2048, 50])
def test_exact(spark, metric, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    points, ref, p, r = sides(spark, 1)
    got = nearest(p, r, 7, metric).toPandas().sort_values(["id", "rank"])
    want = brute(points, ref, 7, metric)
    assert got.groupby("id").size().eq(7).all() and got.id.nunique() == len(points)
    for i, g in got.groupby("id"):
        score = -g.score.to_numpy() if metric == "cosine" else g.score.to_numpy()
        np.testing.assert_allclose(score, want[i], rtol=1e-9, atol=1e-9)
        assert g.ref_id.is_unique
    tied = got[(got.ref_id < 200)]  # copies of one vector come in the order of their ids
    assert all(g.ref_id.tolist() == list(range(len(g))) for _, g in tied.groupby("id") if metric == "euclidean")


def test_exact_reads_few_lists(spark, monkeypatch):
    """On clustered rows the second reading leaves most lists out."""
    points, ref, p, r = sides(spark, 2)
    lists, _ = neighbours.build_lists(r, "euclidean")
    gaps = lists.distances(points[:40])
    bound = np.array([w[-1] for w in brute(points[:40], ref, 7, "euclidean").values()])
    first = lists.first(gaps, 7, 1)
    read = np.mean([len(a) + len(b) for a, b in zip(first, lists.others(gaps, bound, first))])
    assert read < 0.4 * len(lists.centroids)


def test_more_lists_find_more(spark):
    points, ref, p, r = sides(spark, 3)
    true = nearest(p, r, 7, "euclidean")
    found = [recall(nearest(p, r, 7, "euclidean", exact=False, least_lists=n), true).agg(F.avg("recall")).first()[0] for n in (1, 6, 1000)]
    assert 0.5 < found[0] <= found[1] <= found[2] == 1.0


def test_few_and_no_rows(spark):
    _, _, p, r = sides(spark, 4)
    assert nearest(p.limit(3), r.limit(2), 5).count() == 6
    assert nearest(p, r.where("false"), 5).count() == 0 and nearest(p.where("false"), r, 5).count() == 0


def test_copies_of_a_point_do_not_grow_with_the_lists(spark):
    """A point that reads every list goes once to each shard, not once to each list."""
    rng = np.random.default_rng(5)
    ref = rng.normal(0, 1, (9000, 24))
    make = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, vector array<double>")
    lists, _ = neighbours.build_lists(make(ref, "ref_id"), "euclidean")
    shards = neighbours.group_lists(lists)
    assert len(lists.centroids) > 60 and len(shards.members) <= 8
    assert sorted(np.concatenate(shards.members).tolist()) == list(range(len(lists.centroids)))
    got = nearest(make(ref[:30], "id"), make(ref, "ref_id"), 5, "euclidean").toPandas()
    want = brute(ref[:30], ref, 5, "euclidean")
    for i, g in got.sort_values(["id", "rank"]).groupby("id"):
        np.testing.assert_allclose(g.score.to_numpy(), want[i], rtol=1e-9, atol=1e-9)

"""Ranged forms against plain windows and pandas."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardpanel.operators import order


def skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.randrange(40), None if rng.random() < 0.3 else float(rng.randrange(9))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, v long, x double")


@pytest.mark.parametrize("by", [[], ["k"]])
def test_positions_match_row_number(spark, ranged, by):
    df = skewed(spark)
    got = order.positions(df, ["v", "t"], by, "pos", sample_rows=50, ranges=8)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("v", "t")
    assert got.withColumn("want", F.row_number().over(w) - 1).where("pos <> want").count() == 0
    assert got.count() == 600


def test_running_totals_match_window(spark, ranged):
    df = skewed(spark).withColumn("w", F.col("v") * 1.0)
    got = order.running_totals(df, ["t"], {"before": F.col("w")}, ["k"], sample_rows=40, ranges=6)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    assert got.withColumn("want", F.coalesce(F.sum("w").over(w), F.lit(0.0))).where("abs(before - want) > 1e-9").count() == 0


def test_running_last_matches_window(spark, ranged):
    df = skewed(spark)
    got = order.running_last(df, ["k"], ["t"], "x", "filled", sample_rows=40, ranges=6)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert got.withColumn("want", F.last("x", True).over(w)).where("not (filled <=> want)").count() == 0


def test_percent_ranks_match_pandas(spark, ranged):
    df = skewed(spark)
    got = order.percent_ranks(df, {"v": "r", "x": "s"}, ["k"], sample_rows=40, ranges=6).toPandas().sort_values("t")
    base = df.toPandas().sort_values("t")
    for col, name in (("v", "r"), ("x", "s")):
        want = base.groupby("k")[col].rank(pct=True)
        pd.testing.assert_series_equal(got[name].reset_index(drop=True), want.reset_index(drop=True), check_names=False)


@pytest.mark.parametrize("size", [3, 7, 50])
def test_split_series_keeps_rolling_windows_exact(spark, size):
    df = skewed(spark)
    cut = order.split_series(df, ["k"], ["t"], before=4, after=2, max_rows=size)
    w = Window.partitionBy("k", "__chunk").orderBy("t")
    got = order.drop_halo(cut.withColumns({"m": F.sum("v").over(w.rowsBetween(-4, 0)), "nx": F.lead("v", 2).over(w)}))
    p = Window.partitionBy("k").orderBy("t")
    want = df.withColumns({"m2": F.sum("v").over(p.rowsBetween(-4, 0)), "nx2": F.lead("v", 2).over(p)}).select("t", "m2", "nx2")
    assert got.count() == 600
    assert got.join(want, "t").where("not (m <=> m2) or not (nx <=> nx2)").count() == 0


def test_top_per_group_is_exact(spark):
    df = skewed(spark)
    got = order.top_per_group(df, ["k"], [F.desc("v"), F.col("t")], 4, salts=5)
    w = Window.partitionBy("k").orderBy(F.desc("v"), "t")
    want = df.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    assert sorted(map(tuple, got.select("k", "t", "rank").collect())) == sorted(map(tuple, want.select("k", "t", "rank").collect()))


def test_neighbour_on_long_series(spark, ranged):
    df = skewed(spark)
    got = order.neighbour(df, ["k"], ["t"], {"nxt": F.col("t")})
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("want", F.lead("t").over(w)).select("t", "want")
    assert got.join(want, "t").where("not (nxt <=> want)").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_tie_ranks_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    spark.conf.set("wardpanel.group.rows", "1")
    try:
        got = {r["v"]: (r["smaller"], r["equal"], r["total"]) for r in order.tie_ranks(df, "v", sample_rows=10, ranges=3).collect()}
    finally:
        spark.conf.unset("wardpanel.group.rows")
    for v in set(values):
        assert got[v] == (sum(x < v for x in values), values.count(v), len(values))


def test_edges_when_series_share_their_order_values(spark):
    from wardpanel.operators.order import _edges

    rows = spark.range(300).selectExpr("id AS name").crossJoin(spark.range(100).selectExpr("id AS day"))
    assert len(_edges(rows, ["day"], 64, 2048, ["name"])) > 40

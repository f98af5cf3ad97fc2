"""Exact quantiles of groups of any size against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.operators import panel as p
from wardpanel.operators.quantiles import _by_ranges, quantiles

WANTED = {"low": 0.1, "mid": 0.5, "high": 0.93, "least": 0.0, "most": 1.0}


def expected(rows, wanted):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    out = {}
    for g, vs in groups.items():
        kept = [v for v in vs if v is not None]
        out[g] = {n: float(np.quantile(kept, q)) if kept else None for n, q in wanted.items()}
    return out


def check(found, want, names):
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == set(want)
    for g in want:
        for n in names:
            assert got[g][n] == pytest.approx(want[g][n], rel=1e-12) if want[g][n] is not None else got[g][n] is None


@pytest.mark.parametrize("limit, accuracy", [("1000000", 10_000), ("50", 10_000), ("50", 20), ("1", 10_000)])
def test_groups_of_any_size(spark, limit, accuracy):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 600).round(3)] + [("flat", 2.0)] * 300 + [("few", v) for v in (1.0, None, 4.0)]
    rows += [(None, float(v)) for v in rng.integers(0, 9, 200)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    spark.conf.set("wardpanel.group.rows", limit)
    try:
        check(quantiles(df, "v", WANTED, ["g"], accuracy), expected(rows, WANTED), WANTED)
    finally:
        spark.conf.unset("wardpanel.group.rows")


def test_whole_table_and_empty_table(spark, ranged):
    values = [float(v) for v in np.random.default_rng(5).exponential(1, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles(df, "v", WANTED).first()
    for n, q in WANTED.items():
        assert row[n] == pytest.approx(np.quantile(values, q), rel=1e-12)
    none = quantiles(df.limit(0), "v", WANTED).collect()
    assert len(none) == 1 and none[0]["mid"] is None
    with pytest.raises(ValueError):
        quantiles(df, "v", {"x": 1.5})


def test_ranges_alone(spark, ranged):
    rows = [(g, float(v)) for g in ("a", None) for v in np.random.default_rng(8).normal(0, 5, 90).round(1)]
    df = spark.createDataFrame(rows, "g string, __v double")
    check(_by_ranges(df, ["g"], WANTED), expected(rows, WANTED), WANTED)


def test_factors_use_it_on_a_hot_date(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{i}", d, float(v)) for d in (1, 2) for i, v in enumerate(rng.normal(0, 1, 400 if d == 1 else 9))]
    panel = spark.createDataFrame(rows, "instrument string, datetime int, x double")
    factors = {"mid": p.cs_median("x"), "part": p.percentile("x", 0.75)}
    plain = {tuple(r) for r in p.evaluate(panel, factors, max_rows=1000).select("instrument", "datetime", F.round("mid", 12), F.round("part", 12)).collect()}
    spark.conf.set("wardpanel.group.rows", "20")
    try:
        cut = {tuple(r) for r in p.evaluate(panel, factors).select("instrument", "datetime", F.round("mid", 12), F.round("part", 12)).collect()}
    finally:
        spark.conf.unset("wardpanel.group.rows")
    assert plain == cut and len(plain) == 409

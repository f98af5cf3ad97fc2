"""Panel functions against pandas on a panel with missing values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardpanel.operators import panel as p


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    rows = []
    for inst in range(4):
        for day in pd.date_range("2024-01-01", periods=40):
            rows.append((inst, day.date(), float(np.round(rng.normal(50, 9), 3)), float(rng.integers(1, 30))))
    pdf = pd.DataFrame(rows, columns=["instrument", "datetime", "x", "y"])
    pdf.loc[rng.random(len(pdf)) < 0.15, "x"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "instrument long, datetime date, x double, y double").cache()


def roll(data, fn, col="x"):
    return data.groupby("instrument")[col].transform(fn)


W = 0.9 ** np.arange(6)[::-1]
CASES = {
    "mean": (lambda: p.ts_mean("x", 5), lambda d: roll(d, lambda s: s.rolling(5, min_periods=1).mean())),
    "std": (lambda: p.ts_std("x", 6), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).std())),
    "var0": (lambda: p.ts_var("x", 6, 0), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).var(ddof=0))),
    "rank": (lambda: p.ts_rank("x", 6), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).rank(pct=True))),
    "quantile": (lambda: p.ts_quantile("x", 7, 0.8), lambda d: roll(d, lambda s: s.rolling(7, min_periods=1).quantile(0.8))),
    "median": (lambda: p.ts_median("x", 4), lambda d: roll(d, lambda s: s.rolling(4, min_periods=1).median())),
    "delta": (lambda: p.delta("x", 2), lambda d: roll(d, lambda s: s.diff(2))),
    "pct": (lambda: p.ts_pctchange("x", 1), lambda d: roll(d, lambda s: s.pct_change(1, fill_method=None).fillna(0))),
    "ema": (lambda: p.ema("x", 9), lambda d: roll(d, lambda s: s.ewm(span=9, min_periods=1).mean())),
    "sma_ewm": (lambda: p.sma("x", 7, 2), lambda d: roll(d, lambda s: s.ewm(alpha=2 / 7).mean())),
    "macd": (lambda: p.macd("x"), lambda d: roll(d, lambda s: s.ewm(span=12, min_periods=1).mean()) - roll(d, lambda s: s.ewm(span=26, min_periods=1).mean())),
    "wma": (lambda: p.wma("x", 6), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).apply(lambda w: (w * W[: len(w)]).sum() / W[: len(w)].sum(), raw=True))),
    "mad": (lambda: p.ts_mad("x", 5), lambda d: roll(d, lambda s: s.rolling(5, min_periods=1).apply(lambda w: np.median(np.abs(w - np.median(w))), raw=True))),
    "decay": (lambda: p.decaylinear("x", 5), lambda d: roll(d, lambda s: s.rolling(5, min_periods=1).apply(lambda w: (w * (np.arange(1, 6) / 15)[: len(w)]).sum(), raw=True))),
    "prod": (lambda: p.prod(p.column("y") / 10, 4), lambda d: roll(d.assign(z=d.y / 10), lambda s: s.rolling(4, min_periods=1).apply(np.prod, raw=True), "z")),
    "argmax": (lambda: p.ts_argmax("y", 6), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).apply(lambda w: len(w) - w.argmax() - 1, raw=True), "y")),
    "lowday": (lambda: p.lowday("y", 6), lambda d: roll(d, lambda s: s.rolling(6, min_periods=1).apply(lambda w: len(w) - w.argmin(), raw=True), "y")),
    "corr": (lambda: p.ts_corr("x", "y", 8), lambda d: d.groupby("instrument", group_keys=False)[["x", "y"]].apply(lambda g: g.x.rolling(8, min_periods=2).corr(g.y))),
    "cov": (lambda: p.ts_covariance("x", "y", 8), lambda d: d.groupby("instrument", group_keys=False)[["x", "y"]].apply(lambda g: g.x.rolling(8, min_periods=2).cov(g.y))),
    "cs_rank": (lambda: p.rank("x"), lambda d: d.groupby("datetime").x.rank(pct=True)),
    "zscore": (lambda: p.zscore("x"), lambda d: (d.x - d.groupby("datetime").x.transform("mean")) / d.groupby("datetime").x.transform("std")),
    "scale": (lambda: p.scale("x", 2.0), lambda d: 2 * d.x / d.x.abs().groupby(d.datetime).transform("sum")),
    "log": (lambda: p.log("y"), lambda d: np.log(d.y + 1)),
    "sumif": (lambda: p.sumif("y", 5, p.gt("y", 12)), lambda d: roll(d.assign(z=d.y * (d.y > 12)), lambda s: s.rolling(5, min_periods=1).sum(), "z")),
}


@pytest.fixture(scope="module")
def computed(frame):
    out = p.evaluate(frame, {n: make() for n, (make, _) in CASES.items()}).toPandas()
    return out.sort_values(["instrument", "datetime"]).reset_index(drop=True)


@pytest.mark.parametrize("name", CASES)
def test_function_matches_pandas(name, computed, data):
    want = CASES[name][1](data).to_numpy(dtype=float)
    np.testing.assert_allclose(computed[name].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-9)


def beta(y, x):
    return np.linalg.lstsq(np.vstack([x, np.ones(len(x))]).T, y, rcond=None)[0]


def test_regressions(frame, data):
    out = p.evaluate(frame, {"b": p.regbeta("x", "y", 6), "r": p.regresi("x", "y", 6), "s": p.regbeta("x", p.sequence(6)), "c": p.ts_corr("y", p.sequence(6))}).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    filled = data.fillna({"x": 0.0})
    for _, g in filled.groupby("instrument"):
        for i, at in enumerate(g.index):
            if i < 5:
                assert np.isnan(out.b[at]) and np.isnan(out.s[at])
                continue
            y, x = g.x.to_numpy()[i - 5 : i + 1], g.y.to_numpy()[i - 5 : i + 1]
            k, m = beta(y, x)
            assert abs(out.b[at] - k) < 1e-8 and abs(out.r[at] - (y[-1] - k * x[-1] - m)) < 1e-7
            assert abs(out.s[at] - beta(y, np.arange(1, 7))[0]) < 1e-8
            assert abs(out.c[at] - np.corrcoef(x, np.arange(6))[0, 1]) < 1e-8


def test_infinity_and_missing_rules(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 0.0, None), (1, "2024-01-02", 2.0, 1.0)], "instrument long, datetime string, x double, y double")
    got = p.evaluate(df, {"inv": p.inv("x"), "zero": p.divide(0, "x"), "both": p.both("y", 1), "ne": p.ne("y", 1), "gt": p.gt("y", 0), "m": p.maximum("x", "y"), "w": p.where("y", 5, 6)}).orderBy("datetime").collect()
    assert got[0]["inv"] == float("inf") and got[0]["zero"] is None and got[0]["both"] is True and got[0]["ne"] is True and got[0]["gt"] is False
    assert got[0]["m"] is None and got[1]["inv"] == 0.5 and got[1]["m"] == 2.0


def test_chunked_series_equal_whole_series(frame):
    factors = {"m": p.ts_mean("x", 5), "e": p.ema("x", 3), "n": p.lead_rows("x", 2), "q": p.ts_quantile("y", 6, 0.3)}
    whole = p.evaluate(frame, factors).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    cut = p.evaluate(frame, factors, max_rows=7).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    for c in factors:
        np.testing.assert_allclose(cut[c].to_numpy(dtype=float), whole[c].to_numpy(dtype=float), rtol=1e-9)


def test_equal_parts_are_computed_once(frame):
    a, b = p.ts_mean("x", 5), p.ts_mean("x", 5) + p.ts_mean("y", 5)
    names = {s.name for f in (a, b) for s in f.steps}
    assert len(names) == 2


def test_subtrees_ignore_operand_order():
    one = p.subtree_rows("a", p.add(p.ts_mean("x", 5), "y"))
    two = p.subtree_rows("b", p.add("y", p.ts_mean("x", 5)))
    assert max(one, key=lambda r: r[2])[1:] == max(two, key=lambda r: r[2])[1:]
    assert p.subtree_rows("c", p.subtract("x", "y"))[-1][1] != p.subtree_rows("d", p.subtract("y", "x"))[-1][1]


def test_bad_factors_are_reported():
    good, bad = p.drop_missing_factors({"ok": lambda: p.ts_mean("x"), "ahead": lambda: p.delay("x", -1)})
    assert list(good) == ["ok"] and list(bad) == ["ahead"]


def test_weighted_means_over_a_long_gap(spark):
    days = pd.date_range("2020-01-01", periods=430)
    x = pd.Series([1.0, 2.0, 1.5] + [np.nan] * 400 + [float(i % 7) for i in range(27)])
    rows = [(1, d.date(), None if np.isnan(v) else float(v)) for d, v in zip(days, x)]
    panel = spark.createDataFrame(rows, "instrument long, datetime date, x double")
    factors = {"e": p.ema("x", 5), "s": p.sma("x", 7, 2), "m": p.macd("x")}
    got = p.evaluate(panel, factors).toPandas().sort_values("datetime")
    span = lambda n: x.ewm(span=n, min_periods=1).mean()
    for name, want in {"e": span(5), "s": x.ewm(alpha=2 / 7).mean(), "m": span(12) - span(26)}.items():
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-12)


def test_wide_sets_sort_the_series_once(spark):
    """All windows and statistics of a set share one shuffle, and rows that only later steps need do not travel."""
    from wardpanel.operators import catalogue

    columns = "instrument long, datetime date, open double, high double, low double, close double, volume double, vwap double"
    panel = spark.createDataFrame([(i, pd.Timestamp("2024-01-01").date(), 1.0, 2.0, 0.5, 1.5, 9.0, 1.2) for i in range(3)], columns)
    for factors in (catalogue.set_158(), catalogue.set_multi(), catalogue.set_20()):
        plan = p.evaluate(panel, factors)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(instrument") == 1 and plan.count("Exchange ") == 1


def test_statistics_of_statistics_keep_what_is_shown(spark, frame, data):
    """A statistic that others are built on stays when it is a factor itself, and goes when it is not."""
    first = p.ts_median("y", 4)
    got = p.evaluate(frame, {"m": first, "mm": p.ts_median(first, 3), "q": p.ts_mean(p.ts_median("y", 5), 3)}).toPandas().sort_values(["instrument", "datetime"])
    m = roll(data, lambda s: s.rolling(4, min_periods=1).median(), "y")
    mm = roll(data.assign(z=m), lambda s: s.rolling(3, min_periods=1).median(), "z")
    q = roll(data.assign(z=roll(data, lambda s: s.rolling(5, min_periods=1).median(), "y")), lambda s: s.rolling(3, min_periods=1).mean(), "z")
    for name, want in (("m", m), ("mm", mm), ("q", q)):
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_bars_and_windows_share_one_shuffle(spark, tmp_path):
    from wardpanel.queries.panel import bars

    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(12)]
    lines = [(i % 3, d, float(1 + i % 5 + s), 10.0 * i + s, 100 + i, s, 7 * i) for i, d in enumerate(days) for s in range(3)]
    lines += [lines[4], (None, days[0], 2.0, 4.0, 1, 1, 1), (1, None, 2.0, 4.0, 1, 1, 1), (1, days[0], None, 4.0, 1, 1, 1)]
    names = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_orderkey long, l_linenumber int, l_partkey long"
    spark.createDataFrame(lines, names).write.parquet(str(tmp_path / "lineitem.parquet"))

    def told():
        panel = bars(spark, str(tmp_path))
        out = panel.withColumn("before", F.lag("close").over(Window.partitionBy("instrument").orderBy("datetime")))
        moved = out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")
        return sorted(map(str, out.collect())), moved

    rows, moved = told()
    spark.conf.set("wardpanel.group.rows", "3")
    try:
        hot, _ = told()
    finally:
        spark.conf.unset("wardpanel.group.rows")
    assert rows == hot and len(rows) > 12
    assert moved == 1

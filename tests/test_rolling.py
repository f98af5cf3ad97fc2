"""Order statistics of sliding windows against pandas and plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from wardpanel.operators import panel as p, rolling
from wardpanel.operators.rolling import Ask, Indexed, Series, WindowOrder, answer, first_largest


def test_kth_and_less_of_any_stretch():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (2, 2), (50, 4), (333, 1000)):
        values = rng.integers(0, top, n).astype(float)
        order = WindowOrder(values)
        a = rng.integers(0, n, 400)
        b = a + 1 + rng.integers(0, n - a, 400)
        k = rng.integers(0, b - a)
        assert order.kth(a, b, k).tolist() == [sorted(values[x:y])[z] for x, y, z in zip(a, b, k)]
        code = rng.integers(0, len(order.sorted) + 1, 400)
        assert order.less(a, b, code).tolist() == [sum(order.codes[x:y] < c) for x, y, c in zip(a, b, code)]
        assert first_largest(order.codes, a, b).tolist() == [x + int(values[x:y].argmax()) for x, y in zip(a, b)]


PLAIN = {
    "quantile": lambda w, v: np.quantile(w, 0.3) if len(w) else None,
    "rank": lambda w, v: (sum(x < v for x in w) + (sum(x == v for x in w) + 1) / 2) / len(w),
    "mad": lambda w, v: np.median(np.abs(np.array(w) - np.median(w))),
    "argmax": lambda w, v: len(w) - 1 - int(np.argmax(w)),
    "argmin": lambda w, v: len(w) - 1 - int(np.argmin(w)),
    "firstmax": lambda w, v: int(np.argmax(w)) + 1,
    "firstmin": lambda w, v: int(np.argmin(w)) + 1,
    "mean": lambda w, v: np.mean(w),
    "sum": lambda w, v: np.sum(w),
    "spread": lambda w, v: np.std(w, ddof=1) if len(w) > 1 else None,
}


@pytest.mark.parametrize("kind", list(PLAIN))
@pytest.mark.parametrize("window", [1, 2, 7, 500, None])
def test_statistics_of_several_series(kind, window):
    rng = random.Random(f"{kind}{window}")
    sizes = [1, 40, 3, 90, 1, 17]
    series = np.repeat(np.arange(len(sizes)), sizes)
    values = [None if rng.random() < 0.2 else rng.choice([rng.uniform(-1, 1), float(rng.randint(0, 4)), 1e9]) for _ in series]
    lengths = np.array([window or rng.choice([1, 2, 5, 10_000]) for _ in series])
    got, ok = answer(Ask(kind, (), ("x",), window, 0.3), Indexed.of(pa.array(values, type=pa.float64())), None if window else lengths, Series(series))
    for i in range(len(series)):
        start = max(sum(sizes[: series[i]]), i - int(lengths[i]) + 1)
        seen = values[start : i + 1]
        held = [v for v in seen if v is not None]
        gap = len(held) < len(seen)
        want = None
        if held and not (kind in ("mad", "argmax", "argmin") and gap) and not (kind == "rank" and values[i] is None):
            want = PLAIN[kind](held, values[i])
        assert bool(ok[i]) == (want is not None)
        if want is not None:
            assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_lines_and_correlations():
    rng = np.random.default_rng(4)
    series = np.repeat([0, 1, 2], [60, 1, 30])
    x, y = (np.where(rng.random(91) < 0.2, np.nan, np.round(rng.normal(1e6, 2, 91), 1)) for _ in range(2))
    y[70:80] = 5.0
    column = lambda v: pa.array(v, from_pandas=True)
    rows, known = Series(series), {}
    got = {k: answer(Ask(k, (), ("y",), 9), Indexed.of(column(y)), None, rows, known) for k in ("slope", "r2", "rest")}
    got["corr"] = answer(Ask("corr", (), ("x", "y"), 9), Indexed.of(column(x), column(y)), None, rows, known)
    for i in range(91):
        a = max(np.flatnonzero(series == series[i])[0], i - 8)
        t, v, u = np.arange(a, i + 1), y[a : i + 1], x[a : i + 1]
        ok = ~np.isnan(v)
        assert got["slope"][1][i] == got["r2"][1][i] == (ok.sum() > 1)
        assert got["rest"][1][i] == (ok.sum() > 1 and ok[-1])
        if ok.sum() > 1:
            slope, start = np.polyfit(t[ok] - i, v[ok] - 1e6, 1)
            left = ((v[ok] - 1e6 - start - slope * (t[ok] - i)) ** 2).sum()
            total = ((v[ok] - v[ok].mean()) ** 2).sum()
            assert math.isclose(got["slope"][0][i], slope, rel_tol=1e-7, abs_tol=1e-9) and math.isclose(got["r2"][0][i], 1 - left / total if total else 1, abs_tol=1e-7)
            assert not ok[-1] or math.isclose(got["rest"][0][i], v[-1] - 1e6 - start, abs_tol=1e-7)
        both = ok & ~np.isnan(u)
        flat = both.sum() < 2 or v[both].std() == 0 or u[both].std() == 0
        assert got["corr"][1][i] == (not flat)
        if not flat:
            assert math.isclose(got["corr"][0][i], np.corrcoef(u[both] - 1e6, v[both] - 1e6)[0, 1], abs_tol=1e-7)


def test_infinite_values_stay_in_their_windows():
    column = Indexed.of(pa.array([1.0, math.inf, 3.0, 5.0, math.nan, 2.0, 4.0]))
    got, _ = answer(Ask("mean", (), ("x",), 2), column, None, Series(np.zeros(7, dtype=np.int64)))
    assert not np.isfinite(got[[1, 2, 4, 5]]).any() and got[[0, 3, 6]].tolist() == [1, 4, 3]


def test_no_values():
    for kind in Ask.KINDS:
        none = pa.array([None, None], type=pa.float64())
        column = Indexed.of(none, none) if kind in Ask.PAIRS else Indexed.of(none)
        assert not answer(Ask(kind, (), ("x",), 3, 0.5), column, None, Series(np.array([1, 1])))[1].any()
    with pytest.raises(ValueError):
        Ask("mode", (), ("x",), 3)


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(2)
    n = 6000
    pdf = pd.DataFrame({"instrument": 1, "datetime": np.arange(n), "x": np.round(rng.normal(0, 5, n), 1), "n": rng.integers(1, 5000, n)})
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    other = pdf.head(50).assign(instrument=2)
    pdf = pd.concat([pdf, other], ignore_index=True)
    rows = [tuple(None if v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "instrument long, datetime long, x double, n long").repartition(4).cache()


def test_windows_of_thousands_of_rows(long):
    pdf, frame = long
    size = p.column("n")
    factors = {"q": p.ts_quantile("x", 5000, 0.3), "r": p.ts_rank("x", 5000), "m": p.ts_median("x", 1200), "mid": p.bb_middle("x", size), "up": p.bb_upper("x", size)}
    got = p.evaluate(frame, factors).toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    roll = lambda n: pdf.groupby("instrument").x.rolling(n, min_periods=1)
    flat = lambda s: s.reset_index(level=0, drop=True).to_numpy()
    np.testing.assert_allclose(got.q.to_numpy(float), flat(roll(5000).quantile(0.3)), rtol=1e-12)
    np.testing.assert_allclose(got.r.to_numpy(float), flat(roll(5000).rank(pct=True)), rtol=1e-12)
    np.testing.assert_allclose(got.m.to_numpy(float), flat(roll(1200).median()), rtol=1e-12)
    for i in range(0, len(pdf), 37):
        row = pdf.iloc[i]
        own = pdf[(pdf.instrument == row.instrument) & (pdf.datetime <= row.datetime)].x.to_numpy()[-int(row.n) :]
        own = own[~np.isnan(own)]
        if len(own) > 1:
            assert math.isclose(got.mid[i], own.mean(), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(got.up[i], own.mean() + own.std(ddof=1), rel_tol=1e-9, abs_tol=1e-12)


def test_series_are_cut_by_default(spark, long, monkeypatch):
    """A series above the setting is cut without being told, with the same results, also after gaps longer than a chunk's overlap."""
    pdf, frame = long
    gap = frame.selectExpr("instrument", "datetime", "CASE WHEN datetime NOT BETWEEN 900 AND 4200 THEN x END AS x", "n")
    factors = {"e": p.ema("x", 4), "k": p.last_known("x"), "q": p.ts_quantile("x", 30, 0.5), "t": p.ts_mean(p.ema("x", 4), 5), "d": p.ts_argmax("n", 9)}
    order = lambda df: df.toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    whole = order(p.evaluate(gap, factors))
    spark.conf.set("wardpanel.group.rows", "700")
    try:
        cut = order(p.evaluate(gap, factors))
        for f in factors:
            np.testing.assert_allclose(cut[f].to_numpy(float), whole[f].to_numpy(float), rtol=1e-12, err_msg=f)
        with pytest.raises(ValueError, match="max_window"):
            p.evaluate(gap, {"m": p.bb_middle("x", p.column("n"))})
    finally:
        spark.conf.unset("wardpanel.group.rows")
    x = gap.where("instrument = 1").toPandas().sort_values("datetime").x
    np.testing.assert_allclose(whole.e[:6000].to_numpy(float), x.ewm(span=4, min_periods=1).mean().to_numpy(), rtol=1e-9)


def test_batches_end_between_series(spark, monkeypatch):
    monkeypatch.setattr(rolling, "BATCH_ROWS", 5)
    rows = [(i % 7, i // 7, float((i * 37) % 11)) for i in range(140)]
    frame = spark.createDataFrame(rows, "instrument long, datetime long, x double").repartition(2)
    got = p.evaluate(frame, {"q": p.ts_median("x", 4)}).toPandas().sort_values(["instrument", "datetime"])
    want = pd.DataFrame(rows, columns=["i", "t", "x"]).sort_values(["i", "t"]).groupby("i").x.rolling(4, min_periods=1).median()
    np.testing.assert_allclose(got.q.to_numpy(), want.to_numpy())


def test_windows_join_the_pass_of_statistics(long):
    """Beside a statistic no frame of Spark is left over plain columns, and the values are those of pandas."""
    pdf, frame = long
    factors = {"q": p.ts_quantile("x", 9, 0.5), "m": p.ts_mean("x", 7), "s": p.ts_std("x", 6), "hi": p.ts_max("x", 120), "lo": p.ts_min("x", 12), "n": p.ts_max("n", 5)}
    out = p.evaluate(frame, factors)
    assert [f.dataType.simpleString() for f in out.select("n", "hi").schema] == ["bigint", "double"]
    assert "max(x" not in out._jdf.queryExecution().analyzed().toString() and "avg(x" not in out._jdf.queryExecution().analyzed().toString()
    got = out.toPandas().sort_values(["instrument", "datetime"]).reset_index(drop=True)
    groups = pdf.groupby("instrument")
    flat = lambda s: s.reset_index(level=0, drop=True).to_numpy()
    want = {"m": flat(groups.x.rolling(7, min_periods=1).mean()), "s": flat(groups.x.rolling(6, min_periods=2).std()), "hi": flat(groups.x.rolling(120, min_periods=1).max()),
            "lo": flat(groups.x.rolling(12, min_periods=1).min()), "n": flat(groups.n.rolling(5, min_periods=1).max())}
    for name, values in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), values, rtol=1e-9, atol=1e-12, err_msg=name)


def test_infinite_values_as_in_spark():
    column = Indexed.of(pa.array([1.0, math.inf, math.inf, math.nan, 5.0, 2.0]))
    ask = lambda kind, n: answer(Ask(kind, (), ("x",), n), column, None, Series(np.zeros(6, dtype=np.int64)))[0]
    np.testing.assert_array_equal(ask("mean", 2), [1, math.inf, math.inf, math.nan, math.nan, 3.5])
    np.testing.assert_array_equal(ask("max", 2), [1, math.inf, math.inf, math.nan, math.nan, 5])
    np.testing.assert_array_equal(ask("min", 2), [1, 1, math.inf, math.inf, 5, 2])
    assert np.isnan(ask("spread", 2)[[1, 2, 3, 4]]).all()


def test_large_sets_are_shown_by_one_function(spark):
    """Rounding and logarithm stand once in the plan of a factor set, not once per factor."""
    from wardpanel.queries import load_all

    plan = load_all()[0]["panel_set_multi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG(") + plan.count("ln(") < 10 and plan.count("rint(") == 1

"""Catalogue, alignment, normalisation and evaluation queries on the weekly supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.operators import catalogue, evaluate as ev, panel as p
from wardpanel.queries.panel import ALL, BARS, D, NUMBERED, O, RANK_SQL, SQL_KEYS, W, bars, factor_query
from wardpanel.plans.factor_job import factor_job
from wardpanel.queries.registry import query, r, table, tidy
from wardpanel.sources.tables import scratch

KEYS = ["instrument", "datetime"]


def text_date(df):
    return df.withColumn("datetime", F.col("datetime").cast("string"))


RSV = "(close - min(low) OVER {w}) / (max(high) OVER {w} - min(low) OVER {w} + 1e-12)"
PREV = f"lag(close, 1) OVER {O}"
SET20 = {
    "ROC0": "(close - open) / open", "ROC1": f"close / {PREV} - 1",
    **{f"ROC{w}": f"(close - lag(close, {w}) OVER {O}) / lag(close, {w}) OVER {O}" for w in (5, 10, 20)},
    **{f"VRATIO{w}": f"volume / avg(volume) OVER {W(w)}" for w in (5, 10)},
    **{f"VOLATILITY{w}": f"stddev_samp(close) OVER {W(w)} / close" for w in (5, 10)},
    **{f"RSV{w}": RSV.format(w=W(w)) for w in (5, 10)},
    "VSTD5_RATIO": f"stddev_samp(volume) OVER {W(5)} / avg(volume) OVER {W(5)}", "RANGE": "(high - low) / open",
    "RET_VOL5": f"stddev_samp(c1) OVER {W(5)}", "HIGH_RATIO5": f"close / max(high) OVER {W(5)} - 1", "LOW_RATIO5": f"close / min(low) OVER {W(5)} - 1",
    "SHADOW_RATIO": "(high - close) / (close - low + 1e-12)", "BODY_RATIO": "(close - open) / (high - low + 1e-12)",
    "MA_RATIO5_10": f"avg(close) OVER {W(5)} / avg(close) OVER {W(10)} - 1", "MA_RATIO10_20": f"avg(close) OVER {W(10)} / avg(close) OVER {W(20)} - 1",
}
STEPS = NUMBERED + f""", steps AS (SELECT *, close / {PREV} - 1 AS c1, close - {PREV} AS dc, volume - lag(volume) OVER {O} AS dv,
  close / {PREV} AS cr, ln(volume / lag(volume) OVER {O} + 1) AS vr, ln(volume + 1) AS lv, close > {PREV} AS up, close < {PREV} AS down FROM numbered)"""


def large_as_log(c):
    """Ratios on flat bars reach 1e12 and more, beyond the compared digits: above 1e6 the signed logarithm is shown."""
    return F.when(F.abs(c) > 1e6, F.signum(c) * F.log(F.abs(c))).otherwise(c)


def shown(e):
    return f"CASE WHEN abs({e}) > 1e6 THEN sign({e}) * ln(abs({e})) ELSE {e} END"


factor_query("panel_set_20", catalogue.set_20, {n: shown(e) for n, e in SET20.items()}, STEPS, "steps", shown=large_as_log)

CANDLE = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
    "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "vwap / close",
}


def family_sql(w: int) -> dict[str, str]:
    win = W(w)
    lists = f"list({{}}) OVER {win}"
    top = f"list_position({lists.format('high')}, max(high) OVER {win})"
    low = f"list_position({lists.format('low')}, min(low) OVER {win})"
    flag = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) OVER {win}"
    rank = f"(len(list_filter({lists.format('close')}, lambda v: v < close)) + (len(list_filter({lists.format('close')}, lambda v: v = close)) + 1) / 2.0) / len({lists.format('close')})"
    corr = lambda a, b: f"CASE WHEN count({a}) OVER {win} >= 2 AND stddev_pop({a}) OVER {win} > 1e-9 AND stddev_pop({b}) OVER {win} > 1e-9 THEN corr({a}, {b}) OVER {win} END"
    out = {
        "ROC": f"lag(close, {w}) OVER {O} / close", "MA": f"avg(close) OVER {win} / close", "STD": f"stddev_samp(close) OVER {win} / close",
        "BETA": f"CASE WHEN pos > 1 THEN regr_slope(close, pos) OVER {win} / close END",
        "RSQR": f"CASE WHEN pos > 1 THEN regr_r2(close, pos) OVER {win} END",
        "RESI": f"CASE WHEN pos > 1 THEN (close - regr_slope(close, pos) OVER {win} * pos - regr_intercept(close, pos) OVER {win}) / close END",
        "MAX": f"max(high) OVER {win} / close", "MIN": f"min(low) OVER {win} / close",
        "QTLU": f"quantile_cont(close, 0.8) OVER {win} / close", "QTLD": f"quantile_cont(close, 0.2) OVER {win} / close",
        "RANK": rank, "RSV": RSV.format(w=win), "IMAX": f"{top} / {w}", "IMIN": f"{low} / {w}", "IMXD": f"({top} - {low}) / {w}",
        "CORR": corr("close", "lv"), "CORD": corr("cr", "vr"),
        "CNTP": flag("up"), "CNTN": flag("down"), "CNTD": f"{flag('up')} - {flag('down')}",
        "VMA": f"avg(volume) OVER {win} / (volume + 1e-12)", "VSTD": f"stddev_samp(volume) OVER {win} / (volume + 1e-12)",
        "WVMA": f"stddev_samp(abs(c1) * volume) OVER {win} / (avg(abs(c1) * volume) OVER {win} + 1e-12)",
    }
    for d, (a, b, c) in (("dc", ("SUMP", "SUMN", "SUMD")), ("dv", ("VSUMP", "VSUMN", "VSUMD"))):
        up, down = f"sum(CASE WHEN {d} IS NOT NULL THEN greatest({d}, 0) END) OVER {win}", f"sum(CASE WHEN {d} IS NOT NULL THEN greatest(-{d}, 0) END) OVER {win}"
        total = f"(sum(abs({d})) OVER {win} + 1e-12)"
        out.update({a: f"{up} / {total}", b: f"{down} / {total}", c: f"({up} - {down}) / {total}"})
    return {f"{k}{w}": shown(e) for k, e in out.items()}


SET158 = {**{n: shown(e) for n, e in CANDLE.items()}, **{k: e for w in (5, 10, 20, 30, 60) for k, e in family_sql(w).items()}}
factor_query("panel_set_158", catalogue.set_158, SET158, STEPS, "steps", 5, large_as_log)
MULTI = {n: shown(CANDLE[n]) for n in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")}
for _w in (5, 10, 20, 30, 60):
    MULTI.update({k: e for k, e in family_sql(_w).items() if k.rstrip("0123456789") in catalogue.MULTI_FAMILIES})
for _w in (3, 7, 15, 40, 120):
    MULTI.update({k: e for k, e in family_sql(_w).items() if k.rstrip("0123456789") in catalogue.MULTI_FAMILIES[:3]})
factor_query("panel_set_multi", catalogue.set_multi, MULTI, STEPS, "steps", 5, large_as_log)


@query("panel_factor_job", f"""{BARS} SELECT {SQL_KEYS}, {r('(close - open) / open', 'gap')}, {r(f'avg((close - open) / open) OVER {W(4)}', 'smooth')} FROM panel""")
def factor_job_query(spark, sf):
    gap = lambda: p.expression("(close - open) / open")
    wanted = {"gap": gap, "smooth": lambda: p.ts_mean(gap(), 4), "ahead": lambda: p.delay("close", -1)}
    out, problems = factor_job(bars(spark, sf), wanted, scratch(spark, "factors"), sf)
    if list(problems) != ["ahead"]:
        raise AssertionError(problems)
    return tidy(text_date(out), KEYS, ["gap", "smooth"])


@query("panel_quotes_return", f"{BARS} SELECT {SQL_KEYS}, {r(f'coalesce(close / nullif({PREV}, 0) - 1, 0)', 'ret')} FROM panel")
def quotes_return(spark, sf):
    return tidy(text_date(p.with_return(bars(spark, sf))), KEYS, ["ret"])


@query("panel_dedupe_last", """
SELECT l_suppkey AS instrument, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS datetime,
  arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS price,
  arg_max(l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS quantity
FROM lineitem GROUP BY 1, 2""")
def dedupe_last(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").cast("string").alias("datetime"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    return p.dedupe_last(raw, ["l_orderkey", "l_linenumber", "l_partkey", "price"]).select("instrument", "datetime", "price", "quantity")


@query("panel_asof_align", f"""{BARS}, series AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_discount) AS level FROM lineitem GROUP BY 1)
SELECT instrument, CAST(datetime AS VARCHAR) AS datetime, {r('close * s.level', 'v')} FROM panel ASOF LEFT JOIN series s ON panel.datetime >= s.d""")
def asof_align(spark, sf):
    series = table(spark, sf, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("datetime")).agg(F.avg("l_discount").alias("level"))
    out = p.align_as_of(bars(spark, sf).select(*KEYS, "close"), series, "level")
    return tidy(text_date(out.withColumn("v", F.col("close") * F.col("level"))), KEYS, ["v"])


@query("panel_key_align", f"""{BARS}, other AS (SELECT * FROM panel WHERE volume >= 50)
SELECT a.instrument, CAST(a.datetime AS VARCHAR) AS datetime, {r('a.close - b.close', 'v')} FROM panel a LEFT JOIN other b USING (instrument, datetime)""")
def key_align(spark, sf):
    b = bars(spark, sf)
    right = b.where("volume >= 50").select(*KEYS, F.col("close").alias("other"))
    out = p.align_on_keys(b.select(*KEYS, "close"), right).withColumn("v", F.col("close") - F.col("other"))
    return tidy(text_date(out), KEYS, ["v"])


def signal_and_label(spark, sf):
    """Signal: negative five-week price change; label: next return, capped bars apart."""
    made = p.evaluate(bars(spark, sf), {"signal": p.delta("volume", 5), "label": p.delta("volume", 2) - p.delay("volume", 3), "thin": p.column("thin"), "close": p.column("close")})
    return made


SIGNAL = f"""{BARS}, s AS (SELECT instrument, datetime, thin, close, volume, volume - lag(volume, 5) OVER {O} AS signal,
  volume - lag(volume, 2) OVER {O} - lag(volume, 3) OVER {O} AS label FROM panel)"""


@query("backtest_align_features_labels", f"""{SIGNAL} SELECT a.instrument, CAST(a.datetime AS VARCHAR) AS datetime, a.signal, CAST(b.label AS DOUBLE) AS label
FROM (SELECT * FROM s WHERE signal IS NOT NULL) a JOIN (SELECT * FROM s WHERE label IS NOT NULL AND close > 0) b USING (instrument, datetime)""")
def align_features_labels(spark, sf):
    s = signal_and_label(spark, sf)
    out = ev.align_features_labels(s.where("signal is not null").select(*KEYS, "signal"), s.where("label is not null and close > 0").select(*KEYS, "label"))
    return text_date(out).select(*KEYS, "signal", "label")


@query("backtest_rank_normalise", f"""{SIGNAL}, f AS (SELECT *, coalesce(signal, 0) AS sig, coalesce(thin, 0) AS th, count(*) OVER {D} AS n FROM s),
g AS (SELECT *, CASE WHEN n > 1 THEN {RANK_SQL.format(x='sig')} - 0.5 ELSE 0 END AS fs, CASE WHEN n > 1 THEN {RANK_SQL.format(x='th')} - 0.5 ELSE 0 END AS ft FROM f),
h AS (SELECT *, count(*) OVER {D} AS m FROM g WHERE label IS NOT NULL)
SELECT instrument, CAST(datetime AS VARCHAR) AS datetime, {r('fs', 'signal')}, {r('ft', 'thin')}, {r('CASE WHEN m > 1 THEN ' + RANK_SQL.format(x='label') + ' - 0.5 ELSE 0 END', 'label')} FROM h""")
def rank_normalise(spark, sf):
    out = ev.prepare_training_panel(signal_and_label(spark, sf), ["signal", "thin"], "label")
    return tidy(text_date(out), KEYS, ["signal", "thin", "label"])


IC = f"""{SIGNAL}, b AS (SELECT * FROM s WHERE signal IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, {RANK_SQL.format(x='signal')} AS rs, {RANK_SQL.format(x='label')} AS rl FROM b),
daily AS (SELECT datetime, CASE WHEN stddev_pop(signal) > 0 AND stddev_pop(label) > 0 THEN corr(signal, label) END AS ic,
  CASE WHEN stddev_pop(rs) > 1e-12 AND stddev_pop(rl) > 1e-12 THEN corr(rs, rl) END AS rank_ic FROM k GROUP BY 1)"""


@query("backtest_daily_ic", f"{IC} SELECT CAST(datetime AS VARCHAR) AS datetime, {r('ic', 'ic')}, {r('rank_ic', 'rank_ic')} FROM daily")
def daily_ic(spark, sf):
    return tidy(text_date(ev.daily_ic(signal_and_label(spark, sf), "signal", "label")), ["datetime"], ["ic", "rank_ic"])


@query("backtest_ic_summary", f"""{IC} SELECT {r('avg(ic)', 'ic')}, {r('avg(ic) / stddev_samp(ic)', 'icir')}, {r('avg(rank_ic)', 'rank_ic')}, {r('avg(rank_ic) / stddev_samp(rank_ic)', 'rank_icir')} FROM daily""")
def ic_summary(spark, sf):
    return tidy(ev.ic_summary(ev.daily_ic(signal_and_label(spark, sf), "signal", "label")), [], ["ic", "icir", "rank_ic", "rank_icir"])


def _corr_sql(a, b):
    return f"CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END"


@query("backtest_factor_dedupe", f"""{BARS}, f AS (SELECT *, close * 2 + 1 AS n1, volume - open AS n2, high AS n3 FROM panel),
daily AS (SELECT datetime, {', '.join(f"{_corr_sql(o, n)} AS {o}_{n}" for o in ('close', 'volume') for n in ('n1', 'n2', 'n3'))} FROM f GROUP BY 1),
m AS (SELECT {', '.join(f'avg({o}_{n}) AS {o}_{n}' for o in ('close', 'volume') for n in ('n1', 'n2', 'n3'))} FROM daily)
SELECT * FROM (SELECT 'n1' AS new_factor, round(greatest(close_n1, volume_n1), 6) AS max_corr FROM m UNION ALL SELECT 'n2', round(greatest(close_n2, volume_n2), 6) FROM m
UNION ALL SELECT 'n3', round(greatest(close_n3, volume_n3), 6) FROM m) WHERE max_corr < 0.99""")
def factor_dedupe(spark, sf):
    b = bars(spark, sf).withColumns({"n1": F.col("close") * 2 + 1, "n2": F.col("volume") - F.col("open"), "n3": F.col("high")})
    kept = ev.factors_to_keep(ev.correlation_with_library(b, ["close", "volume"], ["n1", "n2", "n3"]))
    return kept.select("new_factor", F.round("max_corr", 6).alias("max_corr"))


@query("backtest_factor_agreement", f"""{BARS}, a AS (SELECT datetime, instrument, thin AS a, 1 AS in_a FROM panel WHERE volume >= 10),
b AS (SELECT datetime, instrument, low AS b, 1 AS in_b FROM panel WHERE volume < 90), j AS (SELECT * FROM a FULL JOIN b USING (datetime, instrument))
SELECT {r('least(count(in_a), count(in_b)) / greatest(count(in_a), count(in_b))', 'row_ratio')}, {r('count(CASE WHEN in_a = 1 AND in_b = 1 THEN 1 END) / count(*)', 'key_similarity')},
  CAST(count(CASE WHEN in_a = 1 AND a IS NULL THEN 1 END) = count(CASE WHEN in_b = 1 AND b IS NULL THEN 1 END) AS INT) AS same_missing,
  {r('count(CASE WHEN abs(a - b) < 1e-6 THEN 1 END) / count(*)', 'equal_ratio')}, CAST(0 AS BIGINT) AS infinite FROM j""")
def factor_agreement(spark, sf):
    b = bars(spark, sf)
    out = ev.agreement(b.where("volume >= 10").select(*KEYS, F.col("thin").alias("value")), b.where("volume < 90").select(*KEYS, F.col("low").alias("value")))
    return out.select(*[F.round(c, 6).alias(c) if c in ("row_ratio", "key_similarity", "equal_ratio") else F.col(c) for c in out.columns])


@query("backtest_daily_spacing", """SELECT CAST(count(*) = 0 AS INT) AS daily FROM (SELECT DISTINCT ts FROM events) a
JOIN (SELECT DISTINCT ts + INTERVAL 1 MINUTE AS ts FROM events) b USING (ts)""")
def daily_spacing(spark, sf):
    return ev.is_daily(table(spark, sf, "events").select(F.col("ts").alias("datetime")))


TOPK = f"""{SIGNAL}, rets AS (SELECT *, (close - lag(close) OVER {O}) / 100000 AS ret FROM s),
picked AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY signal DESC, instrument) AS rk FROM rets WHERE signal IS NOT NULL),
port AS (SELECT datetime, avg(ret) AS ret, count(*) AS picks FROM picked WHERE rk <= 20 GROUP BY 1),
bench AS (SELECT datetime, avg(ret) AS bench, 0.0001 AS cost FROM rets GROUP BY 1),
ex AS (SELECT port.datetime, coalesce(ret, 0) - coalesce(bench, 0) - coalesce(cost, 0) AS x FROM port LEFT JOIN bench USING (datetime))"""


def portfolio(spark, sf):
    s = p.evaluate(bars(spark, sf), {"signal": p.delta("volume", 5), "ret": p.delta("close") / 100000})
    port = ev.daily_top_k(s, 20)
    bench = s.groupBy("datetime").agg(F.avg("ret").alias("bench"), F.lit(0.0001).alias("cost"))
    return port, bench


@query("backtest_daily_top_k", f"{TOPK} SELECT CAST(datetime AS VARCHAR) AS datetime, {r('ret', 'ret')}, picks FROM port")
def daily_top_k(spark, sf):
    return tidy(text_date(portfolio(spark, sf)[0]), ["datetime", "picks"], ["ret"])


@query("backtest_cumulative_excess", f"""{TOPK} SELECT CAST(datetime AS VARCHAR) AS datetime, {r('x', 'daily_excess_return')}, {r('sum(x) OVER (ORDER BY datetime)', 'cumulative_excess_return')} FROM ex""")
def cumulative_excess(spark, sf):
    out = ev.cumulative(ev.excess_return(*portfolio(spark, sf)))
    return tidy(text_date(out), ["datetime"], ["daily_excess_return", "cumulative_excess_return"])


@query("backtest_risk_summary", f"""{TOPK}, c AS (SELECT *, sum(x) OVER (ORDER BY datetime) AS cum FROM ex), d AS (SELECT *, cum - max(cum) OVER (ORDER BY datetime) AS drop_ FROM c)
SELECT {r('avg(x) * 238', 'annualized_return')}, {r('avg(x) / stddev_samp(x) * sqrt(238)', 'information_ratio')}, {r('min(drop_)', 'max_drawdown')}, {r('avg(x) * 238 / abs(min(drop_))', 'calmar_ratio')} FROM d""")
def risk_summary(spark, sf):
    return tidy(ev.risk_summary(ev.excess_return(*portfolio(spark, sf))), [], ["annualized_return", "information_ratio", "max_drawdown", "calmar_ratio"])


@query("backtest_mask_bad_prices", f"""{SIGNAL}, pr AS (SELECT instrument, datetime, CASE WHEN volume < 10 THEN 0 ELSE thin END AS px FROM panel WHERE volume <> 25)
SELECT s.instrument, CAST(s.datetime AS VARCHAR) AS datetime, CASE WHEN coalesce(px = 0 OR (px IS NULL AND pr.instrument IS NOT NULL), false) THEN NULL ELSE signal END AS signal
FROM s LEFT JOIN pr USING (instrument, datetime)""")
def mask_bad_prices(spark, sf):
    b = bars(spark, sf)
    prices = b.where("volume <> 25").select(*KEYS, F.when(F.col("volume") < 10, F.lit(0.0)).otherwise(F.col("thin")).alias("close"))
    return text_date(p.mask_bad_prices(signal_and_label(spark, sf).select(*KEYS, "signal"), prices)).select(*KEYS, "signal")


@query("backtest_library_overlap", """
WITH lib AS (SELECT l_partkey || ':' || p_type AS subtree_key, CAST(l_quantity AS BIGINT) AS size, min(l_orderkey) AS library_factor FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
own AS (SELECT DISTINCT l_orderkey AS factor, l_partkey || ':' || p_type AS subtree_key, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
SELECT factor, size, subtree_key, library_factor FROM (SELECT own.factor, size, subtree_key, library_factor,
  row_number() OVER (PARTITION BY factor ORDER BY size DESC, subtree_key DESC) AS rk FROM own JOIN lib USING (subtree_key, size)) WHERE rk = 1""")
def library_overlap(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    rows = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("factor"), F.concat_ws(":", "l_partkey", "p_type").alias("subtree_key"), F.col("l_quantity").cast("bigint").alias("size"), "l_returnflag")
    return ev.library_overlap(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag <> 'R'").drop("l_returnflag"))


ROLL = ["avg_corr", "avg_format", "avg_run", "max_corr", "max_value", "avg_value"]


@query("backtest_benchmark_rollup", f"""
WITH runs AS (SELECT l_suppkey AS factor, p_type AS category, l_returnflag AS difficulty, l_linestatus = 'F' AND l_linenumber = 1 AS error,
  CASE WHEN l_linenumber > 1 THEN CASE WHEN l_tax < 0.08 THEN 1.0 ELSE 0.5 END END AS row_count, CASE WHEN l_linenumber > 1 THEN 1.0 END AS key_match,
  CASE WHEN l_linenumber > 1 THEN l_quantity / 50 END AS equal_ratio, CASE WHEN l_linenumber > 2 THEN l_discount * 10 END AS corr FROM lineitem JOIN part ON l_partkey = p_partkey),
sh AS (SELECT *, (coalesce(row_count, 0) + coalesce(key_match, 0)) / 2 AS fmt, coalesce(corr, 0) AS co FROM runs),
per AS (SELECT CAST(factor AS VARCHAR) AS factor, category, difficulty, avg(CASE WHEN fmt = 1 THEN co END) AS avg_corr, avg(fmt) AS avg_format, avg(CASE WHEN error THEN 0.0 ELSE 1 END) AS avg_run,
  max(CASE WHEN fmt = 1 THEN co END) AS max_corr, max(equal_ratio) AS max_value, avg(equal_ratio * fmt) AS avg_value FROM sh GROUP BY 1, 2, 3),
alls AS (SELECT * FROM per UNION ALL SELECT '-', category, '-', {', '.join(f'avg({c})' for c in ROLL)} FROM per GROUP BY category UNION ALL SELECT '-', '-', 'Average', {', '.join(f'avg(coalesce({c}, 0))' for c in ROLL)} FROM per)
SELECT factor, category, difficulty, {', '.join(r(c, c) for c in ROLL)} FROM alls""")
def benchmark_rollup(spark, sf):
    later = F.col("l_linenumber") > 1
    runs = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("factor"), F.col("p_type").alias("category"), F.col("l_returnflag").alias("difficulty"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("error"),
        F.when(later, F.when(F.col("l_tax") < 0.08, 1.0).otherwise(0.5)).alias("row_count"), F.when(later, F.lit(1.0)).alias("key_match"),
        F.when(later, F.col("l_quantity") / 50).alias("equal_ratio"), F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 10).alias("corr"))
    return tidy(ev.benchmark_rollup(runs), ["factor", "category", "difficulty"], ROLL)


@query("backtest_best_and_latest", """SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS best_id, max(o_totalprice) AS best, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS latest_id FROM orders GROUP BY 1""")
def best_and_latest(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return ev.best_and_latest(o, "o_custkey", "o_totalprice", "o_orderdate")


@query("backtest_best_pairs", """WITH few AS (SELECT s_suppkey AS id, s_acctbal AS m FROM supplier)
SELECT a.id AS a, b.id AS b, round(a.m + b.m, 6) AS total FROM few a JOIN few b ON a.id < b.id ORDER BY total DESC, 1, 2 LIMIT 25""")
def best_pairs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("metric"))
    out = ev.best_pairs(s, "metric", 25)
    return out.withColumn("total", F.round("total", 6))


@query("panel_key_sets", f"""{BARS}, a AS (SELECT instrument, datetime FROM panel WHERE volume >= 40), b AS (SELECT instrument, datetime FROM panel WHERE volume < 60)
SELECT instrument, CAST(datetime AS VARCHAR) AS datetime FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def key_sets(spark, sf):
    b = bars(spark, sf)
    return text_date(b.where("volume >= 40").select(*KEYS).intersect(b.where("volume < 60").select(*KEYS)))

"""Panel factors on weekly supplier bars built from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.functions.numeric import rounded, rounded_double
from wardpanel.operators import catalogue, panel as p
from wardpanel.operators.order import group_rows, largest_group
from wardpanel.queries.registry import query, r, table


def bars(spark, sf) -> DataFrame:
    """(instrument, week) bars, one shuffle by instrument for them and for all windows over a series.

    A line is narrower than what an aggregate holds of a week, so lines are moved as they are.  Where a supplier has more lines than one
    task may sort, they first shrink to one row per week in the map-side aggregate.
    """
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.date_trunc("week", "l_shipdate").cast("date").alias("datetime"),
        "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey",
    )
    li = li if largest_group(li, ["instrument"]) > group_rows(li) else li.repartition("instrument")
    li = li.select(
        "instrument", "datetime", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"),
    )
    out = li.groupBy("instrument", "datetime").agg(
        F.min_by("price", "k").alias("open"), F.max_by("price", "k").alias("close"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
    )
    return out.withColumn("thin", F.when(F.col("volume") >= 20, F.col("low")))


BARS = """
WITH panel AS (
  SELECT *, CASE WHEN volume >= 20 THEN low END AS thin FROM (
    SELECT l_suppkey AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime,
      arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
      arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
      max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
      sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap
    FROM lineitem GROUP BY 1, 2))
"""


def W(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


O = "(PARTITION BY instrument ORDER BY datetime)"
ALL = "(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL_KEYS = "instrument, CAST(datetime AS VARCHAR) AS datetime"


def factor_query(name: str, factors, sql_columns: dict[str, str], ctes: str = "", source: str = "panel", digits: int = 6, shown=None):
    """Register a factor set; `factors` is built lazily, `sql_columns` are the SQL twins.

    `shown` maps each value before it is rounded.  The values then go through one function over an array: written out for every
    factor of a large set, the expressions are more code than the JVM compiles.
    """

    cols = ", ".join(r(e, n, digits) for n, e in sql_columns.items())

    def run(spark, sf):
        made = factors()
        out = p.evaluate(bars(spark, sf), made)
        if shown is not None:
            values = F.transform(F.array(*[F.col(n).cast("double") for n in made]), shown)
            values = F.transform(values, lambda c: rounded_double(c, digits)).alias("__values")
            out = out.select("instrument", F.col("datetime").cast("string").alias("datetime"), values)
            return out.select("instrument", "datetime", *[F.col("__values")[i].alias(n) for i, n in enumerate(made)])
        return out.select(
            "instrument", F.col("datetime").cast("string").alias("datetime"),
            *[rounded(F.col(n).cast("double"), digits).alias(n) for n in made],
        )

    query(name, f"{BARS}{ctes} SELECT {SQL_KEYS}, {cols} FROM {source}")(run)


factor_query("panel_delta", lambda: {"v": p.delta("close"), "v3": p.delta("close", 3)},
             {"v": f"close - lag(close, 1) OVER {O}", "v3": f"close - lag(close, 3) OVER {O}"})
factor_query("panel_delay", lambda: {"v": p.delay("close"), "v4": p.delay("thin", 4)},
             {"v": f"lag(close, 1) OVER {O}", "v4": f"lag(thin, 4) OVER {O}"})
factor_query("panel_rolling_basic",
             lambda: {"mean": p.ts_mean("thin"), "total": p.ts_sum("thin"), "top": p.ts_max("thin"), "low": p.ts_min("thin", 10)},
             {"mean": f"avg(thin) OVER {W(5)}", "total": f"sum(thin) OVER {W(5)}", "top": f"max(thin) OVER {W(5)}", "low": f"min(thin) OVER {W(10)}"})
factor_query("panel_median", lambda: {"v": p.ts_median("thin", 5)}, {"v": f"quantile_cont(thin, 0.5) OVER {W(5)}"})
factor_query("panel_std_var",
             lambda: {"std": p.ts_std("thin"), "var": p.ts_var("thin"), "var0": p.ts_var("thin", 5, 0), "var2": p.ts_var("thin", 6, 2)},
             {"std": f"stddev_samp(thin) OVER {W(20)}", "var": f"var_samp(thin) OVER {W(5)}", "var0": f"var_pop(thin) OVER {W(5)}",
              "var2": f"CASE WHEN count(thin) OVER {W(6)} > 2 THEN var_pop(thin) OVER {W(6)} * count(thin) OVER {W(6)} / (count(thin) OVER {W(6)} - 2) END"}, digits=4)

LISTS = f""", lists AS (
  SELECT *, list_filter(list(thin) OVER {W(6)}, lambda v: v IS NOT NULL) AS a, list(thin) OVER {W(6)} AS raw FROM panel),
moments AS (SELECT *, len(a) AS n, list_avg(a) AS m FROM lists),
centred AS (SELECT *, list_avg(list_transform(a, lambda v: (v - m) ** 2)) AS m2, list_avg(list_transform(a, lambda v: (v - m) ** 3)) AS m3,
  list_avg(list_transform(a, lambda v: (v - m) ** 4)) AS m4 FROM moments)"""
factor_query("panel_skew_kurt", lambda: {"skew": p.ts_skew("thin", 6), "kurt": p.ts_kurt("thin", 6)},
             {"skew": "CASE WHEN n >= 3 AND m2 > 0 THEN m3 / m2 ** 1.5 END", "kurt": "CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 END"},
             LISTS, "centred")
factor_query("panel_ts_rank", lambda: {"v": p.ts_rank("thin", 6)},
             {"v": "CASE WHEN thin IS NOT NULL THEN (len(list_filter(a, lambda v: v < thin)) + (len(list_filter(a, lambda v: v = thin)) + 1) / 2.0) / len(a) END"},
             LISTS, "lists")
factor_query("panel_quantile",
             lambda: {"q8": p.ts_quantile("thin", 7, 0.8), "swapped": p.ts_quantile("thin", 0.2, 7), "roll": p.percentile("thin", 0.3, 9), "whole": p.percentile("thin", 0.75)},
             {"q8": f"quantile_cont(thin, 0.8) OVER {W(7)}", "swapped": f"quantile_cont(thin, 0.2) OVER {W(7)}",
              "roll": f"quantile_cont(thin, 0.3) OVER {W(9)}", "whole": "quantile_cont(thin, 0.75) OVER (PARTITION BY instrument)"})
FULL = "len(a) = len(raw)"
factor_query("panel_argmax_argmin", lambda: {"hi": p.ts_argmax("thin", 6), "lo": p.ts_argmin("thin", 6)},
             {"hi": f"CASE WHEN {FULL} THEN len(a) - list_position(a, list_max(a)) END", "lo": f"CASE WHEN {FULL} THEN len(a) - list_position(a, list_min(a)) END"},
             LISTS, "lists")
factor_query("panel_highday_lowday", lambda: {"hi": p.highday("thin", 6), "lo": p.lowday("thin", 6)},
             {"hi": f"CASE WHEN {FULL} THEN len(a) - list_position(a, list_max(a)) + 1 END", "lo": f"CASE WHEN {FULL} THEN len(a) - list_position(a, list_min(a)) + 1 END"},
             LISTS, "lists")
NUMBERED = f", numbered AS (SELECT *, CAST(row_number() OVER {O} AS DOUBLE) AS pos FROM panel)"
factor_query("panel_corr_cov",
             lambda: {"c": p.ts_corr("close", "volume", 8), "s": p.ts_covariance("close", "volume", 8),
                      "cseq": p.ts_corr("close", p.sequence(6)), "sseq": p.ts_covariance("close", p.sequence(6))},
             {"c": f"CASE WHEN pos > 1 THEN corr(close, volume) OVER {W(8)} END", "s": f"CASE WHEN pos > 1 THEN covar_samp(close, volume) OVER {W(8)} END",
              "cseq": f"CASE WHEN pos > 1 THEN corr(close, pos) OVER {W(6)} END", "sseq": f"CASE WHEN pos > 1 THEN covar_samp(close, pos) OVER {W(6)} END"},
             NUMBERED, "numbered", 4)
factor_query("panel_ts_zscore", lambda: {"v": p.ts_zscore("close", 10)},
             {"v": f"CASE WHEN stddev_samp(close) OVER {W(10)} > 0 THEN (close - avg(close) OVER {W(10)}) / stddev_samp(close) OVER {W(10)} END"})
factor_query("panel_mad", lambda: {"v": p.ts_mad("thin", 6)},
             {"v": f"CASE WHEN {FULL} THEN list_median(list_transform(a, lambda v: abs(v - list_median(a)))) END"}, LISTS, "lists")
factor_query("panel_pctchange", lambda: {"v": p.ts_pctchange("thin", 2)},
             {"v": f"coalesce(thin / lag(thin, 2) OVER {O} - 1, 0)"})


def ewm_sql(x: str, alpha: str) -> str:
    d = f"(1 - {alpha})"
    return f"(sum({x} * {d} ** (-pos)) OVER {ALL} / sum(CASE WHEN {x} IS NOT NULL THEN {d} ** (-pos) END) OVER {ALL})"


factor_query("panel_sma", lambda: {"plain": p.sma("thin", 7), "smooth": p.sma("thin", 6, 2)},
             {"plain": f"avg(thin) OVER {W(7)}", "smooth": ewm_sql("thin", "(2 / 6.0)")}, NUMBERED, "numbered")
factor_query("panel_ema", lambda: {"e5": p.ema("thin", 5), "e12": p.ema("thin", 12)},
             {"e5": ewm_sql("thin", "(2 / 6.0)"), "e12": ewm_sql("thin", "(2 / 13.0)")}, NUMBERED, "numbered")


def weights_sql(ws: list[float]) -> str:
    return "[" + ", ".join(repr(w) + "::DOUBLE" for w in ws) + "]"


WMA = weights_sql([0.9**i for i in range(6)][::-1])
DECAY = weights_sql([i / 21 for i in range(1, 7)])
DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * {w}[i]))"
factor_query("panel_wma", lambda: {"v": p.wma("thin", 6)},
             {"v": f"CASE WHEN {FULL} THEN {DOT.format(w=WMA)} / list_sum({WMA}[1:len(a)]) END"}, LISTS, "lists")
factor_query("panel_decaylinear", lambda: {"v": p.decaylinear("thin", 6)},
             {"v": f"CASE WHEN {FULL} THEN {DOT.format(w=DECAY)} END"}, LISTS, "lists")
factor_query("panel_count_sumif", lambda: {"n": p.count(p.gt("close", "open")), "s": p.sumif("volume", 8, p.gt("close", "open")), "ac": p.sumac("volume")},
             {"n": f"sum(CASE WHEN close > open THEN 1.0 ELSE 0 END) OVER {W(20)}", "s": f"sum(CASE WHEN close > open THEN volume ELSE 0 END) OVER {W(8)}",
              "ac": f"sum(volume) OVER {W(10)}"})
factor_query("panel_prod", lambda: {"v": p.prod(p.column("close") / "open", 6), "scaled": p.prod("close", 0.5)},
             {"v": f"product(close / open) OVER {W(6)}", "scaled": "close * 0.5"})
READY = f"count(*) OVER {W(8)} = 8"
factor_query("panel_regbeta", lambda: {"seq": p.regbeta("close", p.sequence(8)), "pair": p.regbeta("close", "volume", 8)},
             {"seq": f"CASE WHEN {READY} THEN regr_slope(close, pos) OVER {W(8)} END", "pair": f"CASE WHEN {READY} THEN regr_slope(close, volume) OVER {W(8)} END"},
             NUMBERED, "numbered")
factor_query("panel_regresi", lambda: {"seq": p.regresi("close", p.sequence(8)), "pair": p.regresi("close", "volume", 8)},
             {"seq": f"CASE WHEN {READY} THEN close - (regr_slope(close, pos) OVER {W(8)} * pos + regr_intercept(close, pos) OVER {W(8)}) END",
              "pair": f"CASE WHEN {READY} THEN close - (regr_slope(close, volume) OVER {W(8)} * volume + regr_intercept(close, volume) OVER {W(8)}) END"},
             NUMBERED, "numbered", 4)
factor_query("panel_macd", lambda: {"v": p.macd("close")}, {"v": f"{ewm_sql('close', '(2 / 13.0)')} - {ewm_sql('close', '(2 / 27.0)')}"}, NUMBERED, "numbered")
MOVES = NUMBERED + f""", moves AS (SELECT *, close - lag(close) OVER {O} AS d FROM numbered),
sides AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS down FROM moves),
ewms AS (SELECT *, {ewm_sql('up', '(2 / 15.0)')} AS eu, {ewm_sql('down', '(2 / 15.0)')} AS ed FROM sides)"""
factor_query("panel_rsi", lambda: {"v": p.rsi("close")}, {"v": "CASE WHEN ed <> 0 THEN 100 - 100 / (1 + eu / ed) WHEN eu > 0 THEN 100 END"}, MOVES, "ewms")
BANDS = NUMBERED + f""", banded AS (SELECT *, CAST(volume % 13 + 1 AS INTEGER) AS w, list(thin) OVER {W(20)} AS arr FROM numbered),
cut AS (SELECT *, list_filter(arr[greatest(len(arr) - w + 1, 1):len(arr)], lambda v: v IS NOT NULL) AS tail FROM banded)"""
factor_query("panel_bollinger",
             lambda: {"mid": p.bb_middle("close", 20), "up": p.bb_upper("close", 20), "low": p.bb_lower("close", 20),
                      "vmid": p.bb_middle("thin", p.elementwise("w", lambda c: F.pmod(c, F.lit(13.0)) + 1, "volume"), 20),
                      "vup": p.bb_upper("thin", p.elementwise("w", lambda c: F.pmod(c, F.lit(13.0)) + 1, "volume"), 20)},
             {"mid": f"avg(close) OVER {W(20)}", "up": f"avg(close) OVER {W(20)} + stddev_samp(close) OVER {W(20)}", "low": f"avg(close) OVER {W(20)} - stddev_samp(close) OVER {W(20)}",
              "vmid": "list_avg(tail)", "vup": "list_avg(tail) + CASE WHEN len(tail) > 1 THEN list_stddev_samp(tail) END"}, BANDS, "cut", 5)
LONG = f", held AS (SELECT *, list(thin) OVER {W(250)} AS raw, list_filter(list(thin) OVER {ALL}, lambda v: v IS NOT NULL) AS past, CAST(volume * 3 AS INTEGER) + 1 AS w, list(thin) OVER {ALL} AS whole FROM panel), " \
    "wide AS (SELECT *, list_filter(raw, lambda v: v IS NOT NULL) AS a, list_filter(whole[greatest(len(whole) - w + 1, 1):len(whole)], lambda v: v IS NOT NULL) AS own FROM held)"
factor_query("panel_long_windows",
             lambda: {"mid": p.ts_median("thin", 250), "q9": p.ts_quantile("thin", 250, 0.9), "place": p.ts_rank("thin", 250),
                      "own": p.bb_middle("thin", p.elementwise("w3", lambda c: c * 3 + 1, "volume")), "known": p.last_known("thin")},
             {"mid": f"quantile_cont(thin, 0.5) OVER {W(250)}", "q9": f"quantile_cont(thin, 0.9) OVER {W(250)}",
              "place": "CASE WHEN thin IS NOT NULL THEN (len(list_filter(a, lambda v: v < thin)) + (len(list_filter(a, lambda v: v = thin)) + 1) / 2.0) / len(a) END",
              "own": "list_avg(own)", "known": "past[len(past)]"}, LONG, "wide")
factor_query("panel_next_label", lambda: {"label": p.next_return_label()}, {"label": f"lead(close, 2) OVER {O} / lead(close, 1) OVER {O} - 1"})

D = "(PARTITION BY datetime)"
factor_query("panel_cross_section_stats", lambda: {"mean": p.cs_mean("thin"), "std": p.cs_std("thin"), "mid": p.cs_median("thin"), "top": p.cs_max("thin"), "low": p.cs_min("thin")},
             {"mean": f"avg(thin) OVER {D}", "std": f"stddev_samp(thin) OVER {D}", "mid": f"median(thin) OVER {D}", "top": f"max(thin) OVER {D}", "low": f"min(thin) OVER {D}"})
CENTRED = """, dm AS (SELECT *, avg(thin) OVER (PARTITION BY datetime) AS m, count(thin) OVER (PARTITION BY datetime) AS n FROM panel),
mm AS (SELECT *, avg((thin - m) ** 2) OVER (PARTITION BY datetime) AS m2, avg((thin - m) ** 3) OVER (PARTITION BY datetime) AS m3, avg((thin - m) ** 4) OVER (PARTITION BY datetime) AS m4 FROM dm)"""
factor_query("panel_cross_section_skew_kurt", lambda: {"skew": p.cs_skew("thin"), "kurt": p.cs_kurt("thin")},
             {"skew": "CASE WHEN n >= 3 AND m2 > 0 THEN m3 / m2 ** 1.5 END", "kurt": "CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 END"}, CENTRED, "mm")
RANK_SQL = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY datetime) END"
factor_query("panel_cross_section_rank", lambda: {"v": p.rank("thin"), "vol": p.rank("volume"), "nested": p.rank(p.ts_mean("volume", 3))},
             {"v": RANK_SQL.format(x="thin"), "vol": RANK_SQL.format(x="volume"), "nested": RANK_SQL.format(x="vm")},
             f", vm AS (SELECT *, avg(volume) OVER {W(3)} AS vm FROM panel)", "vm")
factor_query("panel_cross_section_zscore", lambda: {"v": p.zscore("thin")},
             {"v": f"CASE WHEN stddev_samp(thin) OVER {D} > 0 THEN (thin - avg(thin) OVER {D}) / stddev_samp(thin) OVER {D} END"})
factor_query("panel_cross_section_scale", lambda: {"v": p.scale("thin"), "v2": p.scale(p.delta("close"), 100.0)},
             {"v": f"thin / sum(abs(thin)) OVER {D}", "v2": f"100 * d / nullif(sum(abs(d)) OVER {D}, 0)"}, f", dd AS (SELECT *, close - lag(close) OVER {O} AS d FROM panel)", "dd")
factor_query("panel_math", lambda: {"a": p.absolute(p.column("open") - "close"), "s": p.sign(p.column("open") - "close"), "e": p.exp(p.column("close") / -1000.0),
                                    "q": p.sqrt("volume"), "f": p.floor("close"), "l": p.log("volume"), "i": p.inv("volume"), "pw": p.power("volume", 2)},
             {"a": "abs(open - close)", "s": "sign(open - close)", "e": "exp(close / -1000.0)", "q": "sqrt(volume)", "f": "floor(close)", "l": "ln(volume + 1)", "i": "1 / volume", "pw": "volume ** 2"})
factor_query("panel_max_min", lambda: {"m2": p.maximum("open", "thin"), "m3": p.maximum("open", "close", "vwap"), "n2": p.minimum("open", "thin"), "n3": p.minimum("open", "close", "vwap")},
             {"m2": "CASE WHEN thin IS NOT NULL THEN greatest(open, thin) END", "m3": "greatest(open, close, vwap)", "n2": "CASE WHEN thin IS NOT NULL THEN least(open, thin) END", "n3": "least(open, close, vwap)"})
factor_query("panel_arithmetic", lambda: {"a": p.add("open", "thin"), "s": p.subtract("open", "thin"), "m": p.multiply("open", 0.5), "d": p.divide("open", "volume")},
             {"a": "open + thin", "s": "open - thin", "m": "open * 0.5", "d": "open / volume"})
factor_query("panel_logic", lambda: {"b": p.both(p.gt("open", "close"), p.gt("volume", 30)), "e": p.either(p.gt("open", "close"), p.gt("volume", 30)), "miss": p.both("thin", p.gt("volume", 30))},
             {"b": "CAST(open > close AND volume > 30 AS INT)", "e": "CAST(open > close OR volume > 30 AS INT)", "miss": "CAST(coalesce(thin <> 0, true) AND volume > 30 AS INT)"})
factor_query("panel_compare", lambda: {"g": p.gt("open", "thin"), "l": p.lt(1000.0, "close"), "ge": p.ge("open", "close"), "le": p.le("open", "close"), "q": p.eq("open", "close"), "n": p.ne("open", "thin")},
             {"g": "CAST(coalesce(open > thin, false) AS INT)", "l": "CAST(1000.0 < close AS INT)", "ge": "CAST(open >= close AS INT)", "le": "CAST(open <= close AS INT)",
              "q": "CAST(open = close AS INT)", "n": "CAST(coalesce(open <> thin, true) AS INT)"})
factor_query("panel_where", lambda: {"v": p.where(p.gt("open", "close"), "open", "volume")}, {"v": "CASE WHEN open > close THEN open ELSE volume END"})
factor_query("panel_filter", lambda: {"v": p.masked("thin", p.gt("volume", 40))}, {"v": "CASE WHEN volume > 40 THEN thin WHEN thin IS NOT NULL THEN 0 END"})
factor_query("panel_nested_expression",
             lambda: {"v": p.ts_max(p.rank("volume"), 4) - p.rank(p.ts_max(p.delta("volume", 2), 4)) / 2},
             {"v": "top - " + RANK_SQL.format(x="md") + " / 2"},
             f""", d1 AS (SELECT *, volume - lag(volume, 2) OVER {O} AS d, {RANK_SQL.format(x='volume')} AS rv FROM panel),
             d2 AS (SELECT *, max(rv) OVER {W(4)} AS top, max(d) OVER {W(4)} AS md FROM d1)""", "d2")

"""Judging factors and signals: information coefficients, agreement, returns, library overlap."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardpanel.functions.numeric import pair_corr
from wardpanel.operators.order import percent_ranks, running_totals, top_per_group
from wardpanel.operators.panel import INSTRUMENT, TIME

KEYS = [TIME, INSTRUMENT]


def align_features_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows present on both sides, numbers as double."""
    def doubles(df):
        return df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in KEYS])

    return doubles(features).join(doubles(labels), KEYS, "inner")


def rank_normalise(df: DataFrame, columns: Sequence[str], fill: bool) -> DataFrame:
    """Per-date percent rank minus 0.5; a date with one row gives 0.  `fill` turns null and infinity into 0 first."""
    out = df
    if fill:
        clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf), F.lit(0.0)).otherwise(F.col(c))
        out = out.withColumns({c: clean(c) for c in columns})
    sizes = out.groupBy(TIME).agg(F.count(F.lit(1)).alias("__rows"))
    out = percent_ranks(out, {c: f"__n_{c}" for c in columns}, [TIME])
    out = out.join(sizes, TIME)
    out = out.withColumns({c: F.when(F.col("__rows") > 1, F.col(f"__n_{c}") - 0.5).otherwise(F.lit(0.0)) for c in columns})
    return out.drop("__rows", *[f"__n_{c}" for c in columns])


def prepare_training_panel(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features normalised on all rows, rows without a label dropped, then labels normalised."""
    return rank_normalise(rank_normalise(df, features, True).where(F.col(label).isNotNull()), [label], False)


def daily_ic(df: DataFrame, signal: str, label: str) -> DataFrame:
    """Per date: correlation of values and of average-tie ranks, over rows where both are present."""
    both = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    ranked = percent_ranks(both, {signal: "__rs", label: "__rl"}, [TIME])
    return ranked.groupBy(TIME).agg(
        pair_corr(F.col(signal), F.col(label)).alias("ic"), pair_corr(F.col("__rs"), F.col("__rl")).alias("rank_ic")
    )


def ic_summary(daily: DataFrame) -> DataFrame:
    def ir(c):
        return F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c)).otherwise(F.lit(0.0))

    return daily.agg(
        F.avg("ic").alias("ic"), ir("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), ir("rank_ic").alias("rank_icir")
    )


def correlation_with_library(df: DataFrame, old: Sequence[str], new: Sequence[str], block: int = 200) -> DataFrame:
    """(new_factor, max_corr): mean over dates of the per-date correlation, maximum over old factors.

    All pairs are aggregates of one pass over the panel; nothing is joined to itself.
    """
    pairs = [(o, n) for o in old for n in new]
    parts = []
    for at in range(0, len(pairs), block):
        chunk = pairs[at : at + block]
        daily = df.groupBy(TIME).agg(*[pair_corr(F.col(o), F.col(n)).alias(f"c{i}") for i, (o, n) in enumerate(chunk)])
        means = daily.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(chunk))])
        entries = F.array(*[F.struct(F.lit(n).alias("new_factor"), F.col(f"c{i}").alias("corr")) for i, (_, n) in enumerate(chunk)])
        parts.append(means.select(F.explode(entries).alias("e")).select("e.*"))
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out.groupBy("new_factor").agg(F.max("corr").alias("max_corr"))


def factors_to_keep(correlations: DataFrame, limit: float = 0.99) -> DataFrame:
    return correlations.where(F.col("max_corr") < limit)


def agreement(made: DataFrame, truth: DataFrame, value: str = "value") -> DataFrame:
    """One row comparing a produced factor with the expected one (key overlap, counts, values, spacing)."""
    a = made.select(*KEYS, F.col(value).alias("a"), F.lit(1).alias("in_a"))
    b = truth.select(*KEYS, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, KEYS, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    stats = both.agg(
        (F.least(n(in_a), n(in_b)) / F.greatest(n(in_a), n(in_b))).alias("row_ratio"),
        (n(in_a & in_b) / F.count(F.lit(1))).alias("key_similarity"),
        (n(in_a & F.col("a").isNull()) == n(in_b & F.col("b").isNull())).cast("int").alias("same_missing"),
        (n(F.abs(F.col("a") - F.col("b")) < 1e-6) / F.count(F.lit(1))).alias("equal_ratio"),
        n(F.abs("a") == math.inf).alias("infinite"),
    )
    return stats


def is_daily(panel: DataFrame) -> DataFrame:
    """daily = 1 unless two neighbouring distinct times are one minute apart (windows over distinct times only)."""
    times = panel.select(F.col(TIME).cast("timestamp").alias("t")).distinct()
    minute = times.select((F.col("t") + F.expr("INTERVAL 1 MINUTE")).alias("t"))
    hit = times.join(minute, "t", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return hit.select((F.col("n") == 0).cast("int").alias("daily"))


def daily_top_k(signal: DataFrame, k: int, score: str = "signal", ret: str = "ret") -> DataFrame:
    """Equal-weight return of the k best signals of each date."""
    best = top_per_group(signal.where(F.col(score).isNotNull()), [TIME], [F.desc(score), F.col(INSTRUMENT)], k)
    return best.groupBy(TIME).agg(F.avg(ret).alias("ret"), F.count(F.lit(1)).alias("picks"))


def cumulative(daily: DataFrame, value: str = "daily_excess_return", name: str = "cumulative_excess_return") -> DataFrame:
    before = running_totals(daily, [TIME], {"__before": F.col(value)})
    return before.withColumn(name, F.col("__before") + F.col(value)).drop("__before")


def excess_return(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """return - bench - cost per date; missing or infinite parts count as 0."""
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf), F.lit(0.0)).otherwise(F.col(c))
    joined = portfolio.join(benchmark, TIME, "left")
    return joined.select(TIME, (clean("ret") - clean("bench") - clean("cost")).alias("daily_excess_return"))


def risk_summary(daily: DataFrame, value: str = "daily_excess_return", periods: int = 238) -> DataFrame:
    """Annualised return, information ratio, maximum drawdown (of the running sum) and calmar.

    The series has one row per date, so the running maximum goes over the calendar.
    """
    run = cumulative(daily, value, "__cum")
    up_to = Window.partitionBy(F.lit(0)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    peaks = run.withColumn("__drop", F.col("__cum") - F.max("__cum").over(up_to))
    stats = peaks.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.min("__drop").alias("max_drawdown"))
    annual = F.col("m") * periods
    return stats.select(
        annual.alias("annualized_return"),
        F.try_divide(F.col("m"), F.col("s") / math.sqrt(periods)).alias("information_ratio"),
        "max_drawdown",
        F.try_divide(annual, F.abs("max_drawdown")).alias("calmar_ratio"),
    )


def library_overlap(new: DataFrame, library: DataFrame) -> DataFrame:
    """Largest sub-expression of each new factor that some library factor also holds.

    Inputs are (factor, subtree_key, size).  The library is first reduced to one row per key, so a
    common leaf does not multiply rows.
    """
    lib = library.groupBy("subtree_key", "size").agg(F.min("factor").alias("library_factor"))
    own = new.select("factor", "subtree_key", "size").distinct()
    hits = own.join(lib, ["subtree_key", "size"])
    order = F.struct("size", "subtree_key")
    best = hits.groupBy("factor").agg(F.max_by(F.struct("size", "subtree_key", "library_factor"), order).alias("b"))
    return best.select("factor", F.col("b.size").alias("size"), F.col("b.subtree_key").alias("subtree_key"), F.col("b.library_factor").alias("library_factor"))


def benchmark_rollup(runs: DataFrame) -> DataFrame:
    """Success, format and correlation rates per factor, per category and overall.

    Input: factor, category, difficulty, error (boolean), row_count, key_match, equal_ratio, corr (null when not run).
    """
    fmt = (F.coalesce("row_count", F.lit(0.0)) + F.coalesce("key_match", F.lit(0.0))) / 2
    shaped = runs.withColumns({"__fmt": fmt, "__corr": F.coalesce("corr", F.lit(0.0))})
    ok = F.when(F.col("__fmt") == 1, F.col("__corr"))
    per = shaped.groupBy("factor", "category", "difficulty").agg(
        F.avg(ok).alias("avg_corr"), F.avg("__fmt").alias("avg_format"), F.avg((~F.col("error")).cast("double")).alias("avg_run"),
        F.max(ok).alias("max_corr"), F.max("equal_ratio").alias("max_value"), F.avg(F.col("equal_ratio") * F.col("__fmt")).alias("avg_value"),
    )
    names = ["avg_corr", "avg_format", "avg_run", "max_corr", "max_value", "avg_value"]
    by_category = per.groupBy("category").agg(*[F.avg(n).alias(n) for n in names]).select(
        F.lit("-").alias("factor"), "category", F.lit("-").alias("difficulty"), *names
    )
    overall = per.agg(*[F.avg(F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names]).select(
        F.lit("-").alias("factor"), F.lit("-").alias("category"), F.lit("Average").alias("difficulty"), *names
    )
    return per.unionByName(by_category).unionByName(overall)


def best_and_latest(runs: DataFrame, group: str, metric: str, when: str, bigger: bool = True) -> DataFrame:
    """Per group: the run with the best metric and the most recent run (ties by id)."""
    pick = F.max_by if bigger else F.min_by
    return runs.groupBy(group).agg(
        pick("id", F.when(F.col(metric).isNotNull(), F.struct(metric, "id"))).alias("best_id"),
        (F.max if bigger else F.min)(metric).alias("best"),
        F.max_by("id", F.struct(when, "id")).alias("latest_id"),
    )


def best_pairs(runs: DataFrame, metric: str, n: int) -> DataFrame:
    """Top n pairs by summed metric.

    A pair among the best n only uses the n + 1 best rows, so pairs are formed inside one array of n + 1 entries.
    """
    few = runs.orderBy(F.desc(metric), "id").limit(n + 1)
    packed = few.agg(F.sort_array(F.collect_list(F.struct("id", F.col(metric).alias("m")))).alias("r"))
    first = packed.select("r", F.posexplode("r").alias("i", "a"))
    both = first.select("a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("b"))
    pairs = both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.m") + F.col("b.m")).alias("total"))
    return pairs.orderBy(F.desc("total"), "a", "b").limit(n)

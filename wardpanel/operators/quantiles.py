"""Exact quantiles of groups of any size.

Spark's own `percentile` keeps every distinct value of a group in one buffer.  Groups that one task may hold use it; for larger
ones a mergeable sketch brackets the wanted order statistics, an exact count places the bracket, and only the values inside it are
put in order.  A bracket that misses or holds too much is settled by cutting the values into ranges, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardpanel.operators.order import group_rows, tie_ranks
from wardpanel.session import cut_lineage

#: A sketch places a value within rows / ACCURACY of its true position; the bracket is twice as wide on each side.
ACCURACY = 10_000
#: Tables of large groups are broadcast up to this many rows (one key and a few numbers each).
BROADCAST_GROUPS = 100_000


def _keyed(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `by`, null keys equal to null keys; the columns of `by` stay once."""
    right = other.withColumnsRenamed({c: f"__k_{c}" for c in by})
    cond = [df[c].eqNullSafe(right[f"__k_{c}"]) for c in by]
    return df.join(right, cond, how).drop(*[f"__k_{c}" for c in by])


def _between(n: Column, q: float) -> tuple[Column, Column]:
    """0-based positions of the two order statistics around quantile `q`."""
    spot = (n - 1) * F.lit(float(q))
    return F.floor(spot), F.ceil(spot)


def _blend(n: Column, q: float, low: Column, high: Column) -> Column:
    """Linear between the two, in the way of Spark's `percentile`."""
    spot, (below, above) = (n - 1) * F.lit(float(q)), _between(n, q)
    return F.when(low == high, low).otherwise((above - spot) * low + (spot - below) * high)


def _pick(ranked: DataFrame, by: Sequence[str], quantiles: Mapping[str, float], only: Column | None = None) -> DataFrame:
    """The quantiles of each group.  `ranked`: group, value, `smaller` and `equal` rows, `total`; rows with number `only` serve one quantile."""
    found, out = [], []
    for i, (name, q) in enumerate(quantiles.items()):
        for side, spot in zip(("low", "high"), _between(F.col("total"), q)):
            here = (F.col("smaller") <= spot) & (spot < F.col("smaller") + F.col("equal"))
            found.append(F.max(F.when(here if only is None else here & (only == i), F.col("__v"))).alias(f"__{side}_{name}"))
        out.append(_blend(F.col("total"), q, F.col(f"__low_{name}"), F.col(f"__high_{name}")).alias(name))
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), *found).select(*by, *out)


def _by_ranges(rows: DataFrame, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles from counts of values, the values cut into ranges."""
    # the group as text, so that a null in it is a value like any other
    packed = rows.select(F.struct(*by).alias("__g"), "__v").withColumn("__id", F.to_json("__g", {"ignoreNullFields": "false"}))
    ranked = tie_ranks(packed.select("__id", "__v"), "__v", ["__id"])
    picked = _pick(ranked, ["__id"], quantiles)
    names = packed.groupBy("__id").agg(F.first("__g").alias("__g"))
    return picked.join(names, "__id").select(*[F.col(f"__g.{c}").alias(c) for c in by], *quantiles)


def _bracketed(rows: DataFrame, by: Sequence[str], quantiles: Mapping[str, float], limit: int, accuracy: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Quantiles of large groups; none for a group whose bracket holds over `limit` values.  `rows`: group, `__v` (not null).

    `small` marks tables with one row per large group.
    """
    names = list(quantiles)
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, q + d)) for q in quantiles.values() for d in (-slack, slack)]
    guess = rows.groupBy(*by).agg(F.percentile_approx("__v", ends, F.lit(accuracy)).alias("__e"))
    marks = _keyed(rows, small(guess), by)
    inside = [(F.col("__v") >= F.get("__e", 2 * i)) & (F.col("__v") <= F.get("__e", 2 * i + 1)) for i in range(len(names))]
    any_inside = inside[0]
    for one in inside[1:]:
        any_inside = any_inside | one
    below = [F.sum((F.col("__v") < F.get("__e", 2 * i)).cast("bigint")).alias(f"__b{i}") for i in range(len(names))]
    placed = marks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *below)
    counts = marks.where(any_inside).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("equal"), F.first("__e").alias("__e"))
    distinct = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("__d"))
    fits = distinct.where(F.col("__d") <= limit).drop("__d")
    held = _keyed(_keyed(counts, small(placed), by), small(fits), by)
    bracket = [F.struct(F.lit(i).alias("i"), F.get("__e", 2 * i).alias("lo"), F.get("__e", 2 * i + 1).alias("hi"), F.col(f"__b{i}").alias("below")) for i in range(len(names))]
    each = held.withColumn("__at", F.explode(F.array(*bracket))).where((F.col("__v") >= F.col("__at.lo")) & (F.col("__v") <= F.col("__at.hi")))
    before = Window.partitionBy(*by, "__at.i").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("smaller", F.col("__at.below") + F.coalesce(F.sum("equal").over(before), F.lit(0)))
    return _pick(ranked, by, quantiles, F.col("__at.i"))


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: `by` and each quantile of `wanted` (name -> q in [0, 1]), exact and linear between two rows.

    Nulls in `value` do not count; a group without values has null quantiles, and null is a group of its own in `by`.  Without `by`
    there is one row, also for an empty table.  NaN sorts after all numbers.  Groups above `wardpanel.group.rows` go through a
    bracket; the rows of a bracket are about 4 / accuracy of the group, plus one for each tie less.
    """
    if not wanted or any(not 0 <= q <= 1 for q in wanted.values()):
        raise ValueError("quantiles must lie in [0, 1]")
    names, limit = list(wanted), group_rows(df)
    rows = df.select(*by, F.col(value).cast("double").alias("__v"))
    plain = lambda d, keys: d.groupBy(*keys).agg(*[F.percentile("__v", q).alias(n) for n, q in wanted.items()])
    keyed, keys = (rows, list(by)) if by else (rows.withColumn("__one", F.lit(1)), ["__one"])
    hot = keyed.groupBy(*keys).agg(F.count("__v").alias("__n")).where(F.col("__n") > limit).drop("__n")
    many = hot.count()  # at most rows / limit groups
    if many == 0:
        return plain(rows, by)
    small = F.broadcast if many <= BROADCAST_GROUPS else (lambda d: d)
    marked = _keyed(keyed, small(hot.withColumn("__hot", F.lit(True))), keys, "left")
    heavy = marked.where(F.col("__hot") & F.col("__v").isNotNull()).drop("__hot")
    found = cut_lineage(_bracketed(heavy, keys, wanted, limit, accuracy, small).na.drop(subset=names))
    missed = _keyed(hot, found.select(*keys).withColumn("__done", F.lit(True)), keys, "left").where(F.col("__done").isNull()).drop("__done")
    if missed.count():
        found = found.unionByName(_by_ranges(_keyed(heavy, small(missed), keys), keys, wanted))
    if not by:
        return found.select(*names)
    return plain(marked.where(F.col("__hot").isNull()).drop("__hot"), keys).unionByName(found)

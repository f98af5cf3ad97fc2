"""Ordered work on groups of any size.

A plain window puts one group in one task.  The helpers here first cut the ordering key into
ranges, work inside (group, range), and add the small per-range totals afterwards, so one group
may hold any share of the rows.  Range edges only steer balance; every result is exact for any edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 2048
RANGES = 64
GROUP_ROWS = 1_000_000
GROUP_CONF = "wardpanel.group.rows"


def group_rows(df: DataFrame) -> int:
    """Largest group that one task may sort; above it the ranged form is used."""
    return int(df.sparkSession.conf.get(GROUP_CONF, str(GROUP_ROWS)))


def _edges(df: DataFrame, order: Sequence[str], ranges: int, sample_rows: int, by: Sequence[str] = ()) -> list[tuple]:
    """Range edges from the rows with the smallest hashes of group and key; at most `sample_rows` rows reach the driver.

    The hash covers the group, so series that share their order values still give a spread sample.
    """
    key = [*by, *order]
    picked = df.select(*key).orderBy(F.xxhash64(*key), *key).limit(sample_rows).select(*order).collect()
    values = sorted({tuple(r) for r in picked if all(v is not None for v in r)})
    step = max(1, len(values) // ranges)
    return values[step::step]


def _range_id(df: DataFrame, order: Sequence[str], edges: list[tuple]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    single = len(order) == 1
    key = F.col(order[0]) if single else F.struct(*[F.col(c).alias(c) for c in order])

    def literal(edge: tuple) -> Column:
        parts = [F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, edge)]
        return parts[0] if single else F.struct(*parts)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < literal(edges[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(edges))


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    ranges: int = RANGES,
    sample_rows: int = SAMPLE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add `<name>` = sum of the measure over rows of the same group that sort strictly earlier.

    `by` + `order` must be unique and the order columns must not be null.  `largest` is a known bound of
    the rows per group; it saves the size check.
    """
    by, order = list(by), list(order)
    named = df.withColumns({f"__m_{n}": c for n, c in measures.items()})
    known = largest_group(df, by) if largest is None else largest
    edges = [] if known <= group_rows(df) else _edges(named, order, ranges, sample_rows, by)
    before = lambda parts: Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not edges:
        parts = by or [F.lit(0)]
        out = named.withColumns({n: F.coalesce(F.sum(f"__m_{n}").over(before(parts)), F.lit(0)) for n in measures})
        return out.drop(*[f"__m_{n}" for n in measures])
    ranged = named.withColumn("__range", _range_id(named, order, edges))
    parts = by + ["__range"]
    totals = ranged.groupBy(*parts).agg(*[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in measures]
    )
    for c in by:
        offsets = offsets.withColumnRenamed(c, f"__k_{c}")
    offsets = offsets.withColumnRenamed("__range", "__k___range")
    inside = ranged.withColumns(
        {f"__l_{n}": F.coalesce(F.sum(f"__m_{n}").over(before(parts)), F.lit(0)) for n in measures}
    )
    cond = [inside[c].eqNullSafe(offsets[f"__k_{c}"]) for c in parts]
    full = cond[0]
    for c in cond[1:]:
        full = full & c
    joined = inside.join(offsets, full, "left")
    result = joined.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in measures})
    return result.select(*df.columns, *measures)


def running_last(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str | None = None, **kw) -> DataFrame:
    """Last non-null value up to and including each row (forward fill), for groups of any size; `by` + `order` unique.

    `largest` is a known bound of the rows per group; it saves the size check.
    """
    by, order, name = list(by), list(order), name or value
    upto = lambda parts: Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = kw["largest"] if kw.get("largest") is not None else largest_group(df, by)
    if known <= group_rows(df):
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(by or [F.lit(0)])))
    edges = _edges(df, order, kw.get("ranges", RANGES), kw.get("sample_rows", SAMPLE_ROWS), by)
    ranged = df.withColumn("__range", _range_id(df, order, edges))
    parts = by + ["__range"]
    held = ranged.where(F.col(value).isNotNull()).groupBy(*parts).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__v"))
    every = ranged.groupBy(*parts).agg(F.lit(1).alias("__any")).drop("__any").join(held, parts, "left")
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*parts, F.last("__v", ignorenulls=True).over(earlier).alias("__c"))
    local = ranged.withColumn("__l", F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(upto(parts)))
    out = local.join(carried, parts, "left").withColumn("__w", F.coalesce("__l", "__c").getField("v"))
    cols = [c for c in df.columns if c != name]
    return out.select(*cols, F.col("__w").alias(name))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "pos", **kw) -> DataFrame:
    """0-based position of each row inside its group, in `order` (unique within the group)."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by, **kw)


def tie_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), smaller: str = "smaller", equal: str = "equal", total: str = "total", **kw
) -> DataFrame:
    """One row per (group, distinct value): rows below, rows equal, rows in the group.  Nulls are left out."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(equal))
    ranked = running_totals(counts, [value], {smaller: F.col(equal)}, by, **kw)
    if by:
        totals = counts.groupBy(*by).agg(F.sum(equal).alias(total))
        return ranked.join(totals, by)
    return ranked.withColumn(total, counts.agg(F.sum(equal).alias(total)).scalar())


def _percent_rank(value: str, by: Sequence[str]) -> Column:
    ordered = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    smaller = F.rank().over(ordered) - 1
    equal = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    total = F.count(value).over(Window.partitionBy(*by))
    ranked = F.col(value).isNotNull()
    for c in by:
        ranked = ranked & F.col(c).isNotNull()
    return F.when(ranked, (smaller + (equal + 1) / 2) / total)


def percent_ranks(df: DataFrame, names: Mapping[str, str], by: Sequence[str], largest: int | None = None, **kw) -> DataFrame:
    """Average-tie percent rank of several columns inside each group (`names`: column -> new column); null stays null.

    Groups that one task may sort are shuffled once for all columns.  Larger ones are ranked by counts of values;
    every rank then starts from `df` itself, so the plan grows with the number of columns, not with its power.
    Rows with a null in `by` have no rank.
    """
    by = list(by)
    known = largest_group(df, by) if largest is None else largest
    if by and known <= group_rows(df):
        return df.withColumns({name: _percent_rank(value, by) for value, name in names.items()})
    out = df
    for value, name in names.items():
        ranked = tie_ranks(df.select(*by, value), value, by, largest=known, **kw).select(
            *by, value, ((F.col("smaller") + (F.col("equal") + 1) / 2) / F.col("total")).alias(name)
        )
        out = out.join(ranked, [*by, value], "left")
    return out


def large(df: DataFrame) -> DataFrame:
    """A join side of exploded or gathered rows: the optimizer cannot see its size, so it must not be broadcast."""
    return df.hint("merge")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the largest group (one pass with map-side counts)."""
    row = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def split_series(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Make row-count windows safe for very long series.

    Adds `__chunk` and `__halo`.  Windows over (by, __chunk) that look at most `before` rows back and
    `after` rows ahead are exact on rows with `__halo` false; drop the halo rows afterwards.  When the
    largest series is within `max_rows` nothing moves and there is a single chunk.
    """
    by, order = list(by), list(order)
    max_rows = max_rows or group_rows(df)
    if largest_group(df, by) <= max_rows:
        return df.withColumns({"__chunk": F.lit(0).cast("bigint"), "__halo": F.lit(False)})
    size = max(max_rows, before + after + 1)
    placed = positions(df, order, by, "__pos")
    first = F.floor((F.col("__pos") - F.lit(after)) / size)
    last = F.floor((F.col("__pos") + F.lit(before)) / size)
    home = F.floor(F.col("__pos") / size)
    spread = placed.withColumn("__home", home).withColumn(
        "__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last))
    )
    return spread.withColumn("__halo", F.col("__chunk") != F.col("__home")).drop("__home", "__pos")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("__halo")).drop("__halo", "__chunk")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = 32) -> DataFrame:
    """Exact top-k per group in two steps: k per (group, salt), then k per group (at most k * salts rows each)."""
    by = list(by)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    local = Window.partitionBy(*by, "__salt").orderBy(*order)
    kept = salted.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= k).drop("__r", "__salt")
    final = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def neighbour(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Mapping[str, Column], steps: int = 1) -> DataFrame:
    """Values of the row `steps` later (or earlier when negative) in the same series; `order` must be total."""
    split = split_series(df, by, order, before=max(0, -steps), after=max(0, steps))
    w = Window.partitionBy(*by, "__chunk").orderBy(*order)
    moved = {n: (F.lead(c, steps) if steps > 0 else F.lag(c, -steps)).over(w) for n, c in columns.items()}
    return drop_halo(split.withColumns(moved))

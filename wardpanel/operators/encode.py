"""Feature encoders: fit is an aggregate that yields a vocabulary table, transform is a join or an array expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardpanel.operators.order import large, largest_group, positions, running_last
from wardpanel.session import cut_lineage

PAD, UNK = 0, 1
SPECIALS = ("<pad>", "<unk>")


def _depth(df: DataFrame, col: str) -> int:
    t, d = df.schema[col].dataType, 0
    while isinstance(t, T.ArrayType):
        t, d = t.elementType, d + 1
    return d


def explode_levels(df: DataFrame, keys: Sequence[str], col: str, depth: int, outer: bool = False) -> DataFrame:
    """keys, i1..in, token: one row per leaf of a nested array; `outer` keeps empty levels as rows with a null index."""
    out = df.select(*keys, F.col(col).alias("token"))
    op = F.posexplode_outer if outer else F.posexplode
    for i in range(1, depth + 1):
        out = out.select(*keys, *[f"i{j}" for j in range(1, i)], op("token").alias(f"i{i}", "token"))
    return out


def fit_vocabulary(df: DataFrame, order: Sequence[str], col: str, mapping: DataFrame | None = None, start: int = len(SPECIALS)) -> DataFrame:
    """(token, id): ids by first appearance over (order, position); null tokens skipped.

    `mapping` (source, target, rank) may expand a token into several; unmapped tokens stay.  The first places, one row per token, are
    kept, so `df` is gone through once however often the vocabulary is read.
    """
    depth = _depth(df, col)
    leaves = explode_levels(df, order, col, depth).where(F.col("token").isNotNull())
    spots = [*order, *[f"i{j}" for j in range(1, depth + 1)]]
    if mapping is not None:
        leaves = map_tokens(leaves, mapping)
        spots.append("rank")
    first = cut_lineage(leaves.groupBy("token").agg(F.min(F.struct(*spots)).alias("first")).select("token", "first.*"))
    return positions(first, spots, name="id").select("token", (F.col("id") + start).alias("id"))


def map_tokens(leaves: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("source").alias("token"), "target", "rank")
    out = leaves.join(m, "token", "left").withColumn("token", F.coalesce("target", "token"))
    return out.withColumn("rank", F.coalesce("rank", F.lit(0))).drop("target")


def _codes(vocab: DataFrame) -> DataFrame:
    """The id under a name that cannot meet a key column."""
    return vocab.withColumnRenamed("id", "__id")


def _id_lists(vocab: DataFrame, mapping: DataFrame | None) -> list | None:
    """(token, ids) of each known or mapped token, or None when there are too many to send."""
    ids = _codes(vocab.select("token", "id"))
    table = ids.select("token", F.array("__id").alias("ids"))
    if mapping is not None:
        m = mapping.select("source", F.coalesce("target", "source").alias("token"), F.coalesce("rank", F.lit(0)).alias("rank")).where(F.col("source").isNotNull())
        row = F.struct("rank", F.coalesce("__id", F.lit(UNK).cast("bigint")).alias("__id"))
        mapped = m.join(ids, "token", "left").groupBy(F.col("source").alias("token")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["__id"]).alias("ids"))
        table = table.join(mapped.select("token"), "token", "left_anti").unionByName(mapped)
    rows = table.limit(SENT_TOKENS + 1).collect()
    return rows if sum(len(r["ids"]) for r in rows) <= SENT_TOKENS else None


def _swap_lists(known: list):
    """Column function: each token of an array replaced by its ids, an unknown one by the unknown id; nulls are dropped."""
    places = pa.array([r["token"] for r in known], type=pa.string())
    lists = pa.array([*[r["ids"] for r in known], [UNK]], type=pa.list_(pa.int64()))
    lengths = np.array([*[len(r["ids"]) for r in known], 1])

    def swap(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        valid = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(flat, value_set=places), len(known)).to_numpy(zero_copy_only=False)
        done = np.concatenate([[0], np.cumsum(np.where(valid, lengths[at], 0))])
        ends = done[np.concatenate([[0], np.cumsum(_sizes(column))])]
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), lists.take(pa.array(at[valid])).flatten())

    swap.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(swap, "array<bigint>").asNondeterministic()  # one evaluation per row


def encode_sequence(df: DataFrame, key: str, col: str, vocab: DataFrame, mapping: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Flat token array to id array; unknown tokens get the unknown id, nulls are dropped."""
    known = _id_lists(vocab, mapping)
    if known is not None:
        return df.withColumn(name or col, _swap_lists(known)(F.col(col))).select(key, *[c for c in dict.fromkeys([*df.columns, name or col]) if c != key])
    leaves = explode_levels(df, [key], col, 1).where(F.col("token").isNotNull())
    spots = ["i1"]
    if mapping is not None:
        leaves, spots = map_tokens(leaves, mapping), ["i1", "rank"]
    coded = leaves.join(_codes(vocab), "token", "left").withColumn("__id", F.coalesce("__id", F.lit(UNK)))
    ids = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*spots, "__id"))).alias("__x"))
    out = ids.select(key, F.transform("__x", lambda r: r["__id"]).alias("__ids"))
    joined = df.join(large(out), key, "left")
    return joined.withColumn(name or col, F.coalesce("__ids", F.array().cast("array<bigint>"))).drop("__ids")


def pad(arr: Column, n: int | Column, fill: Column) -> Column:
    return F.concat(arr, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(arr), F.lit(0))))


def max_lengths(df: DataFrame, col: str) -> list[int]:
    """Longest array per nesting level below the first."""
    depth = _depth(df, col)
    levels, cur = [], F.col(col)
    for _ in range(depth - 1):
        levels.append(F.max(F.coalesce(F.array_max(F.transform(cur, lambda a: F.coalesce(F.size(a), F.lit(0)))), F.lit(0))))
        cur = F.flatten(F.filter(cur, lambda a: a.isNotNull()))
    return [max(1, int(v or 0)) for v in df.agg(*[c.alias(f"m{i}") for i, c in enumerate(levels)]).first()]


def encode_nested(df: DataFrame, key: str, col: str, vocab: DataFrame, lengths: Sequence[int], name: str | None = None) -> DataFrame:
    """Arrays of token arrays (2 or 3 levels) to padded id arrays.

    Every inner (and middle) array is padded to the fitted length; an empty list is all padding; an empty input is one padded row.
    Rows without a key are left out; rows that share one each hold the tokens of all of them, place by place.
    """
    depth = _depth(df, col)
    once = _leaf(df, col) == vocab.schema["token"].dataType and largest_group(df.where(F.col(key).isNotNull()), [key]) <= 1
    known = _sent(vocab) if once else None
    if known is not None:
        return _encode_nested_rows(df, key, col, vocab, known, lengths, name or col)
    leaves = explode_levels(df, [key], col, depth, outer=True)
    last = f"i{depth}"
    joined = leaves.join(_codes(vocab), "token", "left").withColumn("__id", F.when(F.col(last).isNotNull(), F.coalesce("__id", F.lit(UNK))))
    keys = [key, *[f"i{j}" for j in range(1, depth)]]
    level = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col(last).isNotNull(), F.struct(last, "__id")))).alias("__x"))
    level = level.select(*keys, pad(F.transform("__x", lambda r: r["__id"].cast("bigint")), lengths[-1], F.lit(PAD).cast("bigint")).alias("row"))
    empty = F.array_repeat(F.lit(PAD).cast("bigint"), lengths[-1])
    for d in range(depth - 1, 0, -1):
        keys, spot = [key, *[f"i{j}" for j in range(1, d)]], f"i{d}"
        rows = F.sort_array(F.collect_list(F.when(F.col(spot).isNotNull(), F.struct(spot, "row"))))
        level = level.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias("row"))
        if d > 1:
            level = level.withColumn("row", pad(F.col("row"), lengths[d - 2], empty))
            empty = F.array_repeat(empty, lengths[d - 2])
        else:
            level = level.withColumn("row", F.when(F.size("row") > 0, F.col("row")).otherwise(F.array(empty)))
    return df.drop(name or col).join(large(level.withColumnRenamed("row", name or col)), key)


def _leaf(df: DataFrame, col: str) -> T.DataType:
    t = df.schema[col].dataType
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t


def _leaves_swapped(column: pa.Array, depth: int, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Nested lists with other leaves; a missing list is empty."""
    levels = []
    for _ in range(depth):
        levels.append(_ends(_sizes(column)))
        column = column.flatten()
    out = change(column)
    for ends in reversed(levels):
        out = pa.ListArray.from_arrays(ends, out)
    return out


def _swap_nested(known: list, token: T.DataType, depth: int):
    """Column function: each token of a nested array replaced by its id, an unknown or missing one by the unknown id; a missing list is empty."""
    known = [r for r in known if r["token"] is not None]
    places, found = pa.array([r["token"] for r in known], type=to_arrow_type(token)), pa.array([r["id"] for r in known], type=pa.int64())

    def swap(column: pa.Array) -> pa.Array:
        return _leaves_swapped(column, depth, lambda flat: found.take(pc.index_in(flat, value_set=places)).fill_null(UNK))

    swap.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(swap, "array<" * depth + "bigint" + ">" * depth).asNondeterministic()  # one evaluation per row


def _encode_nested_rows(df: DataFrame, key: str, col: str, vocab: DataFrame, known: list, lengths: Sequence[int], name: str) -> DataFrame:
    """`encode_nested` inside the row: tokens are looked up as they are, and Spark pads one row after the other; nothing is shuffled."""
    depth = _depth(df, col)
    rest = [c for c in df.columns if c not in (key, name)]
    ids = df.where(F.col(key).isNotNull()).withColumn("__ids", _swap_nested(known, vocab.schema["token"].dataType, depth)(F.col(col)))
    empty = F.array_repeat(F.lit(PAD).cast("bigint"), lengths[-1])
    rows = lambda c: F.transform(c, lambda x: pad(x, lengths[-1], F.lit(PAD).cast("bigint")))
    if depth == 3:
        middle, empty = empty, F.array_repeat(empty, lengths[0])
        padded = F.transform("__ids", lambda x: pad(rows(x), lengths[0], middle))
    else:
        padded = rows("__ids")
    return ids.select(key, *rest, F.when(F.size("__ids") > 0, padded).otherwise(F.array(empty)).alias(name))


def keep_tokens(vocab: DataFrame, tokens: DataFrame, remove: bool = False) -> DataFrame:
    """Vocabulary limited to (or without) the tokens; order kept, ids renumbered, specials untouched."""
    kept = vocab.join(tokens.select("token").distinct(), "token", "left_anti" if remove else "left_semi")
    return positions(kept, ["id"], name="__p").select("token", (F.col("__p") + len(SPECIALS)).alias("id"))


def add_tokens(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """Unknown tokens appended in sorted order."""
    new = tokens.select("token").distinct().join(vocab, "token", "left_anti")
    start = vocab.agg(F.coalesce(F.max("id"), F.lit(UNK)).alias("m")).first()["m"] + 1
    return vocab.unionByName(positions(new, ["token"], name="id").select("token", (F.col("id") + start).alias("id")))


# ---- numbers -------------------------------------------------------------------------------------


def _fill(rows: DataFrame, by: Sequence[str], order: str, value: str) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


#: Cells of the grid that one task fills at a time.
GRID_CELLS = 1 << 20


def _grid(column: pa.Array, width: int, forward_fill: bool) -> pa.Array:
    """Lists of lists of doubles: each inner list cut or padded to the width, missing cells filled within the outer list."""
    per_list, inner = _sizes(column), column.flatten()
    lengths, cells = _sizes(inner), inner.flatten().to_numpy(zero_copy_only=False)
    n = len(inner)
    rows, spot = np.repeat(np.arange(n), lengths), np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid = np.full((n, width), np.nan)
    grid[rows[spot < width], spot[spot < width]] = cells[spot < width]
    if forward_fill:
        at, start = np.arange(n), np.repeat(np.cumsum(per_list) - per_list, per_list)
        unseen = np.maximum.accumulate(np.where(lengths > 0, at, -1)) < start
        grid[unseen & (lengths == 0)] = 0.0
        above = np.maximum.accumulate(np.where(np.isnan(grid), -1, at[:, None]), axis=0)
        grid = np.where(above >= start[:, None], np.take_along_axis(grid, np.maximum(above, 0), axis=0), np.nan)
        before = np.maximum.accumulate(np.where(np.isnan(grid), 0, np.arange(width)), axis=1)
        grid = np.take_along_axis(grid, before, axis=1)
    grid = np.nan_to_num(grid, nan=0.0, posinf=np.inf, neginf=-np.inf)
    filled = pa.ListArray.from_arrays(_ends(np.full(n, width)), pa.array(grid.ravel()))
    return pa.ListArray.from_arrays(_ends(per_list), filled)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())


def _filled(lengths: Sequence[int], forward_fill: bool):
    """Column function of `_grid`; of three levels each middle list is padded and filled by itself, and empty middle lists are left out."""
    deep, width = len(lengths) == 2, lengths[-1]

    def fill(column: pa.Array) -> pa.Array:
        lists = column
        if deep:
            middle = column.flatten()
            sizes = _sizes(middle)
            owner = np.repeat(np.arange(len(column)), _sizes(column))[sizes > 0]
            starts, sizes = (np.cumsum(sizes) - sizes)[sizes > 0], sizes[sizes > 0]
            spot = np.arange(lengths[0])
            rows = middle.flatten().take(pa.array((starts[:, None] + spot).ravel(), mask=(spot >= sizes[:, None]).ravel()))
            lists = pa.ListArray.from_arrays(_ends(np.full(len(sizes), lengths[0])), rows)
        ends = np.cumsum(_sizes(lists)) * width
        cuts = [0]  # parts of about GRID_CELLS cells, one list at least
        while cuts[-1] < len(lists):
            reached = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, reached + GRID_CELLS, side="right"))))
        parts = [_grid(lists.slice(i, j - i), width, forward_fill) for i, j in zip(cuts, cuts[1:])]
        out = pa.concat_arrays(parts) if parts else _grid(lists, width, forward_fill)
        return pa.ListArray.from_arrays(_ends(np.bincount(owner, minlength=len(column))), out) if deep else out

    fill.__annotations__ = {"column": pa.Array, "return": pa.Array}
    levels = len(lengths) + 1
    return F.arrow_udf(fill, "array<" * levels + "double" + ">" * levels).asNondeterministic()  # one evaluation per row


def to_doubles(col: Column, depth: int) -> Column:
    """Numbers of nested arrays as doubles; bad text is missing."""
    return F.transform(col, lambda x: to_doubles(x, depth - 1)) if depth else col.cast("string").try_cast("double")


def encode_floats(df: DataFrame, key: str, col: str, lengths: Sequence[int], forward_fill: bool = True) -> DataFrame:
    """Arrays of float arrays (2 or 3 levels) to padded, filled arrays, row by row.

    With filling: an empty list repeats the previous one (zeros when there is none), a missing cell takes the last value of its
    position, then of its row, then 0.  Without: missing is 0.  Bad text counts as missing.
    """
    depth, width = _depth(df, col), lengths[-1]
    lists = to_doubles(F.col(col), depth)
    blank = F.array_repeat(F.lit(float("nan") if forward_fill else 0.0), width)
    blank = F.array(blank) if depth == 2 else F.array(F.array(blank))
    out = df.withColumn("__row", _filled(lengths[-depth + 1 :], forward_fill)(lists))
    rest = [c for c in df.columns if c not in (key, col)]
    return out.select(key, *rest, F.when(F.size("__row") > 0, F.col("__row")).otherwise(blank).alias(col))


def fill_steps(df: DataFrame, key: str, col: str) -> DataFrame:
    """Array of feature vectors: each missing cell takes the last value of the feature, 0 at the start."""
    steps = explode_levels(df, [key], col, 2)
    v = F.when(F.isnan("token"), None).otherwise(F.col("token"))
    cells = steps.withColumn("token", v)
    cells = cells.withColumn("token", F.coalesce(_fill(cells, [key, "i2"], "i1", "token"), F.lit(0.0)))
    rows = cells.groupBy(key, "i1").agg(F.transform(F.sort_array(F.collect_list(F.struct("i2", "token"))), lambda r: r["token"]).alias("r"))
    out = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i1", "r"))), lambda r: r["r"]).alias("__f"))
    return df.drop(col).join(large(out.withColumnRenamed("__f", col)), key, "left")


def resample(points: DataFrame, key: str, time: str, value: str | Sequence[str], step_seconds: float, fill: str = "forward") -> DataFrame:
    """(key, step, hours, values): a regular grid from the first to the last time of each key, for one value column or several.

    The latest point of a slot wins with all its values; what is empty after that, a slot or a single value, is filled forward for
    each column by itself, from 0, or with 0.
    """
    values = [value] if isinstance(value, str) else list(value)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = points.groupBy(key).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    slot = lambda c: F.floor((us(c) - us("__a")) / (step_seconds * 1e6))
    best = points.join(span, key).groupBy(key, slot(time).alias("step")).agg(F.max_by(F.struct(*values), time).alias("__v")).select(key, "step", "__v.*")
    grid = span.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), slot("__b"))).alias("step"))
    rows = grid.join(large(best), [key, "step"], "left")
    if fill == "forward":
        longest = span.agg(F.max(slot("__b") + 1)).first()[0] or 0
        for v in values:
            rows = running_last(rows, [key], ["step"], v, largest=longest)
    hours = (F.col("step") * (step_seconds / 3600.0)).alias("hours")
    return rows.select(key, "step", hours, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def to_floats(col: Column, depth: int) -> Column:
    if depth == 0:
        return col.cast("double")
    return F.transform(col, lambda x: to_floats(x, depth - 1))


# ---- labels --------------------------------------------------------------------------------------


def fit_labels(df: DataFrame, col: str, binary: bool = False) -> DataFrame:
    """(label, id) by sorted label."""
    flat = df.select(F.explode(col).alias("label")) if _depth(df, col) else df.select(F.col(col).alias("label"))
    vocab = positions(flat.where(F.col("label").isNotNull()).distinct(), ["label"], name="id")
    if binary:
        n = vocab.count()
        if n != 2:
            raise ValueError(f"a binary label needs 2 values, found {n}")
    return vocab


def encode_label(df: DataFrame, col: str, vocab: DataFrame) -> DataFrame:
    """Label to its index; an unseen label is an error."""
    out = df.join(_codes(vocab).withColumnRenamed("label", col), col, "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))).cast("bigint")
    return out.withColumn(col, F.coalesce(F.col("__id"), unseen)).select(*df.columns)


def encode_multi_hot(df: DataFrame, key: str, col: str, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """Label array to a 0/1 array over the sorted vocabulary; an unseen label is an error."""
    n = size if size is not None else vocab.count()
    flat = df.select(key, F.explode(col).alias("label")).join(_codes(vocab), "label", "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col("label").cast("string"))).cast("bigint")
    hits = flat.groupBy(key).agg(F.collect_set(F.coalesce(F.col("__id"), unseen)).alias("__h"))
    out = df.drop(col).join(large(hits), key, "left")
    flags = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda i: F.coalesce(F.array_contains("__h", i), F.lit(False)).cast("int"))
    return out.withColumn(col, flags).drop("__h")


# ---- token tables and collation ------------------------------------------------------------------


def token_table(spark: SparkSession, tokens: Sequence[str], specials: Sequence[str] = SPECIALS) -> DataFrame:
    names = list(dict.fromkeys([*specials, *tokens]))
    return spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, id bigint")


def keep_last(arr: Column, n: int) -> Column:
    return F.when(F.size(arr) > n, F.slice(arr, -n, n)).otherwise(arr)


def batch_length(df: DataFrame, batch: Sequence[str], length: Column) -> DataFrame:
    return df.groupBy(*batch).agg(F.max(length).alias("__len")) if batch else df.agg(F.max(length).alias("__len"))


def pad_batch(df: DataFrame, col: str, batch: str, fill: Column) -> DataFrame:
    """Arrays padded to the longest array of their batch."""
    return df.join(batch_length(df, [batch], F.size(col)), batch).withColumn(col, pad(F.col(col), F.col("__len"), fill)).drop("__len")


#: Tokens of a table, and batches, that are sent to all tasks; larger ones are joined.
SENT_TOKENS, SENT_BATCHES = 200_000, 100_000


def _look_up(keys: Sequence, values: Sequence, kind: pa.DataType, other, type_name: str):
    """Column function: each element of an array replaced by its value; other elements become `other`, or are left out if that is None."""
    places, found = pa.array(keys, type=pa.string() if kind == pa.int64() else pa.int64()), pa.array(values, type=kind)

    def swap(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        at = pc.index_in(flat, value_set=places)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        out = found.take(at)
        if other is not None:
            out = out.fill_null(other)
        else:
            held = pc.is_valid(at)
            ends = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
            sizes, out = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]), out.filter(held)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), out)

    swap.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(swap, type_name).asNondeterministic()  # one evaluation per row


def numbered(df: DataFrame, col: str) -> tuple[DataFrame, Callable[[Column, int], Column]]:
    """`df` with the strings of `col` as numbers, and a function that gives the strings back in arrays of so many levels.

    Numbers are narrow to move.  Where there are too many different strings to send, `df` stays as it is and nothing is given back.
    """
    values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(SENT_TOKENS + 1).collect()]
    if len(values) > SENT_TOKENS:
        return df, lambda c, depth: c
    codes = df.sparkSession.createDataFrame(list(enumerate(values)), "__n int, __v string")
    out = df.join(F.broadcast(codes), F.col(col) == F.col("__v"), "left").withColumn(col, F.col("__n")).select(*df.columns)
    names = pa.array(values, type=pa.string())

    def back(c: Column, depth: int) -> Column:
        def swap(column: pa.Array) -> pa.Array:
            return _leaves_swapped(column, depth, names.take)

        swap.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.arrow_udf(swap, "array<" * depth + "string" + ">" * depth).asNondeterministic()(c)  # one evaluation per row

    return out, back


def _sent(table: DataFrame) -> list | None:
    """The rows (token, id), or None when there are too many to send."""
    rows = table.select("token", "id").limit(SENT_TOKENS + 1).collect()
    return rows if len(rows) <= SENT_TOKENS else None


def encode_tokens(df: DataFrame, key: str, col: str, table: DataFrame, batch: str, max_length: int = 512) -> DataFrame:
    """Token arrays to ids: the last `max_length` tokens, padded to the longest of the batch; needs <pad> and <unk> in the table."""
    cut = df.withColumn(col, keep_last(F.col(col), max_length))
    ids = {r["token"]: r["id"] for r in table.where(F.col("token").isin(*SPECIALS)).collect()}
    known = _sent(table)
    if known is None:
        leaves = explode_levels(cut, [key], col, 1, outer=True).join(_codes(table), "token", "left")
        coded = leaves.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("i1").isNotNull(), F.struct("i1", F.coalesce("__id", F.lit(ids["<unk>"])).alias("__id"))))), lambda r: r["__id"]).alias("__ids"))
        return pad_batch(cut.drop(col).join(large(coded.withColumnRenamed("__ids", col)), key), col, batch, F.lit(ids["<pad>"]).cast("bigint"))
    lengths = batch_length(cut, [batch], F.coalesce(F.size(col), F.lit(0)))
    few = lengths.limit(SENT_BATCHES + 1).collect()
    lengths = F.broadcast(df.sparkSession.createDataFrame(few, lengths.schema)) if len(few) <= SENT_BATCHES else lengths
    code = _look_up([r["token"] for r in known], [r["id"] for r in known], pa.int64(), ids["<unk>"], "array<bigint>")
    coded = cut.join(lengths, batch).withColumn(col, code(F.col(col)))
    return coded.withColumn(col, pad(F.col(col), F.col("__len"), F.lit(ids["<pad>"]).cast("bigint"))).drop("__len")


def encode_tokens_nested(df: DataFrame, key: str, col: str, table: DataFrame, batch: str, max_outer: int = 10, max_inner: int = 512) -> DataFrame:
    """Arrays of token arrays: both levels cut to their last entries and padded to the longest of the batch."""
    cut = df.withColumn(col, F.transform(keep_last(F.col(col), max_outer), lambda v: keep_last(v, max_inner)))
    ids = {r["token"]: r["id"] for r in table.where(F.col("token").isin(*SPECIALS)).collect()}
    inner = F.array_max(F.transform(col, lambda v: F.size(v)))
    sizes = cut.groupBy(batch).agg(F.max(F.size(col)).alias("__outer"), F.max(inner).alias("__inner"))
    leaves = explode_levels(cut, [key], col, 2, outer=True).join(_codes(table), "token", "left")
    rows = leaves.groupBy(key, "i1").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("i2").isNotNull(), F.struct("i2", F.coalesce("__id", F.lit(ids["<unk>"])).alias("__id"))))), lambda r: r["__id"]).alias("r"))
    arr = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("i1").isNotNull(), F.struct("i1", "r")))), lambda r: r["r"]).alias(col))
    out = cut.drop(col).join(large(arr), key).join(sizes, batch)
    zero = F.lit(ids["<pad>"]).cast("bigint")
    out = out.withColumn(col, F.transform(col, lambda v: pad(v, F.col("__inner"), zero)))
    return out.withColumn(col, pad(F.col(col), F.col("__outer"), F.array_repeat(zero, F.col("__inner")))).drop("__outer", "__inner")


def decode_tokens(df: DataFrame, key: str, col: str, table: DataFrame) -> DataFrame:
    """Ids back to tokens, padding removed."""
    known = _sent(table)
    if known is None:
        leaves = explode_levels(df, [key], col, 1).withColumnRenamed("token", "__id").join(_codes(table), "__id").where(F.col("token") != "<pad>")
        out = leaves.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i1", "token"))), lambda r: r["token"]).alias(col))
        return df.drop(col).join(large(out), key, "left").withColumn(col, F.coalesce(col, F.array().cast("array<string>")))
    bare = F.coalesce(F.col(col), F.array().cast("array<bigint>"))
    for r in known:  # the padding goes before the ids leave Spark
        bare = F.array_remove(bare, F.lit(r["id"]).cast("bigint")) if r["token"] == "<pad>" else bare
    kept = [r for r in known if r["token"] != "<pad>"]
    back = _look_up([r["id"] for r in kept], [r["token"] for r in kept], pa.string(), None, "array<string>")
    return df.withColumn(col, back(bare))


def record_index(samples: DataFrame, by: str, position: str) -> DataFrame:
    """Positions of the samples of each patient or record."""
    return samples.groupBy(by).agg(F.sort_array(F.collect_list(position)).alias("positions"))


# ---- schema-driven encoding ----------------------------------------------------------------------


@dataclass
class FittedField:
    kind: str
    vocab: DataFrame | None = None
    lengths: list[int] = field(default_factory=list)
    size: int | None = None


class EncoderPipeline:
    """Fit and apply one encoder per field; `schema` maps a field to an encoder name."""

    def __init__(self, schema: Mapping[str, str], key: str, order: Sequence[str], padding: int = 0):
        unknown = set(schema.values()) - set(ENCODERS)
        if unknown:
            raise ValueError(f"unknown encoders: {sorted(unknown)}")
        self.schema, self.key, self.order, self.padding = dict(schema), key, list(order), padding
        self.fitted: dict[str, FittedField] = {}

    def fit(self, df: DataFrame) -> "EncoderPipeline":
        missing = [c for c in (*self.schema, self.key, *self.order) if c not in df.columns]
        if missing:
            raise ValueError(f"missing fields: {missing}")
        for col, kind in self.schema.items():
            self.fitted[col] = ENCODERS[kind][0](self, df, col)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for col, kind in self.schema.items():
            df = ENCODERS[kind][1](self, df, col, self.fitted[col])
        return df

    def save(self, path: str) -> None:
        """Vocabularies and lengths as Parquet tables, one folder per field."""
        for col, f in self.fitted.items():
            spark = f.vocab.sparkSession if f.vocab is not None else SparkSession.getActiveSession()
            spark.createDataFrame([(f.kind, f.lengths, f.size)], "kind string, lengths array<int>, size int").write.mode("overwrite").parquet(f"{path}/{col}/meta")
            if f.vocab is not None:
                f.vocab.write.mode("overwrite").parquet(f"{path}/{col}/vocab")

    def load(self, spark: SparkSession, path: str) -> "EncoderPipeline":
        for col, kind in self.schema.items():
            meta = spark.read.parquet(f"{path}/{col}/meta").first()
            vocab = spark.read.parquet(f"{path}/{col}/vocab") if kind in WITH_VOCABULARY else None
            self.fitted[col] = FittedField(meta["kind"], vocab, list(meta["lengths"]), meta["size"])
        return self


def _fit_sequence(p, df, col):
    return FittedField("sequence", fit_vocabulary(df, p.order, col))


def _fit_nested(p, df, col):
    lengths = max_lengths(df, col)
    lengths[-1] += p.padding
    return FittedField("nested_sequence", fit_vocabulary(df, p.order, col), lengths)


def _fit_floats(p, df, col):
    lengths = max_lengths(df, col)
    lengths[-1] += p.padding
    return FittedField("nested_floats", None, lengths)


def _fit_label(binary):
    return lambda p, df, col: FittedField("label", fit_labels(df, col, binary))


def _fit_multi(p, df, col):
    vocab = fit_labels(df, col)
    return FittedField("multilabel", vocab, [], vocab.count())


def _none(p, df, col):
    return FittedField("plain")


def _timed(inner):
    """A struct (time, value): the value part goes through the inner encoder."""
    def run(p, df, col, f):
        split = df.withColumns({"__time": F.col(f"{col}.time"), "__value": F.col(f"{col}.value")}).drop(col)
        done = inner(p, split, "__value", f)
        return done.withColumn(col, F.struct(F.col("__time").alias("time"), F.col("__value").alias("value"))).drop("__time", "__value")

    return run


def _fit_timed(inner):
    return lambda p, df, col: inner(p, df.withColumn("__value", F.col(f"{col}.value")), "__value")


def _either_sequence(p, df, col, f):
    return encode_nested(df, p.key, col, f.vocab, f.lengths) if f.lengths else encode_sequence(df, p.key, col, f.vocab)


def _fit_either(p, df, col):
    return _fit_nested(p, df, col) if _depth(df, col) > 1 else _fit_sequence(p, df, col)


_NESTED = (_fit_nested, lambda p, df, col, f: encode_nested(df, p.key, col, f.vocab, f.lengths))
_FLOATS = (_fit_floats, lambda p, df, col, f: encode_floats(df, p.key, col, f.lengths))
_SAME = (_none, lambda p, df, col, f: df)
WITH_VOCABULARY = ("sequence", "nested_sequence", "deep_nested_sequence", "stagenet", "binary", "multiclass", "multilabel", "multi_hot")
ENCODERS = {
    "sequence": (_fit_sequence, lambda p, df, col, f: encode_sequence(df, p.key, col, f.vocab)),
    "nested_sequence": _NESTED, "deep_nested_sequence": _NESTED, "nested_sequence_floats": _FLOATS, "deep_nested_sequence_floats": _FLOATS,
    "stagenet": (_fit_timed(_fit_either), _timed(_either_sequence)),
    "stagenet_tensor": (_none, _timed(lambda p, df, col, f: fill_steps(df, p.key, col))),
    "tensor": (_none, lambda p, df, col, f: df.withColumn(col, to_floats(F.col(col), _depth(df, col)))),
    "binary": (_fit_label(True), lambda p, df, col, f: encode_label(df, col, f.vocab)),
    "multiclass": (_fit_label(False), lambda p, df, col, f: encode_label(df, col, f.vocab)),
    "multilabel": (_fit_multi, lambda p, df, col, f: encode_multi_hot(df, p.key, col, f.vocab, f.size)),
    "multi_hot": (_fit_multi, lambda p, df, col, f: encode_multi_hot(df, p.key, col, f.vocab, f.size)),
    "regression": (_none, lambda p, df, col, f: df.withColumn(col, F.col(col).cast("double"))),
    "text": _SAME, "raw": _SAME, "tuple_time_text": _SAME,
    "ignore": (_none, lambda p, df, col, f: df.drop(col)),
}


def register_encoder(name: str, fit, transform) -> None:
    """Add a user encoder: fit(pipeline, df, col) -> FittedField, transform(pipeline, df, col, fitted) -> DataFrame."""
    ENCODERS[name] = (fit, transform)

"""Order statistics of sliding windows at a cost per row that does not depend on the window.

Rows arrive sorted by series and time, several series in one batch.  The values of a batch are indexed once: a wavelet
matrix over their ranks answers "the k-th smallest" and "how many are smaller" for any stretch of rows in one step per bit of the
rank, and a table of maxima over doubling stretches answers "where is the first maximum".  All windows of all series of a
batch are asked at once, and several statistics over one column share its index.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows gathered before they are worked on; a longer series is taken whole.
BATCH_ROWS = 65_536


@dataclass(frozen=True)
class Ask:
    """One statistic: `kind`, the input columns (the second one a window length per row), the window, and a parameter."""

    kind: str
    inputs: tuple[Column, ...]
    keys: tuple[str, ...]
    window: int | None
    param: float | None = None

    KINDS = ("quantile", "rank", "mad", "argmax", "argmin", "firstmax", "firstmin", "max", "min", "mean", "sum", "spread", "corr", "slope", "r2", "rest")
    #: Kinds whose second input is a column, not a window length.
    PAIRS = ("corr",)
    #: Kinds that fit a line over the row number, and all that are made from moments.
    TRENDS = ("slope", "r2", "rest")
    MOMENTS = ("mean", "sum", "spread", "corr", *TRENDS)

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"no such statistic: {self.kind}")


class WindowOrder:
    """k-th smallest values and counts of smaller ones of any stretch of an array, by a wavelet matrix over the ranks."""

    def __init__(self, values: np.ndarray):
        self.sorted, codes = np.unique(values, return_inverse=True)
        self.codes = codes.astype(np.int64)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        left = self.codes
        for bit in range(max(len(self.sorted) - 1, 1).bit_length() - 1, -1, -1):
            one = (left >> bit & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((bit, before, len(left) - int(before[-1])))
            left = np.concatenate([left[~one], left[one]])

    def kth(self, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [first, end); every stretch must hold more than k values."""
        code = np.zeros(len(first), dtype=np.int64)
        for bit, before, zeros in self.levels:
            one_first, one_end = before[first], before[end]
            low = (end - one_end) - (first - one_first)
            right = k >= low
            code += right.astype(np.int64) << bit
            k = np.where(right, k - low, k)
            first, end = np.where(right, zeros + one_first, first - one_first), np.where(right, zeros + one_end, end - one_end)
        return self.sorted[code]

    def less(self, first: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many values of [first, end) rank below `code`."""
        count = np.zeros(len(first), dtype=np.int64)
        over = code >= len(self.sorted)
        asked = np.minimum(code, max(len(self.sorted) - 1, 0))
        whole = end - first
        for bit, before, zeros in self.levels:
            one_first, one_end = before[first], before[end]
            right = (asked >> bit & 1).astype(bool)
            count += np.where(right, (end - one_end) - (first - one_first), 0)
            first, end = np.where(right, zeros + one_first, first - one_first), np.where(right, zeros + one_end, end - one_end)
        return np.where(over, whole, count)

    def code_of(self, values: np.ndarray) -> np.ndarray:
        """Rank of the smallest indexed value that is not below each value."""
        return np.searchsorted(self.sorted, values)


def quantile(order: WindowOrder, first: np.ndarray, end: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation between the two nearest ranks; every stretch holds a value."""
    spot = (end - first - 1) * q
    low = np.floor(spot).astype(np.int64)
    a = order.kth(first, end, low)
    b = order.kth(first, end, np.ceil(spot).astype(np.int64))
    with np.errstate(invalid="ignore"):
        return a + (b - a) * (spot - low)


def median_deviation(order: WindowOrder, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Median of the distances to the median: the distances to both sides are sorted already, so the middle of their union is searched."""
    middle = quantile(order, first, end, 0.5)
    n = end - first
    below = order.less(first, end, order.code_of(middle))

    def distance(k: np.ndarray) -> np.ndarray:
        """k-th smallest distance: i of the k + 1 smallest lie below the median."""
        low, high = np.maximum(0, k + 1 - (n - below)), np.minimum(k + 1, below)
        left = lambda i: middle - order.kth(first, end, np.clip(below - 1 - i, 0, n - 1))
        right = lambda j: order.kth(first, end, np.clip(below + j, 0, n - 1)) - middle
        while (low < high).any():
            open_ = low < high
            mid = (low + high) // 2
            more = left(mid) < right(k - mid)
            low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
        a = np.where(low > 0, left(low - 1), -np.inf)
        b = np.where(k - low >= 0, right(k - low), -np.inf)
        return np.maximum(a, b)

    with np.errstate(invalid="ignore"):
        low, high = distance((n - 1) // 2), distance(n // 2)
        return low + (high - low) * 0.5


def first_largest(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the first largest code in each non-empty stretch, from maxima over stretches of doubling length."""
    n = len(codes)
    best = codes * n + (n - 1 - np.arange(n))  # earlier places win ties
    length = end - first
    power = np.frexp(length)[1] - 1
    out, size = np.zeros(len(first), dtype=np.int64), 1
    for p in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == p)
        out[own] = np.maximum(best[first[own]], best[end[own] - size])
        if len(best) > size:
            best = np.maximum(best[:-size], best[size:])
        size *= 2
    return n - 1 - out % max(n, 1)


def extreme(values: np.ndarray, first: np.ndarray, end: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """`pick` (a maximum or minimum) of each non-empty stretch, from those of two stretches of doubling length that cover it."""
    length, best, size = end - first, values, 1
    power = np.frexp(length)[1] - 1
    out = np.zeros(len(first))
    for p in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == p)
        out[own] = pick(best[first[own]], best[end[own] - size])
        if len(best) > size:
            best = pick(best[:-size], best[size:])
        size *= 2
    return out


def _merge(a: tuple, b: tuple, finite: bool) -> tuple:
    """Count, means and (mixed) squared deviations of two stretches that hold values; no large numbers are subtracted from each other.

    One column: (n, mean, squares); two: (n, mean, mean, squares, squares, products).
    """
    n = a[0] + b[0]
    share = b[0] / n
    means = 1 if len(a) == 3 else 2
    gaps = [b[i] - a[i] for i in range(1, means + 1)]
    moved = [a[i] + g * share for i, g in enumerate(gaps, 1)]
    if not finite:
        moved = [np.where(np.isinf(a[i]) | np.isinf(b[i]), a[i] + b[i], m) for i, m in enumerate(moved, 1)]
    products = [(0, 0)] if means == 1 else [(0, 0), (1, 1), (0, 1)]
    weight = a[0] * share
    return n, *moved, *[a[means + 1 + i] + b[means + 1 + i] + gaps[g] * gaps[h] * weight for i, (g, h) in enumerate(products)]


def window_moments(columns: Sequence[np.ndarray], spans: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Moments of one or two columns over the stretches of each span, put together from stretches of doubling length, one for each bit
    of the length.  The doubling stretches are made once for all spans."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        empty = 1 if len(columns) == 1 else 3
        finite = all(np.isfinite(c).all() for c in columns)
        wholes = [tuple(np.zeros(len(first)) for _ in range(1 + len(columns) + empty)) for first, _ in spans]
        lengths = [end - first for first, end in spans]
        longest = max(length.max(initial=0) for length in lengths)
        block = (1.0, *columns, *[np.zeros(len(columns[0]))] * empty)
        size = 1
        while size <= longest:
            for (first, _), length, whole in zip(spans, lengths, wholes):
                own = np.flatnonzero(length & size)
                below = length[own] & (size - 1)
                at, fresh = first[own] + below, below == 0
                new, more, rest = own[fresh], own[~fresh], at[~fresh]
                whole[0][new] = block[0]
                for w, v in zip(whole[1:], block[1:]):
                    w[new] = v[at[fresh]]
                if len(more):
                    joined = _merge(tuple(w[more] for w in whole), (block[0], *[v[rest] for v in block[1:]]), finite)
                    for w, v in zip(whole, joined):
                        w[more] = v
            if 2 * size <= longest:
                block = _merge((block[0], *[b[:-size] for b in block[1:]]), (block[0], *[b[size:] for b in block[1:]]), finite)
            size *= 2
        return wholes


class Series:
    """Rows of whole series: where each row's series starts, and where the rows with a value lie."""

    def __init__(self, series: np.ndarray):
        n = len(series)
        fresh = np.concatenate([[True], series[1:] != series[:-1]]) if n else np.zeros(0, dtype=bool)
        self.rows = np.arange(n)
        self.start = np.maximum.accumulate(np.where(fresh, self.rows, 0)) if n else self.rows

    def numbers(self) -> np.ndarray:
        """Row number within the series, from 1."""
        return (self.rows - self.start + 1).astype(np.float64)

    def window(self, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.start, self.rows - size + 1), self.rows + 1


@dataclass
class Indexed:
    """A column without its nulls; `before[i]` values lie before row i."""

    valid: np.ndarray
    before: np.ndarray
    values: np.ndarray
    other: np.ndarray | None = None
    order: WindowOrder | None = None

    @classmethod
    def of(cls, column: pa.Array, other: pa.Array | None = None) -> "Indexed":
        """A column, or the rows where both of two columns have a value."""
        valid = pc.is_valid(column) if other is None else pc.and_(pc.is_valid(column), pc.is_valid(other))
        values, second = (None if c is None else c.filter(valid).to_numpy(zero_copy_only=False).astype(np.float64) for c in (column, other))
        valid = valid.to_numpy(zero_copy_only=False)
        return cls(valid, np.concatenate([[0], np.cumsum(valid)]), values, second)

    def index(self) -> WindowOrder:
        if self.order is None:
            self.order = WindowOrder(self.values)
        return self.order


def moments_answer(kind: str, n: np.ndarray, moments: tuple, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics from moments; `row` and `value` are the point that a residual is taken at."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if kind == "mean":
            return moments[1], n > 0
        if kind == "sum":
            return moments[1] * n, n > 0
        if kind == "spread":
            return np.where(np.isfinite(moments[1]), np.sqrt(moments[2] / (n - 1)), np.nan), n > 1
        _, mean_x, mean_y, xx, yy, xy = moments
        if kind == "corr":
            return xy / (np.sqrt(xx) * np.sqrt(yy)), (n > 1) & (xx * yy != 0)
        slope = xy / xx
        if kind == "slope":
            return slope, (n > 1) & (xx > 0)
        if kind == "r2":
            return np.where(yy > 0, slope * xy / np.where(yy > 0, yy, 1), 1.0), (n > 1) & (xx > 0)
        return (value - mean_y) - slope * (row - mean_x), (n > 1) & (xx > 0) & ~np.isnan(value)


def moment_columns(column: Indexed, series: Series, trend: bool) -> list[np.ndarray]:
    """The columns whose moments a statistic is made from."""
    if trend:
        return [series.numbers()[column.valid], column.values]
    return [column.values] if column.other is None else [column.values, column.other]


def shared_moments(plan: Sequence[tuple], indexed: Mapping[tuple, Indexed], series: Series) -> dict[tuple, tuple]:
    """Moments by (keys, window, trend) of all windows of a fixed length; those over the same columns are made together."""
    windows: dict[tuple, dict[int, None]] = {}
    for kind, keys, window, _ in plan:
        if kind in Ask.MOMENTS and window is not None:
            windows.setdefault((keys, kind in Ask.TRENDS), {})[window] = None
    known = {}
    for (keys, trend), sizes in windows.items():
        column = indexed[keys]
        spans = [tuple(column.before[at] for at in series.window(size)) for size in sizes]
        found = window_moments(moment_columns(column, series, trend), spans)
        known.update({(keys, size, trend): moments for size, moments in zip(sizes, found)})
    return known


def answer(ask: Ask, column: Indexed, sizes: np.ndarray | None, series: Series, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of one statistic and where there is one; `known` keeps moments that several statistics share.

    The trend kinds (`slope`, `r2`, `rest`) fit the values to the row number within the series.
    """
    first_row, end_row = series.window(ask.window if sizes is None else np.maximum(sizes, 1))
    first, end = column.before[first_row], column.before[end_row]
    out = np.zeros(len(series.rows))
    full = end - first == end_row - first_row
    if ask.kind == "quantile":
        ok = end > first
        out[ok] = quantile(column.index(), first[ok], end[ok], ask.param)
    elif ask.kind == "rank":
        ok = column.valid
        code = column.index().codes
        a, b = first[ok], end[ok]
        less = column.index().less(a, b, code)
        equal = column.index().less(a, b, code + 1) - less
        out[ok] = (less + (equal + 1) / 2) / (b - a)
    elif ask.kind == "mad":
        ok = full
        out[ok] = median_deviation(column.index(), first[ok], end[ok])
    elif ask.kind in ("argmax", "argmin"):
        ok = full
        codes = column.index().codes if ask.kind == "argmax" else len(column.values) - column.index().codes
        out[ok] = end[ok] - 1 - first_largest(codes, first[ok], end[ok])
    elif ask.kind in ("firstmax", "firstmin"):
        ok = end > first
        codes = column.index().codes if ask.kind == "firstmax" else len(column.values) - column.index().codes
        out[ok] = first_largest(codes, first[ok], end[ok]) - first[ok] + 1
    elif ask.kind in ("max", "min"):
        ok = end > first  # as in Spark, NaN is the largest value
        out[ok] = extreme(column.values, first[ok], end[ok], np.maximum if ask.kind == "max" else np.fmin)
    else:
        trend = ask.kind in Ask.TRENDS
        row = series.numbers()
        key = (ask.keys, ask.window, trend)
        moments = known.get(key) if known is not None else None
        if moments is None:
            moments = window_moments(moment_columns(column, series, trend), [(first, end)])[0]
            if known is not None:
                known[key] = moments
        value = np.full(len(row), np.nan)
        value[column.valid] = column.values
        out, ok = moments_answer(ask.kind, end - first, moments, row, value)
    return out, ok


def add_statistics(df: DataFrame, asks: Mapping[str, Ask], series: Sequence[str], order: str, drop: Sequence[str] = ()) -> DataFrame:
    """`df` with one double column per `Ask`, over windows of rows of the same series in `order`; one shuffle and one sort for all.

    The row number asks Spark for rows in order of their series; rows that a window over the same series left so are not shuffled and
    sorted again.  Columns of `df` named in `drop` are read, but not kept.  A task holds about `BATCH_ROWS` rows, or one series; cut
    longer series first.
    """
    inputs: dict[str, tuple[str, Column]] = {}
    for a in asks.values():
        for key, col in zip(a.keys, a.inputs):
            inputs.setdefault(key, (f"__in{len(inputs)}", col.cast("double")))
    kept = df.drop(*drop)
    own = list(kept.columns)
    place = F.row_number().over(Window.partitionBy(*series).orderBy(order))
    ordered = df.select(*own, place.alias("__row"), *[c.alias(n) for n, c in inputs.values()])
    at = {key: len(own) + 1 + i for i, key in enumerate(inputs)}
    plan = [(a.kind, a.keys, a.window, a.param) for a in asks.values()]
    names = [*own, *asks]

    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = Series(np.cumsum(table.column(len(own)).to_numpy() == 1))
        columns = {key: table.column(i).combine_chunks() for key, i in at.items()}
        columns = {key: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for key, c in columns.items()}
        needed = {keys if kind in Ask.PAIRS else keys[:1] for kind, keys, _, _ in plan}
        indexed = {keys: Indexed.of(*[columns[k] for k in keys]) for keys in needed}
        out, known = [], shared_moments(plan, indexed, rows)
        for kind, keys, window, param in plan:
            sizes = missing = None
            own_keys = keys if kind in Ask.PAIRS else keys[:1]
            if len(keys) > len(own_keys):
                missing = ~pc.is_valid(columns[keys[1]]).to_numpy(zero_copy_only=False)
                sizes = np.nan_to_num(pc.fill_null(columns[keys[1]], 1.0).to_numpy(zero_copy_only=False), nan=1.0, posinf=2.0**62, neginf=1.0).astype(np.int64)
            value, ok = answer(Ask(kind, (), keys, window, param), indexed[own_keys], sizes, rows, known)
            out.append(pa.array(value, type=pa.float64(), mask=~ok if missing is None else ~ok | missing))
        batch = table.select(range(len(own))).to_batches()[0]
        return pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(len(own)).to_numpy()
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                fresh = np.flatnonzero(places == 1)
                if len(fresh):
                    cut = int(fresh[0])
                    yield solve([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield solve(held)

    schema = StructType([*kept.schema.fields, *[StructField(n, DoubleType(), True) for n in asks]])
    return ordered.mapInArrow(rows, schema)

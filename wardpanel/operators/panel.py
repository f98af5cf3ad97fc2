"""Factors over an (instrument, datetime) panel.

A `Factor` is a column plus the window or per-date columns it needs first.  `evaluate` adds those
columns level by level, so all factors of a job share one sort per instrument.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardpanel.functions.numeric import finite_or_null, ratio as safe_ratio
from wardpanel.operators.order import drop_halo, group_rows, largest_group, neighbour, running_last, split_series, tie_ranks
from wardpanel.operators.quantiles import quantiles
from wardpanel.operators.rolling import Ask, add_statistics

INSTRUMENT, TIME = "instrument", "datetime"
SERIES = (INSTRUMENT, "__chunk")


@dataclass(frozen=True)
class Step:
    name: str
    level: int
    kind: str  # column, ordered, fill, rank, quantile, or the grouping column of an aggregate
    make: Callable
    needs: frozenset[str] = frozenset()  # steps whose columns it reads
    ask: Callable | None = None  # a window that the pass for statistics can answer too


@dataclass(frozen=True)
class Factor:
    key: str
    col: Callable[[], Column]
    level: int = 0
    steps: tuple[Step, ...] = ()
    back: int = 0
    ahead: int = 0
    args: tuple["Factor", ...] = ()
    plain: bool = False

    def __add__(self, o): return add(self, o)
    def __radd__(self, o): return add(o, self)
    def __sub__(self, o): return subtract(self, o)
    def __rsub__(self, o): return subtract(o, self)
    def __mul__(self, o): return multiply(self, o)
    def __rmul__(self, o): return multiply(o, self)
    def __truediv__(self, o): return divide(self, o)
    def __rtruediv__(self, o): return divide(o, self)
    def __gt__(self, o): return gt(self, o)
    def __lt__(self, o): return lt(self, o)
    def __ge__(self, o): return ge(self, o)
    def __le__(self, o): return le(self, o)


def column(name: str) -> Factor:
    return Factor(name, lambda: F.col(name))


def expression(text: str) -> Factor:
    """A row expression in Spark SQL over panel columns, e.g. `(close - open) / open`."""
    return Factor(f"expr({text})", lambda: F.expr(text).cast("double"))


def lift(v) -> Factor:
    """Scalars become literals, names become columns."""
    if isinstance(v, Factor):
        return v
    if isinstance(v, str):
        return column(v)
    if isinstance(v, bool):
        return Factor(repr(v), lambda: F.lit(v))
    return Factor(repr(float(v)), lambda: F.lit(float(v)))


def _merge(args: Sequence[Factor]) -> tuple[Step, ...]:
    seen = {}
    for a in args:
        for s in a.steps:
            seen.setdefault(s.name, s)
    return tuple(seen.values())


def _reads(fs: Sequence[Factor]) -> frozenset[str]:
    """Names of the steps whose columns the factors read themselves."""
    return frozenset().union(*[{f.steps[-1].name} if f.plain and f.steps else _reads(f.args) for f in fs])


def _key(name: str, args, params=()) -> str:
    return f"{name}({','.join([a.key for a in args] + [repr(p) for p in params])})"


def elementwise(name: str, fn: Callable[..., Column], *args, params=()) -> Factor:
    fs = [lift(a) for a in args]
    return Factor(
        _key(name, fs, params),
        lambda: fn(*[f.col() for f in fs]),
        max((f.level for f in fs), default=0),
        _merge(fs),
        max((f.back for f in fs), default=0),
        max((f.ahead for f in fs), default=0),
        tuple(fs),
    )


def _held(key: str, make: Callable[[], Column], level: int, fs: Sequence[Factor], back: int, ahead: int) -> Factor:
    """A factor kept as a named column of its level, so that equal sub-expressions are computed once."""
    name = "__f_" + hashlib.md5(key.encode()).hexdigest()[:16]
    steps = _merge(fs) + (Step(name, level, "column", make, _reads(fs)),)
    return Factor(key, lambda: F.col(name), level, steps, back, ahead, tuple(fs), True)


def staged(f: Factor) -> Factor:
    if f.plain:
        return f
    held = _held(f.key, f.col, f.level + 1, (f,), f.back, f.ahead)
    return replace(held, args=f.args)


def _plain(v) -> Factor:
    f = lift(v)
    return staged(f) if f.level else f


def windowed(name: str, fn: Callable[..., Column], *args, params=(), back=0, ahead=0) -> Factor:
    fs = [_plain(a) for a in args]
    return _held(
        _key(name, fs, params),
        lambda: fn(*[f.col() for f in fs]),
        max(f.level for f in fs) + 1,
        fs,
        max(f.back for f in fs) + back,
        max(f.ahead for f in fs) + ahead,
    )


def _grouped(name: str, fn: Callable[[Column], Column], x, by: str = TIME, params=()) -> Factor:
    """An aggregate per date (or per instrument) joined back to the rows: partial sums first, no large window."""
    f = _plain(x)
    key = _key(name, [f], params)
    col = "__g_" + hashlib.md5(key.encode()).hexdigest()[:16]
    step = Step(col, f.level + 1, by, lambda: fn(f.col()).alias(col), _reads([f]))
    return Factor(key, lambda: F.col(col), f.level + 1, f.steps + (step,), f.back, f.ahead, (f,), True)


def _quantile(name: str, x, q: float, by: str = TIME) -> Factor:
    """A quantile per date (or per instrument) joined back to the rows; groups of any size."""
    f = _plain(x)
    key = _key(name, [f], (q,))
    col = "__q_" + hashlib.md5(key.encode()).hexdigest()[:16]
    step = Step(col, f.level + 1, "quantile", lambda: (by, f.key, f.col(), q), _reads([f]))
    return Factor(key, lambda: F.col(col), f.level + 1, f.steps + (step,), f.back, f.ahead, (f,), True)


def _add_quantiles(df: DataFrame, asked: Mapping[str, tuple[str, str, Column, float]]) -> DataFrame:
    """Join quantiles (name -> grouping column, key and column of the value, q) to the rows, all of one value in one pass."""
    own = df.where(~F.col("__halo"))
    for by, key in dict.fromkeys((by, key) for by, key, _, _ in asked.values()):
        same = {n: (c, q) for n, (b, k, c, q) in asked.items() if (b, k) == (by, key)}
        value = next(iter(same.values()))[0]
        found = quantiles(own.select(by, value.alias("__value")), "__value", {n: q for n, (_, q) in same.items()}, [by])
        df = df.join(found, by, "left")
    return df


def _statistic(name: str, kind: str, x, p: int | None, params=(), param: float | None = None, other=None, back: float | None = None) -> Factor:
    """A statistic of a window, computed with all others of its level in one pass over the sorted series.

    `other` is a second column, or with `p` none the window length of each row.
    """
    fs = [_plain(x)] if other is None else [_plain(x), _plain(other)]
    key = _key(name, fs, params)
    col, level = "__o_" + hashlib.md5(key.encode()).hexdigest()[:16], max(f.level for f in fs) + 1
    step = Step(col, level, "ordered", lambda: Ask(kind, tuple(f.col() for f in fs), tuple(f.key for f in fs), p, param), _reads(fs))
    far = max(f.back for f in fs) + (p - 1 if back is None else back)
    return Factor(key, lambda: F.col(col), level, _merge(fs) + (step,), far, max(f.ahead for f in fs), tuple(fs), True)


def last_known(x) -> Factor:
    """The last value that is not null, up to and including the row, however far back it lies."""
    f = _plain(x)
    key = _key("last_known", [f])
    col = "__l_" + hashlib.md5(key.encode()).hexdigest()[:16]
    step = Step(col, f.level + 1, "fill", lambda: (f.col(), col), _reads([f]))
    return Factor(key, lambda: F.col(col), f.level + 1, f.steps + (step,), f.back, f.ahead, (f,), True)


def _fill(df: DataFrame, value: Column, name: str, whole: bool) -> DataFrame:
    """Add `name`: the last non-null `value` of the series.

    In a series cut into chunks a chunk gets what the chunks before it ended with; rows that a chunk only borrows take the value of
    their own chunk.
    """
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    if whole:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    own = ~F.col("__halo")
    ends = df.where(own & value.isNotNull()).groupBy(*SERIES).agg(F.max_by(value, F.col(TIME)).alias("__end"))
    chunks = df.where(own).select(*SERIES).distinct().join(ends, [*SERIES], "left")
    earlier = Window.partitionBy(INSTRUMENT).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*SERIES, F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    here = df.where(own).withColumn(name, F.last(value, ignorenulls=True).over(upto)).join(carried, [*SERIES], "left")
    here = here.withColumn(name, F.coalesce(name, "__carried")).drop("__carried")
    borrowed = df.where(~own).join(here.select(INSTRUMENT, TIME, name), [INSTRUMENT, TIME], "left")
    return here.unionByName(borrowed)


def _turns(steps: Sequence[Step]) -> dict[str, int]:
    """Passes over the sorted series that come before each step.

    Statistics wait until no other step can be taken, so they share as few passes as their inputs allow, and steps that windows of
    Spark answer come first, while the rows are narrow.
    """
    turns: dict[str, int] = {}
    kinds = {s.name: s.kind for s in steps}
    for s in sorted(steps, key=lambda s: s.level):
        turns[s.name] = max((turns[n] + (kinds[n] == "ordered") for n in s.needs), default=0)
    return turns


def _shared(panel: DataFrame, steps: Sequence[Step]) -> tuple[Step, ...]:
    """The steps, with windows moved to the pass for statistics where there is one anyway.

    Spark copies each row for every frame and goes through the whole frame for every row.  Only windows over doubles of the panel
    itself that no other step reads move, so there are no more passes than before and types stay.
    """
    if not any(s.kind == "ordered" for s in steps):
        return tuple(steps)
    read = frozenset().union(*[s.needs for s in steps])
    doubles = lambda ask: all(isinstance(f.dataType, DoubleType) for f in panel.select(*ask.inputs).schema)
    moves = lambda s: s.ask is not None and not s.needs and s.name not in read and doubles(s.ask())
    return tuple(replace(s, kind="ordered", make=s.ask) if moves(s) else s for s in steps)


def evaluate(panel: DataFrame, factors: Mapping[str, Factor], keep: Sequence[str] = (INSTRUMENT, TIME), max_rows: int | None = None) -> DataFrame:
    """Panel keys plus one column per factor.

    A series with more rows than `max_rows` (the setting `wardpanel.group.rows` when not given) is cut into overlapping chunks
    first, so an instrument may hold any share of the rows; one pass counts the rows.  Factors that look back without a bound of
    their own, such as bands whose window is a factor, need series within that size.
    """
    need = max((f.back for f in factors.values()), default=0), max((f.ahead for f in factors.values()), default=0)
    steps = _shared(panel, _merge(list(factors.values())))
    limit = max_rows or group_rows(panel)
    apart = any(s.kind not in ("rank", "quantile", TIME, INSTRUMENT) for s in steps)
    whole = not apart or largest_group(panel, [INSTRUMENT]) <= limit
    if whole:
        df = panel.withColumns({"__chunk": F.lit(0).cast("bigint"), "__halo": F.lit(False)})
    elif math.isinf(need[0]):
        raise ValueError(f"a series has over {limit} rows, and a factor looks back without a bound; give it max_window")
    else:
        df = split_series(panel, [INSTRUMENT], [TIME], need[0], need[1], limit)
    largest = largest_group(panel, [TIME]) if any(s.kind == "rank" for s in steps) else 0
    turns, shown = _turns(steps), _reads(list(factors.values()))
    for turn, ordered, level in sorted({(turns[s.name], s.kind == "ordered", 0 if s.kind == "ordered" else s.level) for s in steps}):
        here = [s for s in steps if turns[s.name] == turn and (s.kind == "ordered" if ordered else s.kind != "ordered" and s.level == level)]
        if ordered:
            later = shown.union(*[s.needs for s in steps if turns[s.name] > turn])
            asks = {s.name: s.make() for s in here}
            df = add_statistics(df, asks, SERIES, TIME, [s.name for s in steps if s.name not in later])
            continue
        for by in (TIME, INSTRUMENT):
            aggregates = [s.make() for s in here if s.kind == by]
            if aggregates:
                df = df.join(df.where(~F.col("__halo")).groupBy(by).agg(*aggregates), by, "left")
        middles = {s.name: s.make() for s in here if s.kind == "quantile"}
        if middles:
            df = _add_quantiles(df, middles)
        base = df
        for s in (s for s in here if s.kind == "rank"):
            df = s.make(base, df, largest)
        for s in (s for s in here if s.kind == "fill"):
            df = _fill(df, *s.make(), whole)
        cols = [s for s in here if s.kind == "column"]
        if cols:
            df = df.select("*", *[s.make().alias(s.name) for s in cols])
    out = df.select(*keep, "__chunk", "__halo", *[f.col().alias(n) for n, f in factors.items()])
    return drop_halo(out)


# ---- windows over one instrument -----------------------------------------------------------------


def _ordered():
    return Window.partitionBy(*SERIES).orderBy(TIME)


def _rows(p: int):
    return _ordered().rowsBetween(-(p - 1), 0)


def delay(x, p: int = 1) -> Factor:
    if p < 0:
        raise ValueError("delay looks ahead when the period is negative")
    return windowed("delay", lambda c: F.lag(c, p).over(_ordered()), x, params=(p,), back=p)


def lead_rows(x, p: int) -> Factor:
    return windowed("lead", lambda c: F.lead(c, p).over(_ordered()), x, params=(p,), ahead=p)


def delta(x, p: int = 1) -> Factor:
    return windowed("delta", lambda c: c - F.lag(c, p).over(_ordered()), x, params=(p,), back=p)


#: A frame of this many rows is added up by Spark for every row; longer windows go to the pass whose cost does not grow with them.
FRAME_ROWS = 16


def _rolling(name: str, agg: Callable[[Column], Column], default: int, kind: str, frame_rows: float = FRAME_ROWS):
    def build(x, p: int = default) -> Factor:
        if p > frame_rows:
            return _statistic(name, kind, x, p, (p,))
        f = windowed(name, lambda c: agg(c).over(_rows(p)), x, params=(p,), back=p - 1)
        ask = lambda: Ask(kind, (f.args[0].col(),), (f.args[0].key,), p)
        return replace(f, steps=(*f.steps[:-1], replace(f.steps[-1], ask=ask)))

    build.__name__ = name
    return build


ts_mean = _rolling("ts_mean", F.avg, 5, "mean")
ts_sum = _rolling("ts_sum", F.sum, 5, "sum")
ts_max = _rolling("ts_max", F.max, 5, "max", math.inf)
ts_min = _rolling("ts_min", F.min, 5, "min", math.inf)
ts_std = _rolling("ts_std", F.stddev_samp, 20, "spread")
sumac = _rolling("sumac", F.sum, 10, "sum", math.inf)


def ts_var(x, p: int = 5, ddof: int = 1) -> Factor:
    def var(c):
        n = F.count(c).over(_rows(p))
        return F.when(n > ddof, F.var_pop(c).over(_rows(p)) * n / (n - ddof))

    return windowed("ts_var", var, x, params=(p, ddof), back=p - 1)


def ts_skew(x, p: int = 5) -> Factor:
    return windowed(
        "ts_skew", lambda c: F.when(F.count(c).over(_rows(p)) >= min(3, max(3, p)), finite_or_null(F.skewness(c).over(_rows(p)))), x, params=(p,), back=p - 1
    )


def ts_kurt(x, p: int = 5) -> Factor:
    return windowed(
        "ts_kurt", lambda c: F.when(F.count(c).over(_rows(p)) >= 4, finite_or_null(F.kurtosis(c).over(_rows(p)))), x, params=(p,), back=p - 1
    )


def _values(x, p: int) -> Factor:
    """Non-null values of the window, oldest first."""
    return staged(windowed("values", lambda c: F.collect_list(c).over(_rows(p)), x, params=(p,), back=p - 1))


def _full(x, p: int) -> Factor:
    """True when the window holds no null."""
    return windowed("full", lambda c: F.count(c).over(_rows(p)) == F.count(F.lit(1)).over(_rows(p)), x, params=(p,), back=p - 1)


def ts_quantile(x, p: int = 5, q: float = 0.5) -> Factor:
    if isinstance(p, float) and 0 < p < 1 and q > 1:
        p, q = int(q), p
    if not 0 <= q <= 1 or p < 1:
        raise ValueError("quantile needs q in [0, 1] and p >= 1")
    return _statistic("ts_quantile", "quantile", x, int(p), (int(p), q), float(q))


def ts_median(x, p: int = 5) -> Factor:
    return ts_quantile(x, p, 0.5)


def percentile(x, q: float, p: int | None = None) -> Factor:
    if p is not None:
        return ts_quantile(x, p, q)
    return _quantile("percentile", x, q, INSTRUMENT)


def ts_rank(x, p: int = 5) -> Factor:
    return _statistic("ts_rank", "rank", x, int(p), (int(p),))


def _arg(name: str, kind: str, offset: int):
    def build(x, p: int = 5) -> Factor:
        since = _statistic(kind, kind, x, int(p), (int(p),))
        return elementwise(name, lambda c: c + offset, since) if offset else since

    build.__name__ = name
    return build


ts_argmax = _arg("ts_argmax", "argmax", 0)
ts_argmin = _arg("ts_argmin", "argmin", 0)
highday = _arg("highday", "argmax", 1)
lowday = _arg("lowday", "argmin", 1)


def trend(x, p: int) -> dict[str, Factor]:
    """Slope, R^2 and last residual of the line through the values of the window over their row numbers; short windows use the rows there are."""
    return {k: _statistic(f"trend_{k}", k, x, int(p), (int(p),)) for k in ("slope", "r2", "rest")}


def first_max(x, p: int = 5) -> Factor:
    """1-based place of the first maximum among the values of the window."""
    return _statistic("first_max", "firstmax", x, int(p), (int(p),))


def first_min(x, p: int = 5) -> Factor:
    return _statistic("first_min", "firstmin", x, int(p), (int(p),))


def position(p: int | None = None) -> Factor:
    """Row number inside the series."""
    return staged(windowed("position", lambda _: F.row_number().over(_ordered()).cast("double"), lift(1)))


def sequence(n: int) -> tuple[str, int]:
    """1..n as the second argument of a rolling regression or correlation."""
    return ("sequence", int(n))


def _pair(y, p: int) -> tuple[Factor, int, bool]:
    if isinstance(y, tuple) and y and y[0] == "sequence":
        return position(), y[1], True
    return lift(y), p, False


def _rolling_corr(x: Column, y: Column, p: int) -> Column:
    ok = x.isNotNull() & y.isNotNull()
    a, b, w = F.when(ok, x), F.when(ok, y), _rows(p)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return F.when(F.count(a).over(w) >= 2, F.try_divide(F.covar_pop(a, b).over(w), spread))


def ts_corr(x, y, p: int = 5) -> Factor:
    other, p, seq = _pair(y, p)
    if not seq:
        return _statistic("ts_corr", "corr", x, int(p), (int(p),), None, other, p - 1)

    def corr(a, b):
        ok = (F.count(a).over(_rows(p)) == F.count(b).over(_rows(p))) & (F.count(a).over(_rows(p)) >= 2)
        return F.when(ok, F.coalesce(_rolling_corr(a, b, p), F.lit(0.0)))

    return windowed("ts_corr_seq", corr, x, other, params=(p,), back=p - 1)


def ts_covariance(x, y, p: int = 5) -> Factor:
    other, p, seq = _pair(y, p)

    def cov(a, b):
        both = F.count(F.when(a.isNotNull() & b.isNotNull(), F.lit(1))).over(_rows(p))
        ok = both >= 2
        if seq:
            ok = ok & (both == F.count(b).over(_rows(p)))
        return F.when(ok, F.covar_samp(a, b).over(_rows(p)))

    return windowed("ts_cov", cov, x, other, params=(p, seq), back=p - 1)


def ts_zscore(x, p: int = 5) -> Factor:
    return divide(subtract(x, ts_mean(x, p)), ts_std(x, p))


def ts_mad(x, p: int = 5) -> Factor:
    return _statistic("ts_mad", "mad", x, int(p), (int(p),))


def ts_pctchange(x, p: int = 1) -> Factor:
    return elementwise("fill0", lambda c: F.coalesce(c, F.lit(0.0)), divide(x, delay(x, p)) - 1)


def ewm(x, alpha: float) -> Factor:
    """Exponentially weighted mean with adjusted weights; null rows still age the weights.

    Inside a block of rows the weighted sums are running sums of x * (1-alpha)^-i scaled back, and
    only the previous block can still matter: a block is long enough for older weights to fall below 1e-17.
    Both sums age alike, so a null row has the mean of the last row with a value, however far back it lies.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return elementwise("ewm1", lambda c: c, x)
    decay = 1.0 - alpha
    reach = math.ceil(math.log(1e-17) / math.log(decay))
    block = max(reach, 64)
    pos = position()
    blk = staged(elementwise("block", lambda c: F.floor((c - 1) / block), pos, params=(block,)))
    idx = staged(elementwise("inblock", lambda c: F.pmod(c - 1, F.lit(float(block))), pos, params=(block,)))
    run = lambda: Window.partitionBy(*SERIES, blk.col()).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    prior = lambda: Window.partitionBy(*SERIES).orderBy(blk.col()).rangeBetween(-1, -1)
    grow = lambda i: F.pow(F.lit(decay), -i)
    num = staged(windowed("ewm_n", lambda c, i, b: F.coalesce(F.sum(c * grow(i)).over(run()), F.lit(0.0)), x, idx, blk, params=(alpha,)))
    den = staged(windowed("ewm_d", lambda c, i, b: F.coalesce(F.sum(F.when(c.isNotNull(), grow(i))).over(run()), F.lit(0.0)), x, idx, blk, params=(alpha,)))
    lead_in = float(decay**block)
    last = lambda v, i: F.coalesce(F.max_by(v, i).over(prior()) * F.lit(lead_in), F.lit(0.0))
    num0 = staged(windowed("ewm_n0", lambda v, i, b: last(v, i), num, idx, blk, params=(alpha,), back=2 * block))
    den0 = staged(windowed("ewm_d0", lambda v, i, b: last(v, i), den, idx, blk, params=(alpha,), back=2 * block))
    held = lambda v, a, b, c, d: F.when(v.isNotNull(), F.try_divide(a + b, c + d))
    mean = elementwise("ewm_held", held, x, num, num0, den, den0, params=(alpha,))
    return last_known(mean)


def ema(x, p: int) -> Factor:
    return ewm(x, 2.0 / (int(p) + 1.0))


def sma(x, m, n=None) -> Factor:
    if n is None:
        return ts_mean(x, int(m))
    return ewm(x, n / m)


def _weighted(name: str, weights: list[float], normalise: bool, x, p: int) -> Factor:
    def total(a, ok):
        w = F.slice(F.array(*[F.lit(v) for v in weights]), 1, F.size(a))
        s = F.aggregate(F.zip_with(a, w, lambda v, k: v * k), F.lit(0.0), lambda acc, v: acc + v)
        if normalise:
            s = s / F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(ok, s)

    return elementwise(name, total, _values(x, p), _full(x, p))


def wma(x, p: int = 20) -> Factor:
    """Weights 0.9^i, newest 1; a short window takes the oldest end of the weight list."""
    return _weighted("wma", [0.9**i for i in range(p)][::-1], True, x, p)


def decaylinear(x, p: int = 5) -> Factor:
    total = p * (p + 1) / 2
    return _weighted("decaylinear", [i / total for i in range(1, p + 1)], False, x, p)


def count(cond, p: int = 20) -> Factor:
    return windowed("count", lambda c: F.sum(c.cast("double")).over(_rows(p)), cond, params=(p,), back=p - 1)


def sumif(x, p: int, cond) -> Factor:
    return ts_sum(elementwise("masked", lambda c, k: c * k.cast("double"), x, cond), p)


def prod(x, p=5) -> Factor:
    if not isinstance(p, int):
        return multiply(x, p)
    product = lambda a, ok: F.when(ok, F.aggregate(a, F.lit(1.0), lambda acc, v: acc * v))
    return elementwise("prod", product, _values(x, p), _full(x, p))


def _fit(y, x, p: int):
    """Slope and intercept columns of the rolling least squares of y on x; nulls count as 0."""
    other, p, _ = _pair(x, p)
    zero = lambda f: elementwise("zero", lambda c: F.coalesce(c, F.lit(0.0)), f)
    yy, xx = staged(zero(lift(y))), staged(zero(other))

    def line(a, b):
        w = _rows(p)
        full = F.count(F.lit(1)).over(w) == p
        flat = F.var_pop(b).over(w) == 0
        level = F.avg(a).over(w) / (F.avg(b).over(w) * F.avg(b).over(w) + 1)
        slope = F.when(flat, level * F.avg(b).over(w)).otherwise(F.regr_slope(a, b).over(w))
        start = F.when(flat, level).otherwise(F.regr_intercept(a, b).over(w))
        return F.when(full, F.struct(slope.alias("slope"), start.alias("start")))

    return yy, xx, staged(windowed("line", line, yy, xx, params=(p,), back=p - 1))


def regbeta(y, x, p: int = 5) -> Factor:
    return elementwise("regbeta", lambda l: l["slope"], _fit(y, x, p)[2])


def regresi(y, x, p: int = 5) -> Factor:
    yy, xx, line = _fit(y, x, p)
    return elementwise("regresi", lambda a, b, l: a - (l["slope"] * b + l["start"]), yy, xx, line)


def macd(x, short: int = 12, long: int = 26) -> Factor:
    return ema(x, short) - ema(x, long)


def rsi(x, window: int = 14) -> Factor:
    move = delta(x, 1)
    up = elementwise("gain", lambda d: F.when(d > 0, d).when(d.isNotNull(), F.lit(0.0)), move)
    down = elementwise("loss", lambda d: F.when(d < 0, -d).when(d.isNotNull(), F.lit(0.0)), move)
    strength = lambda u, d: F.when(d != 0, 100 - 100 / (1 + F.try_divide(u, d))).when(u > 0, F.lit(100.0))
    return elementwise("rsi", strength, ema(up, window), ema(down, window))


def _band(x, w, max_window: int | None) -> tuple[Factor, Factor]:
    """Mean and deviation over the last `w` rows, a number or a factor (at least 1); running sums make the cost per row the same for any window.

    A series that has to be cut needs `max_window`, which a factor must not exceed (an error, not a shorter window).
    """
    if not isinstance(w, (Factor, str)):
        return ts_mean(x, int(w)), ts_std(x, int(w))
    size = lift(w)
    if max_window is not None:
        fits = lambda n: F.when(n.cast("int") > max_window, F.raise_error(F.lit(f"a window is longer than max_window ({max_window})"))).otherwise(n)
        size = elementwise("fits", fits, size, params=(max_window,))
    size = elementwise("rows", lambda n: F.coalesce(F.greatest(n.cast("bigint"), F.lit(1).cast("bigint")), F.lit(1).cast("bigint")).cast("double"), size)
    back = math.inf if max_window is None else max_window - 1
    part = lambda kind: _statistic(f"band_{kind}", kind, x, None, (), None, size, back)
    return part("mean"), part("spread")


def bb_middle(x, w, max_window: int | None = None) -> Factor:
    return _band(x, w, max_window)[0]


def bb_upper(x, w, max_window: int | None = None) -> Factor:
    mean, std = _band(x, w, max_window)
    return mean + std


def bb_lower(x, w, max_window: int | None = None) -> Factor:
    mean, std = _band(x, w, max_window)
    return mean - std


# ---- across one date -----------------------------------------------------------------------------


cs_mean = lambda x: _grouped("cs_mean", F.avg, x)
cs_std = lambda x: _grouped("cs_std", F.stddev_samp, x)
cs_median = lambda x: _quantile("cs_median", x, 0.5)
cs_max = lambda x: _grouped("cs_max", F.max, x)
cs_min = lambda x: _grouped("cs_min", F.min, x)


def cs_skew(x) -> Factor:
    return _grouped("cs_skew", lambda c: F.when(F.count(c) >= 3, finite_or_null(F.skewness(c))), x)


def cs_kurt(x) -> Factor:
    return _grouped("cs_kurt", lambda c: F.when(F.count(c) >= 4, finite_or_null(F.kurtosis(c))), x)


def rank(x) -> Factor:
    """Average-tie percent rank inside a date, over (date, value) counts instead of a per-date window."""
    f = _plain(x)
    key = _key("rank", [f])
    col = "__r_" + hashlib.md5(key.encode()).hexdigest()[:16]

    def attach(base, df, largest):
        vals = base.where(~F.col("__halo")).select(TIME, f.col().alias(col + "v"))
        pct = tie_ranks(vals, col + "v", [TIME], largest=largest).select(
            F.col(TIME), F.col(col + "v"), ((F.col("smaller") + (F.col("equal") + 1) / 2) / F.col("total")).alias(col)
        )
        return df.withColumn(col + "v", f.col()).join(pct, [TIME, col + "v"], "left").drop(col + "v")

    return Factor(key, lambda: F.col(col), f.level + 1, f.steps + (Step(col, f.level + 1, "rank", attach, _reads([f])),), f.back, f.ahead, (f,), True)


def zscore(x) -> Factor:
    return divide(subtract(x, cs_mean(x)), cs_std(x))


def scale(x, target: float = 1.0) -> Factor:
    return divide(multiply(x, target), _grouped("cs_abssum", lambda c: F.sum(F.abs(c)), x))


# ---- element by element --------------------------------------------------------------------------


def add(a, b) -> Factor: return elementwise("add", lambda x, y: x + y, a, b)
def subtract(a, b) -> Factor: return elementwise("sub", lambda x, y: x - y, a, b)
def multiply(a, b) -> Factor: return elementwise("mul", lambda x, y: x * y, a, b)
def divide(a, b) -> Factor: return elementwise("div", safe_ratio, a, b)
def inv(x) -> Factor: return divide(1, x)
def absolute(x) -> Factor: return elementwise("abs", F.abs, x)
def sign(x) -> Factor: return elementwise("sign", F.signum, x)
def exp(x) -> Factor: return elementwise("exp", F.exp, x)
def sqrt(x) -> Factor: return elementwise("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)), x)
def floor(x) -> Factor: return elementwise("floor", lambda c: F.floor(c).cast("double"), x)


def log(x) -> Factor:
    """log(x + 1) of a column; the plain logarithm of an int constant."""
    if isinstance(x, int):
        return lift(math.log(x))
    return elementwise("log1p", lambda c: F.when(c == -1, F.lit(-math.inf)).otherwise(F.log1p(c)), x)


def ln(x) -> Factor: return elementwise("ln", lambda c: F.when(c > 0, F.ln(c)), x)
def power(x, n) -> Factor: return elementwise("pow", lambda c, k: finite_or_null(F.pow(c, k)), x, n)


def _all(fn, cols):
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return F.when(ok, fn(*cols))


def maximum(*xs) -> Factor: return elementwise("max", lambda *c: _all(F.greatest, c), *xs)
def minimum(*xs) -> Factor: return elementwise("min", lambda *c: _all(F.least, c), *xs)


def _truth(c: Column) -> Column:
    """Missing counts as true, zero as false."""
    return F.coalesce(c.cast("boolean"), F.lit(True))


def both(a, b) -> Factor: return elementwise("and", lambda x, y: _truth(x) & _truth(y), a, b)
def either(a, b) -> Factor: return elementwise("or", lambda x, y: _truth(x) | _truth(y), a, b)


def _compare(name, fn, on_missing=False):
    return lambda a, b: elementwise(name, lambda x, y: F.coalesce(fn(x, y), F.lit(on_missing)), a, b)


gt = _compare("gt", lambda x, y: x > y)
lt = _compare("lt", lambda x, y: x < y)
ge = _compare("ge", lambda x, y: x >= y)
le = _compare("le", lambda x, y: x <= y)
eq = _compare("eq", lambda x, y: x == y)
ne = _compare("ne", lambda x, y: x != y, True)


def where(cond, a, b) -> Factor:
    return elementwise("where", lambda c, x, y: F.when(_truth(c), x).otherwise(y), cond, a, b)


def masked(x, cond) -> Factor:
    """x where the condition holds, else 0."""
    return elementwise("filter", lambda c, k: F.when(k, c).when(~k & c.isNotNull(), F.lit(0.0)), x, cond)


# ---- panel preparation and alignment -------------------------------------------------------------


def dedupe_last(panel: DataFrame, ingest: Sequence[str]) -> DataFrame:
    """One row per (datetime, instrument): the one ingested last."""
    rest = [c for c in panel.columns if c not in (INSTRUMENT, TIME)]
    best = panel.groupBy(INSTRUMENT, TIME).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in ingest])).alias("__row")
    )
    return best.select(INSTRUMENT, TIME, "__row.*").select(*panel.columns)


def with_return(panel: DataFrame, price: str = "close") -> DataFrame:
    moved = neighbour(panel, [INSTRUMENT], [TIME], {"__prev": F.col(price)}, -1)
    change = F.when(F.col("__prev") != 0, F.col(price) / F.col("__prev") - 1)
    return moved.withColumn("ret", F.coalesce(change, F.lit(0.0))).drop("__prev")


def align_on_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right side reindexed to the left keys."""
    return left.join(right, [INSTRUMENT, TIME], "left")


def align_as_of(panel: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Date-only series carried onto panel rows: the value of the last series date at or before the row.

    Both sides are reduced to distinct dates before the ordered fill, so it runs over the calendar only.
    """
    days = panel.select(TIME).distinct().select(TIME, F.lit(1).alias("__p"))
    marked = days.unionByName(series.select(TIME, F.lit(0).alias("__p"), F.struct(F.col(value).alias("v")).alias("__v")), allowMissingColumns=True)
    per_day = marked.groupBy(TIME).agg(F.max("__p").alias("__p"), F.first("__v", ignorenulls=True).alias("__v"))
    filled = running_last(per_day, [], [TIME], "__v").where("__p = 1")
    return panel.join(filled.select(TIME, F.col("__v")["v"].alias(value)), TIME, "left")


def next_return_label(price="close") -> Factor:
    """Ref(close, -2) / Ref(close, -1) - 1."""
    return divide(lead_rows(price, 2), lead_rows(price, 1)) - 1


def mask_bad_prices(signal: DataFrame, prices: DataFrame, value: str = "signal", price: str = "close") -> DataFrame:
    bad = prices.select(INSTRUMENT, TIME, ((F.col(price) == 0) | F.col(price).isNull()).alias("__bad"))
    joined = signal.join(bad, [INSTRUMENT, TIME], "left")
    return joined.withColumn(value, F.when(~F.coalesce("__bad", F.lit(False)), F.col(value))).drop("__bad")


COMMUTATIVE = ("add", "mul", "eq", "ne", "and", "or")


def subtree_rows(name: str, f: Factor) -> list[tuple[str, str, int]]:
    """(factor, subtree key, size) for every sub-expression; operands of commutative operators are sorted."""
    rows: list[tuple[str, str, int]] = []

    def walk(g: Factor) -> tuple[str, int]:
        parts = [walk(a) for a in g.args]
        head = g.key.split("(", 1)[0]
        if not parts:
            key, size = g.key, 1
        else:
            keys = [k for k, _ in parts]
            tail = g.key[g.key.rfind(")", 0, -1) + 1 :] if head not in COMMUTATIVE else ""
            key = f"{head}({','.join(sorted(keys) if head in COMMUTATIVE else keys)}{tail}"
            size = 1 + sum(n for _, n in parts)
        rows.append((name, key, size))
        return key, size

    walk(f)
    return rows


def drop_missing_factors(factors: Mapping[str, Callable[[], Factor]]) -> tuple[dict[str, Factor], dict[str, str]]:
    """Build each factor; the ones that cannot be built are reported, not fatal."""
    good, bad = {}, {}
    for name, make in factors.items():
        try:
            good[name] = make()
        except (ValueError, TypeError, KeyError) as err:
            bad[name] = str(err)
    return good, bad

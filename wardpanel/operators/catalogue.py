"""Named factor sets over open, high, low, close, volume (and vwap)."""

from __future__ import annotations

from wardpanel.operators import panel as p
from wardpanel.operators.panel import Factor

EPS = 1e-12
WINDOWS = (5, 10, 20, 30, 60)


def _range_position(w: int) -> Factor:
    low = p.ts_min("low", w)
    return (p.column("close") - low) / (p.ts_max("high", w) - low + EPS)


def candle() -> dict[str, Factor]:
    o, h, l, c = (p.column(n) for n in ("open", "high", "low", "close"))
    span = h - l + EPS
    top, bottom = h - p.maximum(o, c), p.minimum(o, c) - l
    shift = 2 * c - h - l
    return {
        "KMID": (c - o) / o, "KLEN": (h - l) / o, "KMID2": (c - o) / span,
        "KUP": top / o, "KUP2": top / span, "KLOW": bottom / o, "KLOW2": bottom / span,
        "KSFT": shift / o, "KSFT2": shift / span,
    }


def _ups_downs(x: str, w: int, names: tuple[str, str, str]) -> dict[str, Factor]:
    step = p.column(x) - p.delay(x, 1)
    total = p.ts_sum(p.absolute(step), w) + EPS
    up = p.ts_sum(p.maximum(step, 0), w)
    down = p.ts_sum(p.maximum(p.delay(x, 1) - p.column(x), 0), w)
    return {f"{names[0]}{w}": up / total, f"{names[1]}{w}": down / total, f"{names[2]}{w}": (up - down) / total}


def _as_number(f: Factor) -> Factor:
    return p.elementwise("number", lambda c: c.cast("double"), f)


def window_family(w: int) -> dict[str, Factor]:
    c, v = p.column("close"), p.column("volume")
    prev, line = p.delay("close", 1), p.trend("close", w)
    top, low = p.first_max("high", w), p.first_min("low", w)
    rising, falling = p.ts_mean(_as_number(p.gt("close", prev)), w), p.ts_mean(_as_number(p.lt("close", prev)), w)
    weight = p.absolute(c / prev - 1) * v
    out = {
        f"ROC{w}": p.delay("close", w) / c, f"MA{w}": p.ts_mean("close", w) / c, f"STD{w}": p.ts_std("close", w) / c,
        f"BETA{w}": line["slope"] / c, f"RSQR{w}": line["r2"], f"RESI{w}": line["rest"] / c,
        f"MAX{w}": p.ts_max("high", w) / c, f"MIN{w}": p.ts_min("low", w) / c,
        f"QTLU{w}": p.ts_quantile("close", w, 0.8) / c, f"QTLD{w}": p.ts_quantile("close", w, 0.2) / c,
        f"RANK{w}": p.ts_rank("close", w), f"RSV{w}": _range_position(w),
        f"IMAX{w}": top / w, f"IMIN{w}": low / w, f"IMXD{w}": (top - low) / w,
        f"CORR{w}": p.ts_corr("close", p.ln(v + 1), w),
        f"CORD{w}": p.ts_corr(c / prev, p.ln(v / p.delay("volume", 1) + 1), w),
        f"CNTP{w}": rising, f"CNTN{w}": falling, f"CNTD{w}": rising - falling,
        f"VMA{w}": p.ts_mean("volume", w) / (v + EPS), f"VSTD{w}": p.ts_std("volume", w) / (v + EPS),
        f"WVMA{w}": p.ts_std(weight, w) / (p.ts_mean(weight, w) + EPS),
    }
    out.update(_ups_downs("close", w, ("SUMP", "SUMN", "SUMD")))
    out.update(_ups_downs("volume", w, ("VSUMP", "VSUMN", "VSUMD")))
    return out


def set_20() -> dict[str, Factor]:
    o, h, l, c, v = (p.column(n) for n in ("open", "high", "low", "close", "volume"))
    out = {"ROC0": (c - o) / o, "ROC1": c / p.delay("close", 1) - 1}
    for w in (5, 10, 20):
        out[f"ROC{w}"] = (c - p.delay("close", w)) / p.delay("close", w)
    for w in (5, 10):
        out[f"VRATIO{w}"] = v / p.ts_mean("volume", w)
        out[f"VOLATILITY{w}"] = p.ts_std("close", w) / c
        out[f"RSV{w}"] = _range_position(w)
    out["VSTD5_RATIO"] = p.ts_std("volume", 5) / p.ts_mean("volume", 5)
    out["RANGE"] = (h - l) / o
    out["RET_VOL5"] = p.ts_std(c / p.delay("close", 1) - 1, 5)
    out["HIGH_RATIO5"] = c / p.ts_max("high", 5) - 1
    out["LOW_RATIO5"] = c / p.ts_min("low", 5) - 1
    out["SHADOW_RATIO"] = (h - c) / (c - l + EPS)
    out["BODY_RATIO"] = (c - o) / (h - l + EPS)
    out["MA_RATIO5_10"] = p.ts_mean("close", 5) / p.ts_mean("close", 10) - 1
    out["MA_RATIO10_20"] = p.ts_mean("close", 10) / p.ts_mean("close", 20) - 1
    return out


def set_158(vwap: str = "vwap", windows=WINDOWS) -> dict[str, Factor]:
    out = candle()
    for name, col in (("OPEN0", "open"), ("HIGH0", "high"), ("LOW0", "low"), ("VWAP0", vwap)):
        out[name] = p.column(col) / "close"
    for w in windows:
        out.update(window_family(w))
    return out


MULTI_FAMILIES = ("ROC", "MA", "STD", "MAX", "MIN", "RSV", "VMA", "VSTD", "CORR")


def set_multi(windows=WINDOWS, extended=(3, 7, 15, 40, 120)) -> dict[str, Factor]:
    shapes = candle()
    out = {n: shapes[n] for n in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")}
    for w in windows:
        family = window_family(w)
        out.update({f"{n}{w}": family[f"{n}{w}"] for n in MULTI_FAMILIES})
    for w in extended:
        family = window_family(w)
        out.update({f"{n}{w}": family[f"{n}{w}"] for n in MULTI_FAMILIES[:3]})
    return out

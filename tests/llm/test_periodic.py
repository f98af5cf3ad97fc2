"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from wardpanel.llm.periodic import find_runs, periodic_runs, with_digests
from wardpanel.llm.queries import QUERIES, repeat_tail


def plain_runs(words, least=24):
    """Every period on its own: maximal stretches of at least three periods, less those that have a smaller period."""
    n, found = len(words), []
    ids = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, dtype=np.int64)
    for q in range(1, n // 3 + 1):
        turn = np.diff(np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)):
            if b - a >= 2 * q and not any(x <= a and b + q <= x + m and q % p == 0 for x, m, p in found):
                found.append((int(a), int(b - a) + q, q))
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def answer(doc_id, text, least=24):
    words = repeat_tail(doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    runs = plain_runs(words, least)
    gone = set()
    for a, n, q in runs:
        gone.update(range(a + q, a + n))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def periodic_word(rng, depth):
    """Letters with repeated parts inside repeated parts."""
    if not depth:
        return [rng.choice("abc") for _ in range(rng.randint(1, 6))]
    out = []
    for _ in range(rng.randint(1, 3)):
        part = periodic_word(rng, depth - 1)
        out += part * rng.choice([1, 1, 2, 3, 4, 7])
        out += part[: rng.randint(0, len(part))]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_nested_repeats(seed):
    rng = random.Random(seed)
    texts = [periodic_word(rng, rng.randint(0, 4))[:1500] for _ in range(30)] + [[], ["a"], ["a"] * 100, ["a", "b"] * 40, list("aab" * 33 + "a")]
    known = {w: i for i, w in enumerate("abc")}
    counts = np.array([len(t) for t in texts])
    start, length, period = find_runs(np.array([known[w] for t in texts for w in t], dtype=np.int64), counts)
    begin = np.cumsum(counts + 1) - (counts + 1)
    got = sorted(zip(start.tolist(), length.tolist(), period.tolist()))
    want = sorted((int(b) + a, n, q) for b, t in zip(begin, texts) for a, n, q in plain_runs(t, 0))
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_long_periods(seed):
    """Periods of hundreds of words, made of highly periodic pieces, of structured words and of noise."""
    rng = random.Random(seed)
    swap = [0]
    for _ in range(9):
        swap += [1 - x for x in swap]
    pieces = [["x"] * rng.randint(1, 90), [str(x) for x in swap[: rng.randint(20, 400)]], [rng.choice("abcd") for _ in range(rng.randint(1, 200))], ["x", "y"] * rng.randint(1, 60)]
    rng.shuffle(pieces)
    unit = sum(pieces, [])
    for times, tail in ((3, 0), (3, 1), (4, rng.randint(0, len(unit) - 1)), (2, len(unit) - 1)):
        words = ["head"] * rng.randint(0, 5) + unit * times + unit[:tail] + ["end"]
        known = {w: i for i, w in enumerate(sorted(set(words)))}
        start, length, period = find_runs(np.array([known[w] for w in words]), np.array([len(words)]))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == sorted(plain_runs(words, 0))


def test_query_columns(spark, frame):
    rng = random.Random(5)
    rows = [(i, " \t\n"[i % 3].join(periodic_word(rng, 3)[:400])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "a " * 30), (None, None), (7, "a b c " * 20), (7, rows[7][1]), (203, "é x " * 30), (204, "x\u0085y " * 8 + "z")]
    out = with_digests(periodic_runs(frame(rows), prepare=repeat_tail)).collect()
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in out]
    plain = [answer(i, t) if i is not None else (None, *answer(0, t)[1:]) for i, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, plain))


def test_empty_table_and_bad_length(spark, frame):
    assert periodic_runs(frame([(1, "a")]).where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(frame([(1, "a")]), least_length=0)


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect())
    want = sorted(answer(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got == want

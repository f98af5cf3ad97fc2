"""Passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.llm import common, suffix_dedup
from wardpanel.llm.near_dedup import keep_one
from wardpanel.llm.substring_dedup import remove_repeated_words
from wardpanel.llm.suffix_dedup import compare_runs, remove_repeated_bytes, sort_suffixes


def brute(units, size):
    """Removed flags per document from all windows of all documents."""
    seen = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def corpus(seed, unit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, unit)))
    text = lambda n: "".join(word() + rng.choice([" ", " ", "\n", " \t"]) for _ in range(n))
    shared = [text(rng.randint(10, 120)) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(20, len(s))], text(rng.randint(0, 20))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, "loop " * 90), (103, "loop " * 33), (104, ""), (105, None), (106, None), (rows[5][0], rows[5][1]), (None, rows[6][1]), (None, "alone"), (7, "other text of a repeated id")]
    return rows


def spans(gone):
    edge = "".join("x" if g else "." for g in gone)
    return [(m.start(), len(m.group())) for m in re.finditer("x+", edge)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [256, 1])
def test_bytes(spark, frame, seed, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", crowd)
    rows = corpus(seed, 6)
    units = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, 80)):
        want.append((i, bytes(b for b, g in zip(u, gone) if not g), spans(gone), len(u), sum(gone)))
    got = [(r.doc_id, bytes(r.kept), [tuple(s) for s in r.spans], r.n_units, r.n_removed) for r in remove_repeated_bytes(frame(rows), length=80, gram=16).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    assert sum(r[4] for r in want) > 1000


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, frame, seed):
    rows = corpus(seed, 3)
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, 12)):
        want.append((i, " ".join(w for w, g in zip(u, gone) if not g).encode(), spans(gone), len(u), sum(gone)))
    got = [(r.doc_id, bytes(r.kept), [tuple(s) for s in r.spans], r.n_units, r.n_removed) for r in remove_repeated_words(frame(rows), window=12, gram=3).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    assert sum(r[4] for r in want) > 100


def test_empty_table(spark, frame):
    empty = frame([(1, "a")]).where("false")
    assert remove_repeated_bytes(empty).count() == 0
    assert remove_repeated_words(empty).count() == 0


def test_sort_suffixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 99, (300, 24)).astype(np.uint8)
    rows[100:150] = rows[:50]
    rows[150:200, :13] = rows[:50, :13]
    order, prefix = sort_suffixes(rows, np.full(300, 24))
    ranked = [rows[i].tobytes() for i in order]
    assert ranked == sorted(ranked)
    common = lambda a, b: next((k for k in range(24) if a[k] != b[k]), 24)
    assert [0] + [common(a, b) for a, b in zip(ranked, ranked[1:])] == prefix.tolist()


def test_compare_runs_needs_both_sides():
    left, right = [b"xxab", b"yyab", b"zzab"], [b"cdefgh", b"cdefgh", b"cdeQQQ"]
    again = compare_runs(left, right, np.array([5, 5, 5]), np.array([1, 1, 1]), 6)
    assert [np.flatnonzero(a).tolist() for a in again] == [[0, 1, 2], [0, 1, 2], []]


def test_long_text(spark, frame):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(60000))
    rows = [(1, text), (2, text[5000:6000]), (3, "short")]
    got = {r.doc_id: (r.n_units, r.n_removed) for r in remove_repeated_bytes(frame(rows)).collect()}
    assert got == {1: (len(text), 1000), 2: (1000, 1000), 3: (5, 0)}


def test_texts_of_null_ids_with_equal_short_hashes(spark, frame):
    """Two texts under a null id whose 32-bit hashes are the same: only one of them holds the repeated passage."""
    passage = " ".join(f"shared{i:03d}" for i in range(60))
    make = lambda kind, body: spark.range(150_000).select(F.concat(F.lit(body), F.lit(f" {kind}"), F.col("id").cast("string")).alias(kind)).withColumn("h", F.hash(kind))
    other = " ".join(f"single{i:03d}" for i in range(70))
    a, b, _ = make("a", passage).join(make("b", other), "h").select("a", "b", "h").orderBy("h").first()
    docs = frame([(None, a), (None, b), (1, passage)])
    for remove, unit in ((remove_repeated_bytes, lambda t: len(t)), (remove_repeated_words, lambda t: len(t.split()))):
        got = remove(docs).select("doc_id", "kept", "n_removed").collect()
        want = {None: sorted([0, unit(passage)]), 1: [unit(passage)]}
        assert {i: sorted(r.n_removed for r in got if r.doc_id == i) for i in (None, 1)} == want
        assert [bytes(r.kept).decode() for r in got if r.doc_id is None and not r.n_removed] == [b]
    assert sorted(r.text for r in keep_one(docs).collect()) == sorted([a, b])


def swaps(bits, a, b):
    """The recursive swap sequence and its complement: equal under every polynomial hash modulo a power of two once they are long."""
    out = [0]
    for _ in range(bits):
        out += [1 - x for x in out]
    return [a if x == 0 else b for x in out], [b if x == 0 else a for x in out]


def test_prime_hashes():
    rng = np.random.default_rng(0)
    p = (1 << 61) - 1
    a, b = (rng.integers(0, p, 1000, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = [p - 1, 0], [p - 1, 5]
    assert common.mul_mod(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    tokens = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    for which in (0, 1):
        base, h = common._BASES[which] % p, common.PrimeRolling(tokens, which)
        plain = lambda i, j: sum(int(t) * pow(base, j - 1 - k, p) for k, t in enumerate(tokens[i:j].tolist(), i)) % p
        assert h.windows(40).tolist() == [plain(i, i + 40) for i in range(261)]
        assert h.span(np.array([0, 7, 299]), np.array([300, 9, 300])).tolist() == [plain(0, 300), plain(7, 9), plain(299, 300)]


def test_structured_texts_do_not_collide(spark, frame):
    """Words, runs of words and strings of bytes made of swap sequences differ, and nothing is removed from them."""
    one, two = swaps(12, "a", "b")
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {''.join(one)}"), (2, f"{same} {''.join(two)}")]
    assert [r.n_removed for r in remove_repeated_words(frame(rows)).collect()] == [0, 0]
    nine, other = swaps(9, "a", "b")
    got = remove_repeated_bytes(frame([(1, "".join(nine)), (2, "".join(other))]), length=512, gram=64).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]
    ten, back = swaps(10, "xx", "yy")
    got = remove_repeated_words(frame([(1, " ".join(ten)), (2, " ".join(back))]), window=1024, gram=30).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("remove", [remove_repeated_bytes, remove_repeated_words])
def test_many_equal_rows(spark, remove):
    """Rows that repeat in id and text are copies of each other, in time that grows with their number."""
    text = " ".join(f"word{i % 700} {i}" for i in range(450))
    few = spark.createDataFrame([(None, "alone " * 3), (5, text + " tail")], "doc_id long, text string")
    many = spark.range(6000).selectExpr("CAST(NULL AS long) AS doc_id", f"'{text}' AS text").unionByName(few)
    got = remove(many).groupBy("doc_id", "n_units", "n_removed").count().collect()
    left = len(" tail") if remove is remove_repeated_bytes else 1
    assert sorted((r.doc_id is None, r.n_units - r.n_removed, r["count"]) for r in got if r.n_removed) == [(False, left, 1), (True, 0, 6000)]

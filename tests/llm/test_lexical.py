"""Ranked search against a plain scan of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wardpanel.llm import lexical
from wardpanel.llm.lexical import Best, build_index, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        scores = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n // total
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "an", "été", "Über", "x1", "42", "语言"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda size: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=size))
    docs = [(i, text(rng.choice([1, 2, 5, 20, 20, 20, 200]))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " .,_- "), (None, docs[3][1]), (None, "the x1"), (4, docs[4][1]), (4, "another w5"), (n + 4, "the " * 30_000)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]
    items = [(i, text(rng.randint(1, 15))) for i in range(20)] + [(20, None), (21, ""), (22, "unknown"), (23, "the"), (23, "the"), (23, "w7 THE"), (None, "w3")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_scan(spark, frame, seed, small, monkeypatch):
    if small:  # many blocks, several blocks of items, several accumulators a block
        for name, value in (("BLOCK_DOCS", 7), ("ITEM_TERMS", 40), ("ITEM_ROWS", 3), ("FIRST_STRATA", 1)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(seed)
    found = search(build_index(frame(docs)), frame(items, "item_id long, text string, id string, v int"), k=10).collect()
    assert sorted(map(tuple, found), key=repr) == plain(docs, items, 10)


def test_strata(spark, frame):
    """A block holds documents of one normaliser only, and postings that lead back to the texts."""
    docs, _ = corpus(3)
    index = build_index(frame(docs))
    counted = sorted((i, sum(c.values()), tuple(sorted(c.items()))) for i, t in docs if i is not None and (c := Counter(words(t))))
    seen = []
    for b in index.blocks.collect():
        held = [Counter() for _ in b.ids]
        groups, tfs, counts, docs_of = (np.frombuffer(b[c], dtype=d).tolist() for c, d in (("groups", "<i4"), ("tfs", "<i4"), ("counts", "<u2"), ("docs", "<u2")))
        group = post = 0
        for term, size in zip(bytes(b.terms).split(), groups):
            assert tfs[group : group + size] == sorted(set(tfs[group : group + size]), reverse=True)
            for g in range(group, group + size):
                for d in docs_of[post : post + counts[g]]:
                    held[d][term.decode()] = tfs[g]
                post += counts[g]
            group += size
        assert all(50 + 50 * c.total() * index.documents // index.length == b.m for c in held)
        seen += [(i, c.total(), tuple(sorted(c.items()))) for i, c in zip(b.ids, held) if i >= 0]
    assert sorted(seen) == counted


def test_best_keeps_ties():
    best = Best(2, np.ones(3, dtype=np.int64))
    best.add(np.array([1, 1, 1, 0]), np.array([5, 5, 5, 1]), np.array([9, 4, 7, 8]))
    best.add(np.array([1]), np.array([5]), np.array([2]))
    assert best.held[1][1].tolist() == [2, 4] and best.least.tolist() == [1, 5, 1]


def test_empty_tables(spark, frame):
    some = frame([(1, "a b")])
    items = some.select(some.doc_id.alias("item_id"), "text")
    none = build_index(some.where("false"))
    assert none is None and build_index(frame([(1, None), (2, "--")])) is None
    found = search(none, items)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert search(build_index(some), items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in search(build_index(frame([(1, "a b"), (2, "c")])), items).collect()] == [(1, 1, 1)]

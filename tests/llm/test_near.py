"""Near-duplicate classes against all pairs, and the sampling against its definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wardpanel.llm import near_dedup
from wardpanel.llm.components import components
from wardpanel.llm.near_dedup import BIN_SHIFT, bin_weights, distinct_shingles, keep_one, near_classes, spanning_links, text_shingles, weighted_samples


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 7)))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(base) // 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, rng.choice([" ", "  "]).join(copy) + rng.choice(["", ".", "\n"])))
            i += 1
    rows += [(500, rows[0][1].upper()), (501, "a b"), (502, "A, b!"), (503, ""), (504, None), (505, "..."), (506, "a b c"), (0, rows[0][1]), (0, "another text under a known id"), (None, rows[1][1]), (507, "x " * 40_000)]
    return rows


def brute(rows, weight, similarity):
    def shingles(text):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
        return Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w)))))

    sets = [shingles(t) for _, t in rows]
    known = {}
    for s in sets:
        for g in s:
            if g not in known:
                known[g] = float(weight[int(text_shingles([" ".join(g).encode()])[0][0] >> BIN_SHIFT)])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = sum(min(n, sets[b][g]) * known[g] for g, n in sets[a].items() if g in sets[b])
            total = sum(n * known[g] for s in (sets[a], sets[b]) for g, n in s.items()) - shared
            if sets[a] == sets[b] or total and shared / total >= similarity:
                parent[root(a)] = root(b)
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    least = {}
    for a in range(len(rows)):
        least[root(a)] = min(least.get(root(a), 1 << 62), ids[a])
    return Counter((rows[a][0], None if least[root(a)] == -(1 << 63) else least[root(a)]) for a in range(len(rows)))


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3)])
def test_classes(spark, frame, seed, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PAIR_MEMBERS", 12 if block > 3 else 1)
    rows = corpus(seed)
    docs = frame(rows)
    weight = bin_weights(near_dedup.documents(docs, "doc_id", "text"))
    got = near_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute(rows, weight, 0.8)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got if r.class_id not in (0, None))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect() if r.doc_id != 0) == sorted((c if c is not None else -1) for c in sizes if c != 0)


def test_empty(spark, frame):
    assert near_classes(frame([(1, "a")]).where("false")).count() == 0
    assert keep_one(frame([(1, None), (1, None), (2, "")])).count() == 1


def test_sampling_follows_weighted_jaccard():
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    w = rng.uniform(0.5, 4, 300).astype(np.float32)
    other = np.where(rng.random(300) < 0.3, w * rng.uniform(0.3, 1, 300), w).astype(np.float32)
    both = weighted_samples(np.concatenate([hashes, hashes]), np.concatenate([w, other]), np.array([300, 300]), 4000)
    assert abs((both[0] == both[1]).mean() - np.minimum(w, other).sum() / np.maximum(w, other).sum()) < 0.03


def test_shingles():
    hashes, counts, content = text_shingles([b"A b, c D e f", b"a b c d E F!", b"", b"a b", b"a b c d e a b c d e"])
    assert counts.tolist() == [2, 2, 0, 1, 6]
    assert hashes[:2].tolist() == hashes[2:4].tolist() and (content[0] == content[1]).all()
    h, times, n = distinct_shingles(hashes, counts)
    assert n.tolist() == [2, 2, 0, 1, 5] and sorted(times.tolist()) == [1] * 9 + [2]


def test_exact_similarity():
    texts = [b"a b c d e f g h", b"a b c d e f g x", b"", b"a b c d e a b c d e", b"a b c d e", b"q r"]
    table = np.linspace(1, 2, near_dedup.BINS).astype(np.float32)
    got = near_dedup.exact_similarity(texts, table, np.arange(6), np.arange(6))

    def weigh(t):
        h, times, _ = distinct_shingles(*text_shingles([t])[:2])
        return {int(x): (n, float(table[int(x >> BIN_SHIFT)])) for x, n in zip(h, times.tolist())}

    for i, a in enumerate(map(weigh, texts)):
        for j, b in enumerate(map(weigh, texts)):
            if i == j:
                continue
            shared = sum(min(n, b[x][0]) * w for x, (n, w) in a.items() if x in b)
            total = sum(n * w for s in (a, b) for n, w in s.values()) - shared
            assert got[i, j] == pytest.approx(shared / total if total else 0)


def test_spanning_links_follow_agreement():
    samples = np.zeros((3, 64), dtype=np.uint32)
    samples[1, :10] = 1
    samples[2, :20] = 1
    assert spanning_links(samples) == [(0, 1), (1, 2)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def true_brute(rows, similarity):
    """Linked pairs by the definition: document frequencies of the shingles themselves, against the number of documents."""
    sets = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    df = Counter(g for s in sets for g in s)
    weight = {g: 1 + np.log((1 + len(rows)) / (1 + n)) / np.log(2 + len(rows)) for g, n in df.items()}
    pairs = set()
    for a in range(len(rows)):
        for b in range(a):
            shared = sum(min(n, sets[b][g]) * weight[g] for g, n in sets[a].items() if g in sets[b])
            if shared and shared / (sum(n * weight[g] for s in (sets[a], sets[b]) for g, n in s.items()) - shared) >= similarity:
                pairs.add((rows[b][0], rows[a][0]))
    return pairs


def test_weights_follow_true_counts(spark, frame, monkeypatch):
    """One common passage in 150 texts; pairs whose similarity is above 0.8 only without, or below it only with, the true idf."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(near_dedup, "BUCKET_BYTES", 4000)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = [word() for _ in range(64)]
    rows = [(i, " ".join([*(word() for _ in range(60)), *passage])) for i in range(150)]
    for i in range(20):  # twins that share the passage and differ in n words at the end: weights decide
        own = [word() for _ in range(30)]
        n = 5 + i % 10
        rows += [(1000 + 2 * i + j, " ".join([*passage, *own, *(word() for _ in range(n))])) for j in (0, 1)]
    want = {p for p in true_brute(rows, 0.8) if p[0] >= 1000}
    flat = set()
    for i in range(20):
        n = 5 + i % 10
        if 90 / (90 + 2 * n) >= 0.8:
            flat.add((1000 + 2 * i, 1001 + 2 * i))
    got = {r.doc_id: r.class_id for r in near_classes(frame(rows)).collect()}
    assert {(c, i) for i, c in got.items() if c != i} == want
    assert want != flat

    blocks = near_dedup.stage(near_dedup.text_blocks(near_dedup.documents(frame(rows), "doc_id", "text")))
    assert blocks.count() > 5
    signed, total = near_dedup.signatures(blocks)
    df = Counter(h for _, t in rows for h in set(text_shingles([t.encode()])[0].tolist()))
    texts, unpack = dict(rows), near_dedup.zstandard.ZstdDecompressor()
    assert total == len(rows)
    for r in signed.select("id", "df").collect():
        h = distinct_shingles(*text_shingles([texts[r.id].encode()])[:2])[0]
        assert near_dedup._unpacked(r.df, unpack).tolist() == [df[x] for x in h.tolist()]


def test_many_shingles_keep_their_own_counts(spark, frame):
    """More different shingles than there were bins: each is in one text, so each weighs the same."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 60, 60_000))) for i in range(10)]
    signed, total = near_dedup.signatures(near_dedup.stage(near_dedup.text_blocks(near_dedup.documents(frame(rows), "doc_id", "text"))))
    unpack = near_dedup.zstandard.ZstdDecompressor()
    assert all((near_dedup._unpacked(r.df, unpack) == 1).all() for r in signed.select("df").collect()) and total == 10

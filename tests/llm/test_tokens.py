"""Packing, byte-level BPE and the digest index against the libraries and brute force."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardpanel.llm.bpe import decode_corpus, encode_corpus, read_ranks
from wardpanel.llm.digest_index import DigestIndex, add_new, drop_copies
from wardpanel.llm.packing import WordEncoder, best_cuts, pack, sentence_marks, split_tail
from wardpanel.llm.queries import split_pattern, tokenizer_file

ODD = [
    "", None, None, " ", "\n\n", "  lead and trail  ", "a\n\nb \n c\t\td", "don't we'LL I'm he's", "12 345,678.9 x2y", "naïve Straße ÉCOLE ½ ²", "İstanbul ΣΊΣΥΦΟΣ",
    "é café", "日本語のテスト 中文", "a b   c　  d", "x\x1cy\x1d z\x85w", "emoji 😀👍🏽 ok", "<|endoftext|> in<|startoftext|>side", "nul\0byte \0", "!!! ?? ... #tag @you", "́ mark first",
    "   word", "a \n", "word" * 3000, "tab\tend\t", "\r\n\r\nwin", "mixed​zero",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgüéñ'.,;!?-1 23") for _ in range(rng.randint(1, 9)))
    out = [(i, t) for i, t in enumerate(ODD)]
    out += [(100 + i, rng.choice([" ", "\n", ". "]).join(word() for _ in range(rng.randint(1, 400)))) for i in range(60)]
    return out + [(100, out[40][1]), (105, out[31][1]), (105, out[31][1]), (None, "no id"), (None, None)]


def test_byte_bpe(spark, frame, rows):
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoder = tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=read_ranks(path), special_tokens={})
    got = decode_corpus(encode_corpus(frame(rows), path, split_pattern(), block_bytes=3000, buckets=5), path).collect()
    want = Counter((i, tuple(encoder.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    both = encode_corpus(frame(rows), path, split_pattern(), block_bytes=3000, buckets=5, decoded_col="text").collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.text)) for r in both) == want
    assert encode_corpus(frame(rows).where("false"), path, split_pattern()).count() == 0


def test_read_ranks(tmp_path):
    file = tmp_path / "ranks"
    file.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert read_ranks(str(file))[b"a"] == 97


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_pack(spark, frame, rows, block):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pieces = pack(frame(rows), path, length=256, block_tokens=block).collect()
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    chains, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        chains[(p.doc_id, p.doc_tokens)].append((p.start, tuple(ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert Counter(i for (_, n), parts in chains.items() for _, ids in parts for i in ids) == Counter(i for (_, ids), n in want.items() for i in ids * n)
    for (i, ids), n in want.items():
        if n == 1 and sum(1 for (j, other) in want if j == i and len(other) == len(ids)) == 1:
            assert sum((x for _, x in sorted(chains[(i, len(ids))])), ()) == ids
    assert pack(frame(rows).where("false"), path).count() == 0


def test_words_equal_the_tokenizer(rows):
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = WordEncoder(f.read())
    words = sorted({w.decode() for _, t in rows for w in (t or "").encode().split()})
    flat, sizes = encoder.encode_words(words)
    ends = np.cumsum(sizes)
    got = [flat[e - n : e].tolist() for e, n in zip(ends, sizes)]
    assert got == [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    marks = sentence_marks(encoder.tokenizer.get_vocab())
    assert marks[encoder.tokenizer.token_to_id(".</w>")] and not marks[encoder.tokenizer.token_to_id("a</w>")]


def test_best_cuts_is_optimal():
    rng = random.Random(3)
    for _ in range(40):
        places = np.array([0, *sorted(rng.sample(range(1, 300), 30)), 300])
        gaps = np.diff(places)
        if gaps.max() > 64:
            continue
        costs = np.array([0, *[rng.choice([0, 4, 24]) for _ in range(30)], 0])
        best = {0: 0}
        for j in range(1, len(places)):
            steps = [(places[j] - places[i], i) for i in range(j) if places[j] - places[i] <= 64]
            best[j] = min(best[i] + (0 if n & (n - 1) == 0 else 64 - n) for n, i in steps) + costs[j]
        chain = best_cuts(places, costs, 64)
        price = sum((0 if n & (n - 1) == 0 else 64 - n) for n in np.diff(chain)) + sum(costs[np.searchsorted(places, chain)])
        assert price == best[len(places) - 1]
    assert split_tail(10, 23) == [18, 22, 23]


def test_digest_index(spark, frame):
    index = DigestIndex(spark, buckets=4)
    first = [(1, "Aa"), (2, "aA"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (7, "X" * 300_000), (None, "aa"), (None, "lone")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in add_new(frame(first), index).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, True), (None, None, 1, True)}
    later = DigestIndex(spark, index.path, buckets=4)
    got = {(r.doc_id, r.keep_id, r.kept) for r in add_new(frame([(20, "AA"), (21, "new"), (22, "NEW")]), later).collect()}
    assert got == {(20, 2, False), (21, 22, False), (22, 22, True)}
    assert later.rows().count() == 7
    assert add_new(frame(first).where("false"), later).count() == 0
    plan = later.unknown(later.rows())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_drop_copies(spark, frame):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (None, "n"), (None, "N"), (5, "b")]
    kept = drop_copies(frame(rows), DigestIndex(spark, buckets=4))
    assert kept.columns == ["doc_id", "text", "id", "v"]
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()) == [(0, "n"), (2, "a"), (4, ""), (5, "b")]

"""Order-preserving packing of token streams into sequences, by dynamic programming over cut places."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wardpanel.llm.common import SPACE, documents, id_back, pieces, text_slices, word_spans

LENGTH = 4096
#: Costs in tokens of padding: a cut at the end of a sentence, and a cut elsewhere.
SENTENCE_CUT = 4
INNER_CUT = 24
#: Inside a stretch without sentence ends, a cut is allowed every so many tokens.
STRETCH = 256
BLOCK_TOKENS = 1 << 20
END_ID = 2


#: Words of these letters are their own normal form but for case; \x00 marks the end of a word below.
PLAIN = re.compile("[\x01-\x08\x0e-\x1b!-\x7f\x80-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]+")


class WordEncoder:
    """Token ids of texts by a `tokenizers` file whose pre-tokenizer never crosses ASCII white space.

    Every distinct word is encoded once per piece; the words of a piece are found and counted as Arrow arrays.
    Words of plain Latin letters go through the same merges held as tiktoken ranks, many words in one call,
    which is some ten times faster; all others go through the tokenizer itself.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        model = json.loads(definition)["model"]
        self.split = regex.compile(json.loads(definition)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        byte = _letters_to_bytes()
        raw = lambda token: bytes(byte[c] for c in token.removesuffix("</w>")) + b"\0" * token.endswith("</w>")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 255 + b for b in range(1, 256)}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[raw(left + right)] = 511 + i
        ids = {raw(token): i for token, i in model["vocab"].items() if set(token.removesuffix("</w>")) <= set(byte)}
        self.ids = np.zeros(max(ranks.values()) + 1, dtype=np.uint32)
        self.closes = np.zeros(len(self.ids), dtype=bool)
        for token, rank in ranks.items():
            self.ids[rank] = ids.get(token, 0)
            self.closes[rank] = token.endswith(b"\0")
        self.merge = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per word."""
        plain = np.array([PLAIN.fullmatch(w) is not None and "<|" not in w for w in words], dtype=bool)
        parts, per_word = [], []
        for w, ok in zip(words, plain.tolist()):
            if ok and w.isalpha():
                parts.append(w)
                per_word.append(1)
            elif ok:
                own = self.split(w.lower())
                parts += own
                per_word.append(len(own))
        merged = np.array(self.merge("\0".join([*parts, ""]).lower()), dtype=np.int64)
        ends = np.concatenate([[0], np.flatnonzero(self.closes[merged]) + 1])
        sizes = np.zeros(len(words), dtype=np.int64)
        sizes[plain] = np.diff(ends[np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])])
        if plain.all():
            return self.ids[merged], sizes
        other = np.flatnonzero(~plain)
        found = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        sizes[other] = [len(x) for x in found]
        flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
        from_merge = np.repeat(plain, sizes)
        flat[from_merge] = self.ids[merged]
        flat[~from_merge] = np.array([i for x in found for i in x], dtype=np.uint32)
        return flat, sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by `END_ID`, and the ids per text."""
        flat = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        first, end = word_spans(flat)
        offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(flat[~SPACE[flat]].tobytes())]).dictionary_encode()
        ids, size = self.encode_words(_strings(words.dictionary))
        ids, size = np.append(ids, np.uint32(END_ID)), np.append(size, 1)
        offset = np.cumsum(size) - size
        closing = np.searchsorted(first, edges[1:])
        codes = np.insert(words.indices.to_numpy().astype(np.int64), closing, len(size) - 1)
        own = size[codes]
        end_at = np.cumsum(own)
        take = np.repeat(offset[codes] - (end_at - own), own) + np.arange(int(own.sum()))
        per_text = np.diff(np.concatenate([[0], end_at])[np.concatenate([[0], closing + np.arange(1, len(texts) + 1)])])
        return ids[take], per_text


def _strings(values: pa.Array) -> list[str]:
    try:
        return values.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:
        return [w.decode("utf-8", "replace") for w in values.to_pylist()]


def _letters_to_bytes() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def sentence_marks(vocabulary: dict[str, int]) -> np.ndarray:
    """Which ids end a sentence: punctuation that holds a full stop, question or exclamation mark."""
    marks = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        body = token.removesuffix("</w>")
        marks[i] = token.endswith("</w>") and any(c in ".!?" for c in body) and not any(unicodedata.category(c)[0] in "LN" for c in body)
    return marks


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, and the cost of ending there."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    solid = np.flatnonzero(marks[np.minimum(ids, len(marks) - 1)] & (ids < len(marks))) + 1
    cost[solid] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0] = 0
    known = np.flatnonzero(cost >= 0)
    for a, b in zip(known[:-1], known[1:]):
        if b - a > STRETCH:
            inner = np.arange(a + STRETCH, b, STRETCH)
            cost[inner] = INNER_CUT
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cheapest chain of places from the first to the last with steps of at most `length`.

    A step of n tokens costs `length` - n of padding, nothing if n is a power of two.  Without that exception the best
    predecessor is the one with the smallest (cost so far + place): a monotone queue keeps it over the window of
    reachable places.  Power-of-two steps are tried besides.
    """
    at, cost = places.tolist(), costs.tolist()
    index = {p: i for i, p in enumerate(at)}
    steps = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    total, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque()
    for j in range(1, len(at)):
        value = total[j - 1] + at[j - 1]
        while queue and total[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j - 1)
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        best, who = total[i] + at[i] + length - here, i
        for step in steps:
            i = index.get(here - step)
            if i is not None and total[i] < best:
                best, who = total[i], i
        total[j], back[j] = best + cost[j], who
    chain, j = [], len(at) - 1
    while j > 0:
        chain.append(at[j])
        j = back[j]
    return [at[0], *reversed(chain)]


def split_tail(start: int, end: int) -> list[int]:
    """Ends that cut the last window of a stream into powers of two, so that it needs no padding."""
    out = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        out.append(start)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack whole texts into sequences of at most `length` tokens, in the order of the rows of each input split.

    A text is its ids by `tokenizer` (path of a tokenizers file, read on the driver), then id 2; null text is empty.  Cuts
    fall at ends of documents or sentences, or every `STRETCH` tokens where neither comes, and minimise padding plus
    cut penalties.  A sequence whose length is a power of two is not padded.  Each split is packed by itself in
    blocks; the last sequence of a block goes on into the next, so memory does not grow with the split and no row
    is shuffled.  The last window of a split is cut into powers of two.

    Returns one row per piece: `id_col`, `start`, `length`, `ids` (binary, little-endian unsigned 32-bit), `doc_tokens`,
    `sequence_id`, `offset`.  Rows that repeat are packed each.  Empty table: no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer file

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)
        marks = sentence_marks(encoder.tokenizer.get_vocab())
        sequence = TaskContext.get().partitionId() << 32
        held_ids, held = [], []  # held: (doc id, doc tokens, start in doc, tokens)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held_ids, held
            ids = np.concatenate(held_ids)
            ends = np.cumsum([h[3] for h in held])
            chain = best_cuts(*cut_places(ids, ends, marks), length)
            stop = chain[-2] if len(chain) > 1 else 0
            if last:
                chain = chain[:-1] + split_tail(stop, chain[-1]) if not _power(chain[-1] - stop) else chain
                stop = len(ids)
            else:
                chain = chain[:-1]
            first = ends - [h[3] for h in held]
            out = []
            edges = np.unique(np.concatenate([np.array(chain), first[first < stop], [stop]])).astype(np.int64)
            edges = edges[edges <= stop]
            owner = np.searchsorted(ends, edges[:-1], side="right")
            window = np.searchsorted(np.array(chain), edges[:-1], side="right") - 1
            for a, b, o, w in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist(), window.tolist()):
                doc, whole, begun, _ = held[o]
                out.append((doc, begun + a - int(first[o]), b - a, ids[a:b].tobytes(), whole, sequence + w, a - chain[w]))
            sequence += len(chain) - 1
            rest = []
            for h, f, e in zip(held, first.tolist(), ends.tolist()):
                if e > stop:
                    gone = max(0, stop - f)
                    rest.append((h[0], h[1], h[2] + gone, h[3] - gone))
            held_ids, held = [ids[stop:]], rest
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out[i : i + 5000]), types)], names=names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, _, texts in text_slices(batch.column(1), 6 << 20):
                ids, counts = encoder.encode(texts)
                for s, e in pieces(counts, block_tokens):
                    low, high = int(counts[:s].sum()), int(counts[:e].sum())
                    held_ids.append(ids[low:high])
                    held += [(d, n, 0, n) for d, n in zip(doc_ids[a + s : a + e], counts[s:e].tolist())]
                    if sum(len(x) for x in held_ids) >= block_tokens:
                        yield from settle(False)
        if held:
            yield from settle(True)

    source = documents(docs, id_col, text_col).select("id", "text")
    out = source.mapInArrow(rows, "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.select(id_back(out.id).alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0

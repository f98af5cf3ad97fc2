"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import BYTE_TOKENS, Rolling, documents, id_back, id_key, mix, pieces, stage, text_slices
from wardpanel.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
SLOTS = BANDS * BAND_ROWS
#: Texts are counted and signed in blocks of about so many bytes; a bucket counts the shingles of about so many bytes of the corpus.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Bins of `bin_weights`, which no operator uses.
BINS = 1 << 18
BIN_SHIFT = np.uint64(46)
#: Pairs of a bucket that agree in fewer slots are not compared: at similarity 0.8 that is some 4 standard deviations off.
LEAST_AGREEMENT = 38
#: A bucket with more members is compared in blocks of about this size.
BLOCK = 512
#: Buckets with more members verify their texts in place; smaller ones put out pairs, each of which is verified once.
PAIR_MEMBERS = 12

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, shingles per text, and a 128-bit content hash per text.

    Words are runs of letters and digits in lower case.  A text of one to four words is one shingle, one without words has none.
    """
    low = [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    flat = np.frombuffer(b" ".join(low), dtype=np.uint8)
    inside = np.zeros(len(flat) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[flat]
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = mix(Rolling(BYTE_TOKENS[flat]).span(first, end) + (end - first).astype(np.uint64)) if len(first) else np.zeros(0, dtype=np.uint64)
    counts = np.diff(np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in low])))
    ends = np.cumsum(counts)
    begin = ends - counts
    content = np.zeros((len(texts), 2), dtype=np.uint64)
    if not len(words):
        return words, counts, content
    has = counts > 0
    for which in (0, 1):
        content[has, which] = mix(Rolling(words, which).span(begin[has], ends[has]) + counts[has].astype(np.uint64))
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, has.astype(np.int64))
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    stop = np.minimum(at + SHINGLE, np.repeat(ends, n))
    return mix(Rolling(words).span(at, stop) + (stop - at).astype(np.uint64)), n, content


def distinct_shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text (sorted), how often each occurs, and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.concatenate([fresh, [len(h)]]))
    return h[fresh], times, np.bincount(o[fresh], minlength=len(counts))


def bin_weights(docs: DataFrame) -> np.ndarray:
    """Weight of a shingle by its hashed bin, for comparison on small tables: `signatures` counts every shingle by itself.

    Each task adds up one table of `BINS` counts, cut into slices; slices are summed in Spark, and a table of
    fixed size (1 MB) reaches the driver.
    """
    slices = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(2)):
                hashes, counts, _ = text_shingles(texts)
                total += np.bincount((distinct_shingles(hashes, counts)[0] >> BIN_SHIFT).astype(np.int64), minlength=BINS)
        parts = total.astype(np.int64).reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), type=pa.int32()), pa.array([p.tobytes() for p in parts], type=pa.binary())], names=["slice", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS // slices, dtype=np.int64)
        for batch in parts:
            for cell in batch.column(1):
                total += np.frombuffer(cell.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], type=pa.int32()), pa.array([total.tobytes()], type=pa.binary())], names=["slice", "counts"])

    summed = docs.select("id", "v", "text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    table = np.zeros((slices, BINS // slices), dtype=np.int64)
    for row in summed.collect():
        table[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    df = table.reshape(-1)
    return shingle_weights(df, docs.count())


def shingle_weights(df: np.ndarray, texts: int) -> np.ndarray:
    """1 + scaled inverse document frequency, between 1 and 2, of shingles that `df` of all `texts` hold."""
    return (1 + np.log((1 + texts) / (1 + df)) / np.log(2 + texts)).astype(np.float32)


def _packed(values: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """64-bit values byte plane by byte plane: bytes that hardly change lie together."""
    return pack.compress(values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64)


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, vs, sizes, data): consecutive texts packed together.  To be staged, as the name of a block is drawn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), BLOCK_BYTES):
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], type=pa.int32()), c) for c in (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(t) for t in texts], type=pa.int64()))]
                data = pa.array([pack.compress(b"".join(texts))], type=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], type=pa.binary()), *lists, data], names=["block", "ids", "vs", "sizes", "data"])

    schema = f"block binary, ids array<bigint>, vs array<{docs.schema['v'].dataType.simpleString()}>, sizes array<bigint>, data binary"
    return docs.select("id", "v", "text").mapInArrow(rows, schema)


def block_shingles(sizes: pa.Scalar, data: pa.Scalar) -> Iterator[tuple]:
    """Slices of a block: (first text, end text, distinct shingles, times, shingles per text, contents)."""
    flat, sizes = zstandard.ZstdDecompressor().decompress(data.as_py()), sizes.values.to_numpy()
    ends = np.cumsum(sizes)
    for a, b in pieces(sizes):
        hashes, counts, content = text_shingles([flat[e - n : e] for e, n in zip(ends[a:b].tolist(), sizes[a:b].tolist())])
        yield a, b, *distinct_shingles(hashes, counts), content


def shingle_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, answers): for the distinct shingles of each block in order, how many texts of all blocks hold them.

    A block sends its shingles with their counts once to each of 2^`bits` buckets by their leading bits; a bucket adds up the
    blocks and answers each, with one value per shingle.  A shingle comes at most once from a block, however common it is.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                found, times = np.unique(np.concatenate([part[2] for part in block_shingles(batch.column(1)[i], batch.column(2)[i])]), return_counts=True)
                bucket = ((found >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*starts[1:].tolist(), len(found)]
                columns = [[_packed(x[s:e], pack) for s, e in zip(starts.tolist(), ends)] for x in (found, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(starts), type=pa.binary()), pa.array(bucket[starts].astype(np.int32)), *(pa.array(c, type=pa.binary()) for c in columns)],
                    names=["block", "bucket", "shingles", "times"],
                )

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        own = [_unpacked(c.as_py(), unpack) for c in rows.column("shingles")]
        times = np.concatenate([_unpacked(c.as_py(), unpack) for c in rows.column("times")])
        hashes = np.concatenate(own)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        total = np.empty(len(hashes), dtype=np.uint64)
        total[order] = np.repeat(np.add.reduceat(times[order], starts), np.diff(np.append(starts, len(hashes))))
        answers = [_packed(x, pack) for x in np.split(total, np.cumsum([len(x) for x in own])[:-1])]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "df": pa.array(answers, type=pa.binary())})

    sent = blocks.select("block", "sizes", "data").mapInArrow(cut, "block binary, bucket int, shingles binary, times binary")
    answers = sent.groupBy("bucket").applyInArrow(add, "block binary, bucket int, df binary")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "df"))).alias("answers"))


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Values of the Gamma(2, 1) distribution at 65,536 even probabilities, and their logarithms."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.full(65536, 1.7)
    for _ in range(60):  # Newton steps on 1 - (1 + x) exp(-x) = p
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 4, x + 2)
    return x.astype(np.float32), np.log(x).astype(np.float32)


@cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, n + 1, dtype=np.uint64)
    return mix(base * np.uint64(0xA0761D6478BD642F)), mix(base * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Improved consistent weighted sampling: per text (with at least one shingle) one 32-bit sample for each slot.

    For shingle and slot, r and c are Gamma(2, 1) and b uniform, all from the shingle's hash.  With t = floor(ln w / r + b)
    the shingle with the smallest ln c - r (t - b + 1) is the sample, and the pair (shingle, t) its value.  Two texts
    share a slot with the probability of their weighted Jaccard similarity.
    """
    gamma, log_gamma = _quantiles()
    xors, factors = _seeds(slots)
    out = np.zeros((len(counts), slots), dtype=np.uint32)
    low, one = np.uint64(0xFFFF), np.float32(1)
    edges = np.cumsum(counts)
    log_weight = np.log(weights)
    first_doc = 0
    while first_doc < len(counts):
        begin = int(edges[first_doc] - counts[first_doc])
        last_doc = max(first_doc + 1, int(np.searchsorted(edges, begin + 65536, side="right")))
        end = int(edges[last_doc - 1])
        h, lw = hashes[begin:end], log_weight[begin:end]
        starts = (edges[first_doc:last_doc] - counts[first_doc:last_doc]) - begin
        for k in range(slots):
            z = (h ^ xors[k]) * factors[k]
            z ^= z >> np.uint64(32)
            i = (z >> np.uint64(48)).astype(np.int64)
            r = gamma[i]
            b = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(lw / r + b)
            value = log_gamma[(z & low).astype(np.int64)] - r * (t - b + one)
            bits = value.view(np.int32)
            order = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64)
            print_ = ((z >> np.uint64(16)) + (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
            out[first_doc:last_doc, k] = np.minimum.reduceat((order << np.uint64(32)) | print_, starts).astype(np.uint32)
        first_doc = last_doc
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    n = len(samples)
    rows = samples.reshape(n, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, BANDS))
    for j in range(BAND_ROWS):
        key = mix(key + rows[:, :, j])
    return key.view(np.int64)


def signatures(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(id, v, content, samples, keys, df) and the number of texts, from staged blocks.

    content: hash of every text; df: in how many texts each of its shingles is; samples, keys and df are null without words.
    """
    known = blocks.agg(F.sum(F.size("ids")).alias("texts"), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("bytes")).first()
    total = known["texts"] or 0
    bits = max(0, (known["bytes"] or 0) // BUCKET_BYTES).bit_length()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                parts = list(block_shingles(batch.column(2)[i], batch.column(3)[i]))
                found = np.unique(np.concatenate([part[2] for part in parts]))
                often = [_unpacked(answer["df"], unpack) for answer in batch.column(4)[i].as_py() or []]
                often = np.concatenate([np.zeros(0, dtype=np.uint64), *often])
                if len(often) != len(found):
                    raise ValueError("a block of texts lacks counts of its shingles")
                for a, b, h, times, n, content in parts:
                    has = n > 0
                    samples: list = [None] * (b - a)
                    keys: list = [None] * (b - a)
                    df: list = [None] * (b - a)
                    if has.any():
                        own = often[np.searchsorted(found, h)]
                        signed = weighted_samples(h, times.astype(np.float32) * shingle_weights(own, total), n[has])
                        ends = np.cumsum(n)[has]
                        for k, s, key, end, size in zip(np.flatnonzero(has).tolist(), signed, band_keys(signed), ends.tolist(), n[has].tolist()):
                            samples[k], keys[k], df[k] = s.tobytes(), key, _packed(own[end - size : end], pack)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c)[i].values.slice(a, b - a) for c in (0, 1)]
                        + [pa.array([c.tobytes() for c in content], type=pa.binary()), pa.array(samples, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64())), pa.array(df, type=pa.binary())],
                        names=["id", "v", "content", "samples", "keys", "df"],
                    )

    both = blocks.join(shingle_counts(blocks, bits).hint("merge"), "block", "left").select("ids", "vs", "sizes", "data", "answers")
    v = blocks.schema["vs"].dataType.elementType.simpleString()
    return both.mapInArrow(rows, f"id bigint, v {v}, content binary, samples binary, keys array<bigint>, df binary"), total


def agreement(samples: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Slots in which rows agree, as a table."""
    out = np.zeros((len(samples), len(others)), dtype=np.uint8)
    for k in range(samples.shape[1]):
        out += samples[:, k, None] == others[None, :, k]
    return out


def spanning_links(samples: np.ndarray) -> list[tuple[int, int]]:
    """Links of a maximum spanning tree over slot agreement: the links most likely to hold a bucket together."""
    n = len(samples)
    best, who = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    out, at = [], 0
    for _ in range(n - 1):
        left[at] = False
        same = (samples == samples[at]).sum(axis=1)
        better = left & (same > best)
        best[better], who[better] = same[better], at
        at = int(np.argmax(np.where(left, best, -2)))
        if best[at] >= LEAST_AGREEMENT:
            out.append((int(who[at]), at))
    return out


def _decode(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.uint32).reshape(len(cells), SLOTS)


PAIRS = "a binary, b binary"


def _pair_batch(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    left, right = zip(*((min(p), max(p)) for p in pairs)) if pairs else ((), ())
    return pa.table({"a": pa.array(left, type=pa.binary()), "b": pa.array(right, type=pa.binary())})


def by_group(df: DataFrame, keys: list[str], settle) -> DataFrame:
    """Apply `settle` to every group of rows with equal keys; groups of a task arrive sorted, many to a batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _group_starts(now, keys)
            if len(starts) > 1:
                yield from settle(now.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]).to_batches()
            held = now.slice(int(starts[-1])) if len(starts) else None
        if held is not None:
            yield from settle(held.combine_chunks(), np.zeros(1, dtype=np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, PAIRS).distinct()


def _group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(rows.num_rows, dtype=bool)
    fresh[:1] = True
    for k in keys:
        value = rows.column(k).to_numpy()
        fresh[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(fresh)


def tree_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs of contents along spanning trees of the blocks of all buckets."""

    def trees(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        content, samples = rows.column("content").to_pylist(), _decode(rows.column("samples").to_pylist())
        sizes = np.diff(np.append(starts, len(content)))
        two = starts[sizes == 2]
        fit = (samples[two] == samples[two + 1]).sum(axis=1) >= LEAST_AGREEMENT
        pairs = [(content[i], content[i + 1]) for i in two[fit].tolist()]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            pairs += [(content[s + i], content[s + j]) for i, j in spanning_links(samples[s : s + n])]
        return _pair_batch(pairs)

    return by_group(members, ["key", "block"], trees)


def cross_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs that share a bucket, lie in different components and agree in enough slots; for small buckets."""

    def cross(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        content, samples = rows.column("content").to_pylist(), _decode(rows.column("samples").to_pylist())
        _, component = np.unique(np.array([c.hex() for c in rows.column("component").to_pylist()]), return_inverse=True)
        pairs = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(content)]):
            fit = (component[s:e, None] != component[None, s:e]) & (agreement(samples[s:e], samples[s:e]) >= LEAST_AGREEMENT)
            pairs += [(content[s + i], content[s + j]) for i, j in zip(*np.nonzero(fit)) if i < j]
        return _pair_batch(pairs)

    return by_group(members, ["key"], cross)


def exact_similarity(texts: list[bytes], table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`shared_similarity` of texts with weights by bin."""
    h, times, n = distinct_shingles(*text_shingles(texts)[:2])
    return shared_similarity(h, times, n, table[(h >> BIN_SHIFT).astype(np.int64)], left, right)


def shared_similarity(h: np.ndarray, times: np.ndarray, n: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every left text to every right one, as products over the shingles that several hold.

    `h`, `times`, `weights`: the distinct shingles text by text, `n` of each text.
    A shingle that occurs n times counts as n elements, so that a product sums up the smaller of two counts.
    """
    level = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    element = mix(np.repeat(h, times) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weight = np.repeat(weights.astype(np.float64), times)
    owner = np.repeat(np.repeat(np.arange(len(n)), n), times)
    total = np.bincount(owner, weight, len(n))
    _, column, often = np.unique(element, return_inverse=True, return_counts=True)
    several = often[column] > 1
    owner, weight, (_, column) = owner[several], weight[several], np.unique(column[several], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    shared = np.zeros((len(left), len(right)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        there, scale = np.zeros((len(n), 4096)), np.zeros(4096)
        there[owner[a:b], column[a:b] - first] = 1
        scale[column[a:b] - first] = weight[a:b]
        shared += there[left] @ (there[right] * scale).T
    return shared / np.maximum(total[left][:, None] + total[right][None, :] - shared, 1e-300)


def cross_links(members: DataFrame, texts: DataFrame, total: int, similarity: float) -> DataFrame:
    """The same for large buckets, verified in the bucket: only links that join two components there are put out.

    A bucket is compared block against block, so no task holds more than two blocks of texts.
    """

    def links(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        content, samples = rows.column("content").to_pylist(), _decode(rows.column("samples").to_pylist())
        component = rows.column("component").to_pylist()
        unpack = zstandard.ZstdDecompressor()
        block, one, two = (rows.column(c).to_numpy() for c in ("block", "one", "two"))
        found = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(content)]):
            left, right = np.flatnonzero(block[s:e] == one[s]), np.flatnonzero(block[s:e] == two[s])
            _, group = np.unique(np.array([c.hex() for c in component[s:e]]), return_inverse=True)
            if not len(left) or not len(right) or group.min() == group.max():
                continue
            fit = (group[left][:, None] != group[right][None, :]) & (agreement(samples[s:e][left], samples[s:e][right]) >= LEAST_AGREEMENT)
            if not fit.any():
                continue
            own = [t.as_buffer().to_pybytes() for t in rows.column("text").slice(s, e - s)]
            h, times, n = distinct_shingles(*text_shingles(own)[:2])
            often = np.concatenate([_unpacked(c.as_py(), unpack) for c in rows.column("df").slice(s, e - s)])
            fit &= shared_similarity(h, times, n, shingle_weights(often, total), left, right) >= similarity - 1e-9
            for i, j in zip(*np.nonzero(fit)):
                a, b = group[left[i]], group[right[j]]
                if a != b:
                    group[group == b] = a
                    found.append((content[s + left[i]], content[s + right[j]]))
        return _pair_batch(found)

    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top"))))
    tasks = other.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "content", "samples", "component")
    return by_group(tasks.join(texts.hint("merge"), "content"), ["key", "one", "two"], links)


def verify(pairs: DataFrame, texts: DataFrame, total: int, similarity: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least `similarity`; texts: content, text, df; `total`: number of all texts."""
    left = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a"), F.col("df").alias("df_a")).hint("merge"), "a")
    both = left.join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b"), F.col("df").alias("df_b")).hint("merge"), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, known = zstandard.ZstdDecompressor(), {}

        def weighed(content: bytes, text: bytes, df: bytes) -> tuple[np.ndarray, np.ndarray]:
            if content not in known:
                if len(known) > 64:
                    known.clear()
                h, times, _ = distinct_shingles(*text_shingles([text])[:2])
                known[content] = h, times * shingle_weights(_unpacked(df, unpack), total).astype(np.float64)
            return known[content]

        for batch in batches:
            a, b, text_a, text_b, df_a, df_b = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                (h, w), (g, u) = weighed(a[i], text_a[i].encode(), df_a[i]), weighed(b[i], text_b[i].encode(), df_b[i])
                _, p, q = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                shared = float(np.minimum(w[p], u[q]).sum())
                good.append(shared >= similarity * (float(w.sum() + u.sum()) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    return both.select("a", "b", "text_a", "text_b", "df_a", "df_b").mapInArrow(rows, PAIRS)


def class_rows(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, v, component) of every row, and per component its first row, size and number of different texts."""
    source = documents(docs, id_col, text_col)
    signed, total = signatures(stage(text_blocks(source)))
    signed = stage(signed)
    contents = stage(signed.where("samples IS NOT NULL").groupBy("content").agg(F.min(F.struct("id", "v")).alias("one"), F.first("samples").alias("samples"), F.first("keys").alias("keys"), F.first("df").alias("df")))
    keyed = contents.select("content", F.explode("keys").alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = keyed.join(sizes.hint("merge"), "key").select("key", F.pmod(F.xxhash64("content"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"), "n", "content")
    members = stage(shared.join(contents.select("content", "samples").hint("merge"), "content"))
    needed = members.select("content").distinct().join(contents.select("content", "one.*", "df").hint("merge"), "content")
    texts = stage(source.join(needed.hint("merge"), ["id", "v"]).select("content", "text", "df").dropDuplicates(["content"]))

    pairs = stage(tree_pairs(members))
    links = stage(verify(pairs, texts, total, similarity))
    grouped = stage(components(links, "a", "b").withColumnRenamed("node", "content"))
    placed = stage(members.join(grouped.hint("merge"), "content", "left").withColumn("component", F.coalesce("component", "content")))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("block").alias("top")).where("lo < hi").select("key", "top")
    unsettled = stage(placed.join(stage(several).hint("merge"), "key"))
    rest = stage(cross_pairs(unsettled.where(F.col("n") <= PAIR_MEMBERS)).join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    links = links.unionByName(stage(verify(rest, texts, total, similarity)))
    links = links.unionByName(stage(cross_links(unsettled.where(F.col("n") > PAIR_MEMBERS), texts, total, similarity)))
    grouped = stage(components(links, "a", "b").withColumnRenamed("node", "content"))

    named = stage(signed.select("id", "v", "content").join(grouped.hint("merge"), "content", "left").select("id", "v", F.coalesce("component", "content").alias("component"), "content"))
    rows = named.groupBy("component", "content", "id", "v").agg(F.count(F.lit(1)).alias("same"))
    per_content = rows.groupBy("component", "content").agg(F.min(F.struct("id", "v", "same")).alias("one"), F.sum("same").alias("n"))
    classes = per_content.groupBy("component").agg(F.min("one").alias("one"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("similar_texts"))
    return named, stage(classes)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: `id_col`, `class_id` (smallest id of the class), `class_size`, `similar_texts`.

    Classes are the components of the links between texts whose weighted Jaccard similarity over five-word shingles
    is at least `similarity`.  A shingle weighs its count in the text times 1 + scaled inverse document frequency.

    1. In how many texts each shingle is, counted by its 64-bit hash.
    2. Consistent weighted samples per text, cut into bands.  Texts with the same words are one content from here on.
    3. Contents that share a band are linked along a spanning tree of their slot agreement, verified on whole texts.
    4. Pairs that share a band but are in different components after that are all verified too, unless they agree
       in so few slots that a similarity of 0.8 is out of reach; so no link that joins classes is lost.
       Pairs inside one component would change nothing and are not made.  Small buckets put out such pairs; large
       ones are verified block by block where they lie and put out only links that join components.

    Texts with the same words (none at all included) are one class.  Null text: empty.  Rows that repeat get the same
    class.  Empty table: no rows.
    """
    named, classes = class_rows(docs, id_col, text_col, similarity)
    out = named.select("id", "component").join(classes.hint("merge"), "component")
    return out.select(id_back(out.id).alias(id_col), id_back(F.col("one.id")).alias("class_id"), "class_size", "similar_texts")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row of `docs` with the smallest id of each class, all columns as they are; of rows that repeat it, one."""
    _, classes = class_rows(docs, id_col, text_col, similarity)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key(docs[id_col]).alias("id"), F.xxhash64(text).alias("v"))
    stays = whole.join(classes.select("one.*").hint("merge"), ["id", "v"])
    several = stays.where("same > 1").groupBy("id", "v").agg(F.first("row").alias("row"))
    return stays.where("same = 1").select("row.*").unionByName(several.select("row.*"))

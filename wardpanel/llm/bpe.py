"""Byte-level BPE over a corpus: every distinct word is encoded once, by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardpanel.llm.common import documents, id_back, text_slices, word_spans, word_tokens

BLOCK_BYTES = 4 << 20
#: White space beside [\x20\x09-\x0D]; texts that hold any are cut by the pattern itself.
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def unit_edges(buffer: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where to cut texts (joined; `edges` between them) so that the pattern never matches across a cut.

    A run of white space gives its last character to what follows: a space joins the next word, any other
    character stands alone, and the rest of the run is one piece.
    """
    if not len(buffer):
        return np.zeros(1, dtype=np.int64)
    first, end = word_spans(buffer)
    first_of_text = np.zeros(len(buffer) + 1, dtype=bool)
    first_of_text[edges] = True
    before = first[(first > 0) & ~first_of_text[np.minimum(first, len(buffer))]]
    gap = before[(buffer[before - 1] == 0x20) | (buffer[before - 1] < 0x0E) & (buffer[before - 1] > 0x08)]
    alone = gap[buffer[gap - 1] != 0x20]
    cut = np.zeros(len(buffer) + 1, dtype=bool)
    for places in (edges, end, gap - 1, alone):
        cut[places] = True
    return np.flatnonzero(cut)


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None, decoded_col: str | None = None) -> DataFrame:
    """(id_col, ids[, decoded_col]): token ids of every whole text, as tiktoken's `encode_ordinary` gives them.

    Texts are cut into words with positions; a block of texts holds its words once, as codes.  The distinct words of
    each block go to the bucket of their hash, packed by (block, bucket) and sorted, so that a frequent word costs
    one entry per block.  A bucket encodes each of its distinct words once and answers per block; the answers are
    joined back by block and the ids put together by position.  Texts are cut twice, once for the words and once for the
    codes, as a stored copy of both would take more disk than the texts; a block's key holds a hash of its texts,
    so an input that changes between the two reads is an error and not a wrong result.

    Null text: no ids.  Rows that repeat are each returned.  Empty table: no rows.  Extra columns are not read.
    `decoded_col` adds the bytes of the ids, read back from the table of token bytes, as `decode_corpus` does.
    `vocabulary` is a rank file that every worker can read, or a local path on the driver (it is sent along).
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # one vocabulary file, its size does not depend on the data

    def cut(words_too: bool):
        """Rows of words by (block, bucket), or rows of coded texts by block; both passes cut the same blocks."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import re

            import regex

            odd, split = re.compile(ODD_SPACE), regex.compile(pattern)
            pack = zstandard.ZstdCompressor(level=3)
            task, number = TaskContext.get().partitionId(), 0
            for batch in batches:
                for a, b, own in text_slices(batch.column(2), block_bytes):
                    flat = b"".join(own)
                    block = hashlib.blake2b(flat, digest_size=16, key=b"%d %d" % (task, number)).digest()
                    number += 1
                    edges = np.cumsum([0] + [len(t) for t in own])
                    cuts = _odd_cuts(own, edges, unit_edges(np.frombuffer(flat, dtype=np.uint8), edges), odd, split)
                    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
                    bucket = _buckets(words.dictionary, buckets)
                    order = pc.sort_indices(pa.table({"bucket": bucket, "word": words.dictionary}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
                    if words_too:
                        found, bucket = words.dictionary.take(pa.array(order)), bucket[order]
                        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                        data = [_word_blob(found[s:e], pack) for s, e in zip(starts, [*starts[1:], len(found)])]
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(data), type=pa.binary()), pa.array(bucket[starts].astype(np.int32)), pa.array(data, type=pa.binary())], names=["block", "bucket", "data"])
                    else:
                        code = np.empty(len(order), dtype=np.int32)
                        code[order] = np.arange(len(order), dtype=np.int32)
                        data = pack.compress(code[words.indices.to_numpy()].tobytes())
                        counts = np.diff(np.searchsorted(cuts[:-1], edges))
                        columns = [pa.array([block], type=pa.binary()), pa.array([data], type=pa.binary()), pa.array([batch.column(0)[a:b].to_pylist()], type=pa.list_(pa.int64())), pa.array([counts.tolist()], type=pa.list_(pa.int32()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["block", "data", "ids", "counts"])

        return rows

    source = documents(docs, id_col, text_col).select("id", "v", "text")

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        import tiktoken

        encoder = _encoder(tiktoken, ranks.value, pattern)
        pack, unpack, known = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), {}
        answers = []
        for cell in rows.column("data"):
            data = unpack.decompress(cell.as_py())
            n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
            ends = np.cumsum(np.frombuffer(data, dtype=np.uint32, count=n, offset=4).astype(np.int64)) + 4 + 4 * n
            out, first = [], 4 + 4 * n
            for end in ends.tolist():
                word = data[first:end]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encoder.encode_ordinary(word.decode("utf-8", "replace"))
                out.append(ids)
                first = end
            sizes = np.array([len(x) for x in out], dtype=np.uint32)
            flat = np.array([i for x in out for i in x], dtype=np.uint32)
            answers.append(pack.compress(sizes.tobytes() + flat.tobytes()))
        counts = [int(np.frombuffer(unpack.decompress(c.as_py())[:4], dtype=np.uint32)[0]) for c in rows.column("data")]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "n": pa.array(counts, type=pa.int32()), "data": pa.array(answers, type=pa.binary())})

    words = source.mapInArrow(cut(True), "block binary, bucket int, data binary")
    answers = words.groupBy("bucket").applyInArrow(encode, "block binary, bucket int, n int, data binary")
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "data")).alias("answers"))
    texts = source.mapInArrow(cut(False), "block binary, data binary, ids array<bigint>, counts array<int>")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        table = _token_bytes(ranks.value) if decoded_col else None
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, flat = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.uint32)]
                for answer in sorted(batch.column(3)[i].as_py() or [], key=lambda x: x["bucket"]):
                    both = np.frombuffer(unpack.decompress(answer["data"]), dtype=np.uint32)
                    sizes.append(both[: answer["n"]])
                    flat.append(both[answer["n"] :])
                size, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
                offset = np.cumsum(size) - size
                codes = np.frombuffer(unpack.decompress(batch.column(0)[i].as_py()), dtype=np.int32)
                if len(codes) and not len(size):
                    raise ValueError("the input changed between its two reads; write it to a table first")
                own = size[codes]
                end = np.cumsum(own)
                take = np.repeat(offset[codes] - (end - own), own) + np.arange(int(own.sum()))
                counts = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids[take].astype(np.int32)))
                columns = [batch.column(1)[i].values, lists] + ([_decoded(lists, table)] if decoded_col else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    schema = "id bigint, ids array<int>" + ", decoded binary" * bool(decoded_col)
    out = texts.join(gathered.hint("merge"), "block", "left").select("data", "ids", "counts", "answers").mapInArrow(assemble, schema)
    return out.select(id_back(out.id).alias(id_col), "ids", *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def _token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, type=pa.large_binary())


def _decoded(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The joined token bytes of each list: the taken rows of the table lie one after the other, so only bounds are needed."""
    taken = table.take(lists.flatten())
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bounds = offsets[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    data = memoryview(taken.buffers()[2] or b"")
    return pa.array([bytes(data[a:b]) if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist())], type=pa.binary())


_ENCODERS: dict = {}


def _encoder(tiktoken, ranks: dict, pattern: str):
    key = (len(ranks), pattern, id(ranks))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return (word_tokens(flat, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)


def _word_blob(words: pa.Array, pack) -> bytes:
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    body = bytes(memoryview(words.buffers()[2])[offsets[0] : offsets[-1]])
    return pack.compress(np.uint32(len(words)).tobytes() + np.diff(offsets).astype(np.uint32).tobytes() + body)


def _odd_cuts(texts: list[bytes], edges: np.ndarray, cuts: np.ndarray, odd, split) -> np.ndarray:
    """Cuts by the pattern itself for texts with unusual white space."""
    extra = []
    for i, text in enumerate(texts):
        if odd.search(known := text.decode("utf-8", "replace")):
            sizes = [len(w.encode()) for w in split.findall(known)]
            extra.append((edges[i], edges[i + 1], edges[i] + np.cumsum(sizes)))
    for first, end, own in extra:
        cuts = np.unique(np.concatenate([cuts[(cuts <= first) | (cuts >= end)], own]))
    return cuts


def decode_corpus(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids, from the table of token bytes (one vocabulary file, bounded).  Null ids: null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    at, names = encoded.columns.index(ids_col), encoded.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(tokens.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(at), table)], names=[*names, out_col])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(rows, StructType([*encoded.schema.fields, StructField(out_col, BinaryType())]))

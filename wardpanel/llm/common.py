"""Helpers of the corpus operators: input columns, staged tables, rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardpanel.session import checkpoint_folder

PIECE_BYTES = 1 << 20


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v, text): only the columns in use, null text as empty.

    `v` tells rows with the same id and different texts apart; rows that agree in both are the same work
    and get the same result, so results are joined back on (id, v).  It is a 64-bit hash of the text.  A null id is kept as the smallest long.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(id_key(docs[id_col]).alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))


NULL_ID = -(1 << 63)


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(NULL_ID))


def id_back(c: Column) -> Column:
    return F.when(c != F.lit(NULL_ID), c)


def pieces(sizes: np.ndarray, limit: int = PIECE_BYTES):
    """Cut rows into consecutive slices of about `limit` bytes, at least one row each."""
    total, first = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def text_slices(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a text column of about `limit` bytes, as (first row, end row, texts); null is empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in pieces(sizes, limit):
        yield a, b, [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column[a:b]]


def row_texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, text) one after the other; null is empty."""
    for i, t in enumerate(column):
        yield i, t.as_buffer().to_pybytes() if t.is_valid else b""


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES * 2)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        if size > PIECE_BYTES * 4:
            return out[0], out[1]  # a very long text: not kept
        _POWERS[which] = have = (out[0], out[1])
    return have


class Rolling:
    """Rabin-Karp hashes of any span of a token array, modulo 2^64."""

    def __init__(self, tokens: np.ndarray, which: int = 0):
        self.up, down = _powers(len(tokens) + 1, which)
        self.prefix = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tokens * down[: len(tokens)], out=self.prefix[1:])

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[first]) * self.up[end - 1]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.prefix) - 1
        return (self.prefix[size:] - self.prefix[: n - size + 1]) * self.up[size - 1 : n]


PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_SHIFTS = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & PRIME) + (x >> _SHIFTS[2])
    return np.where(x >= PRIME, x - PRIME, x)


def mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, by halves of 31 and 30 bits."""
    s31, s30, _, s1 = _SHIFTS
    a1, a0, b1, b0 = a >> s31, a & _LOW31, b >> s31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduce(((a1 * b1) << s1) + (middle >> s30) + ((middle & _LOW30) << s31) + a0 * b0)


_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _PRIME_POWERS.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(n, PIECE_BYTES * 2), []
        base = _BASES[which] % int(PRIME)
        for b in (base, pow(base, -1, int(PRIME))):
            row = np.ones(1, dtype=np.uint64)
            while len(row) < size:
                row = np.concatenate([row, mul_mod(row, np.full(len(row), pow(b, len(row), int(PRIME)), dtype=np.uint64))])
            out.append(row[:size])
        have = (out[0], out[1])
        if size <= PIECE_BYTES * 4:  # those of a very long text are not kept
            _PRIME_POWERS[which] = have
    return have


class PrimeRolling:
    """Rabin-Karp hashes of any span of a token array, modulo the prime 2^61 - 1: no text makes them collide whatever the base, as powers of two do."""

    def __init__(self, tokens: np.ndarray, which: int = 0):
        self.up, down = _prime_powers(len(tokens) + 1, which)
        terms = mul_mod(_reduce(tokens), down[: len(tokens)])
        self.prefix = np.zeros(len(tokens) + 1, dtype=np.uint64)
        high, low = np.cumsum(terms >> _SHIFTS[1], dtype=np.uint64), np.cumsum(terms & _LOW30, dtype=np.uint64)
        self.prefix[1:] = _reduce(mul_mod(_reduce(high), np.full(len(terms), 1 << 30, dtype=np.uint64)) + _reduce(low))

    def _scaled(self, end: np.ndarray, first: np.ndarray, up: np.ndarray) -> np.ndarray:
        return mul_mod(_reduce(end + (PRIME - first)), up)

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._scaled(self.prefix[end], self.prefix[first], self.up[end - 1])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.prefix) - 1
        return self._scaled(self.prefix[size:], self.prefix[: n - size + 1], self.up[size - 1 : n])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every `width` consecutive ones, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


BYTE_TOKENS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word `[^\\x20\\x09-\\x0D]+`."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_tokens(buffer: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit value per word, from its bytes and length."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    return mix(Rolling(BYTE_TOKENS[buffer]).span(first, end) + (end - first).astype(np.uint64))

"""Ranked lexical search over a length-stratified index, in whole numbers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardpanel.llm.common import id_back, id_key, row_texts, stage

#: Terms of UTF-8 bytes, after A-Z are lower-cased: every byte beyond ASCII belongs to one.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Most documents (numbered by 16 bits) and (term, document) postings in one block of a stratum; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 19
#: Bytes of terms aimed at in a part of a stratum, the unit that is dealt out to tasks.
PART_BYTES = 4 << 20
#: Most (item, term) pairs that are searched for at once; they go to all tasks.
ITEM_TERMS = 200_000
#: Items scored together in a block: the accumulator holds so many rows of at most `BLOCK_DOCS` scores.
ITEM_ROWS = 256
#: Shorter postings are added to all items at once, longer ones item by item.
FEW_POSTINGS = 64
#: Strata that an item visits first, to learn how high its 50th document scores at least.
FIRST_STRATA = 4
DOC = "id bigint, n bigint, salt bigint, size bigint, terms binary, tfs binary"
#: A block as packed little-endian numbers: terms joined by spaces, (term, tf) groups of each term, the tf and the documents of each group.
BLOCK = "m bigint, ids array<bigint>, terms binary, groups binary, tfs binary, counts binary, docs binary"


def terms_of(text: bytes) -> Counter:
    return Counter(TERM.findall(text.lower()))


def impact(tf, m):
    """What one occurrence count adds in a stratum, before the weight of the term: the same for all documents of the stratum."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class LexicalIndex:
    """`blocks`: strata of documents with equal normaliser m, cut into blocks, postings by (term, tf); `documents` with a term and their `length` in terms."""

    blocks: DataFrame
    documents: int
    length: int


def document_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document that has a term: its distinct terms, joined, and how often each occurs; `salt` spreads rows that are alike."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() * 7919
        for batch in batches:
            ids, out, held = batch.column(0), [], 0
            for i, text in row_texts(batch.column(1)):
                found = terms_of(text)
                if found:
                    row += 1
                    joined = b" ".join(found)
                    out.append((ids[i].as_py(), found.total(), row % 65_521, len(joined), joined, np.fromiter(found.values(), dtype="<i4", count=len(found)).tobytes()))
                    held += len(joined)
                if held > 1 << 20:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["id", "n", "salt", "size", "terms", "tfs"])

    return docs.select(id_key(docs[id_col]).alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(rows, DOC)


def block_row(m: int, docs: list[tuple[int, bytes, bytes]]) -> tuple:
    """Postings of one block: of each term the occurrence counts downwards, of each of these the documents."""
    number: dict[bytes, int] = {}
    lists = [terms.split() for _, terms, _ in docs]
    sizes = [len(x) for x in lists]
    term = np.fromiter((number.setdefault(t, len(number)) for x in lists for t in x), dtype=np.int64, count=sum(sizes))
    tf = np.frombuffer(b"".join(t for _, _, t in docs), dtype="<i4").astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    most = int(tf.max())
    order = np.argsort(term * (most + 1) + most - tf, kind="stable")
    term, tf, owner = term[order], tf[order], owner[order]
    group = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    counts = np.diff(np.concatenate([group, [len(term)]]))
    groups = np.bincount(term[group], minlength=len(number))
    return m, [i for i, _, _ in docs], b" ".join(number), groups.astype("<i4").tobytes(), tf[group].astype("<i4").tobytes(), counts.astype("<u2").tobytes(), owner.astype("<u2").tobytes()


def block_rows(ordered: DataFrame) -> DataFrame:
    """Blocks from documents in the order of m: a block never spans two strata, and a stratum may have many."""
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    names = ["m", "ids", "terms", "groups", "tfs", "counts", "docs"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, m = [], 0, None

        def settle() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(block_row(m, held), types)], names=names)

        for batch in batches:
            strata, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, stratum in enumerate(strata):
                tfs = batch.column(3)[i].as_py()
                if held and (stratum != m or len(held) >= BLOCK_DOCS or postings + len(tfs) // 4 > BLOCK_POSTINGS):
                    yield settle()
                    held, postings = [], 0
                m = stratum
                held.append((ids[i], batch.column(2)[i].as_py(), tfs))
                postings += len(tfs) // 4
        if held:
            yield settle()

    return ordered.select("m", "id", "terms", "tfs").mapInArrow(rows, BLOCK)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex | None:
    """Index of all terms of all documents; None if no document has a term.

    A stratum is cut into parts of about `PART_BYTES` bytes of terms by a running number, so one that holds a third of all documents, or
    very long ones, is many parts.  Parts are dealt out by hash and sorted by stratum; each task writes its blocks one after the other.
    """
    counted = stage(document_terms(docs, id_col, text_col))
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not total["n"]:
        return None
    documents, length = int(total["n"]), int(total["l"])
    strata = counted.withColumn("m", F.expr(f"50 + (50 * n * {documents}L) div {length}L"))
    parts = stage(strata.groupBy("m").agg(F.ceil(F.sum("size") / PART_BYTES).alias("parts")))  # Spark broadcasts it if its files are small
    dealt = strata.join(parts, "m").withColumn("part", F.pmod("salt", "parts"))
    ordered = dealt.repartition("m", "part").sortWithinPartitions("m", "part")
    return LexicalIndex(stage(block_rows(ordered)), documents, length)


@dataclass
class Asked:
    """Items that are searched for together: per distinct term its number, and the items that hold it and its weight by that number.

    `least` is the score that a document has to reach, `first` names the items that visit a stratum first.
    """

    number: dict[bytes, int]
    items: list[np.ndarray]
    count: int
    weight: np.ndarray | None = None
    least: np.ndarray | None = None
    first: dict[int, list[int]] = field(default_factory=dict)


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[int], Asked]]:
    """Distinct items in blocks of at most `ITEM_TERMS` (item, term) pairs, or one item; the driver holds one block at a time."""
    ids: list[int] = []
    number: dict[bytes, int] = {}
    lists: list[list[int]] = []
    pairs = 0
    for row in items.select(id_key(items[item_col]).alias("id"), items[text_col].cast("string").alias("text")).distinct().toLocalIterator():
        found = terms_of((row["text"] or "").encode())
        if ids and pairs + len(found) > ITEM_TERMS:
            yield ids, Asked(number, [np.array(x) for x in lists], len(ids))
            ids, number, lists, pairs = [], {}, [], 0
        if found:
            for term in found:
                at = number.setdefault(term, len(number))
                if at == len(lists):
                    lists.append([])
                lists[at].append(len(ids))
            ids.append(row["id"])
            pairs += len(found)
    if ids:
        yield ids, Asked(number, [np.array(x) for x in lists], len(ids))


def read_block(batch: pa.RecordBatch, i: int, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """m of a block; of the asked terms that it holds the number, and the first and end (term, tf) group; the tf of all groups, and the first posting of each."""
    asked = [number.get(t, -1) for t in batch.column("terms")[i].as_py().split()]
    asked = np.array(asked, dtype=np.int64)
    end = np.cumsum(np.frombuffer(batch.column("groups")[i].as_py(), dtype="<i4"))
    mine = np.flatnonzero(asked >= 0)
    first = np.where(mine > 0, end[mine - 1], 0)
    starts = np.concatenate([[0], np.cumsum(np.frombuffer(batch.column("counts")[i].as_py(), dtype="<u2"), dtype=np.int64)])
    return batch.column("m")[i].as_py(), asked[mine], np.stack([first, end[mine]]), np.frombuffer(batch.column("tfs")[i].as_py(), dtype="<i4").astype(np.int64), starts


def term_statistics(index: LexicalIndex, asked: Asked) -> DataFrame:
    """(m, term, df, tf): of each asked term and stratum, the documents that hold it and the most occurrences in one."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(asked.number)  # at most ITEM_TERMS terms

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, term, (first, end), tfs, starts = read_block(batch, i, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), m)), pa.array(term), pa.array(starts[end] - starts[first]), pa.array(tfs[first])], names=["m", "term", "df", "tf"])

    found = index.blocks.select("m", "terms", "groups", "tfs", "counts").mapInArrow(rows, "m bigint, term bigint, df bigint, tf bigint")
    return stage(found.groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf")))


def stratum_bounds(statistics: DataFrame, shared) -> DataFrame:
    """(m, item, bound): what a document of the stratum can score at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                m, terms = batch.column("m")[i].as_py(), batch.column("terms")[i].values
                bound = np.zeros(asked.count, dtype=np.int64)
                for term, tf in zip(terms.field("term").to_pylist(), terms.field("tf").to_pylist()):
                    bound[asked.items[term]] += int(asked.weight[term]) * impact(tf, m)
                item = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), m)), pa.array(item), pa.array(bound[item])], names=["m", "item", "bound"])

    lists = statistics.groupBy("m").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))  # at most ITEM_TERMS a row
    return lists.mapInArrow(rows, "m bigint, item bigint, bound bigint")


class Best:
    """The k best documents of each item among those seen, and the score that a further one has to reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.held = k, least.copy(), {}

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(item, kind="stable")
        item, score, ids = item[order], score[order], ids[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            one, s, d = int(item[a]), score[a:b], ids[a:b]
            if one in self.held:
                s, d = np.concatenate([self.held[one][0], s]), np.concatenate([self.held[one][1], d])
            if len(s) > self.k:
                top = np.lexsort((d, -s))[: self.k]
                s, d = s[top], d[top]
                self.least[one] = max(self.least[one], int(s[-1]))
            self.held[one] = s, d

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.fromiter(self.held, dtype=np.int64, count=len(self.held)), [len(s) for s, _ in self.held.values()])
        parts = list(zip(*self.held.values())) or [[np.zeros(0, dtype=np.int64)]] * 2
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(parts[0])), pa.array(np.concatenate(parts[1]))], names=["item", "score", "id"])


def score_block(batch: pa.RecordBatch, i: int, allowed: Callable[[int], np.ndarray], asked: Asked, best: Best) -> None:
    """Add the documents of a block that can still be among the best to `best`; `allowed` marks the items that visit a stratum.

    Impacts are computed once per (term, tf) group.  Bounds are sums of whole numbers below 2^53, as an item has at most `ITEM_TERMS` terms.  Items whose largest possible score in this block is too low are passed over.
    """
    m, terms, (first, end), tfs, starts = read_block(batch, i, asked.number)
    if not len(terms):
        return
    gains = impact(tfs, m)
    lists = [asked.items[t] for t in terms.tolist()]
    bound = np.bincount(np.concatenate(lists), np.repeat(asked.weight[terms] * gains[first], [len(x) for x in lists]), asked.count)
    mine = np.flatnonzero(allowed(m) & (bound >= best.least))
    if not len(mine):
        return
    ids, docs = batch.column("ids")[i].values.to_numpy(), np.frombuffer(batch.column("docs")[i].as_py(), dtype="<u2").astype(np.int64)
    for a in range(0, len(mine), ITEM_ROWS):
        part = mine[a : a + ITEM_ROWS]
        slot = np.full(asked.count, -1, dtype=np.int64)
        slot[part] = np.arange(len(part))
        scores = np.zeros((len(part), len(ids)), dtype=np.int64)
        for weight, items, f, e in zip(asked.weight[terms].tolist(), lists, first.tolist(), end.tolist()):
            rows = slot[items]
            rows = rows[rows >= 0]
            if len(rows) and weight:
                held = docs[starts[f] : starts[e]]
                gain = np.repeat(gains[f:e] * weight, starts[f + 1 : e + 1] - starts[f:e])
                if len(held) < FEW_POSTINGS:
                    scores[rows[:, None], held] += gain
                else:
                    for r in rows.tolist():
                        scores[r, held] += gain
        row, doc = np.nonzero(scores >= best.least[part][:, None])
        if len(row):
            best.add(part[row], scores[row, doc], ids[doc])


def visit(blocks: DataFrame, shared, k: int, first: bool) -> DataFrame:
    """(item, score, id): the k best documents of each item and task, in the strata that an item visits first, or in all others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        best = Best(k, asked.least)

        def allowed(m: int) -> np.ndarray:
            mask = np.full(asked.count, not first)
            mask[asked.first.get(m, [])] = first
            return mask

        for batch in batches:
            for i in range(batch.num_rows):
                score_block(batch, i, allowed, asked, best)
        yield best.rows()

    return blocks.mapInArrow(rows, "item bigint, score bigint, id bigint")


def search_block(index: LexicalIndex, ids: list[int], asked: Asked, k: int) -> DataFrame:
    """(item_id, rank, id, score) of one block of items."""
    spark = index.blocks.sparkSession
    statistics = term_statistics(index, asked)
    df = np.zeros(len(asked.number), dtype=np.int64)
    for r in statistics.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most ITEM_TERMS rows
        df[r["term"]] = r["df"]
    asked.weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    asked.least = np.ones(asked.count, dtype=np.int64)
    share = lambda: spark.sparkContext.broadcast(asked)  # at most ITEM_TERMS pairs and FIRST_STRATA strata an item
    by_bound = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "m"))
    for r in stratum_bounds(statistics, share()).withColumn("r", by_bound).where(F.col("r") <= FIRST_STRATA).select("m", "item").collect():
        asked.first.setdefault(r["m"], []).append(r["item"])
    seen = stage(best_of(visit(index.blocks.where(F.col("m").isin(list(asked.first))), share(), k, True), k))
    for r in seen.where(F.col("rank") == k).select("item", "score").collect():  # at most one row an item
        asked.least[r["item"]] = r["score"]
    top = best_of(seen.select("item", "score", "id").unionByName(visit(index.blocks, share(), k, False)), k)
    names = spark.createDataFrame(list(enumerate(ids)), "item bigint, item_id bigint")
    return top.join(names, "item").select("item_id", "rank", "id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, score, id): the k best rows of each item; Spark cuts each task to k rows an item before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: LexicalIndex | None, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item_col, rank, id_col, score): the `k` documents with the highest score above 0 for each item, equal scores by ascending id.

    Terms are the runs of letters and digits of ASCII and of all other characters, A-Z lower-cased.  A term weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document scores the sum over the item's distinct terms of the weight times
    (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L, in 64-bit whole numbers.

    Every stratum gets an upper bound per item from the most occurrences of each term in it.  An item visits the strata
    with the highest bounds first, then all blocks of others whose own bound reaches its k-th score so far.  The result is exact.

    Items are taken in blocks of at most `ITEM_TERMS` (item, term) pairs, each against the whole index.  Items that repeat in id and text are
    one; other texts of the same id are searched for on their own.  Items without a term (null, empty) have no rows.  A null id of an
    item or a document comes back as null, and goes before other ids when scores are equal.  Documents that repeat an id count and rank each.
    No index or no items: no rows.  Other columns are not read.
    """
    spark = items.sparkSession
    found = [] if index is None else [stage(search_block(index, ids, asked, k)) for ids, asked in item_blocks(items, item_col, text_col)]
    out = spark.createDataFrame([], StructType([StructField(c, LongType()) for c in ("item_id", "rank", "id", "score")]))
    for part in found:
        out = out.unionByName(part)
    return out.select(id_back(out.item_id).alias(item_col), F.col("rank").cast("int").alias("rank"), id_back(out.id).alias(id_col), "score")


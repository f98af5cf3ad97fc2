"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardpanel.llm.common import NULL_ID, id_back, id_key, stage
from wardpanel.session import checkpoint_folder


def plain_case(text: Column) -> Column:
    """A-Z as lower case, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(docs[id_col]).alias("id"), F.unhex(F.sha2(plain_case(docs[text_col]), 256)).alias("digest"))


class DigestIndex:
    """Table (digest, keep_id, group_size): one row per distinct text seen so far.

    It lies at `path` as Parquet in `buckets` buckets, sorted by digest; opening an existing path goes on with it.
    New digests meet the index in a sort-merge join that does not move the index.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path or f"{checkpoint_folder(spark)}/digests-{uuid.uuid4().hex}"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Rows (one per digest) whose digest the index does not hold."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add digests that are not in the index; group sizes of known ones stay as first counted."""
        new = self.unknown(groups.select("digest", "keep_id", "group_size"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def plain(self) -> DataFrame:
        """The same rows without the bucket layout, so that a join on a hot digest can be split at run time."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.read.schema("digest BINARY, keep_id BIGINT, group_size BIGINT").parquet(self.path)


def add_new(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dedup `docs` among themselves and against `index`, append what is new, and say for each row what stays.

    Texts are equal when identical after lower-casing A-Z only.  Of equal texts in one call the row with the largest id
    stays, unless the index knew the text before: then none does.  Copies are counted map-side before any shuffle.
    Returns per row: `id_col`, `keep_id`, `group_size`, `kept`, `text_sha256`.  Null text is empty text, a null id
    sorts below all others, rows that repeat id and text are each flagged (see `drop_copies`), an empty table gives none.
    """
    own = stage(digests(docs, id_col, text_col))
    groups = stage(own.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    fresh = stage(index.unknown(groups).select("digest", F.lit(True).alias("fresh")))
    index.append(groups)
    known = index.plain().join(fresh.hint("merge"), "digest", "left")
    out = own.join(known.hint("merge"), "digest")
    return out.select(
        id_back(out.id).alias(id_col),
        id_back(out.keep_id).alias("keep_id"),
        "group_size",
        (F.coalesce("fresh", F.lit(False)) & (out.id == out.keep_id)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they are; of rows that repeat id and text, one."""
    own = stage(digests(docs, id_col, text_col))
    counted = own.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = stage(counted.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", "id").alias("same")))
    fresh = stage(index.unknown(groups).select("digest", "keep_id", "same"))
    index.append(groups)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_key(docs[id_col]).alias("id"), F.unhex(F.sha2(plain_case(docs[text_col]), 256)).alias("digest"))
    stays = whole.join(fresh.withColumnRenamed("keep_id", "id").hint("merge"), ["digest", "id"])
    single = stays.where("same = 1").select("row.*")
    several = stays.where("same > 1").groupBy("digest").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(several)


__all__ = ["NULL_ID", "DigestIndex", "add_new", "drop_copies"]

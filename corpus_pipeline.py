"""The corpus pipeline: quality, exact copies, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardpanel.llm.common import stage, table
from wardpanel.llm.digest_index import DigestIndex, drop_copies
from wardpanel.llm.near_dedup import keep_one
from wardpanel.llm.packing import pack
from wardpanel.llm.pii import pseudonymise
from wardpanel.llm.quality import add_score, train
from wardpanel.llm.queries import pseudonym_key, tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the table that are not held out, does not reject."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return add_score(docs, model, score_col="__score").where(F.col("__score") >= 0.5).drop("__score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; the digest index starts empty."""
    return drop_copies(docs, DigestIndex(spark))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; `n_chars` follows the new text where the table has it."""
    out = pseudonymise(docs, pseudonym_key())
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Sampling, boosting and the tokenizer cannot be said in SQL; tests hold `run` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Deterministic splits and sampling: the order is the hash of the id and the seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardpanel.operators.order import positions
from wardpanel.session import cut_lineage

NAMES = {2: ("train", "val"), 3: ("train", "val", "test"), 4: ("train", "val", "cal", "test")}


def shuffled(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "pos", **kw) -> DataFrame:
    """Rows of distinct keys with their position in hash order (inside each `by` group)."""
    h = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return positions(df.withColumn("__h", h), ["__h", key], by, name, **kw).drop("__h")


def _cut(pos: Column, n: Column, ratios: Sequence[float], names: Sequence[str]) -> Column:
    """Names by position: boundaries are the whole parts of n times the summed ratios."""
    total, out = 0.0, None
    for r, name in zip(ratios[:-1], names[:-1]):
        total += r
        cond = pos < F.floor(n * F.lit(total))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def split_keys(keys: DataFrame, key: str, ratios: Sequence[float], seed: int = 0, names: Sequence[str] | None = None) -> DataFrame:
    """(key, split) for distinct keys."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    names = names or NAMES[len(ratios)]
    total = keys.count()
    ranked = shuffled(keys.select(key), key, seed, largest=total)
    return ranked.select(key, _cut(F.col("pos"), F.lit(total), ratios, names).alias("split"))


def split_by_sample(samples: DataFrame, key: str, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    return samples.join(split_keys(samples, key, ratios, seed), key)


def split_by_patient(samples: DataFrame, patient: str, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    """All samples of a patient fall into the same part.  The patients are written once: their order takes several passes."""
    patients = cut_lineage(samples.select(patient).distinct())
    return samples.join(split_keys(patients, patient, ratios, seed), patient)


def split_fixed_test(samples: DataFrame, key: str, part: str, ratios: Sequence[float], seed: int = 0, train: str = "train", by_patient: str | None = None) -> DataFrame:
    """Rows outside the training part are the test set; the ratios divide the rest (2 ratios: train, val; 3: train, val, cal).

    By patient, the part of the patient's first sample decides.
    """
    names = ("train", "val", "cal")[: len(ratios)]
    if by_patient:
        first = samples.groupBy(by_patient).agg(F.min_by(part, key).alias("__part"))
        pool = first.where(F.col("__part") == train).select(by_patient)
        cut = split_keys(pool, by_patient, ratios, seed, names)
        return samples.join(cut.withColumnRenamed("split", "__s"), by_patient, "left").withColumn("split", F.coalesce("__s", F.lit("test"))).drop("__s")
    cut = split_keys(samples.where(F.col(part) == train), key, ratios, seed, names)
    return samples.join(cut.withColumnRenamed("split", "__s"), key, "left").withColumn("split", F.coalesce("__s", F.lit("test"))).drop("__s")


def balanced_sizes(pos: int, neg: int, ratio: float = 1.0, subsample: float = 1.0) -> tuple[int, int]:
    """Positives and negatives to keep.

    The full set is every positive with `ratio` negatives for each, as far as there are any.  At most `subsample` of all rows
    stay, one at least; a larger set shrinks to that room with its mixture kept.
    """
    if ratio < 0 or not 0 < subsample <= 1:
        raise ValueError("needs ratio >= 0 and 0 < subsample <= 1")
    if pos == 0:
        return 0, 0
    matched = min(neg, round(pos * ratio))
    full, room = pos + matched, max(1, int((pos + neg) * subsample))
    kept = max(1, pos * min(full, room) // full)
    return kept, min(round(kept * matched / pos), room - kept)


def sample_balanced(samples: DataFrame, key: str, label: str, ratio: float = 1.0, subsample: float = 1.0, seed: int = 0) -> DataFrame:
    """Positives kept, negatives thinned to the ratio, both thinned to the cap; without positives nothing changes."""
    counts = samples.agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = counts["p"] or 0, counts["n"] - (counts["p"] or 0)
    if not pos:
        return samples
    keep_pos, keep_neg = balanced_sizes(pos, neg, ratio, subsample)
    flagged = samples.withColumn("__pos_label", (F.col(label) == 1).cast("int"))
    ranked = shuffled(flagged, key, seed, ["__pos_label"], "__p")
    return ranked.where(F.col("__p") < F.when(F.col("__pos_label") == 1, keep_pos).otherwise(keep_neg)).drop("__p", "__pos_label")

"""Helpers for user factors, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from wardpanel.functions import stay_events as se

ROWS = [
    (1, ["Sepsis noted", "fever", "SEPSIS and fever", None, "late"], [60, 120, 2880, 30, None]),
    (2, [], []),
    (3, None, None),
    (4, ["fever", "sepsis"], [-60]),
]
EMPTY = (0, 0, 0.0, 0.0, 0.0, False)
WANT = {1: (3, 3, 0.6, 1.0, 2 / 3, True), 2: EMPTY, 3: EMPTY, 4: (0, 2, 1.0, 0.0, 0.0, True)}


def test_helpers(spark):
    df = spark.createDataFrame(ROWS, "id int, texts array<string>, offsets array<int>").withColumn("e", se.stay_events(F.col("texts"), F.col("offsets")))
    e, words = F.col("e"), ["SEPSIS", "fever"]
    got = df.select(
        "id", F.size(se.between(e, 0, 48)), se.keyword_count(e, words), se.keyword_density(e, words), se.first_hours(e, words),
        se.persistence(e, words, [(0, 2), (2, 3), (3, 48)]), se.keyword_any(e, words),
    ).collect()
    for r in got:
        assert tuple(r)[1:] == pytest.approx(WANT[r["id"]])
    edge = df.where("id = 1").select(se.first_hours(e, ["and"], 0, 48.0), se.first_hours(e, ["and"], 48, 49), se.persistence(e, words, []), se.keyword_count(e, [])).first()
    assert tuple(edge) == (0.0, 48.0, 0.0, 0)


def test_plain_numbers(spark):
    df = spark.createDataFrame([(2.0, 4.0), (1.0, 0.0), (1.0, None), (-3.0, 1e-13), (float("nan"), 1.0), (None, 2.0)], "a double, b double")
    rows = df.select(se.share(F.col("a"), F.col("b")).alias("s"), se.log_plus_one(F.col("a")).alias("l")).collect()
    assert [r["s"] for r in rows[:4]] == [0.5, 0.0, 0.0, 0.0]
    assert [r["l"] for r in rows] == pytest.approx([math.log(3), math.log(2), math.log(2), 0.0, 0.0, 0.0])

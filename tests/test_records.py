"""Marked records: cut at their markers, the same rows as the pattern finds."""

from wardpanel.sources.prepare import RECORD, split_records

ODD = [
    "START_OF_RECORD=1||||2||||\n a b \r\n", "x START_OF_RECORD=3||||4|||||t|||||END_OF_RECORD rest START_OF_RECORD=5||||6||||u||||v",
    "START_OF_RECORD=7||||8||||one START_OF_RECORD=bad||||9||||lost START_OF_RECORD=10||||11||||", "START_OF_RECORD=12|||||13||||no", "START_OF_RECORD=14||||15", "", "START_OF_RECORD=16||||17\n||||n",
    "START_OF_RECORD=START_OF_RECORD=18||||19||||a||||b||||c", "START_OF_RECORD=-1||||20||||n", "||||START_OF_RECORD=21||||22||||||||END_OF_RECORD", None,
]


def test_cut_records_equal_the_pattern(spark):
    frame = spark.createDataFrame([(v,) for v in ODD], "value string")
    cut, found = split_records(frame), split_records(frame, pattern="(?:)" + RECORD)
    assert cut.columns == found.columns
    rows = sorted(map(tuple, cut.collect()))
    assert rows == sorted(map(tuple, found.collect())) and len(rows) == 7
    assert ("7", "8", "one") in rows and ("5", "6", "u||||v") in rows and ("3", "4", "|t|") in rows


def test_no_pattern_is_searched_through_the_text(spark):
    plan = split_records(spark.createDataFrame([("",)], "value string"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" not in plan


def test_line_ends_other_than_those_trimmed_stay(spark):
    frame = spark.createDataFrame([("START_OF_RECORD=1||||2||||a\u2028",)], "value string")
    assert split_records(frame).first().text == "a\u2028"

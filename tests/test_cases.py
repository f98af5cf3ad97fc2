"""Small literal frames with known answers."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from wardpanel.functions import codes as cd
from wardpanel.functions import privacy
from wardpanel.operators import calibrate as ca
from wardpanel.operators import encode as en
from wardpanel.operators import metrics as mt
from wardpanel.operators import retrieve as rt
from wardpanel.operators import split as sp
from wardpanel.operators import stay as st
from wardpanel.plans import cohort, jobs
from wardpanel.sources import tables as tb
from wardpanel.sources.configs import DATASETS, MIMIC3, MIMIC4

DAY0 = dt.datetime(2020, 1, 1)


def day(n, hour=0):
    return DAY0 + dt.timedelta(days=n, hours=hour)


def test_balanced_sampling_counts():
    assert sp.balanced_sizes(3, 5, 0.5, 1.0) == (3, 2)
    assert sp.balanced_sizes(3, 10, 3.0, 0.5) == (1, 3)
    with pytest.raises(ValueError):
        sp.balanced_sizes(1, 1, -1)


def test_balanced_sampling_keeps_rows_without_positives(spark):
    df = spark.createDataFrame([(i, 0) for i in range(5)], "id long, label int")
    assert sp.sample_balanced(df, "id", "label").count() == 5


def visits(spark, rows):
    return spark.createDataFrame(rows, "patient_id string, visit_id string, start timestamp, end timestamp, died string")


def codes(spark, rows):
    return spark.createDataFrame(rows, "patient_id string, visit_id string, kind string, code string, seq long, time timestamp, version string")


def labs(spark, rows=()):
    return spark.createDataFrame(list(rows), "patient_id string, visit_id string, time timestamp, stored timestamp, item string, value double, seq long")


def test_diabetes_window(spark):
    v = visits(spark, [("p", f"v{d}", day(d), day(d + 1), "0") for d in (10, 70, 80, 95)])
    c = codes(spark, [
        ("p", "v10", "conditions", "E10.9", 1, day(0), "10"), ("p", "v70", "conditions", "I10", 1, day(71), "10"),
        ("p", "v80", "conditions", "J45", 1, day(81), "10"), ("p", "v95", "conditions", "E10.10", 1, day(95), "10")])
    got = jobs.ketoacidosis_type1(v, c, labs(spark), 90).collect()
    # the window starts with the first type-1 code (day 0) and ends on day 90: the visit on day 95 is outside
    assert len(got) == 1 and got[0]["label"] == 0 and len(got[0]["icd_codes"]["value"]) == 3
    inside = jobs.ketoacidosis_type1(v, c, labs(spark), 100).collect()[0]
    assert inside["label"] == 1 and inside["icd_codes"]["value"][0] == ["D_E109"]


def test_readmission_uses_the_next_visit_even_if_it_is_dropped(spark):
    v = visits(spark, [("p", "a", day(0), day(2), "0"), ("p", "b", day(10), day(12), "0"), ("p", "c", day(60), day(61), "0"), ("q", "z", day(0), day(1), "0")])
    full = [("p", x, k, "1", 1, day(0), "9") for x in ("a", "c") for k in jobs.KINDS]
    got = {r["visit_id"]: r["readmission"] for r in jobs.readmission(v, codes(spark, full + [("p", "b", "conditions", "1", 1, day(10), "9")])).collect()}
    assert got == {"a": 1}
    exact = visits(spark, [("p", "a", day(0), day(2), "0"), ("p", "b", day(17), day(18), "0")])
    assert jobs.readmission(exact, codes(spark, full)).first()["readmission"] == 0


def test_mortality_flags(spark):
    v = visits(spark, [("p", "a", day(0), day(2), "0"), ("p", "b", day(10), day(12), "unknown"), ("p", "c", day(20), day(21), "1")])
    full = [("p", x, k, "1", 1, day(0), "9") for x in "abc" for k in jobs.KINDS]
    got = {r["visit_id"]: r["mortality"] for r in jobs.mortality_next(v, codes(spark, full)).collect()}
    assert got == {"a": 0, "b": 1}


def test_drug_codes_in_order(spark):
    c = spark.createDataFrame(
        [("v1", "n1", 1), ("v1", "0", 2), ("v1", "n2", 3), ("v1", "n1", 4), ("v1", "<NA>", 5), ("v2", "zzz", 1), ("v2", "n3", 2), ("v2", "", 3)],
        "visit_id string, code string, seq long")
    m = spark.createDataFrame([("n1", "A10B", 0), ("n2", "C03C", 0), ("n2", "A10B", 1), ("n3", "N02B", 0)], "source string, target string, rank int")
    first = jobs.map_codes_ordered(c, m)
    got = {r["visit_id"]: [x["code"] for x in sorted(r["r"], key=lambda x: (x["seq"]["seq"], x["seq"]["rank"]))] for r in first.groupBy("visit_id").agg(F.collect_list(F.struct("seq", "code")).alias("r")).collect()}
    assert got == {"v1": ["A10B", "C03C"], "v2": ["N02B"]}


def test_drug_history_hides_current(spark):
    v = visits(spark, [("p", "a", day(0), day(1), "0"), ("p", "b", day(5), day(6), "0")])
    rows = [("p", x, k, f"{k[0]}{x}", 1, day(0), "9") for x in "ab" for k in jobs.KINDS]
    got = {r["visit_id"]: r for r in jobs.drug_history(v, codes(spark, rows)).collect()}
    assert got["a"]["drugs_hist"] == [[]] and got["b"]["drugs_hist"] == [["da"], []] and got["b"]["drugs"] == ["db"]
    assert got["b"]["conditions"] == [["ca"], ["cb"]]


def test_prediction_sets(spark):
    df = spark.createDataFrame([([True, False, False], 1), ([True, False, False], 0), ([True, True, False], 1), ([False, True, False], 2)], "predset array<boolean>, y int")
    r = mt.set_scores(df).first()
    assert r["set_size"] == 1.25 and r["rejection_rate"] == 0.25 and r["miscoverage_overall"] == 0.5
    assert abs(r["error_overall"] - 2 / 3) < 1e-12
    by = {x["k"]: (x["miscoverage"], x["error"]) for x in mt.set_scores_by_class(df, 3).collect()}
    assert by == {0: (0.0, 0.0), 1: (0.5, 1.0), 2: (1.0, 1.0)}


def test_token_encoding(spark):
    t = en.token_table(spark, list("abcdefgh"))
    df = spark.createDataFrame([(1, 0, list("abcez")), (2, 0, list("abcdez"))], "id int, b int, w array<string>")
    got = {r["id"]: r["w"] for r in en.encode_tokens(df, "id", "w", t, "b", 10).collect()}
    assert got == {1: [2, 3, 4, 6, 1, 0], 2: [2, 3, 4, 5, 6, 1]}
    cut = {r["id"]: r["w"] for r in en.encode_tokens(df, "id", "w", t, "b", 3).collect()}
    assert cut == {1: [4, 6, 1], 2: [5, 6, 1]}
    back = en.decode_tokens(en.encode_tokens(df, "id", "w", t, "b", 10), "id", "w", t)
    assert {r["id"]: r["w"] for r in back.collect()}[1] == ["a", "b", "c", "e", "<unk>"]


def test_nested_encoding_rules(spark):
    df = spark.createDataFrame([(1, [["a", "b"], []]), (2, []), (3, [["c", None, "zz"]])], "id int, x array<array<string>>")
    vocab = en.fit_vocabulary(df, ["id"], "x").where("token <> 'zz'")
    got = {r["id"]: r["x"] for r in en.encode_nested(df, "id", "x", vocab, en.max_lengths(df, "x")).collect()}
    assert got[1] == [[2, 3, 0], [0, 0, 0]] and got[2] == [[0, 0, 0]] and got[3] == [[4, 1, 1]]


def test_float_encoding_rules(spark):
    df = spark.createDataFrame([(1, [[], [1.0, None], [], [None, 3.0]]), (2, [])], "id int, x array<array<double>>")
    got = {r["id"]: r["x"] for r in en.encode_floats(df, "id", "x", [2]).collect()}
    assert got[1] == [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 3.0]]
    plain = {r["id"]: r["x"] for r in en.encode_floats(df, "id", "x", [2], forward_fill=False).collect()}
    assert plain[1] == [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 3.0]] and plain[2] == [[0.0, 0.0]]


def test_grid_resampling(spark):
    df = spark.createDataFrame([(1, day(0, 0), 1.0), (1, day(0, 3), 2.0), (1, day(0, 8), 5.0)], "id int, t timestamp, v double")
    got = en.resample(df, "id", "t", "v", 7200).orderBy("step").collect()
    assert [r["v"] for r in got] == [1.0, 2.0, 2.0, 2.0, 5.0] and [r["hours"] for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_vocabulary_algebra(spark):
    v = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id long")
    pick = lambda *t: spark.createDataFrame([(x,) for x in t], "token string")
    assert {r["token"]: r["id"] for r in en.keep_tokens(v, pick("a", "c", "q")).collect()} == {"a": 2, "c": 3}
    assert {r["token"]: r["id"] for r in en.keep_tokens(v, pick("a"), remove=True).collect()} == {"b": 2, "c": 3}
    assert {r["token"]: r["id"] for r in en.add_tokens(v, pick("d", "a")).collect()}["d"] == 5


def test_unseen_and_binary_labels(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, l string")
    with pytest.raises(ValueError):
        en.fit_labels(df, "l", binary=True)
    vocab = en.fit_labels(df.where("l <> 'z'"), "l", binary=True)
    with pytest.raises(Exception, match="unseen label"):
        en.encode_label(df, "l", vocab).collect()


def test_code_formats(spark):
    df = spark.createDataFrame([("E8490", "4280", "9955"), ("42", "I509", "31"), ("428.0", "I50.9", "99.1")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(cd.icd9cm(F.col("a")), cd.icd10cm(F.col("b")), cd.icd9proc(F.col("c"))).collect()]
    assert got == [("E849.0", "428.0", "99.55"), ("42", "I50.9", "31"), ("428.0", "I50.9", "99.1")]
    levels = spark.createDataFrame([("A10BA02",)], "x string").select(*[cd.atc(F.col("x"), i) for i in range(1, 6)]).first()
    assert tuple(levels) == ("A", "A10", "A10B", "A10BA", "A10BA02")


def test_privacy_words():
    got = privacy.tag_words("Seen by John Smith on 2012-03-04 today", "Seen by [**Name**] on [**2012-03-04 date**] today")
    assert [(w["word"], w["label"]) for w in got] == [
        ("Seen", "O"), ("by", "O"), ("John", "B-NAME"), ("Smith", "I-NAME"), ("on", "O"), ("2012-03-04", "B-DATE"), ("today", "O")]


def test_conformal_threshold_and_empty_group(spark):
    df = spark.createDataFrame([(i, 0, [1 - i / 10, i / 10]) for i in range(1, 10)], "sample_id int, y int, prob array<double>")
    assert abs(ca.conformal_threshold(df, 0.2).first()["threshold"] - 0.8) < 1e-12
    assert ca.conformal_threshold(df, 0.01).first()["threshold"] == float("inf")


def test_adaptive_bins_give_the_rest_to_the_last(spark):
    df = spark.createDataFrame([(i, i / 100) for i in range(11)], "sample_id int, conf double")
    sizes = {r["bin"]: r["n"] for r in mt.equal_mass_bins(df, "conf", ["sample_id"], 4).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 1: 3, 2: 3, 3: 3}


def test_stay_factor_without_events(spark):
    stays = spark.createDataFrame([(1,), (2,)], "visit_id long")
    text = spark.createDataFrame([(1, "conditions", 90, "Sepsis shock"), (1, "drugs", None, "x")], "visit_id long, source string, offset_min long, text string")
    num = spark.createDataFrame([(1, "lab_ph", 0, 7.1, 0), (1, "lab_ph", 60, 7.3, 1), (1, "lab_ph", 1440, 9.0, 2)], "visit_id long, source string, offset_min long, value double, seq long")
    specs = [
        st.FactorSpec("any", "keyword_any", ("conditions",), keywords=("sepsis",)),
        st.FactorSpec("first", "first_keyword_offset", ("conditions",), keywords=("shock",)),
        st.FactorSpec("mean", "numeric_window_mean", numeric_source="lab_ph"),
        st.FactorSpec("slope", "numeric_window_slope", numeric_source="lab_ph"),
        st.FactorSpec("gate", "keyword_gated_numeric", ("conditions",), "lab_ph", keywords=("shock",), aggregation="last"),
    ]
    got = {r["visit_id"]: r for r in st.factor_matrix(stays, text, num, specs).collect()}
    assert got[2]["any"] == 0.0 and got[2]["mean"] == 0.0 and got[2]["first"] == 0.0
    assert got[1]["any"] == 1.0 and abs(got[1]["mean"] - 7.2) < 1e-12 and abs(got[1]["slope"] - 0.2) < 1e-9 and got[1]["gate"] == 7.3
    assert abs(got[1]["first"] - 0.9162907318741551) < 1e-12


def test_event_tables_from_files(spark, tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    write("hosp/patients.csv", "subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod\n1,F,50,2100,x,\n2,M,17,2100,x,\n")
    write("hosp/admissions.csv", "subject_id,hadm_id,admittime,dischtime,admission_type,admission_location,insurance,language,marital_status,race,discharge_location,hospital_expire_flag\n"
          "1,10,2100-01-01 00:00:00,2100-01-03 12:00:00,,,,,,,,0\n1,11,2100-01-10 00:00:00,2100-01-11 00:00:00,,,,,,,,1\n")
    write("hosp/diagnoses_icd.csv", "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,2,I10,10\n1,10,1,E119,10\n")
    write("hosp/procedures_icd.csv", "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,1,99,9\n")
    write("hosp/prescriptions.csv", "subject_id,hadm_id,starttime,stoptime,drug,ndc,prod_strength,dose_val_rx,dose_unit_rx,route\n1,10,2100-01-01 08:00:00,,\"a, \"\"b\"\"\",55,,,,\n")
    tables = [t for t in MIMIC4 if t.name in ("patients", "admissions", "diagnoses_icd", "procedures_icd", "prescriptions")]
    ev = tb.load_events(spark, str(tmp_path), tables)
    assert {r["event_type"]: r["events"] for r in tb.event_stats_by_type(ev).collect()} == {"patients": 2, "admissions": 2, "diagnoses_icd": 2, "procedures_icd": 1, "prescriptions": 1}
    assert ev.where("event_type = 'prescriptions'").select("`prescriptions/drug`").first()[0] == 'a, "b"'
    assert ev.where("event_type = 'patients' and timestamp is null").count() == 2
    v = cohort.with_patient(cohort.visits(ev, "mimic4"), ev, "patients", {"anchor_age": "anchor_age"})
    got = jobs.readmission(v, cohort.codes(ev, "mimic4"), 15, F.col("anchor_age").cast("int") >= 18).collect()
    assert len(got) == 1 and got[0]["readmission"] == 1 and got[0]["conditions"] == ["E119", "I10"] and got[0]["drugs"] == ["55"]
    los = jobs.length_of_stay(v, cohort.codes(ev, "mimic4")).first()
    assert los["los"] == 2
    assert jobs.mortality_next(v, cohort.codes(ev, "mimic4")).first()["mortality"] == 1


def test_bad_timestamp_is_an_error(spark, tmp_path):
    (tmp_path / "ICUSTAYS.csv").write_text("subject_id,icustay_id,first_careunit,dbsource,last_careunit,intime,outtime\n1,2,a,b,c,not a time,\n")
    cfg = next(t for t in MIMIC3 if t.name == "icustays")
    with pytest.raises(Exception, match="bad timestamp"):
        tb.load_table(spark, str(tmp_path), cfg).collect()


def test_configurations_are_complete():
    assert len(DATASETS["eicu"]) == 8 and len(DATASETS["ehrshot"]) == 17
    for tables in DATASETS.values():
        for t in tables:
            assert t.attributes and len(set(t.attributes)) == len(t.attributes)


def test_filters_need_a_type(spark):
    with pytest.raises(ValueError):
        tb.get_events(spark.createDataFrame([("a",)], "event_type string"), filters=[("x", "==", 1)])


def test_stream_of_one_patient_arrives_in_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ev = spark.createDataFrame([("hot" if i % 3 else f"p{i}", day(0, 0) + dt.timedelta(minutes=i * 37 % 1000)) for i in range(300)], "patient_id string, timestamp timestamp")

        def task(pid, chunks):
            import pandas as pd

            times = [t for c in chunks for t in c["timestamp"]]
            yield pd.DataFrame({"patient_id": [pid], "n": [len(times)], "ok": [times == sorted(times)]})

        got = tb.by_patient(ev, task, "patient_id string, n long, ok boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["patient_id"]: r["n"] for r in got}["hot"] == 200 and all(r["ok"] for r in got) and len(got) == 101


def test_bm25_by_hand(spark):
    import math

    docs = {1: ["a", "b", "a"], 2: ["b", "c"], 3: ["c", "c", "d"], 4: ["e"]}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(9, ["a", "c", "c"])], "query_id long, tokens array<string>")
    n, avg = 4, sum(map(len, docs.values())) / 4
    idf = {}
    for t in "abcde":
        f = sum(t in d for d in docs.values())
        idf[t] = math.log(n - f + 0.5) - math.log(f + 0.5)
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    want = {}
    for k, d in docs.items():
        s = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ["a", "c", "c"])
        if set(d) & {"a", "c"}:
            want[k] = s
    got = {r["doc_id"]: r["score"] for r in rt.bm25(corpus, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_linkage_ring_is_whole_and_stable(spark):
    corpus = spark.createDataFrame([(f"d{i}", 30 + i % 4, f"g{i % 3}") for i in range(12)], "doc_id string, age int, identifiers string")
    queries = spark.createDataFrame([(f"q{i}", 33, f"g{i}") for i in range(5)], "query_id string, age int, identifiers string")
    a = sorted(map(tuple, rt.candidates(corpus, queries).collect()))
    assert a == sorted(map(tuple, rt.candidates(corpus, queries).collect()))
    per = {}
    for q, d in a:
        per.setdefault(q, set()).add(d)
    assert len(per["q0"]) == 4 and len(per["q4"]) == int((4 * 3) / 5)


def test_closure_has_no_depth_limit(spark):
    from wardpanel.operators.graph import ancestors

    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(70)], "child string, parent string")
    start = spark.createDataFrame([("c0",)], "code string")
    assert ancestors(start, chain).agg({"distance": "max"}).first()[0] == 70
    with pytest.raises(ValueError):
        ancestors(start, chain, max_depth=5)


@pytest.mark.parametrize("limit", ["1000000", "2"])
def test_resample_fills_every_column_by_itself(spark, limit):
    """The last point of a slot counts with all its values, missing ones too; a key with one point has one row."""
    rows = [("p", "2020-01-01 00:00:00", 1.0, None), ("p", "2020-01-01 00:30:00", None, 5.0), ("p", "2020-01-01 03:10:00", 7.0, None), ("q", "2020-01-01 00:00:00", None, None)]
    df = spark.createDataFrame(rows, "id string, t string, a double, b double").withColumn("t", F.to_timestamp("t"))
    spark.conf.set("wardpanel.group.rows", limit)
    try:
        got = [tuple(r) for r in en.resample(df, "id", "t", ["a", "b"], 3600).orderBy("id", "step").collect()]
        zero = [tuple(r)[3:] for r in en.resample(df, "id", "t", ["a", "b"], 3600, "zero").where("id = 'p'").orderBy("step").collect()]
    finally:
        spark.conf.unset("wardpanel.group.rows")
    assert got == [("p", 0, 0.0, 0.0, 5.0), ("p", 1, 1.0, 0.0, 5.0), ("p", 2, 2.0, 0.0, 5.0), ("p", 3, 3.0, 7.0, 5.0), ("q", 0, 0.0, 0.0, 0.0)]
    assert zero == [(0.0, 5.0), (0.0, 0.0), (0.0, 0.0), (7.0, 0.0)]


def test_interaction_rate_lists_short_samples_and_joins_long_ones(spark, monkeypatch):
    import itertools

    from wardpanel.operators import metrics

    drugs = {1: ["a", "b", "c", "a"], 2: ["b", "d"], 3: ["a", "b", "b", "c", "d", "a", "e"], 4: ["e"], 5: [None, "a", "b"]}
    rows = spark.createDataFrame([(s, d) for s, ds in drugs.items() for d in ds] + [(None, "a"), (None, "b")], "sample_id long, drug string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("a", "a"), ("d", None)], "a string, b string")
    known = {("a", "b"), ("b", "c"), ("a", "a")}
    every = [tuple(sorted((x or "", y or ""))) for ds in drugs.values() for x, y in itertools.combinations(ds, 2)]
    want = sum(p in known for p in every) / (len(every) + 1)  # the pair of the sample without a key counts, but matches nothing
    for listed, sent in ((1000, 500_000), (3, 500_000), (1000, 1), (3, 1)):
        monkeypatch.setattr(metrics, "LIST_ROWS", listed)
        monkeypatch.setattr(metrics, "SENT_PAIRS", sent)
        assert abs(metrics.interaction_rate(rows, pairs).first()[0] - want) < 1e-12


def test_tokens_are_looked_up_without_a_shuffle_of_words(spark, monkeypatch):
    table = en.token_table(spark, ["x", "y"])
    df = spark.createDataFrame([(1, "p", ["x", "q", None, "y"]), (2, "p", []), (3, "p", None), (4, "r", ["y"])], "id long, b string, w array<string>")
    want = {1: ([2, 1, 1, 3], ["x", "<unk>", "<unk>", "y"]), 2: ([0] * 4, []), 3: ([0] * 4, []), 4: ([3], ["y"])}
    for sent in (200_000, 1):
        monkeypatch.setattr(en, "SENT_TOKENS", sent)
        enc = en.encode_tokens(df, "id", "w", table, "b", 10)
        back = {r["id"]: r["w"] for r in en.decode_tokens(enc, "id", "w", table).collect()}
        assert {r["id"]: (r["w"], back[r["id"]]) for r in enc.collect()} == want
        plan = en.decode_tokens(enc, "id", "w", table)._jdf.queryExecution().executedPlan().toString()
        assert ("Generate" in plan) == (sent == 1)


def test_privacy_labels_are_packed_note_by_note():
    import pyarrow as pa

    from wardpanel.operators import retrieve

    notes = [f"note {i} to me@x.org" if i % 3 else None for i in range(2 * retrieve.TAG_NOTES + 5)]
    tagged = [n and n.replace("me@x.org", "[**Email**]") for n in notes]
    out = retrieve._tag_notes(pa.array(notes), pa.array(tagged))
    assert isinstance(out, pa.Array) and len(out) == len(notes)
    assert [len(w) for w in out.to_pylist()] == [4 if n else 0 for n in notes]
    assert out[1].as_py()[3] == {"word": "me@x.org", "label": "B-CONTACT"}


def test_kernel_sums_copy_rows_a_fixed_number_of_times(spark):
    from wardpanel.operators import blocks

    assert blocks._count_blocks(spark.range(20_000), 1) <= 8


def test_grams_are_counted_inside_the_row(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(rt, "GRAM_PAIRS", 3)
    texts = [("a b a b c", "a b c a b"), ("", "a"), ("x", "x"), (None, "a b"), ("a a a a", "a a"), ("a b", None), ("c d e f", "f e d c"), ("p q r s t", "q r s t")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id long, a string, b string").coalesce(1)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    out = rt.gram_overlaps(df, "id", words(F.col("a")), words(F.col("b")), range(1, 5))
    got = {(r["id"], r["n"]): (r["overlap"], r["in_a"], r["in_b"]) for r in out.collect()}
    grams = lambda t, n: Counter(tuple(w[i : i + n]) for w in [(t or "").split()] for i in range(len(w) - n + 1))
    want = {(i, n): ((x & y).total(), x.total(), y.total()) for i, (a, b) in enumerate(texts) for n in range(1, 5) for x, y in [(grams(a, n), grams(b, n))]}
    assert got == want


def test_floats_are_filled_inside_the_row(spark):
    rows = [(1, [["1", None, "x"], [], ["nan", "5"]]), (2, [[], None, [None, "2"]]), (3, None), (4, []), (5, [["9", "8", "7", "6"]])]
    flat = spark.createDataFrame(rows, "id int, x array<array<string>>")
    got = en.encode_floats(flat, "id", "x", [3])
    nan = float("nan")
    want = {1: [[1, 1, 1], [1, 1, 1], [1, 5, 5]], 2: [[0, 0, 0], [0, 0, 0], [0, 2, 0]], 3: [[nan] * 3], 4: [[nan] * 3], 5: [[9, 8, 7]]}
    assert str({r["id"]: r["x"] for r in got.collect()}) == str({k: [[float(v) for v in a] for a in rows] for k, rows in want.items()})
    deep = spark.createDataFrame([(1, [[[1.0], None], None, [], [[None, 4.0], [2.0], [3.0]]]), (2, [[]]), (3, None)], "id int, x array<array<array<double>>>")
    out = en.encode_floats(deep, "id", "x", [2, 2])
    want = {1: [[[1, 1], [1, 1]], [[0, 4], [2, 4]]], 2: [[[nan, nan]]], 3: [[[nan, nan]]]}
    assert str({r["id"]: r["x"] for r in out.collect()}) == str({k: [[[float(v) for v in a] for a in m] for m in rows] for k, rows in want.items()})
    for made in (got, out):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_walk_sends_small_levels_to_the_edges(spark, monkeypatch):
    from wardpanel.operators import graph as gr

    edges = spark.createDataFrame([("s1", "p1"), ("s1", "p1"), ("s1", "p2"), ("s2", "p2"), ("s1", "n1"), ("s2", "n2"), ("c1", "n1")], "head string, tail string")
    adj = gr.undirected(edges, distinct=False)
    labels = gr.entities(edges).select(F.col("entity").alias("node"), F.substring("entity", 1, 1).alias("label"))
    seeds = spark.createDataFrame([("n1", "n1"), ("n2", "n2"), ("zz", "zz")], "group string, node string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = gr.nodes_within_steps(adj, labels, seeds, 2, ["s", "p"], block=True)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        want = {("n1", "s1"), ("n1", "p1"), ("n1", "p2"), ("n2", "s2"), ("n2", "p2")}
        assert sorted(map(tuple, got.collect())) == sorted(want)
        monkeypatch.setattr(gr, "SENT_LEVEL", 0)
        assert sorted(map(tuple, gr.nodes_within_steps(adj, labels, seeds, 2, ["s", "p"], block=True).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_results_of_patients_leave_together(spark):
    import pandas as pd

    class Rows:
        def __getattr__(self, name):
            return (lambda run, schema: run) if name == "mapInPandas" else (lambda *a: self)

    def task(pid, chunks):
        yield pd.DataFrame({"patient_id": [pid], "n": [sum(len(c) for c in chunks)]})

    run = tb.by_patient(Rows(), task, "patient_id string, n bigint")
    frames = [pd.DataFrame({"patient_id": ["a", "a", "b"]}), pd.DataFrame({"patient_id": ["b", "c"]}), pd.DataFrame({"patient_id": []})]
    out = list(run(iter(frames)))
    assert len(out) == 1 and out[0].values.tolist() == [["a", 2], ["b", 2], ["c", 1]]
    many = list(run(iter([pd.DataFrame({"patient_id": [str(i) for i in range(2_500)]})])))
    assert [len(f) for f in many] == [1_000, 1_000, 500]


def test_sequences_are_encoded_inside_the_row(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", None, "b", "zz"]), (2, []), (3, None), (4, ["c", "a"])], "id int, x array<string>")
    mapping = spark.createDataFrame([("a", "t2", 2), ("a", "t1", 1), ("b", None, None)], "source string, target string, rank int")
    vocab = en.fit_vocabulary(df, ["id"], "x", mapping).where("token <> 'zz'")
    made = en.encode_sequence(df, "id", "x", vocab, mapping)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["x"] for r in made.collect()}
    assert got == {1: [2, 3, 4, 1], 2: [], 3: [], 4: [6, 2, 3]}
    monkeypatch.setattr(en, "SENT_TOKENS", 0)
    assert {r["id"]: r["x"] for r in en.encode_sequence(df, "id", "x", vocab, mapping).collect()} == got


def test_vocabulary_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t, "array<string>").asNondeterministic()
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", None, "a"])], "id int, x array<string>").repartition(2).withColumn("x", seen("x"))
    vocab = en.fit_vocabulary(df, ["id"], "x")
    kept = en.keep_tokens(vocab, spark.createDataFrame([("c",), ("a",)], "token string"))
    out = en.add_tokens(kept, spark.createDataFrame([("z",), ("c",)], "token string"))
    assert sorted(map(tuple, out.collect())) == [("a", 2), ("c", 3), ("z", 4)]
    assert read.value == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_nested_encoding_moves_no_rows(spark):
    rows = [(1, [[["a", None], None], []]), (2, []), (3, None), (4, [None, [[], ["zz"], ["b", "a", "a"]]]), (None, [[["a"]]])]
    df = spark.createDataFrame(rows, "id int, x array<array<array<string>>>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id long")
    out = en.encode_nested(df, "id", "x", vocab, [2, 2])
    none = [0, 0]
    assert {r["id"]: r["x"] for r in out.collect()} == {
        1: [[[2, 1], none], [none, none]], 2: [[none, none]], 3: [[none, none]], 4: [[none, none], [none, [1, 0], [3, 2, 2]]]}
    assert exchanges(out) == 0


def test_wide_vocabulary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, [["a", None], []]), (2, []), (3, [None, ["zz", "b", "a"]])], "id int, x array<array<string>>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id long")
    told = lambda: {r["id"]: r["x"] for r in en.encode_nested(df, "id", "x", vocab, [2]).collect()}
    sent = told()
    monkeypatch.setattr(en, "SENT_TOKENS", 1)
    assert told() == sent == {1: [[2, 1], [0, 0]], 2: [[0, 0]], 3: [[0, 0], [1, 3, 2]]}


def test_timed_codes_move_no_rows(spark):
    df = spark.createDataFrame([(1, ([0, 1], [["a"], ["b", "a"]])), (2, ([0], [[]]))], "id int, codes struct<time: array<int>, value: array<array<string>>>")
    fitted = en.EncoderPipeline({"codes": "stagenet"}, "id", ["id"], padding=1).fit(df)
    out = fitted.transform(df)
    assert {r["id"]: (r["codes"]["time"], r["codes"]["value"]) for r in out.collect()} == {1: ([0, 1], [[2, 0, 0], [3, 2, 0]]), 2: ([0], [[0, 0, 0]])}
    assert exchanges(out) == 0


@pytest.mark.parametrize("most", [1, 10])
def test_names_come_back_from_numbers(spark, monkeypatch, most):
    monkeypatch.setattr(en, "SENT_TOKENS", most)
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "k int, name string")
    moved, back = en.numbered(df, "name")
    lists = moved.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda r: r["name"]).alias("l"))
    assert lists.select(back(F.array("l", F.array().cast(lists.schema["l"].dataType)), 2)).first()[0] == [["x", None, "y", "x"], []]


def linkage_rows(spark):
    at = lambda n: dt.datetime(2020, 1, n)
    seen = [("p", "1", at(1)), ("p", "2", at(2)), ("p", "3", at(3)), ("q", "4", at(1)), ("q", "5", at(2))]
    v = spark.createDataFrame([(*r, dt.date(1980, 1, 1), "x") for r in seen], "patient_id string, visit_id string, start timestamp, birth date, identifiers string")
    c = [("p", "1", "conditions", "a", 1), ("p", "2", "drugs", "b", 1), ("p", "2", "conditions", "c", 2), ("p", "3", "conditions", "d", 1), ("q", "4", "drugs", "e", 1), ("q", "5", "conditions", "f", 1)]
    codes = spark.createDataFrame(c, "patient_id string, visit_id string, kind string, code string, seq int").localCheckpoint()
    return jobs.linkage_pairs(v, codes)


def test_linkage_moves_conditions_only(spark):
    out = linkage_rows(spark)
    assert [(r["visit_id"], r["conditions"], r["d_visit_id"], r["d_conditions"]) for r in out.collect()] == [("3", ["", "d"], "2", ["", "a", "[SEP]", "c"])]
    assert re.search(r"Filter .*kind#\d+ = conditions", out._jdf.queryExecution().optimizedPlan().toString())


def test_linkage_metadata_leaves_code_lists_behind(spark):
    made = rt.retrieval_tables(linkage_rows(spark).localCheckpoint())
    gathered = lambda name: made[name]._jdf.queryExecution().sparkPlan().toString()
    assert made["corpus_meta"].collect() == [("2", 40, "x")] and made["queries_meta"].collect() == [("3", 40, "x")]
    assert made["corpus"].collect() == [("2", ["a", "c"])] and made["qrels"].collect() == [("3", "2", 1)]
    for name in ("corpus_meta", "queries_meta", "qrels"):
        assert not re.search(r"max_by\([^)]*conditions", gathered(name))


def test_visits_without_ends_read_no_lines(spark, tmp_path):
    from wardpanel.queries.jobs import visits as order_visits

    spark.createDataFrame([(1, 7, "F", 100.0, DAY0, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 5.0)], "l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    whole, short = order_visits(spark, str(tmp_path)), order_visits(spark, str(tmp_path), ends=False)
    assert whole.schema == short.schema and whole.drop("end").collect() == short.drop("end").collect()
    assert "lineitem" not in " ".join(short.inputFiles())


def test_nested_encoding_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, [["a"]]), (1, [["b", "a"]]), (2, [["b"]]), (None, [["a"]])], "id int, x array<array<string>>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id long")
    out = en.encode_nested(df, "id", "x", vocab, [2])
    assert sorted(map(tuple, out.collect())) == [(1, [[2, 3, 2]]), (1, [[2, 3, 2]]), (2, [[3, 0]])]

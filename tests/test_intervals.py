"""Cover of intervals by calendar cells, and the join over it."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardpanel.plans.jobs import GRAIN, cover_cells, events_in_visits


def test_cells_cover_every_day_once(spark):
    rng = random.Random(1)
    spans = [(0, 0), (15, 16), (16, 31), (0, 255), (1, 256), (-40, -3), (-1, 0), (0, 18_262), (4095, 4097)]
    for _ in range(60):
        a = rng.randint(-9000, 9000)
        spans.append((a, a + rng.choice([rng.randint(0, 40), rng.randint(0, 6000)])))
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", cover_cells(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        days = [d for x in r.c for d in range(x.cell * GRAIN**x.level, (x.cell + 1) * GRAIN**x.level)]
        assert sorted(days) == list(range(r.a, r.b + 1))
        assert len(r.c) <= min(r.b - r.a + 1, 100)


def test_events_of_short_and_long_visits(spark):
    rng = random.Random(2)
    begin = dt.datetime(1960, 1, 1)
    at = lambda: begin + dt.timedelta(days=rng.randint(0, 20_000), seconds=rng.randint(0, 86_399))
    visits = []
    for i in range(120):
        s = at()
        visits.append((i % 9, i, s, s + dt.timedelta(seconds=rng.choice([0, 3600, 86_400 * 5, 86_400 * 400, 86_400 * 18_000, -60]))))
    visits.append((0, 500, None, begin))
    events = [(i % 11, i, at()) for i in range(1500)] + [(v[0], 2000 + v[1], v[2]) for v in visits if v[2]] + [(v[0], 3000 + v[1], v[3]) for v in visits] + [(1, 9000, None)]
    got = events_in_visits(spark.createDataFrame(visits, "patient_id long, visit_id long, start timestamp, end timestamp"), spark.createDataFrame(events, "patient_id long, event long, time timestamp"))
    want = sorted((p, v, e) for p, v, s, t in visits if s for q, e, x in events if x and p == q and s <= x <= t)
    assert sorted((r.patient_id, r.visit_id, r.event) for r in got.collect()) == want
    assert len(want) > 500


def test_few_visits_are_sent_as_a_list_and_many_by_cells(spark, monkeypatch):
    from wardpanel.plans import jobs

    at = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    visits = spark.createDataFrame([(p, v, at(v * 3), at(v * 3 + 4 + 40 * (v % 2))) for p in (1, 2) for v in range(9)], "patient_id long, visit_id long, start timestamp, end timestamp")
    events = spark.createDataFrame([(p, e, at(e, 5 * (e % 3))) for p in (1, 2, 3) for e in range(70)], "patient_id long, event long, time timestamp")
    listed = events_in_visits(visits, events)
    assert "__level" not in listed._jdf.queryExecution().toString()
    monkeypatch.setattr(jobs, "FEW_VISITS", 5)
    cells = events_in_visits(visits, events)
    assert "__level" in cells._jdf.queryExecution().toString() and listed.columns == cells.columns
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, cells.collect())) and listed.count() > 100

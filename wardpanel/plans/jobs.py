"""Cohort and label jobs over visit, code, lab and note frames.

visits: patient_id, visit_id, start, end, died and optional extras.   codes: patient_id, visit_id, kind
(conditions, procedures, drugs), code, seq (a sortable position), time.   labs: patient_id, visit_id, time,
stored, item, value, seq.   The frames come from `cohort` for the shipped datasets or from any other source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardpanel.functions import codes as cd
from wardpanel.operators.order import group_rows, large, largest_group, neighbour
from wardpanel.operators.stay import los_category
from wardpanel.session import cut_lineage

KINDS = ("conditions", "procedures", "drugs")
VISIT_ORDER = ["start", "visit_id"]


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 3600000000.0


def whole_days(a: Column, b: Column) -> Column:
    """Floor of the difference in days."""
    return F.floor((micros(b) - micros(a)) / 86400000000.0)


def whole_years(birth: Column, at: Column) -> Column:
    """Age by calendar: the year difference, one less before the birthday."""
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(at) - F.year(birth) - before.cast("int")


def parse_two(value: Column, first: str = "yyyy-MM-dd HH:mm:ss", second: str = "yyyy-MM-dd") -> Column:
    return F.coalesce(F.try_to_timestamp(value, F.lit(first)), F.try_to_timestamp(value, F.lit(second)))


def code_lists(codes: DataFrame, by: Sequence[str] = ("visit_id",), kinds: Sequence[str] = KINDS, distinct: bool = False) -> DataFrame:
    """One ordered array per kind and group; one shuffle for all kinds."""
    def ordered(kind):
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "code"))))
        out = F.transform(rows, lambda r: r["code"])
        return (F.array_distinct(out) if distinct else out).alias(kind)

    return codes.where(F.col("code").isNotNull()).groupBy(*by).agg(*[ordered(k) for k in kinds])


def complete(df: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Rows whose code lists are all non-empty."""
    for k in kinds:
        df = df.where(F.size(k) > 0)
    return df


def visits_with_codes(visits: DataFrame, codes: DataFrame, kinds: Sequence[str] = KINDS, distinct: bool = False) -> DataFrame:
    return complete(visits.join(code_lists(codes, kinds=kinds, distinct=distinct), "visit_id"), kinds)


def length_of_stay(visits: DataFrame, codes: DataFrame) -> DataFrame:
    out = visits_with_codes(visits, codes)
    return out.select("patient_id", "visit_id", *KINDS, los_category(whole_days(F.col("start"), F.col("end"))).alias("los"))


def length_of_stay_minutes(visits: DataFrame, codes: DataFrame, minutes: str = "unit_minutes") -> DataFrame:
    """Stay length from a minute offset; stays without the offset are left out."""
    out = visits_with_codes(visits.where(F.col(minutes).isNotNull()), codes)
    return out.select("patient_id", "visit_id", *KINDS, los_category(F.floor(F.col(minutes) / 1440)).alias("los"))


def with_next(visits: DataFrame, columns: Mapping[str, str], order: Sequence[str] = VISIT_ORDER) -> DataFrame:
    """Columns of the next visit of the patient; visits that are dropped later still count as next."""
    moved = {new: F.col(old) for new, old in columns.items()}
    moved["__has_next"] = F.lit(True)
    out = neighbour(visits, ["patient_id"], order, moved)
    return out.where(F.col("__has_next")).drop("__has_next")


def readmission(visits: DataFrame, codes: DataFrame, window_days: int = 15, adult: Column | None = None) -> DataFrame:
    """1 when the next admission starts less than the window after discharge; last visits have no row."""
    out = with_next(visits, {"next_start": "start"})
    if adult is not None:
        out = out.where(adult)
    label = ((micros(F.col("next_start")) - micros(F.col("end"))) < window_days * 86400000000).cast("int")
    return visits_with_codes(out, codes).select("patient_id", "visit_id", *KINDS, label.alias("readmission"))


def readmission_same_hospital(stays: DataFrame, codes: DataFrame, exclude_minors: bool = True) -> DataFrame:
    """1 when the next stay belongs to the same hospital stay; ages that are not numbers are kept."""
    num = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    ordered = stays.withColumns({"__h": num("hospital_stay"), "__u": num("unit_visit")})
    out = with_next(ordered, {"next_stay": "hospital_stay"}, ["__h", "__u", "visit_id"])
    if exclude_minors:
        age = F.col("age").cast("string").try_cast("int")
        out = out.where(age.isNull() | (age >= 18))
    label = F.col("hospital_stay").eqNullSafe(F.col("next_stay")).cast("int")
    return visits_with_codes(out, codes).select("patient_id", "visit_id", *KINDS, label.alias("readmission"))


def mortality_next(visits: DataFrame, codes: DataFrame, order: Sequence[str] = VISIT_ORDER, kinds: Sequence[str] = KINDS, distinct: bool = False) -> DataFrame:
    """Death flag of the next visit; anything but 1 is 0."""
    out = with_next(visits, {"next_died": "died"}, order)
    label = F.when(F.col("next_died").cast("string") == "1", 1).otherwise(0)
    return visits_with_codes(out, codes, kinds, distinct).select("patient_id", "visit_id", *kinds, label.alias("mortality"))


#: Days per cell grow by this factor from one level to the next.
GRAIN, LEVELS = 16, 4
#: Visits of a patient that are sent as one list to the patient's events.
FEW_VISITS = 256


def cover_cells(first: Column, last: Column) -> Column:
    """Array of (level, cell) that covers the days `first` to `last` without overlap; a cell of level n holds GRAIN^n days.

    Whole coarse cells cover the middle and finer ones both ends: an interval of d days has at most 2 * GRAIN cells a level,
    instead of d rows.
    """
    empty = F.array().cast("array<struct<level:int,cell:bigint>>")
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))).otherwise(empty)
    parts, low, high, more = [], first.cast("bigint"), last.cast("bigint") + 1, F.lit(True)
    for level in range(LEVELS):
        if level == LEVELS - 1:
            parts.append(F.when(more, run(level, low, high)).otherwise(empty))
            break
        up, down = F.ceil(low / GRAIN).cast("bigint"), F.floor(high / GRAIN).cast("bigint")
        coarse = up < down
        ends = F.concat(run(level, low, up * GRAIN), run(level, down * GRAIN, high))
        parts.append(F.when(more & coarse, ends).when(more, run(level, low, high)).otherwise(empty))
        low, high, more = up, down, more & coarse
    return F.concat(*parts)


def events_in_visits(visits: DataFrame, events: DataFrame, start: Column | str = "start", end: Column | str = "end", time: str = "time") -> DataFrame:
    """Events with start <= time <= end in the same patient.

    Where no patient has more than `FEW_VISITS` visits or very many events, each event meets the list of the patient's visits: events are
    shuffled once, by patient, and the work that follows on a patient needs no other shuffle.  Otherwise a visit is covered by calendar cells of several grains, few whatever its length, and an event lies in one cell of each grain that
    occurs among the visits.  The join key is (patient, grain, cell), so a patient with very many events does not meet all of the
    patient's visits.
    """
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    day = lambda c: F.floor(micros(c) / 86400000000)
    spans = visits.withColumns({"__s": s, "__e": e}).where(F.col("__s") <= F.col("__e"))
    if largest_group(spans, ["patient_id"]) <= FEW_VISITS and largest_group(events, ["patient_id"]) <= group_rows(events):
        own = [c for c in visits.columns if c != "patient_id"]
        lists = spans.groupBy("patient_id").agg(F.collect_list(F.struct("__s", "__e", *own)).alias("__v"))
        met = events.drop(*own).join(large(lists), "patient_id")
        rest = [c for c in events.columns if c not in visits.columns]
        around = F.filter("__v", lambda v: (F.col(time) >= v["__s"]) & (F.col(time) <= v["__e"]))
        return met.select("patient_id", *rest, F.explode(around).alias("__v")).select("patient_id", *[F.col(f"__v.{c}").alias(c) for c in own], *rest)
    spans = spans.withColumn("__at", F.explode(cover_cells(day(F.col("__s")), day(F.col("__e"))))).withColumns({"__level": F.col("__at.level"), "__cell": F.col("__at.cell")}).drop("__at")
    levels = spans.agg(F.collect_set("__level").alias("l")).scalar()  # at most LEVELS values
    cell = lambda n: F.floor(day(F.col(time)) / F.pow(F.lit(float(GRAIN)), n)).cast("bigint")
    points = events.withColumn("__level", F.explode(levels)).withColumn("__cell", cell(F.col("__level")))
    keys = ["patient_id", "__level", "__cell"]
    drop = [c for c in points.columns if c in spans.columns and c not in keys]
    joined = spans.join(points.drop(*drop), keys)
    return joined.where((F.col(time) >= F.col("__s")) & (F.col(time) <= F.col("__e"))).drop("__s", "__e", "__level", "__cell")


def mortality_next_by_time(visits: DataFrame, codes: DataFrame, adult: Column | None = None) -> DataFrame:
    """As `mortality_next`, with the codes whose time lies inside the visit."""
    out = with_next(visits, {"next_died": "died"})
    if adult is not None:
        out = out.where(adult)
    cleaned = codes.withColumn("code", F.trim("code")).where(F.length("code") > 0)
    inside = events_in_visits(out.select("patient_id", "visit_id", "start", "end"), cleaned.drop("visit_id"))
    label = F.when(F.col("next_died").cast("string") == "1", 1).otherwise(0)
    return visits_with_codes(out, inside).select("patient_id", "visit_id", *KINDS, label.alias("mortality"))


def mortality_any_death(visits: DataFrame, codes: DataFrame, deaths: DataFrame) -> DataFrame:
    """1 when the patient has any death row; visits need at least one code of any kind; the last visit has no row."""
    out = with_next(visits, {"__next": "visit_id"})
    dead = deaths.select("patient_id").distinct().withColumn("__dead", F.lit(1))
    lists = code_lists(codes).where(F.size("conditions") + F.size("procedures") + F.size("drugs") > 0)
    rows = out.join(lists, "visit_id").join(dead, "patient_id", "left")
    return rows.select("patient_id", "visit_id", *KINDS, F.coalesce("__dead", F.lit(0)).alias("mortality"))


def note_text(notes: DataFrame, by: Sequence[str] = ("visit_id",), separator: str = "", lead: str = "") -> DataFrame:
    """Texts of a visit joined in order."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "text")))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(F.lit(lead), r["text"])), separator)
    return notes.where(F.col("text").isNotNull()).groupBy(*by).agg(joined.alias("clinical_notes"))


def mortality_with_notes(visits: DataFrame, codes: DataFrame, notes: DataFrame) -> DataFrame:
    """Next-visit death label with codes and notes; empty lists are kept."""
    out = with_next(visits, {"next_died": "died"})
    rows = out.join(code_lists(codes), "visit_id", "left").join(note_text(notes), "visit_id", "left")
    empty = F.array().cast("array<string>")
    label = F.when(F.col("next_died").cast("string") == "1", 1).otherwise(0)
    return rows.select(
        "patient_id", "visit_id", *[F.coalesce(k, empty).alias(k) for k in KINDS],
        F.coalesce("clinical_notes", F.lit("")).alias("clinical_notes"), label.alias("mortality"),
    )


def medical_coding(notes: DataFrame, codes: DataFrame) -> DataFrame:
    """Visit text and the sorted set of its codes; visits need both."""
    text = note_text(notes, ["patient_id", "visit_id"], lead=" ")
    sets = codes.where(F.col("code").isNotNull()).groupBy("visit_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return text.join(sets, "visit_id").select("patient_id", "visit_id", F.col("clinical_notes").alias("text"), "codes")


# ---- laboratory vectors --------------------------------------------------------------------------


def _category_of(item: Column, what: str) -> Column:
    """Category name or preference of an item, from the fixed lists (a map literal of 30 entries)."""
    entries = []
    for name, items in cd.LAB_CATEGORIES.items():
        for i, it in enumerate(items):
            entries += [F.lit(it), F.lit(name if what == "category" else i)]
    return F.create_map(*entries)[item]


def lab_pivot(labs: DataFrame, by: Sequence[str], items: Sequence[str] = cd.LAB_ITEMS) -> DataFrame:
    """One row per (group, time): the first value of each item in a fixed order, null when absent."""
    cell = lambda i: F.min_by("value", F.when(F.col("item") == i, F.col("seq"))).alias(i)
    wide = labs.where(F.col("item").isin(list(items))).groupBy(*by, "time").agg(*[cell(i) for i in items])
    return wide.select(*by, "time", F.array(*[F.col(f"`{i}`") for i in items]).alias("values"))


def lab_vector_first(labs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per (group, time): per category the value of the most preferred item present at that time."""
    spot = F.array_position(F.array(*[F.lit(i) for i in cd.LAB_ITEMS]), F.col("item")).cast("int") - 1  # items of a category lie together, preferred first
    rows = labs.where(F.col("item").isin(cd.LAB_ITEMS)).groupBy(*by, "time").agg(F.sort_array(F.collect_list(F.struct(spot.alias("k"), "seq", "value"))).alias("__r"))
    ends = [0, *accumulate(len(items) for items in cd.LAB_CATEGORIES.values())]
    best = lambda c: F.get(F.filter("__r", lambda r: (r["k"] >= c["low"]) & (r["k"] < c["high"])), 0)["value"]
    spans = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(ends, ends[1:])])
    return rows.select(*by, "time", F.transform(spans, best).alias("values"))


def lab_vector_mean(labs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group that has any lab: mean per category, NaN when absent."""
    cat = _category_of(F.col("item"), "category")
    mean = lambda c: F.coalesce(F.avg(F.when(cat == c, F.col("value"))), F.lit(float("nan")))
    return labs.groupBy(*by).agg(F.array(*[mean(c) for c in cd.LAB_CATEGORIES]).alias("values"))


def in_hospital_mortality(visits: DataFrame, labs: DataFrame, hours: int = 48) -> DataFrame:
    """Visits longer than the window with the labs charted and stored inside it; label is the visit's own death."""
    until = F.col("start") + F.make_dt_interval(hours=F.lit(hours))
    long = visits.where(hours_between(F.col("start"), F.col("end")) > hours).withColumn("until", until)
    timed = labs.where(F.col("item").isin(cd.LAB_ITEMS)).drop("visit_id")
    inside = events_in_visits(long, timed, "start", "until").where(F.col("stored") <= F.col("until"))
    rows = lab_pivot(inside, ["patient_id", "visit_id", "died"])
    series = rows.groupBy("patient_id", "visit_id", "died").agg(F.sort_array(F.collect_list(F.struct("time", "values"))).alias("labs"))
    return series.select("patient_id", "visit_id", "labs", F.col("died").cast("int").alias("mortality"))


def _sequence(visits: DataFrame, codes: DataFrame) -> DataFrame:
    """Visits with hours since the previous one and the diagnosis + procedure codes."""
    kinds = ("conditions", "procedures")
    lists = code_lists(codes.where(F.col("kind").isin(*kinds)), kinds=kinds).select("visit_id", F.concat("conditions", "procedures").alias("codes"))
    prev = neighbour(visits, ["patient_id"], VISIT_ORDER, {"__prev": F.col("start")}, -1)
    gap = F.coalesce(hours_between(F.col("__prev"), F.col("start")), F.lit(0.0))
    return prev.withColumn("gap_hours", gap).drop("__prev").join(lists, "visit_id", "left")


def _collect(rows: DataFrame, order: Sequence[str], value: str, time: str, name: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(time).alias("__t"), F.col(value).alias("__v"))))
    out = rows.groupBy("patient_id").agg(items.alias("__i"))
    return out.select("patient_id", F.struct(
        F.transform("__i", lambda r: r["__t"]).alias("time"), F.transform("__i", lambda r: r["__v"]).alias("value")).alias(name))


def patient_sequences(visits: DataFrame, codes: DataFrame, labs: DataFrame, adult: Column | None = None) -> DataFrame:
    """One row per patient: codes per visit with gaps, lab vectors with hours since admission, any death.

    Both parts must be present.  Ages that are not numbers drop the patient.
    """
    ok = visits if adult is None else visits.where(F.coalesce(adult, F.lit(False)))
    ok = cut_lineage(ok.where(F.col("end") >= F.col("start")).select("patient_id", "visit_id", "start", "end", "died"))
    return _patient_sequences(ok, codes, labs)


def _patient_sequences(ok: DataFrame, codes: DataFrame, labs: DataFrame) -> DataFrame:
    seq = _sequence(ok, codes).where(F.size("codes") > 0)
    icd = _collect(seq, VISIT_ORDER, "codes", "gap_hours", "icd_codes")
    timed = labs.where(F.col("item").isin(cd.LAB_ITEMS)).drop("visit_id")
    inside = events_in_visits(ok.select("patient_id", "visit_id", "start", "end"), timed).where(F.col("stored") <= F.col("end"))
    vec = lab_vector_first(inside, ["patient_id", "visit_id", "start"])
    vec = vec.withColumn("hours", hours_between(F.col("start"), F.col("time")))
    lab = _collect(vec, ["start", "visit_id", "time"], "values", "hours", "labs")
    dead = ok.groupBy("patient_id").agg(F.max(F.when(F.col("died").cast("string") == "1", 1).otherwise(0)).alias("mortality"))
    return icd.join(lab, "patient_id").join(dead, "patient_id")


def length_of_stay_sequences(visits: DataFrame, codes: DataFrame, labs: DataFrame, adult: Column | None = None) -> DataFrame:
    """As `patient_sequences`, with the stay category of the last visit as target."""
    ok = visits if adult is None else visits.where(F.coalesce(adult, F.lit(False)))
    ok = cut_lineage(ok.where(F.col("end") >= F.col("start")).select("patient_id", "visit_id", "start", "end", "died"))
    rows = _patient_sequences(ok, codes, labs).drop("mortality")
    last = ok.groupBy("patient_id").agg(F.max_by(F.struct("start", "end"), F.struct(*VISIT_ORDER)).alias("v"))
    return rows.join(last.select("patient_id", los_category(whole_days(F.col("v.start"), F.col("v.end"))).alias("los")), "patient_id")


def visits_before_death(visits: DataFrame) -> DataFrame:
    """Visits before the first death visit, and the patient label.

    The earliest death visit comes from an aggregate; no window over the patient is needed.
    """
    first = visits.where(F.col("died").cast("string") == "1").groupBy("patient_id").agg(F.min(F.struct(*VISIT_ORDER)).alias("__death"))
    rows = visits.join(first, "patient_id", "left")
    kept = rows.where(F.col("__death").isNull() | (F.struct(*VISIT_ORDER) < F.col("__death")))
    return kept.withColumn("mortality", F.col("__death").isNotNull().cast("int")).drop("__death")


def positive_findings(rows: DataFrame, findings: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    """Names of findings above zero, distinct, in order of first appearance."""
    above = lambda f: F.col(f"`{f}`").cast("string").try_cast("double") > 0
    firsts = [F.min(F.when(above(f), F.struct(F.col(order).alias("__o"), F.lit(i).alias("i"), F.lit(f).alias("name")))).alias(f"__f{i}") for i, f in enumerate(findings)]
    names = F.sort_array(F.array_compact(F.array(*[f"__f{i}" for i in range(len(firsts))])))
    found = rows.groupBy(*by).agg(*firsts).select(*by, F.array_distinct(F.transform(names, lambda r: r["name"])).alias("findings"))
    return found.where(F.size("findings") > 0)


def multimodal_mortality(visits: DataFrame, codes: DataFrame, notes: DataFrame, labs: DataFrame, images: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per patient with codes per visit, notes, labs from the first admission, findings and an image; all parts required.

    notes carry kind discharge / radiology; images: patient_id, path, seq; findings: patient_id, findings.
    """
    visits = cut_lineage(visits.select("patient_id", "visit_id", "start", "end", "died"))
    kept = cut_lineage(visits_before_death(visits).where(F.col("end") >= F.col("start")).drop("died"))
    lists = kept.select("patient_id", "visit_id", "start").join(code_lists(codes), "visit_id", "left")
    empty = F.array().cast("array<string>")
    per_visit = lists.groupBy("patient_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "visit_id", *[F.coalesce(k, empty).alias(k) for k in KINDS]))).alias("__v"))
    parts = [F.col(f"__v.{k}").alias(k) for k in KINDS]
    base = per_visit.select("patient_id", *parts)
    for k in KINDS:
        base = base.where(F.exists(k, lambda x: F.size(x) > 0))
    ids = kept.select("visit_id", "start")
    texts = notes.where(F.length("text") > 0).join(ids, "visit_id")
    pick = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "visit_id", "seq", "text")))), lambda r: r["text"]).alias(kind)
    noted = texts.groupBy("patient_id").agg(pick("discharge"), pick("radiology"))
    first = kept.groupBy("patient_id").agg(F.min("start").alias("__first"), F.max("mortality").alias("mortality"))
    timed = labs.where(F.col("item").isin(cd.LAB_ITEMS)).drop("visit_id")
    inside = events_in_visits(kept.select("patient_id", "visit_id", "start", "end"), timed).where(F.col("stored") <= F.col("end"))
    vec = lab_vector_first(inside, ["patient_id", "visit_id"]).join(first, "patient_id")
    vec = vec.withColumn("hours", hours_between(F.col("__first"), F.col("time")))
    lab = _collect(vec, ["hours", "visit_id"], "values", "hours", "labs")
    image = images.where(F.length("path") > 0).groupBy("patient_id").agg(F.min_by("path", "seq").alias("image_path"))
    out = base.join(noted, "patient_id").join(lab, "patient_id").join(image, "patient_id").join(first.drop("__first"), "patient_id")
    out = out.join(findings, "patient_id", "left")
    return out.withColumn("findings", F.coalesce("findings", empty))


# ---- diabetes jobs -------------------------------------------------------------------------------


def _marked_codes(codes: DataFrame) -> DataFrame:
    letter = F.when(F.col("kind") == "conditions", "D_").otherwise("P_")
    return codes.where(F.col("kind").isin("conditions", "procedures") & (F.length("code") > 0)).select(
        "visit_id", F.struct(F.col("kind"), F.col("seq")).alias("seq"), F.concat(letter, cd.plain(F.col("code"))).alias("code"))


def _diabetes_rows(visits: DataFrame, codes: DataFrame, labs: DataFrame, kept: DataFrame) -> DataFrame:
    marked = _marked_codes(codes)
    first = marked.groupBy("visit_id", "code").agg(F.min("seq").alias("seq"))
    lists = first.groupBy("visit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda r: r["code"]).alias("codes"))
    prev = neighbour(kept, ["patient_id"], VISIT_ORDER, {"__prev": F.col("start")}, -1)
    rows = prev.withColumn("gap_hours", F.coalesce(hours_between(F.col("__prev"), F.col("start")), F.lit(0.0)))
    icd = _collect(rows.join(lists, "visit_id"), VISIT_ORDER, "codes", "gap_hours", "icd_codes")
    vec = rows.join(lab_vector_mean(labs, ["visit_id"]), "visit_id")
    lab = _collect(vec, VISIT_ORDER, "values", "gap_hours", "labs")
    nan = F.array(*[F.lit(float("nan"))] * len(cd.LAB_CATEGORIES))
    none = F.struct(F.array(F.lit(0.0)).alias("time"), F.array(nan).alias("value"))
    return icd.join(lab, "patient_id", "left").withColumn("labs", F.coalesce("labs", none))


def ketoacidosis(visits: DataFrame, codes: DataFrame, labs: DataFrame) -> DataFrame:
    """History strictly before the first visit with a ketoacidosis code; label is whether there is one."""
    hit = codes.where((F.col("kind") == "conditions") & cd.in_code_group(F.col("code"), F.col("version"), cd.DKA_ICD9, cd.DKA_ICD10))
    marked = visits.join(hit.select("visit_id").distinct(), "visit_id", "left_semi")
    first = marked.groupBy("patient_id").agg(F.min(F.struct(*VISIT_ORDER)).alias("__first"))
    rows = visits.join(first, "patient_id", "left")
    kept = rows.where(F.col("__first").isNull() | (F.struct(*VISIT_ORDER) < F.col("__first"))).drop("__first")
    out = _diabetes_rows(visits, codes, labs, kept)
    return out.join(first.select("patient_id", F.lit(1).alias("__label")), "patient_id", "left").withColumn("label", F.coalesce("__label", F.lit(0))).drop("__label")


def ketoacidosis_type1(visits: DataFrame, codes: DataFrame, labs: DataFrame, days: int = 90) -> DataFrame:
    """Patients with a type-1 code; history ends `days` after the first such code; label needs an event within `days` of one."""
    dx = codes.where(F.col("kind") == "conditions")
    t1 = dx.where(cd.in_code_group(F.col("code"), F.col("version"), cd.T1_ICD9, cd.T1_ICD10))
    start = t1.groupBy("patient_id").agg(F.min("time").alias("__t1"), F.collect_set("time").alias("__times"))
    until = F.col("__t1") + F.make_dt_interval(days=F.lit(days))
    inside = visits.join(start, "patient_id").where(F.col("start") <= until)
    dka = dx.where(cd.in_code_group(F.col("code"), F.col("version"), cd.DKA_ICD9, cd.T1_DKA_ICD10))
    at = dka.groupBy("visit_id").agg(F.min_by("time", "seq").alias("__dka"))
    hits = inside.join(at, "visit_id")
    first = hits.groupBy("patient_id").agg(
        F.min(F.struct(*VISIT_ORDER)).alias("__first"),
        F.min_by(F.struct("__dka", "__t1", "__times"), F.struct(*VISIT_ORDER)).alias("e"))
    limit = F.col("e.__t1") + F.make_dt_interval(days=F.lit(days))
    near = F.exists("e.__times", lambda t: F.abs(whole_days(t, F.col("e.__dka"))) <= days)
    label = ((F.col("e.__dka") <= limit) & near).cast("int")
    marks = first.select("patient_id", "__first", label.alias("label"))
    rows = inside.join(marks.select("patient_id", "__first"), "patient_id", "left")
    kept = rows.where(F.col("__first").isNull() | (F.struct(*VISIT_ORDER) < F.col("__first"))).select(*visits.columns)
    out = _diabetes_rows(visits, codes, labs, kept)
    return out.join(marks.drop("__first"), "patient_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---- medication ----------------------------------------------------------------------------------


def map_codes_ordered(codes: DataFrame, mapping: DataFrame, by: Sequence[str] = ("visit_id",)) -> DataFrame:
    """Codes mapped to targets: distinct targets in order of first appearance, unmapped and missing codes dropped.

    mapping: source, target, rank (order of targets of one source).
    """
    clean = codes.where(~cd.is_missing(F.col("code"))).withColumn("source", F.trim("code"))
    hits = clean.join(mapping, "source").where(F.length(F.trim("target")) > 0)
    first = hits.groupBy(*by, F.trim("target").alias("code")).agg(F.min(F.struct("seq", "rank")).alias("seq"))
    return first


def drug_history(visits: DataFrame, codes: DataFrame, hide_current: bool = True, at_least_two: bool = True) -> DataFrame:
    """Cumulative code lists per complete visit; the current drugs are the target and empty in the history.

    The output repeats the history of a patient on every later visit, as the sample format asks.
    """
    rows = visits_with_codes(visits, codes)
    up_to = Window.partitionBy("patient_id").orderBy(*VISIT_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    hist = rows.select(
        "patient_id", "visit_id", *VISIT_ORDER[:1], F.col("drugs").alias("target"),
        *[F.collect_list(k).over(up_to).alias(k) for k in KINDS], F.count(F.lit(1)).over(Window.partitionBy("patient_id")).alias("__n"),
    )
    if at_least_two:
        hist = hist.where("__n >= 2")
    past = F.slice("drugs", 1, F.size("drugs") - 1)
    shown = F.concat(past, F.array(F.array().cast("array<string>"))) if hide_current else F.col("drugs")
    return hist.select("patient_id", "visit_id", "conditions", "procedures", shown.alias("drugs_hist"), F.col("target").alias("drugs"))


# ---- linkage -------------------------------------------------------------------------------------


def identifiers(*columns: Column) -> Column:
    return F.concat_ws("+", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def age_years(birth: Column, at: Column) -> Column:
    """Days divided by 365.25, rounded down."""
    return F.floor(whole_days(birth, at) / 365.25).cast("int")


def linkage_pairs(visits: DataFrame, codes: DataFrame, separator: str = "[SEP]", lead: str = "") -> DataFrame:
    """The last visit of an adult as query, all earlier adult visits with codes joined as document.

    visits carry `birth` and `identifiers`.  Codes of other kinds are left out before they are moved.
    """
    lists = code_lists(codes.where(F.col("kind") == "conditions"), kinds=("conditions",)).where(F.size("conditions") > 0)
    aged = visits.withColumn("age", age_years(F.col("birth"), F.col("start")))
    last = aged.groupBy("patient_id").agg(F.max(F.struct(*VISIT_ORDER)).alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    rows = aged.join(last, "patient_id").join(lists, "visit_id")
    is_last = F.struct(*VISIT_ORDER) == F.col("__last")
    query = rows.where(is_last & (F.col("age") >= 18)).select("patient_id", "visit_id", "conditions", "age", "identifiers", "start")
    docs = rows.where(~is_last & (F.col("age") >= 18))
    body = F.sort_array(F.collect_list(F.struct(*VISIT_ORDER, "conditions")))
    joined = F.aggregate(
        "__b", F.array().cast("array<string>"),
        lambda acc, r: F.when(F.size(acc) == 0, r["conditions"]).otherwise(F.concat(acc, F.array(F.lit(separator)), r["conditions"])))
    d = docs.groupBy("patient_id").agg(
        body.alias("__b"), F.max_by(F.struct("visit_id", "age", "identifiers", "start"), F.struct(*VISIT_ORDER)).alias("d")
    ).select("patient_id", joined.alias("d_conditions"), "d", F.array_join(F.transform("__b", lambda r: r["visit_id"]), "|").alias("d_visit_ids"))
    head = F.array(F.lit(lead))
    return query.join(d, "patient_id").select(
        "patient_id", "visit_id", F.concat(head, "conditions").alias("conditions"), "age", "identifiers",
        F.col("d.visit_id").alias("d_visit_id"), F.concat(head, "d_conditions").alias("d_conditions"), F.col("d.age").alias("d_age"),
        F.col("d.identifiers").alias("d_identifiers"), whole_days(F.col("d.start"), F.col("start")).alias("time_gap_days"), "d_visit_ids",
    )


def linkage_pairs_adjacent(visits: DataFrame, codes: DataFrame, lead: str = "<cls>") -> DataFrame:
    """The last visit against the one just before it; both adult, both with codes."""
    lists = code_lists(codes, kinds=("conditions",)).where(F.size("conditions") > 0)
    aged = visits.withColumn("age", age_years(F.col("birth"), F.col("start")))
    prev = neighbour(aged, ["patient_id"], VISIT_ORDER, {"d": F.struct("visit_id", "age", "identifiers")}, -1)
    last = aged.groupBy("patient_id").agg(F.max(F.struct(*VISIT_ORDER)).alias("__last"))
    rows = prev.join(last, "patient_id").where((F.struct(*VISIT_ORDER) == F.col("__last")) & (F.col("age") >= 18) & (F.col("d.age") >= 18))
    both = rows.join(lists, "visit_id").join(lists.select(F.col("visit_id").alias("d_visit_id"), F.col("conditions").alias("d_conditions")), F.col("d.visit_id") == F.col("d_visit_id"))
    head = F.array(F.lit(lead))
    return both.select(
        "patient_id", "visit_id", F.concat(head, "conditions").alias("conditions"), "age", "identifiers", "d_visit_id",
        F.concat(head, "d_conditions").alias("d_conditions"), F.col("d.age").alias("d_age"), F.col("d.identifiers").alias("d_identifiers"))


# ---- other label jobs ----------------------------------------------------------------------------


def positive_bits(value: Column, width: int = 14) -> Column:
    """Positions of set bits, counted from the most significant of `width` bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(value, F.lit(width - 1) - i) == 1)


def codes_until(labels: DataFrame, events: DataFrame, splits: DataFrame) -> DataFrame:
    """Codes of the patient up to and including the label time, with the official split."""
    joined = labels.join(events.select("patient_id", "time", "seq", "code"), "patient_id").where(F.col("time") <= F.col("label_time"))
    rows = joined.groupBy("patient_id", "label_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("time", "seq", "code"))), lambda r: r["code"]).alias("feature"))
    empty = labels.join(rows.select("label_id"), "label_id", "left_anti").select("patient_id", "label_id", "label", F.array().cast("array<string>").alias("feature"))
    return rows.unionByName(empty).join(splits, "patient_id")


def number_text(c: Column) -> Column:
    """A number as text with at least one decimal."""
    return c.cast("double").cast("string")


def prefixed(items: Mapping[str, Column]) -> Column:
    """`prefix_value` strings, nulls skipped."""
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{p}_"), v.cast("string"))) for p, v in items.items()]))


def survival_features(rows: DataFrame, target: str, numeric: Mapping[str, Sequence[str]], text: Mapping[str, Sequence[str]]) -> DataFrame:
    """Feature lists of prefixed strings; label clipped to [0, 1]; rows without a label dropped."""
    from wardpanel.functions.numeric import number_or_null

    groups = list(dict.fromkeys([*numeric, *text]))
    lists = []
    for g in groups:
        items = {c: number_text(number_or_null(F.col(f"`{c}`").cast("string"))) for c in numeric.get(g, ())}
        items.update({c: F.col(f"`{c}`").cast("string") for c in text.get(g, ())})
        lists.append(prefixed(items).alias(g))
    y = number_or_null(F.col(target).cast("string"))
    out = rows.withColumn("__y", y).where("__y is not null")
    return out.select("patient_id", *lists, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__y"))).alias("survival_probability"))


def gene_lists(mutations: DataFrame) -> DataFrame:
    kept = mutations.where(F.col("gene").isNotNull() & (F.lower("gene") != "nan"))
    return kept.groupBy("patient_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "gene"))), lambda r: r["gene"]).alias("mutations"))


def vital_status(raw: Column) -> Column:
    low = F.lower(raw.cast("string"))
    return F.when(low.isin("dead", "deceased", "1"), 1).when(low.isin("alive", "living", "0"), 0)


def cancer_survival(clinical: DataFrame, mutations: DataFrame) -> DataFrame:
    base = clinical.withColumn("vital", vital_status(F.col("vital_status"))).where("vital is not null")
    zero = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c)
    out = base.join(gene_lists(mutations), "patient_id", "left")
    return out.select("patient_id", F.coalesce("mutations", F.array().cast("array<string>")).alias("mutations"), zero("age_at_diagnosis"), zero("gleason_score"), F.col("vital").alias("vital_status"))


def mutation_burden(patients: DataFrame, mutations: DataFrame, threshold: int = 10) -> DataFrame:
    """1 when the gene list (not distinct) has at least `threshold` entries; counted, not gathered."""
    kept = mutations.where(F.col("gene").isNotNull() & (F.lower("gene") != "nan"))
    n = kept.groupBy("patient_id").agg(F.count(F.lit(1)).alias("genes"))
    out = patients.join(n, "patient_id", "left").withColumn("genes", F.coalesce("genes", F.lit(0)))
    return out.select("patient_id", "genes", (F.col("genes") >= threshold).cast("int").alias("high_burden"))


def variant_significance(variants: DataFrame) -> DataFrame:
    from wardpanel.functions.text import text_or_empty

    out = variants.withColumn("label", cd.clinical_significance(F.col("clinical_significance"))).where("label is not null")
    return out.select("patient_id", *[text_or_empty(F.col(c)).alias(c) for c in ("gene_symbol", "variant_type", "chromosome")], F.col("label").alias("clinical_significance"))


def mutation_pathogenicity(mutations: DataFrame) -> DataFrame:
    from wardpanel.functions.text import text_or_empty

    out = mutations.where(F.col("fathmm_prediction").isin("PATHOGENIC", "NEUTRAL"))
    return out.select("patient_id", *[text_or_empty(F.col(c)).alias(c) for c in ("gene_name", "mutation_description", "primary_site")], (F.col("fathmm_prediction") == "PATHOGENIC").cast("int").alias("pathogenic"))


def finding_label(images: DataFrame, finding: str) -> DataFrame:
    return images.select("path", F.col(finding).cast("int").alias("label"))


def finding_labels(images: DataFrame, findings: Sequence[str]) -> DataFrame:
    """Names of the findings marked 1."""
    return images.select("path", F.array_compact(F.array(*[F.when(F.col(f).cast("int") == 1, F.lit(f)) for f in findings])).alias("labels"))


def present_pairs(rows: DataFrame, text: str, label: str) -> DataFrame:
    """Rows with both text and label."""
    return rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label)


def recording_labels(rows: DataFrame, recordings: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Recording paths of a patient and the disease classes marked 1."""
    return rows.select(
        "patient_id", F.array_compact(F.array(*recordings)).alias("recordings"),
        F.array_compact(F.array(*[F.when(F.col(c).cast("string") == "1", F.lit(c)) for c in classes])).alias("labels"))


def token_windows(rows: DataFrame, columns: Sequence[str], size: int | None, overlap: int = 0, extra: Sequence[str] = ()) -> DataFrame:
    """Windows of `size` words every size - overlap words, cut alike from all text columns; no size keeps whole texts."""
    if size is None:
        return rows.select(*extra, F.lit(0).alias("token_start"), *columns)
    words = {f"__w{i}": F.split(F.col(c), " ") for i, c in enumerate(columns)}
    starts = F.sequence(F.lit(0), F.size("__w0") - 1, F.lit(size - overlap))
    out = rows.withColumns(words).withColumn("token_start", F.explode(starts))
    cut = [F.array_join(F.slice(f"__w{i}", F.col("token_start") + 1, F.lit(size)), " ").alias(c) for i, c in enumerate(columns)]
    return out.select(*extra, "token_start", *cut)

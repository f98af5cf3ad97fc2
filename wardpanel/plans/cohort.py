"""Event tables of the shipped datasets to the frames that the jobs read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardpanel.functions import codes as cd


@dataclass(frozen=True)
class Family:
    """Where a dataset keeps its visits, codes, labs and notes (event type, attribute names)."""

    visit: str
    visit_id: str
    end: str | None
    died: str | None
    codes: Mapping[str, tuple[str, str]]
    code_visit: str
    version: str | None = None
    labs: str | None = None
    lab_item: str = "itemid"
    lab_value: str = "valuenum"
    lab_stored: str | None = "storetime"
    notes: Mapping[str, str] = field(default_factory=dict)
    extras: Mapping[str, str] = field(default_factory=dict)


_IDENTITY = {n: n for n in ("insurance", "language", "religion", "marital_status", "ethnicity")}
FAMILIES = {
    "mimic3": Family("admissions", "hadm_id", "dischtime", "hospital_expire_flag",
                     {"conditions": ("diagnoses_icd", "icd9_code"), "procedures": ("procedures_icd", "icd9_code"), "drugs": ("prescriptions", "ndc")},
                     "hadm_id", labs="labevents", lab_stored=None, notes={"note": "noteevents"}, extras=_IDENTITY),
    "mimic4": Family("admissions", "hadm_id", "dischtime", "hospital_expire_flag",
                     {"conditions": ("diagnoses_icd", "icd_code"), "procedures": ("procedures_icd", "icd_code"), "drugs": ("prescriptions", "ndc")},
                     "hadm_id", "icd_version", "labevents", notes={"discharge": "discharge", "radiology": "radiology"}),
    "eicu": Family("patient", "patientunitstayid", None, "hospitaldischargestatus",
                   {"conditions": ("diagnosis", "icd9code"), "procedures": ("physicalexam", "physicalexampath"), "drugs": ("medication", "drugname")},
                   "patientunitstayid", extras={"hospital_stay": "patienthealthsystemstayid", "unit_visit": "unitvisitnumber", "unit_minutes": "unitdischargeoffset", "age": "age"}),
    "omop": Family("visit_occurrence", "visit_occurrence_id", "visit_end_datetime", None,
                   {"conditions": ("condition_occurrence", "condition_concept_id"), "procedures": ("procedure_occurrence", "procedure_concept_id"),
                    "drugs": ("drug_exposure", "drug_concept_id")}, "visit_occurrence_id"),
}


def _attr(event: str, name: str) -> Column:
    return F.col(f"`{event}/{name}`")


def visits(events: DataFrame, family: str) -> DataFrame:
    f = FAMILIES[family]
    end = F.try_to_timestamp(_attr(f.visit, f.end)) if f.end else F.lit(None).cast("timestamp")
    died = F.lit(None).cast("string")
    if f.died:
        raw = _attr(f.visit, f.died)
        died = F.when(F.lower(raw).isin("expired", "1"), "1").when(F.lower(raw).isin("alive", "0"), "0")
    extra = [_attr(f.visit, src).alias(new) for new, src in f.extras.items() if f"{f.visit}/{src}" in events.columns]
    return events.where(F.col("event_type") == f.visit).select(
        "patient_id", _attr(f.visit, f.visit_id).alias("visit_id"), F.col("timestamp").alias("start"), end.alias("end"), died.alias("died"), *extra)


def codes(events: DataFrame, family: str, kinds: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """All code tables in one pass over the event table; `seq` keeps time, then the sequence number, then the code."""
    f = FAMILIES[family]
    table = dict(kinds or f.codes)
    pick = lambda make: F.coalesce(*[F.when(F.col("event_type") == ev, make(kind, ev, attr)) for kind, (ev, attr) in table.items()])
    has = lambda ev, name: f"{ev}/{name}" in events.columns
    number = lambda ev: _attr(ev, "seq_num").try_cast("int") if has(ev, "seq_num") else F.lit(None).cast("int")
    version = lambda ev: _attr(ev, f.version) if f.version and has(ev, f.version) else F.lit(None).cast("string")
    rows = events.where(F.col("event_type").isin([ev for ev, _ in table.values()])).select(
        "patient_id", pick(lambda k, ev, a: _attr(ev, f.code_visit)).alias("visit_id"), pick(lambda k, ev, a: F.lit(k)).alias("kind"),
        pick(lambda k, ev, a: _attr(ev, a)).alias("code"), pick(lambda k, ev, a: number(ev)).alias("__n"),
        pick(lambda k, ev, a: version(ev)).alias("version"), F.col("timestamp").alias("time"))
    return rows.select("patient_id", "visit_id", "kind", "code", F.struct("time", "__n", "code").alias("seq"), "time", "version")


def labs(events: DataFrame, family: str) -> DataFrame:
    f = FAMILIES[family]
    stored = F.try_to_timestamp(_attr(f.labs, f.lab_stored)) if f.lab_stored else F.col("timestamp")
    value = _attr(f.labs, f.lab_value).try_cast("double")
    visit = _attr(f.labs, f.code_visit) if f"{f.labs}/{f.code_visit}" in events.columns else F.lit(None).cast("string")
    return events.where(F.col("event_type") == f.labs).select(
        "patient_id", visit.alias("visit_id"), F.col("timestamp").alias("time"), stored.alias("stored"), _attr(f.labs, f.lab_item).alias("item"),
        value.alias("value"), F.struct("timestamp", stored.alias("stored"), value.alias("value")).alias("seq"))


def notes(events: DataFrame, family: str) -> DataFrame:
    f = FAMILIES[family]
    parts = [
        events.where(F.col("event_type") == ev).select(
            "patient_id", _attr(ev, f.code_visit).alias("visit_id"), F.lit(kind).alias("kind"),
            F.struct(F.col("timestamp"), _attr(ev, "text").alias("t")).alias("seq"), _attr(ev, "text").alias("text"))
        for kind, ev in f.notes.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_patient(frame: DataFrame, events: DataFrame, event_type: str, columns: Mapping[str, str]) -> DataFrame:
    """Columns of the patient table joined to visits (first row per patient)."""
    picked = events.where(F.col("event_type") == event_type).groupBy("patient_id").agg(*[
        F.max(_attr(event_type, src)).alias(new) for new, src in columns.items()
    ])
    return frame.join(picked, "patient_id", "left")

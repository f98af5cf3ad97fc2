"""Delimited source tables to one event table.

Raw columns are text.  The event table has patient_id, event_type, timestamp and one sparse text column
`table/attribute` per attribute.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardpanel.session import checkpoint_folder


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, repartitioned once; larger inputs pass through untouched.

    For plain scans only: heavy per-row work on a single small file would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


@dataclass(frozen=True)
class JoinConfig:
    file_path: str
    on: str
    how: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TableConfig:
    name: str
    file_path: str
    patient_id: str | None
    timestamp: str | tuple[str, ...] | None
    attributes: tuple[str, ...]
    timestamp_format: str | None = None
    joins: tuple[JoinConfig, ...] = ()
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    multiline: bool = False


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def resolve_path(spark: SparkSession, path: str) -> str:
    """The path itself or its .csv / .csv.gz / .tsv / .tsv.gz variant."""
    if _exists(spark, path):
        return path
    stem = path
    for ext in (".gz", ".csv", ".tsv"):
        stem = stem.removesuffix(ext)
    for ext in (".csv", ".csv.gz", ".tsv", ".tsv.gz"):
        if _exists(spark, stem + ext):
            return stem + ext
    raise FileNotFoundError(path)


def scan_delimited(spark: SparkSession, path: str, multiline: bool = True, comment: str | None = None) -> DataFrame:
    """All columns as text, lower-case names, empty cells null.

    Multi-line cells cost file splitting, so tables without free text should pass `multiline=False`.
    """
    base = path.removesuffix(".gz")
    reader = spark.read.option("header", True).option("sep", "\t" if base.endswith((".tsv", ".maf", ".txt")) else ",")
    reader = reader.option("multiLine", multiline).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "")
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def scan_inferred(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """Text scan with the named columns cast; bad cells become null."""
    df = scan_delimited(spark, path, multiline=False)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def row_index(df: DataFrame, name: str) -> DataFrame:
    """Contiguous 0-based row number in file order: per-partition counts plus offsets, no global sort."""
    marked = df.withColumn("__mid", F.monotonically_increasing_id())
    part = F.shiftright("__mid", 33)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    out = marked.withColumn("__part", part).join(starts, "__part")
    return out.withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("__mid", "__part", "__start")


def parse_time(value: Column, fmt: str | None) -> Column:
    """Text to timestamp (milliseconds); a bad value is an error."""
    java = None
    if fmt:
        java = fmt
        for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss")):
            java = java.replace(a, b)
    parsed = F.try_to_timestamp(value, F.lit(java)) if java else value.try_cast("timestamp")
    bad = value.isNotNull() & parsed.isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad timestamp: "), value)).cast("timestamp")).otherwise(parsed)
    return F.date_trunc("millisecond", checked)


def load_table(spark: SparkSession, root: str, cfg: TableConfig, scan=None) -> DataFrame:
    """One source table as events.  `scan(file_path)` may replace the file reader (tests, other storage)."""
    read = scan or (lambda p: scan_delimited(spark, resolve_path(spark, f"{root}/{p}"), cfg.multiline))
    df = read(cfg.file_path)
    if cfg.preprocess:
        df = cfg.preprocess(df)
    for j in cfg.joins:
        other = read(j.file_path).select(j.on, *[c for c in j.columns if c != j.on])
        df = df.join(other, j.on, j.how)
    if cfg.timestamp is None:
        when = F.lit(None).cast("timestamp")
    else:
        parts = [cfg.timestamp] if isinstance(cfg.timestamp, str) else list(cfg.timestamp)
        when = parse_time(F.concat(*[F.col(p).cast("string") for p in parts]), cfg.timestamp_format)
    if cfg.patient_id is None:
        df = row_index(df, "__row")
    pid = F.col(cfg.patient_id or "__row").cast("string")
    attrs = [F.col(f"`{a.lower()}`").alias(f"{cfg.name}/{a}") for a in cfg.attributes]
    return df.select(pid.alias("patient_id"), F.lit(cfg.name).alias("event_type"), when.alias("timestamp"), *attrs)


def union_events(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of event tables over the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load_events(spark: SparkSession, root: str, tables: Sequence[TableConfig], scan=None) -> DataFrame:
    return union_events([load_table(spark, root, t, scan) for t in tables])


def store_key(root: str, tables: Sequence[str], name: str, extra: Mapping | None = None) -> str:
    """Stable id of a dataset, task or encoder configuration."""
    text = json.dumps({"root": root, "tables": sorted(tables), "name": name, "extra": dict(extra or {})}, sort_keys=True, default=str)
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def write_event_store(events: DataFrame, path: str, partitions: int | None = None) -> str:
    """Parquet sorted by patient and time.

    Ranges are cut on (patient, time), so a patient with very many events spreads over several files.
    The commit protocol leaves no partial output behind.
    """
    cols = ["patient_id", "timestamp"]
    ranged = events.repartitionByRange(partitions, *cols) if partitions else events.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)
    return path


def cached_store(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], write=write_event_store) -> DataFrame:
    """The stored table of this key, built once."""
    path = f"{folder}/{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        write(make(), path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def dev_subset(events: DataFrame, n: int = 1000, key: str = "patient_id") -> DataFrame:
    """Events of the first n patients."""
    few = events.select(key).distinct().orderBy(key).limit(n)
    return events.join(F.broadcast(few), key, "left_semi")


OPERATORS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


def get_events(events: DataFrame, event_type: str | None = None, start=None, end=None, filters: Sequence[tuple] = ()) -> DataFrame:
    """Events of a type in a closed time range with attribute conditions."""
    if filters and not event_type:
        raise ValueError("attribute filters need an event type")
    out = events
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end))
    for attr, op, value in filters:
        out = out.where(OPERATORS[op](F.col(f"`{event_type}/{attr}`"), F.lit(value)))
    return out


def keep_sources(events: DataFrame, event_type: str, attr: str, allowed: Sequence[str]) -> DataFrame:
    """Rows of other types, and rows of this type whose attribute is allowed."""
    return events.where((F.col("event_type") != event_type) | F.col(f"`{event_type}/{attr}`").isin(list(allowed)))


def patients_having(events: DataFrame, event_type: str) -> DataFrame:
    ids = events.where(F.col("event_type") == event_type).select("patient_id").distinct()
    return events.join(ids, "patient_id", "left_semi")


def patients_with_any(events: DataFrame, condition: Column, key: str = "patient_id") -> DataFrame:
    """Full history of the patients for whom the condition holds at least once (null is false)."""
    ids = events.where(F.coalesce(condition, F.lit(False))).select(key).distinct()
    return events.join(ids, key, "left_semi")


def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("patient_id").alias("patients"))


def event_stats_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("patient_id").alias("patients"))


#: Rows of small results of a user function that are put together before they leave Python.
OUT_ROWS = 1_000


def by_patient(events: DataFrame, task: Callable, schema: T.StructType | str, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """User function over the events of each patient, in time order.

    task(patient_id, chunks) gets an iterator of pandas frames and yields pandas frames, so a patient with very many
    events streams through in bounded memory.  The shipped jobs do not need this: they are plain joins and aggregates.
    """
    def run(batches):
        import itertools

        import numpy as np
        import pandas as pd

        def pieces():
            for pdf in batches:
                ids = pdf["patient_id"].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
                for a, b in zip(starts, [*starts[1:], len(ids)]):
                    yield ids[a], pdf.iloc[a:b]

        held, rows = [], 0
        for pid, parts in itertools.groupby(pieces(), key=lambda p: p[0]):
            chunks = (part for _, part in parts)
            for out in task(pid, chunks):
                held.append(out)
                rows += len(out)
                if rows >= OUT_ROWS or len(held) >= OUT_ROWS:
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held, rows = [], 0
            for _ in chunks:
                pass
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]

    together = events.where(F.col("patient_id").isNotNull()).repartition("patient_id").sortWithinPartitions("patient_id", *order)
    return together.mapInPandas(run, schema)


# ---- table preprocessing -------------------------------------------------------------------------


def fill_chart_time(df: DataFrame) -> DataFrame:
    """Chart time, or midnight of the chart date."""
    return df.withColumn("charttime", F.coalesce("charttime", F.concat("chartdate", F.lit(" 00:00:00"))))


def birth_time(df: DataFrame) -> DataFrame:
    two = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("01")), 2, "0")
    date = F.concat_ws("-", F.col("year_of_birth").cast("string"), two("month_of_birth"), two("day_of_birth"))
    return df.withColumn("birth_datetime", F.concat(date, F.lit(" 00:00:00")))

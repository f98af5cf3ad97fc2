"""Raw public files to the tables the configurations expect, and small file sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardpanel.sources.tables import row_index, scan_delimited


def triples_source(spark: SparkSession, path: str) -> DataFrame:
    """head, relation, tail by name, else the first three columns."""
    df = scan_delimited(spark, path, multiline=False)
    names = ["head", "relation", "tail"]
    picked = names if all(n in df.columns for n in names) else df.columns[:3]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(picked, names)])


FACTOR_ENTRY = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("factor_id", "factor_name", "factor_expression", "factor_description", "quality", "cache_location")
])


def factor_library_source(spark: SparkSession, path: str, quality: str | None = None, limit: int | None = None, lines: bool = False) -> DataFrame:
    """JSON library {"factors": {id: entry}} as rows; entries without an expression are dropped.

    A file is one document, or with `lines` holds a document per line, so that a large library is read by many tasks.
    """
    schema = T.StructType([T.StructField("factors", T.MapType(T.StringType(), FACTOR_ENTRY))])
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    rows = raw.select(F.explode("factors").alias("id", "e")).select(
        F.col("id").alias("factor_id"), F.coalesce("e.factor_name", "id").alias("factor_name"), "e.factor_expression",
        F.coalesce("e.factor_description", F.lit("")).alias("factor_description"), "e.quality", "e.cache_location",
    )
    rows = rows.where(F.length("factor_expression") > 0)
    if quality:
        rows = rows.where(F.col("quality") == quality)
    return rows.orderBy("factor_id").limit(limit) if limit else rows


def factor_id(name: Column, expression: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", name, expression).cast("binary")), 1, 16)


def upsert_factors(library: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones with the same id; later rows of a batch (by `seq`) win."""
    keyed = new.withColumn("factor_id", factor_id(F.col("factor_name"), F.col("factor_expression")))
    cols = [c for c in keyed.columns if c not in ("factor_id", "seq")]
    last = keyed.groupBy("factor_id").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("factor_id", "r.*")
    return library.join(last, "factor_id", "left_anti").unionByName(last, allowMissingColumns=True)


# Column names of the public variant and mutation exports.
VARIANT_COLUMNS = {
    "genesymbol": "gene_symbol", "clinicalsignificance": "clinical_significance", "reviewstatus": "review_status", "chromosome": "chromosome",
    "positionvcf": "position", "referenceallelevcf": "reference_allele", "alternateallelevcf": "alternate_allele", "type": "variant_type",
    "assembly": "assembly",
}
MUTATION_COLUMNS = {
    "sample_id": ["id_sample", "sample_id"], "gene_name": ["gene_name", "gene name"], "hgvsc": ["hgvsc"], "hgvsp": ["hgvsp"],
    "mutation_description": ["mutation_description", "mutation description"], "fathmm_prediction": ["fathmm_prediction", "fathmm prediction"],
    "primary_site": ["primary_site", "primary site"], "primary_histology": ["primary_histology", "primary histology"],
    "mutation_somatic_status": ["mutation_somatic_status", "mutation somatic status"],
}
TUMOUR_MUTATION_COLUMNS = {
    "hugo_symbol": ["hugo_symbol"], "variant_classification": ["variant_classification"], "variant_type": ["variant_type"], "hgvsc": ["hgvsc"],
    "hgvsp": ["hgvsp_short", "hgvsp"], "tumor_sample_barcode": ["tumor_sample_barcode"],
}
CLINICAL_COLUMNS = {
    "patient_id": ["submitter_id", "bcr_patient_barcode", "case_id", "patient_id"], "age_at_diagnosis": ["age_at_diagnosis", "age_at_initial_pathologic_diagnosis"],
    "gleason_score": ["gleason_score", "primary_gleason_grade"], "vital_status": ["vital_status"], "days_to_death": ["days_to_death"],
    "tumor_stage": ["tumor_stage", "ajcc_pathologic_stage", "pathologic_stage"],
}


def _rename(df: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each output column from the alternative headers that exist."""
    cols = []
    for out, names in mapping.items():
        have = [F.col(f"`{n}`") for n in names if n in df.columns]
        if have:
            cols.append((have[0] if len(have) == 1 else F.coalesce(*have)).alias(out))
    extra = [F.col(c) for c in ("__row", "__order") if c in df.columns]
    return df.select(*cols, *extra)


def prepare_variants(raw: DataFrame, assembly: str = "GRCh38") -> DataFrame:
    out = _rename(raw, {v: [k] for k, v in VARIANT_COLUMNS.items()})
    return out.where(F.col("assembly") == assembly) if "assembly" in out.columns else out


def prepare_mutations(raw: DataFrame) -> DataFrame:
    """Somatic mutation export; a row number stands in for a missing sample id."""
    if not any(n in raw.columns for n in MUTATION_COLUMNS["sample_id"]):
        raw = row_index(raw, "sample_id").withColumn("sample_id", F.col("sample_id").cast("string"))
    return _rename(raw, MUTATION_COLUMNS)


def prepare_tumour_mutations(raw: DataFrame) -> DataFrame:
    """Patient = first 12 characters of the sample barcode."""
    if "tumor_sample_barcode" in raw.columns:
        out = _rename(raw, TUMOUR_MUTATION_COLUMNS).withColumn("patient_id", F.substring("tumor_sample_barcode", 1, 12))
    else:
        out = _rename(row_index(raw, "__row"), TUMOUR_MUTATION_COLUMNS).withColumn("patient_id", F.col("__row").cast("string")).drop("__row")
    return out.select("patient_id", *[c for c in out.columns if c != "patient_id"])


def prepare_tumour_clinical(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per patient: the first one in `order` (file order when not given)."""
    if not order:
        raw, order = row_index(raw, "__order"), ["__order"]
    else:
        raw = raw.withColumn("__order", F.struct(*order))
        order = ["__order"]
    out = _rename(raw, CLINICAL_COLUMNS)
    cols = [c for c in out.columns if c not in ("patient_id", "__order")]
    return out.groupBy("patient_id").agg(F.min_by(F.struct(*cols), "__order").alias("r")).select("patient_id", "r.*")


# Finding classes of the chest image set.
FINDINGS = (
    "atelectasis", "cardiomegaly", "consolidation", "edema", "effusion", "emphysema", "fibrosis", "hernia", "infiltration", "mass", "nodule",
    "pleural_thickening", "pneumonia", "pneumothorax",
)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names below a folder (contents are not read)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def index_findings(labels: DataFrame, files: DataFrame, folder: str, classes: Sequence[str] = FINDINGS, image: str = "image", text: str = "findings") -> DataFrame:
    """Rows whose image exists, one 0/1 column per finding named in the text."""
    kept = labels.join(files.select(F.col("name").alias(image)).distinct(), image, "left_semi")
    flags = [F.lower(text).contains(c.lower()).cast("int").alias(c) for c in classes]
    return kept.select(F.concat_ws("/", F.lit(folder), image).alias("path"), *[c for c in labels.columns if c not in (image, text)], *flags)


def study_time(value: Column) -> Column:
    """Whole part of the number, six digits; other text unchanged."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.lpad(number.cast("bigint").cast("string"), 6, "0")).otherwise(value)


def image_path(root: str, subject: Column, study: Column, image: Column) -> Column:
    person = F.concat(F.lit("p"), subject)
    return F.concat_ws("/", F.lit(root), F.lit("files"), F.substring(person, 1, 3), person, F.concat(F.lit("s"), study), F.concat(image, F.lit(".jpg")))


# Record markers of the privacy corpus.
RECORD = r"START_OF_RECORD=(\d+)\|\|\|\|(\d+)\|\|\|\|([\s\S]*?)(?=\|\|\|\|END_OF_RECORD|START_OF_RECORD=|$)"


#: What stands before and after each record of the privacy corpus.
RECORD_START, RECORD_END = "START_OF_RECORD=", "||||END_OF_RECORD"


def split_records(texts: DataFrame, column: str = "value", pattern: str = RECORD) -> DataFrame:
    """Marked text to (patient_id, note_id, text).

    The standard markers are found by cutting at them; another pattern is searched for as it is.
    """
    if pattern == RECORD:
        pieces = texts.select(F.posexplode(F.split(column, RECORD_START)).alias("pos", "record")).where("pos > 0")
        parts = pieces.select(F.split("record", r"\|\|\|\|", 3).alias("p")).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("patient_id", "note_id", "rest"))])
        marked = parts.where(F.col("rest").isNotNull() & F.col("patient_id").rlike(r"\A\d+\z") & F.col("note_id").rlike(r"\A\d+\z"))
        return marked.select("patient_id", "note_id", F.trim(F.substring_index("rest", RECORD_END, 1), F.lit(" \n\t\r")).alias("text"))
    rows = texts.select(F.posexplode(F.regexp_extract_all(column, F.lit(pattern), 0)).alias("pos", "record"))
    part = lambda i: F.regexp_extract("record", pattern, i)
    return rows.select(part(1).alias("patient_id"), part(2).alias("note_id"), F.trim(part(3), F.lit(" \n\t\r")).alias("text"))


def records_source(spark: SparkSession, path: str) -> DataFrame:
    """Files of marked records as (patient_id, note_id, text); files are cut at record ends, so one file may hold any share of the rows."""
    return split_records(spark.read.option("lineSep", RECORD_END).text(path))


def sample_sink(samples: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    samples.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def csv_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def hourly_melt(wide: DataFrame, ids: Sequence[str], cells: Mapping[str, tuple[str, str]], intime: str, hours: str) -> DataFrame:
    """Hourly wide table to one row per (ids, hour, variable) with mean, count and std.

    `cells` maps a column to (variable, statistic).  Null cells and zero counts go; time = entry rounded up to the hour + hours.
    """
    long = wide.select(*ids, hours, intime, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(s).alias("stat"), F.col(c).cast("double").alias("value")) for c, (v, s) in cells.items()
    ])).alias("c")).select(*ids, hours, intime, "c.*")
    kept = long.where(F.col("value").isNotNull() & ~((F.col("stat") == "count") & (F.col("value") == 0.0))).distinct()
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s)
    rows = kept.groupBy(*ids, hours, intime, "variable").agg(pick("mean"), pick("count"), pick("std"))
    trunc = F.date_trunc("hour", intime)
    start = F.when(trunc == F.col(intime), trunc).otherwise(trunc + F.expr("INTERVAL 1 HOUR"))
    return rows.withColumn("timestamp", start + F.make_dt_interval(hours=F.col(hours).cast("int")))


def json_ledger(spark: SparkSession, path: str, schema: T.StructType | str, key: str, order: str) -> DataFrame:
    """JSON lines, latest entry per key; lines that do not parse are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", F.col(f"r.{order}")).alias("r")).select("r.*")


def relaxed_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Vertical union by name; columns whose types differ become double when all are numbers, else text."""
    names = parts[0].columns
    targets = {}
    for n in names:
        types = {p.schema[n].dataType for p in parts}
        if len(types) > 1:
            targets[n] = "double" if all(isinstance(t, T.NumericType) for t in types) else "string"
    cast = lambda p: p.select(*[F.col(n).cast(targets[n]).alias(n) if n in targets else F.col(n) for n in names])
    out = cast(parts[0])
    for p in parts[1:]:
        out = out.unionByName(cast(p))
    return out

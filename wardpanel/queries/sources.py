"""File sources, event store and event filters.  Files are written from the given tables into a fresh scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.plans import jobs
from wardpanel.queries.registry import query, r, table, tidy
from wardpanel.sources import prepare as pr
from wardpanel.sources import tables as tb
from wardpanel.sources.tables import JoinConfig, TableConfig


def as_csv(spark, df, name="t.csv", sep=",", gz=False):
    """Write a frame as a delimited folder and return its path."""
    path = f"{tb.scratch(spark, 'csv')}/{name}"
    out = df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    (out.option("compression", "gzip") if gz else out).csv(path)
    return path


def text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("source_scan_delimited", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents")
def scan_delimited(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("DOC_ID"), "text", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("Lang"))
    return tb.scan_delimited(spark, as_csv(spark, d, "notes.csv"))


@query("source_scan_inferred", "SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def scan_inferred(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    return tb.scan_inferred(spark, as_csv(spark, p, "p.tsv", "\t", True), {"p_partkey": "bigint", "p_size": "int", "price": "double"})


@query("source_resolve_path", "SELECT n_nationkey, n_name FROM nation")
def resolve_path(spark, sf):
    path = as_csv(spark, table(spark, sf, "nation"), "nation.tsv", "\t")
    found = tb.resolve_path(spark, path.removesuffix(".tsv") + ".csv")
    return tb.scan_delimited(spark, found).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


# ---- an event store over orders, line items and customers -----------------------------------------

ORDERS = TableConfig("admissions", "orders", "o_custkey", "o_orderdate", ("o_orderkey", "o_orderstatus", "o_totalprice"), joins=())
LINES = TableConfig("prescriptions", "lineitem", "o_custkey", "o_orderdate", ("l_orderkey", "l_partkey", "l_quantity", "p_name"),
                    joins=(JoinConfig("orders", "o_orderkey", "inner", ("o_custkey", "o_orderdate")), JoinConfig("part", "p_partkey", "left", ("p_name",))),
                    preprocess=lambda df: df.withColumns({"o_orderkey": F.col("l_orderkey"), "p_partkey": F.col("l_partkey")}))
PEOPLE = TableConfig("patients", "customer", "c_custkey", None, ("c_mktsegment", "c_name"))


def reader(spark, sf):
    return lambda name: text(table(spark, sf, name))


def events(spark, sf):
    return tb.load_events(spark, sf, [ORDERS, LINES, PEOPLE], reader(spark, sf))


EVENTS = """
WITH ev AS (
  SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'admissions' AS event_type, o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS a_key, o_orderstatus AS a_status, o_totalprice AS a_price,
    NULL AS p_key, NULL::DOUBLE AS p_qty, NULL AS p_name, NULL AS c_seg FROM orders
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'prescriptions', o_orderdate, NULL, NULL, NULL, CAST(l_orderkey AS VARCHAR), l_quantity, p_name, NULL
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'patients', NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_mktsegment FROM customer)
"""


@query("source_load_table", """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'prescriptions' AS event_type, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS time, CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_quantity AS BIGINT) AS quantity, p_name AS name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def load_table(spark, sf):
    t = tb.load_table(spark, sf, LINES, reader(spark, sf))
    return t.select("patient_id", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("`prescriptions/l_orderkey`").alias("order_key"),
                    F.col("`prescriptions/l_quantity`").cast("double").cast("bigint").alias("quantity"), F.col("`prescriptions/p_name`").alias("name"))


@query("source_load_table_parts", """SELECT 'x' || CAST(user_id AS VARCHAR) AS patient_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time, event_type AS kind FROM events""")
def load_table_parts(spark, sf):
    cfg = TableConfig("metadata", "events", "pid", ("studydate", "studytime"), ("event_type",), "%Y%m%d%H%M%S")
    scan = lambda name: table(spark, sf, name).select(F.concat(F.lit("x"), "user_id").alias("pid"), F.date_format("ts", "yyyyMMdd").alias("studydate"), F.date_format("ts", "HHmmss").alias("studytime"), "event_type")
    t = tb.load_table(spark, sf, cfg, scan)
    return t.select("patient_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("`metadata/event_type`").alias("kind"))


@query("source_row_index", "SELECT count(*) AS rows, CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high, count(DISTINCT n) AS distinct_rows FROM (SELECT row_number() OVER () - 1 AS n FROM documents)")
def row_index(spark, sf):
    cfg = TableConfig("notes", "documents", None, None, ("doc_id",))
    t = tb.load_table(spark, sf, cfg, reader(spark, sf)).select(F.col("patient_id").cast("bigint").alias("n"))
    return t.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.countDistinct("n").alias("distinct_rows"))


@query("source_union_events", f"{EVENTS} SELECT event_type, count(*) AS n, count(ts) AS timed, count(a_key) AS admissions, count(p_key) AS prescriptions, count(c_seg) AS patients FROM ev GROUP BY 1")
def union_events(spark, sf):
    n = lambda c, a: F.count(f"`{c}`").alias(a)
    return events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("timed"), n("admissions/o_orderkey", "admissions"), n("prescriptions/l_orderkey", "prescriptions"), n("patients/c_mktsegment", "patients"))


@query("source_event_store", f"{EVENTS} SELECT patient_id, count(*) AS n, sum(coalesce(p_qty, 0)) AS quantity FROM ev GROUP BY 1")
def event_store(spark, sf):
    folder = tb.scratch(spark, "store")
    key = tb.store_key(sf, ["admissions", "prescriptions", "patients"], "orders")
    tb.cached_store(spark, folder, key, lambda: events(spark, sf))
    stored = tb.cached_store(spark, folder, key, lambda: events(spark, sf))
    return stored.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("`prescriptions/l_quantity`").cast("double"), F.lit(0.0))).alias("quantity"))


@query("source_dev_subset", f"{EVENTS} SELECT patient_id, count(*) AS n FROM ev SEMI JOIN (SELECT DISTINCT patient_id FROM ev ORDER BY 1 LIMIT 1000) USING (patient_id) GROUP BY 1")
def dev_subset(spark, sf):
    return tb.dev_subset(events(spark, sf), 1000).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query("source_triples", "SELECT CAST(l_suppkey AS VARCHAR) AS head, 'supplies' AS relation, CAST(l_partkey AS VARCHAR) AS tail, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def triples(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_node"), F.lit("supplies").alias("edge"), F.col("l_partkey").alias("to_node"), "l_quantity")
    return pr.triples_source(spark, as_csv(spark, t, "t.tsv", "\t")).groupBy("head", "relation", "tail").agg(F.count(F.lit(1)).alias("n"))


@query("source_factor_library", """SELECT 'f' || p_partkey AS factor_id, CASE WHEN p_size % 5 = 0 THEN 'f' || p_partkey ELSE p_name END AS factor_name, p_type AS factor_expression FROM part WHERE p_size % 7 <> 0 AND p_brand = 'Brand#2' ORDER BY 1 LIMIT 50""")
def factor_library(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("factor_name"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("factor_expression"), F.col("p_brand").alias("quality"))
    entry = F.struct("factor_name", "factor_expression", "quality")
    path = tb.scratch(spark, "library")
    p.select(F.to_json(F.struct(F.create_map("id", entry).alias("factors"))).alias("value")).write.text(path)
    return pr.factor_library_source(spark, path, "Brand#2", 50, lines=True).select("factor_id", "factor_name", "factor_expression")


@query("source_factor_upsert", """WITH n AS (SELECT substr(md5(p_name || '_' || p_type), 1, 16) AS factor_id, p_name AS factor_name, p_type AS factor_expression, max(p_partkey) AS seq FROM part GROUP BY 1, 2, 3),
old AS (SELECT factor_id, 'old' AS note FROM n WHERE factor_expression IN ('SMALL', 'PROMO') UNION ALL SELECT substr(md5(c_name), 1, 16), 'kept' FROM customer)
SELECT factor_id, note, NULL AS factor_name, CAST(NULL AS DOUBLE) AS part FROM old ANTI JOIN n USING (factor_id) UNION ALL SELECT factor_id, NULL, factor_name, CAST(seq AS DOUBLE) FROM n""")
def factor_upsert(spark, sf):
    p = table(spark, sf, "part")
    new = p.select(F.col("p_name").alias("factor_name"), F.col("p_type").alias("factor_expression"), F.col("p_partkey").alias("part"), F.col("p_partkey").alias("seq"))
    replaced = p.where(F.col("p_type").isin("SMALL", "PROMO")).select(pr.factor_id(F.col("p_name"), F.col("p_type")).alias("factor_id")).distinct().withColumn("note", F.lit("old"))
    kept = table(spark, sf, "customer").select(F.substring(F.md5(F.col("c_name").cast("binary")), 1, 16).alias("factor_id"), F.lit("kept").alias("note"))
    out = pr.upsert_factors(replaced.unionByName(kept), new)
    return out.select("factor_id", "note", "factor_name", F.col("part").cast("double").alias("part"))


@query("source_prepare_variants", "SELECT p_name AS gene_symbol, p_type AS clinical_significance, p_size AS position, 'GRCh38' AS assembly FROM part WHERE p_brand < 'Brand#2'")
def prepare_variants(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_name").alias("GeneSymbol"), F.col("p_type").alias("ClinicalSignificance"), F.col("p_size").alias("PositionVCF"), F.when(F.col("p_brand") < "Brand#2", "GRCh38").otherwise("GRCh37").alias("Assembly"))
    out = pr.prepare_variants(tb.scan_delimited(spark, as_csv(spark, raw, "v.tsv", "\t"), multiline=False))
    return out.withColumn("position", F.col("position").cast("int"))


@query("source_prepare_mutations", "SELECT count(DISTINCT n) AS samples, count(*) AS rows, count(DISTINCT p_name) AS genes FROM (SELECT row_number() OVER () AS n, p_name FROM part)")
def prepare_mutations(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_name").alias("Gene name"), F.col("p_type").alias("Primary site"))
    out = pr.prepare_mutations(tb.scan_delimited(spark, as_csv(spark, raw, "m.csv"), multiline=False))
    return out.agg(F.countDistinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("rows"), F.countDistinct("gene_name").alias("genes"))


@query("source_prepare_tumour_mutations", "SELECT substr(c_name, 1, 12) AS patient_id, c_mktsegment AS hugo_symbol, count(*) AS n FROM customer GROUP BY 1, 2")
def prepare_tumour(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_name").alias("Tumor_Sample_Barcode"), F.col("c_mktsegment").alias("Hugo_Symbol"))
    out = pr.prepare_tumour_mutations(tb.scan_delimited(spark, as_csv(spark, raw, "x.tsv", "\t"), multiline=False, comment="#").toDF("tumor_sample_barcode", "hugo_symbol"))
    return out.groupBy("patient_id", "hugo_symbol").agg(F.count(F.lit(1)).alias("n"))


@query("source_prepare_tumour_clinical", "SELECT patient_id, arg_min(o_orderstatus, o_orderkey) AS vital_status, CAST(arg_min(o_orderkey, o_orderkey) AS VARCHAR) AS tumor_stage FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS patient_id FROM orders) GROUP BY 1")
def prepare_clinical(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("submitter_id"), F.col("o_orderstatus").alias("vital_status"), F.col("o_orderkey").cast("string").alias("pathologic_stage"), "o_orderkey")
    return pr.prepare_tumour_clinical(raw, ["o_orderkey"]).select("patient_id", "vital_status", "tumor_stage")


@query("source_image_paths", """SELECT 'root/files/' || substr('p' || o_custkey, 1, 3) || '/p' || o_custkey || '/s' || o_orderkey || '/' || o_orderpriority || '.jpg' AS path,
CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS VARCHAR), 6, '0') END AS study_time FROM orders""")
def image_paths(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", "late").otherwise(((F.floor("o_totalprice") % 100000) + F.lit(0.25)).cast("string"))
    return o.select(pr.image_path("root", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("path"), pr.study_time(raw).alias("study_time"))


@query("source_image_files", "SELECT DISTINCT source AS name, count(*) AS n FROM documents GROUP BY 1")
def image_files(spark, sf):
    d = table(spark, sf, "documents")
    path = tb.scratch(spark, "files")
    d.select("source", "doc_id").write.partitionBy("source").csv(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("name")).distinct()
    return listed.join(d.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")), "name")


@query("source_image_names", "SELECT count(DISTINCT source) AS files, 'csv' AS ending FROM documents")
def image_names(spark, sf):
    """One file per source is written; their names are listed without reading them."""
    path = tb.scratch(spark, "named")
    table(spark, sf, "documents").select("source", "doc_id").repartition("source").write.partitionBy("source").csv(path)
    return pr.image_files(spark, path).groupBy(F.element_at(F.split("name", "[.]"), -1).alias("ending")).agg(F.count(F.lit(1)).alias("files"))


@query("source_split_records", "SELECT CAST(doc_id % 97 AS VARCHAR) AS patient_id, CAST(doc_id AS VARCHAR) AS note_id, trim(text, E' \\n\\t\\r') AS text FROM documents")
def split_records(spark, sf):
    d = table(spark, sf, "documents")
    marked = F.concat(F.lit("START_OF_RECORD="), (F.col("doc_id") % 97).cast("string"), F.lit("||||"), F.col("doc_id").cast("string"), F.lit("||||\n"), F.col("text"), F.lit("\n"))
    path = tb.scratch(spark, "records")
    d.select(marked.alias("value")).write.option("lineSep", pr.RECORD_END + "\n\n").text(path)
    return pr.records_source(spark, path)


@query("source_sample_sink", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def sample_sink(spark, sf):
    path = tb.scratch(spark, "samples")
    pr.sample_sink(table(spark, sf, "documents"), path, 100)
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("source_csv_sink", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def csv_sink(spark, sf):
    path = tb.scratch(spark, "sink") + "/s.csv"
    pr.csv_sink(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    return tb.scan_delimited(spark, path)


@query("source_hourly_melt", """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey, min(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'price' AS variable, m AS mean, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 3 AS DOUBLE) END AS cnt, CASE WHEN l_quantity > 10 THEN l_quantity END AS std FROM w
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'supp', CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS DOUBLE) END, NULL, NULL FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, variable, round(mean, 2) AS mean, cnt AS count, std, strftime(date_trunc('hour', o_orderdate + INTERVAL 30 MINUTE) + INTERVAL 1 HOUR + to_hours(l_linenumber), '%Y-%m-%d %H:%M') AS time
FROM x JOIN orders ON l_orderkey = o_orderkey WHERE mean IS NOT NULL OR cnt IS NOT NULL OR std IS NOT NULL""")
def hourly_melt(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").agg(F.min("l_extendedprice").alias("p_mean"))
    w = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 MINUTE")).alias("intime"), "p_mean",
        (F.col("l_partkey") % 3).alias("p_count"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("p_std"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("s_mean"))
    cells = {"p_mean": ("price", "mean"), "p_count": ("price", "count"), "p_std": ("price", "std"), "s_mean": ("supp", "mean")}
    out = pr.hourly_melt(w, ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"], cells, "intime", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "variable", F.round("mean", 2).alias("mean"), "count", "std", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("time"))


# ---- event filters --------------------------------------------------------------------------------


@query("events_get", f"""{EVENTS} SELECT patient_id, a_key, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE event_type = 'admissions' AND ts BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-08-31' AND a_status <> 'P' AND a_key >= '2'""")
def get_events(spark, sf):
    out = tb.get_events(events(spark, sf), "admissions", "1996-03-01 00:00:00", "1998-08-31 00:00:00", [("o_orderstatus", "!=", "P"), ("o_orderkey", ">=", "2")])
    return out.select("patient_id", F.col("`admissions/o_orderkey`").alias("a_key"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("events_keep_sources", f"{EVENTS} SELECT event_type, count(*) AS n FROM ev WHERE event_type <> 'admissions' OR a_status IN ('F', 'O') GROUP BY 1")
def keep_sources(spark, sf):
    return tb.keep_sources(events(spark, sf), "admissions", "o_orderstatus", ["F", "O"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("events_patients_having", f"{EVENTS} SELECT event_type, count(*) AS n, count(DISTINCT patient_id) AS patients FROM ev WHERE patient_id IN (SELECT patient_id FROM ev WHERE event_type = 'prescriptions') GROUP BY 1")
def patients_having(spark, sf):
    return tb.patients_having(events(spark, sf), "prescriptions").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("patients"))


@query("events_any_over_patient", f"{EVENTS} SELECT patient_id, count(*) AS n FROM ev WHERE patient_id IN (SELECT patient_id FROM ev WHERE starts_with(p_name, 'red') OR p_name IN ('hot gear')) GROUP BY 1")
def any_over_patient(spark, sf):
    name = F.col("`prescriptions/p_name`")
    return tb.patients_with_any(events(spark, sf), F.startswith(name, F.lit("red")) | name.isin("hot gear")).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query("events_stats", f"{EVENTS} SELECT count(*) AS events, count(DISTINCT patient_id) AS patients FROM ev")
def stats(spark, sf):
    return tb.event_stats(events(spark, sf))


@query("events_first_last", f"{EVENTS} SELECT patient_id, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(ts) AS timed FROM ev GROUP BY 1")
def user_function(spark, sf):
    """The per-patient user function over the whole event table."""
    import pandas as pd

    def task(pid, chunks):
        first, last, timed = None, None, 0
        for pdf in chunks:
            t = pdf["timestamp"].dropna()
            if len(t):
                first, last, timed = first if first is not None else t.iloc[0], t.iloc[-1], timed + len(t)
        day = lambda v: None if v is None else v.strftime("%Y-%m-%d")
        yield pd.DataFrame({"patient_id": [pid], "first_day": [day(first)], "last_day": [day(last)], "timed": [timed]})

    return tb.by_patient(events(spark, sf).select("patient_id", "timestamp"), task, "patient_id string, first_day string, last_day string, timed bigint")


@query("events_chart_time", "SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS charttime FROM events")
def chart_time(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("chartdate"), F.when(F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("charttime"))
    return tb.fill_chart_time(e).select("event_id", "charttime")


@query("events_birth_time", """SELECT c_custkey, concat(1930 + c_custkey % 70, '-', CASE WHEN c_custkey % 5 = 0 THEN '01' ELSE lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') END, '-', CASE WHEN c_custkey % 3 = 0 THEN '01' ELSE lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END, ' 00:00:00') AS birth_datetime FROM customer""")
def birth_time(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, (1930 + k % 70).alias("year_of_birth"), F.when(k % 5 != 0, k % 12 + 1).alias("month_of_birth"), F.when(k % 3 != 0, k % 28 + 1).alias("day_of_birth"))
    return tb.birth_time(c).select("c_custkey", "birth_datetime")


@query("events_two_format_date", "SELECT event_id, strftime(CASE WHEN event_type = 'click' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def two_formats(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("raw"))
    return e.select("event_id", F.date_format(jobs.parse_two(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("events_hours_since_previous", f"""WITH p AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) AS t, epoch(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS b FROM orders)
SELECT o_orderkey, {r('coalesce((t - b) / 3600, 0)', 'gap_hours')} FROM p""")
def hours_since_previous(spark, sf):
    from wardpanel.operators.order import neighbour

    o = table(spark, sf, "orders")
    out = neighbour(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"prev": F.col("o_orderdate")}, -1)
    gap = F.coalesce(jobs.hours_between(F.col("prev"), F.col("o_orderdate")), F.lit(0.0))
    return tidy(out.withColumn("gap_hours", gap), ["o_orderkey"], ["gap_hours"])

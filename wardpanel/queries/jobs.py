"""Cohort and label jobs: customers act as patients, orders as visits, line items as codes and labs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.functions import codes as cd
from wardpanel.operators.stay import group_text
from wardpanel.plans import jobs
from wardpanel.queries.registry import query, r, table, tidy
from wardpanel.sources.tables import scratch

SEQ = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
LINE = ["l_orderkey", "l_partkey", *[c for c in SEQ if c != "l_partkey"], "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
BY_SEQ = "ORDER BY " + ", ".join(SEQ)
DX = "CASE p_size % 10 WHEN 0 THEN '250.1' || CAST(p_partkey % 4 AS STRING) WHEN 1 THEN 'E10.' || CAST(p_partkey % 3 AS STRING) ELSE p_brand END"
KIND = "CASE l_returnflag WHEN 'A' THEN 'conditions' WHEN 'N' THEN 'procedures' ELSE 'drugs' END"
CODE = f"CASE l_returnflag WHEN 'A' THEN {DX} WHEN 'N' THEN p_type ELSE CASE WHEN l_tax = 0 THEN '0' ELSE p_name END END"
DIED = "CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE 'unknown' END"


def visits(spark, sf, ends=True):
    """Orders as visits; without `ends` the lines are not read, and `end` is null."""
    o = table(spark, sf, "orders")
    if ends:
        hours = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("h"))
        o = o.join(hours, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    start = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("visit_id"), start.alias("start"),
        (start + F.make_dt_interval(hours=F.coalesce("h", F.lit(0))) if ends else F.lit(None).cast("timestamp")).alias("end"), F.expr(DIED).alias("died"),
        F.date_add(F.lit("1960-03-15").cast("date"), F.pmod(F.col("o_custkey") * 37, F.lit(9000)).cast("int")).alias("birth"),
        F.floor(F.col("o_totalprice") / 60000).alias("hospital_stay"), F.dayofmonth("o_orderdate").alias("unit_visit"),
        F.when(F.col("o_orderkey") % 7 == 0, "> 89").otherwise((F.col("o_orderkey") % 90).cast("string")).alias("age"),
        F.pmod(F.col("o_orderkey"), F.lit(20000)).alias("unit_minutes"),
        jobs.identifiers(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("identifiers"),
    )


def lines(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf, "part")
    li = table(spark, sf, "lineitem")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def lines_once(spark, sf):
    """The joined lines as a scratch table, for jobs that read them several times."""
    path = scratch(spark, "lines")
    lines(spark, sf).select("o_custkey", "o_orderdate", *LINE, "p_partkey", "p_name", "p_brand", "p_type", "p_size").write.parquet(path)
    return spark.read.parquet(path)


def _hours(c):
    return F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=c.cast("int"))


def codes(spark, sf, ln=None):
    return (ln or lines(spark, sf)).select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("l_orderkey").cast("string").alias("visit_id"), F.expr(KIND).alias("kind"),
        F.expr(CODE).alias("code"), F.struct(*SEQ).alias("seq"), _hours(F.col("l_quantity") * 2).alias("time"),
        F.expr("CASE WHEN p_size % 10 = 1 THEN '10' ELSE '9' END").alias("version"),
    )


def labs(spark, sf, ln=None):
    item = F.element_at(F.array(*[F.lit(i) for i in [*cd.LAB_ITEMS, "other", "none"]]), (F.pmod(F.col("l_partkey"), F.lit(29)) + 1).cast("int"))
    return (ln or lines(spark, sf)).select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("l_orderkey").cast("string").alias("visit_id"), _hours(F.col("l_linenumber") * 10).alias("time"),
        _hours(F.col("l_linenumber") * 10 + F.col("l_quantity") / 2).alias("stored"), item.alias("item"), F.col("l_quantity").alias("value"), F.struct(*SEQ).alias("seq"),
    )


ITEMS = "[" + ", ".join(f"'{i}'" for i in [*cd.LAB_ITEMS, "other", "none"]) + "]"
EHR = f"""
WITH q AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS h FROM lineitem GROUP BY 1),
v AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS visit_id, o_orderdate AS st, o_orderdate + to_hours(coalesce(h, 0)) AS en, {DIED} AS died,
  DATE '1960-03-15' + CAST(o_custkey * 37 % 9000 AS INTEGER) AS birth, CAST(floor(o_totalprice / 60000) AS BIGINT) AS hstay, day(o_orderdate) AS uv, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 90 END AS age,
  o_orderkey % 20000 AS mins, o_orderpriority || '+' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS ids FROM orders LEFT JOIN q ON o_orderkey = l_orderkey),
l AS (SELECT *, {KIND} AS kind, {CODE} AS code, o_orderdate + to_hours(CAST(l_quantity * 2 AS BIGINT)) AS tm, CASE WHEN p_size % 10 = 1 THEN '10' ELSE '9' END AS ver, CAST(l_orderkey AS VARCHAR) AS visit_id, CAST(o_custkey AS VARCHAR) AS patient_id,
  {ITEMS}[l_partkey % 29 + 1] AS item, o_orderdate + to_hours(l_linenumber * 10) AS lt, o_orderdate + to_hours(CAST(floor(l_linenumber * 10 + l_quantity / 2) AS BIGINT)) AS stored
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
lists AS (SELECT visit_id, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'conditions') AS conditions, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'procedures') AS procedures,
  string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'drugs') AS drugs FROM l GROUP BY 1),
full_ AS (SELECT * FROM lists WHERE conditions IS NOT NULL AND procedures IS NOT NULL AND drugs IS NOT NULL),
nx AS (SELECT *, lead(st) OVER w AS nst, lead(died) OVER w AS ndied, lead(visit_id) OVER w AS nvis FROM v WINDOW w AS (PARTITION BY patient_id ORDER BY st, visit_id))
"""
LOS = "CAST(CASE WHEN {d} < 1 THEN 0 WHEN {d} <= 7 THEN {d} WHEN {d} <= 14 THEN 8 ELSE 9 END AS INTEGER)"
K3 = "conditions, procedures, drugs"
ADULT = "(year(st) - year(birth) - CASE WHEN month(st) * 100 + day(st) < month(birth) * 100 + day(birth) THEN 1 ELSE 0 END >= 18)"


def joined(df, names=jobs.KINDS, extra=()):
    return df.select("patient_id", "visit_id", *[F.array_join(n, ",").alias(n) for n in names], *extra)


def adult():
    return jobs.whole_years(F.col("birth"), F.col("start")) >= 18


DAYS = "floor((epoch(en) - epoch(st)) / 86400)"


@query("job_length_of_stay", f"{EHR} SELECT patient_id, visit_id, {K3}, {LOS.format(d=DAYS)} AS los FROM v JOIN full_ USING (visit_id)")
def length_of_stay(spark, sf):
    return joined(jobs.length_of_stay(visits(spark, sf), codes(spark, sf)), extra=["los"])


@query("job_length_of_stay_minutes", f"{EHR} SELECT patient_id, visit_id, {K3}, {LOS.format(d='mins // 1440')} AS los FROM v JOIN full_ USING (visit_id)")
def length_of_stay_minutes(spark, sf):
    return joined(jobs.length_of_stay_minutes(visits(spark, sf), codes(spark, sf)), extra=["los"])


@query("job_readmission", f"""{EHR} SELECT patient_id, visit_id, {K3}, CAST(epoch(nst) - epoch(en) < 15 * 86400 AS INTEGER) AS readmission FROM nx JOIN full_ USING (visit_id) WHERE nvis IS NOT NULL AND {ADULT}""")
def readmission(spark, sf):
    return joined(jobs.readmission(visits(spark, sf), codes(spark, sf), 15, adult()), extra=["readmission"])


@query("job_readmission_same_hospital", f"""{EHR}, n2 AS (SELECT *, lead(hstay) OVER w AS nh FROM v WINDOW w AS (PARTITION BY patient_id ORDER BY hstay, uv, visit_id))
SELECT patient_id, visit_id, {K3}, CAST(hstay = nh AS INTEGER) AS readmission FROM n2 JOIN full_ USING (visit_id) WHERE nh IS NOT NULL AND (age IS NULL OR age >= 18)""")
def readmission_same_hospital(spark, sf):
    return joined(jobs.readmission_same_hospital(visits(spark, sf), codes(spark, sf)), extra=["readmission"])


MORT = "CAST(CASE WHEN ndied = '1' THEN 1 ELSE 0 END AS INTEGER) AS mortality"


@query("job_mortality_next", f"{EHR} SELECT patient_id, visit_id, {K3}, {MORT} FROM nx JOIN full_ USING (visit_id) WHERE nvis IS NOT NULL")
def mortality_next(spark, sf):
    return joined(jobs.mortality_next(visits(spark, sf), codes(spark, sf)), extra=["mortality"])


@query("job_mortality_stay_variant", f"""{EHR}, d AS (SELECT visit_id, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'conditions') AS conditions, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'procedures') AS procedures
  FROM (SELECT *, row_number() OVER (PARTITION BY visit_id, kind, code {BY_SEQ}) AS rn FROM l) WHERE rn = 1 GROUP BY 1), n2 AS (SELECT *, lead(died) OVER w AS nd, lead(visit_id) OVER w AS nv FROM v WINDOW w AS (PARTITION BY patient_id ORDER BY hstay, uv, visit_id))
SELECT patient_id, visit_id, conditions, procedures, CAST(CASE WHEN nd = '1' THEN 1 ELSE 0 END AS INTEGER) AS mortality FROM n2 JOIN d USING (visit_id) WHERE nv IS NOT NULL AND conditions IS NOT NULL AND procedures IS NOT NULL""")
def mortality_variant(spark, sf):
    kinds = ("conditions", "procedures")
    out = jobs.mortality_next(visits(spark, sf), codes(spark, sf), ["hospital_stay", "unit_visit", "visit_id"], kinds, distinct=True)
    return joined(out, kinds, ["mortality"])


@query("job_mortality_by_time", f"""{EHR}, ins AS (SELECT nx.visit_id, kind, code, {', '.join(SEQ)} FROM nx JOIN l ON nx.patient_id = l.patient_id AND l.tm BETWEEN nx.st AND nx.en WHERE nvis IS NOT NULL AND {ADULT} AND trim(code) <> ''),
li2 AS (SELECT visit_id, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'conditions') AS conditions, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'procedures') AS procedures, string_agg(code, ',' {BY_SEQ}) FILTER (WHERE kind = 'drugs') AS drugs FROM ins GROUP BY 1)
SELECT patient_id, visit_id, {K3}, {MORT} FROM nx JOIN li2 USING (visit_id) WHERE conditions IS NOT NULL AND procedures IS NOT NULL AND drugs IS NOT NULL""")
def mortality_by_time(spark, sf):
    return joined(jobs.mortality_next_by_time(visits(spark, sf), codes(spark, sf), adult()), extra=["mortality"])


@query("job_mortality_any_death", f"""{EHR} SELECT patient_id, visit_id, coalesce(conditions, '') AS conditions, coalesce(procedures, '') AS procedures, coalesce(drugs, '') AS drugs,
CAST(patient_id IN (SELECT patient_id FROM v WHERE died = '1' AND hstay > 7) AS INTEGER) AS mortality FROM nx JOIN lists USING (visit_id) WHERE nvis IS NOT NULL""")
def mortality_any_death(spark, sf):
    v = visits(spark, sf)
    return joined(jobs.mortality_any_death(v, codes(spark, sf), v.where("died = '1' and hospital_stay > 7")), extra=["mortality"])


def notes(spark, sf, ln=None):
    """Line texts as visit notes, in two kinds."""
    return (ln or lines(spark, sf)).select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("l_orderkey").cast("string").alias("visit_id"), F.struct(*SEQ).alias("seq"),
        F.concat_ws(" ", "p_name", "p_type").alias("text"), F.when(F.col("l_linestatus") == "F", "discharge").otherwise("radiology").alias("kind"))


@query("job_mortality_with_notes", f"""{EHR}, nt AS (SELECT visit_id, string_agg(p_name || ' ' || p_type, '' {BY_SEQ}) AS clinical_notes FROM l GROUP BY 1)
SELECT patient_id, visit_id, coalesce(conditions, '') AS conditions, coalesce(procedures, '') AS procedures, coalesce(drugs, '') AS drugs, coalesce(clinical_notes, '') AS clinical_notes, {MORT}
FROM nx LEFT JOIN lists USING (visit_id) LEFT JOIN nt USING (visit_id) WHERE nvis IS NOT NULL""")
def mortality_with_notes(spark, sf):
    out = jobs.mortality_with_notes(visits(spark, sf), codes(spark, sf), notes(spark, sf))
    return joined(out, extra=["clinical_notes", "mortality"])


@query("job_medical_coding", f"""{EHR} SELECT patient_id, visit_id, string_agg(' ' || p_name || ' ' || p_type, '' {BY_SEQ}) AS text, array_to_string(list_sort(list(DISTINCT code) FILTER (WHERE kind <> 'drugs')), ',') AS codes
FROM l GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind <> 'drugs') > 0""")
def medical_coding(spark, sf):
    out = jobs.medical_coding(notes(spark, sf), codes(spark, sf).where("kind <> 'drugs'"))
    return out.select("patient_id", "visit_id", "text", F.array_join("codes", ",").alias("codes"))


LAB_IN = f"SELECT v.visit_id, v.patient_id, v.died, v.st, l.lt, l.item, l.l_quantity AS val, {', '.join(SEQ)} FROM v JOIN l ON v.patient_id = l.patient_id"
FIRST_ITEM = lambda i: f"arg_min(val, row({', '.join(SEQ)})) FILTER (WHERE item = '{i}')"
SHOW = lambda e: f"coalesce(CAST(CAST({e} AS BIGINT) AS VARCHAR), '-')"


@query("job_in_hospital_mortality", f"""{EHR}, ins AS ({LAB_IN} AND l.lt BETWEEN v.st AND v.st + INTERVAL 48 HOUR AND l.stored <= v.st + INTERVAL 48 HOUR WHERE epoch(v.en) - epoch(v.st) > 48 * 3600 AND item NOT IN ('other', 'none')),
p AS (SELECT patient_id, visit_id, died, lt, concat_ws('/', {', '.join(SHOW(FIRST_ITEM(i)) for i in cd.LAB_ITEMS)}) AS vec FROM ins GROUP BY 1, 2, 3, 4)
SELECT patient_id, visit_id, string_agg(vec, ';' ORDER BY lt) AS labs, CAST(died = '1' AS INTEGER) AS mortality FROM p GROUP BY 1, 2, died""")
def in_hospital_mortality(spark, sf):
    v = visits(spark, sf).withColumn("died", (F.col("died") == "1").cast("int"))
    out = jobs.in_hospital_mortality(v, labs(spark, sf))
    text = F.array_join(F.transform("labs", lambda x: F.array_join(F.transform(x["values"], lambda c: F.coalesce(c.cast("bigint").cast("string"), F.lit("-"))), "/")), ";")
    return out.select("patient_id", "visit_id", text.alias("labs"), "mortality")


def cat_first(items):
    return "coalesce(" + ", ".join(FIRST_ITEM(i) for i in items) + ")"


VEC = "concat_ws('/', " + ", ".join(SHOW(cat_first(items)) for items in cd.LAB_CATEGORIES.values()) + ")"
SEQS = f"""{EHR}, ok AS (SELECT * FROM v WHERE {ADULT} AND en >= st),
g AS (SELECT *, coalesce((epoch(st) - epoch(lag(st) OVER (PARTITION BY patient_id ORDER BY st, visit_id))) / 3600, 0) AS gap FROM ok),
dp AS (SELECT visit_id, string_agg(code, ',' ORDER BY kind, {', '.join(SEQ)}) AS codes FROM l WHERE kind <> 'drugs' GROUP BY 1),
icd AS (SELECT patient_id, string_agg(CAST(CAST(gap AS BIGINT) AS VARCHAR) || ':' || codes, ';' ORDER BY st, visit_id) AS icd_codes FROM g JOIN dp USING (visit_id) GROUP BY 1),
ins AS (SELECT v.visit_id, v.patient_id, v.st, l.lt, l.item, l.l_quantity AS val, {', '.join(SEQ)} FROM ok v JOIN l ON v.patient_id = l.patient_id AND l.lt BETWEEN v.st AND v.en AND l.stored <= v.en WHERE item NOT IN ('other', 'none')),
vec AS (SELECT patient_id, visit_id, st, lt, {VEC} AS vec FROM ins GROUP BY 1, 2, 3, 4),
lab AS (SELECT patient_id, string_agg(CAST(CAST((epoch(lt) - epoch(st)) / 3600 AS BIGINT) AS VARCHAR) || ':' || vec, ';' ORDER BY st, visit_id, lt) AS labs FROM vec GROUP BY 1)"""


def show_vectors(c):
    row = lambda t, v: F.concat_ws(":", t.cast("bigint").cast("string"), F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("bigint").cast("string"), F.lit("-"))), "/"))
    return F.array_join(F.zip_with(f"{c}.time", f"{c}.value", row), ";").alias(c)


def show_codes(c):
    return F.array_join(F.zip_with(f"{c}.time", f"{c}.value", lambda t, v: F.concat_ws(":", t.cast("bigint").cast("string"), F.array_join(v, ","))), ";").alias(c)


@query("job_patient_sequences", f"""{SEQS} SELECT patient_id, icd_codes, labs, CAST(patient_id IN (SELECT patient_id FROM ok WHERE died = '1') AS INTEGER) AS mortality FROM icd JOIN lab USING (patient_id)""")
def patient_sequences(spark, sf):
    ln = lines_once(spark, sf)
    out = jobs.patient_sequences(visits(spark, sf), codes(spark, sf, ln), labs(spark, sf, ln), adult())
    return out.select("patient_id", show_codes("icd_codes"), show_vectors("labs"), "mortality")


@query("job_length_of_stay_sequences", f"""{SEQS}, last_ AS (SELECT patient_id, arg_max(st, row(st, visit_id)) AS st, arg_max(en, row(st, visit_id)) AS en FROM ok GROUP BY 1)
SELECT patient_id, icd_codes, labs, {LOS.format(d=DAYS)} AS los FROM icd JOIN lab USING (patient_id) JOIN last_ USING (patient_id)""")
def length_of_stay_sequences(spark, sf):
    ln = lines_once(spark, sf)
    out = jobs.length_of_stay_sequences(visits(spark, sf), codes(spark, sf, ln), labs(spark, sf, ln), adult())
    return out.select("patient_id", show_codes("icd_codes"), show_vectors("labs"), "los")


@query("job_multimodal_mortality", f"""{EHR}, fd AS (SELECT patient_id, min(row(st, visit_id)) AS f FROM v WHERE died = '1' GROUP BY 1),
kept AS (SELECT v.*, CAST(f IS NOT NULL AS INTEGER) AS mortality FROM v LEFT JOIN fd USING (patient_id) WHERE f IS NULL OR row(st, visit_id) < f),
b AS (SELECT patient_id, string_agg(coalesce(conditions, ''), ';' ORDER BY st, visit_id) AS conditions, string_agg(coalesce(procedures, ''), ';' ORDER BY st, visit_id) AS procedures, string_agg(coalesce(drugs, ''), ';' ORDER BY st, visit_id) AS drugs
  FROM kept LEFT JOIN lists USING (visit_id) GROUP BY 1 HAVING count(conditions) > 0 AND count(procedures) > 0 AND count(drugs) > 0),
nt AS (SELECT kept.patient_id, string_agg(p_name || ' ' || p_type, '|' ORDER BY st, visit_id, {', '.join(SEQ)}) FILTER (WHERE l_linestatus = 'F') AS discharge, string_agg(p_name || ' ' || p_type, '|' ORDER BY st, visit_id, {', '.join(SEQ)}) FILTER (WHERE l_linestatus <> 'F') AS radiology FROM kept JOIN l USING (visit_id) GROUP BY 1),
f1 AS (SELECT patient_id, min(st) AS first_, max(mortality) AS mortality FROM kept GROUP BY 1),
ins AS (SELECT k.visit_id, k.patient_id, l.lt, l.item, l.l_quantity AS val, {', '.join(SEQ)} FROM kept k JOIN l ON k.patient_id = l.patient_id AND l.lt BETWEEN k.st AND k.en AND l.stored <= k.en WHERE item NOT IN ('other', 'none')),
vec AS (SELECT patient_id, visit_id, lt, {VEC} AS vec FROM ins GROUP BY 1, 2, 3),
lab AS (SELECT patient_id, string_agg(CAST(CAST((epoch(lt) - epoch(first_)) / 3600 AS BIGINT) AS VARCHAR) || ':' || vec, ';' ORDER BY lt, visit_id) AS labs FROM vec JOIN f1 USING (patient_id) GROUP BY 1),
fr AS (SELECT patient_id, name, min(row({', '.join(SEQ)}, i)) AS o FROM (SELECT *, unnest(['promo', 'large', 'small']) AS name, unnest([0, 1, 2]) AS i, unnest([l_discount - 0.05, l_tax - 0.05, l_quantity - 45]) AS val FROM l) WHERE val > 0 GROUP BY 1, 2),
fi AS (SELECT patient_id, string_agg(name, ',' ORDER BY o) AS findings FROM fr GROUP BY 1),
im AS (SELECT patient_id, arg_min(p_name, row(l_orderkey, {', '.join(SEQ)})) AS image_path FROM l GROUP BY 1)
SELECT patient_id, {K3}, coalesce(discharge, '') AS discharge, coalesce(radiology, '') AS radiology, labs, image_path, coalesce(findings, '') AS findings, mortality
FROM b JOIN nt USING (patient_id) JOIN lab USING (patient_id) JOIN im USING (patient_id) JOIN f1 USING (patient_id) LEFT JOIN fi USING (patient_id)""")
def multimodal_mortality(spark, sf):
    shared = lines_once(spark, sf)
    ln = shared.withColumn("patient_id", F.col("o_custkey").cast("string"))
    images = ln.select("patient_id", F.col("p_name").alias("path"), F.struct("l_orderkey", *SEQ).alias("seq"))
    scores = ln.select("patient_id", F.struct(*SEQ).alias("seq"), (F.col("l_discount") - 0.05).alias("promo"), (F.col("l_tax") - 0.05).alias("large"), (F.col("l_quantity") - 45).alias("small"))
    found = jobs.positive_findings(scores, ["promo", "large", "small"], ["patient_id"], "seq")
    out = jobs.multimodal_mortality(visits(spark, sf), codes(spark, sf, shared), notes(spark, sf, shared), labs(spark, sf, shared), images, found)
    nested = lambda k: F.array_join(F.transform(k, lambda a: F.array_join(a, ",")), ";").alias(k)
    return out.select("patient_id", *[nested(k) for k in jobs.KINDS], F.array_join("discharge", "|").alias("discharge"), F.array_join("radiology", "|").alias("radiology"), show_vectors("labs"), "image_path", F.array_join("findings", ",").alias("findings"), "mortality")


def dka_sql(ten):
    return f"(kind = 'conditions' AND ((ver = '9' AND replace(code, '.', '') IN {cd.DKA_ICD9}) OR (ver = '10' AND ({' OR '.join(f'''starts_with(upper(replace(code, '.', '')), '{t}')''' for t in ten)}))))"


MARKED = f"""mk AS (SELECT visit_id, kind, CASE WHEN kind = 'conditions' THEN 'D_' ELSE 'P_' END || upper(replace(code, '.', '')) AS c, row({', '.join(SEQ)}) AS sq FROM l WHERE kind <> 'drugs' AND code <> ''),
mf AS (SELECT visit_id, c, min(row(kind, sq)) AS o FROM mk GROUP BY 1, 2), mc AS (SELECT visit_id, string_agg(c, ',' ORDER BY o) AS codes FROM mf GROUP BY 1),
gp AS (SELECT *, coalesce((epoch(st) - epoch(lag(st) OVER (PARTITION BY patient_id ORDER BY st, visit_id))) / 3600, 0) AS gap FROM kept),
icd AS (SELECT patient_id, string_agg(CAST(CAST(gap AS BIGINT) AS VARCHAR) || ':' || codes, ';' ORDER BY st, visit_id) AS icd_codes FROM gp JOIN mc USING (visit_id) GROUP BY 1),
mv AS (SELECT visit_id, concat_ws('/', {', '.join(f'''coalesce(CAST(CAST(round(avg(l_quantity) FILTER (WHERE item IN ({', '.join(repr(i) for i in items)})) * 60) AS BIGINT) AS VARCHAR), '-')''' for items in cd.LAB_CATEGORIES.values())}) AS vec FROM l GROUP BY 1),
lab AS (SELECT patient_id, string_agg(CAST(CAST(gap AS BIGINT) AS VARCHAR) || ':' || vec, ';' ORDER BY st, visit_id) AS labs FROM gp JOIN mv USING (visit_id) GROUP BY 1)"""
NO_LAB = "coalesce(labs, '0:' || concat_ws('/', " + ", ".join(["'-'"] * 10) + ")) AS labs"


def show_means(c):
    cell = lambda x: F.when(F.isnan(x), "-").otherwise(F.round(x * 60).cast("bigint").cast("string"))
    row = lambda t, v: F.concat_ws(":", t.cast("bigint").cast("string"), F.array_join(F.transform(v, cell), "/"))
    return F.array_join(F.zip_with(f"{c}.time", f"{c}.value", row), ";").alias(c)


@query("job_ketoacidosis", f"""{EHR}, hit AS (SELECT DISTINCT visit_id FROM l WHERE {dka_sql(cd.DKA_ICD10)}), fd AS (SELECT patient_id, min(row(st, visit_id)) AS f FROM v SEMI JOIN hit USING (visit_id) GROUP BY 1),
kept AS (SELECT v.* FROM v LEFT JOIN fd USING (patient_id) WHERE f IS NULL OR row(st, visit_id) < f), {MARKED}
SELECT patient_id, icd_codes, {NO_LAB}, CAST(patient_id IN (SELECT patient_id FROM fd) AS INTEGER) AS label FROM icd LEFT JOIN lab USING (patient_id)""")
def ketoacidosis(spark, sf):
    out = jobs.ketoacidosis(visits(spark, sf), codes(spark, sf), labs(spark, sf))
    return out.select("patient_id", show_codes("icd_codes"), show_means("labs"), "label")


@query("job_ketoacidosis_type1", f"""{EHR}, tt AS (SELECT patient_id, tm FROM l WHERE kind = 'conditions' AND ((ver = '9' AND replace(code, '.', '') IN {cd.T1_ICD9}) OR (ver = '10' AND starts_with(upper(replace(code, '.', '')), 'E10')))),
ts AS (SELECT patient_id, min(tm) AS t1 FROM tt GROUP BY 1), ins AS (SELECT v.*, t1 FROM v JOIN ts USING (patient_id) WHERE st <= t1 + INTERVAL 90 DAY),
att AS (SELECT visit_id, arg_min(tm, row({', '.join(SEQ)})) AS dka FROM l WHERE {dka_sql(cd.T1_DKA_ICD10)} GROUP BY 1),
fd AS (SELECT patient_id, min(row(st, visit_id)) AS f, arg_min(dka, row(st, visit_id)) AS dka, min(t1) AS t1 FROM ins JOIN att USING (visit_id) GROUP BY 1),
lb AS (SELECT patient_id, CAST(max(CASE WHEN dka <= fd.t1 + INTERVAL 90 DAY AND abs(floor((epoch(dka) - epoch(tm)) / 86400)) <= 90 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM fd JOIN tt USING (patient_id) GROUP BY 1),
kept AS (SELECT ins.* FROM ins LEFT JOIN fd USING (patient_id) WHERE f IS NULL OR row(st, visit_id) < f), {MARKED}
SELECT patient_id, icd_codes, {NO_LAB}, coalesce(label, 0) AS label FROM icd LEFT JOIN lab USING (patient_id) LEFT JOIN lb USING (patient_id)""")
def ketoacidosis_type1(spark, sf):
    out = jobs.ketoacidosis_type1(visits(spark, sf), codes(spark, sf), labs(spark, sf))
    return out.select("patient_id", show_codes("icd_codes"), show_means("labs"), "label")


def nested(c):
    return F.array_join(F.transform(c, lambda a: F.array_join(a, ",")), ";").alias(c)


HIST = f"""{EHR}, s AS (SELECT v.patient_id, v.visit_id, st, {K3}, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY st, visit_id) AS k FROM v JOIN full_ USING (visit_id)),
h AS (SELECT *, {', '.join(f"string_agg({c}, ';') OVER (PARTITION BY patient_id ORDER BY st, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h_{c}" for c in jobs.KINDS)},
  coalesce(string_agg(drugs, ';') OVER (PARTITION BY patient_id ORDER BY st, visit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS past FROM s)"""


@query("job_drug_history", f"""{HIST} SELECT patient_id, visit_id, h_conditions AS conditions, h_procedures AS procedures, CASE WHEN k = 1 THEN '' ELSE past || ';' END AS drugs_hist, drugs FROM h WHERE n >= 2""")
def drug_history(spark, sf):
    out = jobs.drug_history(visits(spark, sf), codes(spark, sf))
    return out.select("patient_id", "visit_id", nested("conditions"), nested("procedures"), nested("drugs_hist"), F.array_join("drugs", ",").alias("drugs"))


@query("job_drug_history_all", f"""{HIST} SELECT patient_id, visit_id, h_conditions AS conditions, h_procedures AS procedures, h_drugs AS drugs_hist, drugs FROM h WHERE n >= 2""")
def drug_history_all(spark, sf):
    out = jobs.drug_history(visits(spark, sf), codes(spark, sf), hide_current=False)
    return out.select("patient_id", "visit_id", nested("conditions"), nested("procedures"), nested("drugs_hist"), F.array_join("drugs", ",").alias("drugs"))


def name_to_brand(spark, sf):
    """Part name to its brands, ordered: one source code with several targets."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_name").alias("source"), F.concat(F.substring("p_brand", 1, 5), F.lit("-"), F.substring("p_brand", 7, 1)).alias("target")).agg(F.min("p_partkey").alias("rank"))


@query("job_map_codes_ordered", f"""{EHR}, m AS (SELECT p_name AS source, substr(p_brand, 1, 5) || '-' || substr(p_brand, 7, 1) AS target, min(p_partkey) AS rk FROM part GROUP BY 1, 2),
f AS (SELECT visit_id, target, min(row({', '.join(SEQ)}, rk)) AS o FROM l JOIN m ON l.code = m.source WHERE kind = 'drugs' AND code <> '0' GROUP BY 1, 2)
SELECT visit_id, string_agg(target, ',' ORDER BY o) AS drugs FROM f GROUP BY 1""")
def map_codes(spark, sf):
    first = jobs.map_codes_ordered(codes(spark, sf).where("kind = 'drugs'"), name_to_brand(spark, sf))
    return first.groupBy("visit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda r: r["code"]), ",").alias("drugs"))


AGE = "CAST(floor(floor((epoch(st) - epoch(CAST(birth AS TIMESTAMP))) / 86400) / 365.25) AS INTEGER)"


@query("job_linkage_pairs", f"""{EHR}, a AS (SELECT *, {AGE} AS ag, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY st DESC, visit_id DESC) AS rk FROM v),
q2 AS (SELECT a.*, conditions FROM a JOIN lists USING (visit_id) WHERE rk = 1 AND n >= 2 AND ag >= 18 AND conditions IS NOT NULL),
d2 AS (SELECT patient_id, string_agg(conditions, ',[SEP],' ORDER BY st, visit_id) AS dc, arg_max(visit_id, row(st, visit_id)) AS dv, arg_max(ag, row(st, visit_id)) AS da, arg_max(ids, row(st, visit_id)) AS di, max(st) AS ds, string_agg(visit_id, '|' ORDER BY st, visit_id) AS dvs
  FROM a JOIN lists USING (visit_id) WHERE rk > 1 AND ag >= 18 AND conditions IS NOT NULL GROUP BY 1)
SELECT patient_id, visit_id, ',' || conditions AS conditions, ag AS age, ids AS identifiers, dv AS d_visit_id, ',' || dc AS d_conditions, da AS d_age, di AS d_identifiers, CAST(floor((epoch(st) - epoch(ds)) / 86400) AS BIGINT) AS time_gap_days, dvs AS d_visit_ids FROM q2 JOIN d2 USING (patient_id)""")
def linkage_pairs(spark, sf):
    out = jobs.linkage_pairs(visits(spark, sf), codes(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("conditions", "d_conditions")})


@query("job_linkage_pairs_adjacent", f"""{EHR}, a AS (SELECT *, {AGE} AS ag, row_number() OVER (PARTITION BY patient_id ORDER BY st DESC, visit_id DESC) AS rk FROM v)
SELECT q.patient_id, q.visit_id, '<cls>,' || ql.conditions AS conditions, q.ag AS age, q.ids AS identifiers, d.visit_id AS d_visit_id, '<cls>,' || dl.conditions AS d_conditions, d.ag AS d_age, d.ids AS d_identifiers
FROM a q JOIN a d ON q.patient_id = d.patient_id AND q.rk = 1 AND d.rk = 2 JOIN lists ql ON ql.visit_id = q.visit_id JOIN lists dl ON dl.visit_id = d.visit_id
WHERE q.ag >= 18 AND d.ag >= 18 AND ql.conditions IS NOT NULL AND dl.conditions IS NOT NULL""")
def linkage_adjacent(spark, sf):
    out = jobs.linkage_pairs_adjacent(visits(spark, sf), codes(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("conditions", "d_conditions")})


@query("job_codes_until", """WITH lb AS (SELECT user_id, event_id, ts, CAST(value * 20 AS INTEGER) % 16384 AS val FROM events WHERE event_type = 'purchase'),
f AS (SELECT lb.user_id, lb.event_id, string_agg(e.event_type, ',' ORDER BY e.ts, e.event_id) AS feature FROM lb JOIN events e ON e.user_id = lb.user_id AND e.ts <= lb.ts AND e.event_type <> 'purchase' GROUP BY 1, 2)
SELECT CAST(lb.user_id AS VARCHAR) AS patient_id, lb.event_id AS label_id, coalesce(feature, '') AS feature, array_to_string(list_filter(range(14), lambda i: (val >> (13 - i)) & 1 = 1), ',') AS label,
CASE WHEN lb.user_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM lb LEFT JOIN f USING (user_id, event_id)""")
def codes_until(spark, sf):
    e = table(spark, sf, "events").withColumn("patient_id", F.col("user_id").cast("string"))
    ev = e.where("event_type <> 'purchase'").select("patient_id", F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").alias("code"))
    lb = e.where("event_type = 'purchase'").select("patient_id", F.col("event_id").alias("label_id"), F.col("ts").alias("label_time"), F.pmod(F.round(F.col("value") * 20).cast("int"), F.lit(16384)).alias("label"))
    split = e.select("patient_id", F.when(F.col("user_id") % 10 < 7, "train").otherwise("test").alias("split")).distinct()
    out = jobs.codes_until(lb, ev, split)
    return out.select("patient_id", "label_id", F.array_join("feature", ",").alias("feature"), F.array_join(jobs.positive_bits(F.col("label")).cast("array<string>"), ",").alias("label"), "split")


@query("job_survival_features", """WITH r0 AS (SELECT CAST(p_partkey AS VARCHAR) AS patient_id, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS age, p_brand AS sex, CASE WHEN p_size % 3 <> 0 THEN p_type END AS race, p_retailprice / 1000 AS s FROM part)
SELECT patient_id, concat_ws(',', CASE WHEN age <> 'none' THEN 'age_' || age || '.0' END, 'sex_' || sex, 'race_' || race) AS demographics, round(least(1.0, greatest(0.0, s)), 6) AS survival_probability FROM r0""")
def survival(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("patient_id"), F.when(F.col("p_size") % 4 == 0, " None ").otherwise(F.col("p_size").cast("string")).alias("age"),
        F.col("p_brand").alias("sex"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("race"), (F.col("p_retailprice") / 1000).cast("string").alias("surv2m"))
    out = jobs.survival_features(p, "surv2m", {"demographics": ["age"]}, {"demographics": ["sex", "race"]})
    return out.select("patient_id", F.array_join("demographics", ",").alias("demographics"), F.round("survival_probability", 6).alias("survival_probability"))


GENES = f"""WITH g AS (SELECT l_orderkey, {', '.join(SEQ)}, CASE WHEN l_linenumber = 7 THEN 'nan' WHEN l_discount > 0 THEN p_name END AS gene FROM lineitem JOIN part ON l_partkey = p_partkey),
gl AS (SELECT l_orderkey, string_agg(gene, ',' {BY_SEQ}) AS genes, count(*) AS n FROM g WHERE gene IS NOT NULL AND gene <> 'nan' GROUP BY 1)"""


def mutations(spark, sf):
    ln = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gene = F.when(F.col("l_linenumber") == 7, "nan").when(F.col("l_discount") > 0, F.col("p_name"))
    return ln.select(F.col("l_orderkey").alias("patient_id"), gene.alias("gene"), F.struct(*SEQ).alias("seq"))


@query("job_cancer_survival", f"""{GENES} SELECT o_orderkey AS patient_id, coalesce(genes, '') AS mutations, round(o_totalprice, 2) AS age_at_diagnosis, 0.0 AS gleason_score, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS INTEGER) AS vital_status
FROM orders LEFT JOIN gl ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def cancer_survival(spark, sf):
    c = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("patient_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'Deceased' WHEN 'O' THEN 'Alive' ELSE 'not known' END").alias("vital_status"),
        F.round("o_totalprice", 2).cast("string").alias("age_at_diagnosis"), F.col("o_orderpriority").alias("gleason_score"))
    return jobs.cancer_survival(c, mutations(spark, sf)).withColumn("mutations", F.array_join("mutations", ","))


@query("job_mutation_burden", f"{GENES} SELECT o_orderkey AS patient_id, coalesce(n, 0) AS genes, CAST(coalesce(n, 0) >= 5 AS INTEGER) AS high_burden FROM orders LEFT JOIN gl ON o_orderkey = l_orderkey")
def mutation_burden(spark, sf):
    return jobs.mutation_burden(table(spark, sf, "orders").select(F.col("o_orderkey").alias("patient_id")), mutations(spark, sf), 5)


SIG = "CASE p_size % 8 WHEN 0 THEN 'Pathogenic/Likely pathogenic' WHEN 1 THEN 'Pathogenic' WHEN 2 THEN 'Benign' WHEN 3 THEN 'LIKELY benign' WHEN 4 THEN 'Uncertain significance' WHEN 5 THEN 'VUS' WHEN 6 THEN 'risk factor' END"
SIG_OUT = "CASE p_size % 8 WHEN 0 THEN 'Likely pathogenic' WHEN 1 THEN 'Pathogenic' WHEN 2 THEN 'Benign' WHEN 3 THEN 'Likely benign' WHEN 4 THEN 'Uncertain significance' WHEN 5 THEN 'Uncertain significance' END"


@query("job_variant_significance", f"SELECT p_partkey AS patient_id, p_name AS gene_symbol, CASE WHEN p_size > 40 THEN '' ELSE p_type END AS variant_type, p_brand AS chromosome, {SIG_OUT} AS clinical_significance FROM part WHERE {SIG_OUT} IS NOT NULL")
def variant_significance(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("patient_id"), F.col("p_name").alias("gene_symbol"), F.when(F.col("p_size") > 40, "nan").otherwise(F.col("p_type")).alias("variant_type"), F.col("p_brand").alias("chromosome"), F.expr(SIG).alias("clinical_significance"))
    return jobs.variant_significance(v)


@query("job_mutation_pathogenicity", """SELECT o_orderkey AS patient_id, o_orderpriority AS gene_name, o_orderstatus AS mutation_description, '' AS primary_site, CAST(o_orderstatus = 'F' AS INTEGER) AS pathogenic FROM orders WHERE o_orderstatus <> 'P'""")
def mutation_pathogenicity(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("patient_id"), F.col("o_orderpriority").alias("gene_name"), F.col("o_orderstatus").alias("mutation_description"), F.lit(None).cast("string").alias("primary_site"),
                                          F.expr("CASE o_orderstatus WHEN 'F' THEN 'PATHOGENIC' WHEN 'O' THEN 'NEUTRAL' ELSE 'neutral' END").alias("fathmm_prediction"))
    return jobs.mutation_pathogenicity(m)


def images(spark, sf):
    from wardpanel.sources import prepare

    d = table(spark, sf, "documents").select(F.col("source").alias("image"), F.col("doc_id").alias("visit_id"), F.concat_ws("|", "lang", "source").alias("findings"))
    files = table(spark, sf, "documents").where("lang = 'en'").select(F.col("source").alias("name"))
    return prepare.index_findings(d, files, "root/images", ["EN", "src1", "src19"])


@query("job_finding_labels", """SELECT 'root/images/' || source AS path, doc_id AS visit_id, concat_ws(',', CASE WHEN contains(lower(lang || '|' || source), 'en') THEN 'EN' END, CASE WHEN contains(source, 'src1') THEN 'src1' END, CASE WHEN contains(source, 'src19') THEN 'src19' END) AS labels,
CAST(contains(source, 'src1') AS INTEGER) AS src1 FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'en')""")
def finding_labels(spark, sf):
    im = images(spark, sf)
    named = jobs.finding_labels(im.withColumn("path", F.struct("path", "visit_id")), ["EN", "src1", "src19"])
    both = named.select(F.col("path.path").alias("path"), F.col("path.visit_id").alias("visit_id"), F.array_join("labels", ",").alias("labels"))
    return both.withColumn("src1", F.array_contains(F.split("labels", ","), "src1").cast("int"))


@query("job_present_pairs", "SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def present_pairs(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("text", F.struct("text", "lang"))
    out = jobs.present_pairs(d, "text", "quality")
    return out.groupBy(F.col("text.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text.text")).cast("decimal(38,0)").cast("double").alias("chars"))


@query("job_token_windows", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS token_start, array_to_string(w[i + 1:i + 40], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, len(w), 30)) AS i FROM w)""")
def token_windows(spark, sf):
    return jobs.token_windows(table(spark, sf, "documents"), ["text"], 40, 10, ["doc_id"])


@query("job_recording_labels", """SELECT p_partkey AS patient_id, concat_ws(',', p_name, CASE WHEN p_size > 25 THEN p_brand END) AS recordings, concat_ws(',', CASE WHEN p_size % 2 = 1 THEN 'A' END, CASE WHEN p_size % 3 = 1 THEN 'B' END) AS labels FROM part""")
def recording_labels(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("patient_id"), F.col("p_name").alias("r1"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("r2"), (F.col("p_size") % 2).alias("A"), (F.col("p_size") % 3).alias("B"))
    out = jobs.recording_labels(rows, ["r1", "r2"], ["A", "B"])
    return out.select("patient_id", F.array_join("recordings", ",").alias("recordings"), F.array_join("labels", ",").alias("labels"))

"""Stay factors: users of the events table act as stays, their events as text and numeric events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.functions import stay_events as se
from wardpanel.functions import text as tx
from wardpanel.functions.numeric import rounded
from wardpanel.operators import stay as st
from wardpanel.operators.order import top_per_group
from wardpanel.operators.stay import FactorSpec
from wardpanel.plans import stay_frame as sf_plan
from wardpanel.queries.registry import query, r, table, tidy

KIND = {"click": "conditions", "view": "conditions", "signup": "procedures", "error": "procedures", "purchase": "drugs"}
NUMERIC = {"click": "lab_glucose", "view": "vital_heartrate", "signup": "lab_ph", "error": "lab_lactate", "purchase": "lab_bun"}


def _cases(mapping) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def events(spark, sf):
    """Events with the minute offset from the first event of their user (aggregate and join, no window)."""
    e = table(spark, sf, "events")
    start = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 60000000)
    return e.join(start, "user_id").select(
        F.col("user_id").alias("visit_id"), minutes.alias("offset_min"), "event_type", "event_id", "value",
        F.concat_ws(" ", F.initcap("event_type"), "props").alias("text"),
    )


def text_events(spark, sf):
    return events(spark, sf).select("visit_id", F.expr(_cases(KIND)).alias("source"), "offset_min", "text")


def numeric_events(spark, sf):
    return events(spark, sf).select("visit_id", F.expr(_cases(NUMERIC)).alias("source"), "offset_min", "value", F.col("event_id").alias("seq"))


def stays(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("visit_id"))


EV = f"""
WITH base AS (SELECT user_id AS visit_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60000000 AS off, event_id, value,
  {_cases(KIND)} AS source, {_cases(NUMERIC)} AS ns, lower(event_type || ' ' || props) AS txt FROM events),
ev AS (SELECT *, off / 60.0 AS h FROM base),
stays AS (SELECT c_custkey AS visit_id FROM customer)
"""


def factor_query(name: str, specs: list[FactorSpec], sql: dict[str, str]):
    """One factor per SQL aggregate over `ev`; empty groups give 0."""

    def run(spark, sf):
        out = st.factor_matrix(stays(spark, sf), text_events(spark, sf), numeric_events(spark, sf), specs)
        return tidy(out, ["visit_id"], [s.name for s in specs])

    cols = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    shown = ", ".join(r(f"coalesce({n}, 0)", n) for n in sql)
    query(name, f"{EV}, agg AS (SELECT visit_id, {cols} FROM ev GROUP BY 1) SELECT stays.visit_id, {shown} FROM stays LEFT JOIN agg USING (visit_id)")(run)


def N(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE)"


def HIT(*words: str) -> str:
    return "(" + " OR ".join(f"contains(txt, '{w}')" for w in words) + ")"


def WIN(a, b) -> str:
    return f"(h >= {a} AND h < {b})"


def S(*src: str) -> str:
    return "source IN (" + ", ".join(f"'{s}'" for s in src) + ")"


KW = ("lick", "8}", "purchase")
CP, CPD = ("conditions", "procedures"), ("conditions", "drugs")
factor_query("stay_counts", [FactorSpec("a", "log_count", ("conditions",)), FactorSpec("b", "count_ratio", numerator_source="procedures", denominator_source="drugs"), *st.BASE_FEATURES],
             {"a": f"ln(1 + {N(S('conditions'))})", "b": f"{N(S('procedures'))} / greatest({N(S('drugs'))}, 1)",
              "condition_log_count": f"ln(1 + {N(S('conditions'))})", "procedure_log_count": f"ln(1 + {N(S('procedures'))})", "drug_log_count": f"ln(1 + {N(S('drugs'))})",
              "procedure_to_condition_ratio": f"{N(S('procedures'))} / greatest({N(S('conditions'))}, 1)", "drug_to_condition_ratio": f"{N(S('drugs'))} / greatest({N(S('conditions'))}, 1)",
              "procedure_to_drug_ratio": f"{N(S('procedures'))} / greatest({N(S('drugs'))}, 1)"})
factor_query("stay_keywords", [FactorSpec("k_any", "keyword_any", CP, keywords=("9}",)), FactorSpec("k_count", "keyword_count", CPD, keywords=KW), FactorSpec("k_density", "keyword_density", CPD, keywords=KW)],
             {"k_any": f"CASE WHEN {N(S(*CP) + ' AND ' + HIT('9}'))} > 0 THEN 1.0 ELSE 0 END", "k_count": N(S(*CPD) + " AND " + HIT(*KW)),
              "k_density": f"{N(S(*CPD) + ' AND ' + HIT(*KW))} / greatest({N(S(*CPD))}, 1)"})


def DENS(src, words, w):
    return f"{N(S(*src) + ' AND ' + WIN(*w) + ' AND ' + HIT(*words))} / greatest({N(S(*src) + ' AND ' + WIN(*w))}, 1)"


factor_query("stay_temporal_keywords",
             [FactorSpec("t_count", "temporal_keyword_count", CP, keywords=KW, window_start_hours=12, window_end_hours=240),
              FactorSpec("t_density", "temporal_keyword_density", CP, keywords=KW, window_start_hours=0, window_end_hours=300),
              FactorSpec("t_first", "first_keyword_offset", ("drugs", "procedures"), keywords=("7}", "err")),
              FactorSpec("t_delta", "early_late_keyword_delta", CPD, keywords=KW, early_window_hours=(0, 100), late_window_hours=(100, 400)),
              FactorSpec("t_persist", "keyword_persistence", CP, keywords=("lick",))],
             {"t_count": N(S(*CP) + " AND " + WIN(12, 240) + " AND " + HIT(*KW)), "t_density": DENS(CP, KW, (0, 300)),
              "t_first": f"ln(1 + min(CASE WHEN {S('drugs', 'procedures')} AND off >= 0 AND {HIT('7}', 'err')} THEN h END))",
              "t_delta": f"{DENS(CPD, KW, (100, 400))} - {DENS(CPD, KW, (0, 100))}",
              "t_persist": "(" + " + ".join(f"CASE WHEN {N(S(*CP) + ' AND ' + WIN(a, b) + ' AND ' + HIT('lick'))} > 0 THEN 1.0 ELSE 0 END" for a, b in st.WINDOWS) + ") / 3"})


def NV(src: str, w, val="value") -> str:
    return f"CASE WHEN ns = '{src}' AND {WIN(*w)} THEN {val} END"


def AGG(src, w, how) -> str:
    v, x = NV(src, w), NV(src, w, "h")
    return {
        "mean": f"coalesce(avg({v}), 0)", "min": f"coalesce(min({v}), 0)", "max": f"coalesce(max({v}), 0)", "std": f"coalesce(stddev_pop({v}), 0)",
        "count": N(f"ns = '{src}' AND {WIN(*w)}"), "last": f"coalesce(arg_max(value, row(off, event_id)) FILTER (WHERE ns = '{src}' AND {WIN(*w)}), 0)",
        "slope": f"CASE WHEN count({v}) >= 2 AND var_pop({x}) * count({x}) > 1e-12 THEN regr_slope({v}, {x}) ELSE 0 END",
    }[how]


HR, GL, LC = "vital_heartrate", "lab_glucose", "lab_lactate"
WIDE = (0.0, 360.0)


def num(name, op, src=HR, w=WIDE, **kw):
    return FactorSpec(name, op, numeric_source=src, window_start_hours=w[0], window_end_hours=w[1], **kw)


factor_query("stay_numeric_windows", [num(f"w_{a}", f"numeric_window_{a}") for a in ("mean", "min", "max", "count")], {f"w_{a}": AGG(HR, WIDE, a) for a in ("mean", "min", "max", "count")})
factor_query("stay_numeric_std", [num("w_std", "numeric_window_std")], {"w_std": AGG(HR, WIDE, "std")})
factor_query("stay_numeric_last", [num("w_last", "numeric_window_last", GL, (0, 500))], {"w_last": AGG(GL, (0, 500), "last")})
factor_query("stay_numeric_slope", [num("w_slope", "numeric_window_slope", GL, (0, 700))], {"w_slope": AGG(GL, (0, 700), "slope")})
PAIRS = [("add", "mean", "max"), ("sub", "last", "min"), ("mul", "std", "mean"), ("ratio", "max", "mean"), ("max", "mean", "mean"), ("min", "count", "mean")]
OPS = {"add": "({a}) + ({b})", "sub": "({a}) - ({b})", "mul": "({a}) * ({b})", "ratio": "CASE WHEN abs({b}) < 1e-6 THEN 0 ELSE ({a}) / ({b}) END", "max": "greatest({a}, {b})", "min": "least({a}, {b})"}
factor_query("stay_numeric_interaction",
             [num(f"i_{o}", "numeric_source_interaction", HR, WIDE, secondary_numeric_source=GL, aggregation=a, secondary_aggregation=b, operator=o) for o, a, b in PAIRS],
             {f"i_{o}": OPS[o].format(a=AGG(HR, WIDE, a), b=AGG(GL, WIDE, b)) for o, a, b in PAIRS})
factor_query("stay_keyword_gated", [num("g", "keyword_gated_numeric", HR, WIDE, sources=("drugs",), keywords=("5}",), aggregation="max")],
             {"g": f"CASE WHEN {N(S('drugs') + ' AND ' + WIN(*WIDE) + ' AND ' + HIT('5}'))} > 0 THEN {AGG(HR, WIDE, 'max')} ELSE 0 END"})
factor_query("stay_abnormal_fraction", [num("f", "numeric_abnormal_fraction", HR, WIDE, abnormal_low=10.0, abnormal_high=90.0), num("f0", "numeric_abnormal_fraction", HR, WIDE)],
             {"f": f"coalesce(avg(CASE WHEN ns = '{HR}' AND {WIN(*WIDE)} THEN CASE WHEN value < 10 OR value > 90 THEN 1.0 ELSE 0 END END), 0)", "f0": "max(0.0)"})
factor_query("stay_early_late_delta", [num("d", "numeric_early_late_delta", HR, early_window_hours=(0, 200), late_window_hours=(200, 700))],
             {"d": f"{AGG(HR, (200, 700), 'mean')} - {AGG(HR, (0, 200), 'mean')}"})
factor_query("stay_numeric_persistence", [num("p", "numeric_persistence", HR, threshold=20.0), num("q", "numeric_persistence", HR, abnormal_high=30.0)],
             {n: "(" + " + ".join(f"CASE WHEN max({NV(HR, w)}) {c} THEN 1.0 ELSE 0 END" for w in st.WINDOWS) + ") / 3" for n, c in (("p", ">= 20"), ("q", "> 30"))})
M = AGG(HR, (0, 200), "mean") + " - " + AGG(HR, (200, 700), "mean")
TR = [num(f"x_{t}", "numeric_early_late_delta", HR, early_window_hours=(200, 700), late_window_hours=(0, 200), transform=t) for t in st.TRANSFORMS]
factor_query("stay_transforms", TR, {"x_identity": M, "x_log1p": f"sign({M}) * ln(1 + abs({M}))", "x_abs": f"abs({M})", "x_neg": f"-({M})", "x_sqrt_abs": f"sqrt(abs({M}))"})


ALL_SPECS = [*st.BASE_FEATURES, FactorSpec("k_count", "keyword_count", CPD, keywords=KW), num("w_mean", "numeric_window_mean"), num("w_slope", "numeric_window_slope", GL, (0, 700))]


@query("stay_activity_summary", f"""{EV}, agg AS (SELECT visit_id, {AGG(HR, WIDE, 'mean')} AS w_mean, {AGG(HR, WIDE, 'count')} AS w_count FROM ev GROUP BY 1),
m AS (SELECT coalesce(w_mean, 0) AS w_mean, coalesce(w_count, 0) AS w_count FROM stays LEFT JOIN agg USING (visit_id))
SELECT 'w_mean' AS name, {r('avg(w_mean)', 'mean')}, {r('stddev_pop(w_mean)', 'std')}, {r('avg(CASE WHEN abs(w_mean) > 1e-12 THEN 1.0 ELSE 0 END)', 'nonzero_rate')} FROM m
UNION ALL SELECT 'w_count', {r('avg(w_count)', 'mean')}, {r('stddev_pop(w_count)', 'std')}, {r('avg(CASE WHEN abs(w_count) > 1e-12 THEN 1.0 ELSE 0 END)', 'nonzero_rate')} FROM m""")
def activity(spark, sf):
    specs = [num("w_mean", "numeric_window_mean"), num("w_count", "numeric_window_count")]
    m = st.factor_matrix(stays(spark, sf), text_events(spark, sf), numeric_events(spark, sf), specs)
    return tidy(st.activity_summary(m, ["w_mean", "w_count"]), ["name"], ["mean", "std", "nonzero_rate"])


@query("stay_label_counts", """SELECT los, count(*) AS n FROM (SELECT CASE WHEN d < 1 THEN 0 WHEN d <= 7 THEN d WHEN d <= 14 THEN 8 ELSE 9 END AS los
FROM (SELECT CAST(floor(sum(l_quantity) / 10) AS INT) AS d FROM lineitem GROUP BY l_orderkey)) GROUP BY 1""")
def label_counts(spark, sf):
    days = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.floor(F.sum("l_quantity") / 10).alias("d"))
    return st.label_counts(days.select(st.los_category(F.col("d")).alias("los")), "los")


@query("stay_los_category", """SELECT l_orderkey, CASE WHEN d < 1 THEN 0 WHEN d <= 7 THEN d WHEN d <= 14 THEN 8 ELSE 9 END AS los
FROM (SELECT l_orderkey, CAST(floor(sum(l_quantity) / 10) AS INT) AS d FROM lineitem GROUP BY 1)""")
def los(spark, sf):
    days = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.floor(F.sum("l_quantity") / 10).alias("d"))
    return days.select("l_orderkey", st.los_category(F.col("d")).alias("los"))


@query("stay_group_text", f"""{EV} SELECT visit_id, source, string_agg(off || ':' || txt, '|' ORDER BY off, txt) AS items FROM ev GROUP BY 1, 2""")
def group_text(spark, sf):
    t = text_events(spark, sf).withColumns({"text": F.lower("text"), "visit_id": F.struct("visit_id", "source")})
    out = st.group_text(t)
    items = F.array_join(F.zip_with("offsets", "texts", lambda o, x: F.concat_ws(":", o.cast("string"), x)), "|")
    return out.select("visit_id.visit_id", "visit_id.source", items.alias("items"))


@query("stay_group_numeric", f"""{EV} SELECT visit_id, ns AS source, string_agg(off || ':' || CAST(round(value * 100) AS BIGINT), '|' ORDER BY off, event_id) AS items FROM ev GROUP BY 1, 2""")
def group_numeric(spark, sf):
    out = st.group_numeric(numeric_events(spark, sf))
    items = F.array_join(F.zip_with("offsets", "values", lambda o, v: F.concat_ws(":", o.cast("string"), F.round(v * 100).cast("bigint").cast("string"))), "|")
    return out.select("visit_id", "source", items.alias("items"))


TOP = "SELECT lower(trim(p_name)) AS text, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"


def part_names(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name")


@query("stay_top_values", TOP)
def top_values(spark, sf):
    return st.top_values(part_names(spark, sf), "p_name", 40)


@query("stay_token_profile", f"""WITH top AS ({TOP}), t AS (SELECT count, unnest(list_distinct(regexp_extract_all(text, '[a-z][a-z0-9_/-]{{2,}}'))) AS token FROM top)
SELECT token, CAST(sum(count) AS BIGINT) AS count FROM t WHERE token NOT IN ({', '.join(repr(w) for w in tx.STOP_WORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def token_profile(spark, sf):
    return st.token_profile(st.top_values(part_names(spark, sf), "p_name", 40), tx.tokens(F.col("text")), 20)


# ---- ICU tables shaped from the given tables -------------------------------------------------------


def icu_tables(spark, sf):
    """patient = orders (patient id = customer), diagnosis / physicalexam / medication / lab = line items by flag."""
    o = table(spark, sf, "orders")
    patient = o.select(
        F.col("o_orderkey").alias("patientunitstayid"), F.col("o_custkey").alias("uniquepid"), (F.col("o_orderkey") % 20000).alias("unitdischargeoffset"),
        F.when(F.col("o_orderstatus") == "F", "Expired").when(F.col("o_orderstatus") == "O", "Alive").otherwise("").alias("hospitaldischargestatus"),
        F.when(F.col("o_orderstatus") == "P", "Expired").when(F.col("o_orderstatus") == "O", "Alive").alias("unitdischargestatus"),
        F.floor(F.col("o_totalprice") / 60000).alias("patienthealthsystemstayid"), F.dayofmonth("o_orderdate").alias("unitvisitnumber"),
        F.when(F.col("o_orderkey") % 7 == 0, "> 89").otherwise((F.col("o_orderkey") % 90).cast("string")).alias("age"),
    )
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = lambda f: li.where(F.col("l_returnflag") == f)
    offset = ((F.col("l_quantity") - 3) * 60).alias
    col = lambda name: F.col(name)
    return {
        "patient": patient,
        "diagnosis": flag("A").select(col("l_orderkey").alias("patientunitstayid"), col("p_name").alias("diagnosisstring"), col("p_brand").alias("icd9code"), offset("diagnosisoffset")),
        "physicalexam": flag("N").select(col("l_orderkey").alias("patientunitstayid"), col("p_type").alias("physicalexamvalue"), col("p_type").alias("physicalexampath"), offset("physicalexamoffset")),
        "medication": flag("R").select(
            col("l_orderkey").alias("patientunitstayid"), F.when(F.col("l_tax") > 0, F.col("p_brand")).otherwise("").alias("drugname"),
            F.when(F.col("l_linenumber") > 2, (F.col("l_quantity") - 3) * 60).alias("drugstartoffset"), (F.col("l_quantity") * 30).alias("drugorderoffset")),
        "lab": li.select(
            col("l_orderkey").alias("patientunitstayid"), offset("labresultoffset"), F.col("l_extendedprice").cast("string").alias("labresult"),
            F.when(F.col("p_type") == "PROMO", "pH").when(F.col("p_type") == "SMALL", "phosphate").when(F.col("p_type") == "LARGE", "Total Bilirubin").when(F.col("p_type") == "MEDIUM", "serum albumin").otherwise("glucose").alias("labname")),
    }


ICU = """
WITH p AS (SELECT o_orderkey AS visit_id, o_custkey AS patient_id, o_orderkey % 20000 AS off,
  CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'alive' ELSE '' END AS hs, CASE o_orderstatus WHEN 'P' THEN 'expired' WHEN 'O' THEN 'alive' END AS us,
  CAST(floor(o_totalprice / 60000) AS BIGINT) AS hstay, day(o_orderdate) AS uv, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 90 END AS age FROM orders),
li AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
tx AS (SELECT l_orderkey AS visit_id, 'conditions' AS source, p_brand AS code, p_name AS name FROM li WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'procedures', p_type, p_type FROM li WHERE l_returnflag = 'N'
  UNION ALL SELECT l_orderkey, 'drugs', p_brand, p_brand FROM li WHERE l_returnflag = 'R' AND l_tax > 0),
full_ AS (SELECT visit_id FROM tx GROUP BY 1 HAVING count(DISTINCT source) = 3),
nx AS (SELECT *, lead(hs) OVER w AS nhs, lead(hstay) OVER w AS nstay FROM p WINDOW w AS (PARTITION BY patient_id ORDER BY hstay, uv, CAST(visit_id AS VARCHAR)))
"""


def _labels(name, task, profile, sql, **kw):
    def run(spark, sf):
        t = icu_tables(spark, sf)
        labels = sf_plan.stay_labels(t["patient"], task, profile, **kw)
        return sf_plan.stays_with_all_sources(labels, sf_plan.text_events(t, task, sf_plan.STANDARD))

    query(name, f"{ICU} SELECT CAST(visit_id AS VARCHAR) AS visit_id, CAST(patient_id AS VARCHAR) AS patient_id, {sql}")(run)


_labels("stay_frame_los", "los", sf_plan.STANDARD, "CAST(CASE WHEN off // 1440 < 1 THEN 0 WHEN off // 1440 <= 7 THEN off // 1440 WHEN off // 1440 <= 14 THEN 8 ELSE 9 END AS INT) AS los FROM p SEMI JOIN full_ USING (visit_id)")
_labels("stay_frame_mortality_next", "mortality", sf_plan.STANDARD, "CAST(nhs = 'expired' AS INT) AS mortality FROM nx SEMI JOIN full_ USING (visit_id) WHERE nhs IS NOT NULL")
_labels("stay_frame_mortality_own", "mortality", sf_plan.EXPANDED, "CASE us WHEN 'expired' THEN 1 ELSE 0 END AS mortality FROM p SEMI JOIN full_ USING (visit_id) WHERE us IS NOT NULL", status="unitdischargestatus")
_labels("stay_frame_readmission", "readmission", sf_plan.STANDARD, "CAST(hstay = nstay AS INT) AS readmission FROM nx SEMI JOIN full_ USING (visit_id) WHERE nstay IS NOT NULL AND (age IS NULL OR age >= 18)")


@query("stay_frame_arrays", f"""{ICU}, t2 AS (SELECT l_orderkey AS visit_id, 'conditions' AS source, CAST((l_quantity - 3) * 60 AS BIGINT) AS off, p_name AS t FROM li WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'procedures', CAST((l_quantity - 3) * 60 AS BIGINT), p_type FROM li WHERE l_returnflag = 'N'
  UNION ALL SELECT l_orderkey, 'drugs', CAST(CASE WHEN l_linenumber > 2 THEN (l_quantity - 3) * 60 ELSE l_quantity * 30 END AS BIGINT), p_brand FROM li WHERE l_returnflag = 'R' AND l_tax > 0),
g AS (SELECT visit_id, source, string_agg(off || ':' || t, '|' ORDER BY off, t) AS items FROM t2 GROUP BY 1, 2)
SELECT CAST(p.visit_id AS VARCHAR) AS visit_id, c.items AS conditions, r.items AS procedures, d.items AS drugs FROM p JOIN (SELECT * FROM g WHERE source = 'conditions') c USING (visit_id)
JOIN (SELECT * FROM g WHERE source = 'procedures') r USING (visit_id) JOIN (SELECT * FROM g WHERE source = 'drugs') d USING (visit_id)""")
def frame_arrays(spark, sf):
    out = sf_plan.stay_frame(icu_tables(spark, sf), "los", sf_plan.STANDARD)
    show = lambda s: F.array_join(F.zip_with(f"{s}_offsets", s, lambda o, x: F.concat_ws(":", o.cast("string"), x)), "|").alias(s)
    return out.select("visit_id", show("conditions"), show("procedures"), show("drugs"))


@query("stay_lab_patterns", f"""{ICU}, lab AS (SELECT l_orderkey AS visit_id, lower(CASE p_type WHEN 'PROMO' THEN 'pH' WHEN 'SMALL' THEN 'phosphate' WHEN 'LARGE' THEN 'Total Bilirubin' WHEN 'MEDIUM' THEN 'serum albumin' ELSE 'glucose' END) AS n, l_extendedprice AS v FROM li),
m AS (SELECT visit_id, 'lab_ph' AS source, v FROM lab WHERE regexp_matches(n, '^ph$') UNION ALL SELECT visit_id, 'lab_bilirubin', v FROM lab WHERE regexp_matches(n, 'bilirubin')
  UNION ALL SELECT visit_id, 'lab_glucose', v FROM lab WHERE regexp_matches(n, 'glucose') UNION ALL SELECT visit_id, 'lab_albumin', v FROM lab WHERE regexp_matches(n, '^albumin$'))
SELECT CAST(visit_id AS VARCHAR) AS visit_id, source, count(*) AS n, {r('avg(v)', 'mean')} FROM m GROUP BY 1, 2""")
def lab_patterns(spark, sf):
    t = icu_tables(spark, sf)
    out = sf_plan.numeric_events({"lab": t["lab"]}).groupBy("visit_id", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return tidy(out, ["visit_id", "source", "n"], ["mean"])


@query("stay_text_filter", f"""{ICU} SELECT source, count(*) AS n, count(DISTINCT visit_id) AS stays FROM tx GROUP BY 1""")
def text_filter(spark, sf):
    t = sf_plan.text_events(icu_tables(spark, sf), "mortality")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("visit_id").alias("stays"))


@query("stay_finite_filter", """SELECT CAST(l_orderkey AS VARCHAR) AS visit_id, count(*) AS n, sum(v) AS total FROM (
  SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END AS v FROM lineitem)
WHERE v IS NOT NULL AND NOT isnan(v) AND abs(v) < 'inf'::DOUBLE GROUP BY 1""")
def finite_filter(spark, sf):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    v = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_discount") == 0, inf).when(F.col("l_tax") == 0, nan).otherwise(F.col("l_quantity"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("visit_id"), F.lit(0).alias("offset_min"), v.alias("value"))
    return sf_plan.finite_rows(rows).groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---- factor definitions as rows --------------------------------------------------------------------

OPCASE = "CASE p_size % 6 WHEN 0 THEN 'Keyword_Count ' WHEN 1 THEN 'numeric_window_mean' WHEN 2 THEN 'temporal_keyword_density' WHEN 3 THEN 'count_ratio' WHEN 4 THEN 'numeric_persistence' ELSE 'mystery' END"


def spec_rows(spark, sf):
    """Every part is a raw factor definition."""
    p = table(spark, sf, "part")
    return st.blank_specs(p.select(
        F.col("p_partkey").alias("idx"), F.concat_ws("-", "p_name", "p_brand").alias("name"), F.expr(OPCASE).alias("operation"),
        F.split(F.expr("CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'conditions drugs' END"), " ").alias("sources"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN 'Lab_PH' WHEN p_size % 4 = 1 THEN 'vital_heartrate' ELSE 'nothing' END").alias("numeric_source"),
        F.split("p_name", " ").alias("keywords"), F.lit("conditions").alias("numerator_source"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'drugs' ELSE '' END").alias("denominator_source"),
        (F.col("p_size") - 10).cast("double").alias("window_start_hours"), (F.col("p_size") * 2 - 20).cast("double").alias("window_end_hours"),
        F.expr("CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END").alias("threshold"),
    ))


SPEC = f"""WITH raw AS (SELECT p_partkey AS idx, p_name || '-' || p_brand AS nm, lower(trim({OPCASE})) AS operation,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE 'conditions,drugs' END AS sources, CASE WHEN p_size % 4 = 0 THEN 'lab_ph' WHEN p_size % 4 = 1 THEN 'vital_heartrate' ELSE 'nothing' END AS numeric_source,
  replace(lower(p_name), ' ', ',') AS keywords, CASE WHEN p_size % 2 = 0 THEN 'drugs' ELSE '' END AS den, CAST(p_size - 10 AS DOUBLE) AS s0, CAST(p_size * 2 - 20 AS DOUBLE) AS e0,
  CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END AS threshold FROM part),
clean AS (SELECT idx, substr(trim(regexp_replace(lower(trim(nm)), '[^a-zA-Z0-9_]+', '_', 'g'), '_'), 1, 64) AS name, operation, sources, numeric_source, keywords,
  CASE WHEN e0 <= s0 THEN 0 ELSE s0 END AS window_start_hours, CASE WHEN e0 <= s0 THEN 24 ELSE e0 END AS window_end_hours, threshold FROM raw
  WHERE operation <> 'mystery' AND CASE WHEN operation LIKE 'numeric%' THEN numeric_source <> 'nothing' WHEN operation = 'count_ratio' THEN den <> '' ELSE sources <> '' END)"""


STRUCTURE = """name, operation, sources, numeric_source, keywords, den,
  CASE WHEN operation IN ('numeric_window_mean', 'numeric_persistence', 'temporal_keyword_density') THEN window_start_hours || '/' || window_end_hours END,
  CASE WHEN operation LIKE 'numeric%' THEN coalesce(threshold, -1) END"""


@query("stay_spec_normalise", f"{SPEC} SELECT * FROM clean")
def spec_normalise(spark, sf):
    out = st.normalise_specs(spec_rows(spark, sf), "idx")
    return out.select("idx", "name", "operation", F.array_join("sources", ",").alias("sources"), "numeric_source", F.array_join("keywords", ",").alias("keywords"), "window_start_hours", "window_end_hours", "threshold")


@query("stay_spec_signature", f"""{SPEC} SELECT count(*) AS specs, count(DISTINCT row({STRUCTURE})) AS structures FROM clean JOIN (SELECT idx, den FROM raw) USING (idx)""")
def spec_signature(spark, sf):
    out = st.normalise_specs(spec_rows(spark, sf), "idx").withColumn("sig", st.signature())
    return out.agg(F.count(F.lit(1)).alias("specs"), F.countDistinct("sig").alias("structures"))


@query("stay_spec_select", f"""{SPEC}, w AS (SELECT *, CASE WHEN operation LIKE 'keyword%' OR operation = 'count_ratio' THEN '' ELSE window_start_hours || '/' || window_end_hours END AS win,
  CASE WHEN operation LIKE 'numeric%' THEN coalesce(threshold, -1) END AS th, (SELECT den FROM raw WHERE raw.idx = clean.idx) AS den FROM clean WHERE name NOT IN ('small_ring_brand_2', 'hot_gear_brand_3')),
once AS (SELECT name, min(idx) AS first_, arg_min(operation, idx) AS operation FROM w GROUP BY name, w.operation, sources, numeric_source, keywords, den, win, th),
per AS (SELECT name, min(first_) AS idx, arg_max(operation, first_) AS operation FROM once GROUP BY 1) SELECT idx, name, operation FROM per ORDER BY idx LIMIT 60""")
def spec_select(spark, sf):
    specs = st.normalise_specs(spec_rows(spark, sf), "idx")
    return st.select_specs(specs, "idx", denied=["small_ring_brand_2", "HOT_gear_brand_3"], limit=60).select("idx", "name", "operation")


@query("stay_spec_coverage", f"""{SPEC}, k AS (SELECT DISTINCT name, unnest(string_split(keywords, ',')) AS keyword FROM clean WHERE sources <> ''),
obs AS (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS v FROM part),
hit AS (SELECT k.name, k.keyword, max(CASE WHEN contains(v, keyword) THEN 1 ELSE 0 END) AS h FROM k, obs GROUP BY 1, 2)
SELECT name, CAST(sum(h) AS BIGINT) AS covered, CAST(sum(1 - h) AS BIGINT) AS uncovered FROM hit GROUP BY 1""")
def spec_coverage(spark, sf):
    p = table(spark, sf, "part").select(F.explode(F.array(F.lit("conditions"), F.lit("drugs"))).alias("source"), F.concat_ws(" ", "p_type", "p_brand").alias("value"))
    return st.keyword_coverage(st.normalise_specs(spec_rows(spark, sf), "idx"), p)


@query("stay_spec_problems", f"""{SPEC}, dup AS (SELECT name, 'duplicate_name' AS problem FROM clean GROUP BY 1 HAVING count(*) > 1)
SELECT problem, count(*) AS n FROM (SELECT * FROM dup UNION ALL SELECT name, 'past_horizon' FROM clean WHERE operation IN ('temporal_keyword_density', 'numeric_window_mean') AND (window_start_hours > 48 OR window_end_hours > 48)
UNION ALL SELECT name, 'past_horizon' FROM clean WHERE operation = 'numeric_persistence' UNION ALL SELECT name, 'no_threshold' FROM clean WHERE operation = 'numeric_persistence' AND threshold IS NULL
UNION ALL SELECT min(name), 'duplicate_structure' FROM clean JOIN (SELECT idx, den FROM raw) USING (idx) GROUP BY {STRUCTURE} HAVING count(*) > 1) GROUP BY 1""")
def spec_problems(spark, sf):
    out = st.check_specs(st.normalise_specs(spec_rows(spark, sf), "idx"), 48.0)
    return out.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("stay_memory_buckets", """WITH m AS (SELECT p_partkey AS id, p_type AS bucket, p_name || p_brand AS signature, p_retailprice / 2000 + 0.25 * p_size AS score FROM part),
one AS (SELECT arg_max(id, row(score, id)) AS id, arg_max(bucket, row(score, id)) AS bucket, max(score) AS score FROM m GROUP BY signature)
SELECT id, bucket, round(score, 6) + 0.0 AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS rank FROM one) WHERE rank <= 15""")
def memory_buckets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("bucket"), F.concat("p_name", "p_brand").alias("signature"), (F.col("p_retailprice") / 2000).alias("similarity"), F.col("p_size").cast("double").alias("gain"))
    return tidy(st.memory_by_bucket(p, 15), ["id", "bucket", "rank"], ["score"])


@query("stay_event_helpers", f"""{EV}, k AS (SELECT *, txt LIKE '%click%' OR txt LIKE '%view%' AS hit FROM ev)
SELECT visit_id, count(*) FILTER (WHERE h >= 0 AND h < 240) AS early, count(*) FILTER (WHERE hit) AS hits, {r('avg(CASE WHEN hit THEN 1.0 ELSE 0 END)', 'density')},
  {r('coalesce(min(h) FILTER (WHERE hit AND h >= 24 AND h < 480), 0)', 'first')},
  {r('(max(CASE WHEN hit AND h >= 0 AND h < 24 THEN 1.0 ELSE 0 END) + max(CASE WHEN hit AND h >= 24 AND h < 72 THEN 1.0 ELSE 0 END)) / 2', 'persistence')}
FROM k GROUP BY 1""")
def event_helpers(spark, sf):
    words = ["Click", "view"]
    grouped = st.group_text(text_events(spark, sf)).select("visit_id", se.stay_events(F.col("texts"), F.col("offsets")).alias("e"))
    e = F.col("e")
    out = grouped.select(
        "visit_id", F.size(se.between(e, 0, 240)).cast("bigint").alias("early"), se.keyword_count(e, words).cast("bigint").alias("hits"),
        se.keyword_density(e, words).alias("density"), se.first_hours(e, words, 24, 480).alias("first"), se.persistence(e, words, [(0, 24), (24, 72)]).alias("persistence"),
    )
    return tidy(out, ["visit_id", "early", "hits"], ["density", "first", "persistence"])


@query("stay_user_factor", f"{EV} SELECT visit_id, {r('avg(CASE WHEN h >= 72 THEN 1.0 ELSE 0 END)', 'value')} FROM ev GROUP BY 1")
def user_factor(spark, sf):
    grouped = st.group_text(text_events(spark, sf))

    def late_share(row):
        offs = list(row["offsets"])
        return sum(1 for o in offs if o / 60.0 >= 72.0) / max(len(offs), 1)

    return tidy(st.user_factor(grouped, late_share), ["visit_id"], ["value"])

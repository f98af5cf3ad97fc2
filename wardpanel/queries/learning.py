"""Encoders, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.operators import encode as en
from wardpanel.operators import metrics as mt
from wardpanel.operators import split as sp
from wardpanel.queries.registry import query, r, table, tidy
from wardpanel.sources.tables import scratch, spread

# ---- samples: one per customer, with the part names of each order ----------------------------------

SEQ = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def visit_tokens(spark, sf, part=None):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part") if part is None else part, F.col("l_partkey") == F.col("p_partkey"))
    token = F.when(F.col("l_discount") > 0.005, F.col("p_name"))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "o_orderdate", F.struct(*SEQ, token.alias("t")).alias("s"), "l_orderkey")
    per = rows.groupBy("o_custkey", "o_orderdate", "o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.col("s")))), lambda x: x["t"]).alias("tokens"))
    return per


def nested_samples(spark, sf, part=None):
    """pid, tokens: array of arrays, visits in order."""
    v = visit_tokens(spark, sf, part)
    return v.groupBy(F.col("o_custkey").alias("pid")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "tokens"))), lambda x: x["tokens"]).alias("tokens"))


def nested_samples_once(spark, sf):
    """The nested samples as a scratch table, for queries that read them several times; names move as numbers until they are written."""
    path = scratch(spark, "samples")
    part, names = en.numbered(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")
    nested_samples(spark, sf, part).withColumn("tokens", names(F.col("tokens"), 2)).write.parquet(path)
    return spark.read.parquet(path)


def flat_samples(spark, sf):
    v = visit_tokens(spark, sf)
    return v.select(F.col("o_orderkey").alias("sid"), "tokens")


TOKENS = f"""
WITH vis AS (SELECT o_custkey AS pid, o_orderkey AS sid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS nv FROM orders),
leaf AS (SELECT pid, sid, i, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(SEQ)}) - 1 AS j, CASE WHEN l_discount > 0.005 THEN p_name END AS token FROM vis JOIN lineitem ON sid = l_orderkey JOIN part ON l_partkey = p_partkey),
fv AS (SELECT token, row_number() OVER (ORDER BY min(row(sid, j))) + 1 AS id FROM leaf WHERE token IS NOT NULL GROUP BY 1),
nv AS (SELECT token, row_number() OVER (ORDER BY min(row(pid, i, j))) + 1 AS id FROM leaf WHERE token IS NOT NULL GROUP BY 1),
w AS (SELECT max(j) + 1 AS w FROM leaf)
"""
LOST = "token NOT IN ('red ring', 'hot gear', 'small bolt')"


def known(vocab):
    """Vocabulary of another set: some tokens are unknown to it."""
    return vocab.where(~F.col("token").isin("red ring", "hot gear", "small bolt"))


@query("encode_vocabulary", f"{TOKENS} SELECT token, id FROM fv")
def vocabulary(spark, sf):
    return en.fit_vocabulary(flat_samples(spark, sf), ["sid"], "tokens")


@query("encode_sequence", f"{TOKENS}, k AS (SELECT * FROM fv WHERE {LOST}) SELECT sid, coalesce(ids, '') AS ids FROM vis LEFT JOIN (SELECT sid, string_agg(coalesce(id, 1), ',' ORDER BY j) AS ids FROM leaf LEFT JOIN k USING (token) WHERE leaf.token IS NOT NULL GROUP BY 1) USING (sid)")
def sequence(spark, sf):
    s = flat_samples(spark, sf)
    out = en.encode_sequence(s, "sid", "tokens", known(en.fit_vocabulary(s, ["sid"], "tokens")))
    return out.select("sid", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("ids"))


MAPPED = f"""{TOKENS}, m AS (SELECT p_name AS token, p_type AS target, min(p_partkey) AS rk FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1, 2),
ml AS (SELECT sid, j, coalesce(rk, 0) AS rk, coalesce(target, token) AS token FROM leaf LEFT JOIN m USING (token) WHERE token IS NOT NULL), mv AS (SELECT token, row_number() OVER (ORDER BY min(row(sid, j, rk))) + 1 AS id FROM ml GROUP BY 1)"""


@query("encode_sequence_mapped", f"{MAPPED} SELECT sid, coalesce(ids, '') AS ids FROM vis LEFT JOIN (SELECT sid, string_agg(id, ',' ORDER BY j, rk) AS ids FROM ml JOIN mv USING (token) GROUP BY 1) USING (sid)")
def sequence_mapped(spark, sf):
    s = flat_samples(spark, sf)
    m = table(spark, sf, "part").where("p_name NOT LIKE 'red%'").groupBy(F.col("p_name").alias("source"), F.col("p_type").alias("target")).agg(F.min("p_partkey").alias("rank"))
    out = en.encode_sequence(s, "sid", "tokens", en.fit_vocabulary(s, ["sid"], "tokens", m), m)
    return out.select("sid", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("ids"))


def show_nested(c):
    return F.array_join(F.transform(c, lambda a: F.array_join(a.cast("array<string>"), ",")), ";").alias("ids")


PADDED = "array_to_string(list_concat(coalesce(ids, []::BIGINT[]), list_transform(range(w + {p} - coalesce(len(ids), 0)), lambda x: 0)), ',')"
NESTED = f"""{TOKENS}, k AS (SELECT * FROM nv WHERE {LOST}), enc AS (SELECT sid, list(CAST(coalesce(id, 1) AS BIGINT) ORDER BY j) AS ids FROM leaf LEFT JOIN k USING (token) GROUP BY 1)"""


@query("encode_nested_sequence", f"{NESTED} SELECT pid, string_agg({PADDED.format(p=1)}, ';' ORDER BY i) AS ids FROM vis LEFT JOIN enc USING (sid), w GROUP BY 1")
def nested_sequence(spark, sf):
    s = nested_samples_once(spark, sf)
    lengths = en.max_lengths(s, "tokens")
    lengths[-1] += 1
    out = en.encode_nested(s, "pid", "tokens", known(en.fit_vocabulary(s, ["pid"], "tokens")), lengths)
    return out.select("pid", show_nested("tokens"))


@query("encode_deep_nested_sequence", f"""{NESTED}, mid AS (SELECT max(nv) AS m FROM vis),
rows_ AS (SELECT pid, i, {PADDED.format(p=0)} AS row_ FROM vis LEFT JOIN enc USING (sid), w), pads AS (SELECT pid, unnest(range(max(i) + 1, m)) AS i, array_to_string(list_transform(range(w), lambda x: 0), ',') AS row_ FROM vis, mid, w GROUP BY pid, m, w)
SELECT pid, string_agg(row_, ';' ORDER BY i) AS ids FROM (SELECT * FROM rows_ UNION ALL SELECT * FROM pads) GROUP BY 1""")
def deep_nested_sequence(spark, sf):
    s = nested_samples_once(spark, sf)
    vocab = known(en.fit_vocabulary(s, ["pid"], "tokens"))
    deep = s.withColumn("tokens", F.array("tokens"))
    out = en.encode_nested(deep, "pid", "tokens", vocab, en.max_lengths(deep, "tokens"))
    return out.select("pid", F.array_join(F.transform(F.flatten("tokens"), lambda a: F.array_join(a.cast("array<string>"), ",")), ";").alias("ids"))


@query("encode_vocabulary_algebra", f"""{TOKENS}, keep AS (SELECT token, row_number() OVER (ORDER BY id) + 1 AS id FROM fv WHERE token LIKE '%ring%' OR token LIKE 'small%'),
cut AS (SELECT token, row_number() OVER (ORDER BY id) + 1 AS id FROM keep WHERE token <> 'small ring'), mx AS (SELECT max(id) AS m FROM cut),
new AS (SELECT DISTINCT p_type AS token FROM part) SELECT * FROM cut UNION ALL SELECT token, m + row_number() OVER (ORDER BY token) FROM new, mx""")
def vocabulary_algebra(spark, sf):
    v = en.fit_vocabulary(flat_samples(spark, sf), ["sid"], "tokens")
    names = table(spark, sf, "part").select(F.col("p_name").alias("token"))
    kept = en.keep_tokens(v, names.where("token LIKE '%ring%' OR token LIKE 'small%'"))
    cut = en.keep_tokens(kept, names.where("token = 'small ring'"), remove=True)
    return en.add_tokens(cut, table(spark, sf, "part").select(F.col("p_type").alias("token")))


def number_samples(spark, sf):
    """Quantities per order of a customer; some missing, some orders empty."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    li = table(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_tax") > 0.015, F.col("l_quantity")))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("s", F.when((F.col("o_orderstatus") != "P") & F.col("l_orderkey").isNotNull(), F.struct(*SEQ, "v")))
    per = rows.groupBy("o_custkey", "o_orderdate", "o_orderkey").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["v"]).alias("vals"))
    return per.groupBy(F.col("o_custkey").alias("pid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "vals"))), lambda x: x["vals"]).alias("vals"))


FLOATS = f"""WITH vis AS (SELECT o_custkey AS pid, o_orderkey AS sid, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
leaf AS (SELECT sid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(SEQ)}) - 1 AS j, CASE WHEN l_tax > 0.015 THEN l_quantity END AS v FROM vis JOIN lineitem ON sid = l_orderkey WHERE o_orderstatus <> 'P'),
w AS (SELECT max(j) + 1 AS w FROM leaf), grid AS (SELECT pid, sid, i, unnest(range(w)) AS j, sid IN (SELECT sid FROM leaf) AS filled FROM vis, w),
c AS (SELECT grid.*, v FROM grid LEFT JOIN leaf USING (sid, j)),
s AS (SELECT *, max(CASE WHEN filled THEN 1 END) OVER (PARTITION BY pid, j ORDER BY i) AS seen FROM c), z AS (SELECT *, CASE WHEN NOT filled AND seen IS NULL THEN 0 ELSE v END AS v0 FROM s),
f1 AS (SELECT *, last_value(v0 IGNORE NULLS) OVER (PARTITION BY pid, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v1 FROM z),
f2 AS (SELECT *, coalesce(last_value(v1 IGNORE NULLS) OVER (PARTITION BY pid, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v2 FROM f1)"""
BIG = "CAST(CAST({v} AS BIGINT) AS VARCHAR)"


def show_floats(c):
    return F.array_join(F.transform(c, lambda a: F.array_join(a.cast("array<bigint>").cast("array<string>"), ",")), ";").alias("vals")


@query("encode_nested_floats", f"{FLOATS}, rw AS (SELECT pid, i, string_agg({BIG.format(v='v2')}, ',' ORDER BY j) AS row_ FROM f2 GROUP BY 1, 2) SELECT pid, string_agg(row_, ';' ORDER BY i) AS vals FROM rw GROUP BY 1")
def nested_floats(spark, sf):
    s = number_samples(spark, sf)
    return en.encode_floats(s, "pid", "vals", en.max_lengths(s, "vals")).select("pid", show_floats("vals"))


@query("encode_nested_floats_zero", f"{FLOATS}, rw AS (SELECT pid, i, string_agg({BIG.format(v='coalesce(v, 0)')}, ',' ORDER BY j) AS row_ FROM c GROUP BY 1, 2) SELECT pid, string_agg(row_, ';' ORDER BY i) AS vals FROM rw GROUP BY 1")
def nested_floats_zero(spark, sf):
    s = number_samples(spark, sf)
    return en.encode_floats(s, "pid", "vals", en.max_lengths(s, "vals"), forward_fill=False).select("pid", show_floats("vals"))


@query("encode_deep_nested_floats", f"""{FLOATS}, pad AS (SELECT pid, (SELECT max(i) FROM vis) AS mx, max(i) AS li FROM vis GROUP BY 1), rw AS (SELECT pid, i, string_agg({BIG.format(v='v2')}, ',' ORDER BY j) AS row_ FROM f2 GROUP BY 1, 2),
ex AS (SELECT pid, unnest(range(li + 1, mx + 1)) AS i, li FROM pad), al AS (SELECT * FROM rw UNION ALL SELECT ex.pid, ex.i, rw.row_ FROM ex JOIN rw ON ex.pid = rw.pid AND rw.i = ex.li)
SELECT pid, string_agg(row_, ';' ORDER BY i) AS vals FROM al GROUP BY 1""")
def deep_nested_floats(spark, sf):
    s = number_samples(spark, sf).withColumn("vals", F.array("vals"))
    out = en.encode_floats(s, "pid", "vals", en.max_lengths(s, "vals"))
    return out.withColumn("vals", F.flatten("vals")).select("pid", show_floats("vals"))


@query("encode_stage_tensor", """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type <> 'click' THEN value END AS a, CASE WHEN event_type = 'view' THEN value END AS b FROM events),
f AS (SELECT user_id, i, coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, string_agg(CAST(round(a * 100) AS BIGINT) || '/' || CAST(round(b * 100) AS BIGINT), ';' ORDER BY i) AS steps FROM f GROUP BY 1""")
def stage_tensor(spark, sf):
    e = table(spark, sf, "events")
    a, b = F.when(F.col("event_type") != "click", F.col("value")), F.when(F.col("event_type") == "view", F.col("value"))
    s = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.array(a, b).alias("x")))).alias("r")).select("user_id", F.transform("r", lambda q: q["x"]).alias("steps"))
    out = en.fill_steps(s, "user_id", "steps")
    return out.select("user_id", F.array_join(F.transform("steps", lambda x: F.array_join(F.transform(x, lambda v: F.round(v * 100).cast("bigint").cast("string")), "/")), ";").alias("steps"))


@query("encode_resample", f"""WITH sp AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1),
best AS (SELECT e.user_id, (epoch_us(ts) - a) // 21600000000 AS step, arg_max(value, epoch_us(ts)) AS v FROM events e JOIN sp USING (user_id) GROUP BY 1, 2),
grid AS (SELECT user_id, unnest(range(0, (b - a) // 21600000000 + 1)) AS step FROM sp)
SELECT user_id, step, {r('step * 6.0', 'hours')}, {r('coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 'value')} FROM grid LEFT JOIN best USING (user_id, step)""")
def resample(spark, sf):
    return tidy(en.resample(table(spark, sf, "events"), "user_id", "ts", "value", 21600), ["user_id", "step"], ["hours", "value"])


@query("encode_tensor", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS total, len(embedding) AS n FROM embeddings")
def tensor(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("x", en.to_floats(F.col("embedding"), 1))
    return e.select("vec_id", (F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"), F.size("x").cast("bigint").alias("n"))


@query("encode_multi_hot", f"""{TOKENS}, lv AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM leaf WHERE token IS NOT NULL)), nn AS (SELECT count(*) AS n FROM lv),
h AS (SELECT sid, list(DISTINCT id) AS ids FROM leaf JOIN lv USING (token) GROUP BY 1) SELECT sid, array_to_string(list_transform(range(n), lambda x: CASE WHEN list_contains(coalesce(ids, []::BIGINT[]), x) THEN 1 ELSE 0 END), '') AS flags FROM vis LEFT JOIN h USING (sid), nn""")
def multi_hot(spark, sf):
    s = flat_samples(spark, sf).withColumn("tokens", F.filter("tokens", lambda t: t.isNotNull()))
    out = en.encode_multi_hot(s, "sid", "tokens", en.fit_labels(s, "tokens"))
    return out.select("sid", F.array_join(F.col("tokens").cast("array<string>"), "").alias("flags"))


@query("encode_labels", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS status, CAST(o_orderpriority >= '3' AS BIGINT) AS late FROM orders")
def labels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") >= "3").cast("int").alias("late"))
    out = en.encode_label(o, "status", en.fit_labels(o, "status"))
    return en.encode_label(out, "late", en.fit_labels(o, "late", binary=True))


TABLE_SQL = """words AS (SELECT doc_id, lang, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents), """


def words(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).withColumn("w", F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    return d.select("doc_id", "lang", "w")


def letters(spark):
    return en.token_table(spark, ["the", "is", "on", "la", "et", "die", "que", "en", "le"])


@query("encode_tokens", f"""WITH {TABLE_SQL} v AS (SELECT unnest(['the', 'is', 'on', 'la', 'et', 'die', 'que', 'en', 'le']) AS t, unnest(range(2, 11)) AS id), cut AS (SELECT doc_id, lang, CASE WHEN len(w) > 64 THEN w[len(w) - 63:len(w)] ELSE w END AS w FROM words),
mx AS (SELECT lang, max(len(w)) AS m FROM cut GROUP BY 1), x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM cut), e AS (SELECT doc_id, list(CAST(coalesce(id, 1) AS BIGINT) ORDER BY j) AS ids FROM x LEFT JOIN v USING (t) GROUP BY 1)
SELECT doc_id, array_to_string(list_concat(coalesce(ids, []::BIGINT[]), list_transform(range(m - coalesce(len(ids), 0)), lambda q: 0)), ',') AS ids FROM cut JOIN mx USING (lang) LEFT JOIN e USING (doc_id)""")
def tokens(spark, sf):
    out = en.encode_tokens(words(spark, sf), "doc_id", "w", letters(spark), "lang", 64)
    return out.select("doc_id", F.array_join(F.col("w").cast("array<string>"), ",").alias("ids"))


@query("encode_tokens_nested", f"""{TOKENS}, big AS (SELECT pid, i, j, token, max(j) OVER (PARTITION BY sid) AS mj FROM leaf WHERE token IS NOT NULL),
li AS (SELECT pid, i, row_number() OVER (PARTITION BY pid, i ORDER BY j) - 1 AS j, count(*) OVER (PARTITION BY pid, i) AS n, token FROM big), ct AS (SELECT vis.pid, vis.i, vis.nv, n, j, token FROM vis LEFT JOIN li ON vis.pid = li.pid AND vis.i = li.i WHERE vis.i >= vis.nv - 4 AND (n IS NULL OR j >= n - 3)),
v AS (SELECT 'small ring' AS token, 2 AS id UNION ALL SELECT 'red bolt', 3), rw AS (SELECT pid, i, list(CAST(coalesce(v.id, 1) AS BIGINT) ORDER BY j) FILTER (WHERE ct.token IS NOT NULL) AS ids FROM ct LEFT JOIN v USING (token) GROUP BY 1, 2),
outs AS (SELECT pid % 3 AS b, max(least(nv, 4)) AS o FROM vis GROUP BY 1), ins AS (SELECT pid % 3 AS b, max(coalesce(len(ids), 0)) AS n FROM rw GROUP BY 1),
pr AS (SELECT pid, i, array_to_string(list_concat(coalesce(ids, []::BIGINT[]), list_transform(range(n - coalesce(len(ids), 0)), lambda q: 0)), ',') AS s, n FROM rw JOIN ins ON pid % 3 = b)
SELECT pid, string_agg(s, ';' ORDER BY i) || repeat(';' || array_to_string(list_transform(range(max(n)), lambda q: 0), ','), CAST(max(o) - count(*) AS BIGINT)) AS ids FROM pr JOIN outs ON pid % 3 = b GROUP BY pid""")
def tokens_nested(spark, sf):
    s = nested_samples(spark, sf).withColumn("tokens", F.transform("tokens", lambda v: F.filter(v, lambda t: t.isNotNull()))).withColumn("batch", F.col("pid") % 3)
    out = en.encode_tokens_nested(s, "pid", "tokens", en.token_table(spark, ["small ring", "red bolt"]), "batch", 4, 3)
    return out.select("pid", show_nested("tokens"))


@query("encode_tokens_decode", f"""WITH {TABLE_SQL} x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM words)
SELECT doc_id, string_agg(CASE WHEN t IN ('the', 'is', 'on', 'la', 'et', 'die', 'que', 'en', 'le') THEN t ELSE '<unk>' END, ' ' ORDER BY j) AS back FROM x GROUP BY 1 UNION ALL SELECT doc_id, '' FROM words WHERE len(w) = 0""")
def decode(spark, sf):
    tab = letters(spark)
    enc = en.encode_tokens(words(spark, sf), "doc_id", "w", tab, "lang", 1_000_000)
    return en.decode_tokens(enc, "doc_id", "w", tab).select("doc_id", F.array_join("w", " ").alias("back"))


@query("encode_pad_batch", f"""{TOKENS}, t AS (SELECT vis.sid, coalesce(list(CASE WHEN token IS NULL THEN '-' ELSE token END ORDER BY j) FILTER (WHERE j IS NOT NULL), []) AS a FROM vis LEFT JOIN leaf USING (sid) GROUP BY 1), m AS (SELECT sid % 50 AS b, max(len(a)) AS n FROM t GROUP BY 1)
SELECT sid, array_to_string(list_concat(a, list_transform(range(n - len(a)), lambda x: '0')), ',') AS a FROM t JOIN m ON sid % 50 = b""")
def pad_batch(spark, sf):
    s = flat_samples(spark, sf).withColumn("tokens", F.transform("tokens", lambda t: F.coalesce(t, F.lit("-")))).withColumn("b", F.col("sid") % 50)
    return en.pad_batch(s, "tokens", "b", F.lit("0")).select("sid", F.array_join("tokens", ",").alias("a"))


@query("encode_record_index", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS positions FROM orders GROUP BY 1")
def record_index(spark, sf):
    out = en.record_index(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return out.select("o_custkey", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("encode_saved_fields", f"""{NESTED}, p0 AS (SELECT pid, string_agg({PADDED.format(p=0)}, ';' ORDER BY i) AS ids FROM vis LEFT JOIN (SELECT sid, list(CAST(coalesce(id, 1) AS BIGINT) ORDER BY j) AS ids FROM leaf LEFT JOIN nv USING (token) GROUP BY 1) USING (sid), w GROUP BY 1)
SELECT pid, ids, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS BIGINT) AS segment FROM p0 JOIN customer ON pid = c_custkey""")
def saved_fields(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("note"))
    s = nested_samples(spark, sf).join(c, "pid")
    schema = {"tokens": "nested_sequence", "segment": "multiclass", "note": "ignore"}
    path = scratch(spark, "encoders")
    en.EncoderPipeline(schema, "pid", ["pid"]).fit(s).save(path)
    out = en.EncoderPipeline(schema, "pid", ["pid"]).load(spark, path).transform(s)
    return out.select("pid", show_nested("tokens"), "segment")


@query("encode_stage_codes", f"{NESTED} SELECT pid, string_agg({PADDED.format(p=2)}, ';' ORDER BY i) AS ids, string_agg(i, ',' ORDER BY i) AS time FROM vis LEFT JOIN (SELECT sid, list(CAST(coalesce(id, 1) AS BIGINT) ORDER BY j) AS ids FROM leaf LEFT JOIN nv USING (token) GROUP BY 1) USING (sid), w GROUP BY 1")
def stage_codes(spark, sf):
    s = nested_samples_once(spark, sf)
    timed = s.select("pid", F.struct(F.sequence(F.lit(0), F.size("tokens") - 1).alias("time"), F.col("tokens").alias("value")).alias("codes"))
    out = en.EncoderPipeline({"codes": "stagenet"}, "pid", ["pid"], padding=2).fit(timed).transform(timed)
    return out.select("pid", show_nested("codes.value"), F.array_join(F.col("codes.time").cast("array<string>"), ",").alias("time"))


# ---- splits ---------------------------------------------------------------------------------------


def H(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '-{seed}')"


def cut_sql(pos: str, n: str, ratios, names) -> str:
    total, out = 0.0, "CASE"
    for x, name in zip(ratios[:-1], names[:-1]):
        total += x
        out += f" WHEN {pos} < floor({n} * {total!r}::DOUBLE) THEN '{name}'"
    return f"{out} ELSE '{names[-1]}' END"


@query("split_by_sample", f"SELECT o_orderkey, {cut_sql('p', 'n', (0.7, 0.1, 0.2), sp.NAMES[3])} AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {H('o_orderkey', 5)}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)")
def split_sample(spark, sf):
    return sp.split_by_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (0.7, 0.1, 0.2), 5)


PAT = "SELECT o_custkey, row_number() OVER (ORDER BY {h}, o_custkey) - 1 AS p, count(*) OVER () AS n FROM ({src})"


@query("split_by_patient", f"WITH k AS ({PAT.format(h=H('o_custkey', 9), src='SELECT DISTINCT o_custkey FROM orders')}) SELECT o_orderkey, {cut_sql('p', 'n', (0.6, 0.2, 0.1, 0.1), sp.NAMES[4])} AS split FROM orders JOIN k USING (o_custkey)")
def split_patient(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sp.split_by_patient(o, "o_custkey", (0.6, 0.2, 0.1, 0.1), 9).select("o_orderkey", "split")


@query("split_fixed_test_patient", f"""WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS part FROM orders GROUP BY 1), k AS ({PAT.format(h=H('o_custkey', 2), src="SELECT o_custkey FROM f WHERE part = 'F'")})
SELECT o_orderkey, CASE WHEN k.o_custkey IS NULL THEN 'test' ELSE {cut_sql('p', 'n', (0.5, 0.3, 0.2), ('train', 'val', 'cal'))} END AS split FROM orders LEFT JOIN k USING (o_custkey)""")
def split_fixed_patient(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sp.split_fixed_test(o, "o_orderkey", "o_orderstatus", (0.5, 0.3, 0.2), 2, "F", "o_custkey").select("o_orderkey", "split")


@query("split_fixed_test_sample", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H('o_orderkey', 3)}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, CASE WHEN p IS NULL THEN 'test' ELSE {cut_sql('p', 'n', (0.8, 0.2), ('train', 'val'))} END AS split FROM orders LEFT JOIN k USING (o_orderkey)""")
def split_fixed_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.split_fixed_test(o, "o_orderkey", "o_orderstatus", (0.8, 0.2), 3, "F").select("o_orderkey", "split")


@query("split_balanced", f"""WITH s AS (SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INT) AS label FROM orders), c AS (SELECT sum(label) AS p, count(*) AS n FROM s),
z AS (SELECT p, n - p AS q, least(n - p, round(p * 2.0)) AS want, floor(n * 0.4) AS cap FROM c), y AS (SELECT *, floor(cap / (1 + want / p)) AS keep FROM z), x AS (SELECT keep, least(q, round_even(keep * (want / p), 0), cap - keep) AS kneg FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H('o_orderkey', 4)}, o_orderkey) AS rn FROM s) SELECT o_orderkey, label FROM k, x WHERE rn <= CASE WHEN label = 1 THEN keep ELSE kneg END""")
def split_balanced(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    return sp.sample_balanced(o, "o_orderkey", "label", 2.0, 0.4, 4)


@query("split_queries", f"WITH k AS (SELECT item_id, row_number() OVER (ORDER BY {H('item_id', 1)}, item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark) SELECT item_id, {cut_sql('p', 'n', (0.5, 0.25, 0.25), sp.NAMES[3])} AS split FROM k")
def split_queries(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    return sp.split_keys(b, "item_id", (0.5, 0.25, 0.25), 1)


# ---- metrics --------------------------------------------------------------------------------------


def binary_rows(spark, sf):
    """A score with many ties against the return flag."""
    li = table(spark, sf, "lineitem")
    return li.select(F.xxhash64("l_orderkey", *SEQ).alias("sample_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round((F.floor("l_extendedprice") % 100) / 100, 2).alias("prob"), "l_linestatus", F.col("l_orderkey").alias("ok"))


BIN = "WITH b AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, round((CAST(floor(l_extendedprice) AS BIGINT) % 100) / 100, 2) AS prob, l_linestatus, l_orderkey FROM lineitem), "
CONF = "c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND prob >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND prob >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y = 1 AND prob < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y = 0 AND prob < 0.5) AS DOUBLE) AS tn FROM b)"
KAPPA = "((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (tp + fp + fn + tn) ** 2) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (tp + fp + fn + tn) ** 2)"


@query("metric_binary", f"""{BIN}{CONF} SELECT {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')}, {r('tp / (tp + fp)', 'precision')},
{r('tp / (tp + fn)', 'recall')}, {r(KAPPA, 'cohen_kappa')}, {r('tp / (tp + fp + fn)', 'jaccard')} FROM c""")
def binary(spark, sf):
    out = mt.binary_scores(binary_rows(spark, sf))
    return tidy(out, [], out.columns)


def area_sql(src: str, by: str = "") -> str:
    """Rank-sum ROC area and step-wise average precision from counts per score."""
    part = f"PARTITION BY {by}" if by else ""
    keys, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {keys}CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(q * (coalesce(bp, 0) + p / 2.0)) / (sum(p) * sum(q)) END AS roc, CASE WHEN sum(p) > 0 THEN sum(p * ((coalesce(bp, 0) + p) / (coalesce(bp, 0) + p + coalesce(bq, 0) + q))) / sum(p) END AS ap, sum(p) AS np
    FROM (SELECT *, sum(p) OVER w AS bp, sum(q) OVER w AS bq FROM (SELECT {keys}prob, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM {src} GROUP BY {keys}prob) WINDOW w AS ({part} ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {g})"""


@query("metric_ranking_areas", f"{BIN.rstrip(', ')} SELECT {r('roc', 'roc_auc')}, {r('ap', 'pr_auc')} FROM {area_sql('b')}")
def areas(spark, sf):
    return tidy(mt.ranking_areas(binary_rows(spark, sf)), [], ["roc_auc", "pr_auc"])


def class_rows(spark, sf):
    """Class probabilities: softmax of the first ten vector entries."""
    e = table(spark, sf, "embeddings")
    raw = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double") * 8))
    total = F.aggregate("raw", F.lit(0.0), lambda a, v: a + v)
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y"), raw.alias("raw"), F.col("embedding")).withColumn("prob", F.transform("raw", lambda x: F.round(x / total, 9)))


CLS = """WITH c0 AS (SELECT vec_id AS sid, label AS y, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE) * 8)) AS raw, embedding FROM embeddings),
c AS (SELECT sid, y, list_transform(raw, lambda x: round(x / list_sum(raw), 9)) AS prob, embedding FROM c0), p AS (SELECT *, list_position(prob, list_max(prob)) - 1 AS pred, list_max(prob) AS conf FROM c)"""
PER = f"""{CLS}, ks AS (SELECT unnest(range(10)) AS k), pc AS (SELECT k, CAST(count(*) FILTER (WHERE y = k AND pred = k) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y <> k AND pred = k) AS DOUBLE) AS fp,
CAST(count(*) FILTER (WHERE y = k AND pred <> k) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y = k) AS DOUBLE) AS s FROM ks, p GROUP BY 1)"""
MC = {
    "accuracy": "sum(tp) / sum(s)", "balanced_accuracy": "avg(tp / s)", "f1_micro": "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))", "f1_macro": "avg(2 * tp / (2 * tp + fp + fn))",
    "f1_weighted": "sum(s * 2 * tp / (2 * tp + fp + fn)) / sum(s)", "jaccard_micro": "sum(tp) / (sum(tp) + sum(fp) + sum(fn))", "jaccard_macro": "avg(tp / (tp + fp + fn))", "jaccard_weighted": "sum(s * tp / (tp + fp + fn)) / sum(s)",
    "cohen_kappa": "(sum(tp) / sum(s) - sum(s * (tp + fp)) / sum(s) ** 2) / (1 - sum(s * (tp + fp)) / sum(s) ** 2)",
}


@query("metric_multiclass", f"{PER} SELECT {', '.join(r(e, n) for n, e in MC.items())} FROM pc")
def multiclass(spark, sf):
    d = class_rows(spark, sf).withColumn("pred", mt.argmax(F.col("prob")))
    return tidy(mt.multiclass_scores(d), [], list(MC))


PAIR_SQL = f"""{CLS}, l AS (SELECT sid, y, unnest(range(10)) AS k, unnest(prob) AS s FROM c), nk AS (SELECT y AS k, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1),
cnt AS (SELECT k, s, y, count(*) AS n FROM l GROUP BY 1, 2, 3), own AS (SELECT k, s, n FROM cnt WHERE y = k),
u AS (SELECT own.k AS a, cnt.y AS b, sum(own.n * cnt.n * CASE WHEN own.s > cnt.s THEN 1.0 WHEN own.s = cnt.s THEN 0.5 ELSE 0 END) AS u FROM own JOIN cnt ON own.k = cnt.k AND cnt.y <> own.k GROUP BY 1, 2),
ovo AS (SELECT a, b, u / (na.n * nb.n) AS auc, na.n + nb.n AS w FROM u JOIN nk na ON na.k = a JOIN nk nb ON nb.k = b), tot AS (SELECT sum(n) AS t FROM nk),
ovr AS (SELECT a, sum(u) / (any_value(na.n) * (any_value(t) - any_value(na.n))) AS auc, any_value(na.n / t) AS sh FROM u JOIN nk na ON na.k = a, tot GROUP BY 1)"""


@query("metric_multiclass_areas", f"{PAIR_SQL} SELECT (SELECT round(avg(auc), 6) FROM ovr) AS roc_auc_macro_ovr, (SELECT round(sum(auc * sh), 6) FROM ovr) AS roc_auc_weighted_ovr, (SELECT round(avg(auc), 6) FROM ovo) AS roc_auc_macro_ovo, (SELECT round(sum(auc * w) / sum(w), 6) FROM ovo) AS roc_auc_weighted_ovo")
def multiclass_areas(spark, sf):
    out = mt.multiclass_areas(class_rows(spark, sf), 10)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("metric_hit_rates", f"""{CLS}, k AS (SELECT CAST(1 + len(list_filter(range(10), lambda i: prob[i + 1] > prob[y + 1] OR (prob[i + 1] = prob[y + 1] AND i < y))) AS DOUBLE) AS rk FROM c)
SELECT {r('avg(CAST(rk <= 1 AS INT))', 'hits_1')}, {r('avg(CAST(rk <= 5 AS INT))', 'hits_5')}, {r('avg(CAST(rk <= 10 AS INT))', 'hits_10')}, {r('avg(rk)', 'mean_rank')}, {r('avg(1 / rk)', 'mean_reciprocal_rank')} FROM k""")
def hit_rates(spark, sf):
    out = mt.hit_rates(class_rows(spark, sf))
    return tidy(out, [], out.columns)


@query("metric_log_loss", f"{CLS} SELECT {r('avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob[y + 1]))))', 'log_loss')} FROM c")
def log_loss(spark, sf):
    return tidy(mt.log_loss(class_rows(spark, sf)), [], ["log_loss"])


def label_sets(spark, sf):
    e = table(spark, sf, "embeddings")
    y = F.transform(F.slice("embedding", 21, 8), lambda x: (x.cast("double") > 0.05).cast("int"))
    p = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(1 / (1 + F.exp(-x.cast("double") * 10)), 3))
    return e.select(F.col("vec_id").alias("sample_id"), y.alias("y"), p.alias("prob"))


ML = """WITH s AS (SELECT vec_id AS sid, list_transform(embedding[21:28], lambda x: CAST(CAST(x AS DOUBLE) > 0.05 AS INT)) AS ys, list_transform(embedding[1:8], lambda x: round(1 / (1 + exp(-CAST(x AS DOUBLE) * 10)), 3)) AS ps FROM embeddings),
l AS (SELECT sid, unnest(range(8)) AS k, unnest(ys) AS y, unnest(ps) AS prob FROM s)"""


@query("metric_multilabel_areas", f"""{ML}, a AS (SELECT round(roc, 6) AS roc_auc_micro, round(ap, 6) AS pr_auc_micro FROM {area_sql('l')}),
b AS (SELECT round(avg(roc), 6) AS roc_auc_macro, round(avg(ap), 6) AS pr_auc_macro, round(sum(roc * np) / sum(np), 6) AS roc_auc_weighted, round(sum(ap * np) / sum(np), 6) AS pr_auc_weighted FROM {area_sql('l', 'k')}),
c AS (SELECT round(avg(roc), 6) AS roc_auc_samples, round(avg(ap), 6) AS pr_auc_samples FROM {area_sql('l', 'sid')}) SELECT * FROM a, b, c""")
def multilabel_areas(spark, sf):
    out = mt.multilabel_areas(mt.label_rows(label_sets(spark, sf), "sample_id"), "sample_id")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def conf_sql(by):
    n = lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS DOUBLE)"
    g, keys = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"(SELECT {keys}{n('y = 1 AND prob >= 0.3')} AS tp, {n('y = 0 AND prob >= 0.3')} AS fp, {n('y = 1 AND prob < 0.3')} AS fn, {n('y = 0 AND prob < 0.3')} AS tn FROM l {g})"


Z = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / ({b}) ELSE 0 END"
FAM = {"f1": Z("2 * tp", "2 * tp + fp + fn"), "precision": Z("tp", "tp + fp"), "recall": Z("tp", "tp + fn"), "jaccard": Z("tp", "tp + fp + fn")}


@query("metric_multilabel", f"""{ML}, a AS (SELECT {', '.join(f'round({e}, 6) AS {m}_micro' for m, e in FAM.items())}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((fp + fn) / (tp + fp + fn + tn), 6) AS hamming_loss FROM {conf_sql('')}),
b AS (SELECT {', '.join(f'round(avg({e}), 6) AS {m}_macro, round(sum(({e}) * (tp + fn)) / sum(tp + fn), 6) AS {m}_weighted' for m, e in FAM.items())} FROM {conf_sql('k')}),
c AS (SELECT {', '.join(f'round(avg({e}), 6) AS {m}_samples' for m, e in FAM.items())} FROM {conf_sql('sid')}) SELECT * FROM a, b, c""")
def multilabel(spark, sf):
    out = mt.multilabel_scores(mt.label_rows(label_sets(spark, sf), "sample_id"), "sample_id")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("metric_set_hits", f"{ML} SELECT round(sum(CAST(prob >= 0.4 AND y = 1 AS INT)) / count(DISTINCT sid), 6) AS tp, round(sum(CAST(prob >= 0.4 AND y = 0 AS INT)) / count(DISTINCT sid), 6) AS fp FROM l")
def set_hits(spark, sf):
    d = label_sets(spark, sf).withColumn("predset", F.transform("prob", lambda p: p >= 0.4))
    return mt.set_hits(d).select(F.round("tp", 6).alias("tp"), F.round("fp", 6).alias("fp"))


@query("metric_regression", f"""WITH x AS (SELECT l_quantity / 50 AS a0, l_discount * 10 AS b0 FROM lineitem), y AS (SELECT a0, b0, greatest(a0, 1e-6) AS a, greatest(b0, 1e-6) AS b FROM x), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM y)
SELECT {r('sum(b / tb * ln((b / tb) / (a / ta)))', 'kl_divergence')}, {r('avg((a0 - b0) ** 2)', 'mse')}, {r('avg(abs(a0 - b0))', 'mae')} FROM y, t""")
def regression(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("rec"))
    return tidy(mt.regression_scores(d), [], ["kl_divergence", "mse", "mae"])


EDGE = "len(list_filter(range(1, 20), lambda i: i / 20.0::DOUBLE < {c}))"
GAP = "round(sum(abs(mc - ma) * n) / sum(n), 6) + 0.0"


@query("metric_ece", f"{CLS}, b AS (SELECT {EDGE.format(c='conf')} AS bin, avg(conf) AS mc, avg(CAST(pred = y AS DOUBLE)) AS ma, count(*) AS n FROM p GROUP BY 1) SELECT {GAP} AS ece FROM b")
def ece(spark, sf):
    return tidy(mt.ece(mt.top_confidence(class_rows(spark, sf))), [], ["ece"])


def mass_bin(pos: str, n: str) -> str:
    return f"CASE WHEN {pos} < (20 - {n} % 20) * ({n} // 20) THEN {pos} // ({n} // 20) ELSE 20 - {n} % 20 + ({pos} - (20 - {n} % 20) * ({n} // 20)) // ({n} // 20 + 1) END"


@query("metric_ece_adaptive", f"{CLS}, k AS (SELECT *, row_number() OVER (ORDER BY conf, sid) - 1 AS pos, count(*) OVER () AS t FROM p), b AS (SELECT {mass_bin('pos', 't')} AS bin, avg(conf) AS mc, avg(CAST(pred = y AS DOUBLE)) AS ma, count(*) AS n FROM k GROUP BY 1) SELECT {GAP} AS ece FROM b")
def ece_adaptive(spark, sf):
    return tidy(mt.ece(mt.top_confidence(class_rows(spark, sf)), adaptive=True), [], ["ece"])


CW = f"{CLS}, l AS (SELECT sid, y, unnest(range(10)) AS k, unnest(prob) AS pr FROM c), t AS (SELECT * FROM l WHERE pr >= 0.01)"


@query("metric_ece_classwise", f"{CW}, b AS (SELECT k, {EDGE.format(c='pr')} AS bin, avg(pr) AS mc, avg(CAST(k = y AS DOUBLE)) AS ma, count(*) AS n FROM t GROUP BY 1, 2), e AS (SELECT k, sum(abs(mc - ma) * n) / sum(n) AS e FROM b GROUP BY 1) SELECT round(avg(e), 6) + 0.0 AS ece FROM e")
def ece_classwise(spark, sf):
    return tidy(mt.ece_classwise(class_rows(spark, sf), threshold=0.01), [], ["ece"])


@query("metric_ece_classwise_adaptive", f"{CW}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr, sid) - 1 AS pos, count(*) OVER (PARTITION BY k) AS nn FROM t), b AS (SELECT k, {mass_bin('pos', 'nn')} AS bin, avg(pr) AS mc, avg(CAST(k = y AS DOUBLE)) AS ma, count(*) AS n FROM q GROUP BY 1, 2), e AS (SELECT k, sum(abs(mc - ma) * n) / sum(n) AS e FROM b GROUP BY 1) SELECT round(avg(e), 6) + 0.0 AS ece FROM e")
def ece_classwise_adaptive(spark, sf):
    return tidy(mt.ece_classwise(class_rows(spark, sf), threshold=0.01, adaptive=True), [], ["ece"])


@query("metric_brier", f"{CLS} SELECT {r('avg((conf - CAST(pred = y AS INT)) ** 2)', 'brier_top1')} FROM p")
def brier(spark, sf):
    return tidy(mt.brier_top(mt.top_confidence(class_rows(spark, sf))), [], ["brier_top1"])


SETS = f"{CLS}, z AS (SELECT y, list_transform(prob, lambda x: x > 0.12) AS s FROM c), g AS (SELECT y, len(list_filter(s, lambda x: x)) AS n, CAST(s[y + 1] AS DOUBLE) AS hit FROM z)"


def set_rows(spark, sf):
    return class_rows(spark, sf).withColumn("predset", F.transform("prob", lambda x: x > 0.12))


@query("metric_prediction_sets", f"{SETS} SELECT {r('avg(n)', 'set_size')}, {r('avg(CAST(n <> 1 AS INT))', 'rejection_rate')}, {r('1 - avg(hit)', 'miscoverage_overall')}, {r('coalesce(1 - avg(hit) FILTER (WHERE n = 1), 0)', 'error_overall')} FROM g")
def prediction_sets(spark, sf):
    out = mt.set_scores(set_rows(spark, sf))
    return tidy(out, [], out.columns)


@query("metric_prediction_sets_by_class", f"{SETS} SELECT CAST(y AS BIGINT) AS k, {r('1 - avg(hit)', 'miscoverage')}, {r('coalesce(1 - avg(hit) FILTER (WHERE n = 1), 0)', 'error')} FROM g GROUP BY 1")
def prediction_sets_by_class(spark, sf):
    return tidy(mt.set_scores_by_class(set_rows(spark, sf), 10), ["k"], ["miscoverage", "error"])


@query("metric_fairness", f"""WITH p AS (SELECT c_mktsegment = 'BUILDING' AS s, CAST(o_totalprice > 250000 AS INT) AS pred FROM orders JOIN customer ON o_custkey = c_custkey), q AS (SELECT avg(pred) FILTER (WHERE s) AS a, avg(pred) FILTER (WHERE NOT s) AS b FROM p)
SELECT {r('a / b', 'disparate_impact')}, {r('a - b', 'statistical_parity_difference')} FROM q""")
def fairness(spark, sf):
    preds = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), (F.col("o_totalprice") > 250000).cast("int").alias("pred"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), "c_mktsegment")
    out = mt.fairness(mt.protected_flag(preds, people, "c_mktsegment", "BUILDING"))
    return tidy(out, [], out.columns)


@query("metric_interaction_rate", f"""WITH d AS (SELECT l_orderkey AS sid, p_name || p_brand AS drug FROM lineitem JOIN part ON l_partkey = p_partkey), ip AS (SELECT x.p_name || x.p_brand AS a, y.p_name || y.p_brand AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY drug) AS rn FROM d), pr AS (SELECT x.drug AS a, y.drug AS b FROM n x JOIN n y ON x.sid = y.sid AND x.rn < y.rn),
both_ AS (SELECT a, b FROM ip UNION SELECT b, a FROM ip) SELECT {r('avg(CASE WHEN both_.a IS NOT NULL THEN 1.0 ELSE 0 END)', 'ddi_rate')} FROM pr LEFT JOIN both_ USING (a, b)""")
def interaction_rate(spark, sf):
    """Neighbouring parts count as interacting drugs."""
    p = table(spark, sf, "part")
    name = F.concat("p_name", "p_brand")
    rows = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sample_id"), name.alias("drug"))
    pairs = p.select("p_partkey", name.alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), name.alias("b")), "p_partkey").select("a", "b")
    return tidy(mt.interaction_rate(rows, pairs), [], ["ddi_rate"])


RET = """WITH res AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS score FROM orders),
rel AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS relevance FROM orders),
qs AS (SELECT DISTINCT query_id FROM res SEMI JOIN rel USING (query_id)), rk AS (SELECT res.query_id, res.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rk, coalesce(relevance, 0) AS g FROM res LEFT JOIN rel USING (query_id, doc_id)),
hi AS (SELECT *, sum(CAST(g > 0 AS INT)) OVER (PARTITION BY query_id ORDER BY rk) AS cum FROM rk), tot AS (SELECT query_id, count(*) AS r FROM rel WHERE relevance > 0 GROUP BY 1), idl AS (SELECT query_id, relevance AS g, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rk FROM rel WHERE relevance > 0)"""


def ret_k(k):
    return f"""SELECT qs.query_id, coalesce((SELECT sum(g / log2(rk + 1)) FROM hi WHERE hi.query_id = qs.query_id AND rk <= {k}) / (SELECT sum(g / log2(rk + 1)) FROM idl WHERE idl.query_id = qs.query_id AND rk <= {k}), 0) AS nd,
coalesce((SELECT sum(cum / rk) FROM hi WHERE hi.query_id = qs.query_id AND rk <= {k} AND g > 0) / (SELECT r FROM tot WHERE tot.query_id = qs.query_id), 0) AS mp,
coalesce((SELECT count(*) FROM hi WHERE hi.query_id = qs.query_id AND rk <= {k} AND g > 0) / (SELECT r FROM tot WHERE tot.query_id = qs.query_id), 0) AS rc, (SELECT count(*) FROM hi WHERE hi.query_id = qs.query_id AND rk <= {k} AND g > 0) / {k} AS pr FROM qs"""


@query("metric_retrieval", f"{RET}, k3 AS ({ret_k(3)}), k10 AS ({ret_k(10)}) SELECT * FROM " + ", ".join(f"(SELECT round(avg(nd), 5) AS ndcg_{k}, round(avg(mp), 5) AS map_{k}, round(avg(rc), 5) AS recall_{k}, round(avg(pr), 5) AS p_{k} FROM k{k})" for k in (3, 10)))
def retrieval(spark, sf):
    o = table(spark, sf, "orders")
    res = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_totalprice").alias("score"))
    rel = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END").alias("relevance"))
    return mt.retrieval_scores(res, rel, [3, 10])


@query("metric_score_deltas", f"""WITH s AS (SELECT p_type AS metric, l_returnflag AS part, avg(l_discount) FILTER (WHERE l_linestatus = 'F') AS baseline, avg(l_discount) FILTER (WHERE l_linestatus = 'O') AS combined FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT metric, part, {r('baseline', 'baseline')}, {r('combined', 'combined')}, {r('combined - baseline', 'delta')} FROM s""")
def score_deltas(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = li.groupBy(F.col("p_type").alias("metric"), F.col("l_returnflag").alias("part"), F.when(F.col("l_linestatus") == "F", "baseline").otherwise("combined").alias("variant")).agg(F.avg("l_discount").alias("value"))
    return tidy(mt.score_deltas(s, ["metric", "part"]), ["metric", "part"], ["baseline", "combined", "delta"])


@query("metric_best_by_direction", """SELECT o_orderpriority AS metric, CASE WHEN o_orderpriority < '3' THEN arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) ELSE arg_min(o_orderkey, row(o_totalprice, o_orderkey)) END AS run,
CASE WHEN o_orderpriority < '3' THEN max(o_totalprice) ELSE min(o_totalprice) END AS value FROM orders GROUP BY 1""")
def best_by_direction(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("value"))
    return mt.best_by_direction(o, "metric", F.col("metric") < "3")


@query("metric_permuted_column", f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (ORDER BY {H('vec_id', 7)}, vec_id) AS i FROM embeddings)
SELECT a.vec_id, a.label, round(b.x, 6) + 0.0 AS x FROM a JOIN b USING (i)""")
def permuted(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", 0).cast("double").alias("x"))
    return mt.shuffled_column(e, "vec_id", "x", 7).select("vec_id", "label", (F.round("x", 6) + 0.0).alias("x"))

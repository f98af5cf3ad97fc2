"""Codes, ontologies, graphs, retrieval, linkage, text, calibration and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardpanel.functions import codes as cd
from wardpanel.functions import text as tx
from wardpanel.functions.numeric import number_or_null, rounded
from wardpanel.operators import blocks as bl
from wardpanel.operators import calibrate as ca
from wardpanel.operators import encode as en
from wardpanel.operators import evaluate as ev
from wardpanel.operators import graph as gr
from wardpanel.operators import metrics as mt
from wardpanel.operators import models as md
from wardpanel.operators import retrieve as rt
from wardpanel.operators import split as sp
from wardpanel.plans import jobs
from wardpanel.queries import jobs as jq
from wardpanel.queries import learning as ln
from wardpanel.queries.learning import CLS, H
from wardpanel.queries.registry import query, r, table, tidy
from wardpanel.session import cut_lineage
from wardpanel.sources import prepare as pr
from wardpanel.sources.tables import scratch, spread

# ---- codes and text -------------------------------------------------------------------------------

RAW = "CASE p_size % 4 WHEN 0 THEN 'E' || CAST(p_partkey * 7 AS STRING) WHEN 1 THEN CAST(p_partkey % 1000 AS STRING) WHEN 2 THEN 'V' || CAST(p_partkey AS STRING) ELSE CAST(p_partkey * 31 AS STRING) END"


def dot_sql(c, n):
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '.' || substr({c}, {n + 1}) ELSE {c} END"


@query("codes_dotting", f"WITH c AS (SELECT p_partkey, {RAW} AS c FROM part) SELECT p_partkey, CASE WHEN c LIKE 'E%' THEN {dot_sql('c', 4)} ELSE {dot_sql('c', 3)} END AS icd9cm, {dot_sql('c', 3)} AS icd10cm, {dot_sql('c', 2)} AS icd9proc FROM c")
def dotting(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(RAW).alias("c"))
    c = F.col("c")
    return p.select("p_partkey", cd.icd9cm(c).alias("icd9cm"), cd.icd10cm(c).alias("icd10cm"), cd.icd9proc(c).alias("icd9proc"))


@query("codes_atc_levels", "SELECT p_partkey, substr(p_brand, 1, 1) AS l1, substr(p_brand, 1, 3) AS l2, substr(p_brand, 1, 4) AS l3, substr(p_brand, 1, 5) AS l4, p_brand AS l5, 'v' || p_size || '_' || p_brand AS versioned, upper(replace(p_name, '.', '')) AS plain FROM part")
def atc_levels(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", *[cd.atc(b, i).alias(f"l{i}") for i in range(1, 6)], cd.versioned(F.concat(F.lit("v"), F.col("p_size").cast("string")), b).alias("versioned"), cd.plain(F.col("p_name")).alias("plain"))


MISSING = "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN '0' WHEN 4 THEN ' NaN ' WHEN 5 THEN '<NA>' ELSE p_name END"


@query("codes_missing", f"SELECT l_linenumber, CAST(sum(CASE WHEN l_linenumber <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM lineitem GROUP BY 1")
def missing(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy("l_linenumber").agg(F.sum(cd.is_missing(F.expr(MISSING)).cast("bigint")).alias("missing"))


@query("codes_number_cleaning", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders")
def number_cleaning(spark, sf):
    raw = F.expr("CASE o_orderstatus WHEN 'F' THEN concat(' ', CAST(o_totalprice AS STRING), ' ') WHEN 'O' THEN ' None' ELSE 'bad 1' END")
    return table(spark, sf, "orders").select("o_orderkey", number_or_null(raw).alias("price"))


TAGS = "CASE p_size % 14 WHEN 0 THEN '39 year old' WHEN 1 THEN '2012-12-01 date' WHEN 2 THEN '12/01/2012' WHEN 3 THEN '4567' WHEN 4 THEN 'Telephone/Fax' WHEN 5 THEN 'Hospital1' WHEN 6 THEN 'MRN 12' WHEN 7 THEN 'the id here' WHEN 8 THEN 'Dr. md x' WHEN 9 THEN 'attending' WHEN 10 THEN 'Known lastname' WHEN 11 THEN 'xyz' WHEN 12 THEN '3-14' ELSE 'Street Address' END"
TAGS_OUT = "CASE p_size % 14 WHEN 0 THEN 'AGE' WHEN 1 THEN 'DATE' WHEN 2 THEN 'DATE' WHEN 3 THEN 'DATE' WHEN 4 THEN 'CONTACT' WHEN 5 THEN 'LOCATION' WHEN 6 THEN 'ID' WHEN 7 THEN 'ID' WHEN 8 THEN 'PROFESSION' WHEN 9 THEN 'PROFESSION' WHEN 10 THEN 'NAME' WHEN 11 THEN 'NAME' WHEN 12 THEN 'DATE' ELSE 'LOCATION' END"


@query("text_privacy_category", f"SELECT p_partkey, {TAGS_OUT} AS category FROM part")
def privacy_category(spark, sf):
    return table(spark, sf, "part").select("p_partkey", cd.privacy_category(F.expr(TAGS)).alias("category"))


@query("text_privacy_tokens", r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text, E' \n\t\r'), '\s+') AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM w)
SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE contains(t, '@')) AS tagged FROM x WHERE t <> '' GROUP BY 1""")
def privacy_tokens(spark, sf):
    """Every word with an @ is replaced by a mark, then found again in the original."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("text", F.trim("text", F.lit(" \n\t\r")))
    tagged = F.regexp_replace("text", r"\S*@\S*", "[**Email**]")
    out = d.select("doc_id", rt.privacy_tokens(F.col("text"), tagged).alias("t"))
    found = F.filter("t", lambda x: x["label"].endswith("CONTACT"))
    return out.where(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("words"), F.size(found).cast("bigint").alias("tagged"))


@query("text_normalise", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents")
def normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query("text_safe_name", "SELECT p_partkey, substr(trim(regexp_replace(lower(trim(p_brand || ' -- ' || p_name)), '[^a-zA-Z0-9_]+', '_', 'g'), '_'), 1, 64) AS name FROM part")
def safe_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.safe_name(F.concat_ws(" -- ", "p_brand", "p_name"), F.lit("factor")).alias("name"))


PATTERNS = {"ring": r"\bring", "colour": "red|blue|green", "size": "small|large|big", "gear": "gear$"}


@query("text_tags", "SELECT p_partkey, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(p_name), '{p}') THEN '{n}' END" for n, p in PATTERNS.items()) + ") AS tags FROM part")
def tags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.tags(F.col("p_name"), PATTERNS), ",").alias("tags"))


@query("text_keyword_hits", "SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'tion') THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM documents GROUP BY 1")
def keyword_hits(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(tx.has_any(F.col("text"), ["the", "tion"]).cast("bigint")).alias("hits"))


PAIRS = "WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), p AS (SELECT conv_id * 1000 + turn AS id, text AS a, nxt AS b FROM t WHERE nxt IS NOT NULL)"


def turn_pairs(spark, sf):
    """Each turn with the next turn of its conversation (turn numbers are consecutive, so a join does it)."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), "b")
    return pairs.repartition(spark.sparkContext.defaultParallelism, "id")  # few rows, much work per row


ASCII = "regexp_replace({c}, '[^\\x20-\\x7e]', '?', 'g')"


@query("text_edit_similarity", f"{PAIRS}, q AS (SELECT id, {ASCII.format(c='a')} AS a, {ASCII.format(c='b')} AS b FROM p) SELECT id, {r('1 - levenshtein(a, b) / greatest(length(a), length(b))', 'similarity')} FROM q")
def edit_similarity(spark, sf):
    """Other than plain characters become `?` on both sides: the SQL engine counts bytes, Spark counts characters."""
    plain = lambda c: F.regexp_replace(c, r"[^\x20-\x7e]", "?")
    return tidy(turn_pairs(spark, sf).select("id", rt.edit_similarity(plain("a"), plain("b")).alias("similarity")), ["id"], ["similarity"])


def grams_sql(words_a: str, words_b: str, orders) -> str:
    return f"""{PAIRS}, w AS (SELECT id, {words_a} AS wa, {words_b} AS wb FROM p), ns AS (SELECT unnest({list(orders)}) AS n),
ga AS (SELECT id, n, unnest(list_transform(range(1, len(wa) - n + 2), lambda i: array_to_string(wa[i:i + n - 1], ' '))) AS g FROM w, ns), gb AS (SELECT id, n, unnest(list_transform(range(1, len(wb) - n + 2), lambda i: array_to_string(wb[i:i + n - 1], ' '))) AS g FROM w, ns),
ca AS (SELECT id, n, g, count(*) AS c FROM ga GROUP BY 1, 2, 3), cb AS (SELECT id, n, g, count(*) AS c FROM gb GROUP BY 1, 2, 3),
ov AS (SELECT id, n, sum(least(ca.c, cb.c)) AS o FROM ca JOIN cb USING (id, n, g) GROUP BY 1, 2),
st AS (SELECT w.id, ns.n, CAST(coalesce(o, 0) AS DOUBLE) AS o, CAST(greatest(len(wa) - ns.n + 1, 0) AS DOUBLE) AS na, CAST(greatest(len(wb) - ns.n + 1, 0) AS DOUBLE) AS nb FROM w CROSS JOIN ns LEFT JOIN ov ON ov.id = w.id AND ov.n = ns.n)"""


WS = r"list_filter(regexp_split_to_array(trim({c}, E' \n\t\r'), '\s+'), lambda x: x <> '')"


@query("text_bleu", f"""{grams_sql(WS.format(c='a'), WS.format(c='b'), [1, 2, 3, 4])}, l AS (SELECT id, avg(ln(CASE WHEN o > 0 THEN o / nb ELSE 2.2250738585072014e-308 END)) AS lg, max(CASE WHEN n = 1 THEN o END) AS one, max(CASE WHEN n = 1 THEN na END) AS ra, max(CASE WHEN n = 1 THEN nb END) AS hb FROM st GROUP BY 1)
SELECT id, {r('CASE WHEN one > 0 THEN CASE WHEN hb > ra THEN 1 ELSE exp(1 - ra / hb) END * exp(lg) ELSE 0 END', 'bleu')} FROM l""")
def bleu(spark, sf):
    clean = lambda c: F.trim(c, F.lit(" \n\t\r"))
    return tidy(rt.bleu(turn_pairs(spark, sf), "id", clean(F.col("a")), clean(F.col("b"))), ["id"], ["bleu"])


RW = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '\\s+'), lambda x: x <> '')"


@query("text_rouge", f"""{grams_sql(RW.format(c='a'), RW.format(c='b'), [1, 2])}, q AS (SELECT id, n, o / greatest(nb, 1) AS p, o / greatest(na, 1) AS rc FROM st)
SELECT id, CAST(n AS INTEGER) AS n, {r('p', 'precision')}, {r('rc', 'recall')}, {r('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END', 'f')} FROM q""")
def rouge(spark, sf):
    return tidy(rt.rouge(turn_pairs(spark, sf), "id", F.col("a"), F.col("b")), ["id", "n"], ["precision", "recall", "f"])


@query("text_json_ledger", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def json_ledger(spark, sf):
    path = scratch(spark, "ledger")
    lines = table(spark, sf, "events").select(F.to_json(F.struct("user_id", "event_id", "event_type")).alias("value"))
    lines.union(spark.createDataFrame([("not json",)], "value string")).write.text(path)
    return pr.json_ledger(spark, path, "user_id bigint, event_id bigint, event_type string", "user_id", "event_id")


@query("text_relaxed_union", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT p_brand, CAST(p_size AS DOUBLE) FROM part")
def relaxed_union(spark, sf):
    return pr.relaxed_union([table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_size").alias("v"))])


# ---- ontologies and maps --------------------------------------------------------------------------


def ontology(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return c.unionByName(s).unionByName(n)


ONT = """WITH e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
two AS (SELECT a.child, b.parent FROM e a JOIN e b ON a.parent = b.child), up AS (SELECT child AS code, parent AS other, 1 AS distance FROM e UNION ALL SELECT child, parent, 2 FROM two)"""


@query("ontology_ancestors", f"{ONT} SELECT * FROM up")
def ancestors(spark, sf):
    o = ontology(spark, sf)
    return gr.ancestors(o.select(F.col("child").alias("code")), o)


@query("ontology_descendants", f"{ONT} SELECT other AS code, code AS other, distance FROM up")
def descendants(spark, sf):
    o = ontology(spark, sf)
    return gr.descendants(o.select(F.col("parent").alias("code")), o)


@query("ontology_lookup", "SELECT o_custkey AS code, c_name AS name, CAST(c_custkey IS NOT NULL AS INT) AS known FROM (SELECT DISTINCT o_custkey * 2 AS o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def lookup(spark, sf):
    codes = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("code")).distinct()
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return gr.lookup(codes, nodes, "name")


XMAP = "WITH m AS (SELECT DISTINCT replace(p_name, ' ', '.') AS source, substr(p_brand, 1, 7) AS target FROM part WHERE p_type <> 'PROMO')"


@query("codes_cross_map", f"{XMAP} SELECT p_partkey, target FROM part JOIN m ON replace(p_name, ' ', '.') = source")
def cross_map(spark, sf):
    codes = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("code"))
    m = table(spark, sf, "part").where("p_type <> 'PROMO'").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("source"), F.col("p_brand").alias("target"))
    return gr.cross_map(codes, m, lambda c: F.replace(c, F.lit(" "), F.lit(".")), lambda t: F.substring(t, 1, 7)).select("p_partkey", "target")


@query("codes_interaction_pairs", "SELECT DISTINCT n.n_name AS a, r.r_name AS b FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey < 4) AND r_name IN (SELECT r_name FROM region)")
def interaction_pairs(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    pairs = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    allowed = n.where("n_regionkey < 4").select(F.col("n_name").alias("drug")).union(g.select("r_name"))
    return gr.interaction_pairs(pairs, allowed)


# ---- graphs ---------------------------------------------------------------------------------------


def triples(spark, sf):
    """supplier - supplies - part and customer - lives - nation and supplier - based - nation."""
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("head"), F.lit("supplies").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("tail"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("head"), F.lit("lives").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("tail"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("head"), F.lit("based").alias("relation"), F.concat(F.lit("n"), "s_nationkey").alias("tail"))
    return li.unionByName(c).unionByName(s)


TRI = """WITH t AS (SELECT 's' || l_suppkey AS head, 'supplies' AS relation, 'p' || l_partkey AS tail FROM lineitem UNION ALL SELECT 'c' || c_custkey, 'lives', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'based', 'n' || s_nationkey FROM supplier),
adj AS (SELECT head AS node, tail AS nxt FROM t UNION SELECT tail, head FROM t)"""


@query("graph_entity_ids", f"{TRI} SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT head AS entity FROM t UNION SELECT tail FROM t)")
def entity_ids(spark, sf):
    return gr.entity_ids(triples(spark, sf))


@query("graph_relation_ids", f"{TRI} SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM t)")
def relation_ids(spark, sf):
    return gr.relation_ids(triples(spark, sf))


@query("graph_counts", f"{TRI} SELECT (SELECT count(*) FROM (SELECT head FROM t UNION SELECT tail FROM t)) AS entities, count(DISTINCT relation) AS relations, count(*) AS triples FROM t")
def graph_counts(spark, sf):
    return gr.graph_counts(triples(spark, sf))


NSEED = "sd AS (SELECT 'n' || n_nationkey AS grp, 'n' || n_nationkey AS node FROM nation)"


def nation_seeds(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    unknown = table(spark, sf, "region").select(F.concat(F.lit("zz"), "r_regionkey").alias("node"))
    return n.union(unknown).select(F.col("node").alias("group"), "node")


@query("graph_neighbours", f"{TRI}, {NSEED}, h1 AS (SELECT DISTINCT grp, nxt AS node FROM sd JOIN adj USING (node)), h2 AS (SELECT DISTINCT grp, nxt AS node FROM h1 JOIN adj USING (node)), a AS (SELECT grp, node, min(h) AS hops FROM (SELECT grp, node, 1 AS h FROM h1 UNION ALL SELECT grp, node, 2 FROM h2) GROUP BY 1, 2) SELECT grp AS \"group\", node, hops FROM a WHERE grp <> node")
def neighbours(spark, sf):
    return gr.neighbours(triples(spark, sf), nation_seeds(spark, sf), 2)


SUB = f"""{TRI}, sd AS (SELECT r_name AS grp, 'n' || n_nationkey AS node FROM nation JOIN region ON n_regionkey = r_regionkey), inc AS (SELECT DISTINCT tail AS node, head AS nxt FROM t),
h1 AS (SELECT DISTINCT grp, nxt AS node FROM sd JOIN inc USING (node)), ns AS (SELECT grp, node, min(h) AS hops FROM (SELECT grp, node, 0 AS h FROM sd SEMI JOIN adj USING (node) UNION ALL SELECT grp, node, 1 FROM h1 UNION ALL SELECT grp, inc.nxt, 2 FROM h1 JOIN inc USING (node)) GROUP BY 1, 2)"""


def region_seeds(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group"), F.concat(F.lit("n"), "n_nationkey").alias("node"))


def distinct_triples(spark, sf):
    return triples(spark, sf).distinct()


@query("graph_subgraph", f"{SUB} SELECT ns.grp AS \"group\", d.head, d.relation, d.tail FROM (SELECT DISTINCT * FROM t) d JOIN ns ON ns.node = d.head JOIN ns n2 ON n2.node = d.tail AND n2.grp = ns.grp")
def subgraph(spark, sf):
    t = distinct_triples(spark, sf)
    nodes = gr.subgraph_nodes(t, region_seeds(spark, sf), 2)
    return gr.subgraph(t, nodes).select("group", "head", "relation", "tail")


@query("graph_code_feature", f"""{SUB}, ids AS (SELECT entity AS node, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT head AS entity FROM t UNION SELECT tail FROM t)),
k AS (SELECT grp, node, CAST(hops = 0 AS INT) AS seed, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN hops = 0 THEN 0 ELSE 1 END, id) AS rk FROM ns JOIN ids USING (node)) SELECT grp AS "group", node, seed FROM k WHERE rk <= 40""")
def code_feature(spark, sf):
    t = distinct_triples(spark, sf)
    nodes = gr.subgraph_nodes(t, region_seeds(spark, sf), 2)
    kept = gr.pruned_nodes(nodes, gr.entity_ids(t), 40)
    return kept.select("group", "node", (F.col("hops") == 0).cast("int").alias("seed"))


LAB = "lab AS (SELECT DISTINCT node, CASE substr(node, 1, 1) WHEN 's' THEN 'supplier' WHEN 'c' THEN 'customer' WHEN 'p' THEN 'part' ELSE 'nation' END AS label FROM adj)"


def node_labels(spark, sf):
    names = gr.entities(triples(spark, sf)).select(F.col("entity").alias("node"))
    return names.withColumn("label", F.expr("CASE substr(node, 1, 1) WHEN 's' THEN 'supplier' WHEN 'c' THEN 'customer' WHEN 'p' THEN 'part' ELSE 'nation' END"))


@query("graph_nodes_within_steps", f"""{TRI}, {NSEED}, {LAB}, ok AS (SELECT adj.* FROM adj JOIN lab ON lab.node = adj.nxt WHERE label IN ('supplier', 'part')), h1 AS (SELECT DISTINCT grp, nxt AS node FROM sd JOIN ok USING (node)), h2 AS (SELECT DISTINCT grp, nxt AS node FROM h1 JOIN ok USING (node))
SELECT DISTINCT grp AS "group", node FROM (SELECT * FROM h1 UNION SELECT * FROM h2) WHERE grp <> node""")
def within_steps(spark, sf):
    adj = gr.undirected(triples(spark, sf), distinct=False)
    return gr.nodes_within_steps(adj, node_labels(spark, sf), nation_seeds(spark, sf), 2, ["supplier", "part"], block=True)


@query("graph_nodes_for_all_seeds", f"""{TRI}, sd AS (SELECT r_name AS grp, 'n' || n_nationkey AS node FROM nation JOIN region ON n_regionkey = r_regionkey), h1 AS (SELECT DISTINCT grp, nxt AS node FROM sd JOIN adj USING (node)), h2 AS (SELECT DISTINCT grp, nxt AS node FROM h1 JOIN adj USING (node)),
f AS (SELECT * FROM h1 UNION SELECT * FROM h2) SELECT node FROM f ANTI JOIN sd ON sd.grp = f.grp AND sd.node = f.node WHERE substr(node, 1, 1) = 'p' GROUP BY 1 HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM sd)""")
def for_all_seeds(spark, sf):
    seeds = region_seeds(spark, sf)
    found = gr.nodes_within_steps(gr.undirected(triples(spark, sf), distinct=False), node_labels(spark, sf), seeds, 2, ["part"])
    return gr.nodes_for_all_seeds(found, seeds)


HASH = lambda hop: f"md5(node || '-' || nxt || '-7-{hop}')"


@query("graph_sample_neighbours", f"""{TRI}, s0 AS (SELECT 'n' || n_nationkey AS node FROM nation), e0 AS (SELECT node, nxt, row_number() OVER (PARTITION BY node ORDER BY {HASH(0)}, nxt) AS rk FROM adj SEMI JOIN s0 USING (node)), p0 AS (SELECT node, nxt FROM e0 WHERE rk <= 5),
s1 AS (SELECT node FROM s0 UNION SELECT nxt FROM p0), e1 AS (SELECT node, nxt, row_number() OVER (PARTITION BY node ORDER BY {HASH(1)}, nxt) AS rk FROM adj SEMI JOIN s1 USING (node)) SELECT 0 AS hop, node, nxt AS "to" FROM p0 UNION ALL SELECT 1, node, nxt FROM e1 WHERE rk <= 3""")
def sample_neighbours(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return gr.sample_neighbours(gr.undirected(triples(spark, sf)), n, [5, 3], 7)


@query("graph_link_truth", f"""{TRI}, d AS (SELECT DISTINCT * FROM t), nh AS (SELECT relation, tail, count(*) AS n_heads FROM d GROUP BY 1, 2), nt AS (SELECT head, relation, count(*) AS n_tails FROM d GROUP BY 1, 2), ch AS (SELECT head, relation, count(*) + 3 AS h FROM t GROUP BY 1, 2), ct AS (SELECT tail, relation, count(*) + 3 AS k FROM t GROUP BY 1, 2)
SELECT head, relation, tail, n_heads, n_tails, {r('sqrt(1.0 / (h + k))', 'weight')} FROM t JOIN nh USING (relation, tail) JOIN nt USING (head, relation) JOIN ch USING (head, relation) JOIN ct USING (tail, relation)""")
def link_truth(spark, sf):
    return tidy(gr.link_truth(triples(spark, sf)), ["head", "relation", "tail", "n_heads", "n_tails"], ["weight"])


@query("graph_link_truth_sets", f"{TRI}, d AS (SELECT DISTINCT * FROM t) SELECT relation, tail AS entity, 'heads' AS side, string_agg(head, ',' ORDER BY head) AS members FROM d GROUP BY 1, 2 UNION ALL SELECT relation, head, 'tails', string_agg(tail, ',' ORDER BY tail) FROM d GROUP BY 1, 2")
def link_truth_sets(spark, sf):
    t = triples(spark, sf)
    a = gr.truth_heads(t).select("relation", F.col("tail").alias("entity"), F.lit("heads").alias("side"), F.array_join("heads", ",").alias("members"))
    b = gr.truth_tails(t).select("relation", F.col("head").alias("entity"), F.lit("tails").alias("side"), F.array_join("tails", ",").alias("members"))
    return a.unionByName(b)


@query("graph_co_prescription", "WITH d AS (SELECT DISTINCT l_orderkey AS v, p_name AS g FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT x.g AS a, y.g AS b FROM d x JOIN d y ON x.v = y.v AND x.g <> y.g")
def co_prescription(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("visit_id"), F.col("p_name").alias("drug"))
    return gr.co_prescription(rows)


@query("graph_interaction_adjacency", """WITH c AS (SELECT DISTINCT substr(p_name, 1, 4) AS a, substr(p_type, 1, 4) AS b FROM part), v AS (SELECT DISTINCT substr(p_name, 1, 4) AS t FROM part WHERE p_size < 40 UNION SELECT DISTINCT substr(p_type, 1, 4) FROM part WHERE p_type <> 'PROMO'),
k AS (SELECT a, b FROM c WHERE a IN (SELECT t FROM v) AND b IN (SELECT t FROM v)) SELECT a, b FROM k UNION SELECT b, a FROM k""")
def interaction_adjacency(spark, sf):
    p = table(spark, sf, "part")
    vocab = p.where("p_size < 40").select(F.substring("p_name", 1, 4).alias("token")).union(p.where("p_type <> 'PROMO'").select(F.substring("p_type", 1, 4)))
    return gr.interaction_adjacency(p.select(F.col("p_name").alias("a"), F.col("p_type").alias("b")), vocab)


# ---- vectors --------------------------------------------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").alias("y"))


def centroids(spark, sf):
    """Mean vector per label: one query per class."""
    e = vectors(spark, sf).select("y", F.posexplode("vector").alias("i", "v"))
    m = e.groupBy("y", "i").agg(F.avg("v").alias("v"))
    return m.groupBy(F.col("y").cast("bigint").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda q: q["v"]).alias("vector"))


VEC = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label AS y FROM embeddings),
ce AS (SELECT y AS id, list(m ORDER BY i) AS v FROM (SELECT y, i, avg(v[i]) AS m FROM (SELECT y, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)"""
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("vector_top_k_cosine", f"{VEC}, s AS (SELECT a.id, b.id AS ref_id, {COS} AS score FROM ce a, e b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ref_id) AS rk FROM s) SELECT CAST(id AS BIGINT) AS id, ref_id, {r('score', 'score')}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 10 AND score > 0.3")
def top_k(spark, sf):
    ref = vectors(spark, sf).select(F.col("id").alias("ref_id"), "vector")
    return tidy(bl.similar_above(centroids(spark, sf), ref, 10, 0.3), ["id", "ref_id", "rank"], ["score"])


@query("vector_nearest_euclidean", f"{VEC}, s AS (SELECT a.id, b.id AS ref_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS score FROM ce a, e b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, ref_id) AS rk FROM s) SELECT CAST(id AS BIGINT) AS id, ref_id, {r('score', 'score')}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 8")
def nearest(spark, sf):
    ref = vectors(spark, sf).select(F.col("id").alias("ref_id"), "vector")
    return tidy(bl.nearest(centroids(spark, sf), ref, 8, "euclidean"), ["id", "ref_id", "rank"], ["score"])


@query("vector_neighbours_of_rows", f"{VEC}, s AS (SELECT a.id, b.id AS ref_id, {COS} AS score FROM e a, e b WHERE a.id % 10 = 3), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ref_id) AS rk FROM s) SELECT id, ref_id, {r('score', 'score')}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 6")
def neighbours_of_rows(spark, sf):
    """Every tenth vector asks all vectors: the exact form over the inverted file."""
    every = vectors(spark, sf)
    return tidy(bl.nearest(every.where("id % 10 = 3"), every.select(F.col("id").alias("ref_id"), "vector"), 6), ["id", "ref_id", "rank"], ["score"])


# ---- retrieval and linkage ------------------------------------------------------------------------

DOCS = r"docs AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), qs AS (SELECT item_id AS query_id, string_split(text, ' ') AS w FROM benchmark)"
BM = """tf AS (SELECT doc_id, t, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) GROUP BY 1, 2), dl AS (SELECT doc_id, len(w) AS n FROM docs), st AS (SELECT count(*) AS nn, avg(n) AS av FROM dl),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), ir AS (SELECT t, ln(nn - df + 0.5) - ln(df + 0.5) AS i FROM df, st), mi AS (SELECT avg(i) AS m FROM ir), idf AS (SELECT t, CASE WHEN i < 0 THEN 0.25 * m ELSE i END AS i FROM ir, mi),
qt AS (SELECT query_id, t, CAST(count(*) AS DOUBLE) AS q FROM (SELECT query_id, unnest(w) AS t FROM qs) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(q * i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))) AS score FROM qt JOIN idf USING (t) JOIN tf USING (t) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""


def doc_words(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split("text", " ").alias("tokens"))


def query_words(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("tokens"))


@query("retrieval_bm25", f"WITH {DOCS}, {BM} SELECT query_id, doc_id, {r('score', 'score', 5)} FROM sc")
def bm25(spark, sf):
    return tidy(rt.bm25(doc_words(spark, sf), query_words(spark, sf)), ["query_id", "doc_id"], ["score"], 5)


@query("retrieval_bm25_top", f"WITH {DOCS}, {BM}, k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM sc) SELECT query_id, doc_id, {r('score', 'score', 5)}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 10")
def bm25_top(spark, sf):
    """The best ten documents of each item, from blocks of postings."""
    return tidy(rt.bm25_top(doc_words(spark, sf), query_words(spark, sf), 10), ["query_id", "doc_id", "rank"], ["score"], 5)


def linkage(spark, sf):
    """Linkage samples whose codes are part keys."""
    c = jq.codes(spark, sf).withColumn("code", F.col("seq.l_partkey").cast("string"))
    return cut_lineage(jobs.linkage_pairs(_fine(jq.visits(spark, sf, ends=False)), c))


def _fine(v):
    """Identifiers fine enough to be identifying: priority, status and the birth year."""
    return v.withColumn("identifiers", F.concat_ws("+", "identifiers", F.year("birth").cast("string")))


LINK = f"""{jq.EHR}, pk AS (SELECT visit_id, string_agg(CAST(l_partkey AS VARCHAR), ' ' {jq.BY_SEQ}) AS c FROM l WHERE kind = 'conditions' GROUP BY 1),
a AS (SELECT *, {jq.AGE} AS ag, ids || '+' || year(birth) AS fid, count(*) OVER (PARTITION BY patient_id) AS n, row_number() OVER (PARTITION BY patient_id ORDER BY st DESC, visit_id DESC) AS rk FROM v),
q2 AS (SELECT a.*, c FROM a JOIN pk USING (visit_id) WHERE rk = 1 AND n >= 2 AND ag >= 18), d2 AS (SELECT patient_id, string_agg(c, ' [SEP] ' ORDER BY st, visit_id) AS dc, arg_max(visit_id, row(st, visit_id)) AS dv, arg_max(ag, row(st, visit_id)) AS da, arg_max(fid, row(st, visit_id)) AS di FROM a JOIN pk USING (visit_id) WHERE rk > 1 AND ag >= 18 GROUP BY 1),
lk AS (SELECT visit_id, c, ag, fid, dv, dc, da, di FROM q2 JOIN d2 USING (patient_id))"""


@query("linkage_tables", f"{LINK} SELECT visit_id AS query_id, dv AS doc_id, ag AS age, da AS d_age, fid AS identifiers, di AS d_identifiers FROM lk")
def linkage_tables(spark, sf):
    t = rt.retrieval_tables(linkage(spark, sf))
    d = t["corpus_meta"].select("doc_id", F.col("age").alias("d_age"), F.col("identifiers").alias("d_identifiers"))
    return t["qrels"].join(t["queries_meta"], "query_id").join(d, "doc_id").select("query_id", "doc_id", "age", "d_age", "identifiers", "d_identifiers")


CAND = f"""{LINK}, m AS (SELECT q.visit_id AS query_id, d.dv AS doc_id FROM lk q JOIN lk d ON q.fid = d.di AND d.da <= q.ag), c0 AS (SELECT lk.visit_id AS query_id, count(m.doc_id) AS n FROM lk LEFT JOIN m ON m.query_id = lk.visit_id GROUP BY 1), mean_ AS (SELECT CAST(floor(avg(n)) AS BIGINT) AS k, count(*) AS t FROM c0),
ring AS (SELECT dv AS doc_id, row_number() OVER (ORDER BY md5(dv || '-0'), dv) - 1 AS spot FROM lk), lone AS (SELECT query_id, unnest(range(k)) AS i, CAST('0x' || substr(md5(query_id || '-0'), 1, 7) AS BIGINT) % t AS s, t FROM c0, mean_ WHERE n = 0)"""


@query("linkage_candidates", f"{CAND} SELECT * FROM m UNION ALL SELECT query_id, doc_id FROM lone JOIN ring ON spot = (s + i) % t")
def candidates(spark, sf):
    t = rt.retrieval_tables(linkage(spark, sf))
    return rt.candidates(t["corpus_meta"], t["queries_meta"])


@query("linkage_candidate_counts", f"{CAND} SELECT * FROM c0")
def candidate_counts(spark, sf):
    t = rt.retrieval_tables(linkage(spark, sf))
    return rt.candidate_counts(t["corpus_meta"], t["queries_meta"])


@query("linkage_scores_of_candidates", f"""{CAND}, docs AS (SELECT dv AS doc_id, list_filter(string_split(dc, ' '), lambda x: x <> '[SEP]') AS w FROM lk), qs AS (SELECT visit_id AS query_id, string_split(c, ' ') AS w FROM lk), {BM},
pr AS (SELECT * FROM m UNION SELECT query_id, doc_id FROM lone JOIN ring ON spot = (s + i) % t UNION SELECT visit_id, dv FROM lk) SELECT query_id, doc_id, {r('coalesce(score, 0)', 'score', 5)} FROM pr LEFT JOIN sc USING (query_id, doc_id)""")
def scores_of_candidates(spark, sf):
    t = rt.retrieval_tables(linkage(spark, sf))
    return tidy(rt.candidate_scores(t["corpus"], t["queries"], t["corpus_meta"], t["queries_meta"], t["qrels"]), ["query_id", "doc_id"], ["score"], 5)


@query("linkage_hard_negatives", f"""{LINK}, docs AS (SELECT dv AS doc_id, list_filter(string_split(dc, ' '), lambda x: x <> '[SEP]') AS w FROM lk), qs AS (SELECT dv AS query_id, list_filter(string_split(dc, ' '), lambda x: x <> '[SEP]') AS w FROM lk), {BM},
b AS (SELECT query_id, arg_max(doc_id, row(round(score, 9), -CAST(doc_id AS BIGINT))) AS negative_id FROM sc WHERE query_id <> doc_id GROUP BY 1) SELECT visit_id AS query_id, dv AS doc_id, negative_id FROM lk JOIN b ON b.query_id = dv""")
def hard_negatives(spark, sf):
    t = rt.retrieval_tables(linkage(spark, sf))
    return rt.hard_negatives(t["corpus"], t["qrels"])


# ---- calibration and conformal sets ---------------------------------------------------------------

SPLIT = f"{CLS}, hs AS (SELECT sid, row_number() OVER (ORDER BY {H('sid', 0)}, sid) - 1 AS p, count(*) OVER () AS n FROM c), cal AS (SELECT c.* FROM c JOIN hs USING (sid) WHERE p < floor(n * 0.5)), tst AS (SELECT c.* FROM c JOIN hs USING (sid) WHERE p >= floor(n * 0.5))"


def cal_test(spark, sf):
    rows = cut_lineage(sp.split_by_sample(ln.class_rows(spark, sf), "sample_id", (0.5, 0.5), 0))
    return rows.where("split = 'train'"), rows.where("split = 'val'")


def flags(c="predset"):
    return F.array_join(F.transform(c, lambda b: b.cast("int").cast("string")), "").alias("sets")


QPOS = lambda by: f"SELECT {by}s, row_number() OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''} ORDER BY s) - 1 AS pos, count(*) OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''}) AS n FROM (SELECT y, 1 - prob[y + 1] AS s FROM cal)"


@query("conformal_marginal", f"{SPLIT}, rk AS ({QPOS('')}), th AS (SELECT s AS t FROM rk WHERE pos = ceil((1 - 0.1::DOUBLE) * (n + 1)) - 1) SELECT sid AS sample_id, array_to_string(list_transform(prob, lambda x: CAST(1 - x <= t AS INT)), '') AS sets FROM tst, th")
def conformal_marginal(spark, sf):
    cal, test = cal_test(spark, sf)
    return ca.apply_threshold(test, ca.conformal_threshold(cal, 0.1)).select("sample_id", flags())


@query("conformal_by_class", f"{SPLIT}, rk AS ({QPOS('y, ')}), th AS (SELECT y, s AS t FROM rk WHERE pos = ceil((1 - 0.2::DOUBLE) * (n + 1)) - 1), m AS (SELECT list(coalesce(t, 'inf'::DOUBLE) ORDER BY k) AS ts FROM (SELECT unnest(range(10)) AS k) LEFT JOIN th ON k = y) SELECT sid AS sample_id, array_to_string(list_transform(range(1, 11), lambda i: CAST(1 - prob[i] <= ts[i] AS INT)), '') AS sets FROM tst, m")
def conformal_by_class(spark, sf):
    cal, test = cal_test(spark, sf)
    return ca.apply_class_thresholds(test, ca.conformal_threshold(cal, 0.2, ["y"]), 10).select("sample_id", flags())


DIST2 = "greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), 0)"


def as_vectors(d):
    return d.select(F.col("sample_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def dens(src_a, src_b, h, name):
    return f"{name} AS (SELECT a.sid, avg(exp(-{DIST2} / (64 * {h}))) AS d FROM {src_a} a, {src_b} b GROUP BY 1)"


@query("conformal_covariate_weights", f"""{SPLIT}, cv AS (SELECT sid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, prob[y + 1] AS s FROM cal), tv AS (SELECT sid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM tst),
hc AS (SELECT count(*) ** (-1.0 / 68) AS hc FROM cv), ht AS (SELECT count(*) ** (-1.0 / 68) AS ht FROM tv), {dens('(SELECT * FROM cv, hc)', 'cv', 'any_value(hc)', 'dc').replace('any_value(hc)', 'hc')}, {dens('(SELECT * FROM cv, ht)', 'tv', 'ht', 'dt')},
w AS (SELECT sid, dt.d / (dc.d + 1e-10) AS w, s FROM dc JOIN dt USING (sid) JOIN cv USING (sid)), cw AS (SELECT *, sum(w) OVER (ORDER BY s, sid) / (SELECT sum(w) FROM w) AS share FROM w), t AS (SELECT min(s) AS threshold FROM cw WHERE share >= 0.1)
SELECT sid AS sample_id, {r('w', 'weight')}, {r('threshold', 'threshold')} FROM w, t""")
def covariate(spark, sf):
    cal, test = cal_test(spark, sf)
    weights = ca.covariate_weights(as_vectors(cal), as_vectors(test)).withColumnRenamed("id", "sample_id")
    scored = cal.select("sample_id", ca.true_probability().alias("s")).join(weights, "sample_id")
    cut = ca.weighted_quantile(scored, 0.1, [], "s", "weight", "sample_id")
    out = scored.withColumn("threshold", cut.scalar())
    return tidy(out, ["sample_id"], ["weight", "threshold"])


@query("conformal_clusters")
def clusters(spark, sf):
    cal, test = cal_test(spark, sf)
    vec = lambda d: d.withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    model, thresholds = ca.cluster_thresholds(vec(test), vec(cal), 4, 0.1)
    return thresholds


NEAR = lambda src: f"SELECT a.sid, b.sid AS rid, b.s, sqrt({DIST2}) AS d FROM {src} a, cv b"


@query("conformal_neighbourhood", f"""{SPLIT}, cv AS (SELECT sid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, prob[y + 1] AS s FROM cal), tv AS (SELECT sid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM tst),
n1 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d, rid) AS rk FROM ({NEAR('cv')})), w1 AS (SELECT sid, s, exp(-d / 2.0) / sum(exp(-d / 2.0)) OVER (PARTITION BY sid) AS w FROM n1 WHERE rk <= 15),
c1 AS (SELECT w1.sid, least(1.0, sum(CASE WHEN w1.s <= cv.s THEN w ELSE 0 END)) AS c FROM w1 JOIN cv USING (sid) GROUP BY 1), lv AS (SELECT c AS lvl FROM (SELECT c, row_number() OVER (ORDER BY c DESC, sid) AS i, count(*) OVER () AS n FROM c1) WHERE i = ceil(0.8 * n - 1e-9)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d, rid) AS rk FROM ({NEAR('tv')})), w2 AS (SELECT sid, rid, s, exp(-d / 2.0) / sum(exp(-d / 2.0)) OVER (PARTITION BY sid) AS w FROM n2 WHERE rk <= 15), cw AS (SELECT *, sum(w) OVER (PARTITION BY sid ORDER BY s, rid) / sum(w) OVER (PARTITION BY sid) AS share FROM w2),
th AS (SELECT sid, coalesce(min(CASE WHEN share >= lvl - 1e-12 THEN s END), max(s)) AS t FROM cw, lv GROUP BY 1)
SELECT sid AS sample_id, CASE WHEN list_max(prob) >= t THEN array_to_string(list_transform(prob, lambda x: CAST(x >= t AS INT)), '') ELSE array_to_string(list_transform(range(1, 11), lambda i: CAST(i = list_position(prob, list_max(prob)) AS INT)), '') END AS sets FROM tst JOIN th USING (sid)""")
def neighbourhood(spark, sf):
    cal, test = cal_test(spark, sf)
    c = as_vectors(cal).join(cal.select(F.col("sample_id").alias("id"), ca.true_probability().alias("score")), "id")
    t = as_vectors(test).join(test.select(F.col("sample_id").alias("id"), "prob"), "id")
    return ca.neighbourhood_sets(c, t, 0.2, 15, 2.0).select(F.col("id").alias("sample_id"), flags())


@query("calibrate_histogram", f"""{SPLIT}, l AS (SELECT sid, y, unnest(range(10)) AS k, unnest(prob) AS s FROM cal), g AS (SELECT *, ntile(6) OVER (PARTITION BY k ORDER BY s, sid) AS b FROM l), e AS (SELECT k, b, max(s) AS e FROM g WHERE b < 6 GROUP BY 1, 2), el AS (SELECT k, list(e ORDER BY e) AS es FROM e GROUP BY 1),
pb AS (SELECT k, y, len(list_filter(es, lambda e: e < s)) AS bin FROM l JOIN el USING (k)), mv AS (SELECT k, bin, avg(CAST(y = k AS DOUBLE)) AS m FROM pb GROUP BY 1, 2), tl AS (SELECT sid, unnest(range(10)) AS k, unnest(prob) AS s FROM tst),
pp AS (SELECT sid, k, coalesce(m, 0.5) AS m FROM (SELECT sid, k, len(list_filter(es, lambda e: e < s)) AS bin FROM tl JOIN el USING (k)) LEFT JOIN mv USING (k, bin)) SELECT sid AS sample_id, k, {r('CASE WHEN sum(m) OVER (PARTITION BY sid) > 0 THEN m / sum(m) OVER (PARTITION BY sid) ELSE 0.1 END', 'p')} FROM pp""")
def histogram(spark, sf):
    cal, test = cal_test(spark, sf)
    out = ca.apply_histogram(test, *ca.fit_histogram(cal, 6))
    return tidy(out.select("sample_id", F.posexplode("prob").alias("k", "p")).withColumn("k", F.col("k").cast("bigint")), ["sample_id", "k"], ["p"])


@query("calibrate_kernel_vote", f"""{SPLIT}, cv AS (SELECT sid, y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM cal), tv AS (SELECT sid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM tst), k AS (SELECT a.sid, b.y, exp(-{DIST2} / (64 * 0.01)) AS kv FROM tv a, cv b)
SELECT sid AS sample_id, CAST(y AS BIGINT) AS k, {r('sum(kv) / max(tot)', 'p')} FROM k JOIN (SELECT sid, greatest(sum(kv), 1e-10) AS tot FROM k GROUP BY 1) USING (sid) GROUP BY 1, 2""")
def kernel_vote(spark, sf):
    cal, test = cal_test(spark, sf)
    ref = as_vectors(cal).withColumnRenamed("id", "ref_id").join(cal.select(F.col("sample_id").alias("ref_id"), "y"), "ref_id")
    out = bl.kernel_vote(as_vectors(test), ref, 10, 0.01)
    return tidy(out.select(F.col("id").alias("sample_id"), F.posexplode("prob").alias("k", "p")).withColumn("k", F.col("k").cast("bigint")), ["sample_id", "k"], ["p"])


@query("calibrate_temperature")
def temperature(spark, sf):
    cal, test = cal_test(spark, sf)
    logits = lambda d: d.withColumn("logits", F.transform("prob", lambda p: F.ln(F.greatest(p, F.lit(1e-12)))))
    t = ca.temperature(logits(cal))
    return logits(test).select("sample_id", F.lit(round(t, 3)).alias("temperature"), F.array_max(ca.scaled_softmax(F.col("logits"), t)).alias("top"))


@query("calibrate_dirichlet")
def dirichlet(spark, sf):
    from pyspark.ml.functions import vector_to_array

    cal, test = cal_test(spark, sf)
    model = ca.fit_dirichlet(cal)
    return model.transform(ca.log_features(test)).select("sample_id", F.array_max(vector_to_array("calibrated")).alias("top"))


# ---- models ---------------------------------------------------------------------------------------


BASELINE, FACTORS = ["o_totalprice", "day"], ["quantity", "discount", "f_share"]


def tabular(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.dayofyear("o_orderdate").alias("day"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("f_share"))
    rows = cut_lineage(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "label", *BASELINE, *FACTORS))
    return cut_lineage(sp.split_by_patient(rows, "o_custkey", (0.7, 0.3), 1))




@query("model_logistic_scores")
def logistic_scores(spark, sf):
    rows = tabular(spark, sf)
    train, test = rows.where("split = 'train'"), rows.where("split = 'val'")
    out = None
    for kind in ("baseline", "factors", "combined"):
        model = md.fit_logistic(train, md.feature_columns(kind, BASELINE, FACTORS), "label")
        pred = md.predictions(model, test, ["o_orderkey", "label"]).select(F.col("label").alias("y"), F.get("prob", 1).alias("prob"))
        one = mt.ranking_areas(pred).select(F.lit(kind).alias("features"), "roc_auc", "pr_auc")
        out = one if out is None else out.unionByName(one)
    return out


@query("model_sgd_scores")
def sgd_scores(spark, sf):
    """The stochastic form of the three fits."""
    rows = tabular(spark, sf)
    train, test = rows.where("split = 'train'"), rows.where("split = 'val'")
    out = None
    for kind in ("baseline", "factors", "combined"):
        model = md.fit_sgd_logistic(train, md.feature_columns(kind, BASELINE, FACTORS), "label")
        pred = model.transform(test, ["label"]).select(F.col("label").alias("y"), F.get("prob", 1).alias("prob"))
        one = mt.ranking_areas(pred).select(F.lit(kind).alias("features"), "roc_auc", "pr_auc")
        out = one if out is None else out.unionByName(one)
    return out


@query("model_coefficient_importance")
def importance(spark, sf):
    names = md.feature_columns("combined", BASELINE, FACTORS)
    model = md.fit_logistic(tabular(spark, sf).where("split = 'train'"), names, "label")
    return spark.createDataFrame(md.coefficient_importance(model, names), "feature string, importance double")


@query("model_boosted_scores")
def boosted(spark, sf):
    rows = tabular(spark, sf)
    names = md.feature_columns("combined", BASELINE, FACTORS)
    model = md.fit_boosted(rows.where("split = 'train'"), names, "label")
    pred = md.predictions(model, rows.where("split = 'val'"), ["label"]).select(F.col("label").alias("y"), "pred")
    return mt.multiclass_scores(pred)


@query("model_permutation_importance")
def permutation_importance(spark, sf):
    rows = tabular(spark, sf)
    names = md.feature_columns("combined", BASELINE, FACTORS)
    model = md.fit_logistic(rows.where("split = 'train'"), names, "label")
    test = rows.where("split = 'val'").select("o_orderkey", "label", *names)
    area = lambda d: mt.ranking_areas(md.predictions(model, d, ["label"]).select(F.col("label").alias("y"), F.get("prob", 1).alias("prob"))).select("roc_auc")
    base = area(test).scalar()
    moved = cut_lineage(mt.shuffled_columns(test, "o_orderkey", names, 3))
    out = None
    for n in names:
        one = area(moved.withColumn(n, F.col(f"{n}__shuffled"))).select(F.lit(n).alias("feature"), "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out.select("feature", (base - F.col("roc_auc")).alias("importance"))


@query("model_return_ranker")
def return_ranker(spark, sf):
    from wardpanel.operators import panel as p
    from wardpanel.queries.panel import bars

    made = p.evaluate(bars(spark, sf), {"a": p.ts_mean("volume", 5), "b": p.delta("volume", 2), "label": p.delta("volume", 1) - p.delay("volume", 2)})
    ready = cut_lineage(ev.prepare_training_panel(made, ["a", "b"], "label"))
    model = md.fit_return_ranker(ready.where("datetime < '1999-01-01'"), ["a", "b"], "label")
    scored = model.transform(ready.where("datetime >= '1999-01-01'")).select("datetime", "instrument", "signal", "label")
    return ev.ic_summary(ev.daily_ic(scored, "signal", "label"))

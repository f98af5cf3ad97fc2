"""Code ontologies, cross maps and knowledge graphs as edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardpanel.functions import codes as cd
from wardpanel.operators.order import positions, top_per_group
from wardpanel.session import cut_lineage


# ---- ontologies ----------------------------------------------------------------------------------


def lookup(codes: DataFrame, nodes: DataFrame, attribute: str, code: str = "code") -> DataFrame:
    """Attribute of each code and whether the code is known."""
    known = nodes.select(F.col("code").alias(code), F.col(attribute), F.lit(1).alias("known"))
    return codes.join(known, code, "left").withColumn("known", F.coalesce("known", F.lit(0)))


def closure(codes: DataFrame, edges: DataFrame, max_depth: int | None = None, code: str = "code") -> DataFrame:
    """(code, other, distance): everything reachable along from -> to edges, with the shortest distance.

    Breadth-first over all start codes at once until a level is empty; each level is written to the checkpoint folder
    before the next.  With `max_depth`, a deeper chain is an error, not a shorter result.
    """
    step = edges.select(F.col("from").alias("__at"), F.col("to").alias("other")).distinct()
    level = codes.select(code).distinct().join(step, F.col(code) == F.col("__at")).select(code, "other").distinct()
    level = cut_lineage(level.where(F.col(code) != F.col("other")).withColumn("distance", F.lit(1)))
    seen, depth = level, 1
    while True:
        depth += 1
        nxt = level.select(code, F.col("other").alias("__at")).join(step, "__at").select(code, "other").distinct()
        nxt = nxt.where(F.col(code) != F.col("other")).join(seen.select(code, "other"), [code, "other"], "left_anti")
        level = cut_lineage(nxt.withColumn("distance", F.lit(depth)))
        if level.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"codes lie more than {max_depth} steps apart")
        seen = seen.unionByName(level)


def ancestors(codes: DataFrame, ontology: DataFrame, max_depth: int | None = None) -> DataFrame:
    """ontology: child, parent.  Order the result by (distance, other)."""
    return closure(codes, ontology.select(F.col("child").alias("from"), F.col("parent").alias("to")), max_depth)


def descendants(codes: DataFrame, ontology: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(codes, ontology.select(F.col("parent").alias("from"), F.col("child").alias("to")), max_depth)


def cross_map(codes: DataFrame, mapping: DataFrame, standardise=lambda c: c, convert=lambda c: c, keep_unmapped: bool = False) -> DataFrame:
    """codes (code) to (code, target): standardise, look up, convert; several targets give several rows.

    Unmapped codes vanish, or stay as themselves with `keep_unmapped`.
    """
    keyed = codes.withColumn("__k", standardise(F.col("code")))
    m = mapping.select(F.col("source").alias("__k"), convert(F.col("target")).alias("target")).distinct()
    out = keyed.join(m, "__k", "left" if keep_unmapped else "inner")
    return out.withColumn("target", F.coalesce("target", "code") if keep_unmapped else F.col("target")).drop("__k")


def interaction_pairs(pairs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Distinct drug pairs, optionally both sides in an allowed list."""
    out = pairs.select("a", "b").distinct()
    if allowed is None:
        return out
    names = allowed.select("drug").distinct()
    return out.join(names.withColumnRenamed("drug", "a"), "a", "left_semi").join(names.withColumnRenamed("drug", "b"), "b", "left_semi").select("a", "b")


# ---- knowledge graphs ----------------------------------------------------------------------------


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("head").alias("entity")).union(triples.select("tail")).distinct()


def entity_ids(triples: DataFrame) -> DataFrame:
    """(entity, id): rank in sorted names over heads and tails."""
    return positions(entities(triples), ["entity"], name="id")


def relation_ids(triples: DataFrame) -> DataFrame:
    return positions(triples.select("relation").distinct(), ["relation"], name="id")


def graph_counts(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.explode(F.array("head", "tail")).alias("e")).agg(F.countDistinct("e").alias("entities"))
    rest = triples.agg(F.countDistinct("relation").alias("relations"), F.count(F.lit(1)).alias("triples"))
    return ends.select("*", *[rest.select(c).scalar().alias(c) for c in rest.columns])


def undirected(edges: DataFrame, a: str = "head", b: str = "tail", distinct: bool = True) -> DataFrame:
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a)))
    return both.distinct() if distinct else both


def incoming(edges: DataFrame) -> DataFrame:
    """Walk against the edges: from a tail to its heads (the direction of message-passing subgraphs)."""
    return edges.select(F.col("tail").alias("node"), F.col("head").alias("to")).distinct()


#: Rows of a level that are sent to the tasks that hold the edges; a larger level is joined.
SENT_LEVEL = 500_000


def within_hops(adjacency: DataFrame, seeds: DataFrame, hops: int, allowed: DataFrame | None = None, keep_last: bool = True) -> DataFrame:
    """(group, node, hops): nodes within the number of hops of any seed of the group; unknown seeds are skipped.

    adjacency: node, to, repeated rows do no harm; seeds: group, node.  `allowed` (node) limits which neighbours are walked to.  A level
    is written before the next one; without `keep_last` the last one is not, for callers that read the result once.
    """
    def sent(few: DataFrame) -> DataFrame:
        return F.broadcast(few) if few.limit(SENT_LEVEL + 1).count() <= SENT_LEVEL else few

    start = seeds.select("group", "node").distinct()
    ends = adjacency.select("node").union(adjacency.select(F.col("to")))
    known = ends.join(sent(start.select("node").distinct()), "node", "left_semi").distinct()
    level = cut_lineage(start.join(known, "node", "left_semi").withColumn("hops", F.lit(0)))
    seen = level
    for h in range(1, hops + 1):
        nxt = adjacency.select("node", "to").join(sent(level.select("group", "node")), "node").select("group", F.col("to").alias("node")).distinct()
        if allowed is not None:
            nxt = nxt.join(allowed.select("node"), "node", "left_semi").select("group", "node")
        nxt = nxt.join(seen.select("group", "node"), ["group", "node"], "left_anti").withColumn("hops", F.lit(h))
        level = cut_lineage(nxt) if keep_last or h < hops else nxt
        seen = seen.unionByName(level)
    return seen


def neighbours(triples: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Entities within the hops of each seed, the seed itself left out."""
    return within_hops(undirected(triples), seeds, hops).where("hops > 0")


def subgraph_nodes(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(group, node, hops) of the subgraph around the seeds; hops = 0 marks a seed."""
    return within_hops(incoming(edges), seeds, hops)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes of the group."""
    ends = nodes.select("group", F.col("node").alias("head"))
    inside = edges.join(ends, "head")
    return inside.join(nodes.select("group", F.col("node").alias("tail")), ["group", "tail"]).select("group", *edges.columns)


def pruned_nodes(nodes: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """Seeds first, then the other nodes by id, at most `limit` per group (a parameter of the feature)."""
    keyed = nodes.join(ids.withColumnRenamed("entity", "node"), "node")
    return top_per_group(keyed, ["group"], [F.expr("CASE WHEN hops = 0 THEN 0 ELSE 1 END"), F.col("id")], limit, "__rank").drop("__rank")


def nodes_within_steps(adjacency: DataFrame, labels: DataFrame, seeds: DataFrame, steps: int, wanted: Sequence[str] = (), block: bool = False) -> DataFrame:
    """(group, node): nodes within the steps, with a wanted label; with `block` the walk only passes wanted labels."""
    keep = labels.where(F.col("label").isin(list(wanted))).select("node") if block and wanted else None
    found = within_hops(adjacency, seeds, steps, keep, keep_last=False).where("hops > 0").select("group", "node")
    return filter_label(found, labels, wanted) if wanted and not block else found


def nodes_for_all_seeds(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that every seed reaches (groups are single seeds)."""
    n = seeds.select("group").distinct().count()
    return found.groupBy("node").agg(F.countDistinct("group").alias("n")).where(F.col("n") == n).select("node")


def filter_label(nodes: DataFrame, labels: DataFrame, wanted: Sequence[str]) -> DataFrame:
    keep = labels.where(F.col("label").isin(list(wanted))).select("node")
    return nodes.join(keep, "node", "left_semi")


def sample_neighbours(edges: DataFrame, seeds: DataFrame, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """(hop, node, to): at most `size` neighbours per node and hop, chosen by hash; all neighbours when size < 0."""
    frontier, out = seeds.select("node").distinct(), None
    for hop, size in enumerate(sizes):
        picked = edges.select("node", "to").distinct().join(frontier, "node")
        if size >= 0:
            h = F.md5(F.concat_ws("-", F.col("node").cast("string"), F.col("to").cast("string"), F.lit(f"{seed}-{hop}")).cast("binary"))
            picked = top_per_group(picked, ["node"], [h, F.col("to")], size, "__r").drop("__r")
        picked = cut_lineage(picked.withColumn("hop", F.lit(hop)).select("hop", "node", "to"))
        out = picked if out is None else out.unionByName(picked)
        frontier = frontier.union(picked.select(F.col("to").alias("node"))).distinct()
    return out


def link_truth(triples: DataFrame) -> DataFrame:
    """Per triple: number of true heads for (relation, tail), true tails for (head, relation), and the sampling weight.

    The sets themselves are the rows of the distinct triples; `truth_heads` and `truth_tails` list them.
    """
    distinct = triples.select("head", "relation", "tail").distinct()
    heads = distinct.groupBy("relation", "tail").agg(F.count(F.lit(1)).alias("n_heads"))
    tails = distinct.groupBy("head", "relation").agg(F.count(F.lit(1)).alias("n_tails"))
    by_head = triples.groupBy("head", "relation").agg((F.count(F.lit(1)) + 3).alias("__h"))
    by_tail = triples.groupBy("tail", "relation").agg((F.count(F.lit(1)) + 3).alias("__t"))
    out = triples.join(heads, ["relation", "tail"]).join(tails, ["head", "relation"]).join(by_head, ["head", "relation"]).join(by_tail, ["tail", "relation"])
    return out.withColumn("weight", F.sqrt(1 / (F.col("__h") + F.col("__t")))).drop("__h", "__t")


def truth_heads(triples: DataFrame) -> DataFrame:
    return triples.select("head", "relation", "tail").distinct().groupBy("relation", "tail").agg(F.sort_array(F.collect_list("head")).alias("heads"))


def truth_tails(triples: DataFrame) -> DataFrame:
    return triples.select("head", "relation", "tail").distinct().groupBy("head", "relation").agg(F.sort_array(F.collect_list("tail")).alias("tails"))


def co_prescription(rows: DataFrame, group: str = "visit_id", drug: str = "drug") -> DataFrame:
    """Symmetric (a, b): drugs that share a visit.

    The result is the adjacency itself, at most vocabulary squared.  Equal drug lists are merged first, and the pairs of a
    list are folded into the distinct aggregate before any shuffle.
    """
    lists = rows.select(group, drug).distinct().groupBy(group).agg(F.sort_array(F.collect_list(drug)).alias("d")).select("d").distinct()
    first = lists.where(F.size("d") > 1).select("d", F.posexplode("d").alias("i", "a"))
    later = first.select("a", F.explode(F.slice("d", F.col("i") + 2, F.size("d"))).alias("b")).distinct()
    return later.union(later.select("b", "a")).distinct()


def interaction_adjacency(pairs: DataFrame, vocabulary: DataFrame, level: int = 3) -> DataFrame:
    """Symmetric pairs of codes cut to the level, both in the vocabulary."""
    cut = pairs.select(cd.atc(F.col("a"), level).alias("a"), cd.atc(F.col("b"), level).alias("b")).distinct()
    kept = interaction_pairs(cut, vocabulary.select(F.col("token").alias("drug")))
    return kept.union(kept.select("b", "a")).distinct()

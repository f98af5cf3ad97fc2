"""Evaluation of prediction tables.

Scores are reduced to counts per distinct value before any ordering, and orderings go through
`running_totals`, so a class, label or score that holds a third of the rows is no obstacle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardpanel.operators.order import large, positions, running_totals, top_per_group
from wardpanel.session import cut_lineage


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1.0).otherwise(0.0))


def _div(a: Column, b: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    return first.select("*", *[o.select(c).scalar().alias(c) for o in others for c in o.columns])


# ---- binary --------------------------------------------------------------------------------------


def confusion(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    t, p = F.col(y) == 1, F.col(pred) == 1
    aggs = [_n(t & p).alias("tp"), _n(~t & p).alias("fp"), _n(t & ~p).alias("fn"), _n(~t & ~p).alias("tn")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def binary_scores(df: DataFrame, y: str = "y", prob: str = "prob", threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    c = confusion(df.withColumn("__pred", (F.col(prob) >= threshold).cast("int")), by, y, "__pred")
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    acc = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(
        *by, acc.alias("accuracy"), ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
        _div(acc - chance, 1 - chance).alias("cohen_kappa"), _div(tp, tp + fp + fn).alias("jaccard"),
    )


def ranking_areas(df: DataFrame, by: Sequence[str] = (), y: str = "y", prob: str = "prob") -> DataFrame:
    """roc_auc (ties count half) and pr_auc (step-wise average precision) per group; null without both classes."""
    by = list(by)
    pos = F.col(y) == 1
    counts = df.groupBy(*by, (-F.col(prob)).alias("__s")).agg(F.sum(F.when(pos, 1).otherwise(0)).alias("__p"), F.sum(F.when(pos, 0).otherwise(1)).alias("__q"))
    counts = cut_lineage(counts)  # the running totals read them several times
    run = running_totals(counts, ["__s"], {"__tp": F.col("__p"), "__fp": F.col("__q")}, by)
    tp, seen = F.col("__tp") + F.col("__p"), F.col("__tp") + F.col("__p") + F.col("__fp") + F.col("__q")
    step = run.withColumns({"__area": F.col("__q") * (F.col("__tp") + F.col("__p") / 2), "__ap": F.col("__p") * (tp / seen)})
    total = step.groupBy(*by) if by else step.groupBy()
    out = total.agg(F.sum("__area").alias("a"), F.sum("__ap").alias("b"), F.sum("__p").alias("p"), F.sum("__q").alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(
        *by, F.when(both, F.try_divide(F.col("a"), F.col("p") * F.col("q"))).alias("roc_auc"),
        F.when(F.col("p") > 0, F.try_divide(F.col("b"), F.col("p"))).alias("pr_auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


# ---- multiclass ----------------------------------------------------------------------------------


def argmax(probs: Column) -> Column:
    """Index of the first largest entry."""
    return F.array_position(probs, F.array_max(probs)) - 1


def class_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class: tp, fp, fn and the number of true rows."""
    pairs = df.groupBy(F.col(y).cast("bigint").alias("y"), F.col(pred).cast("bigint").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("y").alias("k"), F.lit(True).alias("t")), F.struct(F.col("p").alias("k"), F.lit(False).alias("t")))
    rows = pairs.select("n", (F.col("y") == F.col("p")).alias("ok"), F.explode(sides).alias("s"))
    t, ok = F.col("s.t"), F.col("ok")
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("double")
    return rows.groupBy(F.col("s.k").alias("k")).agg(part(t & ok).alias("tp"), part(~t & ~ok).alias("fp"), part(t & ~ok).alias("fn"), part(t).alias("support"))


def multiclass_scores(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    c = class_counts(df, y, pred)
    tp, fp, fn, s = (F.col(n) for n in ("tp", "fp", "fn", "support"))
    f1, jac = _div(2 * tp, 2 * tp + fp + fn), _div(tp, tp + fp + fn)
    total = F.sum(s)
    acc = F.sum(tp) / total
    chance = F.sum(s * (tp + fp)) / (total * total)
    return c.agg(
        acc.alias("accuracy"), F.avg(F.when(s > 0, tp / s)).alias("balanced_accuracy"),
        (2 * F.sum(tp) / (2 * F.sum(tp) + F.sum(fp) + F.sum(fn))).alias("f1_micro"), F.avg(f1).alias("f1_macro"), (F.sum(f1 * s) / total).alias("f1_weighted"),
        (F.sum(tp) / (F.sum(tp) + F.sum(fp) + F.sum(fn))).alias("jaccard_micro"), F.avg(jac).alias("jaccard_macro"), (F.sum(jac * s) / total).alias("jaccard_weighted"),
        _div(acc - chance, 1 - chance).alias("cohen_kappa"),
    )


def multiclass_areas(df: DataFrame, classes: int, y: str = "y", probs: str = "prob") -> DataFrame:
    """One-vs-rest and one-vs-one areas, macro and weighted by class frequency.

    Per class score, counts of every true class are kept, so no class pairs are expanded over the rows.
    """
    long = df.select(F.col(y).alias("y"), F.posexplode(probs).alias("k", "s"))
    counts = long.groupBy("k", "s").agg(*[F.sum(F.when(F.col("y") == c, 1).otherwise(0)).alias(f"c{c}") for c in range(classes)])
    run = running_totals(counts, ["s"], {f"b{c}": F.col(f"c{c}") for c in range(classes)}, ["k"])
    own = F.coalesce(*[F.when(F.col("k") == c, F.col(f"c{c}")) for c in range(classes)])
    parts = [F.sum(own * (F.col(f"b{c}") + F.col(f"c{c}") / 2)).alias(f"u{c}") for c in range(classes)]
    sizes = [F.sum(f"c{c}").alias(f"n{c}") for c in range(classes)]
    per = run.groupBy("k").agg(*parts, *sizes)
    arr = lambda p: F.array(*[F.col(f"{p}{c}").cast("double") for c in range(classes)])
    per = per.select("k", arr("u").alias("u"), arr("n").alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, v: a + v)
    mine = F.get("n", F.col("k"))
    rest = F.aggregate(F.transform("u", lambda v, i: F.when(i == F.col("k"), F.lit(0.0)).otherwise(v)), F.lit(0.0), lambda a, v: a + v)
    ovr = F.try_divide(rest, mine * (total - mine))
    pair = F.transform("u", lambda v, i: F.when((i != F.col("k")) & (mine > 0) & (F.get("n", i) > 0), F.struct(
        F.try_divide(v, mine * F.get("n", i)).alias("a"), (mine + F.get("n", i)).alias("w"))))
    rows = per.select(ovr.alias("ovr"), (mine / total).alias("share"), F.filter(pair, lambda x: x.isNotNull()).alias("pairs"))
    flat = rows.withColumns({
        "pa": F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["a"]), "pn": F.size("pairs").cast("double"),
        "wa": F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["a"] * x["w"]), "ww": F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["w"]),
    })
    return flat.agg(
        F.avg("ovr").alias("roc_auc_macro_ovr"), F.sum(F.col("ovr") * F.col("share")).alias("roc_auc_weighted_ovr"),
        F.try_divide(F.sum("pa"), F.sum("pn")).alias("roc_auc_macro_ovo"), F.try_divide(F.sum("wa"), F.sum("ww")).alias("roc_auc_weighted_ovo"))


def true_rank(probs: Column, y: Column) -> Column:
    """1-based rank of the true class, earlier classes first on ties."""
    own = F.get(probs, y.cast("int"))
    above = F.aggregate(
        F.transform(probs, lambda p, i: F.when((p > own) | ((p == own) & (i < y)), 1).otherwise(0)), F.lit(0), lambda a, v: a + v)
    return above + 1


def hit_rates(df: DataFrame, y: str = "y", probs: str = "prob") -> DataFrame:
    ranked = df.select(true_rank(F.col(probs), F.col(y)).alias("r"))
    hit = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0))
    return ranked.agg(hit(1).alias("hits_1"), hit(5).alias("hits_5"), hit(10).alias("hits_10"), F.avg("r").alias("mean_rank"), F.avg(1 / F.col("r")).alias("mean_reciprocal_rank"))


def log_loss(df: DataFrame, y: str = "y", probs: str = "prob", eps: float = 2.220446049250313e-16) -> DataFrame:
    """Mean negative log of the clipped probability of the true class."""
    p = F.get(probs, F.col(y).cast("int"))
    return df.agg(F.avg(-F.ln(F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p)))).alias("log_loss"))


# ---- multilabel ----------------------------------------------------------------------------------


def label_rows(df: DataFrame, key: str, y: str = "y", probs: str = "prob") -> DataFrame:
    """(key, k, y, prob): one row per sample and label."""
    z = F.arrays_zip(F.col(y).alias("y"), F.col(probs).alias("prob"))
    return df.select(key, F.posexplode(z).alias("k", "z")).select(key, "k", F.col("z.y").alias("y"), F.col("z.prob").alias("prob"))


def multilabel_areas(rows: DataFrame, key: str) -> DataFrame:
    micro = ranking_areas(rows).select(F.col("roc_auc").alias("roc_auc_micro"), F.col("pr_auc").alias("pr_auc_micro"))
    per = ranking_areas(rows, ["k"])
    weight = lambda c: F.try_divide(F.sum(F.col(c) * F.col("positives")), F.sum("positives"))
    macro = per.agg(F.avg("roc_auc").alias("roc_auc_macro"), F.avg("pr_auc").alias("pr_auc_macro"), weight("roc_auc").alias("roc_auc_weighted"), weight("pr_auc").alias("pr_auc_weighted"))
    each = ranking_areas(rows, [key]).agg(F.avg("roc_auc").alias("roc_auc_samples"), F.avg("pr_auc").alias("pr_auc_samples"))
    return side_by_side(micro, macro, each)


def multilabel_scores(rows: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
    marked = rows.withColumn("pred", (F.col("prob") >= threshold).cast("int"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    score = {
        "f1": _div(2 * tp, 2 * tp + fp + fn), "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "jaccard": _div(tp, tp + fp + fn),
    }
    total = confusion(marked)
    n = tp + fp + fn + F.col("tn")
    micro = total.select(*[c.alias(f"{m}_micro") for m, c in score.items()], ((tp + F.col("tn")) / n).alias("accuracy"), ((fp + fn) / n).alias("hamming_loss"))
    per = confusion(marked, ["k"])
    macro = per.agg(*[F.avg(c).alias(f"{m}_macro") for m, c in score.items()], *[_div(F.sum(c * (tp + fn)), F.sum(tp + fn)).alias(f"{m}_weighted") for m, c in score.items()])
    each = confusion(marked, [key]).agg(*[F.avg(c).alias(f"{m}_samples") for m, c in score.items()])
    return side_by_side(micro, macro, each)


def set_hits(df: DataFrame, y: str = "y", predset: str = "predset") -> DataFrame:
    """Mean true and false positives of prediction sets against multi-label truth."""
    pairs = F.zip_with(predset, y, lambda p, t: F.struct(p.cast("int").alias("p"), t.cast("int").alias("t")))
    count = lambda want: F.aggregate(F.transform(pairs, lambda x: F.when((x["p"] == 1) & (x["t"] == want), 1).otherwise(0)), F.lit(0), lambda a, v: a + v)
    return df.agg(F.avg(count(1)).alias("tp"), F.avg(count(0)).alias("fp"))


# ---- regression ----------------------------------------------------------------------------------


def regression_scores(df: DataFrame, x: str = "x", rec: str = "rec") -> DataFrame:
    """Divergence of the normalised clipped values, squared and absolute error, from one aggregate.

    sum(q log(q / p)) with p = a / A and q = b / B is sum(b log(b / a)) / B - log(B / A).
    """
    clip = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    a, b = clip(x), clip(rec)
    s = df.agg(
        F.sum(b * F.ln(b / a)).alias("t"), F.sum(a).alias("A"), F.sum(b).alias("B"),
        F.avg((F.col(x) - F.col(rec)) * (F.col(x) - F.col(rec))).alias("mse"), F.avg(F.abs(F.col(x) - F.col(rec))).alias("mae"))
    return s.select((F.col("t") / F.col("B") - F.ln(F.col("B") / F.col("A"))).alias("kl_divergence"), "mse", "mae")


# ---- calibration ---------------------------------------------------------------------------------


def equal_width_bin(conf: Column, bins: int) -> Column:
    """Bins closed on the right edge value of the lower bin: an exact edge belongs to the lower side of the next one."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < conf))


def equal_mass_bins(df: DataFrame, conf: str, key: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds `bin`: equal counts in order of confidence, the remainder goes to the last bins."""
    by = list(by)
    ranked = positions(df, [conf, *key], by, "__pos")
    size = F.count(F.lit(1)).alias("__n")
    joined = ranked.join(df.groupBy(*by).agg(size), by) if by else ranked.withColumn("__n", df.agg(size).scalar())
    step, extra = F.floor(F.col("__n") / bins), F.col("__n") % bins
    plain = (bins - extra) * step
    low = F.when(step > 0, F.floor(F.try_divide(F.col("__pos"), step)))
    high = bins - extra + F.floor((F.col("__pos") - plain) / (step + 1))
    return joined.withColumn("bin", F.when(F.col("__pos") < plain, low).otherwise(high).cast("int")).drop("__pos", "__n")


def calibration_error(binned: DataFrame, by: Sequence[str] = (), conf: str = "conf", acc: str = "acc") -> DataFrame:
    """Count-weighted gap between confidence and accuracy over bins."""
    per = binned.groupBy(*by, "bin").agg(F.avg(conf).alias("c"), F.avg(F.col(acc).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    gap = (F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece")
    return per.groupBy(*by).agg(gap) if by else per.agg(gap)


def top_confidence(df: DataFrame, y: str = "y", probs: str = "prob") -> DataFrame:
    return df.withColumns({"conf": F.array_max(probs), "acc": (argmax(F.col(probs)) == F.col(y)).cast("int")})


def ece(df: DataFrame, bins: int = 20, adaptive: bool = False, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    if adaptive:
        return calibration_error(equal_mass_bins(df, "conf", key, bins))
    return calibration_error(df.withColumn("bin", equal_width_bin(F.col("conf"), bins)))


def ece_classwise(df: DataFrame, bins: int = 20, threshold: float = 0.0, adaptive: bool = False, key: str = "sample_id", y: str = "y", probs: str = "prob") -> DataFrame:
    """Mean over classes of the calibration error of the class probability."""
    rows = df.select(key, F.col(y).alias("__y"), F.posexplode(probs).alias("k", "conf")).where(F.col("conf") >= threshold)
    rows = rows.withColumn("acc", (F.col("k") == F.col("__y")).cast("int"))
    binned = equal_mass_bins(rows, "conf", [key], bins, ["k"]) if adaptive else rows.withColumn("bin", equal_width_bin(F.col("conf"), bins))
    return calibration_error(binned, ["k"]).agg(F.avg("ece").alias("ece"))


def brier_top(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("conf") - F.col("acc")) * (F.col("conf") - F.col("acc"))).alias("brier_top1"))


# ---- prediction sets -----------------------------------------------------------------------------


def set_scores(df: DataFrame, y: str = "y", predset: str = "predset") -> DataFrame:
    size = F.size(F.filter(predset, lambda b: b))
    rows = df.select(size.alias("s"), F.get(predset, F.col(y).cast("int")).cast("double").alias("hit"))
    one = F.col("s") == 1
    return rows.agg(
        F.avg("s").alias("set_size"), F.avg(F.when(one, 0.0).otherwise(1.0)).alias("rejection_rate"),
        (1 - F.avg("hit")).alias("miscoverage_overall"), F.coalesce(1 - F.avg(F.when(one, F.col("hit"))), F.lit(0.0)).alias("error_overall"))


def set_scores_by_class(df: DataFrame, classes: int, y: str = "y", predset: str = "predset") -> DataFrame:
    """Miscoverage and error per class (0 for a class without rows)."""
    size = F.size(F.filter(predset, lambda b: b))
    rows = df.select(F.col(y).cast("bigint").alias("k"), size.alias("s"), F.get(predset, F.col(y).cast("int")).cast("double").alias("hit"))
    per = rows.groupBy("k").agg((1 - F.avg("hit")).alias("m"), (1 - F.avg(F.when(F.col("s") == 1, F.col("hit")))).alias("e"))
    ks = df.sparkSession.range(classes).withColumnRenamed("id", "k")
    return ks.join(per, "k", "left").select("k", F.coalesce("m", F.lit(0.0)).alias("miscoverage"), F.coalesce("e", F.lit(0.0)).alias("error"))


# ---- fairness ------------------------------------------------------------------------------------


def protected_flag(predictions: DataFrame, patients: DataFrame, attribute: str, group: str, key: str = "patient_id") -> DataFrame:
    flag = patients.select(key, (F.col(attribute) == group).cast("int").alias("__f"))
    return predictions.join(flag, key, "left").withColumn("sensitive", F.coalesce("__f", F.lit(0))).drop("__f")


def fairness(df: DataFrame, pred: str = "pred", favorable: int = 1, epsilon: float | None = None) -> DataFrame:
    """Disparate impact and parity difference; a zero unprotected rate is an error unless `epsilon` is given."""
    rate = lambda s: F.avg(F.when(F.col("sensitive") == s, F.when(F.col(pred) == favorable, 1.0).otherwise(0.0)))
    r = df.agg(rate(1).alias("p"), rate(0).alias("u"))
    zero = F.lit(epsilon) if epsilon is not None else F.raise_error("no favourable outcome in the unprotected group").cast("double")
    base = F.when(F.col("u") == 0, zero).otherwise(F.col("u"))
    return r.select(F.try_divide(F.col("p"), base).alias("disparate_impact"), (F.col("p") - F.col("u")).alias("statistical_parity_difference"))


# ---- drugs and retrieval -------------------------------------------------------------------------


#: Rows of a sample whose pairs are listed inside its row, and interacting pairs that are sent to all tasks.
LIST_ROWS, SENT_PAIRS = 1000, 500_000


def interaction_rate(rows: DataFrame, pairs: DataFrame, key: str = "sample_id", drug: str = "drug") -> DataFrame:
    """Share of drug pairs of a sample that interact; 0 when there is no pair.

    The number of pairs comes from the list sizes.  A sample of up to `LIST_ROWS` rows is one row that lists its own pairs; in a longer
    one only interacting partners are joined, never all pairs.
    """
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    apart = cut_lineage(pairs.where(known).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = apart.count() <= SENT_PAIRS
    sized = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    size = sized.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("all"), F.max("n").alias("longest")).first()
    named = rows.where(F.col(key).isNotNull() & F.col(drug).isNotNull()).select(key, F.col(drug).alias("a"))
    crowded = (size["longest"] or 0) > LIST_ROWS
    long = sized.where(F.col("n") > LIST_ROWS).select(key)
    short = named.join(long, key, "left_anti") if crowded else named
    lists = short.groupBy(key).agg(F.sort_array(F.collect_list("a")).alias("x")).where(F.size("x") > 1)
    own = lists.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))
    if few:
        listed = own.join(F.broadcast(apart), ["a", "b"]).agg(F.count(F.lit(1)).cast("double").alias("hit"))
    else:
        listed = large(own.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))).join(large(apart), ["a", "b"]).agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("hit"))
    if crowded:
        both = apart.union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        counts = named.join(long, key, "left_semi").groupBy(key, "a").agg(F.count(F.lit(1)).alias("na"))
        partner = counts.join(both, "a").select(key, "na", "a", F.col("b"))
        hits = large(partner).join(large(counts.select(key, F.col("a").alias("b"), F.col("na").alias("nb"))), [key, "b"])
        same = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
        listed = listed.union(hits.agg(F.coalesce(F.sum(same) / 2, F.lit(0.0)).alias("hit")))
    return listed.agg(F.sum("hit").alias("hit")).select(_div(F.col("hit"), F.lit(float(size["all"] or 0.0))).alias("ddi_rate"))


def retrieval_scores(results: DataFrame, qrels: DataFrame, ks: Sequence[int], query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """NDCG, MAP, recall and precision at each k, averaged over the queries that have judgements and results; 5 decimals."""
    top = max(ks)
    judged = qrels.where(F.col("relevance") > 0)
    queries = results.select(query).distinct().join(qrels.select(query).distinct(), query, "left_semi")
    ranked = top_per_group(results.join(queries, query, "left_semi"), [query], [F.desc("score"), F.desc(doc)], top)
    hits = ranked.join(judged.select(query, doc, "relevance"), [query, doc], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    ideal = top_per_group(judged, [query], [F.desc("relevance"), F.col(doc)], top, "rank")
    total = judged.groupBy(query).agg(F.count(F.lit(1)).alias("R"))
    listed = hits.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", "rel"))).alias("h"))
    best = ideal.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("relevance").alias("rel")))).alias("i"))
    rows = queries.join(listed, query, "left").join(best, query, "left").join(total, query, "left")
    add = lambda arr, fn: F.coalesce(F.aggregate(F.transform(arr, fn), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    gain = lambda k: lambda x: F.when(x["rank"] <= k, x["rel"] / F.log2(x["rank"] + F.lit(1.0))).otherwise(F.lit(0.0))
    hit = lambda k: lambda x: F.when((x["rank"] <= k) & (x["rel"] > 0), F.lit(1.0)).otherwise(F.lit(0.0))

    def average_precision(k):
        # hits so far come from the list itself, which has at most max(ks) entries
        before = lambda x: F.size(F.filter("h", lambda z: (z["rank"] <= x["rank"]) & (z["rel"] > 0)))
        return add("h", lambda x: F.when((x["rank"] <= k) & (x["rel"] > 0), before(x) / x["rank"]).otherwise(F.lit(0.0)))

    r = F.coalesce("R", F.lit(0))
    cols = []
    for k in ks:
        cols += [
            F.round(F.avg(_div(add("h", gain(k)), add("i", gain(k)))), 5).alias(f"ndcg_{k}"), F.round(F.avg(_div(average_precision(k), r)), 5).alias(f"map_{k}"),
            F.round(F.avg(_div(add("h", hit(k)), r)), 5).alias(f"recall_{k}"), F.round(F.avg(add("h", hit(k)) / k), 5).alias(f"p_{k}"),
        ]
    return rows.agg(*cols)


# ---- comparisons ---------------------------------------------------------------------------------


def score_deltas(scores: DataFrame, keys: Sequence[str], base: str = "baseline", other: str = "combined") -> DataFrame:
    """combined minus baseline per key, from rows (keys, variant, value)."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))
    out = scores.groupBy(*keys).agg(pick(base).alias("baseline"), pick(other).alias("combined"))
    return out.where(F.col("baseline").isNotNull() & F.col("combined").isNotNull()).withColumn("delta", F.col("combined") - F.col("baseline"))


def best_by_direction(scores: DataFrame, group: str, bigger_is_better: Column) -> DataFrame:
    """Best run per group, larger or smaller first as the metric asks."""
    signed = F.when(bigger_is_better, F.col("value")).otherwise(-F.col("value"))
    return scores.groupBy(group).agg(F.max_by(F.struct("run", "value"), F.struct(signed, -F.col("run"))).alias("b")).select(group, F.col("b.run").alias("run"), F.col("b.value").alias("value"))


def shuffled_column(df: DataFrame, key: str, column: str, seed: int = 0) -> DataFrame:
    """The column permuted over the rows in hash order (for permutation importance)."""
    out = shuffled_columns(df, key, [column], seed)
    return out.drop(column).withColumnRenamed(f"{column}__shuffled", column)


def shuffled_columns(df: DataFrame, key: str, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """As `shuffled_column` for several columns by one order, each beside the original as `<column>__shuffled`."""
    h, n = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), df.count()
    left = positions(df.withColumn("__k", F.col(key)), ["__k"], name="__a", largest=n)
    moved = [F.col(c).alias(f"{c}__shuffled") for c in columns]
    right = positions(df.select(h.alias("__h"), F.col(key).alias("__k2"), *moved), ["__h", "__k2"], name="__b", largest=n)
    return left.join(right, F.col("__a") == F.col("__b")).drop("__a", "__b", "__h", "__k", "__k2")

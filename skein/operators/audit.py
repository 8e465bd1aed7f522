"""Compression audits and edge evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.entropy import embedding_entropy, purity_entropy
from skein.operators.ranking import bucketed_row_number, falling
from skein.operators.storage import written
from skein.operators.vectors import centroid, cosine


def entropy_profile(vectors: DataFrame, group: str, vector: str, tokens: str) -> DataFrame:
    """CA-1. Per group: entropy, centroid (not normalized), count, tokens."""
    sums = vectors.groupBy(group).agg(F.sum(tokens).alias("tokens"))
    return embedding_entropy(vectors, group, vector).join(centroid(vectors, group, vector), group).join(sums, group)


def compression_audit(source: DataFrame, summary: DataFrame, group: str, vector: str, level: str, entropy: str = "purity_entropy") -> DataFrame:
    """CA-2. Entropy of the summary over that of the source against .70, .40, .15 by level, and the
    cosine of the centroids against .60: strong, weak, or degenerate where there is no ratio."""
    side = lambda rows, tag: purity_entropy(rows, group, vector).join(centroid(rows, group, vector), group).toDF(group, f"h_{tag}", f"c_{tag}")
    both = side(source, "a").join(side(summary, "b"), group).join(summary.groupBy(group).agg(F.max(level).alias("level")), group)
    ratio = F.try_divide(F.col("h_b"), F.when(F.col("h_a") > 1e-12, F.col("h_a")))
    least = F.when(F.col("level") == 1, 0.70).when(F.col("level") == 2, 0.40).otherwise(0.15)
    rated = both.withColumn("ratio", ratio).withColumn("similarity", cosine(F.col("c_a"), F.col("c_b")))
    verdict = F.when(F.col("ratio").isNull(), "degenerate").when((F.col("ratio") >= least) & (F.col("similarity") >= 0.60), "strong").otherwise("weak")
    return rated.select(group, "level", "ratio", "similarity", verdict.alias("verdict"))


def audit_rates(audits: DataFrame, order: str, n: int = 100) -> DataFrame:
    """CA-3. Of the last n audits: share of weak ones, mean ratio of those that have one."""
    return audits.orderBy(F.desc(order)).limit(n).agg(F.avg((F.col("verdict") == "weak").cast("double")).alias("weak_share"), F.avg("ratio").alias("mean_ratio"))


def axiom_preservation(present: DataFrame, summaries: DataFrame, rules: DataFrame, least: float = 0.45) -> DataFrame:
    """CA-4. For each rule that a source has: is the cosine of summary and rule at least ``least``?
    (id, mean score, lost rules, valid). present: id, rule; summaries: id, sv; rules: rule, rv."""
    scored = present.join(summaries, "id").join(rules, "rule").withColumn("score", cosine(F.col("sv"), F.col("rv")))
    lost = F.sort_array(F.collect_list(F.when(F.col("score") < least, F.col("rule"))))
    return scored.groupBy("id").agg(F.avg("score").alias("score"), F.array_join(lost, ",").alias("lost")).withColumn("valid", F.col("lost") == "")


#: Signed contributions of a signal to an edge's fitness. Fixed values.
FITNESS = {"gap-bridge": 1.0, "component-reduction": 0.8, "cycle-reduction": 0.8, "cdp-rise": 0.5, "weak-audit": -0.6}
#: Signals that reach recent edges only, and those that reach all; the rest reach bridge nodes.
RECENT, EVERY = ["component-reduction", "cdp-rise", "weak-audit"], ["cycle-reduction"]


def edge_fitness(edges: DataFrame, signals: DataFrame, bridges: DataFrame, since: int) -> DataFrame:
    """PE-1. (src, dst, fitness, reasons) from the signals (kind) of a cycle. Signals are a handful
    of kinds, so they are summed to one row before they meet the edges."""
    kinds = {r[0] for r in signals.select("kind").distinct().limit(len(FITNESS) + 1).collect()}
    marked = edges.join(bridges.select(F.col("node").alias("src"), F.lit(True).alias("bs")), "src", "left").join(bridges.select(F.col("node").alias("dst"), F.lit(True).alias("bd")), "dst", "left")
    parts = []
    for kind in sorted(kinds & FITNESS.keys()):
        if kind in EVERY:
            reach = F.lit(True)
        elif kind in RECENT:
            reach = F.col("iteration") >= since
        else:
            reach = F.coalesce("bs", F.lit(False)) | F.coalesce("bd", F.lit(False))
        parts.append(F.when(reach, F.struct(F.lit(kind).alias("kind"), F.lit(FITNESS[kind]).alias("f"))))
    hits = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<kind:string,f:double>>")
    out = marked.withColumn("_h", hits)
    return out.select("src", "dst", F.aggregate("_h", F.lit(0.0), lambda s, h: s + h["f"]).alias("fitness"), F.array_join(F.transform("_h", lambda h: h["kind"]), ",").alias("reasons"), *[c for c in edges.columns if c not in ("src", "dst")])


def learning_rate(rows: DataFrame, base: float = 0.1) -> DataFrame:
    """PE-2. The base rate twofold when nascent, 0.3-fold when stable, else as it is."""
    return rows.withColumn("rate", base * F.when(F.col("regime") == "nascent", 2.0).when(F.col("regime") == "stable", 0.3).otherwise(1.0))


def offspring(edges: DataFrame, alpha: float) -> DataFrame:
    """w = max(.01, 1 + alpha f) and z' = max(0, z (1 + alpha f)) of edges (fitness, z)."""
    grown = 1 + alpha * F.col("fitness")
    return edges.withColumn("w", F.greatest(F.lit(0.01), grown)).withColumn("z1", F.greatest(F.lit(0.0), F.col("z") * grown))


def price_decomposition(edges: DataFrame, alpha: float) -> DataFrame:
    """PE-3. One row: selection Cov(w, z) / mean w, transmission E(w (z' - z)) / mean w, their sum."""
    s = offspring(edges, alpha).agg(F.covar_pop("w", "z").alias("c"), F.avg(F.col("w") * (F.col("z1") - F.col("z"))).alias("t"), F.avg("w").alias("w"))
    return s.select((F.col("c") / F.col("w")).alias("selection"), (F.col("t") / F.col("w")).alias("transmission"), ((F.col("c") + F.col("t")) / F.col("w")).alias("change"))


def evolve_salience(edges: DataFrame, alpha: float, floor: float = 0.05) -> DataFrame:
    """PE-4. z' scaled to a mean of 1, at least ``floor``. The mean is one figure."""
    grown = offspring(edges, alpha)
    mean = grown.agg(F.avg("z1")).first()[0] or 1.0
    return grown.withColumn("salience", F.greatest(F.lit(floor), F.col("z1") / mean))


def salience_ranking(edges: DataFrame) -> DataFrame:
    """PE-5. All edges with their ``place`` from 0, by falling salience, then src and dst. Places are
    dealt out by ranges of the salience."""
    edges = written(edges, "salience")
    return bucketed_row_number(edges, [], falling(edges, "salience"), [F.desc("salience"), "src", "dst"], "place")


def explore_exploit(decomposition: DataFrame) -> DataFrame:
    """PE-6. |transmission| / (|selection| + |transmission|), 0.5 if both are 0."""
    a, b = F.abs("selection"), F.abs("transmission")
    return decomposition.withColumn("explore", F.when(a + b == 0, 0.5).otherwise(F.try_divide(b, a + b)))


def gini(rows: DataFrame, value: str) -> DataFrame:
    """PE-7. Inequality of a non-negative column. Values are counted first, so that the running sum
    is over distinct values, dealt by ranges and carried by range totals."""
    counts = rows.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    low, high = counts.agg(F.min("x"), F.max("x")).first()
    width = ((high or 0) - (low or 0)) / 64 or 1.0
    dealt = counts.withColumn("b", F.floor((F.col("x") - F.lit(low or 0)) / width))
    before = dealt.groupBy("b").agg(F.sum("k").alias("n")).select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("c", inside).join(before, "b").withColumn("first", F.col("start") + F.col("c"))
    # Ranks first + 1 .. first + k of a value sum to k (first + (k + 1) / 2).
    s = ranked.agg(F.sum(F.col("x") * F.col("k") * (F.col("first") + (F.col("k") + 1) / 2)).alias("ix"), F.sum(F.col("x") * F.col("k")).alias("x"), F.sum("k").alias("n"))
    return s.select((2 * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).alias("gini"))

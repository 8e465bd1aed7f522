"""Queries over metric series, entropy, vectors, audits and edge evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import audit as A
from skein.operators import entropy as E
from skein.operators import series as S
from skein.operators import vectors as V
from skein.operators.graph import question_context as question_context_of
from skein.operators.storage import written
from skein.plans.tables import r6, table

KEY = ["series", "iteration"]


def _rows(spark, sf):
    """A series a user, by event: vne is the value, ee a remainder of it."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("series"), F.col("event_id").alias("iteration"), F.col("value").alias("vne"), (F.col("value") * 0.37 % 5).alias("ee"))


ROWS = "r as (select user_id as series, event_id as iteration, value as vne, (value * 0.37::double) % 5 as ee from events)"
DELTAS = ROWS + """, d as (select *, coalesce(vne - lag(vne) over w, 0) as d_vne, coalesce(ee - lag(ee) over w, 0) as d_ee from r window w as (partition by series order by iteration))"""
CORR = DELTAS + """, c as (select *, case when count(*) over w < 10 then 0 when stddev_pop(d_vne) over w * stddev_pop(d_ee) over w < 1e-12 then 0
    else covar_pop(d_vne, d_ee) over w / (stddev_pop(d_vne) over w * stddev_pop(d_ee) over w) end as correlation from d
    window w as (partition by series order by iteration rows between 9 preceding and current row))"""


def deltas(spark, sf):
    return S.deltas(_rows(spark, sf), "vne", "ee").select(*KEY, r6("d_vne").alias("d_vne"), r6("d_ee").alias("d_ee"))


def cdp(spark, sf):
    return S.with_cdp(_rows(spark, sf)).select(*KEY, r6("cdp").alias("cdp"))


def _corr(spark, sf):
    return S.rolling_correlation(_rows(spark, sf))


def rolling_correlation(spark, sf):
    return _corr(spark, sf).select(*KEY, r6("correlation").alias("correlation"))


def phase_transition(spark, sf):
    return S.phase_transition(_corr(spark, sf)).select(*KEY, "is_transition")


def linear_slope(spark, sf):
    return S.linear_slope(_rows(spark, sf), "vne").select("series", r6("slope").alias("slope"))


def metrics_trend(spark, sf):
    return S.metrics_trend(_rows(spark, sf), "vne").select(*KEY, r6("mean").alias("mean"), r6("slope").alias("slope"))


def early_convergence(spark, sf):
    return S.early_convergence(_rows(spark, sf), most_variance=2.0).select(*KEY, "converging")


def confirmed_transition(spark, sf):
    return S.confirmed_transition(_corr(spark, sf).withColumn("h", F.pmod("iteration", F.lit(4)).cast("int")))


def _features(spark, sf):
    return S.with_cdp(_corr(spark, sf)).withColumn("growth", F.when(F.col("d_vne") > 0, 1).otherwise(0))


def regime(spark, sf):
    return S.regime(_features(spark, sf))


def regime_features(spark, sf):
    return S.regime_features(_features(spark, sf)).select(*KEY, r6("cdp_variance").alias("cdp_variance"), r6("correlation_std").alias("correlation_std"), "recent_growth", "status")


def _nodes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"), F.col("embedding").alias("vector"))


def surprising_edges(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("iteration"), F.col("l_returnflag").alias("origin")).distinct()
    return S.surprising_edges(li, _nodes(spark, sf), ["A", "R"]).select("iteration", "proposed", "surprising", "unknown", r6("ratio").alias("ratio"))


def hysteresis_state(spark, sf):
    return S.hysteresis_state(_rows(spark, sf), "ee", 1.0, 4.0).select(*KEY, "state")


def _scores(spark, sf):
    """A score a user and day: the sum of its values, in hundreds."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("iteration")).agg((F.round(F.sum("value"), 4) / 100).alias("score"))


SCORES = "s as (select user_id as series, strftime(ts, '%Y-%m-%d') as iteration, round(sum(value), 4) / 100 as score from events group by all)"
TREND = SCORES + """, lagged as (select *, lag(score, 1) over w as one, lag(score, 2) over w as two from s window w as (partition by series order by iteration)),
t as (select *, case when two is null then 'stable' when abs(one - two) > 0.05 and abs(score - one) > 0.05 and (one - two) * (score - one) < 0 then 'oscillating'
    when abs((score - two) / 2) < 0.05 then 'stable' when score > two then 'rising' else 'falling' end as trend from lagged)"""


def centrality_trend(spark, sf):
    return S.centrality_trend(_scores(spark, sf)).select(*KEY, "trend")


def rapid_change(spark, sf):
    return S.rapid_change(_scores(spark, sf)).select(*KEY, r6("score").alias("score"))


def topology_reorganized(spark, sf):
    return S.topology_reorganized(_scores(spark, sf))


def peak_valley(spark, sf):
    return S.peak_valley(_scores(spark, sf)).select("series", "peak_at", r6("peak").alias("peak"), "valley_at", r6("valley").alias("valley"))


def rising_nodes(spark, sf):
    return S.rising_nodes(_scores(spark, sf), 0.0).select("series", r6("step").alias("step"))


def phase_timings(spark, sf):
    return S.phase_timings(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("total", 2).alias("total"), "rank")


def _edges(spark, sf):
    """Orders and parts: one edge a line."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"), F.col("l_quantity").alias("weight"))


EDGES = """raw as (select l_orderkey as src, -l_partkey - 1 as dst, l_quantity as weight from lineitem),
e as (select least(src, dst) as src, greatest(src, dst) as dst, sum(weight) as weight from raw where src <> dst group by all),
near as (select src as node, dst as other, weight from e union all select dst, src, weight from e),
deg as (select node, sum(weight) as d from near group by node),
t as (select e.*, a.d as di, b.d as dj, weight * weight / (a.d * b.d) as term from e join deg a on a.node = e.src join deg b on b.node = e.dst)"""
_Q = "q as (select (select count(*) from deg) as n, 1 - ((select count(*) from deg) + 2 * sum(term)) / pow((select count(*) from deg), 2) as q from t)"


def _clean(spark, sf):
    return E.normalize_edges(_edges(spark, sf))


def normalize_edges(spark, sf):
    return _clean(spark, sf)


def quadratic_entropy(spark, sf):
    return E.quadratic_entropy(_clean(spark, sf)).select("n", F.round("q", 9).alias("q"))


def entropy_closed_form(spark, sf):
    return E.entropy_closed_form(_clean(spark, sf)).select("n", r6("entropy").alias("entropy"))


def lambda_max(spark, sf):
    value, _, residual = E.lambda_max(written(_clean(spark, sf), "edges"), 1e-6)
    return spark.range(1).select(F.round(F.lit(value * 1e6), 3).alias("lambda_ppm"), F.lit(residual < 1e-6).alias("converged"))


def power_steps(spark, sf, steps: int = 4):
    return spark.range(1).select(F.round(F.lit(E.power_steps(_clean(spark, sf), steps) * 1e6), 6).alias("lambda_ppm"), F.lit(steps).alias("rounds"))


def graph_entropy(spark, sf):
    found = E.graph_entropy(_clean(spark, sf), 1e-6)
    return found.select("n", F.round("q", 6).alias("q"), F.round("entropy", 4).alias("entropy"), "converged")


def entropy_centrality(spark, sf):
    return E.entropy_centrality(_clean(spark, sf)).select("node", F.round(F.col("score") * 1e6, 3).alias("score_ppm"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def second_moment(spark, sf):
    return E.second_moment(_vectors(spark, sf), "label", "embedding").select("label", "i", "j", r6("m").alias("m"))


def embedding_entropy(spark, sf):
    return E.embedding_entropy(_vectors(spark, sf), "label", "embedding")


def purity_entropy(spark, sf):
    return E.purity_entropy(_vectors(spark, sf), "label", "embedding").select("label", r6("purity_entropy").alias("purity_entropy"))


def _query(spark, sf):
    """The mean of all vectors, as a query."""
    return V.centroid(_vectors(spark, sf).withColumn("one", F.lit(1)), "one", "embedding").first()["centroid"]


def cosine_similarity(spark, sf):
    v = _vectors(spark, sf)
    q = F.array(*map(F.lit, _query(spark, sf)))
    return v.select("vec_id", r6(V.cosine(F.col("embedding"), q)).alias("similarity"))


def similarity_search(spark, sf):
    return V.similarity_search(_vectors(spark, sf), _query(spark, sf), 0.1, 20, "embedding", "vec_id").select("vec_id", r6("similarity").alias("similarity"))


def similarity_search_batch(spark, sf):
    v = _vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return V.similarity_search_batch(v, asked, 0.1, 5, "embedding", "vec_id").select("query_id", "rank", "vec_id", r6("similarity").alias("similarity"))


def question_context(spark, sf):
    v = _vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    near = V.similarity_search_batch(v, asked, 0.25, 3, "embedding", "vec_id").withColumnRenamed("vec_id", "entry").where("entry <> query_id")
    return question_context_of(asked.select(F.col("query_id").alias("question")), near)


def _concepts(spark, sf):
    return V.concept_vector(_vectors(spark, sf), "label", "embedding", 64)


def concept_vector(spark, sf):
    return _concepts(spark, sf).select("label", F.posexplode("concept").alias("i", "x")).select("label", "i", r6("x").alias("x"))


def concept_similarity(spark, sf):
    return V.concept_similarity(_concepts(spark, sf), "label").select("a", "b", r6("similarity").alias("similarity"))


def concept_subspace(spark, sf):
    return V.concept_subspace(_vectors(spark, sf), "label", "embedding", 3)


def section_graph(spark, sf):
    return V.section_graph(V.concept_similarity(_concepts(spark, sf), "label"), floor=-1.0).select("a", "b", r6("similarity").alias("similarity"))


def route_query(spark, sf):
    sections = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return V.route_query(_vectors(spark, sf), sections, _query(spark, sf), "label", "embedding").select("label", r6("score").alias("score"))


def staged_query(spark, sf):
    names = _vectors(spark, sf).withColumn("name", F.concat(F.lit("entry "), F.col("vec_id").cast("string")))
    sources = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("summary"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat_ws("/", "l_returnflag", "l_linenumber").alias("content"))
    return V.staged_query(names, _query(spark, sf), "label", "embedding", "vec_id", "name", sources).select("label", "vec_id", r6("similarity").alias("similarity"), "context")


def _summaries(spark, sf):
    """A summary a turn; a conversation's first turn has the next two as children."""
    turn = table(spark, sf, "conversations")
    name = lambda t: F.concat_ws(":", "conv_id", t)
    kids = F.when(F.col("turn") % 3 == 0, F.array(name(F.col("turn") + 1), name(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    return turn.select(name(F.col("turn")).alias("id"), kids.alias("children"), F.col("text").alias("content"), "conv_id", "turn")


def root_summaries(spark, sf):
    return V.root_summaries(_summaries(spark, sf)).select("id")


def expand_summary(spark, sf):
    s = _summaries(spark, sf)
    first = s.where("turn = 0").select(F.col("conv_id").cast("string").alias("id"), "content")
    two = s.where("turn > 0 and turn % 2 = 0").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("level"), "content")
    three = s.where("turn % 2 = 1").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("seq"), "content")
    return V.expand_summary(first, two, three).select("id", "step", "place", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def compaction_due(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), F.ceil(F.char_length("text") / 4).alias("tokens"), (F.col("lang") == "en").alias("settled"))
    done = table(spark, sf, "labels").where("quality = 0").join(d.select("grp", "id"), F.col("doc_id") == F.col("id")).select("grp", "id")
    return V.compaction_due(d, done).select("grp", "open", "total", "due", F.col("target").cast("long").alias("target"))


def stale_embeddings(spark, sf):
    v = _vectors(spark, sf).withColumn("model", F.when(F.col("label") == 3, None).when(F.col("label") == 4, "old").otherwise("now"))
    cut = v.withColumn("embedding", F.when(F.col("vec_id") % 200 == 5, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return V.stale_embeddings(cut, "label", "model", "embedding", "now", 64).select("label", F.array_join("reasons", ",").alias("reasons"))


def citations(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("text", F.lit(" [finding:"), F.col("source"), F.lit("] [finding:"), F.col("lang"), F.lit("]")).alias("t"))
    known = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    return V.citations(d, known, "t")


def bond_types(spark, sf):
    li = table(spark, sf, "lineitem")
    obs = li.select(F.col("l_suppkey").alias("src"), F.pmod("l_partkey", F.lit(50)).alias("dst"), F.struct("l_orderkey", "l_linenumber").alias("at"), (F.col("l_returnflag") == "A").alias("logical"), F.col("l_discount").alias("distance"), F.col("l_quantity").alias("trajectory"))
    return V.bond_types(obs.withColumn("distance", F.col("distance") * 10), 0.3, 25)


def entropy_profile(spark, sf):
    return A.entropy_profile(_vectors(spark, sf).withColumn("tokens", F.col("vec_id") % 7), "label", "embedding", "tokens").select("label", "entropy", "n", "tokens", F.size("centroid").alias("dimension"))


def _audits(spark, sf):
    v = _vectors(spark, sf).withColumn("level", F.pmod("label", F.lit(3)) + 1)
    return A.compression_audit(v, v.where("vec_id % 3 = 0"), "label", "embedding", "level")


def compression_audit(spark, sf):
    return _audits(spark, sf).select("label", "level", r6("ratio").alias("ratio"), r6("similarity").alias("similarity"), "verdict")


def audit_rates(spark, sf):
    return A.audit_rates(_audits(spark, sf), "label", 6).select(r6("weak_share").alias("weak_share"), r6("mean_ratio").alias("mean_ratio"))


def axiom_preservation(spark, sf):
    v = _vectors(spark, sf)
    present = v.select(F.col("vec_id").alias("id"), F.explode(F.sequence(F.lit(0), F.pmod("label", F.lit(4)))).alias("rule")).withColumn("rule", F.format_string("rule%d", "rule"))
    rules = _concepts(spark, sf).select(F.format_string("rule%d", "label").alias("rule"), F.col("concept").alias("rv"))
    return A.axiom_preservation(present, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("sv")), rules, 0.1).select("id", r6("score").alias("score"), "lost", "valid")


def _fitness(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_linenumber").alias("iteration"), F.sum("l_quantity").alias("z"))
    signals = table(spark, sf, "events").select(F.element_at(F.array(*map(F.lit, ["gap-bridge", "component-reduction", "cycle-reduction", "cdp-rise", "weak-audit"])), (F.pmod("user_id", F.lit(5)) + 1).cast("int")).alias("kind"))
    bridges = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"))
    return A.edge_fitness(li, signals, bridges, 4)


FIT = """lf as (select l_suppkey as src, l_partkey as dst, min(l_linenumber) as iteration, sum(l_quantity) as z from lineitem group by all),
sup as (select s_suppkey as node from supplier where s_acctbal > 5000),
f as (select src, dst, z, iteration, case when iteration >= 4 then 0.5 else 0 end + case when iteration >= 4 then 0.8 else 0 end + 0.8 + case when src in (from sup) or dst in (from sup) then 1.0 else 0 end - case when iteration >= 4 then 0.6 else 0 end as fitness,
    case when iteration >= 4 then 'cdp-rise,component-reduction,cycle-reduction' else 'cycle-reduction' end || case when src in (from sup) or dst in (from sup) then ',gap-bridge' else '' end || case when iteration >= 4 then ',weak-audit' else '' end as reasons from lf),
o as (select *, greatest(0.01, 1 + 0.1 * fitness)::double as w, greatest(0.0, z * (1 + 0.1 * fitness))::double as z1 from f)"""


def edge_fitness(spark, sf):
    return _fitness(spark, sf).select("src", "dst", r6("fitness").alias("fitness"), "reasons")


def learning_rate(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ["nascent", "stable", "critical", "transitioning"])), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return A.learning_rate(table(spark, sf, "events").select("event_id", kinds.alias("regime"))).select("event_id", r6("rate").alias("rate"))


def price_decomposition(spark, sf):
    return A.price_decomposition(_fitness(spark, sf), 0.1).select(*[r6(c).alias(c) for c in ("selection", "transmission", "change")])


def evolve_salience(spark, sf):
    return A.evolve_salience(_fitness(spark, sf), 0.1).select("src", "dst", r6("salience").alias("salience"))


def salience_ranking(spark, sf):
    return A.salience_ranking(A.evolve_salience(_fitness(spark, sf), 0.1).withColumn("salience", F.round("salience", 6))).select("place", "src", "dst", "salience")


def explore_exploit(spark, sf):
    return A.explore_exploit(A.price_decomposition(_fitness(spark, sf), 0.1)).select(r6("explore").alias("explore"))


def gini(spark, sf):
    return A.gini(table(spark, sf, "lineitem"), "l_extendedprice").select(r6("gini").alias("gini"))


QUERIES = {
    "ts1_deltas": deltas, "ts2_cdp": cdp, "ts3_rolling_correlation": rolling_correlation, "ts4_phase_transition": phase_transition, "ts5_linear_slope": linear_slope,
    "ts6_metrics_trend": metrics_trend, "ts7_early_convergence": early_convergence, "ts8_confirmed_transition": confirmed_transition, "ts9_regime": regime,
    "ts10_regime_features": regime_features, "ts11_surprising_edges": surprising_edges, "ts12_hysteresis_state": hysteresis_state, "ts13_centrality_trend": centrality_trend,
    "ts14_rapid_change": rapid_change, "ts15_topology_reorganized": topology_reorganized, "ts16_peak_valley": peak_valley, "ts17_rising_nodes": rising_nodes,
    "ts18_phase_timings": phase_timings, "en1_normalize_edges": normalize_edges, "en2_quadratic_entropy": quadratic_entropy, "en3_entropy_closed_form": entropy_closed_form,
    "en4_lambda_max": lambda_max, "en4b_power_steps": power_steps, "en5_graph_entropy": graph_entropy, "en6_entropy_centrality": entropy_centrality, "en7_second_moment": second_moment,
    "en8_embedding_entropy": embedding_entropy, "en9_purity_entropy": purity_entropy, "en10_cosine_similarity": cosine_similarity,
    "ve1_similarity_search": similarity_search, "ve2_similarity_search_batch": similarity_search_batch, "ve3_concept_vector": concept_vector, "ga18_question_context": question_context,
    "ve4_concept_similarity": concept_similarity, "ve5_concept_subspace": concept_subspace, "ve6_section_graph": section_graph, "ve7_route_query": route_query,
    "ve8_staged_query": staged_query, "ve9_root_summaries": root_summaries, "ve10_expand_summary": expand_summary, "ve11_compaction_due": compaction_due,
    "ve12_stale_embeddings": stale_embeddings, "ve13_citations": citations, "ve14_bond_types": bond_types, "ca1_entropy_profile": entropy_profile,
    "ca2_compression_audit": compression_audit, "ca3_audit_rates": audit_rates, "ca4_axiom_preservation": axiom_preservation, "pe1_edge_fitness": edge_fitness,
    "pe2_learning_rate": learning_rate, "pe3_price_decomposition": price_decomposition, "pe4_evolve_salience": evolve_salience,
    "pe5_salience_ranking": salience_ranking, "pe6_explore_exploit": explore_exploit, "pe7_gini": gini,
}

_SLOPE = "coalesce((count(*) over w * sum(n * vne) over w - sum(n) over w * sum(vne) over w) / nullif(count(*) over w * sum(n * n) over w - pow(sum(n) over w, 2), 0), 0)"
_LAST = "rows between 4 preceding and current row"
_VEC = "v as (select vec_id, label, embedding, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)"
_CENT = _VEC + ", cent as (select label, i, avg(x) as m from v group by label, i), con as (select label, i, m / sqrt(sum(m * m) over (partition by label)) as x from cent)"
_MEAN = _VEC + ", q as (select i, avg(x) as m from v group by i), sim as (select vec_id, label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as similarity from v join q using (i) group by vec_id, label)"
_PAIRS = _CENT + ", cs as (select a.label as a, b.label as b, sum(a.x * b.x) as similarity from con a join con b on a.i = b.i and a.label < b.label group by 1, 2)"
_M2 = "select {0} as label, a.i, b.i as j, avg(a.x * b.x) as m from {1} a join {1} b on a.vec_id = b.vec_id and a.i <= b.i group by {0}, a.i, b.i"
_PUR = "select label, 1 - sum(case when i = j then m * m else 2 * m * m end) / pow(sum(case when i = j then m end), 2) as h from {} group by label"
_SUMS = """s as (select conv_id || ':' || turn as id, conv_id, turn, text as content, case when turn % 3 = 0 then [conv_id || ':' || (turn + 1), conv_id || ':' || (turn + 2)] else [] end as children from conversations)"""
_AUDIT = _VEC + f""", sub as (select * from v where vec_id % 3 = 0), ma as ({_M2.format('a.label', 'v')}), mb as ({_M2.format('a.label', 'sub')}), ha as ({_PUR.format('ma')}), hb as ({_PUR.format('mb')}),
ca as (select label, i, avg(x) as m from v group by all), cb as (select label, i, avg(x) as m from sub group by all),
cc as (select ca.label, sum(ca.m * cb.m) / (sqrt(sum(ca.m * ca.m)) * sqrt(sum(cb.m * cb.m))) as similarity from ca join cb using (label, i) group by 1),
au as (select label, (label % 3 + 1)::int as level, hb.h / case when ha.h > 1e-12 then ha.h end as ratio, similarity from ha join hb using (label) join cc using (label)),
aud as (select *, case when ratio is null then 'degenerate' when ratio >= case level when 1 then 0.7 when 2 then 0.4 else 0.15 end and similarity >= 0.6 then 'strong' else 'weak' end as verdict from au)"""
_LAMBDA = EDGES + """, sc as (select src, dst, weight / sqrt(di * dj) as weight from t), nr as (select src as node, dst as other, weight from sc union all select dst, src, weight from sc),
x0 as (select node, 1 + ((node * 2654435761::hugeint) % 1000 + 1000)::bigint % 1000 / 1000.0::double as x from deg)""" + "".join(
    f""", y{k} as (select x.node, x.x, (x.x - a.a) / (select count(*) from deg) as y from x{k - 1} x join (select nr.node, sum(weight * o.x) as a from nr join x{k - 1} o on o.node = nr.other group by nr.node) a on a.node = x.node),
x{k} as (select node, y / sqrt((select sum(y * y) from y{k})) as x from y{k})"""
    for k in range(1, 5)
)

SQL = {
    "ts1_deltas": f"with {DELTAS} select series, iteration, round(d_vne, 6) + 0.0 as d_vne, round(d_ee, 6) + 0.0 as d_ee from d",
    "ts2_cdp": f"with {ROWS} select series, iteration, round(vne - ee, 6) + 0.0 as cdp from r",
    "ts3_rolling_correlation": f"with {CORR} select series, iteration, round(correlation, 6) + 0.0 as correlation from c",
    "ts4_phase_transition": f"""with {CORR}, b as (select *, last_value(case when correlation <> 0 then correlation end ignore nulls) over (partition by series order by iteration rows between unbounded preceding and 1 preceding) as before from c)
        select series, iteration, coalesce(sign(before) * sign(correlation) < 0 and abs(before) > 0.1 and abs(correlation) > 0.1, false) as is_transition from b""",
    "ts5_linear_slope": f"with {ROWS}, n as (select *, row_number() over (partition by series order by iteration) - 1 as n from r) select series, round(coalesce(regr_slope(vne, n), 0), 6) + 0.0 as slope from n group by series",
    "ts6_metrics_trend": f"with {ROWS}, n as (select *, (row_number() over (partition by series order by iteration) - 1)::double as n from r) select series, iteration, round(avg(vne) over w, 6) + 0.0 as mean, round({_SLOPE}, 6) + 0.0 as slope from n window w as (partition by series order by iteration {_LAST})",
    "ts7_early_convergence": f"with {ROWS}, n as (select *, (row_number() over (partition by series order by iteration) - 1)::double as n from r) select series, iteration, coalesce(count(*) over w >= 5 and var_samp(ee) over w < 2.0 and {_SLOPE} > 0.05, false) as converging from n window w as (partition by series order by iteration {_LAST})",
    "ts8_confirmed_transition": f"""with {CORR}, a as (select *, iteration % 4 as h, sign(correlation) as sg, row_number() over w as n from c window w as (partition by series order by iteration)),
        b as (select *, last_value(nullif(sg, 0) ignore nulls) over (partition by series order by iteration rows between unbounded preceding and 1 preceding) as before from a),
        f as (select *, coalesce(sg <> 0 and sg <> before, false) as flip from b),
        g as (select *, count(*) filter (where flip) over w as stretch, last_value(case when flip then n end ignore nulls) over w as start_, last_value(case when flip then sg end ignore nulls) over w as want,
            list(sg) over (partition by series order by iteration rows between 2 preceding and current row) as recent from f window w as (partition by series order by iteration rows unbounded preceding)),
        m as (select *, coalesce(n - start_ >= 3 and h >= 2 and len(list_filter(recent, lambda s: s = want)) >= 0.6 * len(recent), false) as meets from g)
        select series, iteration, coalesce(n = min(case when meets then n end) over (partition by series, stretch), false) as confirmed from m""",
    "ts9_regime": f"""with {CORR}, x as (select series, iteration, count(*) over w as k, var_samp(vne - ee) over w as v, stddev_samp(correlation) over w as s, sum(case when d_vne > 0 then 1 else 0 end) over w as g from c window w as (partition by series order by iteration rows between 9 preceding and current row)),
        y as (select *, case when k < 10 then null when v > 0.5 and s > 0.8 then 'critical' when v < 0.2 and s < 0.3 and g > 0 then 'stable' else 'transitioning' end as kind from x),
        z as (select *, case when kind is not distinct from lag(kind) over (partition by series order by iteration) and row_number() over (partition by series order by iteration) > 1 then 0 else 1 end as change from y),
        rr as (select *, sum(change) over (partition by series order by iteration) as run from z), t as (select *, case when row_number() over (partition by series, run order by iteration) >= 5 then kind end as settled from rr)
        select series, iteration, coalesce(last_value(settled ignore nulls) over (partition by series order by iteration rows unbounded preceding), 'nascent') as regime from t""",
    "ts10_regime_features": f"""with {CORR} select series, iteration, case when count(*) over w >= 10 then round(var_samp(vne - ee) over w, 6) + 0.0 end as cdp_variance, case when count(*) over w >= 10 then round(stddev_samp(correlation) over w, 6) + 0.0 end as correlation_std,
        (sum(case when d_vne > 0 then 1 else 0 end) over w)::bigint as recent_growth, case when count(*) over w >= 10 then 'measured' else 'insufficient-history' end as status from c window w as (partition by series order by iteration rows between 9 preceding and current row)""",
    "ts11_surprising_edges": f"""with {_VEC}, li as (select distinct l_partkey as src, l_suppkey as dst, l_linenumber as iteration, l_returnflag as origin from lineitem where l_returnflag in ('A', 'R')),
        pr as (select distinct src, dst from li), co as (select src, dst, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) as c from pr join v a on a.vec_id = src join v b on b.vec_id = dst and b.i = a.i group by all),
        j as (select li.*, case when a.label <> b.label then c < 0.3 when a.label = b.label then false end as odd from li left join embeddings a on a.vec_id = li.src left join embeddings b on b.vec_id = li.dst left join co on co.src = li.src and co.dst = li.dst)
        select iteration, count(*) as proposed, count(*) filter (where odd) as surprising, count(*) filter (where odd is null) as unknown, case when count(*) filter (where odd is null) = 0 then round(count(*) filter (where odd) / count(*), 6) end as ratio from j group by iteration""",
    "ts12_hysteresis_state": f"""with {ROWS}, b as (select *, max(case when ee < 1.0 then iteration end) over w as lo, max(case when ee >= 4.0 then iteration end) over w as hi from r window w as (partition by series order by iteration rows between unbounded preceding and current row))
        select series, iteration, case when ee < 1.0 then 'NORMAL' when hi is not null and (lo is null or hi > lo) then 'CRITICAL' else 'OBSTRUCTED' end as state from b""",
    "ts13_centrality_trend": f"with {TREND} select series, iteration, trend from t",
    "ts14_rapid_change": f"with {TREND} select series, iteration, round(score, 6) + 0.0 as score from t where one > 0 and score >= 3 * one",
    "ts15_topology_reorganized": f"""with {SCORES}, k as (select *, row_number() over (partition by iteration order by score desc, series) as rank, count(*) over (partition by iteration) as n from s),
        m as (select *, lag(rank) over (partition by series order by iteration) as was from k) select iteration, count(*) as moved from m where abs(rank - was) > n * 0.5 group by iteration having count(*) > 3""",
    "ts16_peak_valley": f"""with {SCORES}, k as (select * from s qualify row_number() over (partition by series order by iteration desc) <= 50)
        select series, arg_min(iteration, (-score, iteration)) as peak_at, round(max(score), 6) + 0.0 as peak, arg_min(iteration, (score, iteration)) as valley_at, round(min(score), 6) + 0.0 as valley from k group by series""",
    "ts17_rising_nodes": f"""with {TREND}, g as (select series, arg_min(score, iteration) as a, arg_max(score, iteration) as b, arg_max(trend, iteration) as trend, count(*) as n from t group by series)
        select series, round((b - a) / (n - 1), 6) + 0.0 as step from g where trend = 'rising' and n > 1 and (b - a) / (n - 1) >= 0""",
    "ts18_phase_timings": "with t as (select event_type, sum(value) as total from events group by event_type) select event_type, round(total, 2) as total, (row_number() over (order by total desc, event_type))::int as rank from t union all select null, round(sum(value), 2), 0 from events",
    "en1_normalize_edges": f"with {EDGES} select * from e",
    "en2_quadratic_entropy": f"with {EDGES}, {_Q} select n, round(q, 9) as q from q",
    "en3_entropy_closed_form": f"with {EDGES}, {_Q} select n, round(case when n <= 2 or q <= 0 then 0.0 else -q * ln(2.0 / n) end, 6) + 0.0 as entropy from q",
    # Orders and parts are the two sides of a bipartite graph, whose largest eigenvalue is 2.
    "en4_lambda_max": f"with {EDGES} select round(2.0 / count(*) * 1e6, 3) as lambda_ppm, true as converged from deg",
    "en5_graph_entropy": f"with {EDGES}, {_Q} select n, round(q, 6) as q, round(-q * ln(2.0 / n), 4) as entropy, true as converged from q",
    "en4b_power_steps": f"with {_LAMBDA} select round(sum(x * y) / sum(x * x) * 1e6, 6) as lambda_ppm, 4::int as rounds from y4",
    "en6_entropy_centrality": f"""with {EDGES}, {_Q}, st as (select sum(term) as s from t), own as (select v, sum(term) as own from (select src as v, term from t union all select dst, term from t) group by v),
        tc as (select v, src, dst, sum(wi) as wi, sum(wj) as wj from (select near.other as v, t.src, t.dst, near.weight as wi, 0 as wj from t join near on near.node = t.src where near.other <> t.dst union all select near.other, t.src, t.dst, 0, near.weight from t join near on near.node = t.dst where near.other <> t.src) group by all),
        ch as (select v, sum(weight * weight / ((di - wi) * (dj - wj)) - term) as c from tc join t using (src, dst) group by v)
        select own.v as node, round((q - (1 - ((n - 1) + 2 * (s - own + coalesce(c, 0))) / pow(n - 1, 2))) * 1e6, 3) as score_ppm from own left join ch using (v), q, st""",
    "en7_second_moment": f"with {_VEC}, m as ({_M2.format('a.label', 'v')}) select label, i::int as i, j::int as j, round(m, 6) + 0.0 as m from m",
    "en9_purity_entropy": f"with {_VEC}, m as ({_M2.format('a.label', 'v')}), p as ({_PUR.format('m')}) select label, round(h, 6) + 0.0 as purity_entropy from p",
    "en10_cosine_similarity": f"with {_MEAN} select vec_id, round(similarity, 6) + 0.0 as similarity from sim",
    "ve1_similarity_search": f"with {_MEAN} select vec_id, round(similarity, 6) + 0.0 as similarity from sim where similarity >= 0.1 order by sim.similarity desc, vec_id limit 20",
    "ve2_similarity_search_batch": f"""with {_VEC}, c as (select q.vec_id as query_id, r.vec_id, sum(q.x * r.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(r.x * r.x))) as similarity from v q join v r on q.i = r.i where q.vec_id % 100 = 0 group by 1, 2)
        select query_id, (row_number() over (partition by query_id order by c.similarity desc, vec_id))::int as rank, vec_id, round(c.similarity, 6) + 0.0 as similarity from c where c.similarity >= 0.1 qualify row_number() over (partition by query_id order by c.similarity desc, vec_id) <= 5""",
    "ga18_question_context": f"""with {_VEC}, c as (select q.vec_id as question, r.vec_id as entry, sum(q.x * r.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(r.x * r.x))) as s from v q join v r on q.i = r.i where q.vec_id % 100 = 0 and q.vec_id <> r.vec_id group by 1, 2),
        k as (select *, row_number() over (partition by question order by s desc, entry) as rn from c where s >= 0.25), a as (select question, string_agg(entry, ',' order by rn) as entries from k where rn <= 2 group by 1)
        select vec_id as question, coalesce(entries, '') as entries, case when entries is null then 'graph-only' else 'context-supported' end as status from embeddings left join a on a.question = vec_id where vec_id % 100 = 0""",
    "ve3_concept_vector": f"with {_CENT} select label, i::int as i, round(x, 6) + 0.0 as x from con",
    "ve4_concept_similarity": f"with {_PAIRS} select a, b, round(similarity, 6) + 0.0 as similarity from cs",
    "ve6_section_graph": f"""with {_PAIRS}, b as (select a as x, b as y, similarity from cs union all select b, a, similarity from cs), k as (select * from b where similarity >= -1 qualify row_number() over (partition by x order by similarity desc, y) <= 2)
        select distinct least(x, y) as a, greatest(x, y) as b, round(similarity, 6) + 0.0 as similarity from k""",
    "ve7_route_query": f"with {_MEAN}, m as (select label, max(similarity) as s from sim group by label) select r.label::int as label, round(coalesce(s, -1.0), 6) + 0.0 as score from range(12) r(label) left join m on m.label = r.label",
    "ve8_staged_query": f"""with {_MEAN}, b as (select * from sim order by similarity desc, vec_id limit 1), x as (select string_agg(l_returnflag || '/' || l_linenumber, chr(10) || chr(10) order by l_orderkey * 10 + l_linenumber, l_returnflag || '/' || l_linenumber) as c from lineitem where l_orderkey % 500 = (select vec_id from b))
        select label, vec_id, round(similarity, 6) + 0.0 as similarity, coalesce((select c from x), 'entry ' || vec_id) as context from b""",
    "ve9_root_summaries": f"with {_SUMS} select id from s where id not in (select unnest(children) from s)",
    "ve10_expand_summary": f"with {_SUMS} select conv_id::varchar as id, case when turn = 0 then 0 when turn % 2 = 0 then 1 else 2 end as step, turn as place, md5(content) as content_md5 from s",
    "ve11_compaction_due": """with d as (select source as grp, doc_id as id, ceil(length(text) / 4)::bigint as tokens, lang = 'en' as settled from documents),
        o as (select grp, sum(tokens)::bigint as open, max(settled) as settled from d where id not in (select doc_id from labels where quality = 0) group by grp), t as (select grp, sum(tokens)::bigint as total from d group by grp)
        select grp, open, total, open >= 4000 and (settled or total >= 32000) as due, greatest(64, floor(open * 0.4))::bigint as target from o join t using (grp)""",
    "ve12_stale_embeddings": """with m as (select label, case label when 3 then null when 4 then 'old' else 'now' end as model, case when vec_id % 200 = 5 then 32 else 64 end as size from embeddings),
        g as (select label, max(model) as m, count(distinct size) as sizes, max(size) as size, count(*) filter (where model is null) as u from m group by label),
        r as (select label, array_to_string(list_filter([case when u > 0 then 'no-model' end, case when m <> 'now' then 'other-model' end, case when sizes > 1 then 'mixed-sizes' end, case when size <> 64 then 'other-size' end], lambda x: x is not null), ',') as reasons from g) select * from r where reasons <> ''""",
    "ve13_citations": """with m as (select unnest(regexp_extract_all(text || ' [finding:' || source || '] [finding:' || lang || ']', '\\[finding:([A-Za-z0-9_-]+)\\]', 1)) as id from documents) select id, count(*) as n from m where id in (select source from documents) group by id""",
    "ve14_bond_types": """with l as (select l_suppkey as src, l_partkey % 50 as dst, arg_max({'l': l_returnflag = 'A', 'd': l_discount * 10, 't': l_quantity}, (l_orderkey, l_linenumber)) as o from lineitem group by all),
        b as (select src, dst, case when o.l then 'covalent' when o.d <= 0.3 then 'hydrogen' when o.t >= 25 then 'vanDerWaals' end as bond from l) select * from b where bond is not null""",
    "ca2_compression_audit": f"with {_AUDIT} select label, level, round(ratio, 6) + 0.0 as ratio, round(similarity, 6) + 0.0 as similarity, verdict from aud",
    "ca3_audit_rates": f"with {_AUDIT}, l as (select * from aud order by label desc limit 6) select round(avg((verdict = 'weak')::int), 6) + 0.0 as weak_share, round(avg(ratio), 6) + 0.0 as mean_ratio from l",
    "ca4_axiom_preservation": f"""with {_CENT}, p as (select vec_id, label, unnest(range(0, label % 4 + 1)) as rule from embeddings), s as (select p.vec_id as id, p.rule, sum(v.x * con.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(con.x * con.x))) as score
        from p join v on v.vec_id = p.vec_id join con on con.label = p.rule and con.i = v.i group by 1, 2) select id, round(avg(score), 6) + 0.0 as score, coalesce(string_agg('rule' || rule, ',' order by rule) filter (where score < 0.1), '') as lost, count(*) filter (where score < 0.1) = 0 as valid from s group by id""",
    "pe1_edge_fitness": f"with {FIT} select src, dst, round(fitness::double, 6) + 0.0 as fitness, reasons from f",
    "pe2_learning_rate": "select event_id, round(0.1 * case event_id % 4 when 0 then 2.0 when 1 then 0.3 else 1.0 end, 6)::double as rate from events",
    "pe3_price_decomposition": f"with {FIT}, p as (select covar_pop(w, z) as c, avg(w * (z1 - z)) as t, avg(w) as w from o) select round(c / w, 6) + 0.0 as selection, round(t / w, 6) + 0.0 as transmission, round((c + t) / w, 6) + 0.0 as change from p",
    "pe4_evolve_salience": f"with {FIT} select src, dst, round(greatest(0.05, z1 / (select avg(z1) from o)), 6) + 0.0 as salience from o",
    "pe5_salience_ranking": f"with {FIT}, s as (select src, dst, round(greatest(0.05, z1 / (select avg(z1) from o)), 6) + 0.0 as salience from o) select row_number() over (order by salience desc, src, dst) - 1 as place, * from s",
    "pe6_explore_exploit": f"with {FIT}, p as (select abs(covar_pop(w, z)) as c, abs(avg(w * (z1 - z))) as t from o) select round(t / (c + t), 6) + 0.0 as explore from p",
    "pe7_gini": "with r as (select l_extendedprice as x, row_number() over (order by l_extendedprice) as i, count(*) over () as n from lineitem) select round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) + 0.0 as gini from r",
}

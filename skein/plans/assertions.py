"""Queries over sources, sheaves, claims, findings, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.stem import morphology_sql, symbol_sql
from skein.functions.text import PREFERENCE
from skein.operators import claims as C
from skein.operators import findings as D
from skein.operators import sheaf as H
from skein.operators.storage import shared_path, written
from skein.plans.tables import r6, table
from skein.sources import entries as N
from skein.sources import run_log as L


def read_run_log(spark, sf):
    """Turns as check entries: those of the assistant in log events, others inside a tool's output;
    every fifth turn lacks its verdict and is left out."""
    turn = table(spark, sf, "conversations")
    verdict = F.when(F.col("turn") % 5 != 4, F.when(F.char_length("text") % 2 == 0, "sat").otherwise("unsat"))
    blocks = F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    entry = F.array(F.struct(F.col("role").alias("kind"), blocks.alias("blocks"), F.array(F.sha2("text", 256)).alias("formulas"), verdict.alias("verdict"), F.col("text").alias("note")))
    logged = F.col("role") == "assistant"
    events = turn.select(
        F.when(logged, "logic_check_log").otherwise("tool").alias("type"),
        F.when(logged, entry).alias("checkLog"), F.when(~logged, F.to_json(F.struct(entry.alias("checkLog")))).alias("output"),
    )
    path = shared_path(spark, "run_log")
    events.write.json(path)
    at = lambda i: F.col("blocks")[i].cast("long")
    return L.read_run_log(spark, path).select("kind", at(0).alias("conv_id"), at(1).alias("turn"), F.col("formulas")[0].alias("formula"), "verdict", F.sha2("note", 256).alias("note"))


def write_run_log(spark, sf):
    """Turns written as events, a folder a role, and counted from the files."""
    path = shared_path(spark, "run_events")
    L.write_run_log(table(spark, sf, "conversations").select(F.col("role").alias("type"), "conv_id", "turn", "text"), path)
    found = spark.read.schema("conv_id long, turn long, text string, ts string, type string").json(path)
    stamped = F.count(F.when(F.col("ts").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]{12}Z$"), 1))
    return found.groupBy("type", "conv_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.char_length("text")).alias("chars"), F.max("turn").alias("last_turn"), stamped.alias("stamped"))


def run_log_counts(spark, sf):
    return L.run_log_counts(table(spark, sf, "conversations"), "role", "text")


def _entries(spark, sf):
    return N.append_entries(table(spark, sf, "documents"), "source", "doc_id", "text")


def append_entries(spark, sf):
    return _entries(spark, sf)


def validate_sequence(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") - 1).alias("seq"))
    return N.validate_sequence(e, "k")


def entries_range(spark, sf):
    return N.entries_range(_entries(spark, sf), 3, 11).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def corpus_hash(spark, sf):
    return N.corpus_hash(table(spark, sf, "conversations"), "conv_id", ["turn"], "text")


def conversation_summary(spark, sf):
    return N.conversation_summary(table(spark, sf, "conversations"))


def _restrictions(spark, sf):
    """An edge an order and supplier that shipped for it: the supplier's part prices as maps."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_discount").alias("v"))
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    e = li.join(nation, "l_suppkey").select(F.concat_ws(":", "l_orderkey", "l_suppkey").alias("edge"), F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"), "v")
    ends = F.array(F.struct(F.lit("source").alias("side"), F.col("a").alias("vertex"), F.lit(1.0).alias("value")), F.struct(F.lit("target").alias("side"), F.col("b").alias("vertex"), (1 + F.col("v")).alias("value")))
    return e.select("edge", F.explode(ends).alias("x")).select("edge", "x.*", F.lit(0).alias("r"), F.lit(0).alias("c"))


RES = """li as (select l_orderkey, l_suppkey, sum(l_discount) as v from lineitem group by all), e as (select l_orderkey || ':' || l_suppkey as edge, 's' || l_suppkey as a, 'n' || s_nationkey as b, v from li join supplier on s_suppkey = l_suppkey),
b as (select edge, a as col, -1.0::double as value from e union all select edge, b, 1 + v from e)"""
_LAP = RES + ", lap as (select x.col as c1, y.col as c2, sum(x.value * y.value) as value from b x join b y using (edge) group by all)"


def coboundary(spark, sf):
    return H.coboundary(_restrictions(spark, sf)).select(F.col("row.edge").alias("edge"), F.col("col.vertex").alias("col"), r6("value").alias("value"))


def sheaf_laplacian(spark, sf):
    lap = H.sheaf_laplacian(H.coboundary(_restrictions(spark, sf)))
    return lap.select(F.col("c1.vertex").alias("c1"), F.col("c2.vertex").alias("c2"), r6("value").alias("value"))


def _state(b):
    return b.select("col").distinct().withColumn("x", F.char_length("col.vertex").cast("double"))


def dirichlet_energy(spark, sf):
    b = H.coboundary(_restrictions(spark, sf))
    return H.dirichlet_energy(b, _state(b)).select(F.round("energy", 4).alias("energy"))


def _scales(spark, sf):
    """The same edges with one map a vertex, so that there are global sections: what a supplier
    holds times its scale is what its nation holds times that one's."""
    r = _restrictions(spark, sf)
    number = F.substring("vertex", 2, 20).cast("long")
    return r.withColumn("value", F.when(F.col("side") == "source", 1 + F.pmod(number, F.lit(5)) / 10).otherwise(1 + F.pmod(number, F.lit(3)) / 4))


def diffuse_consensus(spark, sf):
    b = written(H.distinct_rows(H.coboundary(_scales(spark, sf))), "rows")
    return H.consensus(H.sheaf_laplacian(b), _state(b))[0].select(F.col("col.vertex").alias("vertex"), r6("x").alias("x"))


def diffuse_steps(spark, sf):
    b = H.coboundary(_restrictions(spark, sf))
    return H.diffuse(H.sheaf_laplacian(b), _state(b), 1e-5, 3).select(F.col("col.vertex").alias("vertex"), r6("x").alias("x"))


def validate_sheaf(spark, sf):
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("vertex"), F.lit(1).alias("dim"))
    nations = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("vertex"), F.pmod("n_nationkey", F.lit(2)).alias("dim"))
    return H.validate_sheaf(known.unionByName(nations), _restrictions(spark, sf))


def _claims(spark, sf):
    """A claim an order: the customer's segment says its priority of the customer's nation."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(k, F.lit(len(v))) + 1).cast("int"))
    scope = F.when(k % 97 == 0, None).when(k % 3 == 0, "corpus").otherwise("position")
    return o.select(
        k.alias("id"), F.col("o_orderstatus").alias("corpus"), pick("property-assertion", "entailment", "identity-claim", "causal-claim", "exclusion", "joint-incompatibility", "distinction", "dissociation").alias("kind"), scope.alias("scope"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).when(k % 41 == 0, F.lit("HOUSEHOLD")).alias("holder"), F.when(k % 53 == 0, "They").otherwise(F.col("c_mktsegment")).alias("subject"),
        F.col("o_orderpriority").alias("predicate"), F.concat(F.lit("n"), "c_nationkey").alias("object"), pick("asserts", "asserts", "denies", "asserts", "unsure").alias("polarity"), F.when(k % 19 == 0, "other").when(k % 2 == 0, "in-kind").alias("difference"),
        pick("epistemic", "modal", "maybe").alias("modality"), F.pmod(k, F.lit(200)).alias("segment"), (k % 7 != 0).alias("accepted"),
    )


CLAIMS = """cl as (select o_orderkey as id, o_orderstatus as corpus, (['property-assertion', 'entailment', 'identity-claim', 'causal-claim', 'exclusion', 'joint-incompatibility', 'distinction', 'dissociation'])[o_orderkey % 8 + 1] as kind,
    case when o_orderkey % 97 = 0 then null when o_orderkey % 3 = 0 then 'corpus' else 'position' end as scope,
    case when o_orderkey % 3 <> 0 then c_mktsegment when o_orderkey % 41 = 0 then 'HOUSEHOLD' end as holder, case when o_orderkey % 53 = 0 then 'They' else c_mktsegment end as subject,
    o_orderpriority as predicate, 'n' || c_nationkey as object, (['asserts', 'asserts', 'denies', 'asserts', 'unsure'])[o_orderkey % 5 + 1] as polarity, case when o_orderkey % 19 = 0 then 'other' when o_orderkey % 2 = 0 then 'in-kind' end as difference,
    (['epistemic', 'modal', 'maybe'])[o_orderkey % 3 + 1] as modality, o_orderkey % 200 as segment, o_orderkey % 7 <> 0 as accepted from orders join customer on c_custkey = o_custkey)"""
#: Which of subject, predicate and object stand in which role of a kind.
_HELD = {
    "distinction": {"distinguished": ["subject", "object"]}, "dissociation": {"dissociable": ["subject", "object"]}, "identity-claim": {"identified": ["subject"], "identified-with": ["object"]},
    "exclusion": {"excluder": ["subject"], "excluded": ["object"]}, "joint-incompatibility": {"incompatible": ["subject", "predicate", "object"]}, "causal-claim": {"cause": ["subject"], "effect": ["object"]},
    "property-assertion": {"subject": ["subject"], "property": ["predicate"]}, "entailment": {"antecedent": ["subject"], "consequent": ["object"]},
}
_TYPED = "ty as (" + " union all ".join(f"select id, kind, '{r}' as role, unnest([{', '.join(c)}]) as label from cl where kind = '{k}'" for k, roles in _HELD.items() for r, c in roles.items()) + ")"


def _typed(c):
    """Roles as the kind of a claim wants them."""
    made = F.lit(None).cast("map<string,array<string>>")
    for kind, roles in _HELD.items():
        made = F.when(F.col("kind") == kind, F.create_map(*[x for r, names in roles.items() for x in (F.lit(r), F.array(*names))])).otherwise(made)
    return c.withColumn("roles", made)


def _with_roles(c):
    return c.withColumn("roles", F.create_map(F.lit("subject"), F.array("subject"), F.lit("predicate"), F.array("predicate"), F.lit("object"), F.array("object")))


def claim_schema_issues(spark, sf):
    c = _claims(spark, sf)
    parts = C.claim_incidence(_typed(c)).select("id", "role", "label")
    # Some claims lack the labels of objects, some name a role that is not theirs.
    parts = parts.where("not (label like 'n%' and id % 23 = 0)").union(c.where("id % 29 = 0").select("id", F.lit("witness"), "object"))
    return C.claim_schema_issues(c, parts, spark.createDataFrame(C.ROLES, "kind string, role string, least int, most int"))


def attribution_issues(spark, sf):
    return C.attribution_issues(_claims(spark, sf))


def claim_identity(spark, sf):
    return C.claim_identity(_with_roles(_claims(spark, sf))).select("id", "canonical", "claim_key", "occurrence_id")


def claim_incidence(spark, sf):
    inc = C.claim_incidence(_with_roles(_claims(spark, sf)))
    return inc.select("id", "role", "ordinal", "label", "node_id")


def clique_projection(spark, sf):
    return C.clique_projection(C.claim_incidence(_with_roles(_claims(spark, sf))))


def canonical_predicates(spark, sf):
    """The words of part names, forms of their first and last words, and clauses about them."""
    part = table(spark, sf, "part")
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    forms = F.array(F.concat(last, F.lit("s")), F.concat(first, F.lit("-"), last, F.lit("ing")), F.concat(first, F.lit("s "), last, F.lit("ed")), F.concat(first, F.lit("ation")))
    labels = part.select(F.explode(F.concat(F.split("p_name", " "), forms)).alias("label")).union(part.where("p_size = 9").select(F.concat(F.lit("Makes the "), "p_name")))
    onto = spark.createDataFrame([("ring", "band"), ("bolts", "bolt"), ("Gears", "gear-ring")], "label string, canonical string")
    words = part.where("p_size = 7").select(last.alias("word")).distinct()
    return C.canonical_predicates(labels, onto, words)


def alias_suggestions(spark, sf):
    from skein.operators.vectors import similarity_search_batch

    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    near = similarity_search_batch(v, asked, 0.2, 50, "embedding", "vec_id").where("query_id <> vec_id").select(F.col("query_id").alias("label"), F.col("vec_id").alias("other"), F.round("similarity", 6).alias("similarity"))
    return C.alias_suggestions(near, v.select(F.col("vec_id").alias("label"), F.col("label").alias("block")), 0.2)


def community_of_claim(spark, sf):
    toks = _claims(spark, sf).select("id", F.explode(F.array(F.lower("subject"), F.lower("predicate"), "object")).alias("token"))
    comm = table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.explode(F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey"))).alias("token"))
    return C.community_of_claim(toks, comm)


def claim_blocks(spark, sf):
    c = _claims(spark, sf).withColumn("proposition", F.concat_ws(" ", "subject", "predicate", "polarity")).withColumn("segment", F.format_string("%03d", "segment"))
    return C.claim_blocks(c).select("corpus", "scope", "holder", F.array_join("propositions", ";").alias("propositions"), F.array_join("segments", ",").alias("segments"), "claims")


def claim_propositions(spark, sf):
    return C.claim_propositions(_typed(_claims(spark, sf))).select("id", F.array_join("propositions", "; ").alias("formulas"))


def _stances(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("holder"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("stance"))


_IMPOSSIBLE = [("a", "1-URGENT/F"), ("a", "5-LOW/O"), ("b", "2-HIGH/P"), ("b", "3-MEDIUM/P"), ("b", "5-LOW/P")]


def joint_violations(spark, sf):
    return C.joint_violations(_stances(spark, sf), spark.createDataFrame(_IMPOSSIBLE, "set_id string, stance string"))


def _witnesses(spark, sf):
    """What holds of an order: priority, status, year, and the flags of its lines."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("witness"), F.explode(F.array(F.concat(F.lit("p:"), "o_orderpriority"), F.concat(F.lit("s:"), "o_orderstatus"), F.concat(F.lit("y:"), F.year("o_orderdate").cast("string")))).alias("proposition"))
    return o.union(table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("r:"), "l_returnflag", "l_linestatus")))


WITNESS = """w as (select o_orderkey as witness, unnest(['p:' || o_orderpriority, 's:' || o_orderstatus, 'y:' || year(o_orderdate)]) as p from orders union select l_orderkey, 'r:' || l_returnflag || l_linestatus from lineitem),
p1 as (select distinct p from w), s2 as (select distinct a.p as a, b.p as b from w a join w b on a.witness = b.witness and a.p < b.p),
f2 as (select a.p as a, b.p as b from p1 a join p1 b on a.p < b.p where not exists (select 1 from s2 where s2.a = a.p and s2.b = b.p)),
c3 as (select x.a, x.b, y.b as c from s2 x join s2 y on x.b = y.a where exists (select 1 from s2 z where z.a = x.a and z.b = y.b)),
s3 as (select distinct a.p as a, b.p as b, c.p as c from w a join w b on a.witness = b.witness and a.p < b.p join w c on c.witness = a.witness and b.p < c.p),
f3 as (select * from c3 where not exists (select 1 from s3 where s3.a = c3.a and s3.b = c3.b and s3.c = c3.c))"""


def minimal_unsat_sets(spark, sf):
    return C.minimal_unsat_sets(_witnesses(spark, sf), 3)


def minimal_unsat_sets_whole(spark, sf):
    """To the arity of the reference, 6; the SQL of cl12 stops at 3."""
    return C.minimal_unsat_sets(_witnesses(spark, sf))


def consistency_graph(spark, sf):
    return C.consistency_graph(_witnesses(spark, sf))


def classify_verdict(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("block"))
    scope = F.when(F.col("s_suppkey") % 3 == 0, "corpus").otherwise("position")
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("block"), F.when(scope == "position", F.col("s_nationkey")).alias("holder"), scope.alias("scope"))
    return C.classify_verdict(s, b)


def _log(spark, sf):
    """A check-log entry a part."""
    p = table(spark, sf, "part")
    noun, adjective = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    formula = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("not_"), noun, F.lit("("), adjective, F.lit(")"))).when(F.col("p_size") % 11 == 0, F.concat(F.lit("exists x ("), noun, F.lit("_types(x))"))).when(F.col("p_size") % 2 == 0, F.concat(noun, F.lit("("), adjective, F.lit(","), F.lower("p_type"), F.lit(")"))).otherwise(F.concat(noun, F.lit("s("), adjective, F.lit(")")))
    return p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 7 == 0, "core").when(F.col("p_size") % 7 == 1, "internal").otherwise(F.lower("p_type")).alias("kind"), F.when(F.col("p_size") > 30, "consistent").when(F.col("p_size") > 25, "contradictory").when(F.col("p_size") > 22, "undetermined").otherwise("consistent").alias("verdict"), F.when(F.col("p_size") % 9 == 0, "VACUOUS: no model").alias("note"), F.array("p_brand", "p_type").alias("blocks"), F.array(formula, F.concat(adjective, F.lit("("), noun, F.lit(")"))).alias("formulas"))


LOG = """lg as (select p_partkey as seq, case when p_size % 7 = 0 then 'core' when p_size % 7 = 1 then 'internal' else lower(p_type) end as kind, case when p_size > 30 then 'consistent' when p_size > 25 then 'contradictory' when p_size > 22 then 'undetermined' else 'consistent' end as verdict, case when p_size % 9 = 0 then 'VACUOUS: no model' end as note, p_brand, p_type, split_part(p_name, ' ', -1) as noun, split_part(p_name, ' ', 1) as adj, p_size from part),
lf as (select seq, p_brand as block, unnest([case when p_size % 5 = 0 then 'not_' || noun || '(' || adj || ')' when p_size % 11 = 0 then 'exists x (' || noun || '_types(x))' when p_size % 2 = 0 then noun || '(' || adj || ',' || lower(p_type) || ')' else noun || 's(' || adj || ')' end, adj || '(' || noun || ')']) as formula from lg join part on p_partkey = seq),
sy as (select distinct block, regexp_extract(formula, '([A-Za-z_][A-Za-z0-9_]*)\\([^()]*\\)', 1) as symbol, len(string_split(formula, ',')) as arity from lf)"""
LOG = LOG.replace("from lg join part on p_partkey = seq", "from lg")


def check_log_page(spark, sf):
    return C.check_log_page(_log(spark, sf), None, "consistent", ["BRAND#3"], 5, 25).select("seq", "kind", "verdict")


def check_log_digest(spark, sf):
    return C.check_log_digest(_log(spark, sf))


def check_log_signals(spark, sf):
    return C.check_log_signals(_log(spark, sf), 50).select("place", "seq", "kind", "verdict", F.array_join("formula_ids", ",").alias("formula_ids"))


def formula_ids(spark, sf):
    return C.formula_ids(_log(spark, sf), "seq")


def _formulas(spark, sf):
    return _log(spark, sf).select(F.get("blocks", 0).alias("block"), F.explode("formulas").alias("formula"))


def novel_symbols(spark, sf):
    known = table(spark, sf, "part").where("p_size < 5").select(F.substring_index("p_name", " ", -1).alias("symbol")).distinct()
    return C.novel_symbols(_formulas(spark, sf), known)


def rank_explanations(spark, sf):
    li = table(spark, sf, "lineitem")
    checks = li.select(F.col("l_suppkey").alias("hypothesis"), (F.col("l_suppkey") % 5 != 0).alias("coherent"), (F.col("l_returnflag") == "A").alias("entailed"), F.pmod("l_suppkey", F.lit(4)).alias("novel"))
    return C.rank_explanations(checks).select("hypothesis", "status", F.round("depth", 9).alias("depth"), F.round("score", 9).alias("score"), "place")


def formula_lint(spark, sf):
    return C.formula_lint(_formulas(spark, sf))


def _occurrences(spark, sf):
    return C.block_symbols(_formulas(spark, sf)).select("block", "symbol")


def symbol_alias_candidates(spark, sf):
    return C.symbol_alias_candidates(_occurrences(spark, sf), 4)


def signature_components(spark, sf):
    turn = table(spark, sf, "conversations")
    return C.signature_components(turn.select(F.format_string("%05d:%03d", "conv_id", "turn").alias("block"), F.concat_ws(":", "conv_id", "role").alias("symbol")))


_CAUSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "none-such"]


def extraction_failures(spark, sf):
    return C.extraction_failures(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cause")), _CAUSES)


def _findings(spark, sf):
    """A finding an order: the customer as namespace, the year as corpus, the priority as outcome."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    method = F.element_at(F.array(F.lit("derived"), F.lit("measured"), F.lit("evidential")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("namespace"), F.year("o_orderdate").alias("corpus"), F.col("o_orderpriority").alias("outcome"), method.alias("method"), (k % 4 != 0).alias("conclusive"),
        F.array(F.pmod(k, F.lit(5)), F.pmod(k, F.lit(7)) + 10).alias("claims"), F.col("o_orderdate").alias("at"), F.when(k % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("verdict"), F.when(k % 13 != 0, "all").alias("coverage"),
        F.pmod(k, F.lit(3)).alias("receipts"), F.pmod(k, F.lit(6)).alias("scope"), F.pmod(k, F.lit(8)).alias("grounds"), F.pmod(k, F.lit(4)).alias("recalls"), F.when(k % 2 == 0, F.pmod(k, F.lit(3))).otherwise(0).alias("cites"), F.when(k % 9 == 0, "archived").otherwise("active").alias("status"),
    )


FIND = """fi as (select o_orderkey as id, o_custkey as namespace, year(o_orderdate) as corpus, o_orderpriority as outcome, (['derived', 'measured', 'evidential'])[o_orderkey % 3 + 1] as method, o_orderkey % 4 <> 0 as conclusive,
    [o_orderkey % 5, o_orderkey % 7 + 10] as claims, o_orderdate as at, case when o_orderkey % 11 = 0 then '' else o_orderstatus end as verdict, case when o_orderkey % 13 <> 0 then 'all' end as coverage, o_orderkey % 3 as receipts,
    o_orderkey % 6 as scope, o_orderkey % 8 as grounds, o_orderkey % 4 as recalls, case when o_orderkey % 2 = 0 then o_orderkey % 3 else 0 end as cites, case when o_orderkey % 9 = 0 then 'archived' else 'active' end as status from orders),
ok as (select * from fi where method <> 'evidential'),
conf as (select a.id as newer, b.id as older, 'claims' as reason, array_to_string(list_sort(list_transform(list_intersect(a.claims, b.claims), lambda x: x)), ',') as shared from ok a join ok b on a.namespace = b.namespace and a.outcome <> b.outcome and (a.at > b.at or a.at = b.at and a.id > b.id)
    where a.method = 'derived' and b.method = 'derived' and a.conclusive and b.conclusive and len(list_intersect(a.claims, b.claims)) > 0
  union all select a.id, b.id, 'corpus', a.corpus::varchar from ok a join ok b on a.namespace = b.namespace and a.corpus = b.corpus and a.outcome <> b.outcome and a.method <> b.method and (a.conclusive or b.conclusive) and (a.at > b.at or a.at = b.at and a.id > b.id))"""


def admit_findings(spark, sf):
    return D.admit_findings(_findings(spark, sf)).select("id", "reason")


_PRINT = ["namespace", "corpus", "outcome", "method", "verdict", "coverage"]


def dedup_findings(spark, sf):
    return D.dedup_findings(_findings(spark, sf), _PRINT, "id").select("id", "fingerprint")


def _conflicts(spark, sf):
    return D.finding_conflicts(_findings(spark, sf))


def finding_conflicts(spark, sf):
    return _conflicts(spark, sf)


def _resolved(spark, sf):
    c = _conflicts(spark, sf)
    return D.resolve_conflict(c, c.where("newer % 10 = 0").select(F.col("newer").alias("winner"), F.col("older").alias("loser")).distinct())


def resolve_conflict(spark, sf):
    return _resolved(spark, sf)


def recall_findings(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("active").alias("status"), F.pmod("vec_id", F.lit(4)).alias("recalls"), F.pmod("vec_id", F.lit(3)).alias("cites"), F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("vec_id") % 300).cast("int")).alias("at"))
    q = F.array(*[F.lit(1.0 if i % 2 else -0.5) for i in range(64)])
    return D.recall_findings(v, q, "embedding", F.lit("2024-06-01").cast("date"), 0.0, 20).select("id", r6("similarity").alias("similarity"), r6("score").alias("score"))


def retire_findings(spark, sf):
    guarded = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return D.retire_findings(_findings(spark, sf), guarded, F.lit("1998-08-01").cast("date"), 180, 5000)


def dependency_audit(spark, sf):
    stored = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("value")).distinct()
    now = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") > 3000, "A").otherwise("N").alias("value"))
    return D.dependency_audit(stored.withColumn("name", F.col("name").cast("string")), now.withColumn("name", F.col("name").cast("string")))


def finding_stats(spark, sf):
    return D.finding_stats(_findings(spark, sf), _resolved(spark, sf))


def _statements(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("I think "), "text")).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 10 == 0, F.lit(True)).alias("is_normative"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), F.pmod("doc_id", F.lit(3)).alias("instances"))


def filter_noise(spark, sf):
    return D.filter_noise(_statements(spark, sf)).select("doc_id", "verdict", "kept")


def _weighed(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("tier"), F.array("l_returnflag", "l_linestatus").alias("topics"), F.when(F.col("l_linenumber") % 2 == 0, "https://x").otherwise("see there").alias("locator"), "l_discount", F.when(F.col("l_tax") > 0.03, "supports").otherwise("contradicts").alias("bearing"), (F.col("l_quantity") < 20).alias("anecdote"))
    tiers = spark.createDataFrame([("a", 1.0), ("n", 0.5)], "tier string, reliability double")
    return D.weigh_evidence(s, tiers, F.col("l_discount") * 10, F.array(F.lit("A"), F.lit("F"), F.lit("O")))


WEIGH = """we as (select l_orderkey, l_linenumber, l_discount * 10 + case l_returnflag when 'A' then 1.0 when 'N' then 0.5 else 0 end + ((l_returnflag = 'A')::int + (l_linestatus in ('F', 'O'))::int) / 3 + case when l_linenumber % 2 = 0 then 1 else 0 end as total,
    case when l_tax > 0.03 then 'supports' else 'contradicts' end as bearing, l_quantity < 20 as anecdote from lineitem),
gr as (select l_orderkey, max(total) filter (where bearing = 'supports') as best, count(*) filter (where bearing = 'supports') as n, max(total) filter (where bearing <> 'supports') as counter, bool_and(anecdote) filter (where bearing = 'supports') as only_a from we group by 1),
st as (select l_orderkey, case when n = 0 then 0.0 else greatest(0.0, least(1.0, 0.7 * best / 4 + 0.3 * least(1.0, n / 3) - 0.6 * coalesce(counter, 0) / 4 - case when only_a then 0.5 else 0 end)) end as strength from gr)"""


def weigh_evidence(spark, sf):
    return _weighed(spark, sf).select("l_orderkey", "l_linenumber", r6("total").alias("total"))


def _strength(spark, sf):
    return D.grounds_strength(_weighed(spark, sf), "l_orderkey")


def grounds_strength(spark, sf):
    return _strength(spark, sf).select("l_orderkey", r6("strength").alias("strength"))


def _claimed(spark, sf):
    pick = lambda ladder, d: F.element_at(F.array(*map(F.lit, ladder)), (F.pmod(F.floor(F.col("l_orderkey") / d), F.lit(len(ladder))) + 1).cast("int"))
    return _strength(spark, sf).withColumn("strength", F.round("strength", 6)).select("l_orderkey", "strength", pick(D.SCOPES, 1).alias("scope"), pick(D.CERTAINTIES, 5).alias("certainty"))


def scope_demand(spark, sf):
    return _claimed(spark, sf).select("l_orderkey", r6(D.scope_demand(F.col("scope"), F.col("certainty"))).alias("demand"))


def calibrate_claim(spark, sf):
    return D.calibrate_claim(_claimed(spark, sf)).select("l_orderkey", "new_scope", "new_certainty", F.col("steps").cast("int").alias("steps"))


def _ranked(spark, sf):
    p = table(spark, sf, "part")
    base = F.col("p_retailprice") / 100
    return p.select(F.col("p_brand").alias("cycle"), F.col("p_partkey").alias("id"), base.alias("base"), (base + F.col("p_size") / 10).alias("combined"), (base + F.col("p_size") / 9).alias("perturbed"), (F.col("p_type") == "ECONOMY").alias("held_out"), (F.col("p_size") / 10).alias("cost"))


def ranking_value(spark, sf):
    v = D.ranking_value(_ranked(spark, sf), "cycle", 10)
    return v.select("cycle", "base_hits", "combined_hits", *[r6(c).alias(c) for c in ("base_rr", "combined_rr", "stability", "cost_per_hit")], "reasons", "decision")


def extraction_scorecard(spark, sf):
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("claim"))
    must = spark.createDataFrame([("1-URGENT/F",), ("2-HIGH/O",), ("5-LOW/P",)], "claim string")
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_nationkey") + 1).alias("segments"))
    return D.extraction_scorecard(found, must, spark.createDataFrame([("3-MEDIUM/P",)], "claim string"), "run", runs).select("run", r6("recall").alias("recall"), "violations", r6("coverage").alias("coverage"), "vacuous")


def run_agreement(spark, sf):
    li = table(spark, sf, "lineitem")
    key = [F.col("l_linestatus").alias("corpus"), F.col("l_orderkey").alias("segment"), (F.col("l_linenumber") % 3).alias("run")]
    roles = (F.col("l_suppkey") % 4).cast("string")
    outcomes = li.where("l_partkey % 10 <> 0").select(
        *key, F.concat_ws(":", "l_returnflag", roles).alias("claim"), F.col("l_returnflag").alias("kind"), roles.alias("roles"),
        F.when(F.col("l_quantity") > 25, "corpus").otherwise("position").alias("scope"), F.when(F.col("l_tax") > 0.02, "asserts").alias("polarity"),
    )
    runs = li.select(*key).select("corpus", "run").distinct().select(
        "corpus", "run", (100 * (F.col("run") + 1)).alias("latency"), F.when(F.col("corpus") == "F", F.col("run") / 4).alias("cost"), (F.col("run") == 1).alias("truncated"), ((F.col("corpus") == "O") & (F.col("run") == 2)).alias("failed")
    )
    return D.run_agreement(outcomes, li.where("l_partkey % 10 = 0").select(*key), runs).withColumn("agreement", r6("agreement"))


def tie_breaker_value(spark, sf):
    li, tens, role = table(spark, sf, "lineitem"), F.col("l_quantity") / 10, F.col("l_suppkey") % 3 + 1
    edits = F.when(F.abs(tens) < 2.0**53, F.floor(tens).cast("double")).otherwise(tens)  # a floor is a long, which has no NaN
    weight = F.when(role != 0, F.element_at(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.3)), role.cast("int")))
    rows = li.select("l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("id"), edits.alias("edits"), weight.alias("weight"), (F.col("l_returnflag") == "R").alias("valid"))
    return D.tie_breaker_value(rows, "l_orderkey").na.fill(-1, ["plain", "weighted"])


def spearman(spark, sf):
    return D.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", "p_brand", "p_partkey").select("p_brand", r6("rho").alias("rho"))


def verdict_scorecard(spark, sf):
    known = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("stance")).distinct()
    found = table(spark, sf, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("found_id"), F.col("l_suppkey").alias("stance")).distinct()
    both = known.withColumn("stance", F.concat_ws(":", "set_id", "stance")), found.withColumn("stance", F.concat_ws(":", "found_id", "stance"))
    return D.verdict_scorecard(*both).withColumn("best", F.col("best").cast("string"))


def verdict_totals(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_orderkey", F.concat_ws(":", "l_orderkey", "l_suppkey").alias("stance"))
    known = li.select("l_linestatus", F.concat_ws("-", "l_linestatus", "l_orderkey").alias("set_id"), "stance").distinct()
    found = li.where("l_returnflag <> 'A'").select("l_linestatus", F.concat_ws("-", "l_linestatus", "l_orderkey").alias("found_id"), "stance").distinct()
    scored = D.verdict_scorecard(known.drop("l_linestatus"), found.drop("l_linestatus")).withColumn("corpus", F.substring_index("set_id", "-", 1))
    part = table(spark, sf, "part")
    names = part.select(F.element_at(F.array(F.lit("F"), F.lit("O")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("corpus"), F.col("p_name").alias("name"))
    bad = part.where("p_size = 3").select(F.lit("O").alias("corpus"), F.regexp_replace(F.upper("p_name"), " ", "-").alias("name")).distinct()
    return D.verdict_totals(scored, found.select(F.col("l_linestatus").alias("corpus"), "found_id"), bad, names, ["F"])


def similarity_floor(spark, sf):
    v = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(1.0 if i % 2 else -0.5) for i in range(64)])
    from skein.operators.vectors import cosine

    cues = v.select(F.col("label").alias("cue"), cosine(F.col("embedding"), q).alias("s")).groupBy("cue").agg(F.max("s").alias("best")).withColumn("hit", F.col("cue") >= 5)
    return D.similarity_floor(cues).select(*[r6(c).alias(c) for c in ("lowest_hit", "highest_miss", "gap", "floor")])


_NAMES = {
    "io1": read_run_log, "io2": write_run_log, "io3": run_log_counts, "io4": append_entries, "io5": validate_sequence, "io6": entries_range, "io7": corpus_hash, "io8": conversation_summary, "sh1": coboundary, "sh2": sheaf_laplacian,
    "sh3": dirichlet_energy, "sh4": diffuse_consensus, "sh4b": diffuse_steps, "sh5": validate_sheaf, "cl1": claim_schema_issues, "cl2": attribution_issues, "cl3": claim_identity, "cl4": claim_incidence, "cl5": clique_projection,
    "cl6": canonical_predicates, "cl7": alias_suggestions, "cl8": community_of_claim, "cl9": claim_blocks, "cl10": claim_propositions, "cl11": joint_violations, "cl12": minimal_unsat_sets, "cl12b": minimal_unsat_sets_whole,
    "cl13": consistency_graph, "cl14": classify_verdict, "cl15": check_log_page, "cl16": check_log_digest, "cl16b": formula_ids, "cl16c": check_log_signals, "cl17": novel_symbols, "cl18": rank_explanations, "cl19": formula_lint,
    "cl20": symbol_alias_candidates, "cl21": signature_components, "cl22": extraction_failures, "fi1": admit_findings, "fi2": dedup_findings, "fi3": finding_conflicts, "fi4": resolve_conflict,
    "fi5": recall_findings, "fi6": retire_findings, "fi7": dependency_audit, "fi8": finding_stats, "ev1": filter_noise, "ev2": weigh_evidence, "ev3": grounds_strength, "ev4": scope_demand,
    "ev5": calibrate_claim, "qe1": ranking_value, "qe2": extraction_scorecard, "qe3": run_agreement, "qe4": tie_breaker_value, "qe5": spearman, "qe6": verdict_scorecard, "qe6b": verdict_totals, "qe7": similarity_floor,
}
QUERIES = {f"{k}_{f.__name__}": f for k, f in _NAMES.items()}

_WS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::bigint"
_ENT = f"en as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as seq, sha256(text) as hash, {_WS} as tokens from documents)"
_CANON = "ca as (select id, segment, kind || ';object=' || object || ';predicate=' || predicate || ';subject=' || subject as canonical from cl)"
_INC = "inc as (select id, unnest(['subject', 'predicate', 'object']) as role, 0 as ordinal, unnest([subject, predicate, object]) as label from cl)"
_NAME = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"
_DEM = "0.6 * (1 - (list_position(['universal', 'general', 'typical', 'some', 'at-least-one'], {0}) - 1) / 4) + 0.4 * (1 - (list_position(['is', 'indicates', 'appears', 'is-consistent-with'], {1}) - 1) / 3)"
_CLM = WEIGH + """, cm as (select l_orderkey, round(strength, 6) as strength, (['universal', 'general', 'typical', 'some', 'at-least-one'])[l_orderkey % 5 + 1] as scope, (['is', 'indicates', 'appears', 'is-consistent-with'])[(l_orderkey // 5) % 4 + 1] as certainty from st)"""
_RESOLVED = """dec as (select distinct newer as w, older as l from conf where newer % 10 = 0), lost as (select distinct l from dec),
res as (select newer, older, reason, case when exists (select 1 from dec where least(w, l) = least(newer, older) and greatest(w, l) = greatest(newer, older)) then 'resolved' when newer in (from lost) or older in (from lost) then 'dismissed' else 'open' end as status from conf)"""
_QV = "qv as (select i, case when i % 2 = 1 then 1.0 else -0.5 end as y from range(64) t(i)), vv as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings), sm as (select vec_id, label, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) as s from vv join qv using (i) group by all)"
_LEVEL = "case grouping(kind) when 1 then 2 else 0 end + grouping(verdict)"

_SQL = {
    "io1": "select role as kind, conv_id, turn, sha256(text) as formula, case when length(text) % 2 = 0 then 'sat' else 'unsat' end as verdict, sha256(text) as note from conversations where turn % 5 <> 4",
    "io2": "select role as type, conv_id, count(*) as events, sum(length(text))::bigint as chars, max(turn) as last_turn, count(*) as stamped from conversations group by role, conv_id",
    "io3": "select role, count(*) as events, sum(ceil(length(text) / 4))::bigint as tokens from conversations group by role",
    "io4": f"with {_ENT} select * from en",
    "io5": "with k as (select l_orderkey as k, l_linenumber::bigint - 1 as seq, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as expected from lineitem) select * from k where seq <> expected",
    "io6": f"with {_ENT} select source, count(*) as n, sum(tokens)::bigint as tokens from en where seq between 3 and 11 group by source",
    "io7": "select conv_id, sha256(string_agg(text, chr(10) order by turn)) as corpus_hash from conversations group by conv_id",
    "io8": """with s as (select conv_id, arg_min(text, turn) filter (where role = 'user') as f, count(*) as messages, max(turn) as last_turn from conversations group by 1),
        t as (select *, regexp_replace(regexp_replace(regexp_replace(f, '^\\s*[#>*-]+\\s*', ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as t from s) select conv_id, case when length(t) > 80 then substr(t, 1, 80) || '…' else t end as title, messages, last_turn from t""",
    "sh1": f"with {RES} select edge, col, round(sum(value), 6) + 0.0 as value from b group by edge, col having sum(value) <> 0",
    "sh2": f"with {_LAP} select c1, c2, round(value, 6) + 0.0 as value from lap",
    "sh3": f"with {RES}, y as (select edge, sum(value * length(col)) as y from b group by edge) select round(sum(y * y), 4) as energy from y",
    "sh4": """with e as (select distinct 's' || s_suppkey as a, 'n' || s_nationkey as b, s_suppkey, s_nationkey from lineitem join supplier on s_suppkey = l_suppkey),
        m as (select distinct b as grp, a as vertex, 1 + (s_suppkey % 5) / 10 as f from e union select b, b, 1 + (s_nationkey % 3) / 4 from e),
        c as (select grp, sum(length(vertex) / f) / sum(1 / (f * f)) as c from m group by grp)
        select vertex, round(c / f, 6) + 0.0 as x from m join c using (grp)""",
    "sh4b": f"with {_LAP}, x0 as (select distinct col, length(col)::double as x from b)" + "".join(f", x{k} as (select x.col, x.x - 1e-5 * coalesce(l.lx, 0) as x from x{k - 1} x left join (select c1, sum(value * o.x) as lx from lap join x{k - 1} o on o.col = c2 group by c1) l on l.c1 = x.col)" for k in (1, 2, 3)) + " select col as vertex, round(x, 6) + 0.0 as x from x3",
    "sh5": f"""with {RES}, vx as (select 's' || s_suppkey as vertex, 1 as dim from supplier where s_acctbal > 0 union all select 'n' || n_nationkey, n_nationkey % 2 from nation),
        m as (select edge, case when value = -1.0 then 'source' else 'target' end as side, col as vertex, case when dim is null then 'unknown-vertex' when dim <= 0 then 'shape-mismatch' end as issue from b left join vx on vx.vertex = b.col) select distinct * from m where issue is not null""",
    "cl1": f"""with {CLAIMS}, {_TYPED}, pa as (select id, role, label from ty where not (label like 'n%' and id % 23 = 0) union all select id, 'witness', object from cl where id % 29 = 0),
        ro as (select * from (values {", ".join(f"('{k}', '{r}', {a}, {'null::int' if b is None else b})" for k, r, a, b in C.ROLES)}) t(kind, role, least_, most_)),
        n as (select id, role, count(distinct label) as n, count(*) as k from pa group by all), wr as (select cl.id, bool_or(coalesce(n.n, 0) < least_ or coalesce(n.k, 0) > coalesce(most_, 1000)) as bad from cl join ro on ro.kind = cl.kind left join n on n.id = cl.id and n.role = ro.role group by cl.id),
        ex as (select distinct n.id from n join cl using (id) where not exists (select 1 from ro where ro.kind = cl.kind and ro.role = n.role))
        select cl.id, case when cl.id in (select id from ex) then 'unexpected-role' when wr.bad then 'cardinality' when kind in ('causal-claim', 'property-assertion', 'entailment') and polarity not in ('asserts', 'denies') then 'polarity'
            when modality not in ('epistemic', 'modal', 'functional', 'metaphysical') then 'modality' when difference not in ('in-kind', 'in-degree') then 'difference-kind' end as issue from cl left join wr using (id)""",
    "cl2": f"with {CLAIMS} select id, case when scope is null then 'scope-missing' when scope = 'position' and holder is null then 'holder-missing' when scope = 'corpus' and holder is not null then 'holder-unexpected' when lower(subject) in ({', '.join(repr(p) for p in C.PRONOUNS)}) then 'pronoun-subject' end as issue from cl",
    "cl3": f"with {CLAIMS}, {_CANON} select id, canonical, sha256(canonical) as claim_key, sha256(segment || chr(1) || canonical) as occurrence_id from ca",
    "cl4": f"with {CLAIMS}, {_INC} select id, role, ordinal::int as ordinal, label, sha256(lower(label)) as node_id from inc",
    "cl5": f"with {CLAIMS}, {_INC}, d as (select distinct id, label from inc) select x.label as a, y.label as b, count(*) as n from d x join d y on x.id = y.id and x.label < y.label group by all",
    "cl6": f"""with p as (select p_name, p_size, split_part(p_name, ' ', 1) as f, split_part(p_name, ' ', -1) as z from part),
        l as (select unnest(string_split(p_name, ' ') || [z || 's', f || '-' || z || 'ing', f || 's ' || z || 'ed', f || 'ation']) as label from p union select 'Makes the ' || p_name from p where p_size = 9),
        k as (select label, {symbol_sql("label", False)} as symbol, {morphology_sql("label", False)} as stems from l),
        o as (select {symbol_sql("label", False)} as symbol, {symbol_sql("canonical", False)} as o, {morphology_sql("canonical", False)} as stems from (values ('ring', 'band'), ('bolts', 'bolt'), ('Gears', 'gear-ring')) t(label, canonical)),
        m as (select stems, min(o) as m from o group by stems having count(distinct o) = 1), v as (select distinct {symbol_sql("z", False)} as symbol from p where p_size = 7),
        t as (select k.*, o.o, v.symbol as v, m.m, nullif(regexp_replace(regexp_extract(regexp_replace(lower(trim(k.label)), '[_\\s]+', '-', 'g'), '^(?:makes?|causes?|implies|means)-(?:the|a|an)-(.+)$', 1), '[^a-z0-9]+', '_', 'g'), '') as r
            from k left join o on o.symbol = k.symbol left join v on v.symbol = k.symbol left join m on m.stems = k.stems),
        s as (select stems, arg_min(symbol, (length(symbol), label)) as s from t where o is null and v is null and r is null and m is null group by stems),
        c as (select t.*, case when o is not null then o when v is not null then symbol else coalesce(r, m, s) end as canonical from t left join s using (stems))
        select label, canonical, case when o is not null then 'ontology' when v is not null then 'unchanged' when r is not null then 'repair' when canonical = symbol then 'unchanged' else 'morphology' end as method from c""",
    "cl7": """with v as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select q.vec_id as label, r.vec_id as other, q.label as bl, r.label as bo, sum(q.x * r.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(r.x * r.x))) as s from v q join v r on q.i = r.i where q.vec_id % 100 = 0 and q.vec_id <> r.vec_id group by all)
        select label, other, round(s, 6) + 0.0 as similarity, bl <> bo as critical from c where s >= 0.2 qualify row_number() over (partition by label order by round(s, 6) desc, other) = 1""",
    "cl8": f"with {CLAIMS}, t as (select distinct id, unnest([lower(subject), lower(predicate), object]) as token from cl), m as (select distinct c_nationkey as community, unnest([lower(c_mktsegment), 'n' || c_nationkey]) as token from customer), n as (select id, community, count(*) as n from t join m using (token) group by all) select id, community, n as shared from n qualify row_number() over (partition by id order by n desc, community) = 1",
    "cl9": f"with {CLAIMS} select corpus, scope, holder, array_to_string(list_sort(list_distinct(list(subject || ' ' || predicate || ' ' || polarity))), ';') as propositions, array_to_string(list_sort(list_distinct(list(format('{{:03d}}', segment)))), ',') as segments, count(*) as claims from cl where accepted group by corpus, scope, holder",
    "cl10": f"""with {CLAIMS}, p as (select *, {_NAME('subject')} as a, {_NAME('predicate')} as p, {_NAME('object')} as b, case when polarity = 'denies' then '-' else '' end as sg, polarity in ('asserts', 'denies') as signed, list_sort(list_distinct([subject, predicate, object])) as m from cl)
        select id, case kind when 'property-assertion' then case when signed then sg || p || '(entity_' || a || ')' end
            when 'entailment' then 'all x (' || a || '(x) -> ' || sg || b || '(x)); exists x (' || a || '(x))' when 'identity-claim' then 'all x (' || a || '(x) <-> ' || b || '(x)); exists x (' || a || '(x))'
            when 'causal-claim' then case when signed then 'all x (' || a || '(x) -> ' || sg || 'causes_' || b || '(x)); exists x (' || a || '(x))' end
            when 'exclusion' then 'all x (' || a || '(x) -> -' || b || '(x)); exists x (' || a || '(x))'
            when 'joint-incompatibility' then 'all x ((' || array_to_string(list_transform(m[1:len(m) - 1], lambda y: {_NAME('y')} || '(x)'), ' & ') || ') -> -' || {_NAME('m[len(m)]')} || '(x))'
            when 'distinction' then 'exists x (' || a || '(x) & -' || b || '(x))' else 'exists x (' || a || '(x) & -' || b || '(x)); exists x (' || b || '(x) & -' || a || '(x))' end as formulas from p""",
    "cl11": f"with im as (select * from (values {', '.join(map(str, _IMPOSSIBLE))}) t(set_id, stance)), h as (select distinct o_custkey as holder, o_orderpriority || '/' || o_orderstatus as stance from orders) select holder, set_id from h join im using (stance) group by holder, set_id having count(*) = (select count(*) from im i where i.set_id = im.set_id)",
    "cl12": f"with {WITNESS} select 2::int as arity, a || ',' || b as members from f2 union all select 3, a || ',' || b || ',' || c from f3",
    "cl13": f"with {WITNESS}, bo as (select a, b from s2 union select b, a from s2), re as (with recursive r(n, m) as (select a, a from bo union select r.n, bo.b from r join bo on bo.a = r.m) select n, min(m) as c from r group by n) select (select count(*) from s2) as pairs, (select count(*) from s3) as triangles, count(distinct c) as components from re",
    "cl14": """with s as (select l_orderkey as set_id, bool_or(l_suppkey % 3 = 0) as corpus, count(distinct case when l_suppkey % 3 <> 0 then s_nationkey end) as holders from lineitem join supplier on s_suppkey = l_suppkey group by 1)
        select set_id, case when corpus and holders = 0 then 'corpus-contradiction' when not corpus and holders = 1 then 'position-contradiction' else 'positions-incompatible' end as verdict from s""",
    "cl15": f"with {LOG} select seq, kind, verdict from lg where verdict = 'consistent' and (lower(p_brand) = 'brand#3' or lower(p_type) = 'brand#3') order by seq limit 25 offset 5",
    "cl16": f"with {LOG} select kind, verdict, count(*) as n, ({_LEVEL})::int as level from lg group by cube (kind, verdict)",
    "cl16b": f"with {LOG} select formula, min(seq) as first from lf group by formula",
    "cl16c": f"""with {LOG}, k as (select *, case when verdict = 'contradictory' then 0 when verdict = 'undetermined' then 1 when note is not null then 2 when kind = 'core' then 3 when kind = 'internal' then 4 else 5 end as rk from lg where verdict <> 'consistent' or kind in ('core', 'internal') or note is not null),
        p as (select *, row_number() over (order by rk, seq) - 1 as place from k qualify place < 50), u as (select place, pos, formula from (select p.place, lf.formula, row_number() over (partition by p.place order by starts_with(lf.formula, p.adj || '(' || p.noun)) - 1 as pos from p join lf on lf.seq = p.seq)),
        f as (select formula, row_number() over (order by min(place * 10 + pos)) - 1 as id from u group by formula)
        select p.place::int as place, p.seq, p.kind, p.verdict, string_agg(f.id, ',' order by u.pos) as formula_ids from p join u on u.place = p.place join f on f.formula = u.formula group by all""",
    "cl17": f"with {LOG} select distinct symbol from sy where symbol not in (select split_part(p_name, ' ', -1) from part where p_size < 5)",
    "cl18": """with s as (select l_suppkey as hypothesis, bool_and(l_suppkey % 5 <> 0) as coherent, avg((l_returnflag = 'A')::int) as depth, max(l_suppkey % 4) as novel from lineitem group by 1),
        t as (select *, case when not coherent then 'refuted' when depth >= 1 then 'explains' when depth > 0 then 'partial' else 'idle' end as status, depth - 0.35 * novel as score from s)
        select hypothesis, status, round(depth, 9) as depth, round(score, 9) as score, (row_number() over (partition by status order by round(t.score, 9) desc, novel, hypothesis))::int as place from t""",
    "cl19": f"""with {LOG}, i as (select block, symbol from sy group by block, symbol having count(distinct arity) > 1), nm as (select distinct symbol from sy), ng as (select symbol, regexp_replace(symbol, '^(not|non|no)_', '') as base from nm where regexp_matches(symbol, '^(not|non|no)_.')),
        sj as (select distinct block, unnest(regexp_extract_all(regexp_replace(regexp_replace(formula, '->.*$', ''), '\\b(all|exists)\\s+[a-zA-Z_][A-Za-z0-9_]*', ' ', 'g'), '\\b([a-z_][A-Za-z0-9_]*)\\s*\\(', 1)) as symbol from lf)
        select 'arity-in-block' as issue, block, symbol from i union all select 'arity-across-blocks', null, symbol from sy where symbol not in (select symbol from i) group by symbol having count(distinct arity) > 1
        union all select 'negation-free', null, null from lf having count(*) > 0 and count(*) filter (where regexp_matches(formula, '~|-[^>]|-$')) = 0
        union all select distinct 'negative-name', null, ng.symbol from ng join nm on nm.symbol <> ng.symbol and (starts_with(nm.symbol, ng.base) or starts_with(ng.base, nm.symbol))
        union all select 'private-witness', block, null from sj where block in (select block from lf where regexp_matches(formula, '\\bexists\\b')) and (select count(distinct block) from sj) > 1 group by block having bool_and(not exists (select 1 from sj o where o.symbol = sj.symbol and o.block <> sj.block))""",
    "cl20": f"""with {LOG}, k as (select symbol, list_transform(string_split(symbol, '_'), lambda p: case when p like '%ies' and length(p) > 4 then p[:-4] || 'y' when p like '%s' and p not like '%ss' and length(p) > 3 then p[:-2] else p end) as ps from (select distinct symbol from sy) where length(symbol) >= 4),
        pr as (select least(x.symbol, y.symbol) as a, greatest(x.symbol, y.symbol) as b from k x join k y on x.symbol <> y.symbol where x.ps = y.ps or len(x.ps) = 1 and len(y.ps) > 1 and y.ps[1] = x.ps[1] and len(list_filter(y.ps[2:], lambda p: p not in ({', '.join(repr(g) for g in C.GENERIC)}))) = 0)
        select distinct a, b, not exists (select 1 from sy p join sy q on p.block = q.block where p.symbol = a and q.symbol = b) as critical from pr""",
    "cl21": """with o as (select distinct 'b:' || format('{:05d}:{:03d}', conv_id, turn) as b, 's:' || conv_id || ':' || role as s from conversations), bo as (select b as x, s as y from o union select s, b from o),
        re as (with recursive r(n, m) as (select x, x from bo union select r.n, bo.y from r join bo on bo.x = r.m) select n, min(m) as c from r group by n) select substr(n, 3) as block, substr(c, 3) as component from re where starts_with(n, 'b:')""",
    "cl22": f"select o_orderpriority as cause, count(*) as n from orders where o_orderpriority in ({', '.join(repr(c) for c in _CAUSES)}) group by 1",
    "fi1": f"with {FIND} select id, case when trim(verdict) = '' then 'missing-verdict' when coalesce(trim(coverage), '') = '' then 'missing-coverage' when method = 'derived' and len(claims) < 1 then 'missing-claims' when method = 'evidential' and receipts < 1 then 'missing-receipts' when scope > grounds then 'scope-above-grounds' end as reason from fi",
    "fi2": f"with {FIND}, f as (select id, sha256(namespace || chr(1) || corpus || chr(1) || outcome || chr(1) || method || chr(1) || verdict || chr(1) || coalesce(coverage, chr(2))) as fingerprint from fi) select min(id) as id, fingerprint from f group by fingerprint",
    "fi3": f"with {FIND} select newer, older, reason, shared from conf",
    "fi4": f"with {FIND}, {_RESOLVED} select * from res",
    "fi5": f"""with {_QV}, f as (select vec_id as id, s, s - case when vec_id % 4 + vec_id % 3 > 0 then 0.0 else 0.05 * least(1.0, (vec_id % 300) / 180) end + least(0.05, 0.01 * (vec_id % 3) + 0.002 * (vec_id % 4)) as sc from sm where s >= 0)
        select id, round(s, 6) + 0.0 as similarity, round(sc, 6) + 0.0 as score from f order by round(f.sc, 9) desc, id limit 20""",
    "fi6": f"""with {FIND}, g as (select *, outcome = '1-URGENT' as guard, recalls + 4 * cites as use from fi), x as (select *, use = 0 and date_diff('day', cast("at" as date), date '1998-08-01') > 180 and not guard as expired from g),
        k as (select *, row_number() over (partition by expired order by use, "at", id) as rn, count(*) over (partition by expired) as n from x)
        select id, case when expired then 'archived' when rn <= n - 5000 and not guard then 'archived' when rn <= n - 5000 then 'conflict-held' else 'hot' end as fate from k""",
    "fi7": """with s as (select distinct l_orderkey as id, l_suppkey as name, l_returnflag as value from lineitem), n as (select s_suppkey as name, case when s_acctbal > 3000 then 'A' else 'N' end as now from supplier where s_suppkey % 5 <> 0)
        select id, string_agg(name || ':' || value || '>' || coalesce(now, '-'), ';' order by name || ':' || value || '>' || coalesce(now, '-')) as changes from s left join n using (name) where value is distinct from now group by id""",
    "fi8": f"with {FIND}, {_RESOLVED} select count(*) filter (where status = 'active') as active, count(*) filter (where status = 'archived') as archived, (select count(*) filter (where status = 'open') from res) as open_conflicts from fi",
    "ev1": f"""with s as (select doc_id, case when doc_id % 6 = 0 then 'I think ' || text else text end as text from documents), v as (select doc_id, case when doc_id % 10 = 0 or regexp_matches(text, '{PREFERENCE}') then 'opinion' when doc_id % 4 = 0 then 'assertion' when doc_id % 3 <= 1 then 'anecdote' else 'evidence' end as verdict from s)
        select doc_id, verdict, verdict in ('anecdote', 'evidence') as kept from v""",
    "ev2": f"with {WEIGH} select l_orderkey, l_linenumber, round(total, 6) + 0.0 as total from we",
    "ev3": f"with {WEIGH} select l_orderkey, round(strength, 6) + 0.0 as strength from st",
    "ev4": f"with {_CLM} select l_orderkey, round({_DEM.format('scope', 'certainty')}, 6) + 0.0 as demand from cm",
    "ev5": f"""with {_CLM}, sc as (select * from (values ('universal', 1), ('general', 2), ('typical', 3), ('some', 4), ('at-least-one', 5)) t(n, i)), ce as (select * from (values ('is', 1), ('indicates', 2), ('appears', 3), ('is-consistent-with', 4)) t(n, i)),
        p as (select cm.l_orderkey, strength, sc.n as s, cm.certainty as c, sc.i - s0.i as step from cm join sc s0 on s0.n = cm.scope join sc on sc.i >= s0.i union all select cm.l_orderkey, strength, 'at-least-one', ce.n, 5 - s0.i + ce.i - c0.i from cm join sc s0 on s0.n = cm.scope join ce c0 on c0.n = cm.certainty join ce on ce.i > c0.i)
        select l_orderkey, s as new_scope, c as new_certainty, step::int as steps from p qualify row_number() over (partition by l_orderkey order by {_DEM.format('s', 'c')} > strength + 1e-12, case when {_DEM.format('s', 'c')} <= strength + 1e-12 then step else -step end) = 1""",
    "qe1": """with p as (select p_brand as cycle, p_partkey as id, p_retailprice / 100 as base, p_retailprice / 100 + p_size / 10 as combined, p_retailprice / 100 + p_size / 9 as perturbed, p_type = 'ECONOMY' as h, p_size / 10 as cost from part),
        r as (select *, row_number() over (partition by cycle order by base desc, id) as rb, row_number() over (partition by cycle order by combined desc, id) as rc, row_number() over (partition by cycle order by perturbed desc, id) as rp from p),
        s as (select cycle, count(*) filter (where h and rb <= 10) as base_hits, count(*) filter (where h and rc <= 10) as combined_hits, coalesce(1 / min(rb) filter (where h), 0) as base_rr, coalesce(1 / min(rc) filter (where h), 0) as combined_rr, count(*) filter (where rc <= 10 and rp <= 10) / count(*) filter (where rc <= 10 or rp <= 10) as stability, sum(cost) as cost from r group by cycle),
        t as (select *, array_to_string(list_filter([case when combined_hits <= base_hits then 'no-extra-hits' end, case when combined_rr < base_rr then 'lower-rank' end, case when stability < 0.5 then 'unstable' end], lambda x: x is not null), ',') as reasons from s)
        select cycle, base_hits, combined_hits, round(base_rr, 6) as base_rr, round(combined_rr, 6) as combined_rr, round(stability, 6) as stability, case when combined_hits > base_hits then round(cost / (combined_hits - base_hits), 6) end as cost_per_hit, reasons, case when reasons = '' then 'retain' else 'retire' end as decision from t""",
    "qe2": """with f as (select distinct o_custkey as run, o_orderpriority || '/' || o_orderstatus as claim from orders) select c_custkey as run, round(count(*) filter (where claim in ('1-URGENT/F', '2-HIGH/O', '5-LOW/P')) / 3, 6) as recall, count(*) filter (where claim = '3-MEDIUM/P') as violations,
        round(count(claim) / (c_nationkey + 1), 6) as coverage, count(claim) = 0 as vacuous from customer left join f on run = c_custkey group by c_custkey, c_nationkey""",
    "qe3": """with o as (select l_linestatus as corpus, l_orderkey as segment, l_linenumber % 3 as run, l_returnflag || ':' || l_shipmode_ as claim, l_returnflag as kind, l_shipmode_ as roles, case when l_quantity > 25 then 'corpus' else 'position' end as scope, case when l_tax > 0.02 then 'asserts' end as polarity from (select *, (l_suppkey % 4)::varchar as l_shipmode_ from lineitem) where l_partkey % 10 <> 0),
        u as (select distinct l_linestatus as corpus, l_orderkey as segment, l_linenumber % 3 as run from lineitem where l_partkey % 10 = 0), rn as (select corpus, run, 100 * (run + 1) as latency, case when corpus = 'F' then run / 4 end as cost, run = 1 as truncated, corpus = 'O' and run = 2 as failed from (values ('F'), ('O')) c(corpus), (values (0), (1), (2)) r(run)),
        g as (select corpus, segment, run, string_agg(claim, '|' order by claim) as a, string_agg(kind, '|' order by kind) as k, string_agg(roles, '|' order by roles) as r, string_agg(scope, '|' order by scope) as s, string_agg(coalesce(polarity, 'null'), '|' order by coalesce(polarity, 'null')) as p, count(*) as n from o group by all),
        h as (select corpus, segment, run from g union select * from u), e as (select h.corpus, h.segment, r.run, coalesce(a, '') as a, coalesce(k, '') as k, coalesce(g.r, '') as r, coalesce(s, '') as s, coalesce(p, '') as p, coalesce(n, 0) as n, u.run is not null as lost
            from (select distinct corpus, segment from h) h join rn r on r.corpus = h.corpus left join g on g.corpus = h.corpus and g.segment = h.segment and g.run = r.run left join u on u.corpus = h.corpus and u.segment = h.segment and u.run = r.run),
        q as (select corpus, segment, count(distinct a) = 1 as a, count(distinct k) = 1 as k, count(distinct r) = 1 as r, count(distinct s) = 1 as s, count(distinct p) = 1 as p, count(distinct n) = 1 as n, count(distinct lost) = 1 as l from e group by all),
        c as (select corpus, count(*) as segments, round(avg(a::int), 6) as agreement, count(*) filter (where not k) as differ_kinds, count(*) filter (where not r) as differ_roles, count(*) filter (where not s) as differ_scopes, count(*) filter (where not p) as differ_polarities, count(*) filter (where not n) as differ_number, count(*) filter (where not l) as differ_mapping from q group by corpus),
        t as (select corpus, count(*) as runs, sum(latency)::bigint as total_latency, avg(latency) as mean_latency, case when count(cost) = count(*) then sum(cost) end as total_cost, count(*) filter (where truncated) as truncated_runs, count(*) filter (where failed) as failed_runs from rn group by corpus)
        select t.*, c.* exclude (corpus), agreement < 0.9 and failed_runs = 0 as sample_more from t join c using (corpus)""",
    "qe4": """with r as (select l_orderkey, l_returnflag = 'R' as valid, row_number() over (partition by l_orderkey order by floor(l_quantity / 10), l_partkey * 100 + l_linenumber) as p, row_number() over (partition by l_orderkey order by floor(l_quantity / 10), ([1.0, 0.7, 0.3])[l_suppkey % 3 + 1] desc, l_partkey * 100 + l_linenumber) as w from lineitem)
        select l_orderkey, coalesce(min(p) filter (where valid), -1)::int as plain, coalesce(min(w) filter (where valid), -1)::int as weighted from r group by 1""",
    "qe5": "with r as (select p_brand, row_number() over (partition by p_brand order by p_size, p_partkey)::double as x, row_number() over (partition by p_brand order by p_retailprice, p_partkey)::double as y from part) select p_brand, round(corr(x, y), 6) + 0.0 as rho from r group by p_brand",
    "qe6": """with k as (select distinct l_orderkey as set_id, l_suppkey as st from lineitem where l_linestatus = 'F'), f as (select distinct l_orderkey as found_id, l_suppkey as st from lineitem where l_returnflag <> 'A'), nk as (select set_id, count(*) as nk from k group by 1), nf as (select found_id, count(*) as nf from f group by 1),
        o as (select set_id, count(*) as n from k join f on f.found_id = k.set_id and f.st = k.st group by 1) select nk.set_id, case when n is not null then nk.set_id::varchar end as best, case when n is null then 'missed' when n = nk and n = nf then 'reproduced' else 'review' end as verdict from nk left join o using (set_id) left join nf on nf.found_id = nk.set_id""",
    "qe6b": """with k as (select distinct l_linestatus as c, l_orderkey as o, l_suppkey as st from lineitem), f as (select distinct l_linestatus as c, l_orderkey as o, l_suppkey as st from lineitem where l_returnflag <> 'A'), nk as (select c, o, count(*) as nk from k group by all), nf as (select c, o, count(*) as nf from f group by all),
        v as (select nk.c, nk.o, exists (select 1 from nf where nf.o = nk.o and nf.nf = nk.nk and (select count(*) from k x join f y on x.c = nk.c and y.c = nf.c and x.o = nk.o and y.o = nk.o and x.st = y.st) = nk.nk) as hit from nk),
        nm as (select distinct case when p_partkey % 2 = 0 then 'F' else 'O' end as c, replace(lower(p_name), ' ', '_') as n from part), b as (select c, count(*) as violations from (select distinct 'O' as c, replace(lower(p_name), ' ', '_') as n from part where p_size = 3) x semi join nm on nm.c = x.c and nm.n = x.n group by c),
        s as (select v.c as corpus, count(*) as sets, count(*) filter (where hit) as reproduced, coalesce(max(violations), 0) as violations, greatest(0, coalesce((select count(distinct o) from nf where nf.c = v.c), 0) - count(*)) as surplus from v left join b on b.c = v.c group by v.c)
        select *, reproduced = sets and violations = 0 and (corpus <> 'F' or surplus = 0) as pass from s""",
    "qe7": f"with {_QV}, c as (select label, max(s) as best from sm group by label), g as (select min(best) filter (where label >= 5) as a, max(best) filter (where label < 5) as b from c) select round(a, 6) as lowest_hit, round(b, 6) as highest_miss, round(a - b, 6) + 0.0 as gap, case when a > b then round((a + b) / 2, 6) end as floor from g",
}
SQL = {f"{k}_{_NAMES[k].__name__}": v for k, v in _SQL.items()}

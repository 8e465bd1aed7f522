"""Typed claims: validation, identity, blocks, contradictions, check logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.stem import morphology_sql, symbol_sql
from skein.operators.components import connected_components
from skein.operators.storage import written

#: Labels that name nobody. Fixed values.
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "this", "that", "these", "those"]


#: Roles of each kind of claim: (kind, role, least, most labels). Fixed values.
ROLES = [
    ("distinction", "distinguished", 2, None),
    ("dissociation", "dissociable", 2, None),
    ("identity-claim", "identified", 1, 1),
    ("identity-claim", "identified-with", 1, 1),
    ("exclusion", "excluder", 1, 1),
    ("exclusion", "excluded", 1, 1),
    ("joint-incompatibility", "incompatible", 2, None),
    ("causal-claim", "cause", 1, 1),
    ("causal-claim", "effect", 1, 1),
    ("property-assertion", "subject", 1, 1),
    ("property-assertion", "property", 1, 1),
    ("entailment", "antecedent", 1, 1),
    ("entailment", "consequent", 1, 1),
]
POLARITIES = ["asserts", "denies"]
MODALITIES = ["epistemic", "modal", "functional", "metaphysical"]
DIFFERENCES = ["in-kind", "in-degree"]
#: Kinds that must have a polarity.
SIGNED = ["causal-claim", "property-assertion"]


def claim_schema_issues(claims: DataFrame, participants: DataFrame, roles: DataFrame) -> DataFrame:
    """CL-1. (id, issue): claims (id, kind, polarity, modality, difference) whose participants (id,
    role, label) do not fit the role table (kind, role, least, most; most null: any number), the
    first issue in order; null if none. Where one label is wanted, it must stand once."""
    n = participants.where(F.btrim("label") != "").groupBy("id", "role").agg(F.count_distinct(F.btrim("label")).alias("n"), F.count(F.lit(1)).alias("all"))
    kinds = roles.select("kind").distinct().withColumn("known", F.lit(True))
    wanted = claims.select("id", "kind").join(roles, "kind").join(n, ["id", "role"], "left")
    fits = (F.coalesce("n", F.lit(0)) >= F.col("least")) & (F.col("most").isNull() | (F.coalesce("all", F.lit(0)) <= F.col("most")))
    wrong = wanted.groupBy("id").agg(F.max(~fits).alias("cardinality"))
    extra = participants.select("id", "role").distinct().join(claims.select("id", "kind"), "id").join(roles.select("kind", "role"), ["kind", "role"], "left_anti").select("id").distinct().withColumn("extra", F.lit(True))
    both = claims.join(kinds, "kind", "left").join(wrong, "id", "left").join(extra, "id", "left")
    other = lambda c, known: ~F.coalesce(F.col(c).isin(known), F.lit(True))
    issue = (
        F.when(F.col("known").isNull(), "unknown-kind")
        .when(F.col("extra"), "unexpected-role")
        .when(F.col("cardinality"), "cardinality")
        .when(F.col("kind").isin(SIGNED) & ~F.coalesce(F.col("polarity").isin(POLARITIES), F.lit(False)), "polarity")
        .when((F.col("kind") == "entailment") & other("polarity", POLARITIES), "polarity")
        .when(other("modality", MODALITIES), "modality")
        .when(other("difference", DIFFERENCES), "difference-kind")
    )
    return both.select("id", issue.alias("issue"))


def attribution_issues(claims: DataFrame) -> DataFrame:
    """CL-2. (id, issue) of claims (id, scope, holder, subject)."""
    issue = (
        F.when(~F.coalesce(F.col("scope").isin("corpus", "position"), F.lit(False)), "scope-missing")
        .when((F.col("scope") == "position") & F.col("holder").isNull(), "holder-missing")
        .when((F.col("scope") == "corpus") & F.col("holder").isNotNull(), "holder-unexpected")
        .when(F.lower(F.btrim("subject")).isin(PRONOUNS), "pronoun-subject")
    )
    return claims.select("id", issue.alias("issue"))


def claim_identity(claims: DataFrame, roles: str = "roles") -> DataFrame:
    """CL-3. ``canonical`` (kind, then roles in order with their labels), ``claim_key`` and
    ``occurrence_id`` (with the segment), both sha256. ``roles`` maps a role to its labels."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.array_sort(e["value"]), "|"))
    canonical = F.concat_ws(";", "kind", F.array_join(F.array_sort(F.transform(F.map_entries(roles), entry)), ";"))
    marked = claims.withColumn("canonical", canonical)
    return marked.withColumn("claim_key", F.sha2("canonical", 256)).withColumn("occurrence_id", F.sha2(F.concat_ws("\u0001", F.col("segment").cast("string"), "canonical"), 256))


def claim_incidence(claims: DataFrame, roles: str = "roles") -> DataFrame:
    """CL-4. (id, role, ordinal, label, node_id): one row a participant."""
    at = claims.select("id", F.explode(F.map_entries(roles)).alias("e")).select("id", F.col("e.key").alias("role"), F.posexplode("e.value").alias("ordinal", "label"))
    return at.withColumn("node_id", F.sha2(F.lower("label"), 256))


def claims_of_incidence(incidence: DataFrame) -> DataFrame:
    """CL-4, back: (id, roles)."""
    role = incidence.groupBy("id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label"))), lambda x: x["label"]).alias("labels"))
    return role.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "labels")))).alias("roles"))


def clique_projection(incidence: DataFrame) -> DataFrame:
    """CL-5. (a, b, n): pairs of participants of a claim, a < b, and the claims that hold both. A
    claim's participants are gathered and paired inside the row."""
    labels = incidence.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return labels.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def clause_noun(label: Column) -> Column:
    """What stands after a verb of making or meaning and an article, as a symbol; else null."""
    rest = F.regexp_extract(F.regexp_replace(F.lower(F.btrim(label)), r"[_\s]+", "-"), "^(?:makes?|causes?|implies|means)-(?:the|a|an)-(.+)$", 1)
    symbol = F.regexp_replace(F.regexp_replace(rest, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(symbol != "", symbol)


def canonical_predicates(labels: DataFrame, ontology: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """CL-6. (label, canonical, method) of each label: the canonical symbol of the ontology (label,
    canonical); else its own symbol if the closed vocabulary (word) has it; else what a clause such
    as "makes the ..." speaks of; else the only canonical symbol of the ontology with the same
    stems, word by word; else the shortest label of those left with the same stems, of equals the
    first. The last two are ``morphology`` where they change the symbol, ``unchanged`` where not.

    Labels are compared as symbols and stemmed once each; a null label is left out. Groups of one
    stem are minima, not lists."""
    own, stems = F.expr(symbol_sql("label")).alias("symbol"), F.expr(morphology_sql("label")).alias("stems")
    mine = labels.where("label is not null").select("label").distinct().select("label", own, stems)
    known = ontology.select(F.expr(symbol_sql("label")).alias("symbol"), F.expr(symbol_sql("canonical")).alias("o"), F.expr(morphology_sql("canonical")).alias("stems"))
    exact = known.groupBy("symbol").agg(F.min("o").alias("o"))
    by_stems = known.groupBy("stems").agg(F.min("o").alias("m"), F.count_distinct("o").alias("k")).where("k = 1").select("stems", "m")
    words = vocabulary.select(F.expr(symbol_sql("word")).alias("symbol"), F.lit(True).alias("v")).distinct()
    told = mine.join(exact, "symbol", "left").join(words, "symbol", "left").join(by_stems, "stems", "left").withColumn("r", clause_noun(F.col("label")))
    told = written(told, "predicates")
    left = told.where("o is null and v is null and r is null and m is null")
    short = left.groupBy("stems").agg(F.min(F.struct(F.char_length("symbol").alias("n"), "label", "symbol")).alias("s")).select("stems", F.col("s.symbol").alias("s"))
    found = told.join(short, "stems", "left").withColumn("canonical", F.when(F.col("o").isNotNull(), F.col("o")).when(F.col("v"), F.col("symbol")).otherwise(F.coalesce("r", "m", "s")))
    changed = F.when(F.col("canonical") == F.col("symbol"), "unchanged").otherwise("morphology")
    method = F.when(F.col("o").isNotNull(), "ontology").when(F.col("v"), "unchanged").when(F.col("r").isNotNull(), "repair").otherwise(changed)
    return found.select("label", "canonical", method.alias("method"))


def alias_suggestions(similar: DataFrame, blocks: DataFrame, least: float = 0.86) -> DataFrame:
    """CL-7. Of candidate matches (label, other, similarity) the best of each label from ``least``
    on; critical where the two never share a block (blocks: label, block)."""
    best = similar.where(F.col("similarity") >= least).groupBy("label").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("b"))
    pair = best.select("label", F.col("b.other").alias("other"), (-F.col("b.s")).alias("similarity"))
    other = blocks.select(F.col("label").alias("other"), "block")
    shared = pair.join(blocks, "label").join(other, ["other", "block"]).select("label", "other").distinct().withColumn("shared", F.lit(True))
    return pair.join(shared, ["label", "other"], "left").select("label", "other", "similarity", F.col("shared").isNull().alias("critical"))


def community_of_claim(claim_tokens: DataFrame, community_tokens: DataFrame) -> DataFrame:
    """CL-8. The community that shares most tokens with a claim, of those the smallest."""
    n = claim_tokens.distinct().join(community_tokens.distinct(), "token").groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("id", F.col("b.community").alias("community"), (-F.col("b.n")).alias("shared"))


def claim_blocks(claims: DataFrame) -> DataFrame:
    """CL-9. Accepted claims by corpus and holder (null for the corpus itself): distinct sorted
    propositions and segments, and the number of claims."""
    return claims.where("accepted").groupBy("corpus", "scope", "holder").agg(F.sort_array(F.collect_set("proposition")).alias("propositions"), F.sort_array(F.collect_set("segment")).alias("segments"), F.count(F.lit(1)).alias("claims"))


def claim_propositions(claims: DataFrame, roles: str = "roles") -> DataFrame:
    """CL-10. ``claims`` (kind, polarity, ``roles`` map of role to labels) with ``propositions``, the
    formulas of the claim's kind; null where a role that the kind needs is missing or the kind is
    not known. Take claims without an issue of CL-1 or CL-2."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"))
    one = lambda role: plain(F.get(F.col(roles)[role], 0))
    sign = F.when(F.col("polarity") == "denies", "-").otherwise("")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda a: text("exists x (", a, "(x))")
    rule = lambda a, arrow, b: text("all x (", a, "(x) ", arrow, " ", b, "(x))")
    members = F.array_sort(F.array_distinct(F.col(roles)["incompatible"]))
    but_last = F.array_join(F.transform(F.slice(members, 1, F.greatest(F.size(members) - 1, F.lit(0))), lambda m: F.concat(plain(m), F.lit("(x)"))), " & ")
    joint = F.when(F.size(members) >= 2, F.array(text("all x ((", but_last, ") -> -", plain(F.element_at(members, -1)), "(x))")))
    pair = lambda role, k: plain(F.get(F.col(roles)[role], k))
    apart = lambda role, i, j: text("exists x (", pair(role, i), "(x) & -", pair(role, j), "(x))")
    signed = lambda a, b, before: F.array(rule(one(a), "->", text(sign, before, one(b))), some(one(a)))
    needs_sign = F.col("polarity").isin(POLARITIES)
    made = (
        F.when(F.col("kind") == "joint-incompatibility", joint)
        .when(F.col("kind") == "exclusion", F.array(rule(one("excluder"), "-> -", one("excluded")), some(one("excluder"))))
        .when(F.col("kind") == "identity-claim", F.array(rule(one("identified"), "<->", one("identified-with")), some(one("identified"))))
        .when((F.col("kind") == "causal-claim") & needs_sign, signed("cause", "effect", "causes_"))
        .when((F.col("kind") == "property-assertion") & needs_sign, F.array(text(sign, one("property"), "(entity_", one("subject"), ")")))
        .when(F.col("kind") == "entailment", signed("antecedent", "consequent", ""))
        .when(F.col("kind") == "distinction", F.array(apart("distinguished", 0, 1)))
        .when(F.col("kind") == "dissociation", F.array(apart("dissociable", 0, 1), apart("dissociable", 1, 0)))
    )
    tidy = F.transform(made, lambda f: F.replace(f, F.lit("-> - "), F.lit("-> -")))
    return claims.withColumn("propositions", F.when(~F.exists(tidy, lambda f: f.isNull()), tidy))


def joint_violations(stances: DataFrame, impossible: DataFrame) -> DataFrame:
    """CL-11. (holder, set_id) where a holder (holder, stance) holds all of an impossible set
    (set_id, stance): relational division."""
    size = impossible.distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    held = stances.distinct().join(impossible.distinct(), "stance").groupBy("holder", "set_id").agg(F.count(F.lit(1)).alias("n"))
    return held.join(size, "set_id").where("n = size").select("holder", "set_id")


def subset_levels(witnesses: DataFrame, most: int = 6) -> tuple[list[DataFrame], list[DataFrame]]:
    """Level by level (from 1): sets of propositions that some witness (witness, proposition)
    satisfies together, and (from 2) minimal sets that none does. No level is left out: candidates
    are a written table, however many there are.

    A k-set is a candidate only if all its faces are consistent; support is counted over the
    witnesses, each of which extends its own supported sets.
    """
    w = written(witnesses.select("witness", "proposition").distinct(), "witnesses")
    held = w.select("witness", F.array("proposition").alias("set"))
    consistent, frustrated = [written(held.select("set").distinct(), "consistent")], []
    for k in range(2, most + 1):
        below = consistent[-1]
        left = below.select("set", F.slice("set", 1, k - 2).alias("head"))
        right = below.select(F.slice("set", 1, k - 2).alias("head"), F.element_at("set", -1).alias("last"))
        made = left.join(right, "head").where(F.col("last") > F.element_at("set", -1)).select(F.concat("set", F.array("last")).alias("set"))
        faces = made.select("set", F.explode(F.transform("set", lambda _, i: F.filter("set", lambda x, j: j != i))).alias("face"))
        ok = faces.join(below.select(F.col("set").alias("face")), "face", "left_semi").groupBy("set").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("set")
        candidates = written(ok, "candidates")
        held = held.join(w, "witness").where(F.col("proposition") > F.element_at("set", -1)).select("witness", F.concat("set", F.array("proposition")).alias("set"))
        held = written(held.join(candidates, "set", "left_semi"), "held")
        found = written(held.select("set").distinct(), "consistent")
        frustrated.append(written(candidates.join(found, "set", "left_anti"), "frustrated"))
        consistent.append(found)
    return consistent, frustrated


def minimal_unsat_sets(witnesses: DataFrame, most: int = 6) -> DataFrame:
    """CL-12. (arity, members): minimal sets, of 2 to ``most``, that no witness satisfies."""
    _, frustrated = subset_levels(witnesses, most)
    out = None
    for level in frustrated:
        rows = level.select(F.size("set").alias("arity"), F.array_join("set", ",").alias("members"))
        out = rows if out is None else out.unionByName(rows)
    return out


def consistency_graph(witnesses: DataFrame) -> DataFrame:
    """CL-13. One row: consistent pairs, components they form, filled triangles."""
    consistent, _ = subset_levels(witnesses, 3)
    pairs, triangles = consistent[1], consistent[2]
    edges = pairs.select(F.get("set", 0).alias("src"), F.get("set", 1).alias("dst"))
    parts = connected_components(edges).agg(F.count_distinct("component").alias("components"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).join(triangles.agg(F.count(F.lit(1)).alias("triangles")), F.lit(True)).join(parts, F.lit(True))  # one row each


def classify_verdict(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """CL-14. (set_id, verdict) of frustrated sets (set_id, block) by their blocks (block, holder,
    scope): the corpus against itself, one holder, or several."""
    s = sets.join(blocks, "block").groupBy("set_id").agg(F.max((F.col("scope") == "corpus")).alias("corpus"), F.count_distinct("holder").alias("holders"))
    verdict = F.when(F.col("corpus") & (F.col("holders") == 0), "corpus-contradiction").when(~F.col("corpus") & (F.col("holders") == 1), "position-contradiction").otherwise("positions-incompatible")
    return s.select("set_id", verdict.alias("verdict"))


def check_log_page(log: DataFrame, kind: str | None, verdict: str | None, blocks: list[str], offset: int = 0, limit: int = 25) -> DataFrame:
    """CL-15. Entries (seq, kind, verdict, blocks) that match, all of ``blocks`` in any case, a page
    at a time of at most 200."""
    found = log
    if kind:
        found = found.where(F.col("kind") == kind)
    if verdict:
        found = found.where(F.col("verdict") == verdict)
    has = F.transform("blocks", F.lower)
    for b in blocks:
        found = found.where(F.array_contains(has, b.lower()))
    return found.orderBy("seq").offset(offset).limit(min(limit, 200))


def check_log_digest(log: DataFrame) -> DataFrame:
    """CL-16. Counts by kind, by verdict, by both and in all (grouping sets)."""
    return log.cube("kind", "verdict").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def formula_ids(log: DataFrame, order: str) -> DataFrame:
    """CL-16. (formula, first): each formula once with the place of its first use, its dictionary key."""
    return log.select(order, F.explode("formulas").alias("formula")).groupBy("formula").agg(F.min(order).alias("first"))


def check_log_signals(log: DataFrame, most: int = 200) -> DataFrame:
    """CL-16. (place, seq, kind, verdict, formula_ids): entries (seq, kind, verdict, note, formulas)
    that are not plain consistent checks, contradictions first, then undetermined, vacuous, core and
    internal ones, by seq; at most ``most``, the digest's stated limit. Formulas are numbered by
    their first use among these."""
    vacuous = F.startswith(F.coalesce("note", F.lit("")), F.lit("VACUOUS"))
    rank = F.when(F.col("verdict") == "contradictory", 0).when(F.col("verdict") == "undetermined", 1).when(vacuous, 2).when(F.col("kind") == "core", 3).when(F.col("kind") == "internal", 4).otherwise(5)
    signal = (F.col("verdict") != "consistent") | F.col("kind").isin("core", "internal") | vacuous
    kept = log.where(signal).withColumn("rank", rank).orderBy("rank", "seq").limit(most)
    placed = written(kept.select((F.row_number().over(Window.orderBy("rank", "seq")) - 1).alias("place"), "seq", "kind", "verdict", "formulas"), "signals")  # `most` rows
    used = placed.select("place", F.posexplode("formulas").alias("pos", "formula"))
    first = used.groupBy("formula").agg(F.min(F.struct("place", "pos")).alias("at"))
    ids = first.select("formula", (F.row_number().over(Window.orderBy("at")) - 1).alias("id"))
    lists = used.join(ids, "formula").groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("formula_ids"))
    return placed.join(lists, "place", "left").select("place", "seq", "kind", "verdict", F.coalesce("formula_ids", F.array().cast("array<int>")).alias("formula_ids"))


def symbols(formula: Column) -> Column:
    """Array of (symbol, number of arguments) in a formula."""
    calls = F.regexp_extract_all(formula, F.lit(r"([A-Za-z_][A-Za-z0-9_]*\([^()]*\))"), F.lit(1))
    return F.transform(calls, lambda c: F.struct(F.substring_index(c, "(", 1).alias("symbol"), F.size(F.split(F.regexp_extract(c, r"\((.*)\)", 1), ",")).alias("arity")))


def block_symbols(formulas: DataFrame) -> DataFrame:
    """(block, symbol, arity) of formulas (block, formula)."""
    return formulas.select("block", F.explode(symbols(F.col("formula"))).alias("s")).select("block", "s.*").distinct()


def novel_symbols(formulas: DataFrame, known: DataFrame) -> DataFrame:
    """CL-17. Symbols of formulas that are not known (symbol)."""
    return block_symbols(formulas).select("symbol").distinct().join(known.select("symbol"), "symbol", "left_anti")


def rank_explanations(checks: DataFrame) -> DataFrame:
    """CL-18. Of check outcomes (hypothesis, coherent, entailed, novel): refuted if any is
    incoherent; depth = entailed / total; score = depth - 0.35 novel; ranked by status, score,
    fewer novel symbols, name."""
    s = checks.groupBy("hypothesis").agg(F.min("coherent").alias("coherent"), F.avg(F.col("entailed").cast("double")).alias("depth"), F.max("novel").alias("novel"))
    status = F.when(~F.col("coherent"), "refuted").when(F.col("depth") >= 1, "explains").when(F.col("depth") > 0, "partial").otherwise("idle")
    s = s.withColumn("status", status).withColumn("score", F.col("depth") - 0.35 * F.col("novel"))
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc(F.round("score", 9)), "novel", "hypothesis"))
    return s.select("hypothesis", "status", "depth", "score", place.alias("place"))


def subjects(formula: Column) -> Column:
    """Symbols that a formula speaks of: those before its arrow, without quantifiers."""
    head = F.regexp_replace(F.regexp_replace(formula, "->.*$", ""), "(?<![A-Za-z0-9_])(all|exists)\\s+[a-zA-Z_][A-Za-z0-9_]*", " ")
    return F.regexp_extract_all(head, F.lit("(?<![A-Za-z0-9_])([a-z_][A-Za-z0-9_]*)\\s*\\("), F.lit(1))


def formula_lint(formulas: DataFrame) -> DataFrame:
    """CL-19. (issue, block, symbol) of formulas (block, formula): symbols of several arities inside
    a block, or across blocks only; no negation in any formula; negative names beside a symbol that
    their base begins with or that begins with it; blocks with a witness of their own whose
    subjects no other block has. Two names that begin alike meet through the prefixes of each."""
    s = block_symbols(formulas)
    inside = s.groupBy("block", "symbol").agg(F.count_distinct("arity").alias("n")).where("n > 1").select(F.lit("arity-in-block").alias("issue"), "block", "symbol")
    across = s.groupBy("symbol").agg(F.count_distinct("arity").alias("n")).where("n > 1").join(inside.select("symbol").distinct(), "symbol", "left_anti")
    across = across.select(F.lit("arity-across-blocks").alias("issue"), F.lit(None).cast("string").alias("block"), "symbol")
    bare = formulas.agg(F.count_if(F.col("formula").rlike("~|-(?!>)")).alias("n"), F.count(F.lit(1)).alias("all")).where("n = 0 and all > 0")
    bare = bare.select(F.lit("negation-free").alias("issue"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("symbol"))
    names = s.select("symbol").distinct()
    negative = names.where(F.col("symbol").rlike("^(not|non|no)_.")).select("symbol", F.regexp_replace("symbol", "^(not|non|no)_", "").alias("base"))
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda n: F.substring(c, F.lit(1), n))
    longer = names.select(F.col("symbol").alias("other"), F.explode(prefixes(F.col("symbol"))).alias("base"))
    shorter = negative.select("symbol", F.explode(prefixes(F.col("base"))).alias("other")).join(names.toDF("other"), "other", "left_semi")
    alike = negative.join(longer, "base").select("symbol", "other").unionByName(shorter.select("symbol", "other")).where("symbol <> other")
    pseudo = alike.select(F.lit("negative-name").alias("issue"), F.lit(None).cast("string").alias("block"), "symbol").distinct()
    mine = formulas.select("block", F.explode(subjects(F.col("formula"))).alias("symbol")).distinct()
    shared = mine.groupBy("symbol").agg(F.count(F.lit(1)).alias("blocks"))
    private = mine.join(shared, "symbol").groupBy("block").agg(F.max("blocks").alias("most")).where("most = 1")
    witness = formulas.where(F.col("formula").rlike("(?<![A-Za-z0-9_])exists(?![A-Za-z0-9_])")).select("block").distinct()
    several = mine.agg(F.count_distinct("block").alias("n")).where("n > 1")
    orphan = private.join(witness, "block", "left_semi").join(several, F.lit(True)).select(F.lit("private-witness").alias("issue"), "block", F.lit(None).cast("string").alias("symbol"))  # one row
    return inside.unionByName(across).unionByName(bare).unionByName(pseudo).unionByName(orphan)


#: Nouns that add nothing to the name before them. Fixed values.
GENERIC = ["state", "type", "kind", "entity", "object", "concept", "property", "process", "claim"]


def singular(part: Column) -> Column:
    ies = part.endswith("ies") & (F.char_length(part) > 4)
    s = part.endswith("s") & ~part.endswith("ss") & (F.char_length(part) > 3)
    return F.when(ies, F.concat(F.substring(part, F.lit(1), F.char_length(part) - 3), F.lit("y"))).when(s, F.substring(part, F.lit(1), F.char_length(part) - 1)).otherwise(part)


def symbol_alias_candidates(occurrences: DataFrame, least: int = 5) -> DataFrame:
    """CL-20. (a, b, critical): symbols (symbol, block) of ``least`` letters or more that are equal
    once their parts are made singular, or of which one is the other with generic nouns after it;
    critical if they never share a block. Equi-joins on the normal form and on the first part."""
    parts = F.transform(F.split("symbol", "_"), singular)
    keyed = occurrences.select("symbol").distinct().where(F.char_length("symbol") >= least).select("symbol", parts.alias("parts"))
    same = keyed.select("symbol", F.array_join("parts", "_").alias("key"))
    one = keyed.where(F.size("parts") == 1).select("symbol", F.get("parts", 0).alias("key"))
    more = keyed.where((F.size("parts") > 1) & F.forall(F.slice("parts", 2, F.size("parts")), lambda p: p.isin(GENERIC))).select("symbol", F.get("parts", 0).alias("key"))
    met = same.toDF("x", "key").join(same.toDF("y", "key"), "key").where("x < y").unionByName(one.toDF("x", "key").join(more.toDF("y", "key"), "key"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    x, y = occurrences.select(F.col("symbol").alias("a"), "block").distinct(), occurrences.select(F.col("symbol").alias("b"), "block").distinct()
    shared = pairs.join(x, "a").join(y, ["b", "block"]).select("a", "b").distinct().withColumn("shared", F.lit(True))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.col("shared").isNull().alias("critical"))


def signature_components(occurrences: DataFrame) -> DataFrame:
    """CL-21. (block, component): blocks linked by shared symbols (symbol, block)."""
    edges = occurrences.select(F.concat(F.lit("b:"), "block").alias("src"), F.concat(F.lit("s:"), "symbol").alias("dst")).distinct()
    found = connected_components(edges)
    return found.where(F.col("node").startswith("b:")).select(F.expr("substring(node, 3)").alias("block"), F.expr("substring(component, 3)").alias("component"))


def extraction_failures(outcomes: DataFrame, causes: list[str]) -> DataFrame:
    """CL-22. (cause, n) of rejections by cause, causes that do not occur left out."""
    return outcomes.where(F.col("cause").isin(causes)).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))

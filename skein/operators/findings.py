"""Findings: admission, duplicates, conflicts, recall, retirement; evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import PREFERENCE
from skein.operators.ranking import range_row_number
from skein.operators.storage import written
from skein.operators.vectors import cosine


def admit_findings(rows: DataFrame) -> DataFrame:
    """FI-1. ``reason`` why a finding is refused, null if it is admitted: a text field is missing, a
    derived one has no claims, an evidential one no receipts, or its scope is above its grounds."""
    reason = (
        F.when(F.coalesce(F.btrim("verdict"), F.lit("")) == "", "missing-verdict")
        .when(F.coalesce(F.btrim("coverage"), F.lit("")) == "", "missing-coverage")
        .when((F.col("method") == "derived") & (F.coalesce(F.size("claims"), F.lit(0)) < 1), "missing-claims")
        .when((F.col("method") == "evidential") & (F.coalesce(F.col("receipts"), F.lit(0)) < 1), "missing-receipts")
        .when(F.col("scope") > F.col("grounds"), "scope-above-grounds")
    )
    return rows.withColumn("reason", reason)


def dedup_findings(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """FI-2. The first of the findings with one sha256 fingerprint of ``fields``, as a minimum."""
    print_ = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in fields]), 256)
    marked = rows.withColumn("fingerprint", print_)
    first = marked.groupBy("fingerprint").agg(F.min(order).alias(order))
    return marked.join(first, ["fingerprint", order], "left_semi")


def finding_conflicts(rows: DataFrame) -> DataFrame:
    """FI-3. (newer, older, reason, shared) of findings (id, namespace, corpus, outcome, method,
    conclusive, claims, at): one namespace, other outcomes, none evidential; both derived and
    conclusive with shared claims, or of other methods over one corpus with one conclusive. Two
    equi-joins: by claim, and by (namespace, corpus)."""
    usable = rows.where("method <> 'evidential'")
    a = usable.select([F.col(c).alias(f"a_{c}") for c in usable.columns])
    b = usable.select([F.col(c).alias(f"b_{c}") for c in usable.columns])
    later = (F.col("a_at") > F.col("b_at")) | ((F.col("a_at") == F.col("b_at")) & (F.col("a_id") > F.col("b_id")))
    derived = "{0}_method = 'derived' and {0}_conclusive"
    by_claim = (
        a.where(derived.format("a")).withColumn("claim", F.explode("a_claims"))
        .join(b.where(derived.format("b")).withColumn("claim", F.explode("b_claims")), "claim")
        .where((F.col("a_namespace") == F.col("b_namespace")) & (F.col("a_outcome") != F.col("b_outcome")) & later)
        .groupBy("a_id", "b_id").agg(F.array_join(F.sort_array(F.collect_set("claim")).cast("array<string>"), ",").alias("shared"))
        .select("a_id", "b_id", F.lit("claims").alias("reason"), "shared")
    )
    by_corpus = a.join(b, (F.col("a_namespace") == F.col("b_namespace")) & (F.col("a_corpus") == F.col("b_corpus"))).where(
        (F.col("a_outcome") != F.col("b_outcome")) & (F.col("a_method") != F.col("b_method")) & (F.col("a_conclusive") | F.col("b_conclusive")) & later
    ).select("a_id", "b_id", F.lit("corpus").alias("reason"), F.col("a_corpus").cast("string").alias("shared"))
    return by_claim.unionByName(by_corpus).toDF("newer", "older", "reason", "shared")


def resolve_conflict(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """FI-4. Conflicts with their ``status`` after decisions (winner, loser): decided ones are
    resolved, other open conflicts of a loser dismissed."""
    lost = decisions.select(F.col("loser").alias("l")).distinct()
    pair = decisions.select(F.least("winner", "loser").alias("x"), F.greatest("winner", "loser").alias("y"), F.lit(True).alias("decided")).distinct()
    keyed = conflicts.withColumn("x", F.least("newer", "older")).withColumn("y", F.greatest("newer", "older")).join(pair, ["x", "y"], "left")
    hit = keyed.join(lost.withColumnRenamed("l", "newer").withColumn("ln", F.lit(True)), "newer", "left").join(lost.withColumnRenamed("l", "older").withColumn("lo", F.lit(True)), "older", "left")
    status = F.when(F.col("decided"), "resolved").when(F.coalesce("ln", "lo"), "dismissed").otherwise("open")
    return hit.select("newer", "older", "reason", status.alias("status"))


def recall_findings(rows: DataFrame, query: Column, vector: str, now: Column, floor: float = 0.4, k: int = 3, days: int = 180) -> DataFrame:
    """FI-5. The best k active findings by cosine less 0.05 age share if unused, plus up to 0.05 for use."""
    used = F.col("recalls") + F.col("cites") > 0
    age = F.least(F.lit(1.0), F.date_diff(now, "at") / F.lit(days))
    rank = F.col("similarity") - F.when(used, 0.0).otherwise(0.05 * age) + F.least(F.lit(0.05), 0.01 * F.col("cites") + 0.002 * F.col("recalls"))
    near = rows.where("status = 'active'").withColumn("similarity", cosine(F.col(vector), query)).where(F.col("similarity") >= floor)
    return near.withColumn("score", rank).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def retire_findings(rows: DataFrame, protected: DataFrame, now: Column, days: int = 180, most: int = 500) -> DataFrame:
    """FI-6. (id, fate): archived if unused past retention; over ``most`` those of the least use, the
    oldest first, are archived, or held where a conflict protects them; else hot.

    Findings are ranked within ranges of their use and age, so that no task sees them all and none
    reach the driver; ids are taken to be unique.
    """
    guarded = rows.join(protected.select("id", F.lit(True).alias("guard")), "id", "left").withColumn("use", F.col("recalls") + 4 * F.col("cites"))
    expired = (F.col("use") == 0) & (F.date_diff(now, "at") > days) & F.col("guard").isNull()
    marked = written(guarded.select("id", "use", "at", "guard", F.coalesce(expired, F.lit(False)).alias("expired")), "guarded")
    gone = marked.where("expired").select("id", F.lit("archived").alias("fate"))
    left = marked.where("not expired")
    over = max(0, left.count() - most)
    if not over:
        return gone.unionByName(left.select("id", F.lit("hot").alias("fate")))
    low = F.col("rank") < over
    fate = F.when(low & F.col("guard").isNull(), "archived").when(low, "conflict-held").otherwise("hot")
    return gone.unionByName(range_row_number(left, [F.col("use"), F.col("at"), F.col("id")], "rank").select("id", fate.alias("fate")))


def dependency_audit(stored: DataFrame, current: DataFrame) -> DataFrame:
    """FI-7. (id, changes): names whose stored value (id, name, value) differs from the current one."""
    both = stored.join(current.select("name", F.col("value").alias("now")), "name", "left").where(~F.col("value").eqNullSafe(F.col("now")))
    text = F.concat("name", F.lit(":"), F.coalesce("value", F.lit("-")), F.lit(">"), F.coalesce("now", F.lit("-")))
    return both.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(text)), ";").alias("changes"))


def finding_stats(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """FI-8. One row: active, archived, open conflicts."""
    a = rows.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "archived").alias("archived"))
    return a.join(conflicts.agg(F.count_if(F.col("status") == "open").alias("open_conflicts")), F.lit(True))  # one row each


# Evidence.


def filter_noise(statements: DataFrame) -> DataFrame:
    """EV-1. ``verdict``: opinion (marked or worded so), assertion (no source), anecdote (one
    instance, kept) or evidence."""
    opinion = F.coalesce("is_normative", F.col("text").rlike(PREFERENCE))
    verdict = F.when(opinion, "opinion").when(F.col("source").isNull(), "assertion").when(F.col("instances") <= 1, "anecdote").otherwise("evidence")
    return statements.withColumn("verdict", verdict).withColumn("kept", F.col("verdict").isin("anecdote", "evidence"))


def weigh_evidence(statements: DataFrame, tiers: DataFrame, relevance: Column, questions: Column) -> DataFrame:
    """EV-2. relevance + reliability of the source's tier + share of sub-questions touched + 1 for a
    locator that can be looked up, and the sum. ``topics`` and ``questions`` are arrays."""
    coverage = F.when(F.size(questions) == 0, 0.0).otherwise(F.size(F.array_intersect("topics", questions)) / F.size(questions))
    place = F.when(F.col("locator").rlike(r"^(https?://|doi:|p\.? ?\d)"), 1.0).otherwise(0.0)
    rated = statements.join(tiers, "tier", "left").select("*", relevance.alias("relevance"), coverage.alias("coverage"), place.alias("verifiable"))
    return rated.withColumn("total", F.col("relevance") + F.coalesce("reliability", F.lit(0.0)) + F.col("coverage") + F.col("verifiable"))


def grounds_strength(evidence: DataFrame, key: str) -> DataFrame:
    """EV-3. clamp(.7 best / 4 + .3 min(1, n / 3) - .6 counter / 4 - .5 if only anecdotes); 0 without support."""
    s = F.col("bearing") == "supports"
    sums = evidence.groupBy(key).agg(F.max(F.when(s, F.col("total"))).alias("best"), F.count_if(s).alias("n"), F.max(F.when(~s, F.col("total"))).alias("counter"), F.min(F.when(s, F.col("anecdote"))).alias("only"))
    raw = 0.7 * F.col("best") / 4 + 0.3 * F.least(F.lit(1.0), F.col("n") / 3) - 0.6 * F.coalesce("counter", F.lit(0.0)) / 4 - F.when(F.col("only"), 0.5).otherwise(0.0)
    return sums.select(key, F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("strength"))


#: Strongest first. Fixed values.
SCOPES = ["universal", "general", "typical", "some", "at-least-one"]
CERTAINTIES = ["is", "indicates", "appears", "is-consistent-with"]


def scope_demand(scope: Column, certainty: Column) -> Column:
    """EV-4. .6 of the scope's cost and .4 of the certainty's, each falling along its ladder."""
    place = lambda ladder, c: F.array_position(F.array(*map(F.lit, ladder)), c) - 1
    return 0.6 * (1 - place(SCOPES, scope) / (len(SCOPES) - 1)) + 0.4 * (1 - place(CERTAINTIES, certainty) / (len(CERTAINTIES) - 1))


def calibrate_claim(claims: DataFrame) -> DataFrame:
    """EV-5. Claims (scope, certainty, strength) narrowed in scope first, then softened in certainty,
    until the demand is met or nothing is left: the new pair and the number of steps."""
    s = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")).cast("int")
    c = F.array_position(F.array(*map(F.lit, CERTAINTIES)), F.col("certainty")).cast("int")
    path = F.concat(
        F.transform(F.sequence(s, F.lit(len(SCOPES))), lambda i: F.struct(F.element_at(F.array(*map(F.lit, SCOPES)), i).alias("s"), F.col("certainty").alias("c"))),
        F.when(c < len(CERTAINTIES), F.transform(F.sequence(c + 1, F.lit(len(CERTAINTIES))), lambda i: F.struct(F.lit(SCOPES[-1]).alias("s"), F.element_at(F.array(*map(F.lit, CERTAINTIES)), i).alias("c")))).otherwise(F.array().cast("array<struct<s:string,c:string>>")),
    )
    walked = claims.withColumn("_path", path)
    fits = F.filter(F.transform("_path", lambda p, i: F.struct(i.alias("i"), (scope_demand(p["s"], p["c"]) <= F.col("strength") + 1e-12).alias("ok"))), lambda x: x["ok"])
    step = F.coalesce(F.get(fits, 0)["i"], F.size("_path") - 1)
    return walked.withColumn("steps", step).select("*", F.get("_path", F.col("steps"))["s"].alias("new_scope"), F.get("_path", F.col("steps"))["c"].alias("new_certainty")).drop("_path")


# Evaluation.


def ranking_value(rows: DataFrame, cycle: str, k: int) -> DataFrame:
    """QE-1. Per cycle, of candidates (id, base, combined, perturbed, held_out, cost): hits in the
    top k of either ranking, their reciprocal ranks, the overlap of the combined and the perturbed
    top k, the cost of an extra hit, and whether the combined ranking is retained."""
    rank = lambda c: F.row_number().over(Window.partitionBy(cycle).orderBy(F.desc(c), "id"))
    r = rows.withColumn("rb", rank("base")).withColumn("rc", rank("combined")).withColumn("rp", rank("perturbed"))
    hit = lambda c: F.count_if(F.col("held_out") & (F.col(c) <= k))
    sums = r.groupBy(cycle).agg(
        hit("rb").alias("base_hits"), hit("rc").alias("combined_hits"), F.coalesce(1 / F.min(F.when(F.col("held_out"), F.col("rb"))), F.lit(0.0)).alias("base_rr"),
        F.coalesce(1 / F.min(F.when(F.col("held_out"), F.col("rc"))), F.lit(0.0)).alias("combined_rr"),
        (F.count_if((F.col("rc") <= k) & (F.col("rp") <= k)) / F.count_if((F.col("rc") <= k) | (F.col("rp") <= k))).alias("stability"), F.sum("cost").alias("cost"),
    )
    gain = F.col("combined_hits") - F.col("base_hits")
    reasons = F.array_compact(F.array(F.when(gain <= 0, "no-extra-hits"), F.when(F.col("combined_rr") < F.col("base_rr"), "lower-rank"), F.when(F.col("stability") < 0.5, "unstable")))
    return sums.withColumn("cost_per_hit", F.when(gain > 0, F.col("cost") / gain)).withColumn("reasons", F.array_join(reasons, ",")).withColumn("decision", F.when(F.size(reasons) == 0, "retain").otherwise("retire"))


def extraction_scorecard(found: DataFrame, must: DataFrame, must_not: DataFrame, key: str, processed: DataFrame) -> DataFrame:
    """QE-2. Per run of ``processed`` (key, segments): recall of what must be found, number of what
    must not be but is, accepted claims a segment, and whether the run has none at all."""
    f = found.select(key, "claim").distinct()
    hit = f.join(must, "claim", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    bad = f.join(must_not, "claim", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("violations"))
    n = must.select("claim").distinct().count()
    both = processed.join(hit, key, "left").join(bad, key, "left").join(f.groupBy(key).agg(F.count(F.lit(1)).alias("accepted")), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        key, (zero("found") / F.lit(max(1, n))).alias("recall"), zero("violations").alias("violations"),
        F.try_divide(zero("accepted").cast("double"), F.col("segments")).alias("coverage"), F.col("accepted").isNull().alias("vacuous"),
    )


def run_agreement(outcomes: DataFrame, unmappable: DataFrame, runs: DataFrame, least: float = 0.9) -> DataFrame:
    """QE-3. Per corpus: segments, the share on which all runs agree in full, the segments on which
    they differ in kinds, roles, scopes, polarities, number of claims and in being unmappable; runs,
    latency in all and in the mean, cost (null unless every run has one), truncated and failed runs;
    and whether more sampling is advised.

    ``outcomes``: corpus, segment, run, claim, kind, roles (text), scope, polarity of accepted
    claims; ``unmappable``: corpus, segment, run; ``runs``: corpus, run, latency, cost, truncated,
    failed. A run without a segment has no claims there. Equal means that the least and the greatest
    form are one, and none is missing unless all are empty.
    """
    keys = ["corpus", "segment", "run"]
    forms = {"agreement": "claim", "kinds": "kind", "roles": "roles", "scopes": "scope", "polarities": "polarity"}
    text = lambda c: F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col(c), F.lit("null")))), "|")
    per = outcomes.groupBy(keys).agg(*[text(c).alias(k) for k, c in forms.items()], F.count(F.lit(1)).alias("claims"))
    per = per.join(unmappable.select(*keys, F.lit(True).alias("lost")).distinct(), keys, "full")
    runs_of = runs.groupBy("corpus").agg(F.count(F.lit(1)).alias("runs"))
    one = lambda c, none: (F.min(F.coalesce(c, none)) == F.max(F.coalesce(c, none))) & ((F.count(F.lit(1)) == F.first("runs")) | (F.max(F.coalesce(c, none)) == none))
    same = per.join(runs_of, "corpus").groupBy("corpus", "segment").agg(
        *[one(c, F.lit("")).alias(c) for c in forms], one("claims", F.lit(0)).alias("number"), one("lost", F.lit(False)).alias("mapping")
    )
    counted = same.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("segments"), F.avg(F.col("agreement").cast("double")).alias("agreement"),
        *[F.count_if(~F.col(c)).alias(f"differ_{c}") for c in ("kinds", "roles", "scopes", "polarities", "number", "mapping")],
    )
    cost = F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost"))
    total = runs.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("latency").alias("total_latency"), F.avg("latency").alias("mean_latency"), cost.alias("total_cost"),
        F.count_if("truncated").alias("truncated_runs"), F.count_if("failed").alias("failed_runs"),
    )
    advice = F.coalesce(F.col("agreement") < least, F.lit(True)) & (F.col("failed_runs") == 0)
    return total.join(counted, "corpus", "left").withColumn("sample_more", advice)


def tie_breaker_value(rows: DataFrame, group: str) -> DataFrame:
    """QE-4. Evaluations before the first valid candidate by edit count alone, and with ties broken
    by a role weight; null if none is valid. Nulls come last; of candidates that nothing tells apart a
    valid one comes first, so that the result does not depend on the order of rows."""
    edits, *rest = F.asc_nulls_last("edits"), F.asc_nulls_last("id"), F.desc("valid")
    plain = F.row_number().over(Window.partitionBy(group).orderBy(edits, *rest))
    weighted = F.row_number().over(Window.partitionBy(group).orderBy(edits, F.desc("weight"), *rest))
    r = rows.withColumn("p", plain).withColumn("w", weighted)
    return r.groupBy(group).agg(F.min(F.when(F.col("valid"), F.col("p"))).alias("plain"), F.min(F.when(F.col("valid"), F.col("w"))).alias("weighted"))


def spearman(rows: DataFrame, x: str, y: str, group: str, key: str) -> DataFrame:
    """QE-5. Rank correlation of two columns in each group, ties by key; 0 where a side does not vary."""
    rank = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(c, key)).cast("double")
    r = rows.select(group, rank(x).alias("rx"), rank(y).alias("ry"))
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return r.groupBy(group).agg(F.when(spread < 1e-12, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), spread), F.lit(0.0))).alias("rho"))


def verdict_scorecard(known: DataFrame, found: DataFrame) -> DataFrame:
    """QE-6. (set_id, best, verdict) for each known set (set_id, stance): reproduced by a found set
    of the same stances, else review for a partial match, else missed. Equal sets meet as one, and
    overlaps are counted over an equi-join on the stance."""
    whole = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_set("stance")).alias("stances"))
    k, f = written(whole(known, "set_id"), "known"), whole(found, "found_id").groupBy("stances").agg(F.min("found_id").alias("found_id"))
    distinct = k.select("stances").distinct()
    each = lambda df, *c: df.select(*c, F.explode("stances").alias("stance"))
    n = each(distinct, "stances").join(each(f, F.col("stances").alias("of"), "found_id"), "stance").groupBy("stances", "of", "found_id").agg(F.count(F.lit(1)).alias("n"))
    exact = F.col("stances") == F.col("of")
    best = n.groupBy("stances").agg(F.min(F.struct((~exact).alias("part"), (-F.col("n")).alias("n"), "found_id")).alias("b"))
    verdict = F.when(F.col("b").isNull(), "missed").when(~F.col("b.part"), "reproduced").otherwise("review")
    return k.join(best, "stances", "left").select("set_id", F.col("b.found_id").alias("best"), verdict.alias("verdict"))


def verdict_totals(scored: DataFrame, found: DataFrame, must_not: DataFrame, names: DataFrame, inverted: list[str]) -> DataFrame:
    """QE-6. Per corpus of scored sets (corpus, set_id, verdict): sets, reproduced ones, violations
    (names of must_not (corpus, name) among the found names (corpus, name)), surplus of found sets
    (corpus, found_id) over known ones, and whether it passes: all reproduced, no violation, and in
    an ``inverted`` corpus no surplus."""
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_")
    bad = must_not.select("corpus", plain.alias("name")).join(names.select("corpus", plain.alias("name")).distinct(), ["corpus", "name"], "left_semi").groupBy("corpus").agg(F.count(F.lit(1)).alias("violations"))
    more = found.groupBy("corpus").agg(F.count_distinct("found_id").alias("found"))
    s = scored.groupBy("corpus").agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("verdict") == "reproduced").alias("reproduced")).join(bad, "corpus", "left").join(more, "corpus", "left")
    surplus = F.greatest(F.lit(0), F.coalesce("found", F.lit(0)) - F.col("sets"))
    s = s.select("corpus", "sets", "reproduced", F.coalesce("violations", F.lit(0)).alias("violations"), surplus.alias("surplus"))
    return s.withColumn("pass", (F.col("reproduced") == F.col("sets")) & (F.col("violations") == 0) & (~F.col("corpus").isin(inverted) | (F.col("surplus") == 0)))


def similarity_floor(cues: DataFrame) -> DataFrame:
    """QE-7. One row of cues (hit, best): lowest hit, highest miss, gap, and the floor between them
    if they part."""
    s = cues.agg(F.min(F.when(F.col("hit"), F.col("best"))).alias("lowest_hit"), F.max(F.when(~F.col("hit"), F.col("best"))).alias("highest_miss"))
    gap = F.col("lowest_hit") - F.col("highest_miss")
    return s.withColumn("gap", gap).withColumn("floor", F.when(gap > 0, (F.col("lowest_hit") + F.col("highest_miss")) / 2))

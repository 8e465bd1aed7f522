"""Sets of propositions against brute force."""

import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions.stem import porter_sql
from skein.operators import claims


def witnesses_df(spark, holds):
    return spark.createDataFrame([(i, p) for i, ps in enumerate(holds) for p in ps], "witness long, proposition string")


@pytest.mark.parametrize("seed", range(2))
def test_minimal_unsat_sets_to_arity_six(spark, seed):
    r = random.Random(seed)
    names = "abcdefgh"
    # All witnesses of a set of six but the whole set, and a few others.
    holds = [set("abcdef") - {x} for x in "abcdef"] + [set(r.sample(names, r.randint(2, 5))) for _ in range(12)]
    want = set()
    for k in range(2, 7):
        for s in combinations(names, k):
            held = lambda t: any(set(t) <= h for h in holds)
            if not held(s) and all(held(f) for f in combinations(s, k - 1)):
                want.add((k, ",".join(s)))
    assert (6, "a,b,c,d,e,f") in want
    got = [tuple(x) for x in claims.minimal_unsat_sets(witnesses_df(spark, holds)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_level_of_over_a_million_candidates_is_not_left_out(spark):
    n = 1500
    df = witnesses_df(spark, [[f"{i:04d}"] for i in range(n)])
    assert claims.minimal_unsat_sets(df, 2).count() == n * (n - 1) // 2
    assert tuple(claims.consistency_graph(df).first()) == (0, 0, 0)


#: Words and stems from the paper of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll theories theori theory theori recommends recommend recommending recommend is is by by""".split()


def test_stems(spark):
    words, want = STEMS[::2], STEMS[1::2]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.expr(porter_sql("w")).alias("s")).collect()
    assert [r.s for r in got] == want
    con = duckdb.connect()
    assert [con.execute(f"select {porter_sql('w', False)} from (select ? as w)", [w]).fetchone()[0] for w in words] == want


def test_forms_of_predicates(spark):
    labels = ["lesion-adequate", "lesion-adequacy", "newcomb-adequate", "newcomb-adequacy", "recommends-refraining", "recommending-refraining", "mental", "mental-states", "Makes the mind free", "theories", "theory", "Closed Word", None]
    df = spark.createDataFrame([(x,) for x in labels + labels[:3]], "label string")
    ontology = spark.createDataFrame([("adequate for lesions", "lesion_adequacy"), ("x", "newcomb_adequacy")], "label string, canonical string")
    words = spark.createDataFrame([("closed_word",)], "word string")
    got = {r.label: (r.canonical, r.method) for r in claims.canonical_predicates(df, ontology, words).collect()}
    assert got == {
        "lesion-adequate": ("lesion_adequacy", "morphology"), "lesion-adequacy": ("lesion_adequacy", "unchanged"), "newcomb-adequate": ("newcomb_adequacy", "morphology"), "newcomb-adequacy": ("newcomb_adequacy", "unchanged"),
        "recommends-refraining": ("recommends_refraining", "unchanged"), "recommending-refraining": ("recommends_refraining", "morphology"), "mental": ("mental", "unchanged"), "mental-states": ("mental_states", "unchanged"),
        "Makes the mind free": ("mind_free", "repair"), "theory": ("theory", "unchanged"), "theories": ("theory", "morphology"), "Closed Word": ("closed_word", "unchanged"),
    }
    two = spark.createDataFrame([("a", "state"), ("b", "stating")], "label string, canonical string")  # of two with one stem none is taken
    assert claims.canonical_predicates(spark.createDataFrame([("states",)], "label string"), two, words).collect()[0].canonical == "states"
    assert claims.canonical_predicates(df.where("false"), ontology, words).count() == 0

"""Exact top-k by Hamming distance: incremental multi-index hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.runtime import written


def sign_code(vector: Column) -> Column:
    """The 64-bit code of a vector of at most 64 numbers: bit i is set if number i is above zero.
    A null vector has no code; one of more numbers is an error."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    long = F.raise_error(F.concat(F.lit("a code has 64 bits; this vector has "), F.size(vector).cast("string")))
    return F.when(F.size(vector) > 64, long.cast("long")).otherwise(code)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(``query_id``, ``rank`` int from 1, ``neighbour_id``, ``distance`` int): the k rows nearest to each
    query by (distance, id), the row with the query's own id left out.

    Rows and queries need an id and a 64-bit ``code_col``; those without are neither found nor
    asked. Equal rows are one row, equal queries one query; an id with several codes is a row for
    each. Other columns are ignored; an empty side gives an empty result; fewer than k rows give all.

    Codes are cut into m segments of about log2(rows) bits. Round r looks up, in each segment, all
    keys at r bits from the query's; after it, all codes within m (r + 1) - 1 bits have been seen,
    and a query whose kth distance is no greater is done. A pair is taken in the round and the
    segment where it is met first, so never twice. Copies of a code are one entry with its k + 1
    least ids, and queries with one code are asked once.
    """
    known = written(rows.where(F.col(code_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).distinct(), "known")
    asked = queries.where(F.col(code_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")).distinct()
    own_codes = known.join(asked.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").groupBy("id").count().agg(F.max("count")).first()[0]
    need = k + (own_codes or 1)  # a query's own rows are left out at the end
    ranked = known.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("rn") <= need)
    entries = written(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    # A probe costs as much as some compares: keys are a few bits short of one entry a bucket.
    m = math.ceil(64 / min(32, max(8, math.log2(max(entries.count(), 2)) - 3)))
    edges = [64 * i // m for i in range(m + 1)]
    cuts = [(a, b - a) for a, b in zip(edges, edges[1:])]
    width = max(bits for _, bits in cuts)
    piece = lambda c, cut: F.shiftrightunsigned(c, cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1))
    segment = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), piece(F.col("code"), cut).alias("key")) for s, cut in enumerate(cuts)]))
    index = written(entries.select("code", F.get("ids", 0).alias("first"), F.size("ids").alias("n"), segment.alias("x")).select("code", "first", "n", "x.*"), "segments")
    open_q = written(asked.select("q").distinct(), "open")
    best = done = probes = reached = None
    order = Window.partitionBy("q").orderBy("distance", "first", "code")
    for r in range(width + 1):
        if r == 0:
            own = F.explode(F.array(*[F.struct(F.lit(s).alias("ps"), piece(F.col("q"), cut).alias("own"), F.lit(cut[1]).alias("bits")) for s, cut in enumerate(cuts)]))
            probes = open_q.select("q", own.alias("x")).select("q", "x.*", F.lit(0).cast("long").alias("flip"))
        else:  # one more bit, above those that are flipped: each choice of r bits comes up once
            more = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda x: (x > F.col("flip")) & (x < F.pow(F.lit(2), F.col("bits"))))
            probes = probes.join(open_q, "q", "left_semi").withColumn("x", F.explode(more)).select("q", "ps", "own", "bits", F.col("flip").bitwiseOR(F.col("x")).alias("flip"))
        probes = written(probes, "probes")
        bound = F.lit(64) if best is None else F.coalesce("kth", F.lit(64))  # farther ones cannot enter any more
        sent = probes if best is None else probes.join(reached, "q", "left")
        sent = sent.select("q", "ps", F.col("own").bitwiseXOR(F.col("flip")).alias("pkey"), bound.alias("most"))
        apart = [F.bit_count(piece(F.col("q").bitwiseXOR(F.col("code")), cut)) for cut in cuts]
        first_met = F.lit(True)
        for s, d in enumerate(apart):
            first_met = first_met & F.when(F.col("s") > s, d > r).when(F.col("s") < s, d >= r).otherwise(True)
        # Probes are many more than their source's size tells, so that neither side may be sent whole.
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        near = (F.col("ps") == F.col("s")) & (F.col("pkey") == F.col("key")) & (distance <= F.col("most")) & first_met
        met = sent.join(index.hint("shuffle_hash"), near).select("q", "code", "first", "n", distance.alias("distance"))
        seen = met if best is None else met.unionByName(best.join(open_q, "q", "left_semi"))
        best = written(seen.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= need).drop("rn"), "best")
        reached = written(best.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") >= need).groupBy("q").agg(F.min("distance").alias("kth")), "reached")
        covered = len(cuts) * (r + 1) - 1 if r < width else 64
        finished = reached.where(F.col("kth") <= covered).select("q") if r < width else open_q
        open_now = written(open_q.join(finished, "q", "left_anti"), "open")
        closed = best.join(open_now, "q", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        open_q = open_now
        if open_q.isEmpty():
            break
    members = done.join(entries.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("id"))
    nearest = members.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rn") <= need)
    lists = written(nearest.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near")), "lists")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.distance").alias("distance")
    )

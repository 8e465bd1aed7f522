"""Vectors: similarity, sections, routing, context."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.storage import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    """EN-10. 0 where a norm is below 1e-12."""
    return F.when(a.isNull() | b.isNull(), None).when((norm(a) < 1e-12) | (norm(b) < 1e-12), 0.0).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def similarity_search(rows: DataFrame, query: list[float], floor: float, k: int, vector: str, key: str) -> DataFrame:
    """VE-1. The best k rows of a cosine of at least ``floor`` to one vector."""
    near = rows.withColumn("similarity", cosine(F.col(vector), F.array(*map(F.lit, query))))
    return near.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(k)


#: Numbers in the vectors of a block of queries and of a block of rows that meet in one task, and the
#: most products it holds at once: 32, 8 and 32 MB of doubles.
BLOCK_NUMBERS = 4_000_000
ROW_NUMBERS = 1_000_000
PRODUCTS = 4_000_000

#: What rounding can do to a cosine is far below this.
SLACK = 1e-9


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added in the order in which ``dot`` adds."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best_of_block(queries, rows, floor: float, k: int):
    """(query place, row place, similarity): the best k of ``rows``, which lie in the order of their
    key, for each of ``queries``. A product of matrices leaves the rows that may be among them; these
    are added up as in ``cosine``, so that equal vectors are equal to the last bit."""
    # Of equal vectors the first k can be among the best.
    _, same = np.unique(np.ascontiguousarray(rows).view(f"V{8 * rows.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.searchsorted(same[order], same[order])
    place = np.sort(order[np.arange(len(order)) - starts < k])
    rows = rows[place]
    norm_q, norm_r = np.sqrt(_folded(queries, queries)), np.sqrt(_folded(rows, rows))
    scaled, found, step = (rows / norm_r[:, None]).T, [], max(1, PRODUCTS // len(rows))
    for at in range(0, len(queries), step):
        near = (queries[at : at + step] / norm_q[at : at + step, None]) @ scaled
        least = np.full(len(near), floor) if len(rows) <= k else np.maximum(floor, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
        q, r = np.nonzero(near >= least[:, None] - SLACK)
        q += at
        total = np.zeros(len(q))
        for i in range(rows.shape[1]):
            total += rows[r, i] * queries[q, i]
        similarity = total / (norm_r[r] * norm_q[q])
        q, r, similarity = (x[similarity >= floor] for x in (q, r, similarity))
        by = np.lexsort((r, -similarity, q))
        q, r, similarity = q[by], r[by], similarity[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first], place[r[first]], similarity[first]))
    return [np.concatenate(x) for x in zip(*found)]


def similarity_search_batch(rows: DataFrame, queries: DataFrame, floor: float, k: int, vector: str, key: str) -> DataFrame:
    """VE-2. (query_id, rank, key, similarity): the best k of each of a table of query vectors.

    A stated query set against all rows. Queries (query_id, qv) and rows are dealt into blocks by
    their number, and each block of queries meets each block of rows in one task, where a product of
    matrices finds the few rows a query that are then compared exactly; only k rows a query leave a
    task. Vectors whose norm is no usable number (``cosine`` says what they give) meet the others by
    a plain join, as far as ``floor`` lets anything of it through.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    dealt = lambda df, c, id_: df.select(F.col(id_).alias("_id"), F.col(c).cast("array<double>").alias("_v"), F.size(c).alias("_size"), norm(F.col(c)).alias("_norm"))
    usable = F.col("_norm").between(1e-12, 1e100) & (F.col("_norm") > 0)
    asked, given = written(dealt(queries, "qv", "query_id"), "asked"), dealt(rows, vector, key)
    kind_q, kind_r = dict(asked.dtypes)["_id"], dict(given.dtypes)["_id"]
    n_q, n_r = (df.agg(F.coalesce(F.sum(F.greatest(F.lit(1), "_size")), F.lit(0))).first()[0] for df in (asked, given))
    blocks_q, blocks_r = max(1, -(-n_q // BLOCK_NUMBERS)), max(1, -(-n_r // ROW_NUMBERS))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": left["_id"][:0], "_id": right["_id"][:0], "similarity": pa.array([], pa.float64())})
        right = right.take(pc.sort_indices(right, sort_keys=[("_id", "ascending")], null_placement="at_start"))
        cut = lambda t: t["_v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        q, r, similarity = _best_of_block(cut(left), cut(right), floor, k)
        return pa.table({"query_id": left["_id"].take(pa.array(q)), "_id": right["_id"].take(pa.array(r)), "similarity": pa.array(similarity)})

    at = ["_size", "_q", "_r"]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = lambda n: F.pmod(F.xxhash64("_id", "_v"), F.lit(n)).cast("int")
    left = asked.where(usable & (F.col("_size") > 0)).select("_id", "_v", "_size", part(blocks_q).alias("_q"), every(blocks_r, "_r"))
    right = given.where(usable & (F.col("_size") > 0)).select("_id", "_v", "_size", part(blocks_r).alias("_r"), every(blocks_q, "_q"))
    tasks = blocks_q * blocks_r
    pairs = left.repartition(tasks, *at).groupBy(*at).cogroup(right.repartition(tasks, *at).groupBy(*at))
    found = pairs.applyInArrow(best, f"query_id {kind_q}, _id {kind_r}, similarity double")

    # Above 0 a norm that is null or next to nothing gives no similarity; others may be NaN, or beyond 1e100.
    odd = ~F.coalesce(usable, F.lit(False)) & (F.lit(floor <= 0) | F.coalesce(F.col("_norm") > 1, F.lit(False)))
    q, r = asked.select(F.col("_id").alias("query_id"), F.col("_v").alias("qv"), odd.alias("odd_q")), given.select("_id", F.col("_v").alias("rv"), odd.alias("odd_r"))
    rest = [q.where("odd_q").join(r, F.lit(True)), q.where("not odd_q").join(r.where("odd_r"), F.lit(True))]
    for met in rest:
        found = found.unionByName(met.select("query_id", "_id", cosine(F.col("rv"), F.col("qv")).alias("similarity")).where(F.col("similarity") >= floor))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(key), "similarity")


def centroid(rows: DataFrame, group: str, vector: str, dimension: int | None = None) -> DataFrame:
    """(group, centroid): the mean vector of each group; vectors of another dimension are skipped."""
    usable = rows if dimension is None else rows.where(F.size(vector) == dimension)
    means = usable.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def concept_vector(rows: DataFrame, group: str, vector: str, dimension: int | None = None) -> DataFrame:
    """VE-3. The mean vector of a section at length 1."""
    c = F.col("centroid")
    return centroid(rows, group, vector, dimension).select(group, F.transform(c, lambda x: F.when(norm(c) < 1e-12, 0.0).otherwise(F.try_divide(x, norm(c)))).alias("concept"))


def concept_similarity(concepts: DataFrame, group: str) -> DataFrame:
    """VE-4. (a, b, similarity) for a < b: dot product, -1 for a missing vector or another size. A
    section has one vector; they are compared pair by pair on their order."""
    a, b = concepts.toDF("a", "va"), concepts.toDF("b", "vb")
    ok = F.size("va") == F.size("vb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(ok, dot(F.col("va"), F.col("vb"))).otherwise(-1.0).alias("similarity"))


def concept_subspace(rows: DataFrame, group: str, vector: str, k: int) -> DataFrame:
    """VE-5. (group, rank, direction): the first k principal directions of each section, of the
    centred second moment (of fixed size). With n <= k vectors n - 1 directions; one vector itself."""
    from skein.operators.entropy import second_moment

    kind = dict(rows.dtypes)[group]
    mean = centroid(rows, group, vector)
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    moments = second_moment(rows, group, vector).join(mean, group).join(n, group)

    def directions(pdf):
        import pandas as pd

        d, count = int(pdf["j"].max()) + 1, int(pdf["n"].iloc[0])
        mu = np.array(pdf["centroid"].iloc[0])
        m = np.zeros((d, d))
        m[pdf["i"], pdf["j"]] = pdf["m"]
        m[pdf["j"], pdf["i"]] = pdf["m"]
        if count == 1:
            found = [mu / max(np.linalg.norm(mu), 1e-12)]
        else:
            _, vectors = np.linalg.eigh(m - np.outer(mu, mu))
            found = [vectors[:, -1 - r] for r in range(min(k, count - 1 if count <= k else k))]
        found = [v if v[np.argmax(np.abs(v))] > 0 else -v for v in found]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(found), "rank": range(1, len(found) + 1), "direction": [v.tolist() for v in found]})

    return moments.groupBy(group).applyInPandas(directions, f"{group} {kind}, rank int, direction array<double>")


def section_graph(similarities: DataFrame, most: int = 2, floor: float = 0.4) -> DataFrame:
    """VE-6. Undirected edges of each section to its ``most`` most similar others."""
    both = similarities.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "similarity"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))).alias("e")).select("e.*").where(F.col("similarity") >= floor)
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "y"))).where(F.col("rn") <= most)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").distinct()


def route_query(items: DataFrame, sections: DataFrame, query: list[float], group: str, vector: str) -> DataFrame:
    """VE-7. Sections by their best item's cosine to the query; -1 for an empty section."""
    best = items.groupBy(group).agg(F.max(cosine(F.col(vector), F.array(*map(F.lit, query)))).alias("score"))
    return sections.select(group).join(best, group, "left").select(group, F.coalesce("score", F.lit(-1.0)).alias("score"))


def staged_query(items: DataFrame, query: list[float], group: str, vector: str, key: str, content: str, sources: DataFrame) -> DataFrame:
    """VE-8. The best item of the best section and what it stands for: the text of an entry, or all
    source entries (summary, seq, content) of a summary, joined by a blank line. Both steps of the
    route are one ordering by the item's score."""
    best = similarity_search(items, query, -1.0, 1, vector, key)
    under = sources.select(F.col("summary").alias(key), "seq", F.col("content").alias("source")).join(best.select(key), key, "left_semi")  # one summary
    texts = under.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]), "\n\n").alias("sources"))
    return best.join(texts, key, "left").select(group, key, "similarity", F.coalesce("sources", F.col(content)).alias("context"))


def root_summaries(summaries: DataFrame) -> DataFrame:
    """VE-9. Summaries (id, children) that are nobody's child."""
    return summaries.join(summaries.select(F.explode("children").alias("id")), "id", "left_anti")


def expand_summary(summaries: DataFrame, compressions: DataFrame, entries: DataFrame) -> DataFrame:
    """VE-10. (id, step, place, content): the summary, then its compressions, then its entries."""
    one = summaries.select("id", F.lit(0).alias("step"), F.lit(0).cast("long").alias("place"), "content")
    two = compressions.select("id", F.lit(1).alias("step"), F.col("level").cast("long").alias("place"), "content")
    three = entries.select("id", F.lit(2).alias("step"), F.col("seq").cast("long").alias("place"), "content")
    return one.unionByName(two).unionByName(three)


def compaction_due(entries: DataFrame, consolidated: DataFrame, least: int = 4000, hard: int = 32000) -> DataFrame:
    """VE-11. Per group the tokens not yet in a summary, whether they are due, and the target size.
    ``entries``: grp, id, tokens, settled."""
    left = entries.join(consolidated, ["grp", "id"], "left_anti").groupBy("grp").agg(F.sum("tokens").alias("open"), F.max("settled").alias("settled"))
    total = entries.groupBy("grp").agg(F.sum("tokens").alias("total"))
    due = (F.col("open") >= least) & (F.col("settled") | (F.col("total") >= hard))
    return left.join(total, "grp").select("grp", "open", "total", due.alias("due"), F.greatest(F.lit(64), F.floor(F.col("open") * 0.4)).alias("target"))


def stale_embeddings(rows: DataFrame, group: str, model: str, vector: str, current: str, dimension: int) -> DataFrame:
    """VE-12. (group, reasons): why its vectors cannot be used."""
    per = rows.groupBy(group).agg(F.max(model).alias("m"), F.count_distinct(F.size(vector)).alias("sizes"), F.max(F.size(vector)).alias("size"), F.count_if(F.col(model).isNull()).alias("untagged"))
    reasons = F.array_compact(F.array(
        F.when(F.col("untagged") > 0, "no-model"), F.when(F.col("m") != current, "other-model"), F.when(F.col("sizes") > 1, "mixed-sizes"), F.when(F.col("size") != dimension, "other-size"),
    ))
    return per.select(group, reasons.alias("reasons")).where(F.size("reasons") > 0)


def citations(texts: DataFrame, findings: DataFrame, text_col: str) -> DataFrame:
    """VE-13. (id, n): marks of known findings."""
    from skein.functions.text import finding_marks

    return texts.select(F.explode(finding_marks(F.col(text_col))).alias("id")).join(findings.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def bond_types(observations: DataFrame, near: float = 0.7, path: float = 5.0) -> DataFrame:
    """VE-14. Of the last observation of each pair: covalent if logical, hydrogen if the vectors are
    within ``near``, vanDerWaals if the trajectory is at least ``path`` long, else none."""
    last = observations.groupBy("src", "dst").agg(F.max_by(F.struct("logical", "distance", "trajectory"), "at").alias("o"))
    kind = F.when(F.col("o.logical"), "covalent").when(F.col("o.distance") <= near, "hydrogen").when(F.col("o.trajectory") >= path, "vanDerWaals")
    return last.select("src", "dst", kind.alias("bond")).where("bond is not null")

"""Ranks over whole tables without sending a table, or a large group, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.storage import written


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bucketed_row_number(df: DataFrame, groups: list[str], bucket: Column, order: list, name: str = "row_number") -> DataFrame:
    """``df`` with ``name``: the row's place from 0 within its group, ordered by (bucket, order).

    ``bucket`` deals a group's rows over tasks; if it does not decrease along ``order``, the rank
    is the one by ``order`` alone. Only the counts of the buckets are summed along a group. Null
    group keys form a group. With no ``groups`` the rank is over the whole table. Columns of
    ``df`` may have any names; one called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    *keys, at, start, size, place = fresh(df, *[f"_g{i}" for i in range(len(groups))], "_bucket", "_start", "_n", "_within")
    null_safe = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")).alias(k) for g, k in zip(groups, keys)]
    dealt = df.select("*", *null_safe, bucket.alias(at))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, at).agg(F.count(F.lit(1)).alias(size))
    starts = counts.select(*keys, at, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*keys, at).orderBy(*order)
    ranked = dealt.withColumn(place, F.row_number().over(within) - 1)
    return ranked.join(starts, [*keys, at]).select(*[F.col(f"`{c}`") for c in kept], (F.col(start) + F.col(place)).alias(name))


def range_row_number(df: DataFrame, order: list, name: str = "row_number", rows: int = 50_000) -> DataFrame:
    """``df`` with ``name``: the row's place from 0 in ``order``, which should be total. Rows are
    dealt by ranges of the order, of about ``rows`` each, and written with the number of theirs."""
    (at,) = fresh(df, "_range")
    ranges = df.repartitionByRange(1 + df.count() // rows, *order).withColumn(at, F.spark_partition_id())
    return bucketed_row_number(written(ranges, "ranges"), [], F.col(at), order, name).drop(at)


def falling(df: DataFrame, name: str, buckets: int = 64) -> Column:
    """A bucket for ranks by a falling number: how many of the table's quantiles are above it."""
    cuts = df.agg(F.percentile_approx(name, [k / buckets for k in range(1, buckets)])).first()[0] or []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(name))) if cuts else F.lit(0)

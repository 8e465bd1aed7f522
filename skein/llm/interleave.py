"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.ranking import bucketed_row_number

#: Rows that one task of a ranking step may expect.
BUCKET_ROWS = 50_000


def interleave(rows: DataFrame, shards: int, stratum_col: str = "source", id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    Within each stratum rows are shuffled by a seeded hash of the id and ranked; all rows are then
    ordered by the fraction of their stratum that lies before them, and cut into ``shards`` runs
    whose row counts differ by one at most. So each shard has each stratum in proportion.

    A null stratum is a stratum of its own. Rows with equal ids take places next to each other,
    in the order of their other columns (as JSON where they hold maps). Columns may have any names;
    those called ``shard`` or ``slot`` are replaced; an empty table gives an empty table.

    Both rankings are dealt out by ranges of the (uniform) hash or fraction, never by stratum
    alone, so that a stratum with most of the rows is no hot key.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    total = rows.count()
    buckets = max(256, total // BUCKET_ROWS)  # a third of all rows is many buckets, however small the table
    # The row travels as one value, so that no name of its columns meets one used here.
    stratum = F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum_col}`").cast("string")), F.lit(""))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), stratum.alias("stratum"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("hash"))
    low = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * buckets)
    ties = F.col("row") if _orderable(rows) else F.to_json("row")
    ranked = bucketed_row_number(packed, ["stratum"], F.least(low, F.lit(buckets - 1)), ["hash", ties], "rank")
    sizes = packed.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    part = ranked.join(sizes, "stratum").withColumn("part", (F.col("rank") + 0.5) / F.col("size"))
    placed = bucketed_row_number(part, [], F.floor(F.col("part") * buckets), ["part", "stratum", "rank"], "place")
    count = max(total, 1)
    cut = placed.withColumn("shard", F.expr(f"place * {shards}L div {count}L"))
    slot = F.expr(f"place - (shard * {count}L + {shards - 1}L) div {shards}L")
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _orderable(df: DataFrame) -> bool:
    return not any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in df.schema)


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder a shard under ``path``, its rows in the order of their slots."""
    sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Drop lines that many documents share; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.runtime import ascii_lower, written

#: ASCII white space, stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Every column of ``docs`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without outer ASCII white space and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` distinct documents lose all
    their lines, except in the document with the largest id. Keys are compared by 128 bits of
    XXH64 with two seeds.

    Null or empty text is one empty line. Rows that repeat an id count as one document and each
    keep their own row; a null id is one document below all others. Columns of ``docs`` called
    ``n_lines`` or ``n_dropped`` are replaced; an empty table gives an empty table.

    Plan: (key, document) pairs are made distinct before keys are counted, so that a hot key is
    summed in many tasks; keys over the threshold are written out, so that the join back to the
    lines is between two plain exchanges, which adaptive execution splits where a key is hot. The
    texts are shuffled once, for the join with the positions to drop.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_text", "_pos", ascii_lower(F.btrim("_line", F.lit(BLANKS))).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_text", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(7), "_key").alias("_k2"))
    )
    shared = written(
        lines.select("_k1", "_k2", "_id")
        .distinct()
        .groupBy("_k1", "_k2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
        .where(F.col("_n") >= min_docs)
        .select("_k1", "_k2", "_keep"),
        "shared-lines",
    )
    drops = (
        lines.join(shared, ["_k1", "_k2"])
        .where(~F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_id", "_text")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text).alias("_rtext"))
    joined = rows.join(drops, (F.col("_rtext") == F.col("_text")) & F.col("_rid").eqNullSafe(F.col("_id")), "left")
    whole = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    cut = joined.select("_row", whole.alias("_whole"), F.split(whole, "\n", -1).alias("_lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    # The runs of lines between dropped positions, in order: linear in the lines of a document.
    first = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_drop", i - 1) + 1)
    after = lambda i: F.when(i == F.size("_drop"), F.size("_lines")).otherwise(F.get("_drop", i))
    runs = F.transform(F.sequence(F.lit(0), F.size("_drop")), lambda i: F.slice("_lines", first(i) + 1, after(i) - first(i)))
    kept = F.when(F.size("_drop") == 0, F.col("_whole")).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*out, F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"))

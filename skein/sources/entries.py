"""Append-only entries with a dense sequence and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import n_tokens, trim_space
from skein.operators.ranking import bucketed_row_number


def append_entries(new: DataFrame, key: str, order: str, text: str, known: DataFrame | None = None, width: int = 100_000) -> DataFrame:
    """IO-4. (key, order, seq, hash, tokens): entries numbered from where ``known`` (key, seq) ends,
    from 0 without it, densely by ``order`` (a number) within ``key``. Ranges of ``order`` deal a
    large key over tasks."""
    rows = new.select(key, order, F.sha2(F.col(text), 256).alias("hash"), n_tokens(F.col(text)).cast("long").alias("tokens"))
    ranked = bucketed_row_number(rows, [key], F.floor(F.col(order) / width), [order], "seq")
    if known is None:
        return ranked
    last = known.groupBy(key).agg((F.max("seq") + 1).alias("_from"))
    return ranked.join(last, key, "left").withColumn("seq", F.col("seq") + F.coalesce("_from", F.lit(0))).drop("_from")


def validate_sequence(entries: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """IO-5. (key, seq, expected) where a sequence is not dense from 0."""
    ranked = bucketed_row_number(entries.select(key, "seq"), [key], F.floor(F.col("seq") / width), ["seq"], "expected")
    return ranked.where("seq <> expected")


def entries_range(entries: DataFrame, low: int, high: int) -> DataFrame:
    """IO-6. Entries between two sequence numbers, both included."""
    return entries.where(F.col("seq").between(low, high))


def corpus_hash(segments: DataFrame, corpus: str, order: list[str], text: str) -> DataFrame:
    """IO-7. sha256 of a corpus's texts joined by line feeds in order; a corpus is one value."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n")
    return segments.groupBy(corpus).agg(F.sha2(joined, 256).alias("corpus_hash"))


def conversation_summary(turns: DataFrame, most: int = 80) -> DataFrame:
    """IO-8. Per conversation: the title (first user message without a heading or list mark, cut to
    ``most`` characters), messages, last turn."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    plain = trim_space(F.regexp_replace(F.regexp_replace(F.col("f.text"), r"^\s*[#>*-]+\s*", ""), r"\s+", " "))
    s = turns.groupBy("conv_id").agg(first.alias("f"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn")).withColumn("t", plain)
    title = F.when(F.char_length("t") > most, F.concat(F.substring("t", 1, most), F.lit("…"))).otherwise(F.col("t"))
    return s.select("conv_id", title.alias("title"), "messages", "last_turn")

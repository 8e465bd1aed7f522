"""From raw documents to packed training sequences: quality rules, toxicity, line dedup, SimHash
near-dedup, best-fit packing. Each stage's result is written and read again as the next one's docs.

All stages but the last return the columns of their documents, whatever others than doc_id and
text there are and whatever they are called; a stage works on one row at a time, on its text, or on
groups of rows, never on positions. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import line_dedup, quality, queries, simhash, toxicity
from skein.llm.runtime import small_batches
from skein.operators.ranking import fresh
from skein.operators.storage import written


def _row(docs: DataFrame):
    """All columns but the text as one value, beside which an operator may add its own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def _columns(docs: DataFrame, **new):
    """The columns of ``docs`` again, from the row, the text and new ones."""
    own = {"text": F.col("text")} | new
    return [own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the web policy go. Null and empty texts have too few words and
    go. Rows are judged one by one, so that repeated rows and null ids fare alike: the text is
    carried beside the ledger's measurements, and nothing is joined."""
    small_batches(spark)
    return quality.keep(docs, quality.WEB)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go. It learns from the labelled ones here.
    Rows are scored one by one by their text alone; null and empty texts are scored by the bias,
    null ids and repeated rows like any other."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(_row(docs), "text"), model).where("predicted = 0").select(_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from the texts, of which the largest id keeps its own; n_chars follows if
    there is one. Null text becomes empty. Rows that repeat an id are one document in the counts
    and each keep a row; null ids together are one document below all others."""
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", _row(docs)))
    return found.select(_columns(docs, n_chars=F.char_length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates exactly one row stays: the one with the smallest id, a null
    id only where the group has no other. Of several rows of that id it is one with the least hash
    of the text, of equal rows any. Null and blank texts are one group."""
    small_batches(spark)
    key, hash_ = fresh(docs, "stay_id", "stay_hash")
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    stay = simhash.representatives(docs.select("doc_id", "text")).select(named.alias(key), F.col("text_hash").alias(hash_))
    # Both the join and the choice among equal rows go by these two columns: the texts are dealt once.
    found = docs.withColumn(key, named).withColumn(hash_, simhash.text_hash(F.col("text")))
    found = found.join(stay, [key, hash_], "left_semi").dropDuplicates([key, hash_])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens. Null and empty texts are the end id
    alone; each row is a document, also where ids are null or repeat."""
    small_batches(spark)
    return queries.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

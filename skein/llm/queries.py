"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, hamming, hyperminhash, importance, interleave, line_dedup, packing, quality, revisit, simhash, toxicity, wavelet, whitening
from skein.llm.runtime import small_batches, written
from skein.operators.storage import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each is fetched, and asked for again a little before and after.
    The validators of the later request vary with the length of the page: the entity tag, a weak
    one, a date alone, or a tag of other content."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 60), "yyyy-MM-dd HH:mm:ss")
    kind = F.char_length("html") % 4
    base = pages.select("page_id", "url", tag.alias("tag"), date.alias("date"), kind.alias("kind"), F.octet_length("html").cast("string").alias("size"))
    header = lambda **h: F.map_filter(F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())
    none = F.lit(None).cast("string")
    capture = lambda name, shift, status, etag, last, digest, headers: F.struct(
        F.concat(F.lit(name), F.col("page_id").cast("string")).alias("record_id"), (F.col("page_id") * 10 + shift).alias("fetched_at"), F.lit(status).alias("status"),
        etag.alias("etag"), last.alias("last_modified"), digest.alias("digest"), headers.alias("headers"),
    )
    asked = F.when(F.col("kind") == 0, F.col("tag")).when(F.col("kind") == 1, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("kind") == 3, F.concat(F.lit('"'), F.md5("tag"), F.lit('"')))
    rows = F.array(
        capture("early-", -5, 304, F.col("tag"), none, none, header(etag=F.col("tag"), server=F.lit("edge"))),
        capture("full-", 0, 200, F.col("tag"), F.col("date"), F.col("tag"), header(content_type=F.lit("text/html"), content_length=F.col("size"), etag=F.col("tag"), server=F.lit("origin"), date=F.col("date"))),
        capture("late-", 5, 304, asked, F.col("date"), none, header(content_length=F.lit("0"), etag=asked, server=F.lit("edge"), cache_control=F.lit("max-age=60"))),
    )
    return base.select("url", F.explode(rows).alias("c")).select("url", "c.*")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve_revisits(captures_of(_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "url_key", "fetched_at", "outcome", "refers_to", "digest", F.array_join(lines, "; ").alias("headers"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_bpe(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.ledger(_table(spark, sf_dir, "documents")), "ledger")
    return quality.apply_policy(quality.apply_policy(rows, quality.BASE, "base_kept"), quality.WEB).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed"
    )


def op5b_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(written(quality.ledger(_table(spark, sf_dir, "documents")), "ledger"), [quality.BASE, quality.WEB])


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "wavelet")
    wavelet.write_tokens(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave.interleave(sized, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_line_dedup, op2_warc_revisits, op3_byte_bpe, op4_best_fit_packing, op5_quality_rules, op5b_rule_ablation, op6_hamming_topk,
        op7_wavelet_tokens, op8_simhash_near_dedup, op9_stratified_shards, op10_toxicity, op11_hyperminhash_near_dedup, op12_embedding_whitening,
        op13_importance_resampling,
    ]
    return {f.__name__: f for f in named}

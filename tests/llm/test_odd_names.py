"""Every operator and stage with column names that hold dots, blanks and hyphens, also within
structs, and with ids of other types than long."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe, hyperminhash, importance, interleave, line_dedup, packing, quality, simhash, toxicity, wavelet, whitening
from skein.operators.storage import shared_path

LONG = "a line that is long enough to be counted among the shared ones"
WORDS_OF = random.Random(2)
TEXTS = [f"{LONG}\nThe own words are these, " + " ".join("".join(WORDS_OF.choices("abdeilnorst", k=5)) for _ in range(40)) for _ in range(8)] + [None, ""]
ODD = ["a.b", "a b", "a-b", "sequence_id", "score", "n_lines", "part"]
BPE, RANKS, WORDS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["int", "string", "long"])
def docs(spark, request):
    kind = request.param
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    inner = F.struct(F.lit(1).alias("x.y"), F.lit("z").alias("x y"), F.lit(2.5).alias("x-y"))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD)], inner.alias("in.ner"), F.lit("web").alias("source"))


def operators(spark, docs):
    path = shared_path(spark, "odd")
    wavelet.write_tokens(docs, path, WORDS)
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    target = spark.createDataFrame([("own words",)], "text string")
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double"), F.hash("text").cast("double") / 1e6).alias("embedding"), "`a.b`", "`in.ner`")
    coded = bpe.encode_bpe(docs, RANKS, P.PATTERN)
    return {
        "line_dedup": (line_dedup.dedup_lines(docs), 10), "encode": (coded, 10), "decode": (bpe.decode_bpe(coded.withColumn("in.ner", F.struct(F.lit(1).alias("x y"))), RANKS), 10),
        "quality": (quality.ledger(docs), 10), "keep": (quality.keep(docs, quality.BASE), None), "pack": (packing.pack(packing.token_pieces(docs, BPE, 64).withColumn("a.b", F.lit(1)), 64), None),
        "wavelet": (wavelet.read_tokens(spark, path), 10), "simhash": (simhash.near_duplicates(docs), 10), "stay": (simhash.representatives(docs), None), "shards": (interleave.interleave(docs, 3), 10),
        "toxicity": (toxicity.score(docs, model), 10), "sets": (hyperminhash.near_duplicates(docs), 10), "whitening": (whitening.whiten(vectors), None), "resampling": (importance.resample(docs, target), 10),
    }


def test_operators(spark, docs):
    for name, (df, n) in operators(spark, docs).items():
        rows = df.collect()
        assert rows and (n is None or len(rows) == n), name
        kept = set(docs.columns) & set(df.columns)
        if name in ("line_dedup", "keep", "shards", "toxicity"):
            assert kept >= {"a.b", "a b", "a-b", "in.ner"} and all(r["in.ner"]["x.y"] == 1 and r["a b"] == 1 for r in rows), name
        if "doc_id" in df.columns:
            assert df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name


def test_stages(spark, docs, tmp_path):
    labels = docs.select(F.col("doc_id"), (F.col("doc_id").cast("int") % 2).alias("toxic"))
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        assert all(r["in.ner"]["x y"] == "z" for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == len(TEXTS)

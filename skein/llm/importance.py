"""Resample documents towards a target's distribution of hashed word n-grams.

Words come out of Aho-Corasick scans: the dictionary holds distinct words between two delimiters,
each with its CRC-32 and its length as payload, and a scan gives the payload of every word of a
text in order. The CRC of several words joined by blanks is composed of the payloads of
neighbours, so that n-grams need no strings. Buckets are counted in the corpus and the target, and
a document's weight is the sum of its features' gains.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.runtime import written
from skein.operators.ranking import bucketed_row_number

#: Bytes of text that are scanned at once.
BLOCK = 4 << 20
#: A worker's dictionary starts anew beyond so many bytes of words.
DICTIONARY = 4 << 20
#: A longer word is no entry of the dictionary; its payload is computed where it stands.
LONGEST = 64
#: Documents in a range of scores that is ranked at once.
RANGE = 50_000
#: Between two documents; no word holds it.
_END = 0x01
#: A-Z become a-z, digits, a-z and all bytes of other characters stay, the rest are delimiters.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LONG = re.compile(rb"[^ \x01]{%d,}" % (LONGEST + 1))


@lru_cache(maxsize=64)
def _shift(length: int) -> np.ndarray:
    """What ``length`` further bytes do to a CRC-32, as the images of its 32 bits."""
    if length == 1:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, byte >> 1 ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return byte[one & 0xFF] ^ one >> np.uint32(8)
    half = _shift(length // 2)
    twice = _apply(half, half)
    return _apply(_shift(1), twice) if length % 2 else twice


def _apply(images: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), np.uint32)
    for bit in range(32):
        out ^= images[bit] * (crc >> np.uint32(bit) & np.uint32(1))
    return out


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32s of left, a blank and right, from the CRCs and the lengths of the right ones."""
    out = _apply(_shift(1), left) ^ np.uint32(zlib.crc32(b" "))
    for bit in range(int(length.max(initial=0)).bit_length()):
        out = np.where(length >> bit & 1, _apply(_shift(1 << bit), out), out)
    return out ^ right


class Dictionary:
    """An Aho-Corasick automaton over distinct words, each between delimiters. It takes in the
    words of each block that it lacks, and starts anew when it is full."""

    def __init__(self, most: int = DICTIONARY):
        self.most, self.size, self.words, self.automaton = most, 0, set(), None

    def learn(self, words: set[bytes]) -> None:
        import ahocorasick

        new, self.words = words - self.words, self.words | words
        self.size += sum(map(len, new))
        if self.automaton is None or self.size > self.most:
            self.automaton, self.words, new = ahocorasick.Automaton(), words, words
            self.size = sum(map(len, words))
            self.automaton.add_word(f" {chr(_END)} ", -1)
        for w in new:
            self.automaton.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 31 | len(w))
        if new or self.automaton.kind != ahocorasick.AHOCORASICK:
            self.automaton.make_automaton()

    def scan(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRCs and lengths of all words of these texts, and how many words each text has."""
        plain = [(t or b"").translate(_PLAIN) for t in texts]
        whole = b" " + b" \x01 ".join([*plain, b""])
        words, long = set(whole.split()), []
        if any(len(w) > LONGEST for w in words):
            long = [(m.end(), m.start()) for m in _LONG.finditer(whole)]
            words = {w for w in words if len(w) <= LONGEST}
        words.discard(b"\x01")
        self.learn(words)
        line = whole.decode("latin-1")
        if long:  # in their places among the others
            found = [(end, value) for end, value in self.automaton.iter(line)]
            found += [(end, zlib.crc32(whole[start:end]) << 31 | end - start) for end, start in long]
            found = np.array([v for _, v in sorted(found)], np.int64)
        else:
            found = np.fromiter((v for _, v in self.automaton.iter(line)), np.int64)
        ends = np.flatnonzero(found == -1)
        found = found[found != -1]
        return (found >> 31).astype(np.uint32), found & (1 << 31) - 1, np.diff(np.r_[-1, ends]) - 1


@lru_cache(maxsize=1)
def _dictionary() -> Dictionary:
    return Dictionary()


def feature_buckets(crc: np.ndarray, length: np.ndarray, count: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all runs of 1 to ``most`` words of each text, text after text, and how many
    each text has."""
    text = np.repeat(np.arange(len(count)), count)
    runs, owner, last, at = [crc], [text], crc, np.arange(len(crc))
    for n in range(2, most + 1):
        at = at[: max(0, len(crc) - n + 1)]
        keep = text[at] == text[at + n - 1]  # runs of n - 1 start at every place whose text reaches so far
        before = np.zeros(len(crc), np.uint32)
        before[: len(last)] = last
        run = np.zeros(len(at), np.uint32)
        run[keep] = joined(before[at[keep]], crc[at[keep] + n - 1], length[at[keep] + n - 1])
        last = run
        runs.append(run[keep])
        owner.append(text[at[keep]])
    every, whose = np.concatenate(runs), np.concatenate(owner)
    order = np.argsort(whose, kind="stable") if most > 1 else slice(None)
    return every[order] % np.uint32(buckets), np.bincount(whose, minlength=len(count))


def _blocks(batches, column: int):
    """Record batches with so many rows that their texts are a block each."""
    for batch in batches:
        start, size = 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            size += n
            if size >= BLOCK:
                yield batch.slice(start, k + 1 - start)
                start, size = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def features(docs: DataFrame, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_words`` long, ``n_features`` long, ``buckets`` binary): of each whole text the
    buckets of all runs of 1 to ``most`` words, repeats included, as little-endian unsigned 16-bit
    numbers. A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A
    feature is its words joined by one blank, and its bucket the CRC-32 of that modulo ``buckets``
    (65536 at most). Null or empty texts have none; each row is a document by itself; other
    columns are left out."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("between 1 and 65536 buckets")

    def run(batches):
        known = _dictionary()
        for block in _blocks(batches, 1):
            crc, length, count = known.scan(block.column(1).to_pylist())
            found, n = feature_buckets(crc, length, count, most, buckets)
            raw, ends = found.astype("<u2").tobytes(), np.cumsum(n) * 2
            parts = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    long = lambda name: T.StructField(name, T.LongType())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], long("n_words"), long("n_features"), T.StructField("buckets", T.BinaryType())]))


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of ``found`` are in each bucket; as many rows as buckets reach the driver."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    summed = found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"]] = summed["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's add-one share in target and corpus, rounded down."""
    share = (target + 1.0) * (corpus.sum() + float(len(corpus))) / ((corpus + 1.0) * (target.sum() + float(len(target))))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel number that depends on seed and id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(id, ``n_features``, ``weight``, ``score``, ``rank``), all long: every document, and the
    places from 1 of the ``percent`` hundredths (rounded down) of those with ``min_words`` words
    or more that are drawn, without replacement, by the highest weight plus Gumbel noise.

    Ties go to the smaller id; a null id has noise of its own and comes first in ties; rows that
    are equal have places in any order. Null or empty texts weigh 0 and are not drawn. An empty
    target pulls to equal shares; an empty table gives an empty table.

    Texts are scanned once: the buckets are written in two bytes a feature, counted, and read
    again for the weights. Only documents that may be drawn are ranked, within ranges of scores.
    """
    found = written(features(docs, most, buckets, id_col, text_col), "features")
    aimed = features(target.select(F.lit(0).alias("id"), F.col(f"`{target_col}`").alias("text")), most, buckets, "id", "text")
    gain = gains(bucket_counts(found, buckets), bucket_counts(aimed, buckets))
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy()
            sums = np.r_[0, np.cumsum(held.value[np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2")])]
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[ends] - sums[ends - n], pa.int64())], names=["id", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(run, T.StructType([*list(found.schema)[:3], T.StructField("weight", T.LongType())]))
    weighed = written(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weighed")
    open_ = weighed.where(F.col("n_words") >= min_words)
    total = open_.count()
    order = [F.col("score").desc(), F.col("id")]
    ranges = open_.repartitionByRange(1 + total // RANGE, *order).withColumn("range", F.spark_partition_id())
    ranked = bucketed_row_number(written(ranges, "ranges"), [], F.col("range"), order, "rank")
    drawn = F.when(F.col("rank") < total * percent // 100, F.col("rank") + 1)
    rest = weighed.where(F.col("n_words") < min_words)
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*names, drawn.cast("long").alias("rank")).union(rest.select(*names, F.lit(None).cast("long").alias("rank")))

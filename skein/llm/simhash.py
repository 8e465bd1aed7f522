"""SimHash near-duplicates by segment popcounts.

Hamming distance is at least the Manhattan distance between the vectors of bit counts of the
segments. Of a pair within k bits, one half of the fingerprint differs by k // 2 bits or fewer, so
the grid of that half's count vectors holds both within that Manhattan distance. The range join
looks there; the whole vectors bound the distance from below, and the bits decide.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.runtime import written
from skein.operators.components import connected_components

#: Bits in a segment; a half of 32 bits has 16 segments with counts from 0 to 2.
SEGMENT = 2
#: The low bit of each segment.
PAIRS = 0x5555555555555555


def fingerprint_of(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a list of words: a bit is set if over half the shingles' XXH64 have
    it. Fewer words than a shingle are one shingle, none give zero."""
    import xxhash

    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    n = len(begins)
    raw = b"".join([digest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1)
    whole = n // 255 * 255  # sums of 255 bits fit a byte
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, ``fp`` long): the fingerprint of each whole text as a signed 64-bit integer. A-Z are
    lower-cased, words are runs without ASCII white space. Null or blank text gives zero. With
    ``hashed`` also ``text_hash`` long, by which rows of one id are told apart."""
    names = [id_col, "fp", *["text_hash"] * hashed]

    def run(batches):
        for batch in batches:
            fps = [fingerprint_of((t or "").encode().lower().split(), shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), *batch.columns[2:]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    also = [text_hash(F.col(text_col)).alias("text_hash")] * hashed
    return docs.select(id_col, text_col, *also).mapInArrow(run, f"`{id_col}` {kind}, fp long" + ", text_hash long" * hashed)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _half(fp: Column, upper: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if upper else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _counts(half: Column) -> Column:
    """The bit counts of the 16 segments of a half, packed two bits each."""
    return half.bitwiseAND(F.lit(PAIRS)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(PAIRS))


def _unary(fp: Column) -> Column:
    """The bit counts of all segments, each in unary (0: 00, 1: 01, 2: 11), so that the Manhattan
    distance of two vectors is the number of bits in which their codes differ."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(PAIRS)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(PAIRS)), 1))


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(``a``, ``b``) longs, a < b: every pair of distinct fingerprints in ``fps.fp`` that differ
    in at most ``most`` bits, once.

    Each fingerprint stands in the cell of each half's count vector and looks in the cells up to
    ``most // 2`` steps above it; a pair with both above and below steps meets from either side.
    Both sides are shuffled: Spark sizes a table without the rows that ``explode`` adds, and would
    send one to the driver that is dozens of times as large as it takes it to be.
    """
    radius = most // 2

    # Steps up in the grid are additions to the packed counts. Two vectors at a distance d have a
    # common upper bound, d1 steps above one and d2 above the other, d1 + d2 = d.
    def ups(n: int) -> list[int]:
        return sorted({sum(1 << 2 * i for i in c) for k in range(n + 1) for c in combinations_with_replacement(range(16), k)})

    def cells(name: str, n: int) -> DataFrame:
        at = [F.struct(F.lit(h).alias("h"), (_counts(_half(F.col("fp"), h)) + F.lit(s)).alias("cell")) for h in (0, 1) for s in ups(n)]
        return fps.select(F.col("fp").alias(name), _unary(F.col("fp")).alias(f"v{name}"), F.explode(F.array(*at)).alias("c")).select(name, f"v{name}", "c.*")

    here = cells("a", radius if radius > 1 else 0)
    there = cells("b", radius).hint("merge")
    near = (
        (F.col("a") != F.col("b"))
        & (F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= most)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    )
    met = here.join(there, (here["h"] == there["h"]) & (here["cell"] == there["cell"]) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fp`` long, ``component_id``): the smallest id reachable over links between
    fingerprints at ``most`` or fewer differing bits, itself included.

    Documents with one fingerprint are one vertex, so copies make no pairs. Repeated ids keep a
    row each; null ids never name a component unless all its ids are null. Null or blank texts
    have fingerprint zero and link like any other. An empty table gives an empty table.
    """
    marked = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    return marked.join(_named(marked, most, id_col), F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def representatives(docs: DataFrame, most: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``text_hash`` long), one row a component of ``near_duplicates``: its smallest id, null
    only if all its ids are, and of the rows of that id the least hash of the text."""
    marked = written(fingerprints(docs, shingle, seed, id_col, text_col, hashed=True), "fingerprints")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")
    least = marked.groupBy("fp").agg(F.min(key).alias("key"))  # copies meet before the join
    found = least.join(_named(marked, most, id_col), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("key").alias("key"))
    return found.select(F.col("key.id").alias(id_col), "key.text_hash")


def _named(marked: DataFrame, most: int, id_col: str) -> DataFrame:
    """(``_fp``, ``root``, ``component_id``) of each fingerprint."""
    vertices = written(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "vertices")
    found = written(links(vertices, most), "links")
    member = written(connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "members")
    whole = vertices.join(member, vertices["fp"] == member["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    least = written(whole.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return written(whole.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "named")

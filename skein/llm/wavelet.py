"""Token ids as wavelet matrices: succinct bit-planes, one compressed file a shard."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.runtime import schema_of
from skein.llm.units import Ids, UnitTable, binary, blocks, cut_at_white, gather, starts

#: Tokens after which a shard is closed; a document is never split. A shard is a file: take more of
#: them where files should be few.
SHARD_TOKENS = 2_097_152
#: Bits between two entries of a plane's rank directory.
BLOCK = 4096

#: A row, which is a file: its shuffle partition, its place in it, the ids before it there, its
#: documents and the matrix.
FILE = "part int, shard int, before long, ids array<{id}>, lengths array<long>, n_tokens long, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes from the highest bit down; after each, entries with bit 0 go before the others."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes = n, zeros, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, n = ids, len(ids)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            plane = np.packbits((now >> level & 1).astype(bool), bitorder="little")
            ones = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(plane)])
            other = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(~plane)])
            whole = pa.array(now)
            low = whole.filter(other).to_numpy()
            zeros.append(len(low))
            planes.append(plane.tobytes())
            padded = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(plane)] = plane
            sums = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            ranks.append(np.r_[0, np.cumsum(sums)].astype("<u4").tobytes())
            now = np.concatenate([low, whole.filter(ones).to_numpy()])
        return cls(n, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """How many of the first i bits of a plane are set."""
        block = i // BLOCK
        plane, a = self.planes[level], block * BLOCK // 8
        whole = int(np.bitwise_count(plane[a : i // 8]).sum()) + int(self.ranks[level][block])
        return whole + (int(plane[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token at place i."""
        token = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            token, i = token << 1 | bit, z + ones if bit else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's entries among the first ``end`` places stand below the last plane."""
        if not 0 <= token < 1 << len(self.zeros):
            return 0, 0  # no plane has its high bits
        a, b = 0, end
        for level, z in enumerate(self.zeros):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (z + x, z + y) if token >> len(self.zeros) - 1 - level & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """How often the token stands in the first ``end`` places."""
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's kth occurrence, from 0; -1 if there are not as many."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            z = self.zeros[level]
            bit = i >= z
            want = i - z if bit else i
            lo, hi = 0, self.n  # the least prefix with want + 1 such bits
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                lo, hi = (mid + 1, hi) if (ones if bit else mid + 1 - ones) <= want else (lo, mid)
            i = lo
        return i

    def places(self, token: int) -> np.ndarray:
        """All places of the token, ascending."""
        a, b = self._range(token, self.n)
        at = np.arange(a, b)
        for level in range(len(self.zeros) - 1, -1, -1) if len(at) else ():
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            at = np.flatnonzero(ones)[at - z] if at[0] >= z else np.flatnonzero(~ones)[at]
        return at

    def read(self) -> np.ndarray:
        """All tokens, by undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for k in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up, z = np.empty_like(now), self.zeros[k]
            up[~ones] = now[:z]
            up[ones] = now[z:] | now.dtype.type(1 << len(self.zeros) - 1 - k)
            now = up
        return now


#: A separator for many units in one text: a symbol that is a match of its own between blanks.
_GAP = "␀"
#: Lower-case Latin letters; a unit of them is one match, and is as the tokenizer normalizes it.
_LETTERS = "^[a-zß-öø-ÿ]+$"
#: Below this, Python lower-cases and normalizes as the tokenizer does, but for U+0130.
_PLAIN = "ɐ"


@lru_cache(maxsize=2)
def _worker(path: str, wide: bool) -> UnitTable:
    """The tokenizer behind a table of white-space-separated units. The tokenizer must lower-case,
    normalize to NFC and drop white space, so that texts may be cut at blanks and line feeds; a
    file that does otherwise is an error.

    Units of letters are encoded as one text and told apart by their ends of words, others with a
    symbol between them; those with letters beyond Latin are encoded each by itself.
    """
    from tokenizers import Tokenizer

    kind = np.dtype("<u4" if wide else "<u2")
    spec = json.loads(Tokenizer.from_file(path).to_str())

    @lru_cache(maxsize=3)
    def tokenizer(name: str):
        own = {"whole": {}, "bare": {"normalizer": None}}.get(name)
        if own is None:  # words: blanks are all that parts them
            bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            own = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        made = Tokenizer.from_str(json.dumps(spec | own))
        made.encode_special_tokens = True
        return made

    def ids(name: str, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in tokenizer(name).encode_batch_fast(texts, add_special_tokens=False)]

    probe = "Ab Éx,\n \tAb"
    if not np.array_equal(ids("whole", [probe])[0], np.concatenate(ids("whole", ["ab", "éx", ",", "ab"]))):
        raise ValueError(f"{path}: not a tokenizer that lower-cases, normalizes to NFC and drops white space")
    last = np.zeros(1 << 8 * min(kind.itemsize, 3), bool)
    last[[i for token, i in spec["model"]["vocab"].items() if token.endswith("</w>")]] = True
    gap = ids("bare", [_GAP])[0]

    def encode(units: pa.Array) -> Ids:
        letters = pc.match_substring_regex(units, _LETTERS).to_numpy(zero_copy_only=False)
        size, flat = np.zeros(len(units), np.int64), []
        words = units.filter(pa.array(letters)).to_pylist()
        at, order = np.flatnonzero(letters), []

        def add(places: np.ndarray, found: np.ndarray, n: np.ndarray) -> None:
            size[places] = n
            order.append(places)
            flat.append(found)

        for k in range(0, len(words), 20_000):
            found = ids("words", [" ".join(words[k : k + 20_000])])[0]
            add(at[k : k + 20_000], found, np.diff(np.r_[-1, np.flatnonzero(last[found])]))
        others = [(k, u) for k, u in zip(np.flatnonzero(~letters).tolist(), units.filter(pa.array(~letters)).to_pylist()) if u]
        single = [x for x in others if not x[1].isascii() and (max(x[1]) >= _PLAIN or "İ" in x[1])]
        alone = {k for k, _ in single}
        mixed = [x for x in others if x[0] not in alone]
        for k in range(0, len(mixed), 20_000):
            part = mixed[k : k + 20_000]
            found = ids("bare", [unicodedata.normalize("NFC", f" {_GAP} ".join(u for _, u in part)).lower()])[0]
            hits = np.flatnonzero(found == gap[0])
            for j in range(1, len(gap)):
                hits = hits[hits + j < len(found)]
                hits = hits[found[hits + j] == gap[j]]
            stay = np.ones(len(found), bool)
            for j in range(len(gap)):
                stay[hits + j] = False
            add(np.array([k for k, _ in part]), found[stay], np.r_[hits, len(found)] - np.r_[0, hits + len(gap)])
        if single:
            each = ids("whole", [u for _, u in single])
            add(np.array([k for k, _ in single]), np.concatenate(each), np.array([len(x) for x in each]))
        # Laid out in the order of the units.
        places, found = np.concatenate([*order, np.zeros(0, np.int64)]), np.concatenate([*flat, np.zeros(0, kind)])
        begin = np.zeros(len(units), np.int64)
        begin[places] = starts(size[places])
        return gather(found, begin, size), size

    return UnitTable(encode, cut_at_white)


def write_tokens(
    docs: DataFrame, out: str, path: str, vocabulary: int = 49_408, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, as wavelet matrices under ``out``,
    one compressed file a shard.

    Documents lie in ascending order of id (null first) over the shards (part, shard); texts with
    one id follow each other in the order of the texts. Null or empty text is the end id alone.
    ``path`` is a tokenizer file that lower-cases and drops white space. Texts are shuffled once,
    by ranges of the id; an empty table writes an empty one.
    """
    bits, kind = max(1, (vocabulary - 1).bit_length()), docs.schema[id_col].dataType.simpleString()
    wide = bits > 16
    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)

    def run(batches):
        table, part = _worker(path, wide), TaskContext.get().partitionId()
        width = np.uint32 if wide else np.uint16
        end, shard, before, size, names, lengths, held, id_type = np.array([end_id], width), 0, 0, 0, [], [], [], None

        def close():
            m = WaveletMatrix.build(np.concatenate(held), bits)
            row = [part, shard, before, names, lengths, m.n, m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["part", "shard", "before", "ids", "lengths", "n_tokens", "zeros", "planes", "ranks"])

        for block, texts in blocks(batches):
            flat, count = table.texts(texts)
            at, id_type = 0, block[0].column(0).type
            for name, n in zip((x for b in block for x in b.column(0).to_pylist()), count.tolist()):
                held += [flat[at : at + n], end]
                at += n
                names.append(name)
                lengths.append(n + 1)
                size += n + 1
                if size >= shard_tokens:
                    yield close()
                    shard, before, size, names, lengths, held = shard + 1, before + size, 0, [], [], []
        if names:
            yield close()

    ordered.mapInArrow(run, FILE.format(id=kind)).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("maxRecordsPerFile", 1).parquet(out)


def _shards(spark: SparkSession, out: str) -> DataFrame:
    """The files with ``base``: the ids of all shards of earlier parts. The parts are as many as
    the shuffle's partitions; a file knows what lies before it in its part."""
    files = spark.read.parquet(out)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "part")


def _matrices(batches, *columns: str):
    for batch in batches:
        for row in batch.to_pylist():
            yield WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]), *(row[c] for c in columns)


_MATRIX = ["n_tokens", "zeros", "planes", "ranks"]


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ``start`` long, ``n_tokens`` long, ``ids`` binary as little-endian u32), read back from
    the files alone: ``start`` counts the ids of all documents before this one."""
    files = _shards(spark, out)
    kind = files.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            names = batch.column(batch.schema.names.index("ids"))
            for k, (m, lengths, before, base) in enumerate(_matrices([batch], "lengths", "before", "base")):
                n = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [names[k].values, pa.array(starts(n) + before + base), pa.array(n), binary(m.read().astype("<u4"), n)], names=[id_col, "start", "n_tokens", "ids"]
                )

    return files.select("before", "base", "ids", "lengths", *_MATRIX).mapInArrow(run, schema_of([T.StructField(id_col, kind)], "start long, n_tokens long, ids binary"))


def token_counts(spark: SparkSession, out: str, tokens: list[int]) -> DataFrame:
    """(``token`` int, ``n`` long): occurrences over all shards, by rank queries on the planes alone.
    A token that no shard can hold has none."""
    tokens = list(dict.fromkeys(tokens))

    def run(batches):
        for (m,) in _matrices(batches):
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int32()), "n": pa.array([m.count(t) for t in tokens], pa.int64())})

    return spark.read.parquet(out).select(_MATRIX).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, out: str, tokens: list[int]) -> DataFrame:
    """(``token`` int, ``position`` long): where each of the tokens stands, counted over all shards,
    by select queries on the planes. A row an occurrence, each shard by itself."""
    tokens = list(dict.fromkeys(tokens))

    def run(batches):
        for m, before, base in _matrices(batches, "before", "base"):
            for t in tokens:
                at = m.places(t) + before + base
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.full(len(at), t), pa.int32()), "position": pa.array(at, pa.int64())})

    return _shards(spark, out).select("before", "base", *_MATRIX).mapInArrow(run, "token int, position long")


def tokens_at(spark: SparkSession, out: str, positions: list[int]) -> DataFrame:
    """(``position`` long, ``token`` int): the tokens at some positions of the whole, by access on
    the planes. Positions that there are not give no row."""
    positions = list(dict.fromkeys(positions))

    def run(batches):
        for m, before, base in _matrices(batches, "before", "base"):
            own = [p for p in positions if 0 <= p - before - base < m.n]
            yield pa.RecordBatch.from_pydict({"position": pa.array(own, pa.int64()), "token": pa.array([m.access(p - before - base) for p in own], pa.int32())})

    return _shards(spark, out).select("before", "base", *_MATRIX).mapInArrow(run, "position long, token int")

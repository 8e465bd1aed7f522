"""Byte-level BPE by merge replay, and decoding.

The work is done over the distinct words of a block of the corpus, not over texts: an inverted
index from token pair to the places in those words where the pair stands is replayed in rank
order, and a merge touches only the neighbours of the place. Spark deals the texts out to tasks;
nothing is shuffled. Each Python worker keeps a bounded table of words that it has replayed.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from skein.llm.runtime import by_place, schema_of
from skein.llm.units import Ids, UnitTable, binary, blocks, cut_words, one_word, pick, starts, sums


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class MergeReplay:
    """Encodes many words at once by the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens, self.token_ids = pa.array(list(ranks), pa.binary()), np.fromiter(ranks.values(), np.int64, len(ranks))
        # Every way to cut a token in two: left id << 32 | right id, and the id of the whole.
        pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.get = pairs.get

    def words(self, words: pa.Array) -> Ids:
        """The ids of each word of a binary array. A word that is a token is that token."""
        token = pc.index_in(words, value_set=self.tokens)
        whole = token.is_valid().to_numpy(zero_copy_only=False)
        todo = words.filter(pa.array(~whole))
        count = np.ones(len(words), np.int64)
        if not len(todo):
            return self.token_ids[token.to_numpy(zero_copy_only=False).astype(np.int64)].astype("<u4"), count
        # The symbols of all words, one place each, with -1 around each word: no pair spans two.
        offsets = np.frombuffer(todo.buffers()[1], np.int32)[todo.offset :][: len(todo) + 1].astype(np.int64)
        raw = np.frombuffer(todo.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        start = np.cumsum(np.r_[1, size[:-1] + 1])
        ids = np.full(int(start[-1] + size[-1] + 1), -1, np.int64)
        ids[np.arange(len(raw)) + np.repeat(start - starts(size), size)] = self.single[raw]
        again = self._replay(ids, start)
        for k in again:
            found = self._word(raw[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]])
            ids[start[k] : start[k] + size[k]] = -2
            ids[start[k] : start[k] + len(found)] = found
        left = ids >= 0
        seen = np.r_[0, np.cumsum(left)]
        n = seen[start + size] - seen[start]
        count[~whole] = n
        flat = np.empty(int(count.sum()), "<u4")
        own = np.repeat(whole, count)
        flat[own] = self.token_ids[token.drop_null().to_numpy(zero_copy_only=False)]
        flat[~own] = ids[left]
        return flat, count

    def _ranks(self, ids: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place, or -1."""
        left, right = ids[at], ids[after[at]]
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (left >= 0) & (right >= 0), self.merged[k], -1)

    def _replay(self, ids: np.ndarray, start: np.ndarray) -> set[int]:
        """Merge in place; a swallowed place becomes -2. Returns the words to encode singly:
        those where a merge has given rise to a pair of a lower rank than its own."""
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        pair = self._ranks(ids, after, np.arange(n))  # the rank of the pair at each place
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        first, cuts = np.unique(pair[places], return_index=True)
        # The inverted index: rank of a pair -> the places where it stands.
        index: dict[int, list] = {r: [p] for r, p in zip(first.tolist(), np.split(places, cuts[1:]))} if len(places) else {}
        queue, again = list(index), set()
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            if (found := index.pop(rank, None)) is None:
                continue
            p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            p = p[pair[p] == rank]
            gone = after[p]
            if len(p) > 1 and (p[1:] == gone[:-1]).any():  # a run such as aaaa: from the left
                keep, last = [], -1
                for a, b in zip(p.tolist(), gone.tolist()):
                    if a != last:
                        keep.append(a)
                        last = b
                p = np.array(keep)
                gone = after[p]
            if not len(p):
                continue
            behind = after[gone]
            ids[p], ids[gone] = rank, -2
            pair[gone] = -1
            after[p], before[behind] = behind, p
            near = np.concatenate([p, before[p]])  # only the touched neighbours
            pair[near] = ranks = self._ranks(ids, after, near)
            new = ranks >= 0
            near, ranks = near[new], ranks[new]
            if (low := ranks < rank).any():
                again.update((np.searchsorted(start, near[low], "right") - 1).tolist())
            if len(ranks) > 32:
                order = np.argsort(ranks, kind="stable")
                near, ranks = near[order], ranks[order]
                first, cuts = np.unique(ranks, return_index=True)
                groups = zip(first.tolist(), np.split(near, cuts[1:]))
            else:
                groups = zip(ranks.tolist(), near[:, None])
            for r, at in groups:
                if r in index:
                    index[r].append(at)
                else:
                    index[r] = [at]
                    heapq.heappush(queue, r)
        return again

    def _word(self, word: np.ndarray) -> list[int]:
        """One word, a merge at a time: the least rank, and of that the leftmost."""
        ids, get = self.single[word].tolist(), self.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j == len(ids) or ids[j] != b:
                continue  # one of them has been merged since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (s := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(queue, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> UnitTable:
    """A worker's replay behind a table of words."""
    replay, split = MergeReplay(read_ranks(path)), regex.compile(pattern).findall

    def encode(units: pa.Array) -> Ids:
        one = one_word(units)
        parts = list(map(split, units.filter(pa.array(~one)).to_pylist()))
        place = {w: k for k, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        words = pa.concat_arrays([units.filter(pa.array(one)), pa.array(list(place), pa.string())])
        flat, size = replay.words(words.cast(pa.binary()))
        # Each unit is a run of words.
        ones = int(one.sum())
        count = np.ones(len(units), np.int64)
        count[~one] = [len(p) for p in parts]
        word, own = np.empty(int(count.sum()), np.int64), np.repeat(one, count)
        word[own], word[~own] = np.arange(ones), [ones + place[w] for p in parts for w in p]
        return pick(flat, size, word), sums(size[word], count)

    return UnitTable(encode, cut_words)


class Decoder:
    """Token ids back to bytes."""

    def __init__(self, path: str):
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        self.known = np.zeros(max(tokens) + 2, bool)
        self.known[list(tokens)] = True
        each = [tokens.get(i, b"") for i in range(len(self.known))]
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ``count`` ids, one after the other, and how many each run has."""
        ids = np.minimum(ids, len(self.known) - 1)
        if not self.known[ids].all():
            raise ValueError("an id outside the vocabulary")
        return pick(self.flat, self.size, ids), sums(self.size[ids], count)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ``n_tokens`` long, ``ids`` binary): the ids of each whole text, little-endian u32. With
    ``decode`` also ``decoded`` binary: what ``decode_bpe`` gives for the ids, in the same pass.

    ``path`` is a rank file that every executor can read, ``pattern`` the split pattern. Null text
    is empty and has no ids; each row is encoded by itself, so repeated rows repeat. Other columns
    of ``docs`` are left out; an empty table gives an empty table. A text of any length is one
    text: time and memory grow with it, memory with the longest.
    """

    def run(batches):
        table = _worker(path, pattern)
        for block, texts in blocks(batches):
            flat, count = table.texts(texts)
            at = 0
            for batch in block:
                n = count[at : at + batch.num_rows]
                at += batch.num_rows
                own, flat = flat[: n.sum()], flat[n.sum() :]
                columns = [batch.column(0), pa.array(n), binary(own, n)]
                if decode:
                    columns.append(binary(*_decoder(path).bytes(own, n)))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode_bpe(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the bytes that the ids stand for. Null ids
    give null; an id outside the vocabulary is an error. A column ``decoded`` is replaced."""
    encoded = encoded.drop("decoded") if ids_col != "decoded" else encoded
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches):
        decoder = _decoder(path)
        for batch in batches:
            ids = batch.column(at)
            count = pc.binary_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            raw, n = decoder.bytes(np.frombuffer(b"".join(x.as_buffer() for x in ids if x.is_valid), "<u4"), count)
            decoded = pc.if_else(ids.is_valid(), binary(raw, n), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*names, "decoded"])

    return by_place(encoded).mapInArrow(run, schema_of(encoded.schema.fields, "decoded binary"))

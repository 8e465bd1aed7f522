"""Texts to token ids through a bounded table of the units that recur.

The split patterns of these tokenizers let a text be cut wherever a match must begin. Arrow cuts
the texts of a block and tells the distinct units; only those that the table does not hold are
encoded, together, and numpy lays the ids of all units out in the order of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the split patterns know it (U+001C to U+001F do not belong to it).
WHITE = "\t-\r \x85\xa0  -     　"
#: Ids of many units, one after the other, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one after the other."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return flat[at]


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def sums(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over the first counts[0] numbers, the next counts[1], and so on; of none 0."""
    total = np.r_[0, np.cumsum(size)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def pick(flat: np.ndarray, size: np.ndarray, which: np.ndarray | pa.Array) -> np.ndarray:
    """The chosen ones of the runs that make up ``flat``, one after the other."""
    chosen = binary(flat, size).take(which if isinstance(which, pa.Array) else pa.array(which))
    data = chosen.buffers()[2]
    return np.frombuffer(data, flat.dtype)[: np.frombuffer(chosen.buffers()[1], np.int32)[len(chosen)] // flat.itemsize] if data else flat[:0]


def binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of a flat array as an Arrow binary array."""
    offsets = (np.r_[0, np.cumsum(size)] * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


class UnitTable:
    """Unit -> ids. ``encode`` gives the ids of distinct units; ``cut`` the units of texts and how
    many each text has. A full stop or comma after a Latin letter or a digit is a unit of its own.
    """

    STOP = "[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]$"

    def __init__(self, encode: Callable[[pa.Array], Ids], cut: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], limit: int = 40 << 20):
        self.encode, self.cut, self.limit = encode, cut, limit
        self.units, self.size = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.flat = self.encode(pa.array([".", ","], pa.string()))[0]  # the first two ids are those of the stops
        assert len(self.flat) == 2

    def texts(self, texts: pa.Array) -> Ids:
        """The ids of each text, null being empty."""
        units, counts = self.cut(texts.fill_null(""))
        told = units.dictionary_encode()
        flat, size = self._distinct(told.dictionary)
        at = told.indices.to_numpy(zero_copy_only=False)
        return pick(flat, size, told.indices), sums(size[at], counts)

    def _distinct(self, units: pa.Array) -> Ids:
        stopped = pc.match_substring_regex(units, self.STOP).to_numpy(zero_copy_only=False)
        bare = pc.utf8_slice_codeunits(units.filter(pa.array(stopped)), 0, -1)
        last = pc.utf8_slice_codeunits(units.filter(pa.array(stopped)), -1)
        order = np.r_[np.flatnonzero(~stopped), np.flatnonzero(stopped)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        bases = pa.concat_arrays([units.filter(pa.array(~stopped)), bare]).take(pa.array(back)).dictionary_encode()
        start, size = self._known(bases.dictionary)
        at = bases.indices.to_numpy(zero_copy_only=False)
        # Each unit is its base and then a stop or nothing.
        runs, long = np.empty((len(units), 2), np.int64), np.zeros((len(units), 2), np.int64)
        runs[:, 0], long[:, 0] = start[at], size[at]
        runs[:, 1] = 0
        runs[stopped, 1] = pc.equal(last, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        long[stopped, 1] = 1
        return gather(self.flat, runs.ravel(), long.ravel()), long.sum(axis=1)

    def _known(self, units: pa.Array) -> Ids:
        """Where in ``flat`` each unit's ids begin, and how many they are; new ones are added."""
        held = self.units.nbytes + self.size.nbytes + self.flat.nbytes
        if held > self.limit:  # what this block needs of it stays
            stay = pc.index_in(self.units, value_set=units).is_valid().to_numpy(zero_copy_only=False)
            kept = gather(self.flat, self._start()[stay], self.size[stay])
            self.units, self.size, self.flat = self.units.filter(pa.array(stay)), self.size[stay], np.concatenate([self.flat[:2], kept])
        place = pc.index_in(units, value_set=self.units)
        new = place.is_null().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            fresh = units.filter(pa.array(new))
            flat, size = self.encode(fresh)
            at[new] = len(self.units) + np.arange(len(fresh))
            self.units = pa.concat_arrays([self.units, fresh])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        return self._start()[at], self.size[at]

    def _start(self) -> np.ndarray:
        return starts(self.size) + 2


def blocks(batches: Iterable[pa.RecordBatch], column: int = 1, size: int = 6_000_000) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """Arrow batches in blocks of about ``size`` bytes of text, with the texts of the block, so
    that unseen units are encoded many at a time."""
    block, held = [], 0
    for batch in batches:
        block.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield block, pa.concat_arrays([b.column(column) for b in block])
            block, held = [], 0
    if block:
        yield block, pa.concat_arrays([b.column(column) for b in block])


def _split(texts: pa.Array, at: str) -> tuple[pa.Array, np.ndarray]:
    parts = pc.split_pattern(texts, at)
    return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


#: Texts with white space before white space or the end, or with the mark of a cut.
_RUN = f"[{WHITE}]([{WHITE}]|$)|\\x00"
_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]").findall


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units for patterns of the ` ?word` kind: cut before each blank and around each line feed.
    Where white space runs together, its last character goes with what follows."""
    if not pc.any(pc.match_substring_regex(texts, _RUN)).as_py():
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        return _split(marked, "\0")
    units = list(map(_UNIT, texts.to_pylist()))
    return pa.array([u for us in units for u in us], pa.string()), np.fromiter(map(len, units), np.int64, len(units))


def cut_at_white(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units for tokenizers that drop white space and lower-case: A-Z are lower-cased here."""
    return _split(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")


#: Units that are one match of a pattern of the ` ?word` kind, whatever Unicode's version.
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$|^ ?[0-9]+$"


def one_word(units: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(units, _WORD).to_numpy(zero_copy_only=False)

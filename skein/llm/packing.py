"""Pack documents into as few fixed-length sequences as can be, by bin completion.

How many sequences are needed depends only on how many pieces there are of each length. The
lengths are counted in Spark (at most ``capacity`` rows come to the driver, however large the
corpus), bin completion runs over these counts, and its plan, whose size is bounded by the number
of lengths, is joined back to the pieces by their rank among those of their length.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.runtime import schema_of, written
from skein.llm.units import Ids, UnitTable, binary, blocks, cut_words, one_word, starts
from skein.operators.ranking import bucketed_row_number, fresh


@lru_cache(maxsize=2)
def _worker(path: str) -> UnitTable:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    gap = ids(["\n"])[0]

    def encode(units: pa.Array) -> Ids:
        one = one_word(units)
        words, rest = units.filter(pa.array(one)).to_pylist(), ids(units.filter(pa.array(~one)).to_pylist())
        flat, size = [], []
        for k in range(0, len(words), 20_000):  # as one text, with a line feed, a match of its own, between each two
            found = ids(["\n".join(words[k : k + 20_000])])[0]
            part = found == gap[0]
            ends = np.r_[np.flatnonzero(part), len(found)]
            size.append(np.diff(np.r_[-1, ends]) - 1)
            flat.append(found[~part])
        count = np.empty(len(units), np.int64)
        count[one], count[~one] = np.concatenate([*size, np.zeros(0, np.int64)]), [len(x) for x in rest]
        out, own = np.empty(int(count.sum()), "<u4"), np.repeat(one, count)
        out[own], out[~own] = np.concatenate([*flat, gap[:0]]), np.concatenate([*rest, gap[:0]])
        return out, count

    return UnitTable(encode, cut_words)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``piece`` int, ``start`` long, ``length`` long, ``ids`` binary): the ids of each whole
    text with ``end_id`` after them, little-endian u32, in pieces of at most ``capacity``.

    ``path`` is a byte-level tokenizer file whose split pattern is of the ` ?word` kind. Only longer
    documents are cut, into full pieces; the first piece holds what is left over. Null or empty
    text is the end id alone. Each row is a document of its own, also where ids repeat; other
    columns are left out, so that none can clash; an empty table gives an empty table.
    """

    def run(batches):
        table = _worker(path)
        for block, texts in blocks(batches):
            flat, count = table.texts(texts)
            at = 0
            for batch in block:
                n = count[at : at + batch.num_rows]
                at += batch.num_rows
                own, flat = np.insert(flat[: n.sum()], np.cumsum(n), end_id), flat[n.sum() :]
                n = n + 1
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(starts(pieces), pieces)
                first = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binary(own, length)],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema_of([docs.schema[id_col]], "piece int, start long, length long, ids binary"))


#: A filling: ((length, how many), ...) in descending order of length.
Filling = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts of lengths: [(filling, number of sequences)]."""
    room: dict[int, list[tuple[Filling, int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for free in sorted(r for r in room if r >= size):
            groups = room.pop(free)
            while groups and left:
                filling, n = groups.pop()
                k = min(free // size, left)
                whole = min(n, left // k)
                if whole < n:
                    groups.append((filling, n - whole))
                room.setdefault(free - k * size, []).append(((*filling, (size, k)), whole))
                left -= k * whole
            if groups:
                room.setdefault(free, []).extend(groups)
            if not left:
                break
        k = capacity // size
        for each, n in ((k, left // k), (left % k, 1 if left % k else 0)):
            if n:
                room.setdefault(capacity - each * size, []).append((((size, each),), n))
    return [g for groups in room.values() for g in groups]


def best_fit_size(counts: dict[int, int], capacity: int) -> int:
    """The number of sequences of ``best_fit``, without its plan."""
    room, free, opened = [0] * (capacity + 1), 0, 0  # how many have so much room; bit n of free: some have n
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left and (fits := free >> size):
            at = size + (fits & -fits).bit_length() - 1
            each = at // size
            n = min(room[at], left // each)
            for k, m in ((each, n), (left - each * n, 1 if n < room[at] else 0)):
                if k and m:
                    room[at] -= m
                    room[at - k * size] += m
                    free |= 1 << at - k * size
                    left -= k * m
            if not room[at]:
                free &= ~(1 << at)
        each = capacity // size
        for k, m in ((each, left // each), (left % each, 1 if left % each else 0)):
            if m:
                room[capacity - k * size] += m
                free |= 1 << capacity - k * size
                opened += m
    return opened


def fillings(largest: int, counts: dict[int, int], capacity: int, waste: int) -> Iterator[Filling]:
    """Undominated ways to complete a sequence that holds one piece of the largest length, with at
    most ``waste`` unused, lazily: by waste, within it those of the longest pieces first.

    A filling is dominated where a piece left out would fit in place of some of its own (none,
    or several that are together no longer) and leave less unused, or as much with fewer pieces;
    an equally good packing then has the other filling.

    Bit n of ``reach[i]`` says that the lengths from the i-th on can sum to n as often as they are
    there; of what it lets through, all is found and nothing else is walked.
    """
    counts = counts | {largest: counts[largest] - 1}
    room = capacity - largest
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    full, spare = (1 << room + 1) - 1, 0
    reach = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        s, sums, k = sizes[i], reach[i + 1], 1
        spare |= 1 << s
        n = min(counts[s], room // s)
        while n:
            each = min(k, n)
            sums |= sums << s * each & full
            n -= each
            k *= 2
        reach[i] = sums

    def walk(i: int, left: int, chosen: Filling, sums: int, several: int, spare: int) -> Iterator[Filling]:
        # sums: of any of the chosen pieces; several: of two or more of them; spare: lengths left out
        if several & spare or over(sums & ~1) & spare:
            return  # the spared piece is longer than any still to be chosen
        if not left:
            if not over(1) & spare:
                more = chosen[0][1] if chosen and chosen[0][0] == largest else 0
                yield ((largest, 1 + more), *chosen[1 if more else 0 :])
            return
        if over(1 << left) & spare:
            return  # in place of all that is still to be chosen
        if spare >> left & 1:
            if i < len(sizes) and left <= sizes[i]:
                yield from walk(i, 0, (*chosen, (left, 1)), sums | sums << left, several | (sums & ~1) << left, spare if counts[left] > 1 else spare & ~(1 << left))
            return
        while i < len(sizes) and reach[i] >> left & 1:
            s = sizes[i]
            i += 1
            for k in range(min(counts[s], left // s), 0, -1):
                if reach[i] >> left - s * k & 1:
                    every, many = sums, several
                    for _ in range(k):
                        every, many = every | every << s, many | many << s | (every & ~1) << s
                    yield from walk(i, left - s * k, (*chosen, (s, k)), every, many, spare & ~(1 << s) if k == counts[s] else spare)

    def over(sums: int) -> int:
        """The lengths by 1 to ``unused`` above these sums."""
        n, done = unused, 1
        out = sums << 1 if n else 0
        while done < n:
            step = min(done, n - done)
            out |= out << step
            done += step
        return out

    for unused in range(min(waste, room) + 1):
        if reach[0] >> room - unused & 1:
            yield from walk(0, room - unused, (), 1, 0, spare)


def times_of(filling: Filling, left: dict[int, int], allowed: int, capacity: int) -> Iterator[int]:
    """How often to apply a filling: as often as may be, half of that, and so on to once."""
    n = min(left[s] // k for s, k in filling)
    if unused := capacity - sum(s * k for s, k in filling):
        n = min(n, allowed // unused)
    while n:
        yield n
        n //= 2


#: Nodes on the path that keep the state of their enumeration; others take it up again by count.
OPEN = 32
#: Branches that the searches of one packing look at, some seconds in the driver.
NODES = 10_000


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A proved lower bound. Pieces longer than half a sequence lie apart, and in what they leave
    free only pieces no longer than that fit: for every length r, the free room of up to r beyond
    all pieces of up to r stays unused. The volume and that waste have to fit."""
    volume = sum(s * n for s, n in counts.items())
    free = forced = 0
    for r in range(capacity // 2):
        free += r * (counts.get(capacity - r, 0) - counts.get(r, 0))
        forced = max(forced, free)
    return -(-(volume + forced) // capacity)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[Filling, int]]:
    """[(filling, number of sequences)] that hold all pieces; as few sequences as were found.

    Best-fit decreasing is the first incumbent. As long as it has more sequences than the proved
    bound, its emptiest sequences are opened and their pieces packed anew by ``complete`` into one
    sequence less, at first as few of them as have a sequence's room unused together, then twice
    as many, and so on to all: few pieces have few fillings, and a gain there is a gain of the
    whole. The last search is that over all pieces, which proves that there is no better packing
    if it ends by itself. ``nodes`` bounds the branches of all searches together; None does not.
    """
    best = best_fit(counts, capacity)
    bound, left = least_sequences(counts, capacity), [nodes]
    size = 0
    while (fewest := sum(n for _, n in best)) > bound and left[0] != 0:
        opened, rest, spare = [], [], 0
        for filling, n in sorted(best, key=lambda g: sum(s * k for s, k in g[0])):
            unused = capacity - sum(s * k for s, k in filling)
            take = min(n, max(size - sum(m for _, m in opened), -(-(capacity - spare) // max(1, unused)) if spare < capacity else 0))
            if take > 0:
                opened.append((filling, take))
                spare += take * unused
            if take < n:
                rest.append((filling, n - max(take, 0)))
        some: dict[int, int] = {}
        for filling, n in opened:
            for s, k in filling:
                some[s] = some.get(s, 0) + n * k
        before = sum(n for _, n in opened)
        found = complete(some, capacity, opened, max(least_sequences(some, capacity), before - (fewest - bound)), left)
        if sum(n for _, n in found) < before:
            best, size = rest + found, 0
        elif before == fewest:
            break
        else:
            size = 2 * before
    return best


def complete(counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], bound: int, nodes: list[int | None]) -> list[tuple[Filling, int]]:
    """A packing of these pieces with fewer sequences than ``best``, or ``best``.

    Depth-first branch and bound around the largest remaining length: each branch is an
    undominated filling, applied as often as the counts allow, half as often, and so on to once.
    The best-fit packing of what remains is an incumbent at every node; a branch whose waste so
    far leaves no way to fewer sequences than the incumbent is pruned. Ends at ``bound``, when all
    branches are done, or when as many as ``nodes[0]`` have been looked at, which is counted down.
    """
    total = sum(s * n for s, n in counts.items())
    left = dict(counts)
    plan: list[tuple[Filling, int]] = []
    fewest = sum(n for _, n in best)
    used = wasted = 0

    def branches(allowed: int) -> Iterator[tuple[Filling, int]]:
        for filling in fillings(max(left), left, capacity, allowed) if left else ():
            for n in times_of(filling, left, allowed, capacity):
                yield filling, n

    def unused(filling: Filling) -> int:
        return capacity - sum(s * k for s, k in filling)

    def spared() -> int:
        return (fewest - 1) * capacity - total - wasted

    # A frame: what it has still to try, how many it has tried, and the waste allowed when it began.
    stack = [[branches(spared()), 0, spared()]]
    while stack and fewest > bound:
        frame = stack[-1]
        if frame[0] is None:
            frame[0] = islice(branches(frame[2]), frame[1], None)
        step = next(frame[0], None)
        if step is None or spared() < 0:
            stack.pop()
            if plan:
                filling, n = plan.pop()
                used -= n
                wasted -= n * unused(filling)
                for s, k in filling:
                    left[s] = left.get(s, 0) + n * k
            continue
        frame[1] += 1
        filling, n = step
        if nodes[0] is not None:
            if not nodes[0]:
                break
            nodes[0] -= 1
        if n * unused(filling) > spared():
            continue
        for s, k in filling:
            left[s] -= n * k
            if not left[s]:
                del left[s]
        plan.append(step)
        used += n
        wasted += n * unused(filling)
        if (found := used + best_fit_size(left, capacity)) < fewest:
            best, fewest = plan + best_fit(left, capacity), found
        if len(stack) >= OPEN:
            stack[-OPEN][0] = None
        stack.append([branches(spared()), 0, spared()])
    return best


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), nodes: int | None = NODES) -> DataFrame:
    """``pieces`` with ``sequence_id`` long and ``offset`` long: where each piece lies, gapless
    from 0 in each sequence. Columns of these names are replaced.

    Lengths must be 1 to ``capacity``; another or a null length is an error. Rows that are equal
    in ``order`` are packed each by itself. Other columns may have any names. An empty table gives an empty table.

    As few sequences as ``bin_completion`` finds within ``nodes`` branches; None searches until it
    is proved that there are no fewer, which may take any time. What is not proved is logged as
    the gap between the sequences and the lower bound.

    ``pieces`` are written out once, counted by length, and ranked within their length in
    buckets by a hash, so that a length which many pieces share is dealt out over many tasks.
    """
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if bad := [s for s in counts if s is None or not 1 <= s <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {sorted(map(str, bad))[:5]}")
    rows, base = [], 0
    ranked = dict.fromkeys(counts, 0)
    plan_ = bin_completion(counts, capacity, nodes)
    used, bound = sum(n for _, n in plan_), least_sequences(counts, capacity)
    if used > bound:
        logging.getLogger(__name__).warning("%d sequences, proved to need %d at least", used, bound)
    for filling, n in plan_:
        at = 0
        for s, k in filling:
            rows.append((s, ranked[s], ranked[s] + n * k, k, base, at))
            ranked[s] += n * k
            at += s * k
        base += n
    rank, size, low, high, each, first, start = fresh(pieces, "_rank", "_size", "_low", "_high", "_each", "_base", "_at")
    plan = pieces.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` long" for c in (size, low, high, each, first, start)))
    total = sum(counts.values())
    ranked_pieces = bucketed_row_number(pieces, [length_col], F.pmod(F.xxhash64(*order), F.lit(max(16, total // 100_000))), list(order), rank)
    place = F.col(rank) - F.col(low)
    return ranked_pieces.join(
        F.broadcast(plan), (F.col(length_col) == F.col(size)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high))  # bounded by the number of lengths
    ).select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col(first) + F.floor(place / F.col(each))).cast("long").alias("sequence_id"),
        (F.col(start) + F.pmod(place, F.col(each)) * F.col(length_col)).cast("long").alias("offset"),
    )

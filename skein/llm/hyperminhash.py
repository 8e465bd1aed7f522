"""Near-duplicates by HyperMinHash: compressed MinHash registers, banded, estimated, then verified.

A set's 64-bit element hashes are dealt over 128 buckets by their upper bits; of the least hash of
each bucket a register of 16 bits keeps the count of leading zeros and the ten bits after the first
one. A bucket without an element takes the least of all elements under a hash of its own, so that
of sets of any size each register agrees with the probability of the Jaccard similarity J. Four
registers are a band: of two sets with J >= 0.8 no band of 32 agrees with a probability of
(1 - 0.8 ** 4) ** 32 < 5e-8. Agreement by chance, which the compression allows, only adds
candidates; the estimate corrects for it, and full sets decide.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.runtime import written
from skein.operators.components import connected_components

REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Bits of a hash below those that choose the bucket.
VALUE = 64 - 7
#: The chance that a pair at the threshold is given up by its estimate.
MISS = 1e-8
#: Bits of the filter that keeps texts without candidates from being shuffled (2 MB).
FILTER_BITS = 24
#: Buckets of more sets are put together where they share sets.
LARGE = 16
#: A part of a large group has about so many sets, or hashes in its sets, at most.
PART_SETS, PART_HASHES = 1024, 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(33))) * _M3
    return x ^ (x >> np.uint64(33))


_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(VALUE)
_OWN = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _M1) | np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int = 2) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles: A-Z lower-cased, words are
    runs without ASCII white space; fewer words than a shingle are one, none give an empty set."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    whole = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        whole = _mix(whole * _M1 + h[i : len(h) - k + 1 + i])
    return np.unique(whole)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a set that is not empty, from its sorted hashes."""
    at = np.searchsorted(hashes, _STARTS)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    empty = np.flatnonzero((at == len(hashes)) | (least >> np.uint64(VALUE) != _STARTS >> np.uint64(VALUE)))
    least &= np.uint64((1 << VALUE) - 1)
    for part in np.array_split(empty, 1 + len(empty) * len(hashes) // 1_000_000):
        if len(part):
            own = hashes * _OWN[part][:, None]
            least[part] = ((own ^ (own >> np.uint64(32))) * _M3).min(axis=1) >> np.uint64(7)
    high = least >> np.uint64(MANTISSA)  # up to 47 bits, exact as a double
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + MANTISSA, np.frexp(least.astype(np.float64))[1])
    after = (least << (VALUE - bits).astype(np.uint64)) >> np.uint64(VALUE - 1 - MANTISSA)
    return ((VALUE - bits) << MANTISSA | (after & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)).astype("<u2")


def jaccard_estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from how many registers agree in sets of ``n`` and ``m`` elements, less
    the agreement by chance: two least values that differ share zero count and mantissa with a
    probability of nm / (n + m)^2 / (2 ln 2) / 2^mantissa."""
    chance = n / (n + m) * (m / (n + m)) / (2 * log(2)) / (1 << MANTISSA)
    return (same / REGISTERS - chance) / (1 - chance)


def least_estimate(similarity: float, miss: float = MISS) -> float:
    """The estimate below which a pair at the threshold falls with a probability of at most
    ``miss``, by Chernoff's bound."""
    low, high = 0.0, similarity
    for _ in range(60):
        p = (low + high) / 2
        kl = (p * log(p / similarity) if p else 0.0) + (1 - p) * log((1 - p) / (1 - similarity))
        low, high = (p, high) if REGISTERS * kl > -log(miss) else (low, p)
    return low


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(``id``, ``row`` long, ``n`` long, ``v`` binary, ``regs`` binary) of (id, row, text): the
    set's size, a 128-bit name of the set, and its registers; null for the empty set."""

    def run(batches):
        import xxhash

        for batch in batches:
            size, name, regs = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_hashes(text, shingle)
                size.append(len(found))
                name.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                regs.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(regs, pa.binary())], names=["id", "row", "n", "v", "regs"])

    kind = T.StructType([docs.schema["id"], docs.schema["row"], T.StructField("n", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("regs", T.BinaryType())])
    return docs.mapInArrow(run, kind)


def _likely(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (``a``, ``b`` and others) whose sizes and registers allow the similarity, with an
    ``estimate`` of it."""
    side = lambda s: vertices.select(F.col("v").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"regs{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    others = [f for f in pairs.schema if f.name not in ("a", "b")]
    least = least_estimate(percent / 100)

    def run(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            found = jaccard_estimate((ra == rb).sum(axis=1), n, m)
            kept = pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[6:], pa.array(found)], names=["a", "b", *(f.name for f in others), "estimate"])
            yield kept.filter(pa.array(found >= least))

    kind = T.StructType([pairs.schema["a"], pairs.schema["b"], *others, T.StructField("estimate", T.DoubleType())])
    return near.select("a", "b", "na", "nb", "regsa", "regsb", *(f.name for f in others)).mapInArrow(run, kind)


def _sets(docs: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(``v``, ``hashes`` array of longs) of ``ends`` (v, row), anew from the texts. A filter of
    fixed size passes over the other texts; what it lets through by mistake the join leaves out."""
    bit = F.col("row").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int")
    bits = ends.select(F.shiftright(bit, 3).alias("at"), bit.bitwiseAND(F.lit(7)).alias("bit"))
    ones = bits.groupBy("at").agg(F.expr("bit_or(shiftleft(1, bit))").alias("ones")).toPandas()
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    table[ones["at"]] = ones["ones"]
    held = docs.sparkSession.sparkContext.broadcast(table)  # a fixed number of bits

    def run(batches):
        for batch in batches:
            row = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            kept = batch.filter(pa.array((held.value[row >> 3] >> (row & 7) & 1).astype(bool)))
            found = [shingle_hashes(t, shingle).view(np.int64) for t in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row", "hashes"])

    told = docs.select("row", "text").mapInArrow(run, "row long, hashes array<long>")
    return written(told.join(ends, "row").dropDuplicates(["row"]).select("v", "hashes"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (``a``, ``b``) whose full sets have the similarity."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("met"), (F.size("sa") + F.size("sb")).alias("all"))
    return met.where(F.col("met") * 100 >= (F.col("all") - F.col("met")) * percent).select("a", "b")


def block_links(regs: np.ndarray, hashes: list[np.ndarray], component: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked sets of different components in one block; with ``side`` only those of
    which one is on either side. Estimates from the registers first, then full sets."""
    n = np.array([len(h) for h in hashes])
    asked = component[:, None] != component
    asked &= np.tri(len(n), k=-1, dtype=bool) if side is None else side[:, None] & ~side
    asked &= np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent
    rows = np.flatnonzero(asked.any(axis=1) | asked.any(axis=0))
    if not len(rows):
        return rows, rows
    regs, n, asked = regs[rows], n[rows], asked[np.ix_(rows, rows)]
    same = np.zeros(asked.shape, np.uint8)
    for column in regs.T:
        same += column[:, None] == column
    asked &= jaccard_estimate(same, n[:, None], n) >= least_estimate(percent / 100)
    if not asked.any():
        return rows[:0], rows[:0]
    _, at, times = np.unique(np.concatenate([hashes[r] for r in rows]), return_inverse=True, return_counts=True)
    owner, several = np.repeat(np.arange(len(rows)), n), times > 1
    place = np.cumsum(several) - 1
    owner, at = owner[several[at]], place[at[several[at]]]
    met = np.zeros(asked.shape, np.float32)  # counts below 2^24 are exact
    for low in range(0, int(several.sum()), 4096):
        part = (at >= low) & (at < low + 4096)
        has = np.zeros((len(rows), 4096), np.float32)
        has[owner[part], at[part] - low] = 1
        met += has @ has.T
    met = met.astype(np.int64)
    one, two = np.nonzero(asked & (met * 100 >= (n[:, None] + n - met) * percent))
    return rows[one], rows[two]


def _compared(met: DataFrame, vertices: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``) linked sets of different components that meet in a bucket.

    Large buckets that share sets, as the bands of one group of near copies do, are one group, so
    that each of its sets travels once and not once a band; a small bucket is a group by itself. A
    large group is cut in parts and every two parts are a block of their own, so that no group is
    one task's and no pairs are made but links."""
    size = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("head"))
    sized = written(met.join(written(size, "sizes"), ["band", "key"]), "sized")
    large = F.col("n") > LARGE
    group = connected_components(sized.where(large).select(F.col("head").alias("src"), F.col("v").alias("dst")))
    alone = sized.where(~large).select(F.concat("key", F.encode(F.col("band").cast("string"), "UTF-8")).alias("group"), "v", "component")
    joined = sized.where(large).select("v", "component").distinct().join(group.toDF("v", "group"), "v").select("group", "v", "component")
    grouped = written(alone.unionByName(joined).join(vertices.select("v", "n", "regs"), "v"), "grouped")
    parts = grouped.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART_SETS, F.sum("n") / PART_HASHES)).cast("int").alias("parts"))
    dealt = grouped.join(written(parts, "parts"), "group").join(sets, "v").withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "component", "regs", "hashes")
    blocks = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches):
        def links(rows: pa.Table) -> pa.RecordBatch:
            i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            names, components = rows.column(4).to_pylist(), rows.column(5).to_pylist()
            number = {c: k for k, c in enumerate(set(components))}
            regs = np.frombuffer(b"".join(rows.column(6).to_pylist()), "<u2").reshape(-1, REGISTERS)
            lists = rows.column(7).combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            side = None if i == j else rows.column(3).to_numpy() == i
            one, two = block_links(regs, np.split(flat, ends[:-1]), np.array([number[c] for c in components]), side, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([names[k] for k in one], pa.binary()), "b": pa.array([names[k] for k in two], pa.binary())})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            for start, end in zip(cuts, [*cuts[1:], len(keys)]):
                if held and tuple(held[0].column(k)[0].as_py() for k in range(3)) != keys[start]:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield links(pa.Table.from_batches(held))

    found = blocks.mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(docs: DataFrame, vertices: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(``node``, ``component``) of sets that are linked with another.

    In each round one set of each bucket in which several components meet stands for the others;
    in the first round each set is held against the likeliest of those, later each two components
    by their likeliest pair. So a group of near copies grows together without its pairs. Once
    fewer than a quarter of a round's pairs are links, all sets of different components that meet
    in a bucket are compared in blocks, so that no link between components is lost.
    """
    bands = [F.struct(F.lit(i).alias("band"), F.substring("regs", 2 * BAND * i + 1, 2 * BAND).alias("key")) for i in range(REGISTERS // BAND)]
    banded = vertices.select("v", F.explode(F.array(*bands)).alias("c")).select("c.*", "v")
    shared = written(banded.groupBy("band", "key").count().where("count > 1").select("band", "key"), "shared")
    met = written(banded.join(shared, ["band", "key"]).withColumn("component", F.col("v")), "met")
    sets = _sets(docs, written(met.select("v").distinct().join(vertices.select("v", "row"), "v"), "ends"), shingle)
    links = None
    for turn in range(64):  # ends when a round finds few links
        head = F.min(F.struct(F.xxhash64(F.lit(turn), "band", "v"), F.col("v").alias("head"), F.col("component").alias("of")))
        heads = met.groupBy("band", "key").agg(head.alias("h")).select("band", "key", "h.head", "h.of")
        star = met.join(written(heads, "heads"), ["band", "key"]).where("component <> of")
        ends = (F.least("v", "head").alias("a"), F.greatest("v", "head").alias("b"), F.least("component", "of").alias("x"), F.greatest("component", "of").alias("y"))
        likely = _likely(written(star.select(*ends, F.col("v").alias("own")).distinct(), "star"), vertices, percent)
        best = likely.groupBy(*(["x", "y"] if turn else ["own"])).agg(F.max(F.struct("estimate", "a", "b")).alias("best"))
        held = written(best.select("best.a", "best.b").distinct(), "held")
        found = written(_verified(held, sets, percent), "found")
        links = links.union(found) if turn else found
        component = connected_components(links.toDF("src", "dst"))
        named = met.select("band", "key", "v").join(component, met["v"] == component["node"], "left")
        named = written(named.select("band", "key", "v", F.coalesce("component", "v").alias("component")), "named")
        several = named.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
        met = written(named.join(written(several, "several"), ["band", "key"]), "met")
        if 4 * found.count() <= held.count():
            break
    return connected_components(links.union(written(_compared(met, vertices, sets, percent), "more")).toDF("src", "dst"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_shingles`` long, ``component_id``, ``kept`` boolean): the smallest id reachable over
    links between sets of distinct shingles whose intersection has at least ``percent`` hundredths
    of their union, itself included; ``kept`` where that is the own id.

    Documents with one set are one vertex, so copies make no pairs. Null, empty and blank texts
    have the empty set and stay alone. Repeated ids keep a row each and are kept alike; null ids
    never name a component unless all its ids are null, and are then kept. Other columns of
    ``docs`` may have any names; an empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`")
    own = F.col(f"`{id_col}`")
    docs = docs.select(own.alias("id"), F.xxhash64(own, text).alias("row"), text.cast("binary").alias("text"))
    marks = written(_marks(docs, shingle), "marks")
    nulls_last = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    vertices = marks.where("v is not null").groupBy("v").agg(F.min(nulls_last).alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    vertices = written(vertices.select("v", "n", "regs", F.col("least.id").alias("first"), "least.row"), "vertices")
    member = written(_links(docs, vertices, percent, shingle), "members")
    whole = vertices.select("v", "first").join(member, vertices["v"] == member["node"], "left").select("v", "first", F.coalesce("component", "v").alias("root"))
    named = whole.join(written(whole.groupBy("root").agg(F.min("first").alias("component_id")), "least"), "root")
    named = written(named.select(F.col("v").alias("_v"), "component_id"), "named")
    all_ = marks.select("id", "n", "v").join(named, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return all_.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

"""Concept graphs: edges (src, dst, weight) with src < dst from text, and analytics over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain, count
from math import gcd, inf
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.operators.ranking import bucketed_row_number, range_row_number
from skein.operators.storage import Scratch, delete, written


def undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def both_ways(edges: DataFrame) -> DataFrame:
    """(``node``, ``other``, ``weight``): each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))).alias("e")).select("e.*")


def pairs_in_window(tokens: DataFrame, keys: list[str], order: str = "pos", window: int = 4) -> DataFrame:
    """(keys, src, dst, weight): unequal tokens d < window apart, at weight window - d. The window
    function runs inside a segment, so a pair needs no join."""
    along = Window.partitionBy(*keys).orderBy(order)
    near = F.array(*[F.struct(F.lead("token", d).over(along).alias("b"), F.lit(window - d).cast("long").alias("weight")) for d in range(1, window)])
    found = tokens.select(*keys, F.col("token").alias("a"), near.alias("near")).select(*keys, "a", F.explode("near").alias("x")).where("x.b is not null and x.b <> a")
    return found.select(*keys, *undirected(F.col("a"), F.col("x.b")), "x.weight")


def cooccurrence_edges(tokens: DataFrame, keys: list[str], order: str = "pos", window: int = 4) -> DataFrame:
    """GR-1. Weighted undirected edges; partial sums meet hot pairs."""
    return pairs_in_window(tokens, keys, order, window).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


# The same from ``lists``: one row a segment (keys, ``tokens`` in order), so that windows are looked up
# in the row itself and no token is shuffled or sorted before its partial sums.


def _placed(lists: DataFrame, *kept: str) -> DataFrame:
    """(kept, ``pos`` from 0, ``a``, ``tokens``): a row a token."""
    return lists.select(*kept, "tokens", F.posexplode("tokens").alias("pos", "a"))


def pairs_in_lists(lists: DataFrame, keys: list[str], window: int = 4) -> DataFrame:
    """``pairs_in_window`` of lists: a list beside itself moved on, so that a row carries a token and
    those after it and not its whole list."""
    moved = [F.slice("tokens", F.lit(d + 1), F.greatest(F.lit(0), F.size("tokens"))) for d in range(1, window)]
    rows = lists.select(*keys, F.inline(F.arrays_zip("tokens", *moved))).toDF(*keys, "_a", *[f"_{d}" for d in range(1, window)])
    near = F.array(*[F.struct(F.col(f"_{d}").alias("b"), F.lit(window - d).cast("long").alias("weight")) for d in range(1, window)])
    found = rows.select(*keys, "_a", F.explode(near).alias("_x")).where("_x.b is not null and _x.b <> _a")
    return found.select(*keys, *undirected(F.col("_a"), F.col("_x.b")), "_x.weight")


def edges_of_lists(lists: DataFrame, window: int = 4) -> DataFrame:
    """GR-1 of lists."""
    return pairs_in_lists(lists, [], window).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def numbered(lists: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(names, edges, bits): the distinct tokens (``node``, ``id`` from 0 in their order), GR-1 under
    their numbers, and the bits of a number.

    Numbers compare as the names do, and a pair of them is one number, so that what is shuffled is a
    third of the names. Tokens are looked up once an occurrence, and not once a pair or an edge."""
    tokens = lists.select(F.monotonically_increasing_id().alias("list"), "tokens").select("list", F.posexplode("tokens").alias("pos", "node"))
    names = written(range_row_number(tokens.select("node").distinct(), ["node"], "id").select("node", F.col("id").cast("long").alias("id")), "names")
    bits = names.count().bit_length()
    if bits > 31:
        raise ValueError("a pair of more than 2^31 tokens is no long")
    mask = F.lit((1 << bits) - 1)
    placed = tokens.join(names, "node").select("list", F.shiftleft(F.col("pos").cast("long"), bits).bitwiseOR(F.col("id")).alias("at"))
    found = placed.repartition("list").groupBy("list").agg(F.array_sort(F.collect_list("at")).alias("all"))
    found = written(found.select(F.transform("all", lambda x: x.bitwiseAND(mask)).alias("tokens")), "numbers")
    pairs = pairs_in_lists(found, []).select(F.shiftleft("src", bits).bitwiseOR(F.col("dst")).alias("pair"), "weight")
    edges = pairs.groupBy("pair").agg(F.sum("weight").alias("weight"))
    return names, written(edges.select(F.shiftright("pair", bits).alias("src"), F.col("pair").bitwiseAND(mask).alias("dst"), "weight"), "edges"), bits


def token_counts(lists: DataFrame) -> DataFrame:
    """(token, ``n``, ``segs``): occurrences and segments of each token. In a sorted list a token that
    is not the one before it is its first in the segment."""
    ordered = lists.select(F.array_sort("tokens").alias("tokens"))
    rows = ordered.select(F.inline(F.arrays_zip("tokens", F.concat(F.array(F.lit(None).cast("string")), F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - 1)))))).toDF("token", "_before")
    return rows.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("token").eqNullSafe(F.col("_before"))).cast("int")).alias("segs"))


def links_of_lists(lists: DataFrame, nodes: DataFrame, part: Callable[[Column], Column], parts: int, window: int = 4) -> DataFrame:
    """(``ca``, ``cb``, ``links``, ``weight``): edges of GR-1 and their weight between the parts of a
    partition by name (``part`` of a token, from 0 to less than ``parts``), without a table of edges.

    Edges are summed under numbers: a token's hash with its part in the last bits. ``nodes`` (node)
    has each token once, so that it shows whether two share a number; then the names are taken.
    """
    bits = (parts - 1).bit_length()
    number = lambda t: F.shiftleft(F.xxhash64(t), bits).bitwiseOR(part(t).cast("long"))
    if nodes.groupBy(number(F.col("node")).alias("number")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        edges = edges_of_lists(lists, window).select(part(F.col("src")).alias("ca"), part(F.col("dst")).alias("cb"), "weight")
    else:
        of = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        numbers = lists.select(F.transform("tokens", number).alias("tokens"))
        edges = edges_of_lists(numbers, window).select(of("src").alias("ca"), of("dst").alias("cb"), "weight")
    return edges.groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))


def _bigrams_in(lists: DataFrame, keys: list[str]) -> DataFrame:
    return _placed(lists, *keys).select(*keys, "pos", "a", F.get("tokens", F.col("pos") + 1).alias("b")).where("b is not null and a <> b")


def _bigram_totals(lists: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, n, first, last): occurrences of a bigram, and the keys and places of the first and
    the last one (its place negative) in its first segment."""
    return _bigrams_in(lists, keys).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "pos")).alias("first"), F.min(F.struct(*keys, (-F.col("pos")).alias("pos"))).alias("last"))


#: An occurrence that is alone in the first segment of its bigram is not promoted.
_ALONE = "first.pos = -last.pos"


def place_bits(docs: DataFrame, doc: str, text: str) -> tuple[int, int] | None:
    """Bits for a segment's number and for a place, where these and the document's id go into one
    positive long, else None: neither is above the bytes of the longest text."""
    least, most, length, without = docs.agg(F.min(doc), F.max(doc), F.max(F.octet_length(text)), F.count_if(F.col(doc).isNull())).first()
    if without or not isinstance(least, int):
        return None
    bits = (length or 0).bit_length()
    return (bits, bits) if least >= 0 and most.bit_length() + 2 * bits < 64 else None


def _place(keys: list[str], bits: tuple[int, int]) -> Column:
    """The first place of a segment, as one number: ``bits`` of the second key and of a place."""
    return F.shiftleft(F.shiftleft(F.col(keys[0]).cast("long"), bits[0]).bitwiseOR(F.col(keys[1]).cast("long")), bits[1])


def _numbered_totals(lists: DataFrame, bits: tuple[int, int]) -> DataFrame:
    """(a, b, n, first, last, alone) of lists (``segment`` from ``_place``, tokens): ``_bigram_totals``
    with keys and place in one number, of which Spark keeps sums without sorting."""
    last = (1 << bits[1]) - 1
    found = _bigrams_in(lists, ["segment"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("segment") + F.col("pos")).alias("first"), F.min(F.col("segment") + last - F.col("pos")).alias("last"))
    return found.withColumn("alone", F.col("first").bitwiseAND(F.lit(last)) + F.col("last").bitwiseAND(F.lit(last)) == last)


def promoted_counts(lists: DataFrame, keys: list[str], bits: tuple[int, int] | None = None) -> DataFrame:
    """GR-4. (a, b, n): promoted occurrences of each bigram that has some. ``bits``: of ``place_bits``."""
    if not bits:
        return _bigram_totals(lists, keys).select("a", "b", (F.col("n") - F.expr(_ALONE).cast("int")).alias("n")).where("n > 0")
    found = _numbered_totals(lists.select(_place(keys, bits).alias("segment"), "tokens"), bits)
    return found.select("a", "b", (F.col("n") - F.col("alone").cast("int")).alias("n")).where("n > 0")


def concept_nodes(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """GR-2. One row a token: its largest term weight in any segment, occurrences, segments."""
    tf = tokens.groupBy("token", *keys).agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("token").agg((F.max("tf") * (1 + F.log(F.lit(0.5)))).alias("tfidf"), F.sum("tf").alias("n"), F.count(F.lit(1)).alias("segments"))


def bigrams(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, a, b): adjacent unequal tokens."""
    along = Window.partitionBy(*keys).orderBy("pos")
    return tokens.select(*keys, "pos", F.col("token").alias("a"), F.lead("token").over(along).alias("b")).where("b is not null and a <> b")


def bigram_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """GR-3."""
    return bigrams(tokens, keys).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def promoted_phrases(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """GR-4. Occurrences whose count so far, their whole segment included, is two or more.

    That is every occurrence but a single one in the first segment of its bigram, so that sums by
    bigram do for a running count and a common bigram needs no window of its own.
    """
    found = written(bigrams(tokens, keys), "bigrams")
    per = found.groupBy("a", "b", *keys).agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy("a", "b").agg(F.min(F.struct(*keys, "n")).alias("first"))
    alone = first.where("first.n = 1").select("a", "b", *[F.col(f"first.{k}").alias(k) for k in keys])
    return found.join(alone, ["a", "b", *keys], "left_anti")


def phrase_edges(tokens: DataFrame, keys: list[str], window: int = 4) -> DataFrame:
    """GR-5. Edges from a phrase to both its words (weight window) and to the words up to
    window - 1 places outside it (weight window - d)."""
    along = Window.partitionBy(*keys).orderBy("pos")
    around = [F.struct(F.lag("token", d).over(along).alias("w"), F.lit(window - d).cast("long").alias("weight")) for d in range(1, window)]
    around += [F.struct(F.lead("token", d + 1).over(along).alias("w"), F.lit(window - d).cast("long").alias("weight")) for d in range(1, window)]
    context = tokens.select(*keys, "pos", F.array(*around).alias("around"))
    found = promoted_phrases(tokens, keys).join(context, [*keys, "pos"])
    parts = F.array(F.struct(F.col("a").alias("w"), F.lit(window).cast("long").alias("weight")), F.struct(F.col("b").alias("w"), F.lit(window).cast("long").alias("weight")))
    rows = found.select(F.concat_ws(" ", "a", "b").alias("phrase"), F.explode(F.concat(parts, "around")).alias("x")).where("x.w is not null")
    return rows.select("phrase", "x.*").groupBy("phrase", "w").agg(F.sum("weight").alias("weight"))


def phrase_edges_of_lists(lists: DataFrame, keys: list[str], window: int = 4, bits: tuple[int, int] | None = None) -> DataFrame:
    """GR-5 of lists. Only the places that are not promoted are sent to the segments, and a phrase's
    surroundings are looked up in its own row. Each step is written, so that no two steps' shuffle
    files are on disk together. ``bits``: of ``place_bits``."""
    if bits:
        lists = lists.select(_place(keys, bits).alias("segment"), "tokens")
        first, last = F.col("first"), F.lit((1 << bits[1]) - 1)
        alone = _numbered_totals(lists, bits).where("alone").select((first - first.bitwiseAND(last)).alias("segment"), first.bitwiseAND(last).cast("int").alias("pos"))
        keys = ["segment"]
    else:
        alone = _bigram_totals(lists, keys).where(_ALONE).select("first.*")
    alone = written(alone, "alone").groupBy(*keys).agg(F.collect_list("pos").alias("not_promoted"))
    left = lists.join(alone, keys, "left").select("tokens", F.coalesce("not_promoted", F.array().cast("array<int>")).alias("not_promoted"))
    left = written(left.where(F.size("tokens") > 1), "left")
    # The places that stay, by a set difference: a place's own search would be a square of long segments.
    places = F.array_except(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tokens") - 2)), "not_promoted")
    at = left.select("tokens", F.explode(places).alias("pos"))
    found = at.select("tokens", "pos", F.get("tokens", "pos").alias("a"), F.get("tokens", F.col("pos") + 1).alias("b")).where("a <> b")
    offsets = [(0, window), (1, window)] + [(-d, window - d) for d in range(1, window)] + [(d + 1, window - d) for d in range(1, window)]
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).cast("long").alias("weight")) for o, w in offsets])
    rows = found.select(F.concat_ws(" ", "a", "b").alias("phrase"), "tokens", "pos", F.explode(steps).alias("x"))
    rows = rows.select("phrase", F.when(F.col("pos") + F.col("x.o") >= 0, F.get("tokens", F.col("pos") + F.col("x.o"))).alias("w"), "x.weight").where("w is not null")
    return rows.groupBy("phrase", "w").agg(F.sum("weight").alias("weight"))


def edge_provenance(pairs: DataFrame, iteration: Column, origin: Column) -> DataFrame:
    """GR-6. The first iteration of each edge and the origin it had then."""
    marked = pairs.select("src", "dst", iteration.alias("iteration"), origin.alias("origin"))
    return marked.groupBy("src", "dst").agg(F.min(F.struct("iteration", "origin")).alias("x")).select("src", "dst", "x.*")


def provenance_of_lists(lists: DataFrame, iteration: Column, origin: Column, origins: list[str], window: int = 4) -> DataFrame:
    """GR-6 of lists, whose ``origin`` is one of ``origins``: iteration and origin are one number, in
    their order, of which Spark keeps a minimum by edge without sorting pairs. Null is no minimum."""
    names = F.array(*map(F.lit, sorted(origins)))
    born = iteration.cast("long") * len(origins) + F.array_position(names, origin) - 1
    pairs = pairs_in_lists(lists.select(born.alias("born"), "tokens"), ["born"], window)
    first = pairs.groupBy("src", "dst").agg(F.min("born").alias("born"))
    place = F.pmod("born", F.lit(len(origins)))
    return first.select("src", "dst", F.expr(f"(born - pmod(born, {len(origins)})) div {len(origins)}").alias("iteration"), F.get(names, place.cast("int")).alias("origin"))


def new_edges(edges: DataFrame, iteration: int, known: list[str]) -> DataFrame:
    """GR-7. Edges created in an iteration; an origin that is not known becomes ``unknown``."""
    return edges.where(F.col("iteration") == iteration).withColumn("origin", F.when(F.col("origin").isin(known), F.col("origin")).otherwise("unknown"))


def degrees(edges: DataFrame) -> DataFrame:
    """GR-8. ``degree`` and ``strength`` (weighted degree) of each node."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """GR-8. One row: nodes, edges, total weight, largest degree."""
    size = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total_weight"))
    order = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("degree").alias("max_degree"))
    return order.join(size, F.lit(True))  # one row each


def without_vector(nodes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """GR-9."""
    return nodes.join(vectors.select(key), key, "left_anti")


def segmentation_artifacts(tokens: DataFrame, doc: str, seg: str) -> DataFrame:
    """GR-10. Edges that exist only if windows may run across segments."""
    along = tokens.withColumn("_at", F.struct(seg, "pos"))
    across = cooccurrence_edges(along, [doc], "_at")
    return across.join(cooccurrence_edges(tokens, [doc, seg]), ["src", "dst"], "left_anti")


def artifacts_of_lists(lists: DataFrame, doc: str, seg: str, window: int = 4) -> DataFrame:
    """GR-10 of lists, in one sum by edge. A segment's tokens follow each other in their document,
    so that a pair inside a segment is one of the document's pairs too."""
    whole = lists.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(seg, "tokens"))).alias("all"))
    whole = whole.select(F.flatten(F.transform("all", lambda s: F.transform(s["tokens"], lambda t: F.struct(s[seg].alias("seg"), t.alias("token"))))).alias("tokens"))
    steps = _placed(whole).select("tokens", "pos", "a", F.explode(F.array(*map(F.lit, range(1, window)))).alias("d"))
    pairs = steps.select("a", F.get("tokens", F.col("pos") + F.col("d")).alias("b"), (window - F.col("d")).cast("long").alias("weight")).where("b is not null and a.token <> b.token")
    sums = pairs.groupBy(*undirected(F.col("a.token"), F.col("b.token"))).agg(F.sum("weight").alias("weight"), F.max(F.col("a.seg") == F.col("b.seg")).alias("inside"))
    return sums.where("not inside").select("src", "dst", "weight")


# Communities. ``members`` has (node, community) and, where named, score and tfidf.


def _inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with the community of either end; edges that have both (``ca``, ``cb``) are left as
    they are. A row is one link, unless it stands for several (``links``) already."""
    if not {"ca", "cb"} <= set(edges.columns):
        a = members.select(F.col("node").alias("src"), F.col("community").alias("ca"))
        b = members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
        edges = edges.join(a, "src").join(b, "dst")
    return edges if "links" in edges.columns else edges.withColumn("links", F.lit(1).cast("long"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """GA-2. One row: Q of a partition at resolution 1."""
    # Strengths of communities are sums over the ends of edges: no sum by node is needed.
    between = written(_inside(edges, members).groupBy("ca", "cb").agg(F.sum("weight").alias("weight")), "between")
    inside = between.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("w"), F.sum("weight").alias("m"))
    strength = between.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("d"))
    squares = strength.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("s"))
    return inside.join(squares, F.lit(True)).select((F.col("w") / F.col("m") - F.col("s") / (4.0 * F.col("m") * F.col("m"))).alias("q"))  # one row each


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """GA-3. (node, community): in each round every node takes the label with the largest weight
    around it, of those the smallest; labels begin as the nodes themselves."""
    near = both_ways(edges)
    labels = near.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("x"))
        labels = written(best.select("node", F.col("x.community").alias("community")), "labels")
    return labels


def label_propagation_of_numbers(edges: DataFrame, names: DataFrame, bits: int, rounds: int) -> DataFrame:
    """GA-3 of ``numbered`` edges, of which each stands once. In the first round a node's neighbours are
    the labels; a vote and its label are one number, the smaller label the larger one, so that the best
    is a maximum that needs no sort and meets in partial sums."""
    near, top = both_ways(edges), (1 << bits) - 1
    if (edges.agg(F.sum("weight")).first()[0] or 0).bit_length() + bits > 63:
        raise ValueError("a weight and a label are no long")
    scratch, labels = Scratch(edges.sparkSession, kept=1), None
    for _ in range(rounds):
        votes = near.select("node", F.col("other").alias("community"), F.col("weight").alias("w"))
        if labels is not None:
            votes = near.join(labels.toDF("other", "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.max(F.shiftleft("w", bits).bitwiseOR(F.lit(top) - F.col("community"))).alias("x"))
        labels = scratch.keep(best.select("node", (F.lit(top) - F.col("x").bitwiseAND(F.lit(top))).alias("community")), "labels")
    if labels is None:
        labels = near.select("node").distinct().withColumn("community", F.col("node"))
    a, b = names.select(F.col("id").alias("node"), F.col("node").alias("_node")), names.select(F.col("id").alias("community"), F.col("node").alias("_community"))
    return labels.join(a, "node").join(b, "community").select(F.col("_node").alias("node"), F.col("_community").alias("community"))


#: Levels after which what was found is written as one table, so that plans stay short on long chains.
LEVELS = 16


def breadth_first(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(``source``, ``node``, ``hops``, ``paths``): distance and number of shortest paths from each
    source (column ``source``), level by level until none is left; each level is written out. A
    neighbour of a level lies in it, in the one before or in the next, so it is held against two."""
    near = written(both_ways(edges).select("node", "other").distinct(), "near")
    seen = level = written(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("paths")), "level")
    before = level
    for hop in count(1):
        step = level.join(near, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        new = step.join(level.unionByName(before), ["source", "node"], "left_anti")
        before, level = level, written(new.select("source", "node", F.lit(hop).alias("hops"), "paths"), "level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
        if hop % LEVELS == 0:
            seen = written(seen, "seen")


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(``source``, ``node``, ``delta``): what share of the shortest paths from the source to all
    other nodes runs through the node; only nodes with some."""
    near = written(both_ways(edges).select("node", "other").distinct(), "near")
    reached = written(breadth_first(edges, sources), "reached")
    depth = reached.agg(F.max("hops")).first()[0] or 0
    level = reached.where(F.col("hops") == depth).select("source", "node", "hops", "paths", F.lit(0.0).alias("delta"))
    gathered = level.where("false")
    for hop in range(depth - 1, 0, -1):
        share = level.join(near, "node").select("source", F.col("other").alias("node"), ((1 + F.col("delta")) / F.col("paths")).alias("part"))
        here = reached.where(F.col("hops") == hop).join(share.groupBy("source", "node").agg(F.sum("part").alias("part")), ["source", "node"], "left")
        level = written(here.select("source", "node", "hops", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("delta")), "delta")
        gathered = gathered.unionByName(level.where("delta > 0"))
        if hop % LEVELS == 0:
            gathered = written(gathered, "gathered")
    return gathered.select("source", "node", "delta")


def betweenness(edges: DataFrame, sources: DataFrame, n_nodes: int) -> DataFrame:
    """GA-4. (node, betweenness) by unweighted hops over (n - 1)(n - 2) / 2. Exact if ``sources``
    holds all nodes; with fewer pivots the sum is scaled up by n over their number."""
    total = _dependencies(edges, sources).groupBy("node").agg(F.sum("delta").alias("delta"))
    scale = n_nodes / max(1, sources.count()) / max(1.0, (n_nodes - 1) * (n_nodes - 2))
    nodes = both_ways(edges).select("node").distinct()
    return nodes.join(total, "node", "left").select("node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


#: Entries of a node that lie in one list, of which a node with many neighbours has several; entries that
#: one group holds against a front; and how many of these cost as much as a row that is looked up.
PIECE = 4096
GROUP = 1 << 21
ROW = 16


def _listed(front: DataFrame, near: DataFrame, at: str) -> DataFrame:
    """``front`` with the lists (``ids``: id, degree) of the neighbours of its nodes ``at``."""
    pieces = front.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("degree") / PIECE)))).drop("degree")
    return pieces.join(near.withColumnRenamed("at", at), [at, "piece"])


def _meet(lists: pa.Table, held: pa.Table) -> pa.Table:
    """(run, a, b): the entries b of the lists (run, a, ids) that the same run holds (run, id)."""
    n = pc.list_value_length(lists["ids"]).to_numpy()
    to, at = pc.list_flatten(lists["ids"]).to_numpy(), np.repeat(np.arange(len(lists)), n)
    runs, code = np.unique(held["run"].to_numpy(), return_inverse=True)
    if not len(runs) or not len(to):
        return pa.table({c: pa.array([], pa.int64()) for c in ("run", "a", "b")})
    run, ids = lists["run"].to_numpy(), held["id"].to_numpy()
    mine, width = np.searchsorted(runs, run), int(max(to.max(), ids.max())) + 1
    known = runs[np.minimum(mine, len(runs) - 1)] == run
    keys, asked = np.sort(code * width + ids), mine[at] * width + to
    hit = (keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked) & known[at]
    return pa.table({"run": run[at[hit]], "a": lists["a"].to_numpy()[at[hit]], "b": to[hit]})


def _across(ends: DataFrame, near: DataFrame, left: DataFrame, right: DataFrame, on: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``on``, a, b, left, right): the edges from a node of ``left`` to one of ``right`` (id, degree and
    others, which come as structs) of the same key, pair or pair and side; and (``on``, el, er), the
    entries of either side of each key that has both. A key takes the cheapest way: all pairs of its
    nodes are looked up among the edges, or the lists of one side are held against the other in groups
    of bounded size."""
    size = lambda df, n, e: df.groupBy(on).agg(F.count(F.lit(1)).alias(n), F.sum("degree").alias(e))
    sizes = size(left, "nl", "el").join(size(right, "nr", "er"), on).withColumn("product", F.col("nl").cast("double") * F.col("nr"))
    way = F.when(F.col("product") * ROW <= F.least("el", "er"), 0).when(F.col("el") <= F.col("er"), 1).otherwise(2)
    sizes = sizes.select(*on, "el", "er", way.alias("way"), F.when(way == 0, F.col("product")).otherwise(F.col("nl") + F.col("nr") + F.least("el", "er")).alias("work"))
    sizes = scratch.keep(sizes.withColumn("parts", (1 + F.floor(F.col("work") / GROUP)).cast("long")), "sizes")
    work = dict(sizes.groupBy("way").agg(F.sum("work")).collect())
    part = lambda id_: F.pmod(F.xxhash64(id_), F.col("parts"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    found = []
    if 0 in work or not work:
        mine = sizes.where("way = 0").select(*on, "parts")
        one = left.select(*on, F.col("id").alias("a")).join(mine, on).withColumn("part", part("a")).drop("parts")
        other = right.select(*on, F.col("id").alias("b")).join(mine, on).withColumn("part", parts).drop("parts")
        asked = one.join(other, [*on, "part"])
        asked = scratch.keep(asked, "asked") if work.get(0, 0) <= GROUP else asked  # a small table is sent to the edges
        found.append(asked.join(ends.select(F.col("at").alias("a"), F.col("id").alias("b")), ["a", "b"]).select(*on, "a", "b"))
    run = F.col("pair") * 2 + F.col("side") if "side" in on else F.col("pair")
    for w, (going, held) in ((1, (left, right)), (2, (right, left))):
        if w in work:
            groups = 1 + int(work[w]) // GROUP
            group = F.pmod(F.xxhash64("run", "part"), F.lit(groups)).alias("group")
            mine = sizes.where(F.col("way") == w).select(*on, "parts")
            lists = scratch.keep(going.join(mine, on).select(run.alias("run"), F.col("id").alias("a"), "degree", "parts"), "going")
            lists = _listed(lists, near, "a").select("run", "a", "parts", F.col("ids.id").alias("ids")).withColumn("part", parts)
            some = F.when(F.col("parts") > 1, F.filter("ids", lambda i: part(i) == F.col("part"))).otherwise(F.col("ids"))
            lists = lists.select(group, "run", "a", some.alias("ids")).repartition(groups, "group")
            rows = held.join(mine, on).select(run.alias("run"), "id", part("id").alias("part")).select(group, "run", "id").repartition(groups, "group")
            met = lists.groupBy("group").cogroup(rows.groupBy("group")).applyInArrow(lambda l, r: _meet(l, r), "run long, a long, b long")
            if w == 2:
                met = met.select("run", F.col("b").alias("a"), F.col("a").alias("b"))
            key = [F.expr("run div 2").alias("pair"), F.expr("int(run % 2)").alias("side")] if "side" in on else [F.col("run").alias("pair")]
            found.append(met.select(*key, "a", "b"))
    found = scratch.keep(reduce(DataFrame.union, found), "edges")
    row = lambda df, id_, name: df.select(*on, F.col("id").alias(id_), F.struct(*[c for c in df.columns if c not in on]).alias(name))
    return found.join(row(left, "a", "left"), [*on, "a"]).join(row(right, "b", "right"), [*on, "b"]), sizes


def _pair_shares(ends: DataFrame, near: DataFrame, degrees_: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(``id``, ``s``, ``ss``): sums over ``pairs`` (pair, s, t) of the share of a pair's shortest paths
    that run through a node between them, and of its square.

    Both ends of a pair grow, the one with fewer edges to follow, until an edge joins their fronts; all
    such edges are on shortest paths then. From there the shares go back to either end."""
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("id")) for i, c in enumerate("st")]))
    front = pairs.select("pair", both.alias("e")).select("pair", "e.*").join(degrees_, "id")
    columns = ["pair", "side", "id", "hops", "paths", "degree", "new"]
    front = scratch.keep(front.select("pair", "side", "id", F.lit(0).alias("hops"), F.lit(1.0).alias("paths"), "degree", F.lit(True).alias("new")).select(columns), "front")
    levels, seeds = [], []
    while True:
        levels.append(front.where("new").drop("new"))
        side = lambda i: front.where(F.col("side") == i).select("pair", "id", "hops", "paths", "degree")
        met, sizes = _across(ends, near, side(0), side(1), ["pair"], scratch)
        met = scratch.keep(met, "met")
        both = F.col("left.paths") * F.col("right.paths")
        total = met.groupBy("pair").agg(F.sum(both).alias("total"))
        share = met.join(total, "pair").withColumn("share", both / F.col("total"))
        for i, name in enumerate(["left", "right"]):
            seeds.append(share.groupBy("pair", F.lit(i).alias("side"), F.col(name).alias("n")).agg(F.sum("share").alias("share")).select("pair", "side", "n.*", "share"))
        # A pair that has no nodes left on one side is not connected.
        go = sizes.join(met.select("pair").distinct(), "pair", "left_anti").select("pair", F.when(F.col("el") <= F.col("er"), 0).otherwise(1).alias("go"))
        go = scratch.keep(go, "go")
        if go.isEmpty():
            break
        told = front.join(go, "pair")
        going = scratch.keep(told.where("side = go").select("pair", "side", F.col("id").alias("at"), "hops", "paths", "degree"), "going")
        steps = _listed(going, near, "at").select("pair", "side", "hops", "paths", F.inline("ids"))
        grown = steps.groupBy("pair", "side", "id").agg((F.max("hops") + 1).alias("hops"), F.sum("paths").alias("paths"), F.max("degree").alias("degree"))
        # A neighbour of a level lies in it, in the one before or in the next.
        own = reduce(DataFrame.union, levels).select("pair", "side", "id", F.col("hops").alias("had")).join(go.select("pair", F.col("go").alias("side")), ["pair", "side"], "left_semi")
        grown = grown.join(own, ["pair", "side", "id"], "left_anti").withColumn("new", F.lit(True))
        front = scratch.keep(told.where("side <> go").withColumn("new", F.lit(False)).select(columns).union(grown.select(columns)), "front")
    seeds, level = scratch.keep(reduce(DataFrame.unionByName, seeds), "seeds"), reduce(DataFrame.union, levels)
    carried, shares = seeds.where("false").drop("hops"), []
    for hop in range(seeds.agg(F.max("hops")).first()[0] or 0, 0, -1):
        here = seeds.where(F.col("hops") == hop).drop("hops").unionByName(carried)
        here = scratch.keep(here.groupBy("pair", "side", "id").agg(F.sum("share").alias("share"), F.max("paths").alias("paths"), F.max("degree").alias("degree")), "here")
        shares.append(here.select("id", "share"))
        if hop > 1:
            before = level.where(F.col("hops") == hop - 1).join(here.select("pair", "side").distinct(), ["pair", "side"], "left_semi").drop("hops")
            back, _ = _across(ends, near, here, before, ["pair", "side"], scratch)
            part = F.sum(F.col("left.share") / F.col("left.paths") * F.col("right.paths")).alias("share")
            carried = back.groupBy("pair", "side", F.col("right").alias("n")).agg(part).select("pair", "side", "n.*", "share")
    shares = reduce(DataFrame.union, shares) if shares else seeds.select("id", "share").where("false")
    return shares.groupBy("id").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("ss"))


def sampled_betweenness(edges: DataFrame, n_nodes: int, error: float = 0.25, top: int = 100, first: int = 32, z: float = 1.96, seed: int = 7) -> tuple[DataFrame, int]:
    """GA-4. ((node, betweenness, error), sources asked): betweenness to a relative error.

    Nodes are taken as sources in the order of a seeded hash, each with one target, and after the last
    again from the first with other targets, so that no pair comes twice: ``first`` pairs, and then each
    time at least as many again, or what the error so far asks for. After each block every node has the mean
    of its share of shortest paths over the pairs so far, and the half-width of its interval: ``z``
    standard errors, less by the share of pairs already asked. The search ends when the half-widths of
    the ``top`` nodes of the largest means are all within ``error`` of these, or when all pairs have been
    asked and the figures are exact. ``error`` of the result is that half-width (1.96: at 95 %, for the
    means of many pairs). Nodes on no shortest path of a pair have 0 and no known error (null).

    A pair walks the surroundings of its two ends, where a source with all its targets walks all
    edges twice. The sums and squares of a block are joined to those before it and written, and the
    figures of ``top`` rows alone reach the driver.
    """
    spark = edges.sparkSession
    nodes = both_ways(edges).select("node").distinct()
    order = bucketed_row_number(nodes, [], F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1024)), [F.xxhash64(F.lit(seed), "node"), "node"], "place")
    order = written(order.select("node", F.col("place").cast("long").alias("id")), "order")
    count_ = order.count()
    scale = count_ * (count_ - 1) / max(1.0, (n_nodes - 1) * (n_nodes - 2))
    if count_ < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error")), count_
    ends = edges.where("src <> dst").select("src", "dst").join(order.toDF("src", "a"), "src").join(order.toDF("dst", "b"), "dst").select("a", "b")
    ends = written(ends.union(ends.select("b", "a")).toDF("at", "id").distinct(), "ends")
    degrees_ = written(ends.groupBy("at").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("at", "id"), "degrees")
    near = ends.join(degrees_, "id").join(degrees_.toDF("at", "entries"), "at")
    near = near.groupBy("at", F.pmod(F.xxhash64("id"), 1 + F.floor(F.col("entries") / PIECE)).alias("piece"))
    near = written(near.agg(F.collect_list(F.struct("id", "degree")).alias("ids")), "near")
    draw = Random(seed)
    every, begin, stride = count_ * (count_ - 1), draw.randrange(count_ - 1), draw.randrange(1, count_)
    while gcd(stride, count_ - 1) > 1:
        stride += 1
    total, asked, upto = None, 0, min(every, first)
    while True:
        source, turn = F.pmod("pair", F.lit(count_)), F.floor(F.col("pair") / count_)
        target = F.pmod(source + 1 + F.pmod(turn * stride + begin, F.lit(count_ - 1)), F.lit(count_))
        pairs = spark.range(asked, upto).toDF("pair").select("pair", source.alias("s"), target.alias("t"))
        scratch = Scratch(spark, kept=1 << 30)  # all levels are asked again
        sums = _pair_shares(ends, near, degrees_, pairs, scratch)
        if total is not None:
            sums = sums.unionByName(total).groupBy("id").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        total, asked = written(sums, "shares"), upto
        for path in chain(*scratch.paths.values()):
            delete(spark, path)
        variance = F.greatest(F.lit(0.0), F.col("ss") / asked - (F.col("s") / asked) ** 2) / max(1, asked - 1) * (1 - asked / every)
        figures = total.select("id", (F.col("s") / asked).alias("mean"), (z * F.sqrt(variance)).alias("half"))
        worst = figures.orderBy(F.desc("mean"), "id").limit(top).agg(F.max(F.col("half") / F.col("mean"))).first()[0]
        if asked == every or (asked >= count_ if worst is None else worst <= error):
            break
        # Half-widths fall with the root of the pairs.
        need = 2 * asked if worst is None else 1.1 * asked * (worst / error) ** 2 if error else inf
        upto = int(min(every, max(2 * asked, need)))
    missing = F.lit(0.0) if asked == every else F.lit(None).cast("double")
    found = order.join(figures, "id", "left").select("node", (F.coalesce("mean", F.lit(0.0)) * scale).alias("betweenness"), F.coalesce(F.col("half") * scale, missing).alias("error"))
    return found, min(asked, count_)


def cycle_rank(edges: DataFrame) -> DataFrame:
    """GA-7. One row: nodes, edges, components, rank (V - C) and independent cycles (E - V + C)."""
    simple = edges.where("src <> dst").select("src", "dst").distinct()
    parts = connected_components(edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    return parts.join(simple.agg(F.count(F.lit(1)).alias("n_edges")), F.lit(True)).select(  # one row each
        "n_nodes", "n_edges", "n_components", (F.col("n_nodes") - F.col("n_components")).alias("rank"), (F.col("n_edges") - F.col("n_nodes") + F.col("n_components")).alias("cycles")
    )


def community_gaps(edges: DataFrame, members: DataFrame, most: float = 0.2) -> DataFrame:
    """GA-8. Pairs of communities with a density of crossing edges above 0 and below ``most``."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    crossing = _inside(edges, members).where("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.sum("links").alias("links"))
    a, b = size.toDF("ca", "size_a"), size.toDF("cb", "size_b")
    return crossing.join(a, "ca").join(b, "cb").withColumn("density", F.col("links") / (F.col("size_a") * F.col("size_b"))).where((F.col("density") > 0) & (F.col("density") < most))


def gap_modularity_delta(edges: DataFrame, members: DataFrame, gaps: DataFrame) -> DataFrame:
    """GA-9. clamp(intra / (intra + inter) - 0.5, 0.01, 1); the ratio is 1 without intra edges."""
    intra = _inside(edges, members).where("ca = cb").groupBy("ca").agg(F.sum("links").alias("n"))
    a, b = intra.toDF("ca", "intra_a"), intra.toDF("cb", "intra_b")
    both = gaps.join(a, "ca", "left").join(b, "cb", "left").withColumn("intra", F.coalesce("intra_a", F.lit(0)) + F.coalesce("intra_b", F.lit(0)))
    ratio = F.when(F.col("intra") == 0, 1.0).otherwise(F.col("intra") / (F.col("intra") + F.col("links")))
    return both.select("ca", "cb", F.greatest(F.lit(0.01), F.least(F.lit(1.0), ratio - 0.5)).alias("delta"))


#: Sources whose marks share one number.
MARKS = 62


def _reached(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(``source``, ``community``, ``hops``, ``n``): how many nodes (node, community) lie at each
    distance from each source, one round a hop until no node is new.

    MARKS sources share a number a node, of which each has a bit, so that a round sends one row an
    edge however many they are, and what is known of a node is one row a block of sources. Nodes are
    numbered first; the edges lie dealt by their beginning for all rounds.
    """
    scratch = Scratch(edges.sparkSession)
    every = both_ways(edges).select("node").union(nodes.select("node")).distinct().join(nodes.select("node", "community"), "node", "left")
    ids = written(every.select("node", "community", F.monotonically_increasing_id().alias("id")), "ids")
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    ends = written(edges.select("src", "dst").join(a, "src").join(b, "dst").select("a", "b"), "ends")
    near = ends.union(ends.select("b", "a")).toDF("at", "id").repartition("at").persist()
    order = written(bucketed_row_number(sources.select("source"), [], F.pmod(F.xxhash64("source"), F.lit(64)), ["source"], "place"), "sources")
    block, bit = F.floor(F.col("place") / MARKS).alias("block"), F.pmod("place", F.lit(MARKS)).cast("int")
    begin = order.join(ids, F.col("source") == F.col("node")).select("id", block, F.expr(f"shiftleft(1L, cast(place % {MARKS} as int))").alias("mark"))
    begin = begin.groupBy("block", "id").agg(F.bit_or("mark").alias("new"))
    state, found = scratch.keep(begin.select("block", "id", F.col("new").alias("seen"), "new"), "marks"), None
    bits = F.filter(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.getbit("new", i) == 1)
    try:
        for hop in count(1):
            step = state.where("new <> 0").select("block", F.col("id").alias("at"), "new").join(near, "at").groupBy("block", "id").agg(F.bit_or("new").alias("got"))
            both = state.select("block", "id", "seen", F.lit(0).cast("long").alias("got")).unionByName(step.select("block", "id", F.lit(0).cast("long").alias("seen"), "got"))
            both = both.groupBy("block", "id").agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"))
            state = scratch.keep(both.select("block", "id", (F.expr("seen | got")).alias("seen"), F.expr("got & ~seen").alias("new")), "marks")
            fresh = state.where("new <> 0").join(ids.select("id", "community"), "id").select("block", "community", F.explode(bits).alias("bit"))
            counted = written(fresh.groupBy("block", "bit", "community").agg(F.count(F.lit(1)).alias("n")).withColumn("hops", F.lit(hop)), "counted")
            if counted.isEmpty():
                break
            found = counted if found is None else found.unionByName(counted)
            if hop % LEVELS == 0:
                found = written(found, "found")
    finally:
        near.unpersist()
    found = counted if found is None else found
    return found.join(order.select("source", block, bit.alias("bit")), ["block", "bit"]).select("source", "community", "hops", "n")


def gap_path_length(edges: DataFrame, members: DataFrame, gaps: DataFrame, sample: int = 3) -> DataFrame:
    """GA-10. Mean hops from the first ``sample`` members of one side to all reachable members of
    the other; null if none is reachable."""
    first = written(members.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("rn") <= sample), "first")
    reached = _reached(edges, members, first.select(F.col("node").alias("source")))
    from_a = first.select(F.col("community").alias("ca"), F.col("node").alias("source"))
    to_b = reached.withColumnRenamed("community", "cb")
    hops = gaps.select("ca", "cb").join(from_a, "ca").join(to_b, ["cb", "source"]).groupBy("ca", "cb").agg((F.sum(F.col("hops") * F.col("n")) / F.sum("n")).alias("path_length"))
    return gaps.select("ca", "cb").join(hops, ["ca", "cb"], "left")


def gap_bridge_nodes(edges: DataFrame, members: DataFrame, gaps: DataFrame, share: float = 0.3) -> DataFrame:
    """GA-11. Of the ends of crossing edges the best max(2, floor(share n)) by score."""
    crossing = _inside(edges, members).where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    pair = Window.partitionBy("ca", "cb")
    ranked = crossing.join(gaps.select("ca", "cb"), ["ca", "cb"], "left_semi").join(members.select("node", "score"), "node").withColumn("rn", F.row_number().over(pair.orderBy(F.desc("score"), "node"))).withColumn("n", F.count(F.lit(1)).over(pair))
    return ranked.where(F.col("rn") <= F.greatest(F.lit(2), F.floor(F.col("n") * share))).select("ca", "cb", "rn", "node")


def gap_lookup(gaps: DataFrame, a, b) -> DataFrame:
    """GA-12. One pair, in either order."""
    return gaps.where((F.col("ca") == F.least(F.lit(a), F.lit(b))) & (F.col("cb") == F.greatest(F.lit(a), F.lit(b))))


def nearest_gap(gaps: DataFrame) -> DataFrame:
    """GA-12. The gap of the lowest density."""
    return gaps.orderBy("density", "ca", "cb").limit(1)


def community_summary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """GA-13. Label (the top three by 10 score + tfidf), size, internal weight, mean tfidf, top score."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.col("score") * 10 + F.col("tfidf")), "node"))
    top = members.withColumn("rn", rank).groupBy("community").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "node")))), lambda x: x["node"]), " · ").alias("label"),
        F.count(F.lit(1)).alias("size"), F.avg("tfidf").alias("mean_tfidf"), F.max("score").alias("max_score"),
    )
    inner = _inside(edges, members).where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("internal_weight"))
    return top.join(inner, "community", "left").withColumn("internal_weight", F.coalesce("internal_weight", F.lit(0)))


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """GA-14. Crossing edges of each pair: number, total and mean weight."""
    crossing = _inside(edges, members).where("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    return crossing.agg(F.sum("links").alias("links"), F.sum("weight").alias("total"), (F.sum("weight") / F.sum("links")).alias("mean"))


def representatives(members: DataFrame, n: int = 3) -> DataFrame:
    """GA-15. The top n members of each community by score."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "node"))
    return members.withColumn("rn", rank).where(F.col("rn") <= n).select("community", "rn", "node")


def community_distance(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """GA-16. |mean tfidf a - mean tfidf b| over the larger (at least 0.001), at most 1; where both
    are 0 the same of the scores."""
    mean = members.groupBy("community").agg(F.avg("tfidf").alias("t"), F.avg("score").alias("s"))
    both = pairs.select("ca", "cb").join(mean.toDF("ca", "ta", "sa"), "ca").join(mean.toDF("cb", "tb", "sb"), "cb")
    apart = lambda x, y: F.least(F.lit(1.0), F.abs(F.col(x) - F.col(y)) / F.greatest(F.col(x), F.col(y), F.lit(0.001)))
    return both.select("ca", "cb", F.when((F.col("ta") == 0) & (F.col("tb") == 0), apart("sa", "sb")).otherwise(apart("ta", "tb")).alias("distance"))


#: Templates of questions that join two communities. Ours.
TEMPLATES = ["How does %s bear on %s?", "What would link %s with %s?", "Which case shows %s and %s together?"]


def bridging_questions(members: DataFrame, gaps: DataFrame, close: float = 0.05, most: int = 3) -> DataFrame:
    """GA-17. The i-th representatives of both sides in the i-th template; pairs closer than
    ``close`` are to be reinforced, others bridged."""
    reps = representatives(members, most)
    a, b = reps.toDF("ca", "rn", "node_a"), reps.toDF("cb", "rn", "node_b")
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        text = F.when(F.col("rn") == i + 1, F.format_string(t, "node_a", "node_b")).otherwise(text)
    action = F.when(F.col("distance") < close, "reinforce").otherwise("bridge")
    return gaps.select("ca", "cb").join(community_distance(members, gaps), ["ca", "cb"]).join(a, "ca").join(b, ["cb", "rn"]).select("ca", "cb", "rn", text.alias("question"), action.alias("action"))


def question_context(questions: DataFrame, near: DataFrame, most: int = 2) -> DataFrame:
    """GA-18. (question, entries, status): the best ``most`` entries of each question, from a batch
    search (query_id, rank, entry); ``graph-only`` where none is near enough."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "entry"))), 1, most)
    found = near.groupBy("query_id").agg(F.array_join(F.transform(best, lambda x: x["entry"].cast("string")), ",").alias("entries"))
    both = questions.join(found, F.col("question") == F.col("query_id"), "left")
    return both.select("question", F.coalesce("entries", F.lit("")).alias("entries"), F.when(F.col("entries").isNull(), "graph-only").otherwise("context-supported").alias("status"))


def gap_proposals(gaps: DataFrame) -> DataFrame:
    """GA-19. A record to propose, not to apply, for each gap."""
    return gaps.select(F.concat_ws(":", F.lit("gap"), "ca", "cb").alias("id"), F.format_string("What connects %s and %s?", F.col("ca").cast("string"), F.col("cb").cast("string")).alias("question"), F.lit("gap").alias("origin"), F.lit(False).alias("applied"))


def anomaly_census(links: DataFrame, deltas: DataFrame, cycles: DataFrame, verdicts: DataFrame, most: int = 6) -> DataFrame:
    """GA-20. Pairs with twice the mean number of links (of at least two pairs), gaps with a
    positive delta, cycles, and conflict verdicts; the best ``most`` by priority, then id."""
    usual = links.agg(F.avg("links").alias("usual"), F.count(F.lit(1)).alias("pairs"))
    heavy = links.join(usual, F.lit(True)).where("pairs >= 2 and links >= 2 * usual").select(F.concat_ws(":", F.lit("links"), "ca", "cb").alias("id"), (F.col("links") / F.col("usual")).alias("priority"))
    gaps = deltas.where("delta > 0").select(F.concat_ws(":", F.lit("gap"), "ca", "cb").alias("id"), F.col("delta").alias("priority"))
    holes = cycles.where("cycles > 0").select(F.lit("cycles").alias("id"), (10.0 + F.col("cycles")).alias("priority"))
    conflict = verdicts.where("conflict").select(F.concat_ws(":", F.lit("verdict"), "verdict").alias("id"), F.lit(100.0).alias("priority"))
    return heavy.union(gaps).union(holes).union(conflict).orderBy(F.desc("priority"), "id").limit(most)


def reachable_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """GA-21. (start, node): all that depends on a node over directed edges src -> dst, however far;
    the start itself appears only if it lies on a cycle.

    From a node with one way on, all that follows up to the next fork is taken at once: the ways
    of 1, 2, 4, ... such steps are tables made by joining each to itself, and a set of nodes with
    its ways of any length is one join a table. So the rounds grow with the forks on a path and
    with the logarithm of the stretches between them. Cycles end the doubling at their length.
    """
    edges = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "directed")
    ways = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    forks = written(edges.join(ways.where("n > 1").select("src"), "src", "left_semi"), "forks")
    jumps = [written(ways.where("n = 1").select("src", "dst"), "jump")]
    most = jumps[0].count()
    while 1 << len(jumps) <= most:
        last = jumps[-1]
        twice = written(last.join(last.toDF("dst", "then"), "dst").select("src", F.col("then").alias("dst")), "jump")
        if twice.isEmpty():
            break
        jumps.append(twice)

    def on(found: DataFrame) -> DataFrame:
        for jump in reversed(jumps):
            found = written(found.union(found.join(jump, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))).distinct(), "on")
        return found

    first = start.select("start", F.col("start").alias("at")).join(edges, F.col("at") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
    seen = frontier = on(written(first, "first"))
    for turn in count(1):
        step = frontier.join(forks, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        step = written(step.join(seen, ["start", "node"], "left_anti"), "step")
        if step.isEmpty():
            return seen
        frontier = written(on(step).join(seen, ["start", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        if turn % LEVELS == 0:
            seen = written(seen, "seen")

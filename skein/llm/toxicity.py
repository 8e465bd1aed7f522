"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.runtime import by_place, schema_of, written

#: n-gram lengths in characters, and hash buckets (2 to the power).
SIZES = (3, 4, 5)
BITS = 20
#: At most so many labelled rows are learnt from, those with the least hash of their id.
FIT_ROWS = 6_000
#: A clean document taken for toxic counts as so many missed toxic ones where the threshold is set.
CLEAN_WEIGHT = 3.0
#: White space that runs together to one blank.
_BLANKS = re.compile(r"[ \t-\r]+")


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text's n-grams of characters: lower-cased, runs of ASCII
    white space made one blank, a blank at either end. Null text is empty."""
    plain = _BLANKS.sub(" ", (text or "").lower()).strip(" ")
    h = chars = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(1)
        if n in SIZES:
            found.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.uint32)
    every = np.sort(np.concatenate(found))
    return every[np.r_[True, every[1:] != every[:-1]]]


@dataclass(frozen=True)
class Model:
    """One weight a bucket (ratio times fitted weight) and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text)].sum(dtype=np.float64)) + self.bias
        return 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most: int = FIT_ROWS) -> DataFrame:
    """(id, ``label``, ``trial``): labelled rows whose crc32(id as text) mod 5 is not 0, at most
    ``most`` of them; a fifth, by a hash, is for the threshold. Rows without an id or a label are
    left out."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    rows = usable.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"), (F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(5)) == 0).alias("trial"))
    return rows.orderBy(F.xxhash64("_id"), "_id", "label").limit(most)


class _Sample:
    """Presence of features in rows: the feature numbers of all rows in one array, and how many
    each row has. Rows that are not ``used`` have no weight; the classes of the others weigh alike."""

    def __init__(self, at: np.ndarray, size: np.ndarray, label: np.ndarray, scale: np.ndarray):
        self.at, self.size, self.label, self.scale = at, size, label, scale
        self.start = np.r_[0, np.cumsum(size)]
        cuts, room = [0], 0  # parts of some million entries, so that what is between stays small
        for k, n in enumerate(size.tolist()):
            room += n
            if room > 1_000_000:
                cuts.append(k + 1)
                room = 0
        self.parts = list(zip(cuts, [*cuts[1:], len(label)]))

    def margins(self, v: np.ndarray) -> np.ndarray:
        """Of each row; the last number of ``v`` is the bias."""
        own, z = v[:-1] * self.scale, np.full(len(self.label), v[-1])
        for i, j in self.parts:
            sums = np.r_[0.0, np.cumsum(own[self.at[self.start[i] : self.start[j]]])]
            z[i:j] += np.diff(sums[self.start[i : j + 1] - self.start[i]])
        return z

    def loss(self, v: np.ndarray, used: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """The balanced logistic loss of the used rows with its gradient."""
        n_pos, n = max(1.0, self.label[used].sum()), used.sum()
        weight = np.where(self.label == 1, 0.5 / n_pos, 0.5 / max(1.0, n - n_pos)) * used
        w, z = v[:-1], self.margins(v)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.label)
        g = np.zeros(len(w))
        for i, j in self.parts:
            g += np.bincount(self.at[self.start[i] : self.start[j]], weights=np.repeat(error[i:j], self.size[i:j]), minlength=len(w))
        value = (weight * (np.logaddexp(0, z) - self.label * z)).sum() + l2 / 2 * (w @ w)
        return value, np.r_[self.scale * g + l2 * w, error.sum()]


def _minimize(loss, v: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps."""
    value, g = loss(v)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, factors = g.copy(), []
        for s, y in reversed(moves):
            factors.append((s @ step) / (s @ y))
            step -= factors[-1] * y
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, np.abs(g).sum())
        for (s, y), f in zip(moves, reversed(factors)):
            step += s * (f - (y @ step) / (s @ y))
        length = 1.0
        while True:
            moved = v - length * step
            now, slope = loss(moved)
            if now <= value - 1e-4 * length * (g @ step) or length < 1e-6:
                break
            length /= 2
        if (moved - v) @ (slope - g) > 0:
            moves = [*moves[1 - kept :], (moved - v, slope - g)]
        done = value - now < 1e-5 * abs(value)
        v, value, g = moved, now, slope
        if done:
            break
    return v


def _threshold(z: np.ndarray, label: np.ndarray) -> float:
    """The margin from which on a row counts as toxic: between two rows of the trial, where most
    toxic rows are caught less CLEAN_WEIGHT times the share of clean ones; 0 without both classes."""
    if not 0 < label.sum() < len(label):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, label = z[order], label[order]
    gain = np.cumsum(label) / label.sum() - CLEAN_WEIGHT * np.cumsum(1 - label) / (1 - label).sum()
    gain[:-1][z[:-1] == z[1:]] = -np.inf  # no cut between equals
    k = int(np.argmax(gain))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rounds: int = 30, l2: float = 0.01) -> Model:
    """Learn from a bounded sample of the labelled rows, and nothing from the rest.

    Document counts of each n-gram in either class are summed in Spark and give the log-count
    ratios (add-one smoothed; buckets seen in fewer than 3 rows have none). A logistic regression
    on presence times ratio, with both classes of equal weight, is fitted on the driver over all
    buckets with a ratio: at most FIT_ROWS rows, of the feature numbers of which it holds one copy.
    A fifth of the rows is held back first to set the threshold, which the bias then takes in.
    Without rows of both classes every score is the share of the one class, or 0 without rows.
    """
    sample = training_rows(labels, id_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = written(rows.join(F.broadcast(sample), F.col("id") == F.col("_id")).select("label", "trial", "text"), "training")

    def count(batches):
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                n[label][features(text)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "neg": pa.array(n[0][at]), "pos": pa.array(n[1][at])})

    seen = train.mapInArrow(count, "bucket int, neg int, pos int").groupBy("bucket").agg(F.sum("neg").cast("int").alias("neg"), F.sum("pos").cast("int").alias("pos"))
    found = seen.where("neg + pos >= 3").toPandas()  # at most a row a bucket
    by_label = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_neg, n_pos = by_label.get(0, 0), by_label.get(1, 0)
    if not n_neg or not n_pos:
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if n_pos else -40.0)
    buckets, pos, neg = (found[c].to_numpy() for c in ("bucket", "pos", "neg"))
    scale = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    held = docs.sparkSession.sparkContext.broadcast(place)  # 4 bytes a bucket

    def sparse(batches):
        for batch in batches:
            at = [held.value[features(t)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a[a >= 0].tobytes() for a in at], pa.binary())], names=["label", "trial", "at"])

    table = written(train.mapInArrow(sparse, "label int, trial boolean, at binary"), "features")
    room = table.agg(F.sum(F.octet_length("at")), F.count(F.lit(1))).first()
    at, size = np.empty(room[0] // 4, np.int32), np.empty(room[1], np.int64)
    label, trial, end = np.empty(room[1]), np.empty(room[1], bool), 0
    for k, r in enumerate(table.toLocalIterator()):  # a part of the bounded sample at a time
        label[k], trial[k], size[k] = r["label"], r["trial"], len(r["at"]) // 4
        at[end : end + size[k]] = np.frombuffer(r["at"], np.int32)
        end += int(size[k])
    rows_of, v, cut = _Sample(at, size, label, scale), np.zeros(len(scale) + 1), 0.0
    if 0 < label[~trial].sum() < (~trial).sum() and trial.any():
        v = _minimize(lambda x: rows_of.loss(x, ~trial, l2), v, rounds)
        cut = _threshold(rows_of.margins(v)[trial], label[trial])
    v = _minimize(lambda x: rows_of.loss(x, np.ones(len(label), bool), l2), v, rounds)
    weights = np.zeros(1 << BITS, np.float32)
    weights[buckets] = v[:-1] * scale
    return Model(weights, float(v[-1]) - cut)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` double (0 to 1) and ``predicted`` int (1 from 0.5 on), from the
    whole text alone. Null or empty text is scored by the bias. Columns of these names are
    replaced; repeated rows score alike; an empty table gives an empty table."""
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        for batch in batches:
            scores = [held.value.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return by_place(docs).mapInArrow(run, schema_of(docs.schema.fields, "score double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""HyperMinHash, whitening and importance resampling against plain Python, with their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import brute
from skein.llm import hyperminhash, importance, queries, whitening

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=2):
    w = (text or "").translate(brute.LOWER).encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_sets(docs, percent=80):
    """{id: (size, smallest id reachable)} for unique ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_near_sets_of_every_size(spark):
    r = random.Random(5)
    docs = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "two one", "\xa0one two", "one two one two"]
    for size in (3, 5, 6, 10, 25, 60, 130, 300, 2000):
        base = [f"v{r.randrange(300)}x{size}" for _ in range(size)]
        docs += [edited(r, base, n) for n in (0, 0, 1, 1, 2, max(1, size // 25), size // 18, size // 10, size // 4)]
    docs = list(enumerate(docs))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in near_sets(docs).items()}


def test_near_sets_of_a_dense_group(spark, monkeypatch):
    """Hundreds of copies about the threshold, which no round joins all; large buckets in parts."""
    monkeypatch.setattr(hyperminhash, "PART_SETS", 60)
    r = random.Random(6)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    docs = list(enumerate(edited(r, base, r.randrange(3, 9)) for _ in range(260)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = near_sets(docs)
    assert got == want and 5 < len(set(c for _, c in want.values())) < 250


def test_near_sets_with_odd_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "other text"), (None, "a b c d"), (None, "lonely words"), (3, "A B C D"), (None, None), (4, None)]
    odd = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id int, text string, `n` int, `a.b` int")
    got = sorted(map(str, (tuple(x) for x in hyperminhash.near_duplicates(odd).collect())))
    assert got == sorted(map(str, [(7, 3, 3, False)] * 2 + [(7, 1, 7, True), (None, 3, 3, False), (None, 1, None, True), (3, 3, 3, True), (None, 0, None, True), (4, 0, 4, True)]))
    assert hyperminhash.near_duplicates(odd.where("false")).count() == 0


def test_estimate_is_close():
    r = np.random.default_rng(1)
    for n in (4, 40, 400, 4000):
        errors = []
        for _ in range(60):
            u = r.integers(0, 2**63, int(n * 1.25), dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(u[:n]), np.unique(u[-n:])
            same = (hyperminhash.registers(a) == hyperminhash.registers(b)).sum()
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(hyperminhash.jaccard_estimate(same, np.float64(n), np.float64(n)) - j)
        assert abs(np.mean(errors)) < 0.025
    assert 0.5 < hyperminhash.least_estimate(0.8) < 0.6


def test_near_sets_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.op11_hyperminhash_near_dedup(spark, SF).collect()}
    assert got == near_sets(docs)


def whitened(vectors, most=16):
    """{id: (deviation, whitened, explained)} of finite vectors, by integers and numpy."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors}
    fitted = np.array(sorted(set(map(tuple, x.values()))), object)
    n, s = len(fitted), fitted.sum(axis=0)
    centred = fitted * n - s
    v = ((centred.T @ centred) / n**3).astype(float)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    out = {}
    for i, row in x.items():
        d = np.array(row, object) * n - s
        out[i] = (int((d * d).sum()), (d / n).astype(float) @ w / np.sqrt(e), e / np.trace(v))
    return n, out


def test_whitening_whole_table(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    n, want = whitened([(r["vec_id"], r["embedding"]) for r in rows])
    got = {}
    for r in queries.op12_embedding_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = None
    for i, (deviation, w, explained) in want.items():
        assert sorted(got[i]) == list(range(1, 17))
        mine = np.array([got[i][k].whitened for k in range(1, 17)])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine, signs * w, rtol=1e-8, atol=1e-8)
        assert all(r.n == n and r.deviation == deviation and r.identity_error < 1e-9 for r in got[i].values())
        assert np.allclose([got[i][k].explained for k in range(1, 17)], explained, rtol=1e-9)


def test_whitening_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (2, [1.0, 0.0, -1.5]), (None, [3.0, 3.0, 1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, [5.0, 2.0, -9.0])]
    odd = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id int, embedding array<double>, `a.b` int")
    got = whitening.whiten(odd).collect()
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["1", "1", "2", "7", "None"]
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2, 3}  # four vectors span three dimensions
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(flat).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(odd.where("false")).count() == 0 and whitening.whiten(odd.where("vec_id = 3")).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_large_entries_are_exact():
    y = np.array([[2**40, -(2**39)], [3, 2**40 + 1]], np.int64)
    assert whitening.squares(y) == [2**80 + 9, 2**78 + (2**40 + 1) ** 2, (2**40 - 2**39) ** 2 + (2**40 + 4) ** 2]
    r = np.random.default_rng(0).integers(-300, 300, (10_000, 5))
    want = [int((r[:, i] ** 2).sum()) for i in range(5)] + [int(((r[:, i] + r[:, j]) ** 2).sum()) for i in range(5) for j in range(i + 1, 5)]
    assert whitening.squares(r) == want
    model = whitening.Whitening(10**9, [10**15 + 7], [10**6], np.ones((1, 1)), np.ones(1), np.ones(1))
    assert model.deviation(np.array([[10**6 + 2]])).tolist() == [(2 * 10**9 - 7) ** 2]


def words_of(text):
    out, word = [], bytearray()
    for b in (text or "").translate(brute.LOWER).encode() + b" ":
        if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


def buckets_of(text, most, buckets):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def drawn(docs, target, most=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, most, buckets))
    for text in target:
        t.update(buckets_of(text, most, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows, open_ = {}, []
    for i, text in docs:
        found = buckets_of(text, most, buckets)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(found), weight, score, None]
        if len(words_of(text)) >= min_words:
            open_.append((-score, i))
    for k, (_, i) in enumerate(sorted(open_)[: len(open_) * percent // 100]):
        rows[i][3] = k + 1
    return {i: tuple(r) for i, r in rows.items()}


@pytest.mark.parametrize("most", [1, 2, 4])
def test_resampling(spark, monkeypatch, most):
    monkeypatch.setattr(importance, "RANGE", 40)
    r = random.Random(most)
    odd = ["", None, "\x01 \x01", "a-b_C", "é É ß 漢字", "x" * 200 + " y " + "z" * 65 + " " + "w" * 64, "\x00a\x7fb\x80c", "0 9 A Z a z @ [ ` {", "İ ΣΑΣ"]
    docs = [*odd, *(" ".join(r.choice(["alpha", "Beta", "gamma", "δ", "x" * 70, "1"]) for _ in range(r.randrange(60))) for _ in range(300))]
    docs = list(enumerate(docs))
    target = ["alpha beta", None, "alpha alpha gamma " * 10]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), most, 5000)
    assert {x.doc_id: tuple(x)[1:] for x in got.collect()} == drawn(docs, target, most, 5000)


def test_resampling_with_odd_rows(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "short")]
    odd = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id int, text string, weight int, `rank` int, `a.b` int")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(odd, none, percent=67).collect()
    assert len(got) == 5 and sorted(x.rank for x in got if x.rank) == [1, 2]  # 67 hundredths of three
    assert importance.resample(odd.where("false"), none).count() == 0
    assert importance.resample(odd.where("doc_id = 2"), none).collect()[0].rank is None


def test_dictionary_starts_anew():
    known = importance.Dictionary(most=30)
    for k in range(60):
        words = [f"w{k}".encode(), b"same", f"v{k % 7}".encode()]
        crc, length, count = known.scan([b" ".join(words), None, b"Same"])
        assert crc.tolist() == [zlib.crc32(w) for w in words] + [zlib.crc32(b"same")] and length.tolist() == [*map(len, words), 4] and count.tolist() == [3, 0, 1]
        assert known.size <= 40

"""The packing search against exhaustive search and packings known to be perfect."""

import itertools
import random

import pytest

from skein.llm import packing


def cut(r, bins, capacity, least, most):
    """Counts of lengths that fill ``bins`` sequences without waste."""
    counts = {}
    for _ in range(bins):
        room = capacity
        while room:
            s = r.randint(least, most)
            s = room if room - s < least else s
            counts[s] = counts.get(s, 0) + 1
            room -= s
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_sequences_of_more_than_nine_pieces(seed):
    r = random.Random(seed)
    bins = r.randint(3, 6)
    counts = cut(r, bins, 2048, 150, 205)
    assert sum(n for _, n in packing.best_fit(counts, 2048)) == bins + 1
    assert sum(n for _, n in packing.bin_completion(counts, 2048)) == bins


@pytest.mark.parametrize("seed", range(60))
def test_as_few_as_exhaustive_search(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 37])
    counts = cut(r, r.randint(2, 3), capacity - r.choice([0, 1]), max(1, capacity // 6), capacity * 2 // 3)
    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)

    def fits(i, rooms):
        return i == len(items) or any(fits(i + 1, (*rooms[:j], room - items[i], *rooms[j + 1 :])) for j, room in enumerate(rooms) if room >= items[i] and room not in rooms[:j])

    fewest = next(n for n in itertools.count(1) if fits(0, (capacity,) * n))
    assert sum(n for _, n in packing.bin_completion(counts, capacity)) == fewest


@pytest.mark.parametrize("seed", range(30))
def test_fillings_are_all_those_undominated(seed):
    r = random.Random(seed)
    capacity = 24
    counts = {s: r.randint(1, 3) for s in r.sample(range(2, 15), 6)}
    top = max(counts)
    rest = {s: n - (s == top) for s, n in counts.items()}
    want = set()
    for each in itertools.product(*[range(n + 1) for n in rest.values()]):
        chosen = [s for s, k in zip(rest, each) for _ in range(k)]
        unused = capacity - top - sum(chosen)
        if unused < 0:
            continue
        spare = [s for s, k in zip(rest, each) if k < rest[s]]
        parts = [(sum(c), n) for n in range(len(chosen) + 1) for c in itertools.combinations(chosen, n)]
        if not any(total < x <= total + unused or (total == x and n > 1) for x in spare for total, n in parts):
            want.add(tuple(sorted([top, *chosen], reverse=True)))
    got = [tuple(s for s, k in f for _ in range(k)) for f in packing.fillings(top, counts, capacity, capacity)]
    assert len(got) == len(set(got)) and set(got) == want
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_best_fit_size_is_that_of_its_plan():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([10, 60, 2048])
        counts = {s: r.randint(1, 20) for s in r.sample(range(1, capacity + 1), r.randint(1, 10))}
        assert packing.best_fit_size(counts, capacity) == sum(n for _, n in packing.best_fit(counts, capacity))


@pytest.mark.parametrize("seed", range(40))
def test_the_lower_bound_is_one(seed):
    """Never above the fewest, and above the volume where long pieces leave room that nothing fits."""
    r = random.Random(seed)
    capacity = 20
    counts = {s: r.randint(1, 2) for s in r.sample(range(3, 20), 5)}
    found = sum(n for _, n in packing.bin_completion(counts, capacity, None))
    assert -(-sum(s * n for s, n in counts.items()) // capacity) <= packing.least_sequences(counts, capacity) <= found
    assert packing.least_sequences({19: 40, 5: 4}, capacity) == 41


def test_few_branches_end_the_search():
    """Many pieces, so that there is no end by itself: what is found holds all and is no worse."""
    r = random.Random(4)
    counts = {}
    for _ in range(3000):
        s = min(2048, int(r.lognormvariate(6.3, 0.9)) + 1)
        counts[s] = counts.get(s, 0) + 1
    plan = packing.bin_completion(counts, 2048, 500)
    used = {}
    for filling, n in plan:
        assert sum(s * k for s, k in filling) <= 2048
        for s, k in filling:
            used[s] = used.get(s, 0) + n * k
    assert used == counts and packing.least_sequences(counts, 2048) <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 2048))

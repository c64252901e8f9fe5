"""MinHash near-duplicates against brute force; pruning against the posterior."""

import random

import numpy as np
import pytest

from atalaia.llm import deals, minhash, shingling


def grams(text):
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_force(rows):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(rows)]


def texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "Ab", "aB"]
    out = ["", None, " \t\n", "one two", "ONE  two", "one two three", "É x", "é x", "\xa0"]
    for n in (8, 20, 60, 200, 700):
        for _ in range(3):
            base = [r.choice(words) for _ in range(n)]
            out.append(" ".join(base))
            for share in (0.004, 0.01, 0.015, 0.02, 0.03):
                copy = [r.choice(words) if r.random() < share else w for w in base]
                out.append("\n".join(copy[r.randrange(3) :]).upper() if r.random() < 0.3 else " ".join(copy[r.randrange(3) :]))
    base = [r.choice(words) for _ in range(100)]
    out += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 100, 2)]
    passage = " ".join(r.choice(words) for _ in range(60))
    return out + [f"{passage} {' '.join(r.choice(words) for _ in range(20))}" for _ in range(20)]


@pytest.mark.parametrize("small, most", ((16, 4096), (2, 6)))
def test_equals_brute_force(spark, monkeypatch, small, most):
    monkeypatch.setattr(deals, "SMALL", small)
    monkeypatch.setattr(deals, "MOST", most)  # large deals are cut into parts
    rows = [(None if i % 17 == 3 else 500 - i, t) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (7, rows[25][1]), (7, rows[30][1]), (None, "never seen before at all"), (None, "never seen before at all")]
    df = spark.createDataFrame([(*x, "k", 5, 1) for x in rows], "doc_id long, text string, key string, n int, label int").repartition(3)
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda x: str(tuple(x))
    want = by_force(rows)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(want, key=key)
    assert sum(d != c for d, _, c, _ in want) > 60
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_pruned_pairs_are_improbable():
    """After each batch the floor is the least count whose posterior reaches the miss probability, and pairs at the least likeness get by."""
    sift = minhash.Bayes()
    least = 0.85 + 0.15 / 256
    for (_, n), floor in zip(sift.batches, sift.floors, strict=True):
        x = np.linspace(least, 1, 20_001)[1:]
        grid = np.linspace(0, 1, 200_001)[1:-1]
        for m, over in ((floor, True), (floor - 1, False)):
            density = lambda p, m=m: np.exp(m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-15)))
            share = density(x).sum() * (x[1] - x[0]) / (density(grid).sum() * (grid[1] - grid[0]))
            assert (share >= minhash.MISS * 0.98) == over
    r = np.random.default_rng(2)
    n, met, near = 0, 0, 0
    for k in range(300):
        both = r.integers(0, 2**63, 850, dtype=np.uint64)
        a, b = (np.unique(np.r_[both, r.integers(0, 2**63, 75, dtype=np.uint64)]) for _ in "ab")
        x, y = (shingling.signature(v, minhash.ROWS * minhash.BANDS) for v in (a, b))
        n += sift.pairs([x], [y], np.array([1850]))[0]
        u, v = shingling.bands([x, y], minhash.ROWS)
        met += bool((u == v).any())
        near += (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() / 300
    assert n == met == 300 and abs(near - least) < 0.004
    far = shingling.signature(r.integers(0, 2**63, 900, dtype=np.uint64), minhash.ROWS * minhash.BANDS)
    assert not sift.pairs([far], [x], np.array([1800]))[0]

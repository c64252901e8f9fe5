"""Greedy string tiling and patience alignment against brute force."""

import random
from itertools import combinations

import numpy as np

from atalaia.llm import patience, tiling
from atalaia.llm.seeds import plain_words


def greedy_tiles(item, doc, least):
    free, out = (np.ones(len(item), bool), np.ones(len(doc), bool)), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free[0][i + n] and free[1][j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free[0][i : i + n] = free[1][j : j + n] = False
        out.append((i, j, n))


def test_tiles_are_greedy():
    r = random.Random(1)
    for _ in range(150):
        a = [r.randrange(r.choice((3, 30))) for _ in range(r.randrange(40))]
        b = [r.randrange(30) for _ in range(r.randrange(30))]
        for _ in range(r.randrange(5)):
            i = r.randrange(len(a) + 1)
            b += a[i : i + r.randrange(25)] + [r.randrange(30)]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for least in (1, 3, 5):
            assert sorted(tiling.tiles(x, y, least)) == sorted(greedy_tiles(x, y, least))


def test_contamination(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 50)))) for i in range(12)] + [(50, "w1 w2"), (53, "w7 Xx w8 w9"), (54, "notthere"), (51, None), (52, ""), (None, " ".join(words[::-1][:30]))]
    items += [items[0], (12, items[1][1].upper() + "!")]
    docs = [(0, ""), (1, None), (None, items[2][1]), (3, items[3][1]), (3, items[3][1])]
    for d in range(4, 60):
        text = [r.choice(words) for _ in range(r.randrange(80))]
        item = (r.choice(items)[1] or "").split()
        if item and r.random() < 0.7:
            c = r.randrange(len(item))
            text[3:3] = item[c:] + ["Xx,"] + item[:c]  # reordered
        docs.append((d, " ".join(text)))
    docs.append((99, "word " * 20_000 + items[5][1]))
    df = spark.createDataFrame([(i, t, "r", 0.1) for i, t in docs], "doc_id long, text string, rest string, coverage double")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")

    def force(text):
        doc, best, n = plain_words(text or ""), (0.0, None), 0
        known = sorted({i for i in items}, key=lambda x: (x[0] is None, x[0] or 0))
        for i, t in known:
            item = plain_words(t or "")
            if item:
                share = sum(x[2] for x in greedy_tiles(item, doc, min(5, len(item)))) / len(item)
                n += share >= 0.6
                if share > best[0]:
                    best = (share, i)
        return best[1], round(best[0], 9), n, int(n > 0)

    memo = {t: force(t) for _, t in docs if t is None or len(t) < 50_000}
    for most in (500_000, 0):
        monkeypatch.setattr(tiling, "MOST_WORDS", most)
        got = tiling.contamination(df, bench).collect()
        assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in docs)
        for x in got:
            assert x.rest.rest == "r"
            if x.rest.text in memo:
                assert (x.item_id, round(x.coverage, 9), x.n_items, x.contaminated) == memo[x.rest.text]
            else:
                assert x.contaminated == 1 and x.item_id == 5
        assert sum(x.contaminated for x in got) > 20
        assert tiling.contamination(df.limit(0), bench).collect() == []
        assert {x.contaminated for x in tiling.contamination(df, bench.limit(0)).collect()} == {0}


def test_rising():
    r = random.Random(3)
    for _ in range(200):
        v = r.sample(range(50), r.randrange(9))
        got = patience.rising(v)
        best = max((n for n in range(len(v) + 1) if any(list(c) == sorted(set(c)) for c in combinations(v, n))), default=0)
        assert len(got) == best and [v[i] for i in got] == sorted({v[i] for i in got}) and got == sorted(got)


def patience_by_force(a, b):
    """The same alignment by recursion over slices and an exhaustive longest increasing subsequence."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + patience_by_force(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + patience_by_force(a[:-1], b[:-1])
    both = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not both:
        return 0
    rising = [c for n in range(len(both), 0, -1) for c in combinations(both, n) if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))]
    longest = [c for c in rising if len(c) == len(rising[0])]
    own = [both[i] for i in patience.rising([j for _, j in both])]
    assert tuple(own) in longest  # of several that are longest any will do, but the recursion must know which
    kept = own
    cuts = [(-1, -1), *kept, (len(a), len(b))]
    return len(kept) + sum(patience_by_force(a[i + 1 : x], b[j + 1 : y]) for (i, j), (x, y) in zip(cuts, cuts[1:], strict=False))


def test_align():
    r = random.Random(4)
    for _ in range(400):
        a = [r.randrange(r.choice((4, 25))) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() < 0.8]
        b[len(b) // 2 : len(b) // 2] = [r.randrange(25) for _ in range(r.randrange(4))]
        pairs = patience.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == patience_by_force(a, b)


def test_scan(spark):
    t = patience.TEMPLATES
    filler = "some words of prose that go on, "
    rows = [
        (1, filler * 50 + t["MIT"] + filler * 50, "MIT"),
        (2, filler + t["Apache-2.0"].replace("compliance", "full compliance") + filler, "Apache-2.0"),
        (3, t["MIT-notice"] * 30, "MIT-notice"),
        (4, t["MIT-notice"].upper(), "MIT-notice"),
        (5, filler * 3000 + "x\n" + t["GPL-3.0-notice"], "GPL-3.0-notice"),
        (6, filler * 10, None),
        (7, "", None),
        (8, None, None),
        (None, t["CC-BY-NC-4.0-notice"], "CC-BY-NC-4.0-notice"),
        (9, " ".join(t["ISC"].split()[:60]), None),
        (9, " ".join(w for i, w in enumerate(t["ISC"].split()) if i % 12 != 5), "ISC"),
        (10, "the software is provided to you; any damages or other", None),
    ]
    df = spark.createDataFrame([(i, x, 1) for i, x, _ in rows], "doc_id long, text string, license int")
    got = patience.scan(df).collect()
    assert [(r.doc_id, r.license) for r in got] == [(i, w) for i, _, w in rows]
    for r, (_, text, want) in zip(got, rows, strict=True):
        if want:
            assert r.coverage >= 0.8 and r.n_licenses >= 1
            assert plain_words(t[want])[0] == plain_words(text)[r.first_word] and r.end_word <= len(plain_words(text))
    assert patience.scan(df.limit(0)).collect() == []

"""Substring dedup against brute force."""

import random
from collections import Counter

import numpy as np

from atalaia.llm import suffix


def by_force(rows, window):
    split = [(t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") for _, t in rows]
    split = [[w for w in x if w] for x in split]
    least = {}
    for (d, _), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = Counter()
    for (d, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and least[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    return out


def some_rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["é", "\x85", "\xa0x"]
    passages = [[r.choice(words) for _ in range(r.randrange(30, 130))] for _ in range(6)]
    rows = []
    for d in range(90):
        parts = [r.choice(words) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(20)
            parts += p[a : a + r.choice((49, 50, 51, 200))] + [r.choice(words)]
        if r.random() < 0.3:
            parts = ["same"] * r.randrange(40, 160)
        rows.append((r.randrange(60), r.choice([" ", "\n", " \t"]).join(parts)))
    rows += rows[:5]
    rows += [(70, rows[0][1]), (None, rows[1][1]), (71, ""), (72, None), (73, " \n "), (74, "x " * 30_000), (75, "x " * 90 + "y")]
    return rows


def test_dedup(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, spans int, tie string")
    want = by_force(rows, 50)
    for most in (50_000, 300, 40, 0):  # groups by ever longer prefixes, at last all by 50 words
        monkeypatch.setattr(suffix, "GROUP_SUFFIXES", most)
        got = suffix.dedup(df).collect()
        assert Counter((x.doc_id, x.n_words, x.n_removed, x.text) for x in got) == want, most
        assert all(x.rest.spans == 1 and x.rest.doc_id == x.doc_id for x in got)
    assert suffix.dedup(df.limit(0)).collect() == []


def test_equal_windows_have_equal_prefixes():
    w, r = suffix.Words(), np.random.default_rng(1)
    a = r.integers(0, 2**64, 300, np.uint64)
    b = np.r_[r.integers(0, 2**64, 77, np.uint64), a[100:180], r.integers(0, 2**64, 5, np.uint64)]
    for tier in range(4):
        (x, p), (y, q) = w.prefixes(a, 50, 10, tier), w.prefixes(b, 50, 10, tier)
        assert len(x) == 251 and (x[100:131] == y[77:108]).all() and (p[100:131] - 100 == q[77:108] - 77).all()
        size = 50 - suffix.widths(50, 10)[tier] + 1
        start = np.arange(251)
        assert (start <= p).all() and (p + size <= start + 50).all() and size == (10, 30, 45, 50)[tier]


def test_no_group_is_greater_than_its_bound(spark, monkeypatch):
    """Documents of one repeated line count by their suffixes, so that they are no small group."""
    monkeypatch.setattr(suffix, "GROUP_SUFFIXES", 100)
    line = " ".join(f"l{i}" for i in range(12))
    rows = [(d, " ".join([line] * (20 + d) + [f"end{d}"])) for d in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(text) as tie")
    lists = suffix.shared_prefixes(suffix._marks(df, 50, 10).select("id", "tie", "keys", "many"))
    for tier in range(3):
        wanted = lambda name: df.join(lists.filter(f"size({name}) > 0").selectExpr("id", "tie", f"{name} as wanted"), ["id", "tie"])  # noqa: B023, E731
        groups = suffix._segments(wanted("cold"), 50, 10, tier).collect()
        sizes = Counter()
        w = suffix.Words()
        for x in groups:
            sizes[x.key] += len(set(w.prefixes(suffix._numbers(w, bytes(x.words)), 50, 10, tier)[1].tolist()))
        assert max(sizes.values(), default=0) <= 100
        lists = suffix.shared_prefixes(suffix._longer(wanted("hot"), 50, 10, tier + 1))
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.text) for x in got) == by_force(rows, 50)


def test_tree_of_sorted_suffixes():
    r = np.random.default_rng(3)
    rows = r.integers(0, 3, (200, 6)).astype(np.uint64)
    tree = suffix.subtree(rows)
    for depth in range(7):
        node = suffix.nodes(tree, depth)
        names = {}
        assert all(names.setdefault(tuple(x[:depth]), n) == n for x, n in zip(rows.tolist(), node.tolist(), strict=True)) and len(set(node.tolist())) == len(names)

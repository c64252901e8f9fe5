"""Fingerprints and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter
from math import log

import numpy as np
import xxhash

from atalaia.llm import cws, simhash


def jaccard(a, b):
    x, y = ({t: 1 + log(n) for t, n in Counter(v.lower().split()).items()} for v in (a, b))
    both = x.keys() | y.keys()
    return sum(min(x.get(t, 0), y.get(t, 0)) for t in both) / sum(max(x.get(t, 0), y.get(t, 0)) for t in both)


def some_texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(r.choice(words[: r.choice((20, 300))]) for _ in range(r.choice((1, 3, 80, 200)))) for _ in range(n)]


def test_collision_rate_is_generalised_jaccard():
    texts = some_texts(30)
    for cached in (50_000, 40):  # the second never holds a whole bag
        s = cws.Sampler(1024, cached)
        marks = [s.fingerprint(t) for t in texts]
        for i in range(29):
            assert abs(cws.likeness(marks[i], marks[i + 1]) - jaccard(texts[i], texts[i + 1])) < 0.08
    small, large = cws.Sampler(64, 40), cws.Sampler(64, 9999)
    assert [small.fingerprint(t) for t in texts] == [large.fingerprint(t) for t in texts]


def slow_sample(text):
    """The sample of each slot, term by term and slot by slot in plain numbers."""
    bag, word, step = Counter(text.lower().split()), (1 << 64) - 1, 0x9E3779B97F4A7C15
    gamma = cws.gamma_quantiles()
    table, logs = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & word
        return x ^ x >> 31

    out, one = [], np.float32(1)
    for slot in range(1, cws.SLOTS + 1) if bag else ():
        best = None
        for term, n in bag.items():
            h = int.from_bytes(xxhash.xxh64_digest(term.encode()), "little")
            x = mix((h + slot * step) & word)
            r, c, beta = table[x & 0xFFFF], logs[x >> 16 & 0xFFFF], np.float32(x >> 32) * np.float32(2.0**-32 * (1 - 2.0**-23))
            value, t = c - r * (one - beta), np.float32(0)
            if n > 1:
                t = np.floor(np.float32(np.log1p(np.log(float(n)))) / r + beta)
                value = value - r * t
            if best is None or value < best[0]:
                best = value, mix((h + int(t) * 0xD6E8FEB86659FD93 + mix((slot * step + 77) & word)) & word) >> 48
        out.append(best[1])
    return out


def test_edit_likeness_rows(spark):
    texts = [*some_texts(40), "", None, "é" * 10, "a b c d", "x" * 90_000]
    ids = [*range(0, 80, 2), 101, 103, 105, 7, -(2**63)]
    rows = list(zip(ids, texts, strict=True)) + [(None, "no id"), (105, "é" * 10)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, bucket int, `to` string")
    got = cws.edit_likeness(df).collect()
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [(None, "no id")]
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        marks = [slow_sample(x) for x in (t, new, nxt)]
        near = [sum(a == b for a, b in zip(marks[0], m, strict=True)) / cws.SLOTS if marks[0] and m else float(marks[0] == m) for m in marks[1:]]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), *("".join(f"{x:04x}" for x in m) for m in marks[:2]), *near] += 1
    assert Counter(tuple(r) for r in got) == want
    assert cws.edit_likeness(df.limit(0)).collect() == []


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(marks):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_near_duplicates(spark, monkeypatch):
    base = some_texts(25, 3)
    r = random.Random(4)
    texts = [*base, "", None, " \t\n", "\x85 a", "One two", "ONE\ttwo", "É ß"]
    for _ in range(60):
        words = r.choice(base).split()
        words[r.randrange(len(words))] = r.choice(["changed", "the"])
        texts.append(" ".join(words))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[1]), (None, "alone is this one here and now")]
    marks = [slow_fingerprint(t or "") for _, t in rows]
    roots = components_by_force(marks)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = Counter((i, f"{m:016x}", least.get(root)) for (i, _), m, root in zip(rows, marks, roots, strict=True))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    for most in (8192, 3):  # the second splits every deal
        monkeypatch.setattr(simhash, "MOST", most)
        assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_links_lose_nothing():
    r = np.random.default_rng(5)
    seeds = r.integers(0, 2**64, 60, np.uint64)
    fp = []
    for s in seeds:
        for _ in range(8):
            x = int(s)
            for b in r.integers(0, 64, 3):
                x ^= 1 << int(b)
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    a, b = simhash.linked(fp, np.zeros(len(fp), int), 4)
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 4).all()
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        np.minimum.at(label, a, label[b]), np.minimum.at(label, b, label[a])
    force = components_by_force([int(x) for x in fp])
    assert len(set(zip(label.tolist(), force, strict=True))) == len(set(force)) == len(set(label.tolist()))


def test_pivots_discard_what_is_far():
    """Of random pairs the pivots leave few to the exact comparison, of near ones they lose none."""
    r = np.random.default_rng(7)
    fp = r.integers(0, 2**64, 2000, np.uint64)
    near = fp.copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, len(fp)).astype(np.uint64)
    table = lambda x: np.bitwise_count(x[:, None] ^ simhash.PIVOTS).astype(int)
    assert (np.abs(table(fp) - table(near)).max(1) <= 4).all()
    left = np.mean(np.abs(table(fp) - table(np.roll(fp, 1))).max(1) <= 4)
    assert left < 0.02
    a, b = simhash.linked(np.r_[fp[:300], near[:300]], np.zeros(600, int), 4)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, i + 300) for i in range(300)]

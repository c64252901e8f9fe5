"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from atalaia.llm import variants


def words_by_force(rows, least=5, times=3, every=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def near_by_force(u, v):
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    return u in cuts(v) or v in cuts(u)


def by_force(rows, **args):
    n = words_by_force(rows, **args)
    form, out = {}, []
    for w in n:
        near = [u for u in n if abs(len(u) - len(w)) < 2 and near_by_force(u, w)]
        best = min(near, key=lambda u: (-n[u], u), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n[w], form[w][1], n[f] if f else None))
    return sorted(out)


def corpus():
    r = random.Random(5)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(4, 9))) for _ in range(60)] + ["banana", "ananas", "x" * 40, "Àttila", "àttila", "aaaaaa", "aaaaa", "abababab"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = r.choice(base[: r.randrange(1, len(base))])
            if r.random() < 0.3:
                j = r.randrange(len(w))
                w = r.choice((w[:j] + w[j + 1 :], w[:j] + r.choice("abcé") + w[j:], w[:j] + r.choice("abcé") + w[j + 1 :]))
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((None if i == 7 else i, " ".join(words) + r.choice(("", "œeuvre-ābc×def, €5", "\n\n"))))
    return [*rows, (1, None), (2, ""), (3, "?!"), rows[0], rows[0], (9, "y" * 70_000 + " " + ("q" * 300 + " ") * 4 + ("q" * 301 + " ") * 9)]


@pytest.mark.parametrize("hot, few", [(20_000, 6), (40, 2)])
def test_equals_brute_force(spark, monkeypatch, hot, few):
    monkeypatch.setattr(variants, "HOT", hot)  # with few, halves are dealt again and again
    monkeypatch.setattr(variants, "FEW", few)
    rows = corpus()
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = variants.group(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = by_force(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(x[1] is not None for x in want) > 50 and max(x[4] for x in want) > 5
    assert variants.group(df.limit(0)).collect() == []


def test_words_held_are_found_once():
    """Every near pair of dense words is met by one half, however deep the halves are cut."""
    words = sorted({"".join(random.Random(i).choices("ab", k=random.Random(-i).randrange(3, 9))) for i in range(400)})
    few, variants.FEW = variants.FEW, 1
    try:
        held = [(w, *x, 1) for w in words for x in variants.halves(0, 0, len(w))]
        shard = variants.shard(held)
    finally:
        variants.FEW = few
    for v in words:
        met = Counter(u for a, b in variants.may(0, 0, len(v)) for u in variants.scanned(shard, v, a, b))
        assert met == Counter(u for u in words if near_by_force(u, v))


def test_without_damage(spark):
    df = spark.createDataFrame([(1, "about about about abouts abouts abouts")], "doc_id long, text string")
    assert sorted(map(tuple, variants.group(df, every=0).collect())) == [("about", None, "about", 3, 1, None), ("abouts", None, "abouts", 3, 1, None)]

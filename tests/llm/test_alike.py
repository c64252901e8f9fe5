"""Near-duplicates by shingles against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from atalaia.llm import alike, deals, shingling, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups_by_force(texts):
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_texts():
    """Random texts, and copies with words changed so that the likeness lies on both sides of 4/5."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = ["", None, " \t", "one two", "one  two", "one two three"]
    for n in (9, 14, 30, 100, 300, 900):
        for _ in range(4):
            base = [r.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = [r.choice(words) if r.random() < share else w for w in base]
                texts.append(" ".join(copy[r.randrange(3) :]))
    texts += [f"{passage} {' '.join(r.choice(words) for _ in range(20))}" for _ in range(25)]
    base = [r.choice(words) for _ in range(120)]
    texts += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 120, 2)]
    return texts


def test_stage_links_from_four_fifths(spark):
    texts = near_texts()
    roots = groups_by_force(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if roots[i] == roots[j]]
    marks = [int(simhash.fingerprint(t or ""), 16) for t in texts]
    assert sum(bin(marks[i] ^ marks[j]).count("1") > 4 for i, j in pairs) > 50  # op3's contract would not link these
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(roots))


@pytest.mark.parametrize("small, most", ((16, 4096), (2, 4096), (2, 5)))
def test_groups_are_those_of_brute_force(spark, monkeypatch, small, most):
    monkeypatch.setattr(deals, "SMALL", small)  # with 2, most deals are large
    monkeypatch.setattr(deals, "MOST", most)  # with 5, these are cut into parts
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in alike.near_duplicates(df, ["doc_id"]).collect()}
    roots = groups_by_force(texts)
    assert len(got) == len(texts)
    assert len({(got[i], r) for i, r in enumerate(roots)}) == len(set(roots)) == len(set(got.values()))
    assert alike.near_duplicates(df.limit(0), ["doc_id"]).collect() == []


def test_bound_never_rules_out_what_is_alike():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, r.integers(1, 50)))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.95], r.integers(0, 60, 2)])
        if shingling.alike(a, b, 4, 5):
            assert deals.fit(*(np.array([len(x)]) for x in (a, b)), alike.Pivots())[0]


def test_rows_of_repeated_and_null_ids(spark):
    r = random.Random(9)
    some = [" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(50)) for _ in range(80)) for _ in range(6)]
    rows = [(1, some[0]), (1, some[1]), (1, some[0] + " more"), (2, some[1]), (3, some[2]), (3, some[2]), (None, some[2] + " end"), (None, some[3]), (None, some[3] + " end"), (None, some[4]), (0, some[5]), (None, None)]
    got = pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert len(kept) == 7 and {(1, some[1]), (3, some[2]), (None, some[4]), (0, some[5]), (None, None)} < set(kept)
    assert len({(1, some[0]), (1, some[0] + " more")} & set(kept)) == 1 and len({(None, some[3]), (None, some[3] + " end")} & set(kept)) == 1


def test_columns_of_clashing_names(spark):
    """Columns that are named as those the stages make on their way come out as they went in."""
    names = ["_row", "_id", "_last", "row", "last", "number", "whole", "rest", "component", "n_words", "_text_as_it_was", "key", "a.b"]
    r = random.Random(4)
    some = [" ".join(r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(120)) for _ in range(3)]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate([some[0], some[1], some[0] + " x", "y " + some[2], some[1]])]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(f'`{c}` string' for c in names)}")
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[1], rows[3]]
    left = pipeline.cut_repeats(spark, docs, "")
    assert left.columns == docs.columns and {x.doc_id: tuple(x)[5:] for x in left.collect()} == {i: rows[i][5:] for i in (0, 1, 2, 3)}

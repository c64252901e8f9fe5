"""The toxicity classifier: gradients, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np

from atalaia.llm import toxicity as tox

BAD = ["vilestem", "grubstem", "murkstem"]


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "and", "of"]
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        text = [r.choice(words) for _ in range(r.randrange(3, 150))]
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(BAD) + r.choice(["", "ing", "ed", f"x{r.randrange(50)}"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, None if i % 97 == 0 else y, 1) for i, _, y in rows] + [(3, 0, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = tox.fit(docs, labels)
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held) and 400 < len(held) < 600
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = tox.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n"), (4, "w1 " * 200_000)], "doc_id long, text string")
    rows = tox.score(odd, model).collect()
    assert len(rows) == 5 and all(r.score is not None for r in rows) and not [r for r in rows if r.doc_id is None and r.held_out]
    assert tox.score(odd.limit(0), model).collect() == []
    empty = tox.fit(docs.limit(0), labels.limit(0))
    assert {r.predicted for r in tox.score(docs, empty).collect()} == {0}


def test_what_is_collected_is_bounded(spark):
    """One text of a repeated id, none that is too long, and few rows calibrate as many do."""
    rows = corpus(240, 5)
    many = [(i, t) for i, t, _ in rows] + [(0, f"other {k}") for k in range(500)] + [(3, "long " * 9000)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fitted = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    some, counts = tox.sampled(docs, labels, most_chars=10_000)
    assert len(some) == fitted == sum(counts.values()) and some["text"].str.len().max() < 2000 and some["doc_id"].is_unique
    few, _ = tox.sampled(docs, labels, 20, 30, 10_000, 5000)
    assert 5 < len(few) < 50 and few.groupby("y")["text"].agg(lambda t: t.str.len().sum()).max() <= 5000
    model = tox.fit(docs, labels, most_chars=10_000)
    got = {r.doc_id: r.predicted for r in tox.score(docs.limit(240), model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == y for i, y in held]) > 0.85


def test_every_labelled_row_is_trained_and_calibrated_on(spark, monkeypatch):
    """Texts of any length and number, in many parts; how rows are partitioned makes no difference."""
    monkeypatch.setattr(tox, "PART_ROWS", 60, raising=False)
    rows = corpus(600, 3)
    for i in range(600, 660):  # this word is in long texts alone
        rows.append((i, "w1 w2 w3 " * 24_000 + ("zzgrim" if i % 2 else "w4"), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tox.Model, "calibrate", lambda self, logits, langs, y, counts, f=tox.Model.calibrate: (seen.append((y, counts)), f(self, logits, langs, y, counts)))
    model = tox.fit(docs, labels)
    fitted = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert [counts[y == c].sum() for y, counts in seen for c in (0, 1)] == [fitted.count(0), fitted.count(1)]
    asked = spark.createDataFrame([(0, "w5 zzgrim w9"), (1, "w5 w7 w9")], "doc_id long, text string")
    assert [r.predicted for r in tox.score(asked, model).orderBy("doc_id").collect()] == [1, 0]
    again = tox.fit(docs.repartition(7), labels.repartition(3))
    assert again.thresholds == model.thresholds and np.array_equal(again.table, model.table)
    dealt = tox.labelled(docs, labels).selectExpr("*", "cast(doc_id % 2 as int) fold", "cast(doc_id % 5 as int) part")
    assert sum(v[-1] for v in tox._summed(dealt, [1.0, 1.0], 1).values()) == len(fitted)


def test_scorer_equals_a_plain_forward_pass():
    model, r = tox.Model(), random.Random(2)
    model.bias += 0.1
    for n in (0, 1, 2, 3, 40, 900):
        words = [f"w{r.randrange(50)}".encode() for _ in range(n)]
        x = [sum(model.table[k].astype(np.float64) for k in tox.rows_of(w)) for w in words] + [np.zeros(tox.SIZE)] * 2
        pooled = []
        for w in tox.WIDTHS:
            pooled += [max(sum(x[i + o] @ model.filters[w][o][:, f] for o in range(w)) for i in range(max(1, n))) if n else 0.0 for f in range(tox.FILTERS)]
        want = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.shift
        assert abs(model.scorer(100).logit(words) - want) < 1e-4


def test_long_texts_are_scored_in_parts_alike():
    model = tox.Model()
    words = [f"w{i}".encode() for i in np.random.default_rng(1).integers(0, 300, 5000)]
    assert abs(model.scorer(1000).logit(words) - model.scorer(100_000).logit(words)) < 1e-5


def test_gradients():
    model = tox.Model()
    r = np.random.default_rng(2)
    docs = [np.array(x) for x in ([1, 2, 3, 4, 2], [5], [0], [3, 3, 6, 1])]
    rows = np.array([[tox.ROWS] * 2, *r.integers(0, 9, (6, 2))])
    table = np.vstack([r.standard_normal((tox.ROWS, tox.SIZE)), np.zeros((1, tox.SIZE))])
    model.filters = {w: f.astype(np.float64) for w, f in model.filters.items()}
    labels, weights = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    model.bias, model.out = r.standard_normal(len(model.bias)), model.out.astype(np.float64)
    params = model._parameters(table)
    params["shift"] = model._shift = np.zeros(1)

    def loss():
        total = 0
        for d, y, w in zip(docs, labels, weights, strict=True):
            x = np.vstack([table[rows[d]].sum(1), np.zeros((2, tox.SIZE))])
            pooled = np.concatenate([max_over(x, f, len(d)) for f in model.filters.values()]) + model.bias
            z = np.maximum(pooled, 0) @ model.out + model._shift[0]
            total += w * (np.log1p(np.exp(z)) - y * z)
        return total / len(docs)

    def max_over(x, f, n):
        return np.max([sum(x[i + o] @ f[o] for o in range(len(f))) for i in range(n)], 0)

    grads, touched = model._gradients(docs, rows, table, labels, weights)
    for name, at in (("w2", (1, 3, 2)), ("w3", (2, 0, 5)), ("out", (4,)), ("bias", (9,)), ("table", (int(touched[1]), 3))):
        p = params[name]
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        g = grads[name][(1, at[1]) if name == "table" else at]
        assert abs((up - down) / 2e-6 - g) < 1e-5 + 0.001 * abs(g), name


def test_threshold_separates_best():
    x, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])
    assert tox.best_threshold(x, y, np.ones(4)) == 1.5


def test_every_text_of_a_doc_id_is_learned(spark, monkeypatch):
    """All texts of one id count as labelled rows, and several parts have as many epochs as one."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"a mild text of {i}") for i in ids] + [(i, f"the second text, {'vile ' * (i % 2)}number {i}") for i in ids]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.text, r.y) for r in tox.labelled(docs, labels).collect())
    assert got == sorted((i, t, i % 2) for i, t in [*rows, rows[0]])
    asked, summed = [], tox._summed
    monkeypatch.setattr(tox, "PART_ROWS", 40)
    monkeypatch.setattr(tox, "_summed", lambda dealt, weights, epochs: asked.append(epochs) or summed(dealt, weights, epochs))
    tox.fit(docs, labels)
    assert asked == [tox.EPOCHS]

"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows: one for the word, and one each for its first 3 to 6 bytes, so
that inflected forms share most of theirs. Filters of width 1, 2 and 3 run over the words of the whole text,
each is max-pooled, and a linear layer gives a logit. A threshold is calibrated on labelled texts, scored by
models that were not trained on them, for each language, as told from the text's own stop words; the score is
placed so that a text at its language's threshold scores exactly ``CUT``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, prepare, tidied
from .seeds import plain_words

#: Rows of the hashed embedding, its size, filters of each width, widths.
ROWS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Rows and characters of a part that a model is trained on, epochs, and slices in which models are added.
PART_ROWS, PART_CHARS, EPOCHS, SLICES = 4000, 20_000_000, 5, 16
#: Most labelled texts that sampled() gives, of either class, characters of the longest, and of all of a class.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, MOST_TOTAL = 2000, 3000, 200_000, 20_000_000
#: Folds that the fitted texts are dealt to; each is calibrated on by a model that was trained on the others.
FOLDS = 3
#: Score from which a text counts as toxic.
CUT = 0.7
#: Stop words by which the language of a text is told; fixed values.
STOP_WORDS = {
    "en": "the of and to in is that for with on as are this by be it was",
    "fr": "le la les de des et un une du en que qui dans pour par sur au",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine",
    "es": "el la los las de y que en un una por con para del se es lo",
}
PREFIXES = (3, 4, 5, 6)


def rows_of(word: bytes) -> list[int]:
    """Rows of the embedding that a word sums up."""
    h = xxhash.xxh32_intdigest
    return [h(word, 1) % ROWS, *(h(word[:n], n + 1) % ROWS for n in PREFIXES)]


_STOPS = {w.encode(): lang for lang in reversed(STOP_WORDS) for w in STOP_WORDS[lang].split()}
_SHARED = {w.encode() for w in " ".join(STOP_WORDS.values()).split() if sum(w in s.split() for s in STOP_WORDS.values()) > 1}


def language(words: list[bytes]) -> str:
    """The language most of whose own stop words occur, "" if none does; ties go to the first in STOP_WORDS."""
    seen = dict.fromkeys(STOP_WORDS, 0)
    for w in words:
        lang = _STOPS.get(w)
        if lang and w not in _SHARED:
            seen[lang] += 1
    best = max(seen, key=seen.get)
    return best if seen[best] else ""


class Model:
    """The classifier; ``train`` fits it, ``logits`` applies it."""

    def __init__(self, seed: int = 8) -> None:
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((ROWS, SIZE)) * 0.01).astype(np.float32)
        self.filters = {w: (r.standard_normal((w, SIZE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (r.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.shift = np.float32(0)
        self.thresholds: dict[str, float] = {"": float("inf")}

    def train(self, docs: list[np.ndarray], words: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 5, rate: float = 0.05, seed: int = 8) -> None:
        """Adagrad on the weighted logistic loss; the first embedding entry starts as the rows' smoothed log odds.

        ``docs`` are numbers of ``words``, from 1; 0 is padding, and an empty document is one 0.
        """
        r = np.random.default_rng(seed)
        rows = np.array([[ROWS] * (1 + len(PREFIXES)), *map(rows_of, words)], np.int32)
        seen = np.zeros((2, ROWS + 1), np.float64)
        for d, y in zip(docs, labels, strict=True):
            seen[y][np.unique(rows[d])] += 1
        self.seen = seen[:, :ROWS].sum(0)
        seen = (seen[:, :ROWS] + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
        odds = np.log(seen[1] / seen[0])
        self.table[:, 0] = np.clip(odds - np.median(odds), -1, 6) / 4
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] = 1 / w
        self.out[:] = np.abs(self.out)
        table = np.vstack([self.table, np.zeros((1, SIZE), np.float32)])
        past = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self._parameters(table).items()}
        for _ in range(epochs):
            for batch in np.array_split(r.permutation(len(docs)), max(1, len(docs) // 48)):
                grads, touched = self._gradients([docs[i] for i in batch], rows, table, labels[batch], weights[batch])
                for k, v in self._parameters(table).items():
                    at = touched if k == "table" else slice(None)
                    past[k][at] += grads[k] ** 2
                    v[at] -= rate * grads[k] / np.sqrt(past[k][at])
                table[ROWS] = 0
                self.shift = np.float32(self._shift[0])
        self.table = table[:ROWS]

    def _parameters(self, table: np.ndarray) -> dict[str, np.ndarray]:
        if not hasattr(self, "_shift"):
            self._shift = np.array([self.shift], np.float32)
        return {"table": table, "bias": self.bias, "out": self.out, "shift": self._shift, **{f"w{w}": f for w, f in self.filters.items()}}

    def _gradients(self, docs, rows, table, labels, weights):
        lengths = np.array([len(d) for d in docs])
        pad = max(WIDTHS) - 1
        words = np.concatenate([np.r_[d, [0] * pad] for d in docs])
        starts = np.cumsum(lengths + pad) - lengths - pad
        windows = np.concatenate([s + np.arange(n) for s, n in zip(starts, lengths, strict=True)])
        cuts = np.cumsum(lengths) - lengths
        own, back = np.unique(words, return_inverse=True)
        x = table[rows[own]].sum(1)[back]
        pooled, best = [], {}
        for w in WIDTHS:
            response = sum(x[windows + o] @ self.filters[w][o] for o in range(w))
            best[w] = np.stack([a + response[a : a + n].argmax(0) for a, n in zip(cuts, lengths, strict=True)])
            pooled.append(np.take_along_axis(response, best[w], 0))
        pooled = np.concatenate(pooled, 1) + self.bias
        active = np.maximum(pooled, 0)
        logit = active @ self.out + self._shift[0]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weights / len(docs)).astype(np.float32)
        inner = error[:, None] * self.out * (pooled > 0)
        grads = {"out": active.T @ error, "shift": np.array([error.sum()]), "bias": inner.sum(0)}
        dx_at, dx = [], []
        for n, w in enumerate(WIDTHS):
            g = inner[:, n * FILTERS : (n + 1) * FILTERS]
            at = windows[best[w]]
            grads[f"w{w}"] = np.stack([np.einsum("dfs,df->sf", x[at + o], g) for o in range(w)])
            for o in range(w):
                dx_at.append((at + o).ravel())
                dx.append((g[:, :, None] * self.filters[w][o].T).reshape(-1, SIZE))
        dx_at, dx = np.concatenate(dx_at), np.concatenate(dx)
        hit = rows[words[dx_at]]
        touched, place = np.unique(hit, return_inverse=True)
        gt = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(gt, place.reshape(hit.shape), dx[:, None, :])
        grads["table"] = gt
        return grads, touched

    def responses(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to each filter at each offset."""
        x = self.table[np.array([rows_of(w) for w in words])].sum(1)
        return np.concatenate([x @ self.filters[w][o] for w in WIDTHS for o in range(w)], 1)

    def scorer(self, cached: int = 200_000) -> Scorer:
        return Scorer(self, cached)

    def calibrate(self, logits: np.ndarray, langs: list[str], labels: np.ndarray, counts: np.ndarray, least: int = 15) -> None:
        """For each language with enough texts of both classes, and for all others together, the threshold of best F1; ``counts`` texts have a logit each."""
        langs = np.array(langs)
        self.thresholds = {}
        for lang in ["", *STOP_WORDS]:
            of = langs == lang if lang else np.ones(len(langs), bool)
            y, n = labels[of], counts[of]
            toxic, clean = (n * y).sum(), (n * (1 - y)).sum()
            if min(toxic, clean) >= (least if lang else 1):
                self.thresholds[lang] = best_threshold(logits[of], y, n)
        self.thresholds.setdefault("", float("inf"))

    def score(self, logit: float, lang: str) -> float:
        at = self.thresholds.get(lang, self.thresholds[""])
        if at == float("inf"):
            return CUT / 2
        return float(1 / (1 + np.exp(-np.clip(logit - at + np.log(CUT / (1 - CUT)), -30, 30))))


class Scorer:
    """Logits of texts, with the responses of words that were met kept up to a bound."""

    def __init__(self, model: Model, cached: int) -> None:
        self.model, self.cached = model, cached
        self.rows: dict[bytes, int] = {}
        self.kept = np.zeros((cached, FILTERS * sum(WIDTHS)), np.float32)

    def _places(self, words: list[bytes]) -> list[int]:
        known = self.rows
        new = set(words).difference(known)
        if len(known) + len(new) > self.cached:
            known.clear()
            new = set(words)
        if new:
            new = list(new)
            self.kept[len(known) : len(known) + len(new)] = self.model.responses(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return [known[w] for w in words]

    def logit(self, words: list[bytes]) -> float:
        m, pad = self.model, max(WIDTHS) - 1
        best = np.full(len(m.out), -np.inf, np.float32)
        step = self.cached // 2
        for a in range(0, max(1, len(words)), step):  # long texts by overlapping parts
            part = words[a : a + step + pad]
            n = min(len(part), step) or 1
            r = np.zeros((n + pad, self.kept.shape[1]), np.float32)
            if part:
                r[: len(part)] = self.kept[self._places(part)]
            col = 0
            for i, w in enumerate(WIDTHS):
                response = sum(r[o : o + n, col + o * FILTERS : col + (o + 1) * FILTERS] for o in range(w))
                mine = best[i * FILTERS : (i + 1) * FILTERS]
                np.maximum(mine, response.max(0), out=mine)
                col += w * FILTERS
        return float(np.maximum(best + m.bias, 0) @ m.out + m.shift)


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the gap between two logits at which the weighted F1 is best; of equals the highest."""
    order = np.argsort(-logits, kind="stable")
    x, y, w = logits[order], labels[order], weights[order]
    right, wrong = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * right / (right + wrong + (w * y).sum())
    f1[np.r_[x[1:] == x[:-1], False]] = -1  # only where the logit changes
    i = int(f1.argmax())
    return float((x[i] + x[i + 1]) / 2 if i + 1 < len(x) else x[i] - 1)


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is not 1 modulo 3; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_chars: int = MOST_CHARS, most_total: int = MOST_TOTAL) -> tuple[pd.DataFrame, dict[int, int]]:
    """(doc_id, y, text) of a bounded number of labelled rows, in the driver, for a look at them, and the labelled rows of either class; fit() does not use it."""
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(in_training() & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    sample = some[0].unionByName(some[1])  # of a fixed greatest size, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").filter(F.length("text") <= most_chars)
    kept = cut(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    sizes = kept.select("doc_id", "y", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    within = sizes[sizes.groupby("y")["n"].cumsum() <= most_total]
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in within["doc_id"]], "doc_id long")
    rows = kept.join(F.broadcast(chosen), "doc_id", "left_semi").toPandas().sort_values("doc_id")
    return rows, counts


def labelled(docs: DataFrame, labels: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(doc_id, y, text) of every row whose label may be learned, repeated ids and texts too; with ``most_chars`` of those that are no longer."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(in_training() & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(in_training())
    if most_chars is not None:
        texts = texts.filter(F.length("text") <= most_chars)
    return texts.join(known, "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, most_chars: int | None = None) -> Model:
    """Train on every labelled row for which in_training() holds, and calibrate on all of them.

    Null labels are left out, a doc_id with several labels counts as toxic if any of them is 1; all texts of a doc_id are
    taken, in one fold, and with ``most_chars`` no longer ones. Rows are dealt by a hash of doc_id to FOLDS folds, and a fold's, by text too, to parts of about PART_ROWS
    rows or PART_CHARS characters; a model is trained on each part in a task, and models are averaged, a row of the embedding by the texts that
    have it. The model is the average of all parts. Each text is scored by that of the folds it is not in; thresholds come from the
    counts of these logits, to three digits, over all texts. With no text of one class the model calls nothing toxic.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = cut(labelled(docs, labels, most_chars))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"] or not 0 < size["toxic"] < size["n"]:
        return Model()
    parts = max(1, -(-size["n"] // (FOLDS * PART_ROWS)), -(-size["chars"] // (FOLDS * PART_CHARS)))
    weights = [size["n"] / 2 / (size["n"] - size["toxic"]), size["n"] / 2 / size["toxic"]]
    hashed = F.xxhash64("doc_id")
    dealt = rows.withColumns({"fold": F.pmod(hashed, F.lit(FOLDS)).cast("int"), "part": F.pmod(F.shiftright(F.xxhash64("doc_id", "text"), 8), F.lit(parts)).cast("int")})
    sums = _summed(dealt, weights, EPOCHS)
    model = _averaged(list(sums.values()))
    held = [_averaged([v for k, v in sums.items() if k != fold]) for fold in range(FOLDS)]
    counts = _logit_counts(dealt, held).toPandas()
    model.calibrate(counts["logit"].to_numpy(float), counts["language"].tolist(), counts["y"].to_numpy(np.int64), counts["n"].to_numpy(float))
    return model


def _trained(texts: list[str], y: np.ndarray, weights: list[float], epochs: int) -> Model:
    """A model of the texts of one part."""
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(w, len(known) + 1) for w in plain_words(t)] or [0], np.int32) for t in texts]
    model = Model()
    model.train(numbers, list(known), y, np.array(weights, np.float32)[y], epochs)
    return model


def _summed(dealt: DataFrame, weights: list[float], epochs: int) -> dict[int, np.ndarray]:
    """By fold, the sum over its parts of _weighted() models. Sums are made in tasks, a slice of the numbers in each, so the driver gets FOLDS models at any size."""

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        values = _weighted(_trained(rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.int64), weights, epochs), rows.num_rows)
        fold = rows.column("fold")[0].as_py()
        return pa.table({"fold": pa.array([fold] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([rows.column("part")[0].as_py()] * SLICES, pa.int32()), "made": pa.array([x.tobytes() for x in np.array_split(values, SLICES)], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows.sort_by("part").column("made"))
        return pa.table({"fold": rows.column("fold")[:1], "slice": rows.column("slice")[:1], "made": pa.array([total.tobytes()], pa.binary())})

    tidy = lambda rows: list(tidied(lambda x: iter([train(x)]))(rows))[0]
    made = dealt.groupBy("fold", "part").applyInArrow(tidy, "fold int, slice int, part int, made binary")
    rows = made.groupBy("fold", "slice").applyInArrow(add, "fold int, slice int, made binary").collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["fold"], r["slice"])):
        by.setdefault(r["fold"], []).append(np.frombuffer(r["made"], np.float64))
    return {k: np.concatenate(v) for k, v in by.items()}


def _shapes(model: Model) -> list[np.ndarray]:
    return [*model.filters.values(), model.bias, model.out]


def _weighted(model: Model, n: int) -> np.ndarray:
    """The numbers of a model of ``n`` texts: for each row of the embedding the texts that have it, the rows times these, then all else times n, and n."""
    rest = np.concatenate([x.ravel() for x in _shapes(model)] + [np.array([model.shift])])
    return np.concatenate([model.seen, (model.table * model.seen[:, None]).ravel(), rest * n, [n]]).astype(np.float32)


def _averaged(sums: list[np.ndarray]) -> Model:
    """The model of summed _weighted() models; rows of the embedding that no text has stay as they begin."""
    model = Model()
    if not sums:
        return model
    total = sum(sums)
    seen, table, rest, n = total[:ROWS], total[ROWS : ROWS * (SIZE + 1)].reshape(ROWS, SIZE), total[ROWS * (SIZE + 1) : -1], total[-1]
    met = seen > 0
    model.table[met] = table[met] / seen[met, None]
    at = 0
    for x in _shapes(model):
        x[...] = (rest[at : at + x.size] / n).reshape(x.shape)
        at += x.size
    model.shift = np.float32(rest[at] / n)
    return model


def _logit_counts(dealt: DataFrame, models: list[Model]) -> DataFrame:
    """(language, y, logit, n): texts by logit, to three digits, of the model of the folds that a text is not in."""
    sent = dealt.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        scorers = [m.scorer(60_000) for m in pickle.loads(sent.value)]
        for b in batches:
            words = [plain_words(t) for t in b["text"]]
            yield {"language": [language(w) for w in words], "y": b["y"], "logit": [round(scorers[k].logit(w), 3) for k, w in zip(b["fold"], words, strict=True)]}

    return mapped(dealt.select("text", "y", "fold"), work, "language string, y int, logit double").groupBy("language", "y", "logit").agg(F.count(F.lit(1)).alias("n"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, language) for every row of (doc_id, text).

    Null text counts as empty and is scored as such; other columns are not read; repeated rows stay.
    held_out is crc32 of the id as text modulo 3 being 1, false for a null id.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        m: Model = pickle.loads(sent.value)
        s = m.scorer()
        for b in batches:
            words = [plain_words(t or "") for t in b["text"]]
            langs = [language(w) for w in words]
            yield {"doc_id": b["doc_id"], "score": [m.score(s.logit(w), lang) for w, lang in zip(words, langs, strict=True)], "language": langs}

    rows = mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, score double, language string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "language")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        s = m.scorer()
        for b in batches:
            words = [plain_words(t or "") for t in b.column(at).to_pylist()]
            keep = [m.score(s.logit(w), language(w)) < CUT for w in words]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(work), docs.schema)

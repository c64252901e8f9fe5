"""Many questions against sparse vectors: a block of chunks times a block of questions, of which only what may enter a list leaves the task.

Questions go to every task as one matrix of a checked size. Each task keeps the scores of the best chunks that it has seen for each question; a pair
below the last of them is not emitted, and a question whose bound (by the greatest and least weight of each bucket in the block) lies below it is not multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the matrix that goes to every task at most (64 MB), numbers of a block of chunks, and questions multiplied at once.
MOST_CELLS, BLOCK, STEP = 8_000_000, 4_000_000, 256
_EVEN = 1e-6  # scores are rounded to six digits


def dense(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """Sparse entries (bucket, weight) as a matrix, a row each; null rows are zeros."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat, out = pc.list_flatten(vectors), np.zeros((len(vectors), dimensions))
    out[np.repeat(np.arange(len(vectors)), lengths), flat.field("bucket").to_numpy(zero_copy_only=False)] = flat.field("weight").to_numpy(zero_copy_only=False)
    return out


def first_of(scores: np.ndarray, limit: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, chunk) places of the ``limit`` best chunks of each row of ``scores`` that reach its ``floor`` (ties: the first), and each row's best scores."""
    n = scores.shape[1]
    k = min(limit, n)
    best = np.partition(scores, n - k, axis=1)[:, n - k :]
    i, j = np.nonzero((scores >= np.maximum(best[:, 0], floor)[:, None]) & (scores > -np.inf))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < limit
    return i[keep], j[keep], best


class Questions:
    """The questions of one search: a matrix, their ids and what chunks they allow."""

    def __init__(self, rows: pa.Table, dimensions: int):
        self.ids, self.matrix = rows.column("query_id").combine_chunks(), dense(rows.column("qv").combine_chunks(), dimensions)
        self.agency = rows.column("q_orgao").to_pylist()
        self.types = [set(t) if t else None for t in rows.column("tipos").to_pylist()]
        self.signed = bool((self.matrix < 0).any())
        self._of_type: dict[str | None, np.ndarray] = {}

    def of_type(self, kind: str | None) -> np.ndarray:
        """Which questions allow a type."""
        if kind not in self._of_type:
            self._of_type[kind] = np.array([t is None or (kind is not None and kind in t) for t in self.types], bool)
        return self._of_type[kind]

    def bound(self, block: np.ndarray) -> np.ndarray:
        """A score that no row of the block passes, of each question."""
        most, least = np.maximum(block.max(0), 0), np.minimum(block.min(0), 0)
        return np.maximum(self.matrix, 0) @ most + np.minimum(self.matrix, 0) @ least if self.signed else self.matrix @ most


def _codes(values: pa.Array) -> tuple[np.ndarray, list]:
    """A number for each value, null as another one, and the values by number."""
    held = values.dictionary_encode(null_encoding="encode")
    return held.indices.to_numpy(zero_copy_only=False), held.dictionary.to_pylist()


def _found(block: pa.RecordBatch, asked: Questions, dimensions: int, limit: int, best: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, chunk, score) of a block in the order of chunk_id; with ``best``, the scores that the task has seen, of all agencies together, else of each one."""
    x = dense(block.column("vector"), dimensions)
    agency, agencies = _codes(block.column("orgao"))
    kind, kinds = _codes(block.column("tipo_documento"))
    number = {a: n for n, a in enumerate(agencies) if a is not None}
    own = np.array([-1 if a is None else number.get(a, -2) for a in asked.agency])  # -1: any, -2: none of this block
    parts = [np.arange(len(x))] if best is not None else [np.flatnonzero(agency == a) for a in range(len(agencies))]
    for rows in parts:
        part, live = x[rows], own != -2
        if best is not None:
            live &= asked.bound(part) + _EVEN >= best[:, 0]
        places = np.flatnonzero(live)
        for at in range(0, len(places), STEP):
            q = places[at : at + STEP]
            dots = asked.matrix[q] @ part.T
            scores = np.floor(dots * 1e6 + 0.5) / 1e6
            fits = np.array([asked.of_type(k)[q] for k in kinds])[kind[rows]].T & ((own[q] == -1)[:, None] | (own[q][:, None] == agency[rows][None, :]))
            scores[(dots == 0) | ~fits] = -np.inf
            i, j, top = first_of(scores, limit, best[q, 0] if best is not None else np.full(len(q), -np.inf))
            if best is not None:
                both = np.concatenate([best[q], top], axis=1)
                best[q] = np.sort(both, axis=1)[:, -limit:]
            yield q[i], rows[j], scores[i, j]


def search(vectors: DataFrame, rows: pa.Table, dimensions: int, limit: int, by_agency: bool = False) -> DataFrame:
    """(query_id, chunk_id, orgao, score): of (chunk_id, orgao, tipo_documento, vector) a superset of the ``limit`` best of each question, of all or of each agency.

    ``rows`` are the questions (query_id, q_orgao, tipos, qv), at most MOST_CELLS / dimensions. Scores have six digits; pairs with a product of 0 are none.
    What is emitted by a task is its best at the time, so it grows with the logarithm of what the task reads; the caller ranks it.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(Questions(rows, dimensions))
    kinds, step = dict(vectors.dtypes), max(1, BLOCK // dimensions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = None if by_agency else np.full((len(asked.ids), limit), -np.inf)
        for b in batches:
            b = b.take(pc.sort_indices(b.column("chunk_id")))
            for at in range(0, b.num_rows, step):
                block = b.slice(at, step)
                for q, c, score in _found(block, asked, dimensions, limit, best):
                    where = pa.array(c)
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), block.column("chunk_id").take(where), block.column("orgao").take(where), pa.array(score)], ["query_id", "chunk_id", "orgao", "score"])

    return vectors.select("chunk_id", "orgao", "tipo_documento", F.transform("vector", lambda e: F.struct(e["bucket"].cast("int").alias("bucket"), e["weight"].alias("weight"))).alias("vector")).mapInArrow(work, f"query_id string, chunk_id {kinds['chunk_id']}, orgao {kinds['orgao']}, score double")


def whole(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, a row each, and which of them have ``width`` numbers and no null; the others are zeros."""
    full = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    flat, ok = pc.list_flatten(vectors.filter(full)), full.to_numpy(zero_copy_only=False).copy()
    ok[ok] = ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, width).any(1) if width else False
    out, held = np.zeros((len(vectors), width)), np.flatnonzero(full.to_numpy(zero_copy_only=False))
    out[held] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(float).reshape(len(held), width)
    return out * ok[:, None], ok


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first number on, as an aggregate over the array sums them."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Asked:
    """Dense questions of one search: ids, matrix and norms."""

    def __init__(self, rows: pa.Table):
        self.ids, queries = rows.column("query_id").combine_chunks(), rows.column("query").combine_chunks()
        lengths = set(pc.unique(pc.list_value_length(queries)).to_pylist()) - {None}
        #: Whether all have as many numbers; a question without any has no score.
        self.even, self.width = len(lengths) <= 1, max(lengths, default=0)
        if self.even:
            self.matrix, ok = whole(queries, self.width)
            with np.errstate(all="ignore"):
                self.norm = np.where(ok, np.sqrt(dots(self.matrix, self.matrix)), 0)
                self.unit = np.divide(self.matrix, self.norm[:, None], out=np.zeros_like(self.matrix), where=self.norm[:, None] != 0)


def nearest(vectors: DataFrame, asked: Asked, limit: int, wanted: Callable[[int, Asked], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score): of (id, vector) a superset of the ``limit`` best of each dense question by cosine, six digits (ties: least id; null where there is none, last).

    Blocks are multiplied to tell which pairs may enter a list; only these get their exact score. With ``wanted`` vectors have a ``cell``,
    and only the questions that it names for a cell are multiplied with its vectors.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    sent, step = spark.sparkContext.broadcast((asked, wanted)), max(1, min(4096, BLOCK // max(asked.width, 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, choose = sent.value
        floor = np.full(len(q.ids), -np.inf)  # score of the last place that the task has seen
        for b in batches:
            b = b.take(pc.sort_indices(b.column("id")))
            cells = b.column("cell").to_numpy() if choose else np.zeros(b.num_rows, int)
            for cell in np.unique(cells):
                rows, who = np.flatnonzero(cells == cell), choose(int(cell), q) if choose else np.arange(len(q.ids))
                for at in range(0, len(rows), step):
                    yield from found(b.take(pa.array(rows[at : at + step])), who, q, floor)

    def found(b: pa.RecordBatch, who: np.ndarray, q: Asked, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, ok = whole(b.column("vector"), q.width)
        with np.errstate(all="ignore"):
            norm = np.where(ok, np.sqrt(dots(x, x)), 0)
            unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] != 0)
            for k in range(0, len(who), STEP):
                w = who[k : k + STEP]
                near = q.unit[w] @ unit.T
                near[np.isnan(near)] = 0
                near[:, norm == 0], near[q.norm[w] == 0] = -2, -2
                last = np.partition(near, -limit, axis=1)[:, -limit] if near.shape[1] > limit else np.full(len(w), -np.inf)
                i, j = np.nonzero(near >= np.maximum(last - 2 * _EVEN, floor[w] - _EVEN)[:, None])
                exact = dots(q.matrix[w[i]], x[j]) / (norm[j] * q.norm[w[i]])
                none = (norm[j] == 0) | (q.norm[w[i]] == 0)
                score = np.where(none, -2, np.floor(np.where(np.isnan(exact), 0, exact) * 1e6 + 0.5) / 1e6)
                order = np.lexsort((j, -score, i))
                i, j, score, none = i[order], j[order], score[order], none[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                lowest = rank == limit - 1
                floor[w[i[lowest]]] = np.maximum(floor[w[i[lowest]]], score[lowest])
                kept = rank < limit
                yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(w[i[kept]])), b.column("id").take(pa.array(j[kept])), pa.array(score[kept], mask=none[kept])], ["query_id", "id", "score"])

    kind = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}.get(asked.ids.type)
    columns = ["id", "vector", *(["cell"] if wanted else [])]
    return vectors.select(*columns).mapInArrow(work, f"query_id {kind}, id {kinds['id']}, score double")

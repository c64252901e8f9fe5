"""BM25 of chunks whose texts are read for it, where no postings are stored: nothing is shuffled but counts and the best of each task.

The phrases of all questions go to every task as a trie. One pass counts the chunks that hold each, a second one scores; a chunk's score is made
in its own batch. A task keeps the best chunks that it has seen for each question and hands them on at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import index_tokens

#: Pairs of chunk and asked phrase that are scored at once, and rows that a task keeps before it hands them on.
STEP, MOST_KEPT = 2_000_000, 500_000
FOUND = pa.schema([("q", pa.int64()), ("chunk_id", pa.string()), ("orgao", pa.string()), ("score", pa.float64())])


class Phrases:
    """Phrases, each an array of terms, as a trie: the node that follows a node by a term, and the phrase that ends in it."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        terms = {t: i for i, t in enumerate(sorted({t for p in phrases for t in p}))}
        follows: dict[int, int] = {}
        ends = {}
        for n, p in enumerate(phrases):
            node = 0
            for t in p:
                node = follows.setdefault(node * len(terms) + terms[t], len(follows) + 1)
            ends[node] = n
        self.n, self.terms = len(phrases), pa.array(list(terms), pa.string())
        self.key = np.array(sorted(follows), np.int64)
        self.to = np.array([follows[k] for k in sorted(follows)], np.int64)
        self.phrase = np.array([ends.get(node, -1) for node in range(len(follows) + 1)], np.int64)

    def counts(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, occurrences) of what the rows of tokens hold, by row, and each row's number of tokens. Occurrences may overlap."""
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(tokens).dictionary_encode()
        known = pc.fill_null(pc.index_in(flat.dictionary, self.terms.cast(flat.dictionary.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(length)), length)
        at, met = np.flatnonzero(code >= 0), [np.zeros(0, np.int64)]
        node = np.zeros(len(at), np.int64)
        while len(at):
            key = node * len(self.terms) + code[at]
            k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[k] == key
            at, node = at[hit], self.to[k[hit]]
            end = self.phrase[node] >= 0
            met.append(row[at[end]] * self.n + self.phrase[node[end]])
            more = at + 1 < len(code)
            at, node = at[more], node[more]
            more = (row[at + 1] == row[at]) & (code[at + 1] >= 0)
            at, node = at[more] + 1, node[more]
        key, n = np.unique(np.concatenate(met), return_counts=True)
        return key // max(self.n, 1), key % max(self.n, 1), n, length


class Asked:
    """The terms of questions (query_id, q_orgao, tipos, phrase, times): a row for each question and phrase, by phrase."""

    def __init__(self, rows: pa.Table):
        phrase = [tuple(p) for p in rows.column("phrase").to_pylist()]
        number = {p: n for n, p in enumerate(dict.fromkeys(phrase))}
        self.phrases, of = Phrases(list(number)), np.array([number[p] for p in phrase], np.int64)
        order = np.argsort(of, kind="stable")
        rows, self.of = rows.take(pa.array(order)), of[order]
        ids = rows.column("query_id").combine_chunks().dictionary_encode()
        self.ids, self.q = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.agency, self.times = rows.column("q_orgao").to_pylist(), rows.column("times").to_numpy()
        self.types = [set(t) if t else None for t in rows.column("tipos").to_pylist()]
        self.first = np.searchsorted(self.of, np.arange(self.phrases.n + 1))  # where the rows of each phrase begin
        self._of_type: dict[str | None, np.ndarray] = {}

    def weigh(self, n: int, tokens: int, df: np.ndarray) -> None:
        """Weights from the number of chunks, of their tokens and of the chunks that hold each phrase."""
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), K.BM25_FLOOR)
        self.weight, self.avgdl = self.times * idf[self.of], tokens / max(n, 1)

    def of_type(self, kind: str | None) -> np.ndarray:
        """Which rows allow a type."""
        if kind not in self._of_type:
            self._of_type[kind] = np.array([t is None or (kind is not None and kind in t) for t in self.types], bool)
        return self._of_type[kind]

    def scored(self, tokens: pa.ListArray, kind: np.ndarray, kinds: list, agency: np.ndarray, agencies: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, row, score) of a batch, six digits, a part of its rows at once; kinds and agencies of rows go by number."""
        row, phrase, tf, dl = self.phrases.counts(tokens)
        fan = self.first[phrase + 1] - self.first[phrase]
        number = {a: n for n, a in enumerate(agencies) if a is not None}
        own = np.array([-1 if a is None else number.get(a, -2) for a in self.agency], np.int64)  # -1: any, -2: none of this batch
        fits = np.array([self.of_type(k) for k in kinds]).reshape(len(kinds), -1)
        first = np.r_[True, row[1:] != row[:-1]][: len(row)]  # of each row, which goes to the part of its first phrase
        part = (np.cumsum(fan) // STEP)[first][np.cumsum(first) - 1]
        for p in np.unique(part):
            here = part == p
            r, n = row[here], fan[here]
            which = np.repeat(self.first[phrase[here]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, t = np.repeat(r, n), np.repeat(tf[here], n)
            ok = fits[kind[r], which] & ((own[which] == -1) | (own[which] == agency[r]))
            r, t, which = r[ok], t[ok], which[ok]
            share = self.weight[which] * t * (K.BM25_K1 + 1) / (t + K.BM25_K1 * ((1 - K.BM25_B) + K.BM25_B * dl[r] / self.avgdl))
            key, place = np.unique(self.q[which] * len(dl) + r, return_inverse=True)
            yield key // len(dl), key % len(dl), np.floor(np.bincount(place, share, len(key)) * 1e6 + 0.5) / 1e6


class Best:
    """The best chunks of each question, or of each question and agency, that a task has seen; ties by chunk_id."""

    def __init__(self, limit: int, by_agency: bool):
        self.limit, self.by_agency, self.rows = limit, by_agency, FOUND.empty_table()
        self.code: dict[str | None, int] = {}
        self.full, self.floor = np.zeros(0, np.int64), np.zeros(0)  # keys that have had ``limit`` chunks, and the last one's score

    def keys(self, q: np.ndarray, agency: np.ndarray, agencies: list) -> np.ndarray:
        """A number for each row's question, or question and agency."""
        return q * 2**32 + np.array([self.code.setdefault(a, len(self.code)) for a in agencies], np.int64)[agency] if self.by_agency else q

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray, ids: pa.Array, agency: pa.Array) -> None:
        at = np.searchsorted(self.full, key)
        known = np.append(self.full, -1)[at] == key
        keep = ~known | (score >= np.append(self.floor, 0)[at])
        where = pa.array(row[keep])
        new = pa.Table.from_arrays([pa.array(q[keep]), ids.take(where), agency.take(where), pa.array(score[keep])], schema=FOUND)
        rows = pa.concat_tables([self.rows, new])
        by = ["q", "orgao"] if self.by_agency else ["q"]
        rows = rows.take(pc.sort_indices(rows, [*[(c, "ascending") for c in by], ("score", "descending"), ("chunk_id", "ascending")]))
        codes, names = coded(rows.column("orgao").combine_chunks())
        key = self.keys(rows.column("q").to_numpy(), codes, names)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        last = np.flatnonzero(place == self.limit - 1)
        full, floor = np.r_[self.full, key[last]], np.r_[self.floor, rows.column("score").to_numpy()[last]]
        order = np.lexsort((floor, full))
        order = order[np.r_[full[order][1:] != full[order][:-1], True][: len(full)]]  # the highest of each key
        self.full, self.floor = full[order], floor[order]
        self.rows = rows.filter(pa.array(place < self.limit))


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """A number for each value, null as another one, and the values by number."""
    held = values.dictionary_encode(null_encoding="encode")
    return held.indices.to_numpy(zero_copy_only=False), held.dictionary.to_pylist()


def _weighed(chunks: DataFrame, asked: Asked) -> None:
    """Give the questions their weights, from counts over all chunks."""
    sent = chunks.sparkSession.sparkContext.broadcast(asked.phrases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        total = np.zeros(phrases.n + 2, np.int64)  # chunks with each phrase, chunks, tokens
        for b in batches:
            _, phrase, _, length = phrases.counts(b.column(0))
            total += np.r_[np.bincount(phrase, minlength=phrases.n), len(length), length.sum()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["what", "n"])

    counted = chunks.select(index_tokens(F.col("texto")).alias("t")).mapInArrow(work, "what long, n long").groupBy("what").agg(F.sum("n").alias("n"))
    total = np.zeros(asked.phrases.n + 2, np.int64)
    for r in counted.collect():
        total[r["what"]] = r["n"]
    asked.weigh(int(total[-2]), int(total[-1]), total[:-2])


def search(chunks: DataFrame, terms: pa.Table, limit: int, by_agency: bool = False) -> DataFrame:
    """(query_id, chunk_id, orgao, score): of chunks a superset of the ``limit`` best by BM25 of each question, of all or of each agency.

    ``terms`` are those of search.query_terms, as many as may be sent to all tasks. The caller ranks what comes out: ``limit`` chunks a question
    (and agency) of each task, or a few times as many where they are more than MOST_KEPT.
    """
    spark, asked = chunks.sparkSession, Asked(terms)
    if not len(asked.q):
        return spark.createDataFrame([], "query_id string, chunk_id string, orgao string, score double")
    _weighed(chunks, asked)
    sent = spark.sparkContext.broadcast(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = sent.value, Best(limit, by_agency)

        def out() -> Iterator[pa.RecordBatch]:
            rows = best.rows
            found = pa.table({"query_id": asked.ids.take(rows.column("q").combine_chunks()), **{c: rows.column(c) for c in ("chunk_id", "orgao", "score")}})
            yield from found.combine_chunks().to_batches()
            best.rows = FOUND.empty_table()

        for b in batches:
            agency, agencies = coded(b.column("orgao"))
            kind, kinds = coded(b.column("tipo_documento"))
            for q, row, score in asked.scored(b.column("t"), kind, kinds, agency, agencies):
                best.add(q, score, best.keys(q, agency[row], agencies), row, b.column("chunk_id"), b.column("orgao"))
            if best.rows.num_rows > MOST_KEPT:
                yield from out()
        yield from out()

    return chunks.select("chunk_id", "orgao", "tipo_documento", index_tokens(F.col("texto")).alias("t")).mapInArrow(work, "query_id string, chunk_id string, orgao string, score double")

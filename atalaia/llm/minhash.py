"""MinHash near-duplicates with sequential Bayesian verification.

Distinct sets of shingles get signatures of BANDS * ROWS bytes and are dealt by bands, so that sets which have a band in common
meet (``deals``). A pair is compared batch by batch of its signatures: after each, the posterior of its likeness, from a uniform
prior and the matches so far, tells with which probability it still reaches the least likeness; below MISS the pair goes.
What survives all batches is verified on full sets. At the least likeness, 0.85, a pair has no band in common with probability 1.5e-7, and
is pruned with less than BATCHES * MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .deals import dealt, labels
from .shingling import key_of, shingles, signature

#: Bytes of a band and bands of a signature; bands of a batch.
ROWS, BANDS, BATCH = 7, 40, 8
#: Sets are linked from a likeness of ``NUM / DEN`` on.
NUM, DEN = 17, 20
#: Posterior probability of the least likeness below which a pair is pruned.
MISS = 1e-7


def posterior(matches: int, n: int, least: float) -> float:
    """Probability that a rate is ``least`` or more, after so many matches of ``n`` and from a uniform prior.

    The posterior is a Beta distribution of whole parameters, so its tail is a sum of binomial terms.
    """
    return sum(comb(n + 1, k) * least**k * (1 - least) ** (n + 1 - k) for k in range(matches + 1))


class Bayes:
    """The sift of signatures by batches (see ``deals.Sift``)."""

    def __init__(self, num: int = NUM, den: int = DEN, miss: float = MISS, size: int = ROWS * BANDS, batch: int = ROWS * BATCH) -> None:
        self.num, self.den = num, den
        least = num / den + (1 - num / den) / 256  # bytes are equal by chance too
        self.batches = [(i, min(i + batch, size)) for i in range(0, size, batch)]
        #: Matches after each batch that a pair needs at least.
        self.floors = [next(m for m in range(end + 1) if posterior(m, end, least) >= miss) for _, end in self.batches]

    def open(self, sketches: list[bytes], group: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)

    def rest(self, held: np.ndarray, n: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(j), np.int64)
        for (a, b), floor in zip(self.batches, self.floors, strict=True):
            total += (held[j, a:b] == held[i, a:b]).sum(1)
            stay = total >= floor
            j, total = j[stay], total[stay]
        return j

    def pairs(self, x: list[bytes], y: list[bytes], n: np.ndarray) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (x, y))
        live, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for (a, b), floor in zip(self.batches, self.floors, strict=True):
            total += (x[live, a:b] == y[live, a:b]).sum(1)
            stay = total >= floor
            live, total = live[stay], total[stay]
        out = np.zeros(len(x), bool)
        out[live] = True
        return out


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, n, fp) of (doc_id, text): the text's hash, the set's name, members and signature; without words n is 0, key and fp null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) if t.strip(" \t\n\x0b\f\r") else None for t in b.column(1).to_pylist()]
            keys = pa.array([None if s is None else key_of(s) for s in sets], pa.int64())
            sizes = pa.array([0 if s is None else len(s) for s in sets], pa.int32())
            fp = pa.array([None if s is None else signature(s, ROWS * BANDS) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), keys, sizes, fp], ["doc_id", "mark", "key", "n", "fp"])

    return rows.mapInArrow(work, "doc_id long, mark long, key long, n int, fp binary")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Sets of distinct five-word shingles (one of fewer words, if a text has not five) are linked from a likeness of ``num / den`` on;
    bands are made for likenesses of 0.85 and more. component_id is the least doc_id reachable over links, kept whether that is the row's own. Texts without words,
    null ones too, have no shingles and are linked with nothing. Repeated rows stay, and equal texts are of one component; a null doc_id takes
    its component's least id, and where there is none component_id is null and the row kept. Other columns are not read.
    """
    prepare(docs.sparkSession)
    marks = cut(marked(docs))
    sets = cut(marks.filter("n > 0").groupBy("key").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    label = labels(dealt(sets, "fp", ROWS * BANDS, ROWS), docs, sets, Bayes(num, den, miss))
    nodes = cut(sets.select("key", "least").join(label.withColumnRenamed("node", "key"), "key", "left"))
    whole = nodes.filter("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    linked = nodes.filter("label is not null").join(whole, "label").select("key", "component_id")
    of = cut(linked.unionByName(nodes.filter("label is null").select("key", F.col("least").alias("component_id"))))
    found = marks.filter("n > 0").join(of, "key").select("doc_id", "n", "component_id").unionByName(marks.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

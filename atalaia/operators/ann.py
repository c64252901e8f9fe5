"""Vector search by cells: a coarse quantiser, vectors stored by cell, cells pruned by the scan, candidates ranked exactly.

Centroids are learned from a bounded sample; every vector is put into the cell of its nearest centroid and written there, beside each cell's
radius: the greatest angle between its centroid and a vector. A question looks into so many of the nearest cells as sampled
questions needed for a recall of 0.95, and what it finds there is ranked by exact cosine. In exact mode the score of its last place then tells which other cells may still hold
something better (a vector is no nearer to the question than its centroid's angle less the radius), and these are searched too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rounded
from . import blocks
from .search import dense_cosine, sent_questions, small, top

#: Vectors that centroids are learned from at most, cells at most (centroids go to every task), and vectors that a cell should have.
SAMPLE, MOST_CELLS, CELL = 20_000, 4096, 256
#: Recall that the number of cells to look into is chosen for, sampled questions it is measured with, and cells named in the scan's filter at most.
RECALL, QUESTIONS, MOST_NAMED = 0.95, 100, 1000
_SCHEMA = "query_id {0}, query array<double>, cell int"


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Unit centroids, a row a cell, by k-means on at most ``sample`` vectors: those of least hash, the same in every run.

    Without ``cells`` there are as many as give each about CELL vectors, at most MOST_CELLS. Fewer come out where vectors are equal.
    """
    rows = vectors.select("id", "vector", F.sqrt(_dot(F.col("vector"), F.col("vector"))).alias("norm")).filter("norm > 0")
    n = cells or int(np.clip(vectors.count() // CELL, 1, MOST_CELLS))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    if some.isEmpty():
        raise ValueError("no vector has a length")
    if n == 1:
        mean = np.mean([r["features"].toArray() / np.linalg.norm(r["features"].toArray()) for r in some.toLocalIterator()], axis=0)
        found = mean[None] if np.linalg.norm(mean) > 0 else np.eye(1, len(mean))
    else:
        found = np.array(KMeans(k=n, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some).clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    if any(r is None or len(r) != width for r in rows):
        raise ValueError(f"vectors must have {width} numbers")
    return np.array(rows, float).reshape(len(rows), width)


def assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, vector, cell, angle): each vector's nearest cell (ties: the first) and its angle to the centroid. Vectors of length 0 have cell -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), centers.shape[1])
            norm = np.linalg.norm(x, axis=1)
            near = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0) @ centers.T
            cell = np.where(norm > 0, near.argmax(1), -1).astype(np.int32)
            angle = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], ["id", "vector", "cell", "angle"])

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "vector").mapInArrow(work, f"id {kinds['id']}, vector {kinds['vector']}, cell int, angle double")


def probes(rows: DataFrame, centers: np.ndarray, recall: float = RECALL, questions: int = QUESTIONS, limit: int = 30) -> int:
    """Cells to look into for a recall: so many that of the nearest ``limit`` of all (id, vector, cell), for sampled questions, that share lies in them.

    Questions are the vectors of least hash, ``questions`` of them at most, each asked of every vector.
    """
    asked = rows.filter("cell >= 0").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(questions).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    near = dense_cosine(rows.select("id", "vector", "cell").filter("cell >= 0"), asked, limit, "id", "vector").select("query_id", "id")
    found = near.join(rows.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(asked, "query_id").collect()
    ranks = []
    for r in found:  # ``questions`` rows of ``limit`` cells
        order = np.argsort(-(np.array(r["query"], float) @ centers.T), kind="stable")
        ranks += np.argsort(order)[r["cells"]].tolist()
    return int(np.quantile(ranks, recall, method="higher")) + 1


def write(vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 1, recall: float = RECALL) -> None:
    """Write the index of (id, vector) below ``folder``: vectors by cell, and centroids with radius, number of vectors and the cells to look into for ``recall``.

    Every vector is written. A cell with very many has several files, as rows are dealt by ranges of cell and id.
    """
    spark, place = vectors.sparkSession, folder.rstrip("/")
    centers = centroids(vectors, cells, sample, seed)
    rows = assigned(vectors, centers)
    rows.repartitionByRange("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{place}/vectors")
    of = spark.read.parquet(f"{place}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    own = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    probe = probes(spark.read.parquet(f"{place}/vectors"), centers, recall)
    own.join(of, "cell").withColumn("probe", F.lit(probe)).coalesce(1).write.mode("overwrite").parquet(f"{place}/centroids")


@dataclass
class Cells:
    """A written index."""

    vectors: DataFrame
    cell: np.ndarray
    centers: np.ndarray
    radius: np.ndarray
    #: Cells that a question looks into unless it is told otherwise.
    probe: int

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Cells:
        rows = spark.read.parquet(f"{folder.rstrip('/')}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        held = [np.array([r[c] for r in rows]) for c in ("cell", "centroid", "radius")]
        return cls(spark.read.parquet(f"{folder.rstrip('/')}/vectors"), *held, rows[0]["probe"])


def _cells(index: Cells, asked: DataFrame, probe: int, beyond: bool) -> DataFrame:
    """(query_id, query, cell): the ``probe`` nearest cells of each question; or with ``beyond`` those others that may hold a vector of ``last`` or more."""
    kind = dict(asked.dtypes)["query_id"]
    centers, radius, cell = index.centers, index.radius, index.cell

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), centers.shape[1])
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            near = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) @ centers.T
            order = np.argsort(-near, axis=1, kind="stable")
            if beyond:
                best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))
                last = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                wanted = best >= np.where(np.isnan(last), -2, last)[:, None] - 1e-6  # scores are rounded
                np.put_along_axis(wanted, order[:, :probe], False, axis=1)
            else:
                wanted = np.zeros(near.shape, bool)
                np.put_along_axis(wanted, order[:, :probe], True, axis=1)
            wanted &= norm > 0
            i, j = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(cell[j].astype(np.int32))], ["query_id", "query", "cell"])

    rows = asked.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"), *(["last"] if beyond else []))
    return rows.mapInArrow(work, _SCHEMA.format(kind))


@dataclass
class Looked:
    """Which questions look into a cell: those that have it among their ``probe`` nearest, or with ``last`` those others that may find a vector of that score or more in it."""

    cell: np.ndarray
    centers: np.ndarray
    radius: np.ndarray
    probe: int
    #: Scores of the questions' last places, NaN where there is none.
    last: np.ndarray | None = None

    def __call__(self, cell: int, asked: blocks.Asked) -> np.ndarray:
        at = np.flatnonzero(self.cell == cell)
        if not len(at):
            return at
        if not hasattr(asked, "nearness"):  # of the last cell to look into, once a task
            k = len(self.cell) - self.probe
            asked.nearness = np.concatenate([np.partition(asked.unit[i : i + blocks.STEP] @ self.centers.T, k, axis=1)[:, k] for i in range(0, len(asked.unit), blocks.STEP)])
        near = asked.unit @ self.centers[at[0]]
        first = near >= asked.nearness - 1e-12
        if self.last is not None:
            best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - self.radius[at[0]], 0))
            first = ~first & (best >= np.where(np.isnan(self.last), -2, self.last) - 1e-6)  # scores are rounded
        return np.flatnonzero(first & (asked.norm > 0))


def _in_blocks(index: Cells, asked: blocks.Asked, limit: int, probe: int, exact: bool) -> DataFrame:
    """search() of questions that go to every task."""
    own = Looked(index.cell, index.centers, index.radius, probe)
    ranked = lambda of: top(blocks.nearest(index.vectors, asked, limit, of), limit, F.desc("score"), F.col("id"))
    first = ranked(own)
    if not exact or probe == len(index.cell):
        return first
    first = first.cache()
    last = dict(first.filter(F.col("posicao") == limit).select("query_id", "score").toArrow().to_pandas().itertuples(index=False))  # a row a question
    more = ranked(replace(own, last=np.array([last.get(i, np.nan) for i in asked.ids.to_pylist()], float)))
    return top(first.drop("posicao").unionByName(more.drop("posicao")), limit, F.desc("score"), F.col("id"))


def _ranked(index: Cells, wanted: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, posicao) of the vectors in the wanted cells of each question."""
    named = [r["cell"] for r in wanted.select("cell").distinct().limit(MOST_NAMED + 1).collect()]
    rows = index.vectors.filter(F.col("cell").isin(named)) if len(named) <= MOST_NAMED else index.vectors
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    rows = rows.select("id", "vector", "cell", norm("vector").alias("norm"))
    pairs = rows.join(small(wanted.withColumn("query_norm", norm("query"))), "cell")
    score = F.try_divide(_dot(F.col("vector"), F.col("query")), F.col("norm") * F.col("query_norm"))
    return top(pairs.select("query_id", "id", rounded(score, 6).alias("score")), limit, F.desc("score"), F.col("id"))


def search(index: Cells, asked: DataFrame, limit: int = 30, probe: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, score, posicao): the best vectors by cosine for each question (query_id, query), six digits, ties by id.

    ``probe`` cells are looked into (those that the index was measured to need, if it is not given). With ``exact`` all others that may hold a better vector are too, so the result is that of
    a scan of all vectors. Vectors and questions of length 0 are not found and find nothing.
    """
    n = min(probe or index.probe, len(index.cell))
    held = sent_questions(asked)
    if held and held.width == index.centers.shape[1]:
        return _in_blocks(index, held, limit, n, exact)
    first = _ranked(index, _cells(index, asked, n, False), limit)
    if not exact:
        return first
    first = first.cache()
    last = first.filter(F.col("posicao") == limit).select("query_id", F.col("score").alias("last"))
    more = _ranked(index, _cells(index, asked.join(last, "query_id", "left"), n, True), limit)
    return top(first.drop("posicao").unionByName(more.drop("posicao")), limit, F.desc("score"), F.col("id"))

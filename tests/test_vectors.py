"""Murmur3 against published values and a second implementation; search by cells against all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaia.functions import murmur
from atalaia.operators import ann, search

#: Published values of MurmurHash3 x86 32 bit with seed 0.
KNOWN = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "Hello, world!": 0xC0363E43, "test": 0xBA6BD213, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}


def second(data: bytes) -> int:
    h, turn = 0, lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        if len(data) - i >= 4:
            h = (turn(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def test_murmur3(spark):
    texts = [*KNOWN, *("x" * n for n in range(20)), "ção", "é", "日本語", "ab\x00c", "ß" * 7]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", murmur.murmur3(F.col("t")).alias("h"), murmur.murmur_bucket(F.col("t"), 384).alias("b")).collect()
    got = {r.t: (r.h, r.b) for r in rows}
    assert all(got[t][0] & 0xFFFFFFFF == h for t, h in KNOWN.items())
    assert all(got[t] == (second(t.encode()), abs(second(t.encode())) % 384) for t in texts) and got[None] == (None, None)


def test_murmur_embedding(spark):
    row = spark.createDataFrame([("plano plano de risco",)], "t string").select(search.murmur_embedding(F.col("t"), 50).alias("v")).first()
    want = {}
    for w in "plano plano de risco".split():
        want[abs(second(w.encode())) % 50] = want.get(abs(second(w.encode())) % 50, 0) + 1
    norm = np.sqrt(sum(c * c for c in want.values()))
    assert [(e.bucket, e.weight) for e in row.v] == [(b, pytest.approx(c / norm)) for b, c in sorted(want.items())]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 24))
    x = np.concatenate([centers[r.integers(0, 40, 1500)] + 0.4 * r.normal(size=(1500, 24)), np.repeat(centers[:1], 300, 0), np.zeros((3, 24))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    folder = str(tmp_path_factory.mktemp("cells"))
    ann.write(vectors, folder, cells=32, sample=600)
    asked = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors, ann.Cells.read(spark, folder), asked


def test_every_vector_is_stored(spark, index):
    vectors, cells, _ = index
    assert cells.vectors.count() == vectors.count() and cells.vectors.filter("cell = -1").count() == 3
    near = cells.centers @ cells.centers.T
    assert len(cells.cell) <= 32 and np.allclose(np.diag(near), 1)


def test_exact_mode_and_recall(spark, index):
    vectors, cells, asked = index
    want = {}
    for r in search.dense_cosine(vectors, asked, 30, "id", "vector").filter("score is not null").collect():
        want.setdefault(r.query_id, []).append((r.posicao, r.id, r.score))
    got, some = {}, {}
    for out, rows in ((got, ann.search(cells, asked, 30, exact=True)), (some, ann.search(cells, asked, 30))):
        for r in rows.collect():
            out.setdefault(r.query_id, []).append((r.posicao, r.id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in some[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    one = ann.search(cells, asked.limit(1), 30, probe=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "cell#" in plan.split("PartitionFilters")[1][:200]


def test_recall_on_the_embeddings(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ann.write(vectors, str(tmp_path), cells=16)
    asked = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    cells = ann.Cells.read(spark, str(tmp_path))
    exact = {(r.query_id, r.id) for r in search.dense_cosine(vectors, asked, 30, "id", "vector").collect()}
    found = {(r.query_id, r.id) for r in ann.search(cells, asked, 30).collect()}
    print("recall", len(found & exact) / len(exact), cells.probe)
    assert len(found & exact) / len(exact) >= 0.9


def test_odd_vectors(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, vector array<float>")
    with pytest.raises(ValueError, match="length"):
        ann.write(rows((1, [0.0, 0.0])), str(tmp_path / "a"))
    ann.write(rows((1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])), str(tmp_path / "b"))
    cells = ann.Cells.read(spark, str(tmp_path / "b"))
    asked = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, query array<float>")
    assert [(r.query_id, r.id, r.score) for r in ann.search(cells, asked, 3, exact=True).orderBy("posicao").collect()] == [("q", 1, 1.0), ("q", 1, 1.0), ("q", 2, 0.0)]

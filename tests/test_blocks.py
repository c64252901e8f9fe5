"""Many questions in blocks against the same questions one by one in a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaia.operators import blocks, search

SIZE = 24


def sparse(r, n, signed):
    return sorted((b, (r.random() * 2 - 1) if signed else r.random()) for b in r.sample(range(SIZE), n))


def plain(chunks, asked, limit, by_agency):
    out = []
    for qid, agency, types, qv in asked:
        lists = {}
        for cid, orgao, kind, v in chunks:
            if (types and kind not in types) or (agency is not None and orgao != agency):
                continue
            w = dict(v or [])
            dot = sum(x * w.get(b, 0) for b, x in qv)
            if dot:
                lists.setdefault(orgao if by_agency else None, []).append((-(np.floor(dot * 1e6 + 0.5) / 1e6), cid))
        for found in lists.values():
            out += [(qid, cid, -s, n + 1) for n, (s, cid) in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("by_agency", [False, True])
def test_blocks_equal_a_plain_loop(spark, monkeypatch, signed, by_agency):
    """Ties, equal vectors, null vectors, agencies and types, questions that fit nothing; small blocks, so that scores of earlier ones count."""
    r = random.Random(3)
    same = sparse(r, 5, signed)
    chunks = [(f"c{i:04d}", r.choice(["A", "B", None]), r.choice(["ata", "pg", None]), same if i % 5 == 0 else sparse(r, r.randrange(0, 9), signed)) for i in range(400)] + [("null", "A", "ata", None)]
    r.shuffle(chunks)
    asked = [(f"q{i:03d}", r.choice([None, None, "A", "Z"]), r.choice([None, None, [], ["ata"], ["ata", "x"]]), same if i % 9 == 0 else sparse(r, r.randrange(0, 7), signed)) for i in range(70)]
    kind = "array<struct<bucket:int,weight:double>>"
    vectors = spark.createDataFrame(chunks, f"chunk_id string, orgao string, tipo_documento string, vector {kind}").repartition(3)
    rows = spark.createDataFrame(asked, f"query_id string, q_orgao string, tipos array<string>, qv {kind}").toArrow()
    monkeypatch.setattr(blocks, "BLOCK", 50 * SIZE)
    got = search.top(blocks.search(vectors, rows, SIZE, 7, by_agency), 7, F.desc("score"), F.col("chunk_id"), keys=("query_id", "orgao") if by_agency else ("query_id",))
    assert sorted((x.query_id, x.chunk_id, x.score, x.posicao) for x in got.collect()) == plain(chunks, asked, 7, by_agency)


def test_no_chunks_and_no_questions(spark):
    kind = "array<struct<bucket:int,weight:double>>"
    vectors = spark.createDataFrame([], f"chunk_id string, orgao string, tipo_documento string, vector {kind}")
    rows = spark.createDataFrame([], f"query_id string, q_orgao string, tipos array<string>, qv {kind}").toArrow()
    assert blocks.search(vectors, rows, SIZE, 3).count() == 0


def test_both_plans_agree(spark, monkeypatch):
    """In blocks, and joined by bucket; a question has the same rows beside few and many others."""
    texts = ["plano de integridade", "canal de denúncia", "plano de risco e plano de metas", "", "integridade"]
    chunks = spark.createDataFrame([(f"c{i}", "A", "ata", t) for i, t in enumerate(texts * 3)], "chunk_id string, orgao string, tipo_documento string, texto string")
    index = search.Index(chunks, None, None, search.vectors(chunks))
    asked = search.questions(spark, [(f"q{i}", t, None, None) for i, t in enumerate(["plano", "denúncia de risco", "integridade"] * 10)])
    some = asked.filter("query_id < 'q2'")
    in_blocks = search.semantic(index, asked, 5)
    plan = in_blocks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = sorted(map(tuple, in_blocks.collect()))
    few = sorted(map(tuple, search.semantic(index, some, 5).collect()))
    monkeypatch.setattr(blocks, "MOST_CELLS", 0)
    assert sorted(map(tuple, search.semantic(index, asked, 5).collect())) == want
    assert few and few == [x for x in want if x[0] in {r.query_id for r in some.collect()}]


def test_dense_questions_in_blocks(spark, monkeypatch):
    """In blocks as joined: ties, vectors without length, null numbers and other lengths; cells in exact mode find the same."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None), (302, [1.0, None, 1.0, 1.0]), (303, [1.0]), (304, [])]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = vectors.filter("id % 10 = 0 and size(vector) = 4").selectExpr("id as query_id", "vector as query")
    found = lambda limit: sorted(map(str, search.dense_cosine(vectors, asked, limit, "id", "vector").collect()))
    plan = search.dense_cosine(vectors, asked, 5, "id", "vector")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = [found(5), found(400)]
    monkeypatch.setattr(blocks, "MOST_CELLS", 0)
    assert got == [found(5), found(400)]

"""The versioned index: keyed upserts against a rebuild, old versions, failed and repeated batches, two writers, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaia.operators import search
from atalaia.sources import sinks, store

DOCS = "document_id string, orgao string, tipo_documento string, text string, at int"


def rows(spark, some):
    return spark.createDataFrame([(k, "A", "ata", t, at) for k, t, at in some], DOCS)


def held(s, version=None):
    return sorted((x.document_id, x.text) for x in s.table("documents", version).collect())


def contents(s):
    index = s.read()
    tables = [index.chunks.drop("segment"), index.postings, index.vectors, s.term_stats(), index.corpus_stats]
    return [sorted(str(sorted(r.asDict().items())) for r in t.collect()) for t in tables]


ONE = [("a", "plano de integridade um", 1), ("b", "risco e plano", 1), ("c", "nada", 1), ("a", "velho", 0), (None, "sem id", 1)]
TWO = [("b", "risco novo novo", 5), ("b", "risco velho", 2), ("d", "plano plano plano", 5), ("e", None, 5)]


def test_batches_equal_a_rebuild(spark, tmp_path):
    s, other = store.Store(spark, str(tmp_path / "s")), store.Store(spark, str(tmp_path / "o"))
    assert s.version() == 0 and s.manifest()["segments"] == []
    assert s.upsert(rows(spark, ONE), "at") == 1 and s.upsert(rows(spark, TWO), "at") == 2
    first = s.read(1)
    ids = spark.createDataFrame([("c",), ("zz",)], "document_id string")
    assert s.delete(ids) == 3 == s.version()
    assert held(s) == [("a", "plano de integridade um"), ("b", "risco novo novo"), ("d", "plano plano plano"), ("e", None)]
    assert s.upsert(rows(spark, [("c", "voltou", 1)]), "at") == 4 and held(s)[2] == ("c", "voltou")
    other.rebuild(rows(spark, [*ONE[:1], *TWO[:1], *TWO[2:], ("c", "voltou", 1)]), "at")
    assert contents(s) == contents(other)
    ask = lambda index, q: [(x.query_id, x.score) for x in search.bm25(index, search.questions(spark, [(q, q, None, None)])).collect()]
    assert ask(s.read(), "plano novo") == ask(other.read(), "plano novo") != []
    assert ask(first, "novo") == [] and len(ask(first, "nada")) == 1  # a search that began before sees its own version
    was = contents(s)
    assert s.stale() and s.compact() == 5 and contents(s) == was and not s.stale()
    assert s.drop_old(1) == [1, 2, 3, 4] and contents(s) == was and len(s.files.names("segments")) == 1
    with pytest.raises(Exception, match="manifests|does not exist"):
        s.table("documents", 1).collect()


def test_failed_builds_and_two_writers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path))
    s.upsert(rows(spark, ONE), "at")
    was = contents(s)
    bad = rows(spark, TWO).withColumn("text", F.when(F.col("document_id") == "d", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for broken in ("docs", "postings"):
        with monkeypatch.context() as m:
            if broken == "postings":
                m.setattr(search, "write_postings", lambda *a: (_ for _ in ()).throw(OSError("full")))
            with pytest.raises(Exception, match="broken|full"):
                s.upsert(bad if broken == "docs" else rows(spark, TWO), "at")
        assert s.version() == 1 and contents(s) == was
    real = search.write_postings

    def late(*a):  # another writer publishes meanwhile
        monkeypatch.setattr(search, "write_postings", real)
        store.Store(spark, str(tmp_path)).upsert(rows(spark, [("z", "outro", 1)]), "at")
        real(*a)

    monkeypatch.setattr(search, "write_postings", late)
    with pytest.raises(store.Conflict):
        s.upsert(rows(spark, TWO), "at")
    assert s.version() == 2 and [k for k, _ in held(s)] == ["a", "b", "c", "z"]
    s.drop_old(2)
    assert len(s.files.names("segments")) == 2 and s.files.names("drafts") == []
    with pytest.raises(ValueError):
        store.Store(spark, str(tmp_path), size=50).upsert(rows(spark, TWO), "at")


def test_streams_feed_each_file_once(spark, tmp_path):
    s, folder = store.Store(spark, str(tmp_path / "s")), tmp_path / "in"
    stream = lambda: spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    rows(spark, ONE).coalesce(1).write.parquet(str(folder))
    assert s.feed(stream(), "in", str(tmp_path / "c"), order="at") == 1
    rows(spark, TWO).coalesce(1).write.mode("append").parquet(str(folder))
    assert s.feed(stream(), "in", str(tmp_path / "c"), order="at") == 2
    was = contents(s)
    assert s.feed(stream(), "in", str(tmp_path / "c"), order="at") == 2
    assert s.upsert(rows(spark, TWO), "at", ("in", 1)) == 2 and s.upsert(rows(spark, ONE), "at", ("in", 0)) == 2  # as Spark repeats them after a failure
    assert contents(s) == was
    other = store.Store(spark, str(tmp_path / "o"))
    other.rebuild(rows(spark, [*ONE[:1], *ONE[2:3], *TWO[:1], *TWO[2:]]), "at")
    assert contents(s) == contents(other)


def test_last_of(spark):
    got = store.last_of(rows(spark, ONE + TWO), "document_id", "at")
    assert got.columns == ["document_id", "orgao", "tipo_documento", "text"]
    assert sorted((x.document_id, x.text or "") for x in got.collect()) == [("a", "plano de integridade um"), ("b", "risco novo novo"), ("c", "nada"), ("d", "plano plano plano"), ("e", "")]


def test_embedder_by_argument(spark, tmp_path):
    lengths = search.batch_embedder("letters", lambda texts: np.array([[t.lower().count(c) for c in "abcdefgh"] for t in texts]))
    s = store.Store(spark, str(tmp_path), dimensions=8, embed=lengths)
    s.upsert(rows(spark, [("x", "aaa b", 1), ("y", "hhh g", 1), ("z", None, 1), ("w", "123", 1)]), "at")
    found = search.semantic(s.read(), search.questions(spark, [("q", "hg", None, None)])).collect()
    assert len(found) == 1 and found[0].score == pytest.approx(4 / np.sqrt(20), abs=1e-6)
    with pytest.raises(ValueError, match="letters"):
        store.Store(spark, str(tmp_path), dimensions=8).read()
    with pytest.raises(Exception, match="dimensions"):
        store.Store(spark, str(tmp_path / "o"), dimensions=9, embed=lengths).upsert(rows(spark, ONE), "at")


def test_index_of_repeated_ids(spark, tmp_path):
    sinks.write_index(rows(spark, ONE + TWO), str(tmp_path), order="at")
    got = {x.document_id: x.text for x in spark.read.parquet(str(tmp_path / "documents")).collect()}
    assert got == {"a": "plano de integridade um", "b": "risco novo novo", "c": "nada", "d": "plano plano plano", "e": None}

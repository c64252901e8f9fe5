"""Cache of extracted pages, listings, retries and shown numbers."""

import shutil

import pytest
from pyspark.sql import functions as F

from atalaia.functions import text
from atalaia.operators import chunking, classify, keywords, search
from atalaia.sources import readers, sinks


def test_cached_pages(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    log.mkdir()

    def read(content: bytes, most: int) -> list[str]:
        (log / content.decode().replace(" ", "_")).open("a").write("x")
        return content.decode().split("|")[:most]

    def run(rows, most=9):
        files = spark.createDataFrame(rows, "caminho string, content binary")
        return sorted(map(tuple, readers.cached_pages(files, cache, [read], most).collect()))

    a, b, none = ("a", bytearray(b"Um|dois")), ("b", bytearray(b"Um|dois")), ("c", bytearray(b"  "))
    assert run([a, b, none, ("n", None)]) == [("a", 1, "um"), ("a", 2, "dois"), ("b", 1, "um"), ("b", 2, "dois")]
    assert run([a, none, ("d", bytearray(b"Tres"))]) == [("a", 1, "um"), ("a", 2, "dois"), ("d", 1, "tres")]
    assert {f.name: f.read_text() for f in log.iterdir()} == {"Um|dois": "x", "__": "x", "Tres": "x"}
    assert run([a], 1) == [("a", 1, "um")]
    assert run([]) == []


def test_listed_agencies(spark, tmp_path):
    for name in ("cig/BBB/x.pdf", "pg/AAA/y.PDF", "pg/BBB/z.pdf", "pg/CCC/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert readers.listed_agencies(spark, str(tmp_path)) == ["AAA", "BBB"]


def test_retried():
    waits, calls = [], []

    def f(after):
        calls.append(1)
        if len(calls) < after:
            raise OSError(len(calls))
        return "ok"

    assert readers.retried(lambda: f(3), 3, 0.5, waits.append) == "ok" and waits == [0.5, 1.0]
    calls.clear()
    with pytest.raises(OSError):
        readers.retried(lambda: f(9), 2, 0.5, waits.append)
    calls.clear()
    assert readers.retried(lambda: f(1), 0) == "ok"


def test_shown_numbers_and_selection(spark):
    rows = spark.createDataFrame([("1.005e1", 1234567, ["B1_acao", "x"]), ("x", None, []), (None, 0, None)], "a string, n long, b array<string>")
    got = rows.select(text.two_places(F.col("a")), text.dotted(F.col("n")), text.booster_names(F.col("b"))).collect()
    assert list(map(tuple, got)) == [("10.05", "1.234.567", "acao, x"), ("0.00", "0", "-"), ("0.00", "0", "-")]
    assert classify.selected(rows, a=["x"], n=None, z=["q"]).count() == 1


def test_criteria_files(spark, tmp_path):
    def read(value):
        (tmp_path / "c.json").write_text(value)
        return [r["codigo"] for r in readers.criteria(spark, str(tmp_path / "c.json")).collect()]

    assert read('{"criterios": [{"codigo": "A"}]}') == ["A"] and read(' [{"codigo": "B"}, {"titulo": "x"}]') == ["B"]
    assert read("{}") == [] and read('{"outra": [1]}') == [] and read("[]") == []
    for bad in ('"x"', "3", '{"criterios": {"codigo": "A"}}', '{"criterios": "A"}'):
        with pytest.raises(ValueError):
            read(bad)


def test_write_summary(spark, tmp_path):
    docs = spark.createDataFrame([("1", "A", "t", "um dois um"), ("2", "B", "t", "nada"), ("3", "B", "t", None)], "document_id string, orgao string, tipo_documento string, text string")
    by_page = keywords.counts_by_page(chunking.pages(docs), ["um", "dois", "zzz"])
    at = sinks.write_summary(docs, by_page, ["um", "dois", "zzz"], str(tmp_path))
    row = spark.read.json(at["summary_results"]).first().asDict(True)
    assert row["contagem_keywords_geral"] == {"um": 2, "dois": 1, "zzz": 0} and row["porcentagem_keywords_geral"] == {"um": 50.0, "dois": 25.0, "zzz": 0.0}
    assert [x["keyword"] for x in row["top_keywords_geral"]] == ["um", "dois", "zzz"] and row["resumo_geral"]["documentos"] == 3
    agencies = {r["orgao"]: r for r in spark.read.json(at["estatisticas_por_orgao"]).collect()}
    assert [x["keyword"] for x in agencies["A"]["top_keywords"]] == ["um", "dois"] and agencies["B"]["top_keywords"] == []


def test_retrieve_without_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("1", "A", "t", "plano de integridade publicado"), ("2", "B", "t", "outra coisa inteiramente")], "document_id string, orgao string, tipo_documento string, text string")
    sinks.write_index(docs, str(tmp_path))
    asked = search.questions(spark, [("q", "plano de integridade", None, None)])
    found, said = search.retrieve(spark, str(tmp_path), asked)
    whole = [r["fontes"] for r in found.orderBy("rank").collect()]
    assert said["semantica"]["enabled"] and "semantica" in whole[0]
    shutil.rmtree(tmp_path / "vectors")
    found, said = search.retrieve(spark, str(tmp_path), asked)
    assert [(r["documento"], r["fontes"]) for r in found.collect()] == [("1", ["lexical"])]
    assert said["semantica"] == {"enabled": False, "reason": "vetores ausentes"}
    with pytest.raises(ValueError):
        search.retrieve(spark, str(tmp_path), search.questions(spark, [("q", "  ", None, None)]))

"""Collection by agency and hits of a search, on small tables."""

import pytest
from pyspark.sql import functions as F

from atalaia.functions import constants as K
from atalaia.operators import collection, web

REGISTRY = "sigla string, link string, possui_atas boolean, possui_repositorio boolean"


@pytest.mark.parametrize(
    "minutes,found,repository,want",
    [(True, True, False, K.CHECK_OK), (True, False, False, K.CHECK_CONFLICT), (False, True, None, K.CHECK_CONFLICT), (None, None, None, K.CHECK_OK), (None, False, True, K.CHECK_EMPTY), (False, True, True, K.CHECK_OK)],
)
def test_result_check(spark, minutes, found, repository, want):
    rows = spark.createDataFrame([(minutes, found, repository)], "m boolean, f boolean, r boolean")
    assert rows.select(collection.result_check(F.col("m"), F.col("f"), F.col("r"))).first()[0] == want


def test_flow(spark):
    agencies = spark.createDataFrame([("A", "u", True, False), ("B", "u", None, True), ("C", None, True, None), ("D", "", False, False), ("E", "u", False, False)], REGISTRY)
    held = spark.createDataFrame([("a", "cig"), ("A", "cig"), ("B", "pg"), ("B", None), (None, "pg"), ("E", "pg"), ("E", "compliance")], "sigla string, tipo string")
    found = spark.createDataFrame([("B", 3)], "sigla string, links long")
    got = {r["sigla"]: tuple(r)[1:] for r in collection.flow(agencies, held, found).collect()}
    assert got["A"] == ("ja_coletado", "busca", "busca", True, True, K.CHECK_OK)
    assert got["B"] == ("repositorio", "ja_coletado", "busca", True, True, K.CHECK_OK)
    assert got["C"] == ("sem_url",) * 3 + (False, True, K.CHECK_NO_URL)
    assert got["D"] == ("sem_url",) * 3 + (False, True, K.CHECK_NO_URL)
    assert got["E"] == ("sem_atas", "ja_coletado", "ja_coletado", True, False, K.CHECK_OK)
    only = {r["sigla"]: r for r in collection.flow(agencies, held, found, ["cig"]).collect()}
    assert only["A"]["acao_pg"] == "nao_pedido" and not only["A"]["pendente"] and not only["A"]["consulta_programa"]
    assert collection.flow(agencies.limit(0), held, found).count() == 0


def test_elements_and_hits(spark):
    pages = [
        (1, "<p>um</p><p>as <i>Atas</i></p><a href='/a'>x</a><a href='/b'>Ano 2024</a><a href='/c'>atas</a>"),
        (2, "<a href='/d'>Atas</a><a href='/e'>2020</a>"),
        (3, None),
        (4, ""),
    ]
    rows = web.elements(spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("https://x.org/")))
    of = {r["page_id"]: [tuple(e) for e in r["elementos"]] for r in rows.collect()}
    assert of == {1: [("/a", "x", "um"), ("/b", "Ano 2024", "as Atas")], 2: [("/d", "Atas", ""), ("/e", "2020", "")], 3: [], 4: []}
    hits = {r["page_id"]: tuple(r)[1:] for r in web.search_hits(rows, K.HIT_TERMS["cig"]).collect()}
    assert hits == {1: (True, "/b", True, False), 2: (True, "/d", False, True), 3: (False, None, False, False), 4: (False, None, False, False)}


def test_portal_links(spark):
    hits = spark.createDataFrame([(1, 0, False, None, False), (1, 1, True, "/t", False), (1, 2, True, "/z", True), (2, 0, True, "/y", True), (3, 0, False, None, False)], "page_id long, termo int, achou boolean, href string, tem_ano boolean")
    listed = spark.createDataFrame([(i, f"/{i}") for i in (1, 2, 3)], "page_id long, link string")
    got = sorted(map(tuple, web.portal_links(hits, listed, listed).collect()))
    assert got == [(1, "/t", "titulo"), (2, "/2", "ano"), (3, "/3", "hub")]

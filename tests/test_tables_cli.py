"""Tables that people have typed, layouts of files, names, and the commands that use them."""

import datetime
import json
from decimal import Decimal

import pytest

from atalaia import cli
from atalaia.functions import links
from atalaia.sources import readers
from atalaia.sources.store import Store

TYPED = '''EMPRESA,CNPJ,"DATA DE
APRESENTAÇÃO",VALOR,OBS
Um Ltda,1,24/10/2022,"1.234,56","duas
linhas"
"Dois
SA",2,2023-01-06,12.5,
EMPRESA,CNPJ,"DATA DE
APRESENTAÇÃO",VALOR,OBS
Três,3,31/02/2023,abc,"diz ""sim"", não"
Quatro,x,,,
Cinco,5
Seis,6,01.02.2023,7,a,b,c
'''


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TYPED)
    kinds = {"EMPRESA": "string", "CNPJ": "long", "DATA DE APRESENTAÇÃO": "date", "VALOR": "decimal(10,2)"}
    got = {r["EMPRESA"]: r for r in readers.typed_csv(spark, str(tmp_path / "t.csv"), kinds).collect()}
    day = datetime.date
    assert list(got) == ["Um Ltda", "Dois SA", "Três", "Quatro", "Cinco", "Seis"]
    assert tuple(got["Um Ltda"])[1:4] == (1, day(2022, 10, 24), Decimal("1234.56")) and got["Um Ltda"]["motivo"] is None and got["Um Ltda"]["bruto"]["5: OBS"] == "duas\nlinhas"
    assert tuple(got["Dois SA"])[1:4] == (2, day(2023, 1, 6), Decimal("12.50"))
    assert got["Três"]["motivo"] == "DATA DE APRESENTAÇÃO, VALOR" and got["Três"]["bruto"]["3: DATA DE APRESENTAÇÃO"] == "31/02/2023" and got["Três"]["bruto"]["5: OBS"] == 'diz "sim", não'
    assert got["Quatro"]["motivo"] == "CNPJ" and got["Cinco"]["motivo"] == "number of cells" == got["Seis"]["motivo"]
    assert tuple(got["Seis"])[1:4] == (6, day(2023, 2, 1), Decimal("7.00"))
    assert readers.typed_csv(spark, str(tmp_path / "none.csv"), kinds).collect() == []
    with pytest.raises(ValueError, match="OUTRA"):
        readers.typed_csv(spark, str(tmp_path / "t.csv"), {"OUTRA": "long"})


def test_layouts_of_files(spark, tmp_path):
    for name, content in (("cig/SEMA/b.pdf", "x"), ("cig/SEMA/a.PDF", "y"), ("cig/SEMA/empty.pdf", ""), ("cig/SEEDF/c.pdf", "z"), ("SEDES/d.pdf", "w"), ("SEDES/e.pdf", "w"), ("pg/f.pdf", "v")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    held = lambda **k: sorted((r.tipo_documento, r.orgao, r.arquivo) for r in readers.pdf_files(spark, str(tmp_path), ["cig"], **k).collect())
    typed = [("cig", "SEEDF", "c.pdf"), ("cig", "SEMA", "a.PDF"), ("cig", "SEMA", "b.pdf")]
    assert held() == typed  # no empty files
    assert held(untyped="cig") == sorted([*typed, ("cig", "SEDES", "d.pdf"), ("cig", "SEDES", "e.pdf")])
    assert held(untyped="cig", first=1) == [("cig", "SEDES", "d.pdf"), ("cig", "SEEDF", "c.pdf"), ("cig", "SEMA", "a.PDF")]


def test_names_of_a_file(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"Casa Civil": "CACI", "Nada": null, "Órgão, De Tudo": "ODT"}')
    known = readers.names(spark, str(tmp_path / "n.json"))
    rows = spark.createDataFrame([("Casa Civil",), ("Órgão, De Tudo",), ("Nada",), (None,), ("x",)], "n string")
    assert [r.sigla for r in links.named(rows, "n", known.unionByName(known)).collect()].count("") == 3
    assert {r.n: r.sigla for r in links.named(rows, "n", known).collect()} == {"Casa Civil": "CACI", "Órgão, De Tudo": "ODT", "Nada": "", None: "", "x": ""}


def test_collect(spark, tmp_path):
    page = '<a href="/atas/Ata_01-2023.pdf">Ata de reunião</a><a href="/outra">x</a>'
    spark.createDataFrame([(1, "https://a.org/cig/atas", page), (2, "https://a.org/sub/x", page), (3, "https://b.org", "<p>nada</p>"), (4, "https://abc.org/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "r.json").write_text(json.dumps({"A": {"link": "https://a.org/", "possui_atas": True}, "S": {"link": "https://a.org/sub"}, "B": {"link": "https://b.org", "possui_atas": True}, "N": {"link": ""}}))
    got = cli.run(spark, ["collect", "--pages", str(tmp_path / "pages"), "--registry", str(tmp_path / "r.json"), "--out", str(tmp_path / "out")])
    found = {(r.page_id, r.sigla) for r in spark.read.json(str(tmp_path / "out/links")).collect()}
    assert found == {(1, "A"), (2, "S")} and got["links"] == 2  # the longest address counts, and none that goes on with other letters
    assert {r["sigla"]: r["acao_cig"] for r in got["agencias"]} == {"A": "busca", "B": "busca", "N": "sem_url", "S": "sem_atas"}


def test_incremental_index_and_reset(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "document_id string, orgao string, tipo_documento string, text string").write.mode("overwrite").parquet(str(tmp_path / "docs"))
    index = str(tmp_path / "index")
    command = ["index", "--documents", str(tmp_path / "docs"), "--out", index, "--incremental"]
    docs(("1", "A", "cig", "plano de integridade"), ("2", "A", "cig", "outra coisa"))
    assert cli.run(spark, command) == {"versao": 1}
    docs(("2", "A", "cig", "plano novo de integridade"))
    assert cli.run(spark, command) == {"versao": 2}
    found = cli.run(spark, ["search", "plano integridade", "--index", index])
    assert sorted(r["documento"] for r in found) == ["1", "2"] and "novo" in " ".join(r["trecho"] for r in found)
    assert cli.run(spark, ["reset", "--index", index]) == {"versoes_apagadas": [1], "versao": 2}
    assert cli.run(spark, ["reset", "--index", index, "--keep", "0"]) == {"versoes_apagadas": [2], "versao": 0} and Store(spark, index).version() == 0


def test_lexicon_and_exact_counts_by_command(spark, tmp_path):
    spark.createDataFrame([("1", "A", "cig", "plano " * 120 + "\nalfa beta gama delta"), ("2", "A", "cig", "nada de nada por aqui mesmo")], "document_id string, orgao string, tipo_documento string, text string").write.parquet(str(tmp_path / "docs"))
    lexicon = [{"axis_id": "E1", "axis_name": "Um", "categories": [{"category_id": "c", "terms": [], "expressions": [], "subsignals": ["alfa beta"]}]}]
    (tmp_path / "l.json").write_text(json.dumps(lexicon))
    scored = cli.run(spark, ["analyse", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "a"), "--only-integrity-plans", "--lexico", str(tmp_path / "l.json")])
    assert {r["document_id"]: r["imga"] > 0 for r in scored} == {"1": True, "2": False}
    count = lambda *x: cli.run(spark, ["analyse", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "b"), "--keywords", "plano", *x])[0]["ocorrencias"]
    assert (count(), count("--exato")) == (100, 120)


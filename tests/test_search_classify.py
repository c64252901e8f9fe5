"""Search, fusion, labels, index files, command line, streams."""

import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from atalaia import cli
from atalaia.operators import chunking, classify, coverage, scan, search, web
from atalaia.plans import registry
from atalaia.sources import readers, sinks
from atalaia.sources.store import last_of
from atalaia.streaming import control, ingest

DOCS = [
    ("d1", "A", "pg", "O conselho aprovou o plano de integridade. A denúncia foi apurada pelo comitê de ética em reunião."),
    ("d2", "A", "cig", "Ata da reunião do comitê interno. Nao existe plano de integridade neste órgão."),
    ("d3", "B", "pg", "Relatório anual com pré-aviso de auditoria e denuncia anônima."),
    ("d4", "B", "compliance", "Texto sem relação com a pergunta."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(DOCS, "document_id string, orgao string, tipo_documento string, text string")
    return chunking.chunks(df, 1200, 200).persist()


def test_bm25_equals_fts5(spark, chunks):
    rows = chunks.select("chunk_id", "texto").collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, texto, tokenize='unicode61')")
    db.executemany("insert into f values (?, ?)", [tuple(r) for r in rows])
    asked = search.questions(spark, [("q", "denúncia plano integridade integridade reunião pré-aviso", None, None)])
    want = {i: -s for i, s in db.execute("select id, bm25(f) from f where f match ?", ['"denúncia" OR "plano" OR "integridade" OR "integridade" OR "reunião" OR "pré-aviso"'])}
    got = {x.chunk_id: x.score for x in search.bm25(chunks, asked).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_filters_and_fusion(spark, chunks):
    asked = search.questions(spark, [("all", "plano de integridade", None, None), ("b", "denuncia", "B", ["pg"]), ("none", "xyzzy", None, None)])
    found = search.hybrid(chunks, asked).collect()
    assert {x.query_id for x in found if "lexical" in x.fontes} == {"all", "b"}
    b = [x for x in search.evidence(search.hybrid(chunks, asked), chunks).collect() if x.query_id == "b"]
    assert [x.documento for x in b] == ["d3"] and b[0].score == 1.0
    alone = search.hybrid(chunks, asked, dimensions=None).collect()
    assert {x.score for x in alone if x["rank"] == 1} == {0.55}
    lex = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, posicao int")
    sem = spark.createDataFrame([("q", "z", 1), ("q", "x", 2)], "query_id string, chunk_id string, posicao int")
    got = {x.chunk_id: (x.score, x["rank"]) for x in search.fuse(lex, sem).collect()}
    assert got["z"] == (0.45, 3) and got["x"][1] == 1 and got["y"] == (round(0.55 * 61 / 62, 6), 2)
    with pytest.raises(ValueError):
        search.questions(spark, [("q", " ", None, None)])


def test_embedding(spark):
    e = spark.range(1).select(search.embedding(F.lit("foo foo bar")).alias("a"), search.embedding(F.lit("  ")).alias("b")).first()
    assert e.b == [] and math.isclose(sum(x.weight**2 for x in e.a), 1.0)
    assert {x.bucket: round(x.weight * math.sqrt(5)) for x in e.a}[91] == 2


def test_labels(spark):
    rows = [(0, 0.0, 3, False, "nao_encontrado"), (2, 0.54, 0, False, "nao_encontrado"), (2, 0.54, 1, True, "nao_atende"), (2, 0.55, 0, False, "atende_parcialmente"), (1, 0.85, 2, False, "atende"), (1, 0.85, 1, False, "atende_parcialmente"), (1, 0.849, 5, False, "atende_parcialmente")]
    df = spark.createDataFrame(rows, "n int, s double, h int, neg boolean, want string")
    got = df.select("want", classify.label(F.col("n"), F.col("s"), F.col("h"), F.col("neg")).alias("g")).collect()
    assert all(x.want == x.g for x in got)
    texts = [("Não existe registro", True), ("inexistência de plano", True), ("ausencia de x", True), ("sem previsão", True), ("existe e consta", False)]
    got = spark.createDataFrame(texts, "t string, want boolean").select("want", classify.has_negative(F.col("t")).alias("g")).collect()
    assert all(x.want == x.g for x in got)
    bands = spark.createDataFrame([(24.99,), (25.0,), (50.0,), (75.0,)], "x double").select(classify.band(F.col("x")).alias("b")).collect()
    assert [b.b for b in bands] == ["Incipiente", "Basica", "Intermediaria", "Avancada"]


def test_report_and_commands(spark, chunks, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame(DOCS, "document_id string, orgao string, tipo_documento string, text string").write.parquet(docs)
    at = cli.run(spark, ["index", "--documents", docs, "--out", str(tmp_path / "index")])
    assert spark.read.parquet(at["chunks"]).count() == 4 and spark.read.json(at["manifest"]).first().documentos == 4
    found = cli.run(spark, ["search", "plano de integridade", "--index", str(tmp_path / "index"), "--top-k", "2"])
    assert [x["rank"] for x in found] == [1, 2]
    (tmp_path / "criterios.json").write_text(
        '{"criterios": [{"codigo": "E1-A", "pergunta_normativa": "Existe plano de integridade?", "palavras_chave": ["plano", "integridade"], "eixo_imga": "E1", "peso_criterio": 0},'
        ' {"codigo": "E2-B", "titulo": "Canal de denúncia", "tipos_documento_prioritarios": ["pg"], "palavras_chave": ["denuncia"]}, {"codigo": "E3-C"}]}'
    )
    out = cli.run(spark, ["classify", "--index", str(tmp_path / "index"), "--criterios-file", str(tmp_path / "criterios.json"), "--output-dir", str(tmp_path / "report")])
    rows = {(x.orgao, x.criterio): x for x in spark.read.json(out["classificacoes"]).collect()}
    assert set(rows) == {(o, c) for o in "AB" for c in ("E1-A", "E2-B")}
    assert rows["A", "E1-A"].classificacao == "nao_atende" and rows["A", "E1-A"].peso_criterio == 1.0
    assert rows["B", "E2-B"].palavras_chave_encontradas == ["denuncia"]
    report = spark.read.option("header", "true").csv(out["indicadores_orgaos"]).collect()
    assert len(report) == 2 and '"nao_atende":1' in {x.orgao: x for x in report}["A"].classificacoes
    assert cli.run(spark, ["analyse", "--documents", docs, "--out", str(tmp_path / "kw"), "--keywords", "plano, ética"])
    with pytest.raises(ValueError):
        classify.criteria_rows(readers.criteria(spark, str(tmp_path / "criterios.json")), code="nope")


def test_sources(spark, tmp_path):
    folder = tmp_path / "pdf" / "pg" / "sema"
    folder.mkdir(parents=True)
    (folder / "A.PDF").write_bytes(b"%PDF page one\x0cpage two\x0c ")
    (folder / "b.pdf").write_bytes(b"junk")
    files = readers.pdf_files(spark, str(tmp_path / "pdf"), [" PG "], ["sema"])
    assert sorted((x.tipo_documento, x.orgao, x.arquivo) for x in files.collect()) == [("pg", "SEMA", "A.PDF"), ("pg", "SEMA", "b.pdf")]
    assert files.filter(readers.is_pdf_content(F.col("content"))).count() == 1

    def broken(content, most):
        raise OSError

    def plain(content, most):
        return content.decode().removeprefix("%PDF").split("\x0c")[:most] if content.startswith(b"%PDF") else []

    pages = readers.extracted_pages(files, [broken, plain]).collect()
    assert [(p.page_no, p.texto.strip()) for p in pages] == [(1, "page one"), (2, "page two")]
    assert readers.catalog(files).first().arquivos == ["A.PDF", "b.pdf"]
    with pytest.raises(ValueError):
        readers.document_types(["other"])
    assert readers.csv(spark, str(tmp_path / "missing.csv"), "a int").count() == 0
    assert readers.json(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "k.txt").write_text("Risco\n\n risco \nPlano\n")
    assert readers.keywords(spark, str(tmp_path / "k.txt")) == ["risco", "plano"] and readers.keywords(spark, typed="a, B,,a") == ["a", "b"]
    (tmp_path / "r.json").write_text('{"X": {"link": "http://x", "possui_atas": true}, "Y": {"link": "http://y"}}')
    assert {x.sigla: x.possui_atas for x in readers.registry(spark, str(tmp_path / "r.json")).collect()} == {"X": True, "Y": None}
    (tmp_path / "l.json").write_text('[{"axis_id": "E1", "categories": [{"terms": ["a"], "expressions": ["b"], "subsignals": []}, {"terms": ["c"]}]}]')
    assert readers.lexicon(spark, str(tmp_path / "l.json")) == {"E1": (["a", "c"], ["b"], [])}
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for _ in range(2):
        sinks.write_new(rows, str(tmp_path / "new"), "k")
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2


def test_web_and_crawl(spark):
    html = '<A HREF="/ata-1.pdf">Ata <b>1</b></A> <a class=x href=\'/ata-1.pdf?x=2\'>again</a><a href="#top">t</a><a href="http://o/x">out</a>'
    pages = spark.createDataFrame([(1, "http://h/transparencia", html, 9), (2, "http://h/x", None, 9)], "page_id long, url string, html string, pos int")
    found = web.anchors(pages)
    assert [(x.pos, x.href, x.texto) for x in found.orderBy("pos").collect()] == [(1, "/ata-1.pdf", "Ata 1"), (2, "/ata-1.pdf?x=2", "again"), (3, "#top", "t"), (4, "http://o/x", "out")]
    links = web.document_links(found)
    assert web.first_of_same(links, "page_id", "pos").count() == 1 and links.count() == 2
    assert [(x.pdf_score, x.palavra, x.hub) for x in web.page_scores(found).collect()] == [(2, True, True)]
    edges = [("http://h/", f"http://h/{i}", i) for i in range(50)] + [("http://h/0", "http://h/deep#a", 1), ("http://h/0", "http://h/", 2), ("http://h/deep", "http://h/deeper", 1), ("http://h/", "http://other/", 0)]
    df = spark.createDataFrame(edges, "source string, target string, pos int")
    got = [tuple(x) for x in web.crawl(df, "http://h/#frag", pages_most=45).orderBy("ordem").collect()]
    assert got[0] == ("http://h/", 0, 1) and got[1] == ("http://h/0", 1, 2) and len(got) == 42 and got[-1] == ("http://h/deep", 2, 42)
    assert len(web.crawl(df, "http://h/").collect()) == 35


def test_coverage(spark):
    docs = spark.createDataFrame([("1", "A", "pg"), ("2", "A", "cig"), ("3", "B", "compliance")], "document_id string, orgao string, tipo_documento string")
    got = {x.orgao: (x.ausentes, x.risco) for x in coverage.missing_types(docs, ["pg", "cig", "compliance"], ("pg", "cig")).collect()}
    assert got == {"A": (["compliance"], "Risco Moderado"), "B": (["pg", "cig"], "Risco Alto")}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "view", "2024-01-01 00:05:00"), (2, "view", "2024-01-01 00:50:00"), (3, "click", "2024-01-01 02:00:00")], "event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    got = {x.event_type: (x.n, x.ids) for x in ingest.streamed_event_counts(spark, path).collect()}
    assert got == {"view": (2, 3), "click": (1, 3)}
    seen = []
    windows = ingest.windowed_counts(ingest.arrivals(spark, path, events.schema))
    ingest.run_once(windows, lambda b, i: seen.extend(b.collect()), str(tmp_path / "c1"), "update")
    assert max((x.n for x in seen if x.event_type == "view")) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "t1", "task": "x", "state": "run", "params": {"a": "b"}}')
    done = []
    for _ in range(2):  # the second start finds nothing new
        control.serve(ingest.commands(spark, str(tmp_path / "in")), lambda begun: done.extend(r.id for r in begun.collect()), str(tmp_path / "out"), str(tmp_path / "c2"))
        control.say(spark, str(tmp_path / "in"), control.states(spark, str(tmp_path / "out")).filter("state = 'running'"), "completed")
    assert done == ["t1"] and [(x.state, x.runs) for x in control.states(spark, str(tmp_path / "out")).collect()] == [("completed", 1)]


def test_axis_weights_of_a_criteria_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"eixos_imga": {"E1": {"peso_eixo": 30}, "E2": {}}, "criterios": []}')
    (tmp_path / "b.json").write_text("[]")
    assert readers.axis_weights(spark, str(tmp_path / "a.json")) == {"E1": 0.3, "E2": 0.0}
    assert readers.axis_weights(spark, str(tmp_path / "b.json")) is None
    rows = spark.createDataFrame([("A", "E1", 1.0, 1.0, "atende")], "orgao string, eixo_imga string, peso_criterio double, score_ponderado double, classificacao string")
    assert classify.indicators(rows, {"E1": 0.3}).first().imga_global == 30.0


def test_stored_index_answers_without_texts(spark, chunks, tmp_path):
    docs = spark.createDataFrame(DOCS, "document_id string, orgao string, tipo_documento string, text string")
    sinks.write_index(docs, str(tmp_path))
    index = search.Index.read(spark, str(tmp_path))
    asked = search.questions(spark, [("q", "denúncia plano pré-aviso", None, None)])
    for f in (search.bm25, search.semantic):
        stored, anew = f(index, asked), f(chunks, asked)
        assert stored.collect() == anew.collect()
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "texto" not in plan and "CartesianProduct" not in plan
    assert "PushedFilters: [IsNotNull(term)" in search.bm25(index, asked)._jdf.queryExecution().toString() or "In(term" in search.bm25(index, asked)._jdf.queryExecution().toString()
    many = search.questions(spark, [(f"q{i}", "denúncia plano", None, None) for i in range(30)])
    few = search.questions(spark, [("q0", "denúncia plano", None, None)])
    assert search.semantic(index, many).filter("query_id = 'q0'").collect() == search.semantic(index, few).collect()
    with pytest.raises(ValueError):
        search.semantic(index, asked, dimensions=7)


def test_stored_postings_equal_those_of_chunks(spark, tmp_path):
    """Blocks name chunks by number, are made without a shuffle and give back every posting with its places."""
    docs = spark.createDataFrame([("1", "A", "t", "a b a\nb a c"), ("2", None, None, None), ("3", "B", "u", "Ação a-b ação\n?!"), ("4", "B", "u", "c " * 500)], "document_id string, orgao string, tipo_documento string, text string")
    sinks.write_index(docs, str(tmp_path), 300, 50)
    written = spark.read.parquet(str(tmp_path / "postings"))
    assert written.columns == ["term", "numeros", "ends", "places"]
    assert "Exchange" not in search.posting_blocks(spark.read.parquet(str(tmp_path / "chunks")))._jdf.queryExecution().executedPlan().toString()
    index = search.Index.read(spark, str(tmp_path))
    want = search.postings(chunking.chunks(docs, 300, 50))
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(tuple, search.block_counts(written).collect())) == sorted(map(tuple, want.groupBy("term").agg(F.count(F.lit(1)), F.sum("tf")).collect()))


def test_searches_of_a_stored_index_shuffle_no_chunks(spark, tmp_path):
    """Hits are summed where their join with chunks has put them, texts stay where they are, and unique ids are not shuffled to be made unique."""
    docs = spark.createDataFrame(DOCS, "document_id string, orgao string, tipo_documento string, text string")
    sinks.write_index(docs, str(tmp_path))
    index = search.Index.read(spark, str(tmp_path))
    assert "hash_texto" not in spark.read.parquet(str(tmp_path / "chunks")).columns and "hash_texto" in index.chunks.columns
    asked = search.questions(spark, [("q", "denúncia plano", None, None)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if chunks were many
    try:
        assert not re.search(r"hashpartitioning\(query_id#\d+, (numero|chunk_id)", plan(search.bm25(index, asked)))
        found = plan(search.evidence(search.hybrid(index, asked), index))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "chunk_id" in found and not [x for x in found.split("\n") if "SortMergeJoin [chunk_id" in x]
    phrases = search.questions(spark, [("p", "pré-aviso", None, None)])
    assert search.bm25(index, phrases).count() == 1
    assert "Exchange" not in plan(last_of(docs, "document_id", None))
    twice = docs.unionByName(docs.withColumn("text", F.lit("~")))
    assert {x.text for x in last_of(twice.filter("document_id <> 'd1' or text <> '~'"), "document_id", None).collect()} == {"~", DOCS[0][3]}


def test_search_index_holds_no_more_than_searches_need(spark, tmp_path, monkeypatch):
    """No copy of documents and no vectors are stored; searches answer as from the whole index, of a repeated document too."""
    docs = spark.createDataFrame([*DOCS, DOCS[0]], "document_id string, orgao string, tipo_documento string, text string")
    at = sinks.write_search_index(docs, str(tmp_path / "lean"))
    sinks.write_index(docs, str(tmp_path / "whole"))
    assert {x.name for x in (tmp_path / "lean").iterdir()} == set(at) == {"chunks", "postings", "corpus_stats"}
    lean, whole = search.Index.lean(spark, str(tmp_path / "lean")), search.Index.read(spark, str(tmp_path / "whole"))
    asked = search.questions(spark, [("q", "plano de integridade denúncia", None, None), ("r", "pré-aviso", None, ["pg", "cig"])])
    for f in (search.bm25, search.semantic, search.hybrid):
        got = f(lean, asked)
        assert sorted(map(str, got.collect())) == sorted(map(str, f(whole, asked).collect())) and got.count() > 2
    monkeypatch.setattr(registry, "_BUILT", {})
    registry.QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")
    assert [k[0] for k in registry._BUILT] == ["search"]  # no whole index


def test_index_of_chunks_that_are_cut_once(spark, tmp_path):
    """Searches answer as from chunks made anew, without cutting texts again; vectors of types that no question asks for are not made."""
    docs = spark.createDataFrame(DOCS, "document_id string, orgao string, tipo_documento string, text string")
    cut = chunking.chunks(docs, 60, 10)
    index = search.Index.once(cut, str(tmp_path / "said"))
    asked = search.questions(spark, [("q", "plano de integridade denúncia", None, ["pg"]), ("r", "pré-aviso", None, ["pg", "cig"])])
    for f in (search.bm25, search.semantic, search.hybrid):
        got = f(index, asked)
        assert sorted(map(str, got.collect())) == sorted(map(str, f(cut, asked).collect())) and got.count() > 2
    plan = search.semantic(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "hash_texto" not in plan and "posexplode" not in plan and "In(tipo_documento, [cig,pg])" in plan
    assert index.chunks.count() == cut.count()


def test_searches_store_chunks_alone(spark, tmp_path, monkeypatch):
    """What the session's searches keep is smaller than the texts, ids and postings that they would need, and neither phrases nor scores are shuffled."""
    monkeypatch.setattr(registry, "_BUILT", {})
    monkeypatch.setattr(registry, "_own_folder", lambda spark, what: f"{tmp_path}/{what}")
    for name in ("bm25_phrases", "criterion_classification", "label_distribution", "org_criterion_matrix", "matrix_selected", "org_ranking"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [x.name for x in tmp_path.iterdir()] == ["search"]
    kept = spark.read.parquet(str(tmp_path / "search"))
    assert set(kept.columns) == {"document_id", "orgao", "tipo_documento", "pagina_inicial", "pagina_final", "ordem", "texto"}
    index = search.Index.kept(spark, str(tmp_path / "search"))
    want = registry._chunks(spark, "/root/testdata/sf0.001")
    assert index.chunks.dtypes == want.dtypes and index.chunks.exceptAll(want).count() == want.exceptAll(index.chunks).count() == 0
    plan = search.bm25(index, search.questions(spark, [("p", "of-the and-the", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # that of the best of each task


def test_scan_equals_postings(spark, tmp_path, monkeypatch):
    """Scores from texts are those from postings: phrases, repeats, filters, ties and nulls, in small parts too; more terms than may be sent are joined."""
    rows = [(str(i), None if i % 11 == 0 else "AB"[i % 2], None if i % 7 == 0 else "tu"[i % 2], f"a a a b{i % 3} c-a. Ação b{i % 5} a b\n?!\n" + "x a " * (i % 4)) for i in range(60)]
    cut = chunking.chunks(spark.createDataFrame(rows, "document_id string, orgao string, tipo_documento string, text string"), 30, 10).coalesce(2).persist()
    index = search.Index.once(cut, str(tmp_path / "once"))
    asked = search.questions(spark, [("p", "acao-b1 a-a a-a-a b1-a", None, None), ("q", "a-b0 acao acao xyzzy", "A", None), ("r", "acao-b2 a-a-b", None, ["t"]), ("s", "xyzzy", None, []), ("t", "??", None, None)])

    def same():
        for limit, by_agency in ((1000, False), (3, True)):
            got, want = search.bm25(index, asked, limit, by_agency), search.bm25(cut, asked, limit, by_agency)
            rows = sorted(map(str, got.collect()))
            assert got.dtypes == want.dtypes and rows == sorted(map(str, want.collect())) and len(rows) > 6

    same()
    monkeypatch.setattr(scan, "STEP", 5)
    monkeypatch.setattr(scan, "MOST_KEPT", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = search.bm25(index, asked.filter("query_id in ('s', 't')"))
    assert none.count() == 0 and none.columns == search.bm25(cut, asked).columns
    monkeypatch.setattr(search, "MOST_QUESTIONS", 2)
    monkeypatch.setattr(scan, "search", None)
    same()

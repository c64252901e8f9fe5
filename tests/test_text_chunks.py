"""Text rules and the chunker against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from atalaia.functions import links, text
from atalaia.operators import chunking, keywords, maturity


def chunk_by_force(t, size, overlap):
    t = re.sub(r"\s+", " ", t).strip()
    if not t:
        return []
    if len(t) <= size:
        return [t]
    out, current = [], ""

    def hard(s):
        step = max(1, size - overlap)
        return [s[i : i + size].strip() for i in range(0, len(s), step)]

    for s in re.split(r"(?<=[.!?])\s+", t):
        both = f"{current} {s}" if current else s
        if len(both) <= size:
            current = both
        elif current:
            out.append(current)
            tail = current[-overlap:].strip() if overlap else ""
            current = f"{tail} {s}".strip()
        else:
            out += hard(s)
            current = ""
    if current:
        out.append(current)
    return [x.strip() for x in out if x.strip()]


def test_chunker(spark):
    r = random.Random(1)
    texts = ["", " \n", "x" * 30, "x" * 31, "a. " + "b" * 80 + ". c", "x" * 100, "ab cd. " * 20]
    texts += [" ".join("".join(r.choice("abé") for _ in range(r.randrange(1, 9))) + r.choice(["", "", ".", "!", "?"]) for _ in range(r.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((30, 10), (30, 0), (50, 49)):
        got = {x.i: x.c for x in df.select("i", chunking.chunk(F.col("t"), size, overlap).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == chunk_by_force(t, size, overlap), (size, overlap, t)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d1", "A", "cig", "one. two\n\n \nthree"), ("d2", "A", "pg", None)], "document_id string, orgao string, tipo_documento string, text string")
    rows = chunking.chunks(docs, 5, 0).orderBy("ordem").collect()
    assert [(x.document_id, x.pagina_inicial, x.ordem, x.texto) for x in rows] == [("d1", 1, 1, "one."), ("d1", 1, 2, "two"), ("d1", 2, 3, "three")]
    assert len({x.chunk_id for x in rows}) == 3
    pages = chunking.pages(docs).orderBy("page_no").collect()
    assert [(p.page_no, p.page_pos, p.texto) for p in pages] == [(1, 1, "one. two"), (2, 4, "three")]


def test_text_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert get(text.collapse(lit(" a \xa0\n b "))) == "a b"
    assert get(text.fold(lit("AÇÃO  Ética"))) == "acao etica"
    assert get(text.index_tokens(lit("Denúncia_x-2 ÜBER"))) == ["denuncia", "x", "2", "uber"]
    assert get(text.word_tokens(lit("A é_b c"))) == ["a", "é_b", "c"]
    assert get(text.query_tokens(lit("O que é pré-aviso de ouvidoria para x"))) == ["pré-aviso", "ouvidoria"]
    assert get(text.without_page_numbers(lit("a\n - 12 -\nb\r\nc"))) == "a\nb\nc"
    assert get(text.paragraphs(lit("short\n\n" + "x" * 20))) == ["x" * 20]
    assert get(text.title_date(lit("Ata de 12 de março de 2020"))) == "12 de março de 2020"
    assert get(text.title_date(lit("12/03/2020"))) == "12/03/2020"
    assert get(text.title_date(lit("none"))) is None
    assert get(text.excerpt(lit("y" * 421))) == "y" * 420 + "..."
    assert get(text.title_from_url(lit(" "), lit("http://h/a/Plano-de%20_x/?q"))) == "Plano de  x"
    assert get(text.title_from_url(lit(None).cast("string"), lit("http://h/"))) == "documento"
    assert get(text.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5
    assert get(text.safe_filename(lit("a/b: ç.pdf"))) == "a_b_ ç.pdf"


def test_link_rules(spark):
    rows = [
        ("http://h/x.pdf", "plano", "cig", False, True),
        ("http://h/x.pdf", "plano", "pg", True, True),
        ("http://h/x", "Ata da reunião", "cig", True, False),
        ("http://h/x", "resolução sobre ata", "cig", False, False),
        ("http://h/documents/1/programa", "guia", "compliance", True, False),
        ("http://h/documents/1/relatorio", "", "cig", True, True),
        ("http://h/x.pdf/abc", "", "cig", True, True),
        ("http://h/x.pdfs", "", "cig", True, False),
        ("http://h/a-pdf?download=1", "", "cig", False, True),
        ("", "ata", "cig", False, False),
        (None, "ata", "pg", False, False),
    ]
    df = spark.createDataFrame(rows, "u string, t string, k string, likely boolean, pdf boolean")
    for k in ("cig", "pg", "compliance"):
        for x in df.filter(F.col("k") == k).select("*", links.probably_document(F.col("u"), F.col("t"), k).alias("a"), links.is_pdf(F.col("u")).alias("b")).collect():
            assert (x.a, x.b) == (x.likely, x.pdf), x
    titles = [("Ata 1", True), ("Portaria da ata", False), ("3ª extra", True), ("ordinária", False), ("conselho", True), (None, False), ("x", False)]
    got = spark.createDataFrame(titles, "t string, y boolean").select("y", links.is_minutes(F.col("t")).alias("g")).collect()
    assert all(x.y == x.g for x in got)
    names = [("relat_sema_2020.pdf", "SEMA"), ("Casa Militar.pdf", "CM"), ("abc_x.pdf", "ABC"), ("averylongname_x.pdf", "OUTROS"), ("ordem urbanística", "DF_LEGAL")]
    got = spark.createDataFrame(names, "n string, o string").select("o", links.agency_of_filename(F.col("n")).alias("g")).collect()
    assert all(x.o == x.g for x in got)
    url = spark.range(1).select(links.absolute(F.lit("//h2/x"), F.lit("http://h/y")).alias("a"), links.absolute(F.lit("z"), F.lit("https://h/y/q")).alias("b"), links.absolute(F.lit("mailto:x"), F.lit("http://h")).alias("c")).first()
    assert tuple(url) == ("https://h2/x", "https://h/z", "mailto:x")


def test_keywords_and_snippets(spark):
    page = "Riscos e risco. CONTROLE interno; controles. " + "risco " * 120 + "x" * 49_000 + " risco risco"
    pages = spark.createDataFrame([("d", "O", 1, page), ("d", "O", 2, "sem nada"), ("e", "O", 1, "controle interno")], "document_id string, orgao string, page_no int, texto string")
    words = ["Risco", " controle", "controle interno", "risco", ""]
    got = {(x.document_id, x.page_no, x.keyword): x.ocorrencias for x in keywords.counts_by_page(pages, words).collect()}
    assert got == {("d", 1, "risco"): 100, ("d", 1, "controle"): 2, ("e", 1, "controle"): 1}
    pat = re.compile(r"\b(?:risco|controle|controle interno)\w*\b", re.I)
    want = [(m.start() + 1, m.group()) for m in pat.finditer(page[:50_000])]
    found = pages.filter("document_id = 'd' and page_no = 1").select(F.explode(keywords.matches(F.col("texto"), words)).alias("m")).select("m.*").collect()
    assert [(x.pos, x.match) for x in found] == want


def test_near_snippets(spark):
    r = random.Random(5)
    rows = [("d", i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7)))) for i in range(1, 200)]
    kept = []
    for _, i, s in rows:
        w = set(s.lower().split())
        if s in [k for _, k, _ in kept] or any(len(w & v) / len(w | v) >= 0.85 for _, _, v in kept[-5:]):
            continue
        kept.append((i, s, w))
    df = spark.createDataFrame(rows, "document_id string, ordem int, snippet string")
    got = sorted((x.ordem, x.snippet) for x in keywords.unlike_snippets(df).collect())
    assert got == [(i, s) for i, s, _ in kept]


def test_maturity(spark):
    docs = spark.createDataFrame(
        [("a", "O", "A auditoria interna realiza anualmente um plano do conselho sempre."), ("b", "O", "xx yy\n" + "nothing of note stands here"), ("c", "O", "")], "document_id string, orgao string, text string"
    )
    scored = maturity.score_segments(maturity.segments(docs))
    got = {(x.document_id, x.eixo): (x.score, x.evidencias) for x in scored.collect()}
    assert got["a", "E6"] == (5, ["auditoria interna"]) and got["a", "E1"] == (5, ["conselho"]) and set(got) == {("a", "E6"), ("a", "E1")}
    index = {x.document_id: (x.imga, x.faixa) for x in maturity.document_index(maturity.audit(docs, scored)).collect()}
    assert index["c"] == (0.0, "Incipiente") and index["a"][1] == "Avancada"
    bands = spark.createDataFrame([(25.0,), (25.01,), (50.0,), (75.0,), (75.01,)], "x double").select(maturity.band(F.col("x")).alias("b")).collect()
    assert [b.b for b in bands] == ["Incipiente", "Basica", "Basica", "Intermediaria", "Avancada"]


def test_hard_split_is_one_pass(spark):
    """Windows as slices give them, of any characters; a text of three million characters takes seconds, as no window counts them from the first."""
    texts = ["", "a", "x" * 100, "ab\U0001f600ção " * 50, "l\nm " * 90, "   " + "y" * 250]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    for size, overlap in ((100, 20), (100, 0), (30, 25), (5, 9)):
        step = max(1, size - overlap)
        want = [[w for k in range(0, max(len(t), 1), step) if (w := t[k : k + size].strip(" "))] for t in texts] + [[]]
        assert [r.w for r in rows.orderBy("i").select(chunking.hard_split(F.col("t"), size, overlap).alias("w")).collect()] == want
    start = time.time()
    long = spark.range(1).select(F.repeat(F.lit("abcdefghij"), 300_000).alias("t"))
    assert long.select(F.size(chunking.hard_split(F.col("t"), 100, 20))).first()[0] == 37_500 and time.time() - start < 20

"""Parameters of the registered queries over the synthetic tables, whose prose knows no Portuguese."""

from __future__ import annotations

SIZE, OVERLAP = 300, 50
QUESTIONS = [
    ("q1", "the and that with", None, None),
    ("q2", "les des une pour avec les", None, ["fr"]),
    ("q3", "der die und von idiot", "SRC0", None),
    ("q4", "que para los clown worthless", None, ["es", "en"]),
]
#: Hyphens make phrases; accents do not count.
PHRASES = [("h1", "of-the and-the", None, None), ("h2", "ça-et für-den", None, None), ("h3", "the-the of-the-and", None, ["en"])]
#: code, question, title, types, keywords, weight, axis
CRITERIA = [
    ("E1-GOV-001", "the and that with", "One", ["en"], ["that", "with", "zzz"], 2.0, "E1"),
    ("E2-INT-001", "les des une pour", "Two", ["fr"], ["des", "pour"], 1.0, "E2"),
    ("E3-AMB-001", "der die und von", "Three", None, ["der", "DIE"], 1.5, "E3"),
    ("E4-DUE-001", "idiot clown scum moron", "Four", ["en", "es"], ["idiot", "clown"], 0.0, "E4"),
    ("E6-RIS-001", "que los del para", "Five", ["es"], ["qqq"], 1.0, "E6"),
    ("X9-NON-001", "xyzzy plugh", "Six", None, ["xyzzy"], 3.0, None),
]
LEXICON = {
    "E1": (["the", "les"], ["of the", "de la"], ["is that"]),
    "E2": (["and", "des"], ["and the"], ["with that"]),
    "E3": (["der", "que"], ["die der"], ["und von"]),
    "E4": (["with", "para"], ["for the"], ["to be"]),
    "E5": (["this", "pour"], ["in the"], ["this is"]),
    "E6": (["von", "los"], ["to the"], ["von der"]),
    "E7": (["was", "une"], ["it is"], ["was the"]),
    "E8": (["idiot", "clown"], ["del que"], ["zzz none"]),
}
BOOSTERS = {"acao": ["that", "que"], "periodicidade": ["with", "avec"], "responsavel": ["for", "pour"], "artefato": ["was", "auf"]}
KEYWORDS = ["that", "idiot", "pour", "der", "que"]
ABSENT = "xyzzy"
SNIPPET_KEYWORDS = ["idiot", "clown", "scum"]
TYPES, SEVERE = ["user", "assistant", "system", "tool"], ("assistant", "tool")
#: Put before every third text: a sentence with a negative signal.
NEGATIVE = "Nao existe plano, the and that with. "
#: PDF links with and without text, one by its ending behind a query, and links that are none.
LINKS_PAGE = '<a href="/atas/Ata_01-2023.pdf"></a><a href="b/relatorio.PDF">Ata da reuniao</a><a href="/c.pdf?download=1">ata 2</a><a href="/d.html">ata 3</a>'
#: Terms of hits in links and paragraphs, in the order of a search, and a made page: titles with and without a year, and a paragraph less than links.
HIT_TERMS = ["idiot", "ción", "of the", "atas"]
HITS_PAGE = '<p>Nada</p><p>sobre <b>atas</b> de 2021</p><p>x</p><a href="/a">Um</a><a href="/b">Reuniao de 2023</a><a href="/c">Atas 2022</a><a href="/d">atas idiot</a>'
#: Put before a quarter of the texts when they arrive anew, and the term that versions are asked for.
NEWER, TERM = "Nova versao: ", "nova"
#: Phrases of a page: its first word of five letters or more, and its first two words with one blank between.
PHRASE_PATTERNS = (r"[\p{L}\p{N}_]{5,}", r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+")
#: What events say as control messages.
SAID = {"signup": "run", "purchase": "completed", "error": "failed"}
#: Headings of a typed table, two of them over several lines.
HEADINGS = ("CHAVE", "DATA DE\nAPRESENTACAO\nDO PEDIDO", "VALOR\nTOTAL")

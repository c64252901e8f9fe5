"""The SQL that each query must equal, for DuckDB, built from the same parameters."""

from __future__ import annotations

from ..functions import constants as K
from . import settings as S


def text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(xs: list[str] | None) -> str:
    return "NULL::VARCHAR[]" if xs is None else "[" + ", ".join(map(text, xs)) + "]"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return collapse(f"translate(lower({x}), '{K.FOLD_FROM}', '{K.FOLD_TO}')")


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def rnd(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def word(x: str, w: str) -> str:
    """Whether a lower-cased text holds a word between Unicode boundaries."""
    return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){w}($|[^\p{{L}}\p{{M}}\p{{N}}_])')"


WORD = r"[\p{L}\p{M}\p{N}_]+"
DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, upper(trim(source)) AS orgao, lower(trim(lang)) AS tipo_documento, coalesce(text, '') AS text FROM documents)"
PAGES = rf"""{DOCS},
lines AS (SELECT document_id, orgao, tipo_documento, unnest(string_split(text, chr(10))) AS texto, generate_subscripts(string_split(text, chr(10)), 1) AS page_pos FROM d),
pg AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_pos) AS page_no FROM lines WHERE {collapse("texto")} <> '')"""
_HARD = f"list_filter([trim(substr(x, k + 1, {S.SIZE})) for k in range(0, length(x), {S.SIZE - S.OVERLAP})], lambda w: w <> '')"
CHUNKS = rf"""{PAGES},
pt AS (SELECT *, {collapse("texto")} AS t FROM pg),
ps AS (SELECT *, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM pt),
r AS (
  SELECT document_id, page_no, ss, 0 AS i, []::VARCHAR[] AS o, '' AS c FROM ps WHERE length(t) > {S.SIZE}
  UNION ALL
  SELECT document_id, page_no, ss, i + 1,
    CASE WHEN length(cand) <= {S.SIZE} THEN o WHEN c <> '' THEN list_append(o, c) ELSE list_concat(o, {_HARD}) END,
    CASE WHEN length(cand) <= {S.SIZE} THEN cand WHEN c <> '' THEN trim(trim(substr(c, greatest(length(c) - {S.OVERLAP} + 1, 1))) || ' ' || x) ELSE '' END
  FROM (SELECT *, ss[i + 1] AS x, CASE WHEN c = '' THEN ss[i + 1] ELSE c || ' ' || ss[i + 1] END AS cand FROM r WHERE i < len(ss))),
cut AS (
  SELECT document_id, page_no, [t] AS cs FROM pt WHERE length(t) <= {S.SIZE}
  UNION ALL SELECT document_id, page_no, list_filter([trim(w) for w in CASE WHEN c <> '' THEN list_append(o, c) ELSE o END], lambda w: w <> '') FROM r WHERE i = len(ss)),
cu AS (SELECT document_id, page_no, unnest(cs) AS texto, generate_subscripts(cs, 1) AS k FROM cut),
co AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_no, k) AS ordem, sha1(texto) AS hash_texto FROM cu),
ch AS (SELECT sha1(document_id || ':' || page_no || ':' || ordem || ':' || hash_texto) AS chunk_id, document_id, orgao, tipo_documento, page_no AS pagina, ordem, texto, hash_texto FROM co JOIN d USING (document_id))"""


def questions(rows: list[tuple]) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"({text(a)}, {text(b)}, {text(c)}, {listed(t)})" for a, b, c, t in rows) + ") t(query_id, pergunta, q_orgao, tipos))"


_ASKED = "(tipos IS NULL OR len(tipos) = 0 OR list_contains(tipos, tipo_documento)) AND (q_orgao IS NULL OR q_orgao = orgao)"


def lexical(by: str = "query_id") -> str:
    stop = listed(K.QUERY_STOP_WORDS)
    return rf"""
qt AS (SELECT query_id, q_orgao, tipos, term, count(*) AS times FROM (
  SELECT query_id, q_orgao, tipos, unnest(list_slice(list_filter(regexp_extract_all(lower(pergunta), '\b[\w-]{{3,}}\b'), lambda w: NOT list_contains({stop}, w)), 1, 16)) AS term FROM q) GROUP BY ALL),
tk AS (SELECT chunk_id, orgao, tipo_documento, tokens, len(tokens) AS dl FROM (SELECT chunk_id, orgao, tipo_documento, list_filter(string_split_regex(strip_accents(lower(texto)), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS tokens FROM ch)),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk),
po AS (SELECT chunk_id, orgao, tipo_documento, dl, term, count(*) AS tf FROM (SELECT chunk_id, orgao, tipo_documento, dl, unnest(tokens) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
fr AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query_id, chunk_id, orgao, {rnd("sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))", 6)} AS score
  FROM qt JOIN po USING (term) JOIN fr USING (term) CROSS JOIN st WHERE {_ASKED} GROUP BY query_id, chunk_id, orgao),
lex AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS posicao FROM sc QUALIFY posicao <= 30)"""


def _phrases() -> str:
    """lexical() for questions whose tokens hold hyphens and accents: each is a phrase, found in the joined tokens of a chunk."""
    joined = "' ' || array_to_string(tokens, '  ') || ' '"
    phrase = "array_to_string(list_filter(string_split_regex(strip_accents(lower(term)), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), '  ')"
    old = lexical()
    a, b = old.index("po AS ("), old.index("fr AS (")
    hits = rf"""qp AS (SELECT DISTINCT term, ' ' || {phrase} || ' ' AS ph FROM qt),
po AS (SELECT chunk_id, orgao, tipo_documento, dl, term, tf FROM (SELECT tk.*, term, len(list_filter(range(1, length({joined}) + 1), lambda i: substr({joined}, i, length(ph)) = ph)) AS tf FROM tk JOIN qp ON contains({joined}, ph)) WHERE tf > 0),
"""
    return (old[:a] + hits + old[b:]).replace(r"\b[\w-]{3,}\b", r"[\p{L}\p{M}\p{N}_-]{3,}")


def vectors(source: str, key: str, column: str, out: str) -> str:
    return rf"""
{out}_c AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS bucket, count(*) AS c FROM (SELECT {key}, unnest(regexp_extract_all(lower({column}), '{WORD}')) AS w FROM {source}) GROUP BY ALL),
{out} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS weight FROM {out}_c)"""


def semantic(by: str = "query_id") -> str:
    return rf"""{vectors("q", "query_id", "pergunta", "qv")},{vectors("ch", "chunk_id", "texto", "cv")},
ss AS (SELECT query_id, chunk_id, orgao, {rnd("sum(qv.weight * cv.weight)", 6)} AS score
  FROM qv JOIN q USING (query_id) JOIN cv USING (bucket) JOIN (SELECT chunk_id, orgao, tipo_documento FROM ch) USING (chunk_id) WHERE {_ASKED} GROUP BY query_id, chunk_id, orgao),
sem AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS posicao FROM ss QUALIFY posicao <= 30)"""


def fused(by: str = "query_id", k: int = 5) -> str:
    return rf"""
fu AS (SELECT coalesce(lex.query_id, sem.query_id) AS query_id, coalesce(lex.orgao, sem.orgao) AS orgao, coalesce(lex.chunk_id, sem.chunk_id) AS chunk_id, lex.posicao AS lp, sem.posicao AS sp,
  coalesce(0.55 * 61.0 / (60.0 + lex.posicao), 0) AS sl, coalesce(0.45 * 61.0 / (60.0 + sem.posicao), 0) AS sv
  FROM lex FULL JOIN sem ON lex.query_id = sem.query_id AND lex.chunk_id = sem.chunk_id),
fs AS (SELECT *, {rnd("CAST(sl AS DOUBLE) + CAST(sv AS DOUBLE)", 6)} AS score, concat_ws(',', CASE WHEN lp IS NOT NULL THEN 'lexical' END, CASE WHEN sp IS NOT NULL THEN 'semantica' END) AS fontes FROM fu),
hy AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, lp NULLS LAST, sp NULLS LAST) AS rank FROM fs QUALIFY rank <= {k})"""


def _asked(select: str, *parts: str, rows: list[tuple] = S.QUESTIONS) -> str:
    return f"WITH RECURSIVE {CHUNKS}, {questions(rows)}," + ",".join(parts) + "\n" + select


_CRITERIA_Q = [(c[0], c[1], None, c[3]) for c in S.CRITERIA]
_CRITERIA = "cr AS (SELECT * FROM (VALUES " + ", ".join(f"({text(c)}, {text(q)}, {text(t)}, {listed(k)}, {w or 1.0}::DOUBLE, {text(a or 'SEM_EIXO')})" for c, q, t, _, k, w, a in S.CRITERIA) + ") t(criterio, pergunta_c, titulo, palavras, peso_criterio, eixo_imga))"
_NEGATIVE = " OR ".join(f"regexp_matches({fold('texto')}, '{p}')" for p in K.NEGATIVE_SIGNALS)
_LABELS = rf"""
ev AS (SELECT query_id AS criterio, hy.orgao, score, rank, texto, document_id, pagina FROM hy JOIN ch USING (chunk_id)),
eg AS (SELECT criterio, orgao, count(*) AS n, max(score) AS top, string_agg(texto, ' ' ORDER BY rank) AS txt, min(document_id) FILTER (rank = 1) AS documento, min(pagina) FILTER (rank = 1) AS pagina, min(texto) FILTER (rank = 1) AS trecho, bool_or({_NEGATIVE}) FILTER (rank <= 2) AS neg FROM ev GROUP BY criterio, orgao),
pr AS (SELECT o.orgao, cr.*, coalesce(n, 0) AS evidencias_total, coalesce(top, 0) AS score_recuperacao, coalesce(txt, '') AS txt, coalesce(documento, '') AS documento, coalesce(CAST(pagina AS VARCHAR), '') AS pagina, coalesce(trecho, '') AS trecho, coalesce(neg, false) AS neg
  FROM (SELECT DISTINCT orgao FROM ch) o CROSS JOIN cr LEFT JOIN eg ON eg.criterio = cr.criterio AND eg.orgao = o.orgao),
ph AS (SELECT *, list_sort(list_distinct(list_filter(palavras, lambda w: contains({fold("txt")}, {fold("w")})))) AS achadas FROM pr),
la AS (SELECT *, CASE WHEN evidencias_total = 0 OR (score_recuperacao < 0.55 AND len(achadas) = 0) THEN 'nao_encontrado'
  WHEN neg THEN 'nao_atende' WHEN score_recuperacao >= 0.85 AND len(achadas) >= 2 THEN 'atende' ELSE 'atende_parcialmente' END AS classificacao FROM ph),
cl AS (SELECT *, CASE classificacao WHEN 'atende' THEN 1.0::DOUBLE WHEN 'atende_parcialmente' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pontuacao FROM la),
cs AS (SELECT *, {rnd("pontuacao * peso_criterio", 4)} AS score_ponderado FROM cl)"""


def _classified(select: str) -> str:
    return _asked(select, lexical("query_id, orgao"), semantic("query_id, orgao"), fused("query_id, orgao"), _CRITERIA, _LABELS, rows=_CRITERIA_Q)


_WEIGHTS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in K.AXIS_WEIGHTS.items()) + ") t(eixo, peso))"
_AXES = f", ax AS (SELECT orgao, eixo_imga, sum(peso_criterio) AS peso, sum(score_ponderado) AS score, count(*) AS criterios, {rnd('coalesce(sum(score_ponderado) / nullif(sum(peso_criterio), 0) * 100, 0)', 2)} AS score_eixo FROM cs GROUP BY orgao, eixo_imga), {_WEIGHTS}, gi AS (SELECT orgao, {rnd('sum(score_eixo * coalesce(w.peso, 0))', 2)} AS imga_global FROM ax LEFT JOIN w ON w.eixo = ax.eixo_imga GROUP BY orgao), gb AS (SELECT *, CASE WHEN imga_global >= 75 THEN 'Avancada' WHEN imga_global >= 50 THEN 'Intermediaria' WHEN imga_global >= 25 THEN 'Basica' ELSE 'Incipiente' END AS faixa FROM gi)"


def _with_axes(select: str) -> str:
    return _classified(_AXES + "\n" + select)


_PREFIX = " OR ".join(f"starts_with(lower(m), '{k}')" for k in S.KEYWORDS)
_OF = "CASE " + " ".join(f"WHEN contains(lower(m), '{k}') THEN '{k}'" for k in S.KEYWORDS) + " END"
KEYWORDS = rf"""{PAGES},
mt AS (SELECT document_id, orgao, page_no, unnest(regexp_extract_all(substr(texto, 1, 50000), '{WORD}')) AS m FROM pg),
kp AS (SELECT document_id, orgao, page_no, {_OF} AS keyword, least(count(*), 100) AS ocorrencias FROM mt WHERE {_PREFIX} GROUP BY ALL)"""
_WHOLE = KEYWORDS.replace("substr(texto, 1, 50000)", "texto").replace("least(count(*), 100)", "count(*)")
_FIRST = " UNION ".join(f"SELECT regexp_extract(lower(texto), '{p}') AS keyword FROM pg" for p in S.PHRASE_PATTERNS)
#: Phrases by their lengths at each word, hits from the left by a fold, and the first listed phrase that each match holds.
PHRASES = rf"""{PAGES},
di AS (SELECT keyword, CAST('0x' || substr(md5(keyword), 1, 15) AS BIGINT) AS posicao, len(regexp_extract_all(keyword, '{WORD}')) AS w FROM ({_FIRST}) WHERE keyword <> ''),
ln AS (SELECT DISTINCT length(keyword) AS n FROM di),
tk AS (SELECT document_id, orgao, page_no, lower(texto) AS low, unnest(regexp_extract_all(lower(texto), '{WORD}')) AS m, unnest(string_split_regex(lower(texto), '{WORD}')) AS gap, unnest(range(1, len(string_split_regex(lower(texto), '{WORD}')) + 1)) AS i FROM pg),
tp AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(length(coalesce(m, ''))) OVER w - length(coalesce(m, '')) + 1 AS BIGINT) AS pos FROM tk WINDOW w AS (PARTITION BY document_id, page_no ORDER BY i)),
hi AS (SELECT document_id, orgao, page_no, i, posicao, w, keyword || regexp_extract(substr(low, pos + n, 100), '^{WORD}') AS match FROM tp JOIN ln ON m IS NOT NULL JOIN di ON keyword = substr(low, pos, n)),
li AS (SELECT document_id, orgao, page_no, list({{'i': i, 'w': w, 'm': match, 'next': 0::BIGINT, 'out': []::VARCHAR[]}} ORDER BY i, posicao) AS a FROM hi GROUP BY ALL),
ta AS (SELECT document_id, orgao, page_no, unnest(list_reduce(list_prepend({{'i': 0::BIGINT, 'w': 0::BIGINT, 'm': '', 'next': 0::BIGINT, 'out': []::VARCHAR[]}}, a),
  lambda x, y: CASE WHEN y.i >= x.next THEN {{'i': y.i, 'w': y.w, 'm': y.m, 'next': y.i + y.w, 'out': list_append(x.out, y.m)}} ELSE x END).out) AS match FROM li),
pi AS (SELECT match, n, unnest(range(1, length(match) - n + 2)) AS s FROM (SELECT DISTINCT match FROM ta) JOIN ln ON n <= length(match)),
of AS (SELECT match, min_by(keyword, posicao) AS keyword FROM pi JOIN di ON keyword = substr(match, s, n) GROUP BY match)
SELECT document_id, orgao, page_no, keyword, count(*) AS ocorrencias FROM ta JOIN of USING (match) GROUP BY ALL"""
_SPREFIX = " OR ".join(f"starts_with(lower(m), '{k}')" for k in S.SNIPPET_KEYWORDS)
_SOF = "CASE " + " ".join(f"WHEN contains(lower(m), '{k}') THEN '{k}'" for k in S.SNIPPET_KEYWORDS) + " END"
SNIPPETS = rf"""{PAGES},
pw AS (SELECT document_id, orgao, page_no, texto, unnest(regexp_extract_all(texto, '{WORD}')) AS m, unnest(string_split_regex(texto, '{WORD}')) AS gap, unnest(range(1, len(string_split_regex(texto, '{WORD}')) + 1)) AS i FROM (SELECT * REPLACE (substr(texto, 1, 50000) AS texto) FROM pg)),
pp AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(length(coalesce(m, ''))) OVER w - length(coalesce(m, '')) + 1 AS BIGINT) AS pos FROM pw WINDOW w AS (PARTITION BY document_id, page_no ORDER BY i)),
ph AS (SELECT document_id, orgao, page_no, pos, m, {_SOF} AS keyword, {collapse("substr(texto, greatest(pos - 300, 1), pos + length(m) + 300 - greatest(pos - 300, 1))")} AS snippet FROM pp WHERE m IS NOT NULL AND ({_SPREFIX})),
pc AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY document_id, page_no, keyword ORDER BY pos) <= 100),
sn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_no, pos) AS ordem FROM pc QUALIFY ordem <= 500)"""


def _axis_sql() -> str:
    boosts = " + ".join("CAST(" + " OR ".join(rf"regexp_matches(low, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){s}')" for s in v) + " AS INT)" for v in S.BOOSTERS.values())
    flags = ", ".join("(" + " OR ".join(rf"regexp_matches(low, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){s}')" for s in v) + f") AS b_{k}" for k, v in S.BOOSTERS.items())
    found = lambda xs, whole: "list_filter([" + ", ".join(f"CASE WHEN {word('low', x) if whole else f'contains(low, {text(x)})'} THEN {text(x)} END" for x in xs) + "], lambda w: w IS NOT NULL)"
    axes = " UNION ALL ".join(f"SELECT document_id, orgao, segmento, '{a}' AS eixo, {found(s, True)} AS f3, {found(e, False)} AS f2, {found(t, True)} AS f1, {boosts} AS extra, {flags} FROM lo" for a, (t, e, s) in S.LEXICON.items())
    return rf"""{DOCS},
sp AS (SELECT document_id, orgao, regexp_replace(CASE WHEN regexp_matches(text, '\n\s*\n') THEN text ELSE replace(text, chr(10), chr(10) || chr(10)) END, '\n\s*[-–]?\s*\d+\s*[-–]?\s*\n', chr(10), 'g') AS t FROM d),
sl AS (SELECT document_id, orgao, list_filter([trim(x) for x in string_split_regex(regexp_replace(t, '\r\n?', chr(10), 'g'), '\n\s*\n')], lambda x: length(x) >= 20) AS segs FROM sp),
lo AS (SELECT document_id, orgao, lower(unnest(segs)) AS low, generate_subscripts(segs, 1) AS segmento FROM sl),
xa AS ({axes}),
xs AS (SELECT *, CASE WHEN len(f3) > 0 THEN 3 WHEN len(f2) > 0 THEN 2 WHEN len(f1) > 0 THEN 1 ELSE 0 END AS base, CASE WHEN len(f3) > 0 THEN f3 WHEN len(f2) > 0 THEN f2 ELSE f1 END AS evidencias FROM xa),
sg AS (SELECT *, least(base + extra, 5) AS score FROM xs WHERE base > 0)"""


SEGMENTS = _axis_sql()
_AUDIT = rf"""{SEGMENTS}, {_WEIGHTS},
su AS (SELECT document_id, eixo, sum(score) AS soma, count(*) AS segs FROM sg GROUP BY document_id, eixo),
au AS (SELECT d.document_id, w.eixo, w.peso, coalesce(soma, 0) AS raw, coalesce(segs, 0) AS segs, len({words("d.text")}) / 100.0::DOUBLE AS fator FROM d CROSS JOIN w LEFT JOIN su ON su.document_id = d.document_id AND su.eixo = w.eixo),
ad AS (SELECT *, coalesce(raw / nullif(fator, 0), 0) AS dens FROM au),
ai AS (SELECT document_id, eixo, CAST(raw AS BIGINT) AS soma_bruta, CAST(segs AS BIGINT) AS num_segmentos_pontuados, {rnd("fator", 2)} AS fator_normalizacao, {rnd("dens", 4)} AS densidade, {rnd("dens * 10", 2)} AS indice_pre_cap, {rnd("least(dens * 10, 100.0)", 2)} AS indice_final, peso AS peso_metodologia FROM ad),
aj AS (SELECT *, {rnd("indice_final * peso_metodologia", 4)} AS contribuicao_imga FROM ai)"""

_ANCHORS = r"""
an AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS inner_,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
ab AS (SELECT page_id, url, pos, href, trim(regexp_replace(regexp_replace(inner_, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS texto,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS org FROM an),
al AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN regexp_matches(href, '^(mailto|tel|javascript):') THEN href WHEN starts_with(href, '/') THEN org || href ELSE org || '/' || href END AS link FROM ab)"""


_ELEMENTS = rf"""
pages_ AS (SELECT page_id, url, html FROM pages UNION ALL SELECT -1, 'https://x.org/a/', {text(S.HITS_PAGE)}),
ea AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs,
  regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS ps FROM pages_),
eb AS (SELECT page_id, ps, unnest(hs) AS href, unnest(ts) AS t, generate_subscripts(hs, 1) AS pos FROM ea),
el AS (SELECT page_id, pos, href, {collapse("regexp_replace(t, '<[^>]*>', ' ', 'g')")} AS texto,
  coalesce({collapse("regexp_replace(ps[pos], '<[^>]*>', ' ', 'g')")}, '') AS paragrafo FROM eb WHERE len(ps) = 0 OR pos <= len(ps))"""


def _any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(p)})" for p in parts) + ")"


def _likely_other(url: str, title: str) -> str:
    """Links that are likely documents, for kinds other than minutes: PDFs first, whatever the title says."""
    any_of = lambda x, xs: "(" + " OR ".join(f"contains({x}, {text(w)})" for w in xs) + ")"
    u, t = f"lower({url})", f"lower(coalesce({title}, ''))"
    bare = f"regexp_replace(string_split(string_split({u}, '?')[1], '#')[1], '/+$', '')"
    early = f"(regexp_matches({bare}, '([.]pdf|-pdf|_pdf)$') OR contains({u}, '.pdf') OR (contains({u}, '/documents/') AND {any_of(u, K.LINK_EARLY_PATHS)}))"
    general = f"(NOT {any_of(t, K.LINK_TEXT_AGAINST)} AND ({any_of(u, K.LINK_URL_MARKS)} OR ends_with({u}, '-pdf') OR {any_of(t, K.LINK_TEXT_MARKS)}))"
    return f"{url} <> '' AND ({early} OR {general})"


def _likely(url: str, txt: str) -> str:
    u, t = f"lower({url})", f"lower({txt})"
    return f"(NOT {_any(t, K.LINK_TEXT_AGAINST + K.LINK_TEXT_AGAINST_CIG)} AND ({_any(u, K.LINK_URL_MARKS)} OR ends_with({u}, '-pdf') OR {_any(t, K.LINK_TEXT_MARKS)}))"


def _minutes(x: str) -> str:
    return f"(NOT {_any(f'lower({x})', K.MINUTES_AGAINST)} AND ({_any(f'lower({x})', K.MINUTES_WORDS)} OR ({_any(f'lower({x})', K.MINUTES_ORDINALS)} AND regexp_matches({x}, '[0-9]'))))"


def _hit(terms: list[str]) -> str:
    return f"({_any('lower(texto)', terms)} OR {_any('lower(paragrafo)', terms)})"


_FLOW = f"""WITH ag AS (SELECT 'S' || s_suppkey AS sigla, s_suppkey % 7 <> 0 AS url, coalesce(CASE WHEN s_nationkey % 3 <> 0 THEN s_acctbal > 0 END, false) AS atas, s_suppkey % 4 = 0 AS repo FROM supplier),
li AS (SELECT 'S' || l_suppkey AS sigla, bool_or(l_linenumber = 1 AND l_quantity = 50 AND l_discount < 0.01) AS cig, bool_or(l_linenumber = 2 AND l_quantity = 50 AND l_discount < 0.01) AS pg,
  bool_or(l_linenumber = 3 AND l_quantity = 50 AND l_discount < 0.01) AS co, bool_or(l_quantity = 49 AND l_discount < 0.01) AS links FROM lineitem GROUP BY l_suppkey),
j AS (SELECT ag.*, coalesce(cig, false) AS cig, coalesce(pg, false) AS pg, coalesce(co, false) AS co, coalesce(links, false) AS links FROM ag LEFT JOIN li USING (sigla))
SELECT sigla, CASE WHEN NOT url THEN 'sem_url' WHEN NOT repo AND NOT atas THEN 'sem_atas' WHEN cig THEN 'ja_coletado' WHEN repo THEN 'repositorio' ELSE 'busca' END AS acao_cig,
  CASE WHEN NOT url THEN 'sem_url' WHEN pg THEN 'ja_coletado' ELSE 'busca' END AS acao_pg, CASE WHEN NOT url THEN 'sem_url' WHEN co THEN 'ja_coletado' ELSE 'busca' END AS acao_compliance,
  url AS consulta_programa, (NOT cig AND (repo OR atas)) OR NOT pg OR NOT co AS pendente,
  CASE WHEN NOT url THEN '{K.CHECK_NO_URL}' WHEN repo OR NOT atas OR cig OR links THEN '{K.CHECK_OK}' ELSE '{K.CHECK_CONFLICT}' END AS verificacao FROM j"""
_PORTAL = f"""WITH {_ELEMENTS},
tm AS (SELECT unnest({listed(S.HIT_TERMS)}) AS termo, unnest(range({len(S.HIT_TERMS)})) AS n),
hit AS (SELECT page_id, href, regexp_matches(texto, '\\b20\\d{{2}}\\b') AS ano FROM el JOIN tm ON contains(lower(texto), termo) OR contains(lower(paragrafo), termo) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n, pos) = 1)"""

_AGENCY = "CASE " + " ".join(f"WHEN {_any('lower(nome)', v)} THEN '{k}'" for k, v in K.AGENCY_PATTERNS.items()) + " WHEN length(upper(string_split(nome, '_')[1])) <= 10 THEN upper(string_split(nome, '_')[1]) ELSE 'OUTROS' END"
_DATES = "coalesce(" + ", ".join(f"nullif(regexp_extract(texto, '{p}'), '')" for p in K.DATE_PATTERNS) + ")"

_JACCARD = f"len(list_intersect({words('lower(k.snippet)')}, {words('lower(s.snippet)')})) / len(list_distinct(list_concat({words('lower(k.snippet)')}, {words('lower(s.snippet)')})))"
_NEAR = f"""WITH RECURSIVE {SNIPPETS},
fold AS (
  SELECT document_id, 0 AS i, []::STRUCT(ordem BIGINT, snippet VARCHAR)[] AS kept FROM (SELECT DISTINCT document_id FROM sn)
  UNION ALL
  SELECT f.document_id, i + 1, CASE WHEN len(list_filter(kept, lambda k: k.snippet = s.snippet)) > 0 OR len(list_filter(list_slice(kept, greatest(len(kept) - 4, 1), len(kept)), lambda k: {_JACCARD} >= 0.85)) > 0
    THEN kept ELSE list_append(kept, {{'ordem': s.ordem, 'snippet': s.snippet}}) END
  FROM fold f JOIN sn s ON s.document_id = f.document_id AND s.ordem = f.i + 1),
last AS (SELECT document_id, unnest(kept) AS k FROM fold QUALIFY i = max(i) OVER (PARTITION BY document_id))
SELECT document_id, k.ordem AS ordem, k.snippet AS snippet FROM last"""
_ORIGIN = lambda x: f"regexp_extract({x}, '^(https?://[^/?#]+)', 1)"
_CRAWL = f"""WITH {_ANCHORS},
e AS (SELECT string_split(url, '#')[1] AS source, string_split(link, '#')[1] AS target, pos FROM al),
s AS (SELECT string_split(url, '#')[1] AS url FROM pages ORDER BY page_id LIMIT 1),
same AS (SELECT * FROM e WHERE {_ORIGIN("source")} = {_ORIGIN("target")} AND {_ORIGIN("source")} <> ''),
a1 AS (SELECT target, row_number() OVER (ORDER BY pos, target) AS n FROM same JOIN s ON source = s.url WHERE target <> s.url QUALIFY n <= {K.CRAWL_OUTLINKS}),
l1 AS (SELECT target, row_number() OVER (ORDER BY min(n), target) + 1 AS ordem FROM a1 GROUP BY target QUALIFY ordem <= {K.CRAWL_PAGES}),
a2 AS (SELECT same.target, l1.ordem AS o, row_number() OVER (PARTITION BY source ORDER BY pos, same.target) AS n FROM same JOIN l1 ON source = l1.target
  WHERE same.target NOT IN (SELECT target FROM l1) AND same.target NOT IN (SELECT url FROM s) QUALIFY n <= {K.CRAWL_OUTLINKS}),
f2 AS (SELECT target, min({{'o': o, 'n': n}}) AS k FROM a2 GROUP BY target),
l2 AS (SELECT target, row_number() OVER (ORDER BY k, target) + 1 + (SELECT count(*) FROM l1) AS ordem FROM f2 QUALIFY ordem <= {K.CRAWL_PAGES})
SELECT url, 0 AS depth, 1 AS ordem FROM s UNION ALL SELECT target, 1, ordem FROM l1 UNION ALL SELECT target, 2, ordem FROM l2"""


_COSINE = f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, {rnd('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 6)} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS posicao FROM p QUALIFY posicao <= 30"


def _murmur() -> str:
    """MurmurHash3 of distinct words over their hexadecimal bytes, in 128-bit arithmetic, step by step."""
    cut = lambda x: f"(({x}) & 4294967295)"
    times = lambda x, c: cut(f"({x}) * {c}::HUGEINT")
    turned = lambda x, r: f"(({x} * {2**r}::HUGEINT & 4294967295) | ({x} // {2 ** (32 - r)}))"
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(d, {at} + {2 * i}, 2)" for i in reversed(range(n))) + ")::HUGEINT"
    mixed = lambda x: times(turned(times(x, 0xCC9E2D51), 15), 0x1B873593)
    return rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS palavra FROM documents),
x AS (SELECT palavra, hex(encode(palavra)) AS d FROM w),
b AS (SELECT palavra, d, length(d) // 2 AS n, [{mixed(number("(8 * i + 1)", 4))} FOR i IN range(length(d) // 8)] AS ks FROM x),
h AS (SELECT palavra, d, n, list_reduce(list_prepend(0::HUGEINT, ks), lambda h, k: {cut(f"{turned('xor(h, k)', 13)} * 5 + {0xE6546B64}")}) AS h FROM b),
t AS (SELECT palavra, n, xor(xor(h, CASE n % 4 {" ".join(f"WHEN {k} THEN {mixed(number('(8 * (n // 4) + 1)', k))}" for k in (1, 2, 3))} ELSE 0::HUGEINT END), n::HUGEINT) AS h FROM h),
f AS (SELECT palavra, {times("xor(h, h // 65536)", 0x85EBCA6B)} AS h FROM t),
g AS (SELECT palavra, {times("xor(h, h // 8192)", 0xC2B2AE35)} AS h FROM f),
s AS (SELECT palavra, CAST(xor(h, h // 65536) AS BIGINT) AS h FROM g),
z AS (SELECT palavra, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM s)
SELECT palavra, hash, abs(hash) % {K.DIMENSIONS} AS bucket FROM z"""


def _upserted(all_of_them: bool = False) -> str:
    """The documents after the second batch, and without those that the third drops."""
    of = "" if all_of_them else " WHERE doc_id % 7 <> 0"
    return f"SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN {text(S.NEWER)} || coalesce(text, '') ELSE text END AS text FROM documents{of}"


_TOKENS = _asked("", lexical()).replace("FROM documents)", "FROM ($DOCS$))").strip()
_TERMS = (_TOKENS + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tk) GROUP BY ALL) GROUP BY term").replace("{", "{{").replace("}", "}}").replace("$DOCS$", "{}")


def _version(number: int, docs: str) -> str:
    """Chunks, mean length and one term of the index of some documents."""
    rows = f"SELECT CAST({number} AS BIGINT) AS versao, count(*) AS n, {rnd('avg(dl)', 6)} AS avgdl, count(*) FILTER (list_contains(tokens, '{S.TERM}')) AS df, CAST(coalesce(sum(len(list_filter(tokens, lambda w: w = '{S.TERM}'))), 0) AS BIGINT) AS cf FROM tk"
    return f"SELECT * FROM ({_TOKENS.replace('$DOCS$', docs)} {rows})"


ORACLES = {
    "snippets_near_dedup": _NEAR,
    "bfs_hubs": _CRAWL,
    "index_counts": f"WITH RECURSIVE {CHUNKS} SELECT (SELECT count(*) FROM d) AS documentos, (SELECT count(DISTINCT orgao) FROM d) AS orgaos, (SELECT count(DISTINCT tipo_documento) FROM d) AS tipos, (SELECT count(*) FROM ch) AS chunks",
    "manifest_by_type": f"WITH {DOCS} SELECT tipo_documento, count(*) AS documentos, array_to_string(list_sort(list(DISTINCT orgao)), ',') AS orgaos FROM d GROUP BY tipo_documento",
    "document_totals": f"WITH {PAGES}, t AS (SELECT document_id, {collapse('texto')} AS t FROM pg) SELECT d.document_id, count(t.t) AS paginas, CAST(coalesce(sum(len({words('t.t')})), 0) AS BIGINT) AS palavras_total, CAST(coalesce(sum(length(t.t)), 0) AS BIGINT) AS caracteres_total FROM d LEFT JOIN t USING (document_id) GROUP BY d.document_id",
    "pages_numbered": f"WITH {PAGES} SELECT document_id, page_no, page_pos, sha1(texto) AS hash_texto FROM pg",
    "chunk_identity": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, document_id, pagina, ordem, hash_texto, len({words('texto')}) AS palavras, length(texto) AS caracteres FROM ch",
    "hard_split": f"WITH {DOCS}, s AS (SELECT document_id, list_filter([trim(substr({collapse('text')}, k + 1, 100)) for k in range(0, greatest(length({collapse('text')}), 1), 80)], lambda w: w <> '') AS w FROM d) SELECT document_id, len(w) AS janelas, sha1(array_to_string(w, '|')) AS resumo FROM s",
    "index_build": _asked("SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM ch) AS vectors, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT term) AS term_stats, (SELECT n FROM st) AS n, " + rnd("(SELECT avgdl FROM st)", 6) + " AS avgdl FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tk) GROUP BY ALL)", lexical()),
    "evidence_context": _asked("SELECT query_id, string_agg('[' || rank || '] Documento: ' || document_id || chr(10) || 'Órgão: ' || ch.orgao || chr(10) || 'Tipo: ' || tipo_documento || chr(10) || 'Página: ' || pagina || chr(10) || 'Trecho: ' || texto, chr(10) || chr(10) ORDER BY rank) AS contexto FROM hy JOIN ch USING (chunk_id) GROUP BY query_id", lexical(), semantic(), fused()),
    "cited_answer": _asked(f"SELECT q.query_id, coalesce({text(K.ANSWER_HEAD)} || string_agg(rank || '. ' || trim(substr(texto, 1, 420)) || CASE WHEN length(texto) > 420 THEN '...' ELSE '' END || ' Fonte: ' || document_id || ', página ' || pagina || '.', chr(10) ORDER BY rank) || {text(K.ANSWER_TAIL)}, {text(K.ANSWER_NONE)}) AS resposta FROM q LEFT JOIN (SELECT * FROM hy JOIN ch USING (chunk_id) WHERE rank <= 3) h ON h.query_id = q.query_id GROUP BY q.query_id", lexical(), semantic(), fused(), rows=[*S.QUESTIONS, ("q5", "xyzzy plugh qwerty", "NONE", None)]),
    "bm25_phrases": _asked("SELECT query_id, chunk_id, score, posicao FROM lex", _phrases(), rows=S.PHRASES),
    "label_distribution": _classified("SELECT classificacao, count(*) AS criterios FROM cs GROUP BY classificacao"),
    "indicator_means": _with_axes(f"SELECT count(*) AS orgaos, {rnd('CAST(sum(CAST(c AS DECIMAL(18, 2))) AS DOUBLE) / count(*)', 2)} AS conformidade_media, {rnd('CAST(sum(CAST(imga_global AS DECIMAL(18, 2))) AS DOUBLE) / count(*)', 2)} AS imga_medio FROM (SELECT orgao, {rnd('coalesce(sum(score_ponderado) / nullif(sum(peso_criterio), 0) * 100, 0)', 2)} AS c, any_value(imga_global) AS imga_global FROM cs JOIN gb USING (orgao) GROUP BY orgao)"),
    "bm25_topk": _asked("SELECT query_id, chunk_id, score, posicao FROM lex", lexical()),
    "index_upsert": _TERMS.format(_upserted()),
    "index_versions": " UNION ALL ".join(_version(n, docs) for n, docs in ((1, "SELECT * FROM documents WHERE doc_id % 10 < 8"), (2, _upserted(True)), (3, _upserted()))),
    "index_stream": _TERMS.format("SELECT * FROM documents"),
    "control_states": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SAID.items())} END AS state, lpad(CAST(event_id AS VARCHAR), 12, '0') AS task FROM events WHERE user_id IS NOT NULL),
r AS (SELECT id, min(task) AS task FROM e WHERE state = 'run' GROUP BY id), f AS (SELECT id, min_by(state, task) AS state FROM e WHERE state IN ('completed', 'failed') GROUP BY id)
SELECT id, coalesce(f.state, 'running') AS state, 1::BIGINT AS attempt, task, 1::BIGINT AS runs FROM r LEFT JOIN f USING (id)""",
    "murmur_buckets": _murmur(),
    "acronym_table": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN substr(r_name, 1, 2) ELSE '' END AS sigla FROM nation JOIN region ON n_regionkey = r_regionkey",
    "csv_typed": "SELECT o_orderkey AS chave, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS data, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS valor, CASE WHEN o_orderkey % 7 = 0 THEN 'DATA DE APRESENTACAO DO PEDIDO' END AS motivo FROM orders",
    "windowed_events": "SELECT strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS inicio, event_type, count(*) AS n FROM events GROUP BY ALL",
    "titles_shown": r"SELECT page_id, sha1(regexp_replace(substr(html, 1, 300), '[\p{C}\p{Zl}\p{Zp}]', ' ', 'g')) AS inicio, regexp_replace(url, '[^\p{L}\p{N} ._]', '_', 'g') AS arquivo, coalesce(nullif(trim(translate(url_decode(string_split(regexp_replace(regexp_replace(string_split_regex(url, '[?#]')[1], '^[a-z]+://[^/]*', ''), '/+$', ''), '/')[-1]), '-_', '  ')), ''), 'documento') AS titulo FROM pages".replace("\\\\", "\\"),
    "document_links_kinds": f"WITH {_ANCHORS} " + " UNION ALL ".join(f"SELECT page_id, pos, link, CASE WHEN texto <> '' THEN texto ELSE 'documento' END AS titulo, '{k}' AS tipo FROM al WHERE {_likely_other('link', 'texto')}" for k in ("pg", "compliance")),
    "snippets_written": rf"WITH {SNIPPETS} SELECT document_id, orgao, keyword, ordem, sha1(regexp_replace(snippet, '[\p{{C}}\p{{Zl}}\p{{Zp}}]', ' ', 'g')) AS resumo FROM sn".replace("\\\\", "\\"),
    "new_keys_written": "SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS rodada FROM documents",
    "catalog_files": f"WITH {DOCS} SELECT tipo_documento, orgao, count(*) AS n, string_agg(document_id || '.pdf', ',' ORDER BY document_id || '.pdf') AS arquivos FROM d GROUP BY ALL",
    "postings_stats": _asked(r"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tk) GROUP BY ALL) GROUP BY term", lexical()),
    "like_fallback": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, 0.0::DOUBLE AS score FROM ch WHERE contains(lower(texto), 'idiot') OR contains(lower(texto), 'worthless') ORDER BY chunk_id LIMIT 30",
    "hash_embedding": f"WITH RECURSIVE {CHUNKS},{vectors('ch', 'chunk_id', 'texto', 'cv')} SELECT chunk_id, CAST(bucket AS BIGINT) AS bucket, {rnd('weight', 6)} AS weight FROM cv",
    "cosine_topk": _COSINE,
    "cells_topk_exact": _COSINE,
    "semantic_topk_filtered": _asked("SELECT query_id, chunk_id, score, posicao FROM sem", semantic()),
    "semantic_many": f"WITH RECURSIVE {CHUNKS}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS pergunta, NULL::VARCHAR AS q_orgao, NULL::VARCHAR[] AS tipos FROM benchmark),{semantic()}\nSELECT query_id, chunk_id, score, posicao FROM sem",
    "hybrid_rrf_topk": _asked(f"SELECT query_id, chunk_id, score, {rnd('sl', 6)} AS score_lexical, {rnd('sv', 6)} AS score_semantico, fontes, rank, document_id AS documento, pagina, texto AS trecho FROM hy JOIN ch USING (chunk_id)", lexical(), semantic(), fused()),
    "hybrid_batch_criteria": _asked("SELECT query_id AS criterio, chunk_id, score, fontes, rank FROM hy", lexical(), semantic(), fused(), rows=_CRITERIA_Q),
    "criterion_classification": _classified("SELECT orgao, criterio, eixo_imga, peso_criterio, classificacao, pontuacao, score_ponderado, score_recuperacao, evidencias_total, array_to_string(achadas, ',') AS palavras_chave_encontradas FROM cs"),
    "axis_scores": _with_axes("SELECT orgao, eixo_imga, peso, score, criterios, score_eixo FROM ax"),
    "org_indicators": _with_axes(f"SELECT orgao, count(*) AS criterios_avaliados, {rnd('sum(peso_criterio)', 4)} AS peso_total, {rnd('sum(score_ponderado)', 4)} AS score_total, {rnd('coalesce(sum(score_ponderado) / nullif(sum(peso_criterio), 0) * 100, 0)', 2)} AS conformidade_percentual, any_value(imga_global) AS imga_global, any_value(faixa) AS faixa FROM cs JOIN gb USING (orgao) GROUP BY orgao"),
    "label_histogram": _classified("SELECT orgao, " + ", ".join(f"count(*) FILTER (classificacao = '{k}') AS {k}" for k in K.LABEL_POINTS) + " FROM cs GROUP BY orgao"),
    "negative_labels": _classified("SELECT orgao, criterio, classificacao, pontuacao, evidencias_total, neg AS negativo FROM cs WHERE criterio = 'E1-GOV-001'").replace("coalesce(text, '') AS text FROM documents", f"CASE WHEN doc_id % 3 = 0 THEN {text(S.NEGATIVE)} ELSE '' END || coalesce(text, '') AS text FROM documents"),
    "document_links_pdf": f"WITH pages_ AS (SELECT page_id, url, html FROM pages UNION ALL SELECT -1, 'https://x.org/a/', {text(S.LINKS_PAGE)}), {_ANCHORS.replace('FROM pages)', 'FROM pages_)')}, "
    f"p AS (SELECT *, regexp_replace(link, '[?#].*$', '') AS pfad FROM al WHERE {_likely('link', 'texto')}) SELECT page_id, pos, link, CASE WHEN texto <> '' THEN texto ELSE translate(regexp_extract(pfad, '([^/]+)/*$', 1), '-_', '  ') END AS titulo FROM p WHERE ends_with(lower(pfad), '.pdf')",
    "org_ranking": _with_axes("SELECT *, row_number() OVER (ORDER BY imga_global DESC, orgao) AS posicao FROM gb"),
    "org_criterion_matrix": _classified("SELECT orgao, criterio, eixo_imga, classificacao, pontuacao, score_ponderado, evidencias_total, documento, pagina, trecho FROM cs"),
    "manual_sample": _classified("SELECT orgao, criterio, eixo_imga, classificacao, pontuacao, score_ponderado, evidencias_total, documento, pagina, trecho, '' AS avaliacao_manual, '' AS classificacao_correta, '' AS observacoes, '' AS avaliador FROM cs ORDER BY orgao, criterio LIMIT 20"),
    "keyword_counts_exact": f"WITH {_WHOLE} SELECT * FROM kp",
    "keyword_counts_phrases": f"WITH {PHRASES}",
    "keyword_counts_page": f"WITH {KEYWORDS} SELECT * FROM kp",
    "keyword_counts_doc": f"WITH {KEYWORDS} SELECT document_id, orgao, keyword, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias FROM kp GROUP BY ALL",
    "keyword_counts_global": f"WITH {KEYWORDS} SELECT keyword, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias FROM kp GROUP BY ALL",
    "keyword_pct": f"WITH {KEYWORDS}, t AS (SELECT sum(len({words('text')})) AS n FROM d) SELECT keyword, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias, {rnd('sum(ocorrencias) * 100.0::DOUBLE / any_value(n)', 4)} AS percentual FROM kp CROSS JOIN t GROUP BY keyword",
    "top_keywords_org": f"WITH {KEYWORDS}, t AS (SELECT orgao, keyword, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias FROM kp GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY orgao ORDER BY ocorrencias DESC, keyword) AS posicao FROM t QUALIFY posicao <= 3",
    "top_keywords_global": f"WITH {KEYWORDS} SELECT keyword, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias FROM kp GROUP BY ALL ORDER BY ocorrencias DESC, keyword LIMIT 20",
    "org_estimates": f"WITH {KEYWORDS}, t AS (SELECT count(*) AS n, sum(len({words('text')})) AS w FROM d), o AS (SELECT sum(ocorrencias) AS o FROM kp), g AS (SELECT orgao, count(*) AS documentos FROM d GROUP BY orgao) SELECT orgao, documentos, CAST(floor(w * documentos / n) AS BIGINT) AS palavras, CAST(floor(o * documentos / n) AS BIGINT) AS ocorrencias, {rnd('documentos * 100.0::DOUBLE / n', 2)} AS percentual FROM g CROSS JOIN t CROSS JOIN o",
    "org_totals": f"WITH {KEYWORDS}, g AS (SELECT orgao, count(*) AS documentos, CAST(sum(len({words('text')})) AS BIGINT) AS palavras FROM d GROUP BY orgao), o AS (SELECT orgao, CAST(sum(ocorrencias) AS BIGINT) AS ocorrencias FROM kp GROUP BY orgao) SELECT orgao, documentos, palavras, coalesce(ocorrencias, 0) AS ocorrencias FROM g LEFT JOIN o USING (orgao)",
    "run_summary": f"WITH {KEYWORDS}, t AS (SELECT count(*) AS documentos, CAST(sum(len({words('text')})) AS BIGINT) AS palavras FROM d), o AS (SELECT CAST(coalesce(sum(ocorrencias), 0) AS BIGINT) AS ocorrencias FROM kp) SELECT documentos, palavras, ocorrencias, {len(S.KEYWORDS)} AS palavras_chave, {rnd('ocorrencias * 1.0::DOUBLE / documentos', 2)} AS media_por_documento FROM t CROSS JOIN o",
    "snippets": f"WITH {SNIPPETS} SELECT document_id, orgao, page_no, CAST(pos AS BIGINT) AS pos, m AS match, keyword, snippet, ordem FROM sn",
    "snippets_exact_dedup": f"WITH {SNIPPETS} SELECT document_id, ordem, snippet FROM sn QUALIFY row_number() OVER (PARTITION BY document_id, md5(snippet) ORDER BY ordem) = 1",
    "jaccard_lines": f"WITH {PAGES}, b AS (SELECT document_id, page_no, list_distinct({words('lower(texto)')}) AS w FROM pg), n AS (SELECT *, lead(w) OVER (PARTITION BY document_id ORDER BY page_no) AS n FROM b) SELECT document_id, page_no, {rnd('len(list_intersect(w, n)) / len(list_distinct(list_concat(w, n)))', 6)} AS jaccard FROM n WHERE n IS NOT NULL",
    "segment_scores": f"WITH {SEGMENTS} SELECT document_id, segmento, eixo, score, array_to_string(evidencias, ',') AS evidencias FROM sg",
    "axis_statistics": f"WITH {SEGMENTS}, t AS (SELECT eixo, list_sort(list(DISTINCT x)) AS ts FROM (SELECT eixo, unnest(evidencias) AS x FROM sg) GROUP BY eixo) SELECT sg.eixo, count(*) AS segmentos, CAST(sum(len(evidencias)) AS BIGINT) AS ocorrencias, array_to_string(any_value(ts), ',') AS termos, any_value(len(ts)) AS termos_unicos, " + ", ".join(f"count(*) FILTER (b_{k}) AS ativacoes_{k}" for k in S.BOOSTERS) + " FROM sg JOIN t USING (eixo) GROUP BY sg.eixo",
    "imga_axis_audit": f"WITH {_AUDIT} SELECT * FROM aj",
    "imga_document": f"WITH {_AUDIT}, x AS (SELECT document_id, {rnd('sum(indice_final * peso_metodologia) * 10', 2)} AS imga, {rnd('sum(contribuicao_imga)', 4)} AS contribuicoes FROM aj GROUP BY document_id) SELECT *, CASE WHEN imga > 75 THEN 'Avancada' WHEN imga > 50 THEN 'Intermediaria' WHEN imga > 25 THEN 'Basica' ELSE 'Incipiente' END AS faixa FROM x",
    "term_consolidation": f"WITH {SEGMENTS}, t AS (SELECT eixo, document_id, unnest(evidencias) AS x FROM sg) SELECT eixo, array_to_string(list_sort(list(DISTINCT x)), ', ') AS termos, count(*) AS ocorrencias, count(DISTINCT document_id) AS documentos FROM t GROUP BY eixo",
    "missing_document_types": f"WITH g AS (SELECT conv_id AS orgao, list(DISTINCT role) AS ts FROM conversations GROUP BY conv_id), m AS (SELECT *, list_filter({listed(S.TYPES)}, lambda t: NOT list_contains(ts, t)) AS a FROM g) SELECT orgao, array_to_string(a, ',') AS ausentes, CASE WHEN list_contains(a, '{S.SEVERE[0]}') AND list_contains(a, '{S.SEVERE[1]}') THEN 'Risco Alto' ELSE 'Risco Moderado' END AS risco FROM m WHERE len(a) > 0",
    "processed_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "org_from_filename": f"WITH n AS (SELECT page_id, string_split(url, '/')[-1] AS nome FROM pages) SELECT page_id, {_AGENCY} AS orgao FROM n",
    "acronym_lookup": "SELECT n_nationkey, CASE n_name WHEN 'BRAZIL' THEN 'BR' WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' ELSE '' END AS sigla FROM nation",
    "page_anchors": f"WITH {_ANCHORS} SELECT page_id, pos, href, texto, link FROM al",
    "anchors_paragraphs": f"WITH {_ELEMENTS} SELECT * FROM el",
    "search_hits": rf"WITH {_ELEMENTS}, h AS (SELECT page_id, href, regexp_matches(texto, '\b20\d{{2}}\b') AS ano FROM el WHERE {_hit(S.HIT_TERMS)} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1), t AS (SELECT DISTINCT page_id FROM el WHERE {_any('lower(texto)', S.HIT_TERMS)}) SELECT page_id, h.page_id IS NOT NULL AS achou, href, coalesce(ano, false) AS tem_ano, t.page_id IS NOT NULL AS no_titulo FROM pages_ LEFT JOIN h USING (page_id) LEFT JOIN t USING (page_id)",
    "collection_flow": _FLOW,
    "document_links": f"WITH {_ANCHORS} SELECT page_id, pos, link, CASE WHEN texto <> '' THEN texto ELSE 'documento' END AS titulo FROM al WHERE {_likely('link', 'texto')}",
    "link_dedup": f"WITH {_ANCHORS}, k AS (SELECT *, string_split(lower(link), '?')[1] AS mesmo FROM al) SELECT link, mesmo, page_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY mesmo ORDER BY page_id, pos) = 1",
    "hub_pages": f"WITH {_ANCHORS}, s AS (SELECT page_id, url, count(*) FILTER ({_likely('link', 'texto')} AND regexp_matches(link, '^https?://')) AS pdf_score FROM al WHERE pos <= 300 AND href <> '' AND NOT starts_with(href, '#') GROUP BY page_id, url) SELECT page_id, pdf_score, {_any(_path := "lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1))", K.HUB_PATHS['cig'])} AS palavra, ({_any(_path, K.HUB_PATHS['cig'])} OR pdf_score >= 2) AS hub FROM s",
    "minutes_titles": f"WITH {PAGES} SELECT document_id, page_no, texto AS titulo FROM pg WHERE {_minutes('texto')}",
    "title_dates": rf"WITH {PAGES} SELECT document_id, page_no, {_DATES} AS data, regexp_matches(texto, '\b20\d{{2}}\b') AS tem_ano FROM pg WHERE {_DATES} IS NOT NULL",
    "extractive_answer": f"WITH {PAGES}, t AS (SELECT document_id, page_no, {collapse('texto')} AS t FROM pg) SELECT document_id, page_no, CASE WHEN length(t) > 420 THEN trim(substr(t, 1, 420)) || '...' ELSE t END AS trecho FROM t",
    "conversion_stats": f"SELECT event_type AS tipo, count(*) FILTER (value >= 50) AS sucesso, count(*) FILTER (NOT value >= 50) AS falha, count(*) AS total, {rnd('count(*) FILTER (value >= 50) * 100.0::DOUBLE / count(*)', 2)} AS taxa_sucesso FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "rolling_avg_last10": f"SELECT event_type, event_id, {rnd('avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 4)} AS media FROM events",
    "streamed_ingest_counts": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
    "label_agreement": "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "conversation_pages": f"SELECT conv_id, count(*) AS paginas, CAST(sum(len({words('text')})) AS BIGINT) AS palavras, array_to_string(list_sort(list(DISTINCT role)), ',') AS papeis FROM conversations GROUP BY conv_id",
}
ORACLES["portal_links"] = (
    f"{_PORTAL} SELECT page_id, href AS link, 'titulo' AS origem FROM hit WHERE NOT ano UNION ALL SELECT page_id, el.href, 'ano' FROM el JOIN hit USING (page_id) WHERE ano AND regexp_matches(texto, '\\b20\\d{{2}}\\b') "
    f"UNION ALL SELECT page_id, url, 'hub' FROM ({ORACLES['hub_pages']}) AS s JOIN pages USING (page_id) WHERE hub AND page_id NOT IN (SELECT page_id FROM hit)"
)
ORACLES["matrix_selected"] = f"SELECT orgao, criterio, classificacao, printf('%.2f', score_ponderado) AS score FROM ({ORACLES['org_criterion_matrix']}) AS m WHERE orgao = 'SRC0' AND classificacao IN ('atende', 'atende_parcialmente')"
ORACLES["words_shown"] = f"WITH {DOCS}, g AS (SELECT orgao, count(*) AS n, sum(len({words('text')})) AS w FROM d GROUP BY orgao) SELECT orgao, replace(format('{{:,}}', CAST(n AS BIGINT)), ',', '.') AS documentos, replace(format('{{:,}}', CAST(w AS BIGINT)), ',', '.') AS palavras FROM g"
ORACLES["keywords_ranked"] = f"""SELECT keyword, coalesce(c.ocorrencias, 0) AS ocorrencias, {rnd("coalesce(c.ocorrencias, 0) * 100.0::DOUBLE / w", 2)} AS percentual, row_number() OVER (ORDER BY coalesce(c.ocorrencias, 0) DESC, keyword) AS posicao
FROM (SELECT unnest({listed([*S.KEYWORDS, S.ABSENT])}) AS keyword) AS k LEFT JOIN ({ORACLES["keyword_counts_global"]}) AS c USING (keyword) CROSS JOIN (WITH {DOCS} SELECT sum(len({words("text")})) AS w FROM d) AS t"""
#: Queries that differ from others in the way alone, by files that are written and read.
ORACLES |= {"retrieve_evidence": ORACLES["hybrid_rrf_topk"], "summary_written": ORACLES["org_estimates"], "report_written": ORACLES["org_criterion_matrix"]}

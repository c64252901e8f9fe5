"""Word lists, weights, thresholds and limits that results depend on."""

from __future__ import annotations

# Fixed values of retrieval.
DOCUMENT_TYPES = ("cig", "pg", "compliance", "integridade")
CHUNK_SIZE, CHUNK_OVERLAP, DIMENSIONS, MAX_PAGES = 1200, 200, 384, 40
WEIGHT_LEXICAL, WEIGHT_SEMANTIC, RRF_K = 0.55, 0.45, 60
LEXICAL_LIMIT, SEMANTIC_LIMIT, TOP_K = 30, 30, 5
FTS_TOKENS, LIKE_TOKENS = 16, 8
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
QUERY_STOP_WORDS = "a as ao aos como com da das de do dos e em ha na nas no nos o os ou para por possui previsto que se um uma".split()
FOLD_FROM, FOLD_TO = "áàâãéêíóôõúç", "aaaaeeiooouc"

# Fixed values of classification.
LABEL_POINTS = {"atende": 1.0, "atende_parcialmente": 0.5, "nao_atende": 0.0, "nao_encontrado": 0.0}
MIN_FULL, MIN_PARTIAL, MIN_HITS, SAMPLE_SIZE = 0.85, 0.55, 2, 20
NEGATIVE_SIGNALS = (
    r"\bnao\s+(ha|existe|possui|consta|foi|foram|identificado|identificada)\b",
    r"\binexist(e|em|encia|ente|entes)\b",
    r"\bausencia\s+de\b",
    r"\bsem\s+(evidencia|registro|previsao|comprovacao|formalizacao)\b",
)
REASONS = {
    "nao_encontrado": "Nao foram encontradas evidencias suficientes para o criterio.",
    "nao_atende": "As evidencias recuperadas indicam ausencia, inexistencia ou falta de formalizacao.",
    "atende": "Ha evidencia documental especifica com recuperacao forte e termos esperados do criterio.",
    "atende_parcialmente": "Ha evidencia relacionada, mas ela e parcial, generica ou insuficiente para aderencia plena.",
}
AXIS_WEIGHTS = {"E1": 0.10, "E2": 0.10, "E3": 0.15, "E4": 0.20, "E5": 0.10, "E6": 0.15, "E7": 0.10, "E8": 0.10}
INDEX_SCALE = 10

# Fixed values of the maturity lexicon: (terms, expressions, subsignals) of each axis, and stems that raise a score.
LEXICON = {
    "E1": (
        ["diretoria", "conselho", "alta administração", "instância decisória", "liderança estratégica"],
        ["aprovado pelo conselho", "deliberação colegiada", "patrocínio institucional", "apoio da alta administração", "comprometimento da alta administração"],
        ["comitê de auditoria", "comitê de riscos", "comitê de compliance", "comitê de integridade", "conselho fiscal", "diretoria estatutária"],
    ),
    "E2": (
        ["ética", "integridade", "valores", "conduta", "comportamento ético"],
        ["liderar pelo exemplo", "tom da alta administração", "cultura de integridade", "disseminação de valores", "fazer a coisa certa"],
        ["semana da integridade", "ações de aculturamento", "pacto empresarial pela integridade", "código de ética e conduta"],
    ),
    "E3": (
        ["conformidade", "aderência", "normativos", "regulação", "controles"],
        ["conformidade legal", "aderência normativa", "controles administrativos", "procedimentos internos de compliance"],
        ["política de conflito de interesses", "política de transações com partes relacionadas", "manual de alçadas", "compliance officer"],
    ),
    "E4": (
        ["terceiros", "fornecedores", "parceiros", "diligência"],
        ["análise de integridade de terceiros", "avaliação prévia de riscos", "due diligence de integridade"],
        ["dossiê de compliance", "parecer de integridade", "verificação de pessoa politicamente exposta", "pep"],
    ),
    "E5": (
        ["treinamento", "capacitação", "comunicação", "conscientização", "divulgação"],
        ["campanhas de integridade", "educação corporativa", "comunicação institucional"],
        ["universidade corporativa", "plano de comunicação", "monitoramento contínuo", "revisão do programa"],
    ),
    "E6": (
        ["riscos", "controles", "auditoria", "mapeamento"],
        ["matriz de riscos", "gerenciamento de riscos corporativos", "sistema de controles internos"],
        ["coso erm", "três linhas de defesa", "auditoria interna", "plano de mitigação"],
    ),
    "E7": (
        ["transparência", "prestação de contas", "divulgação", "acesso"],
        ["divulgação pública", "acesso à informação", "evidenciação de resultados"],
        ["relatório de integridade", "portal da transparência", "auditoria independente", "parecer técnico"],
    ),
    "E8": (
        ["efetividade", "maturidade", "resultados", "impacto"],
        ["implementação efetiva", "melhoria contínua", "fortalecimento da governança"],
        ["índice de maturidade", "indicadores de desempenho", "plano de aprimoramento", "revisão anual"],
    ),
}
BOOSTERS = {
    "acao": ["implementou", "realiza", "executa", "monitora", "apura", "investiga", "audita"],
    "periodicidade": ["anualmente", "mensalmente", "trimestralmente", "periodicamente", "contínua"],
    "responsavel": ["conselho", "diretoria", "compliance officer", "auditoria", "comitê"],
    "artefato": ["política", "manual", "regimento", "fluxo", "plano", "relatório"],
}
SCORE_CAP = 5

# Fixed values of keyword scans.
PAGE_CHARS, PAGE_MATCHES, DOC_SNIPPETS, SNIPPET_CHARS, SNIPPET_JACCARD, SNIPPET_LOOK_BACK, SEGMENT_CHARS = 50_000, 100, 500, 300, 0.85, 5, 20

# Fixed values of link rules and of the crawl.
SEARCH_TERMS = {
    "cig": ["cig atas", "Comitê Interno de Governança", "cigp", "Reuniões: Atas", "Relatórios de Reuniões de Governança"],
    "pg": ["programa de integridade", "programa integridade", "integridade e compliance"],
    "compliance": ["plano de compliance", "plano compliance", "compliance", "plano de integridade e compliance"],
}
LINK_URL_MARKS = [".pdf", "/documents/", "documento", "ata", "reuniao"]
LINK_TEXT_MARKS = ["pdf", "ata", "reunião", "relatório"]
LINK_TEXT_AGAINST = ["diário", "instrução", "portaria", "resolução", "apresentação", "decreto", "certificado", "retificação", "organograma", "pesquisa", "cartilhas", "guia", "certidão", "manual"]
LINK_TEXT_AGAINST_CIG = ["plano", "política"]
LINK_EARLY_PATHS = ["compliance", "integridade", "programa", "compactado"]
PDF_MARKS = ["/documents/", "/documento", "/ata", "/reuniao", "/relatorio", "/arquivo", "pdf-", "_pdf", "download"]
PDF_ENDINGS = ["-pdf", "_pdf", "-doc", "_doc", "documento", "ata", "reuniao", "relatorio"]
MINUTES_WORDS = ["ata", "reunião", "reuniao", "sessão", "sessao", "encontro", "assembleia", "conselho", "comissão", "comissao", "colegiado", "plenária", "plenaria"]
MINUTES_AGAINST = ["resolução", "governança", "portaria"]
MINUTES_ORDINALS = ["º", "ª", "ordinária", "ordinaria", "extraordinária", "extraordinaria", "especial"]
DATE_PATTERNS = [r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{2}-\d{2}-\d{4}\b", r"\b\d{2}\.\d{2}\.\d{4}\b", r"\b\d{2} de [A-Za-zçÇ]+ de \d{4}\b", r"\b[A-Za-zçÇ]+ de \d{4}\b", r"\b\d{4}\b"]
HUB_PATHS = {
    "cig": ["cig", "governanca", "governança", "ata", "atas", "transparencia", "transparência", "acervo", "documento", "comite", "comitê", "reuniao", "reunião", "colegiado"],
    "pg": ["integridade", "programa", "compliance", "transparencia", "transparência"],
    "compliance": ["compliance", "integridade", "plano", "transparencia", "transparência"],
}
CRAWL_PAGES, CRAWL_DEPTH, CRAWL_HUBS, CRAWL_ANCHORS, CRAWL_OUTLINKS = 35, 2, 5, 300, 40

# Substrings of file names that tell an agency, in the order in which they are tried.
AGENCY_PATTERNS = {
    "SEMA": ["sema", "meio ambiente"],
    "JUCIS": ["jucis", "junta comercial"],
    "EMATER": ["emater", "assistência técnica"],
    "PCDF": ["pcdf", "polícia civil"],
    "UNDF": ["undf", "universidade"],
    "SEPE": ["sepe", "projetos especiais"],
    "IPEDF": ["ipedf", "pesquisa estatística"],
    "DETRAN": ["detran", "trânsito"],
    "CACI": ["caci", "casa civil"],
    "CBM": ["cbm", "bombeiros"],
    "CGDF": ["cgdf", "controladoria"],
    "CM": ["cm", "casa militar"],
    "DER": ["der", "estradas"],
    "DF_LEGAL": ["df legal", "ordem urbanística"],
    "FAPDF": ["fapdf", "apoio pesquisa"],
    "FEPECS": ["ensino pesquisa"],
    "FHB": ["fhb", "hemocentro"],
    "IBRAM": ["ibram", "brasília ambiental"],
    "IPREVDF": ["iprevdf", "previdência"],
    "JBB": ["jbb", "jardim botânico"],
    "PGDF": ["pgdf", "procuradoria"],
    "PROCON": ["procon", "consumidor"],
    "SEAC": ["seac", "atendimento comunidade"],
    "SEAGRI": ["seagri", "agricultura"],
    "SEAPE": ["seape", "administração penitenciária"],
    "SECTI": ["secti", "ciência tecnologia"],
    "SEDES": ["sedes", "desenvolvimento social"],
    "SEDUH": ["seduh", "desenvolvimento urbano"],
    "SEEDF": ["seedf", "educação"],
    "SEGOV": ["segov", "governo"],
    "SEJUS": ["sejus", "justiça cidadania"],
    "SEJUV": ["sejuv", "família juventude"],
    "SEMOB": ["semob", "transporte mobilidade"],
    "SES": ["ses", "saúde"],
    "SLU": ["slu", "limpeza urbana"],
    "SMDF": ["smdf", "mulher"],
    "SODF": ["sodf", "obras infraestrutura"],
    "SSPDF": ["sspdf", "segurança pública"],
}

#: Fixed values of the answer made of excerpts: characters of each, how many, and the sentences around them.
EXCERPT, ANSWER_EXCERPTS = 420, 3
ANSWER_HEAD = "Encontrei evidências documentais relacionadas à pergunta.\n\nSíntese baseada nos trechos recuperados:\n"
ANSWER_TAIL = "\n\nComo esta resposta não usou LLM, ela preserva os trechos principais em vez de gerar uma conclusão interpretativa."
ANSWER_NONE = "Não encontrei evidências suficientes na base indexada para responder a pergunta. Tente reformular a consulta, remover filtros ou reindexar os documentos."

# Types that are collected, and the outcomes of the check of a collection.
COLLECTED_TYPES = ["cig", "pg", "compliance"]
CHECK_OK = "✅ OK"
CHECK_EMPTY = "❌ Erro: nenhum link encontrado no repositório"
CHECK_CONFLICT = "❌ Erro: inconsistência"
CHECK_NO_URL = "❌ Erro: URL ausente"
# Terms by which a search hit counts, by type.
HIT_TERMS = {
    "cig": ["comitê interno de governança", "comitê de governança", "atas", "atas das reuniões", "atas de reuniões", "governança pública"],
    "programa": ["integridade e compliance", "integridade", "programa de integridade"],
    "pg": ["programa de integridade", "programa integridade", "integridade e compliance", "integridade", "compliance e integridade"],
    "compliance": ["plano de compliance", "plano compliance", "compliance", "plano de integridade e compliance", "plano integridade compliance"],
}

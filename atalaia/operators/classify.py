"""Compliance labels from retrieved evidence, and indicators by agency."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import fold, rounded
from . import search

CRITERION = "codigo string, pergunta_normativa string, pergunta string, titulo string, tipos_documento_prioritarios array<string>, palavras_chave array<string>, peso_criterio double, eixo_imga string, eixo string"


def _given(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def criteria_rows(criteria: DataFrame, code: str | None = None, most: int | None = None) -> DataFrame:
    """Criteria with question, weight and axis settled; without a question they are left out.

    ``code`` keeps one criterion (an error if there is none), ``most`` the first ones by code.
    """
    if code is not None:
        criteria = criteria.filter(F.col("codigo") == code)
        if criteria.isEmpty():
            raise ValueError(f"no criterion {code}")
    rows = criteria.select(
        "codigo",
        _given("pergunta_normativa", "pergunta", "titulo").alias("pergunta"),
        "titulo",
        F.col("tipos_documento_prioritarios").alias("tipos"),
        F.coalesce("palavras_chave", F.array().cast("array<string>")).alias("palavras_chave"),
        F.coalesce(F.nullif("peso_criterio", F.lit(0.0)), F.lit(1.0)).alias("peso_criterio"),
        F.coalesce(_given("eixo_imga", "eixo"), F.lit("SEM_EIXO")).alias("eixo_imga"),
    ).filter(F.col("pergunta").isNotNull())
    return rows.orderBy("codigo").limit(most) if most else rows


def has_negative(text: Column) -> Column:
    """Whether a text says that something is missing."""
    return reduce(or_, [fold(text).rlike(p) for p in K.NEGATIVE_SIGNALS])


def keyword_hits(keywords: Column, texts: Column) -> Column:
    """The distinct keywords that occur in the texts, sorted; accents and case do not count."""
    joined = fold(F.array_join(texts, " "))
    return F.array_sort(F.array_distinct(F.filter(keywords, lambda k: (fold(k) != "") & F.contains(joined, fold(k)))))


def label(n: Column, top_score: Column, hits: Column, negative: Column, full: float = K.MIN_FULL, partial: float = K.MIN_PARTIAL, min_hits: int = K.MIN_HITS) -> Column:
    """The label, rules in their order: nothing found, negative, full, else partial."""
    return (
        F.when((n == 0) | ((top_score < partial) & (hits == 0)), "nao_encontrado")
        .when(negative, "nao_atende")
        .when((top_score >= full) & (hits >= min_hits), "atende")
        .otherwise("atende_parcialmente")
    )


def by_label(c: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def classify(chunks: DataFrame | search.Index, criteria: DataFrame, agencies: DataFrame | None = None, top_k: int = K.TOP_K, full: float = K.MIN_FULL, partial: float = K.MIN_PARTIAL, min_hits: int = K.MIN_HITS, **options) -> DataFrame:
    """Agency × criterion with label, points and evidence, in one plan instead of a search for each pair."""
    asked = criteria.select(F.col("codigo").alias("query_id"), "pergunta", F.lit(None).cast("string").alias("orgao"), "tipos")
    found = search.hybrid(chunks, asked, top_k, by_agency=True, **options)
    texts = search.evidence(found.select("query_id", "orgao", "chunk_id", "score", "rank"), chunks)
    item = F.struct("rank", "score", "trecho", "documento", "pagina", "chunk_id")
    grouped = texts.groupBy("query_id", "orgao").agg(F.array_sort(F.collect_list(item)).alias("evidencias"))  # top_k of them at most
    agencies = agencies if agencies is not None else (chunks.chunks if isinstance(chunks, search.Index) else chunks).select("orgao").distinct()
    pairs = agencies.crossJoin(search.small(criteria)).join(grouped.withColumnRenamed("query_id", "codigo"), ["codigo", "orgao"], "left")
    pairs = pairs.withColumn("evidencias", F.coalesce("evidencias", F.array().cast(dict(grouped.dtypes)["evidencias"])))
    e = F.col("evidencias")
    rows = pairs.withColumns({
        "palavras_chave_encontradas": keyword_hits(F.col("palavras_chave"), e["trecho"]),
        "score_recuperacao": F.coalesce(F.array_max(e["score"]), F.lit(0.0)),
        "negativo": F.exists(F.slice(e, 1, 2), lambda x: has_negative(x["trecho"])),
        "evidencias_total": F.size(e),
    })
    rows = rows.withColumn("classificacao", label(F.col("evidencias_total"), F.col("score_recuperacao"), F.size("palavras_chave_encontradas"), F.col("negativo"), full, partial, min_hits))
    rows = rows.withColumns({"pontuacao": by_label(F.col("classificacao"), K.LABEL_POINTS), "justificativa": by_label(F.col("classificacao"), K.REASONS)})
    return rows.select("orgao", F.col("codigo").alias("criterio"), "pergunta", "titulo", "eixo_imga", "peso_criterio", "classificacao", "pontuacao", rounded(F.col("pontuacao") * F.col("peso_criterio"), 4).alias("score_ponderado"), "score_recuperacao", "evidencias_total", "palavras_chave_encontradas", "justificativa", "evidencias")


def band(score: Column) -> Column:
    """Band of an agency's index; the limits belong to the higher band."""
    return F.when(score >= 75, "Avancada").when(score >= 50, "Intermediaria").when(score >= 25, "Basica").otherwise("Incipiente")


def axis_scores(rows: DataFrame) -> DataFrame:
    """Points, weight and share by agency and axis."""
    share = F.coalesce(F.try_divide(F.sum("score_ponderado"), F.sum("peso_criterio")) * 100, F.lit(0.0))
    return rows.groupBy("orgao", "eixo_imga").agg(F.sum("peso_criterio").alias("peso"), F.sum("score_ponderado").alias("score"), F.count(F.lit(1)).alias("criterios"), rounded(share, 2).alias("score_eixo"))


def label_distribution(rows: DataFrame) -> DataFrame:
    """(classificacao, criterios): how often each label occurs, most frequent first, ties by name; labels that do not occur are left out."""
    return rows.groupBy("classificacao").agg(F.count(F.lit(1)).alias("criterios")).orderBy(F.desc("criterios"), "classificacao")


def means(found: DataFrame) -> DataFrame:
    """One row: agencies, and the means of their compliance and index, two digits; 0 without agencies."""
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  exact, as the values have two digits
    mean = lambda c: rounded(F.coalesce(F.try_divide(total(c), F.count(c)), F.lit(0.0)), 2)
    return found.agg(F.count(F.lit(1)).alias("orgaos"), mean("conformidade_percentual").alias("conformidade_media"), mean("imga_global").alias("imga_medio"))


def label_histogram(rows: DataFrame, *by: str) -> DataFrame:
    """Number of rows with each of the four labels, zero included."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("classificacao") == k).alias(k) for k in K.LABEL_POINTS])


def indicators(rows: DataFrame, axis_weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each agency: totals, compliance, labels, the axes' scores and the weighted index with its band."""
    weights = axis_weights or K.AXIS_WEIGHTS
    weight = F.coalesce(by_label(F.col("eixo_imga"), weights), F.lit(0.0))
    axes = axis_scores(rows).groupBy("orgao").agg(
        rounded(F.sum(F.col("score_eixo") * weight), 2).alias("imga_global"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("eixo_imga", "score_eixo")))).alias("pontuacao_por_eixo"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("eixo_imga", "criterios")))).alias("criterios_por_eixo"),
    )
    share = F.coalesce(F.try_divide(F.sum("score_ponderado"), F.sum("peso_criterio")) * 100, F.lit(0.0))
    labels = F.create_map(*[x for k in K.LABEL_POINTS for x in (F.lit(k), F.count_if(F.col("classificacao") == k))])
    total = rows.groupBy("orgao").agg(F.count(F.lit(1)).alias("criterios_avaliados"), rounded(F.sum("peso_criterio"), 4).alias("peso_total"), rounded(F.sum("score_ponderado"), 4).alias("score_total"), rounded(share, 2).alias("conformidade_percentual"), labels.alias("classificacoes"))
    return total.join(axes, "orgao").withColumn("faixa", band(F.col("imga_global")))


def ranking(found: DataFrame) -> DataFrame:
    """Agencies by index, highest first, ties by name."""
    return found.withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("imga_global"), "orgao"))).select("orgao", "imga_global", "faixa", "posicao")


def matrix(rows: DataFrame) -> DataFrame:
    """Agency × criterion with the first evidence's document, page and excerpt, "" where there is none."""
    first = F.try_element_at("evidencias", F.lit(1))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select("orgao", "criterio", "eixo_imga", "classificacao", "pontuacao", "score_ponderado", "evidencias_total", text(first["documento"]).alias("documento"), text(first["pagina"]).alias("pagina"), text(first["trecho"]).alias("trecho"))


def selected(rows: DataFrame, **chosen: list[str] | None) -> DataFrame:
    """Rows whose columns have one of the values chosen for them; no values, or a column that is not there, choose all."""
    for c, values in chosen.items():
        if values and c in rows.columns:
            rows = rows.filter(F.col(c).isin(list(values)))
    return rows


def manual_sample(rows: DataFrame, n: int = K.SAMPLE_SIZE) -> DataFrame:
    """The first rows of the matrix, with four blank columns for a human check."""
    blank = {c: F.lit("") for c in ("avaliacao_manual", "classificacao_correta", "observacoes", "avaliador")}
    return matrix(rows).orderBy("orgao", "criterio").limit(n).withColumns(blank)

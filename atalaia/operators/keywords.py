"""Keyword counts and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import collapse, jaccard, n_words, rounded, words


def cleaned(keywords: list[str]) -> list[str]:
    """Lower-cased keywords without blanks and repeats, in order."""
    return list(dict.fromkeys(k.strip().lower() for k in keywords if k.strip()))


def pattern(keywords: list[str]) -> str:
    """One pattern for all keywords: each as the beginning of a word, the first listed preferred."""
    quoted = "|".join(rf"\Q{k}\E" for k in cleaned(keywords))
    return rf"(?iuU)\b(?:{quoted})\w*\b"


def attributed(match: Column, keywords: list[str]) -> Column:
    """The first listed keyword that a match holds."""
    out = None
    for k in cleaned(keywords):
        hit = F.contains(F.lower(match), F.lit(k))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def matches(text: Column, keywords: list[str]) -> Column:
    """Array of (pos, match, keyword) of the matches in a page's first characters, in order."""
    page = F.substring(text, 1, K.PAGE_CHARS)
    found = F.regexp_extract_all(page, F.lit(pattern(keywords)), 0)
    gaps = F.split(page, pattern(keywords), -1)
    # A match begins after all gaps and matches before it.
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(found, i))).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(F.get(gaps, i)) + 1).alias("pos"), F.get(found, i).alias("match"), attributed(F.get(found, i), keywords).alias("keyword")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,match:string,keyword:string>>").alias("out"))
    order = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(order, start, step, lambda acc: acc["out"])


def counts_by_page(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Occurrences by page and keyword, at most 100 for each."""
    found = F.regexp_extract_all(F.substring("texto", 1, K.PAGE_CHARS), F.lit(pattern(keywords)), 0)
    rows = pages.select("document_id", "orgao", "page_no", F.explode(found).alias("m"))
    rows = rows.withColumn("keyword", attributed(F.col("m"), keywords))
    return rows.groupBy("document_id", "orgao", "page_no", "keyword").agg(F.least(F.count(F.lit(1)), F.lit(K.PAGE_MATCHES)).alias("ocorrencias"))


def counts_by_document(by_page: DataFrame) -> DataFrame:
    return by_page.groupBy("document_id", "orgao", "keyword").agg(F.sum("ocorrencias").alias("ocorrencias"))


def counts_global(by_page: DataFrame) -> DataFrame:
    return by_page.groupBy("keyword").agg(F.sum("ocorrencias").alias("ocorrencias"))


def percentages(by_page: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of all words, in percent, by keyword."""
    total = docs.agg(F.sum(n_words(F.col("text"))).alias("palavras"))
    return counts_global(by_page).crossJoin(total).select("keyword", "ocorrencias", rounded(F.coalesce(F.try_divide(F.col("ocorrencias") * 100.0, F.col("palavras")), F.lit(0.0)), 4).alias("percentual"))


def top_by_agency(by_page: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent keywords of each agency, ties by keyword."""
    total = by_page.groupBy("orgao", "keyword").agg(F.sum("ocorrencias").alias("ocorrencias"))
    w = Window.partitionBy("orgao").orderBy(F.desc("ocorrencias"), "keyword")
    return total.withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= n)


def top_global(by_page: DataFrame, n: int = 20) -> DataFrame:
    return counts_global(by_page).orderBy(F.desc("ocorrencias"), "keyword").limit(n)


def agency_statistics(docs: DataFrame, by_page: DataFrame, estimate: bool = True) -> DataFrame:
    """Documents, words and occurrences by agency: shares of the totals by number of documents, or exact sums."""
    own = docs.groupBy("orgao").agg(F.count(F.lit(1)).alias("documentos"), F.sum(n_words(F.col("text"))).alias("exact_words"))
    hits = by_page.groupBy("orgao").agg(F.sum("ocorrencias").alias("exact_hits"))
    if not estimate:
        return own.join(hits, "orgao", "left").select("orgao", "documentos", F.col("exact_words").alias("palavras"), F.coalesce("exact_hits", F.lit(0)).alias("ocorrencias"))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(n_words(F.col("text"))).alias("w")).crossJoin(by_page.agg(F.coalesce(F.sum("ocorrencias"), F.lit(0)).alias("o")))
    share = lambda c: F.floor(F.col(c) * F.col("documentos") / F.col("n")).cast("long")
    return own.crossJoin(total).select("orgao", "documentos", share("w").alias("palavras"), share("o").alias("ocorrencias"), rounded(F.col("documentos") * 100.0 / F.col("n"), 2).alias("percentual"))


def summary(docs: DataFrame, by_page: DataFrame, keywords: list[str]) -> DataFrame:
    """One row: documents, words, keywords, occurrences, mean occurrences a document."""
    total = docs.agg(F.count(F.lit(1)).alias("documentos"), F.sum(n_words(F.col("text"))).alias("palavras"))
    hits = by_page.agg(F.coalesce(F.sum("ocorrencias"), F.lit(0)).alias("ocorrencias"))
    return total.crossJoin(hits).withColumns({"palavras_chave": F.lit(len(cleaned(keywords))), "media_por_documento": rounded(F.coalesce(F.try_divide(F.col("ocorrencias") * 1.0, F.col("documentos")), F.lit(0.0)), 2)})


def ranked(docs: DataFrame, by_page: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, ocorrencias, percentual, posicao) of every keyword, those that do not occur too; ties by keyword. As many rows as keywords."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(k,) for k in cleaned(keywords)], "keyword string")
    total = docs.agg(F.sum(n_words(F.col("text"))).alias("palavras"))
    rows = asked.join(F.broadcast(counts_global(by_page)), "keyword", "left").crossJoin(total).withColumn("ocorrencias", F.coalesce("ocorrencias", F.lit(0)))
    share = rounded(F.coalesce(F.try_divide(F.col("ocorrencias") * 100.0, F.col("palavras")), F.lit(0.0)), 2)
    return rows.select("keyword", "ocorrencias", share.alias("percentual"), F.row_number().over(Window.orderBy(F.desc("ocorrencias"), "keyword")).alias("posicao"))


def report(docs: DataFrame, by_page: DataFrame, keywords: list[str], n: int = 20) -> DataFrame:
    """The summary as one row: totals, counts and shares by keyword, and the n most frequent ones; bounded by the keywords."""
    each = F.array_sort(F.collect_list(F.struct("posicao", "keyword", "ocorrencias", "percentual")))
    of = ranked(docs, by_page, keywords).agg(each.alias("k"))
    pairs = lambda c: F.map_from_entries(F.transform("k", lambda x: F.struct(x["keyword"], x[c])))
    best = F.transform(F.slice("k", 1, n), lambda x: F.struct(x["keyword"].alias("keyword"), x["ocorrencias"].alias("count"), x["percentual"].alias("percentage")))
    total = summary(docs, by_page, keywords).select(F.struct("documentos", "palavras", "palavras_chave", "ocorrencias", "media_por_documento").alias("resumo_geral"))
    return total.crossJoin(of).select("resumo_geral", pairs("ocorrencias").alias("contagem_keywords_geral"), pairs("percentual").alias("porcentagem_keywords_geral"), best.alias("top_keywords_geral"))


def agency_report(docs: DataFrame, by_page: DataFrame, n: int = 10) -> DataFrame:
    """By agency its statistics and an array of its n most frequent keywords, empty where none occurs."""
    kind = "array<struct<posicao:int,keyword:string,ocorrencias:bigint>>"
    best = top_by_agency(by_page, n).groupBy("orgao").agg(F.array_sort(F.collect_list(F.struct("posicao", "keyword", "ocorrencias"))).cast(kind).alias("top_keywords"))
    return agency_statistics(docs, by_page).join(best, "orgao", "left").withColumn("top_keywords", F.coalesce("top_keywords", F.array().cast(kind)))


def snippets(pages: DataFrame, keywords: list[str], around: int = K.SNIPPET_CHARS) -> DataFrame:
    """The text around each match: at most 100 a page and keyword, 500 a document, in order of page and place."""
    hits = F.transform(matches(F.col("texto"), keywords), lambda m: F.struct(m["pos"].alias("pos"), m["match"].alias("match"), m["keyword"].alias("keyword"), collapse(F.substring("texto", F.greatest(m["pos"] - around, F.lit(1)), m["pos"] + F.length(m["match"]) + around - F.greatest(m["pos"] - around, F.lit(1)))).alias("snippet")))
    rows = pages.select("document_id", "orgao", "page_no", F.explode(hits).alias("h")).select("document_id", "orgao", "page_no", "h.*")
    per_page = F.row_number().over(Window.partitionBy("document_id", "page_no", "keyword").orderBy("pos"))
    per_doc = F.row_number().over(Window.partitionBy("document_id").orderBy("page_no", "pos"))
    return rows.withColumn("n", per_page).filter(F.col("n") <= K.PAGE_MATCHES).withColumn("ordem", per_doc).filter(F.col("ordem") <= K.DOC_SNIPPETS).drop("n")


def distinct_snippets(found: DataFrame) -> DataFrame:
    """Of snippets equal within a document the first."""
    w = Window.partitionBy("document_id", F.md5(F.col("snippet").cast("binary"))).orderBy("ordem")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def unlike_snippets(found: DataFrame, least: float = K.SNIPPET_JACCARD, look_back: int = K.SNIPPET_LOOK_BACK) -> DataFrame:
    """Snippets in order, without exact repeats of kept ones and without those like one of the last kept.

    A document's snippets are at most 500, so one row holds them while they are folded.
    """
    kind = "array<struct<ordem:int,snippet:string,w:array<string>>>"
    item = F.struct("ordem", "snippet", F.array_distinct(words(F.lower("snippet"))).alias("w"))

    def step(acc: Column, x: Column) -> Column:
        recent = F.slice(acc, F.greatest(F.size(acc) - look_back + 1, F.lit(1)), F.lit(look_back))
        known = F.exists(acc, lambda k: k["snippet"] == x["snippet"]) | F.exists(recent, lambda k: jaccard(k["w"], x["w"]) >= least)
        return F.when(known, acc).otherwise(F.concat(acc, F.array(x)))

    gathered = found.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kept = gathered.select("document_id", F.explode(F.aggregate("s", F.array().cast(kind), step)).alias("k"))
    return kept.select("document_id", "k.ordem", "k.snippet")

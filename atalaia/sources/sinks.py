"""Writers: index tables, manifest, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import printable
from ..operators import chunking, classify, coverage, keywords, search
from .store import last_of


def write_index(docs: DataFrame, folder: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, dimensions: int = K.DIMENSIONS, order: str | None = None) -> dict[str, str]:
    """Write documents (of a repeated id the last by ``order``), chunks, postings, statistics, vectors and the manifest; a full refresh. Returns the folders.

    Chunks are written first and read back, so that the tables built on them do not cut the texts again. Search reads them through
    ``search.Index.read``.
    """
    spark = docs.sparkSession
    at = _folders(folder, "documents", "chunks", "postings", "term_stats", "corpus_stats", "vectors", "manifest")
    _put(last_of(docs, "document_id", order), at["documents"])
    docs = spark.read.parquet(at["documents"])
    parts = _write_lexical(docs, at, size, overlap)
    _put(search.block_counts(spark.read.parquet(at["postings"])).select("term", "df"), at["term_stats"])
    _put(search.vectors(parts, dimensions).withColumn("dimensions", F.lit(dimensions)), at["vectors"])
    total = coverage.index_counts(docs, parts).withColumn("gerado_em", F.current_timestamp())
    types = coverage.manifest(docs).agg(F.collect_list(F.struct("*")).alias("por_tipo"))
    total.crossJoin(types).write.mode("overwrite").json(at["manifest"])
    return at


def write_search_index(docs: DataFrame, folder: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, order: str | None = None) -> dict[str, str]:
    """Write what searches alone need: chunks, postings and statistics of the documents that write_index takes. Returns the folders.

    Documents are not copied, and vectors, which follow from the chunks, are made by the searches that need them (``search.Index.lean``).
    """
    at = _folders(folder, "chunks", "postings", "corpus_stats")
    _write_lexical(last_of(docs, "document_id", order), at, size, overlap)
    return at


def _folders(folder: str, *names: str) -> dict[str, str]:
    return {k: f"{folder.rstrip('/')}/{k}" for k in names}


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def _write_lexical(docs: DataFrame, at: dict[str, str], size: int, overlap: int) -> DataFrame:
    """Write chunks, postings and statistics; the chunks as they are stored."""
    _put(search.numbered(chunking.chunks(docs, size, overlap)), at["chunks"], "tipo_documento")
    parts = docs.sparkSession.read.parquet(at["chunks"])
    search.write_postings(search.posting_blocks(parts), at["postings"])
    _put(parts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), at["corpus_stats"])
    return parts


def write_report(rows: DataFrame, folder: str, sample: int = K.SAMPLE_SIZE, axis_weights: dict[str, float] | None = None) -> dict[str, str]:
    """Write classifications, indicators (with the axes' weights given, else the usual ones), the matrix and the sample for a human check."""
    at = {k: f"{folder.rstrip('/')}/{k}" for k in ("classificacoes", "indicadores_orgaos", "criterios_orgaos", "amostra_manual", "relatorio")}
    rows.write.mode("overwrite").json(at["classificacoes"])
    found = classify.indicators(rows, axis_weights)
    flat = found.select(*[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in found.dtypes])
    flat.write.mode("overwrite").option("header", "true").csv(at["indicadores_orgaos"])
    classify.matrix(rows).write.mode("overwrite").option("header", "true").csv(at["criterios_orgaos"])
    classify.manual_sample(rows, sample).coalesce(1).write.mode("overwrite").option("header", "true").csv(at["amostra_manual"])
    report = rows.agg(F.count(F.lit(1)).alias("classificacoes_total"), F.countDistinct("orgao").alias("orgaos"), F.countDistinct("criterio").alias("criterios"))
    report.withColumn("arquivos", F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(v))])).write.mode("overwrite").json(at["relatorio"])
    return at


def write_summary(docs: DataFrame, by_page: DataFrame, words: list[str], folder: str) -> dict[str, str]:
    """Write the summary of a keyword analysis: one JSON document, and the agencies' statistics a row each. Returns the folders."""
    at = {k: f"{folder.rstrip('/')}/{k}" for k in ("summary_results", "estatisticas_por_orgao")}
    keywords.report(docs, by_page, words).withColumn("data_analise", F.current_timestamp()).write.mode("overwrite").json(at["summary_results"])
    keywords.agency_report(docs, by_page).write.mode("overwrite").json(at["estatisticas_por_orgao"])
    return at


def write_snippets(found: DataFrame, folder: str) -> None:
    """Append snippets by agency and keyword."""
    found.withColumn("snippet", printable(F.col("snippet"))).write.mode("append").partitionBy("orgao", "keyword").json(folder)


def write_new(rows: DataFrame, folder: str, key: str) -> None:
    """Append the rows whose key is not in the folder yet."""
    spark: SparkSession = rows.sparkSession
    try:
        known = spark.read.parquet(folder).select(key)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = rows.limit(0).select(key)
    rows.join(known, key, "left_anti").write.mode("append").parquet(folder)

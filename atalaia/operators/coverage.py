"""What the collection holds and lacks, and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded


def index_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, agencies, types."""
    d = docs.agg(F.count(F.lit(1)).alias("documentos"), F.countDistinct("orgao").alias("orgaos"), F.countDistinct("tipo_documento").alias("tipos"))
    return d.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def manifest(docs: DataFrame) -> DataFrame:
    """By type: documents and the sorted agencies."""
    return docs.groupBy("tipo_documento").agg(F.count(F.lit(1)).alias("documentos"), F.array_sort(F.collect_set("orgao")).alias("orgaos"))


def missing_types(docs: DataFrame, required: list[str], severe: tuple[str, str]) -> DataFrame:
    """By agency the required types it lacks, and the risk: high if both of ``severe`` are missing."""
    has = [F.bool_or(F.col("tipo_documento") == t).alias(f"tem_{t}") for t in required]
    rows = docs.groupBy("orgao").agg(*has)
    lacking = F.array_compact(F.array(*[F.when(~F.col(f"tem_{t}"), F.lit(t)) for t in required]))
    rows = rows.withColumn("ausentes", lacking).filter(F.size("ausentes") > 0)
    high = ~F.col(f"tem_{severe[0]}") & ~F.col(f"tem_{severe[1]}")
    return rows.select("orgao", "ausentes", F.when(high, "Risco Alto").otherwise("Risco Moderado").alias("risco"))


def pending(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def success_rates(runs: DataFrame, by: str, ok: str) -> DataFrame:
    """By key: successes, failures, total and the rate in percent."""
    rows = runs.groupBy(by).agg(F.count_if(F.col(ok)).alias("sucesso"), F.count_if(~F.col(ok)).alias("falha"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("taxa_sucesso", rounded(F.coalesce(F.try_divide(F.col("sucesso") * 100.0, F.col("total")), F.lit(0.0)), 2))


def recent_mean(runs: DataFrame, by: str, order: str, value: str, n: int = 10) -> DataFrame:
    """Mean of the last ``n`` values up to each row of a key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    return runs.select(by, order, rounded(F.avg(value).over(w), 4).alias("media"))

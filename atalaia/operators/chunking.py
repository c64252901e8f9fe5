"""Pages, chunks and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import TEXTS, collapse, n_words, sentences

_NONE = lambda: F.array().cast(TEXTS)
_FULL = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def hard_split(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, ``overlap`` of them shared; trimmed, empty ones dropped."""
    step = max(1, size - overlap)
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?s).{{1,{step}}}"), 0)  # one pass: a substring counts characters from the first
    ahead = range(1, -(-size // step))
    window = lambda p: F.transform(p, lambda x, i: F.substring(F.concat(x, *[F.coalesce(F.get(p, i + k), F.lit("")) for k in ahead]), 1, size))
    return _FULL(F.transform(F.array(pieces), window)[0])


def chunk(c: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Sentences packed into chunks of up to ``size`` characters, each beginning with the tail of the one before.

    A sentence that does not fit closes the chunk and starts the next behind the tail, even if that gets
    too long; one that does not fit into an empty chunk is split hard.
    """
    text = collapse(c)

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["c"] == "", x).otherwise(F.concat(acc["c"], F.lit(" "), x))
        tail = F.trim(F.substring(acc["c"], F.greatest(F.length(acc["c"]) - overlap + 1, F.lit(1)), F.lit(overlap))) if overlap else F.lit("")
        return (
            F.when(F.length(joined) <= size, F.struct(acc["o"].alias("o"), joined.alias("c")))
            .when(acc["c"] != "", F.struct(F.concat(acc["o"], F.array(acc["c"])).alias("o"), F.trim(F.concat(tail, F.lit(" "), x)).alias("c")))
            .otherwise(F.struct(F.concat(acc["o"], hard_split(x, size, overlap)).alias("o"), F.lit("").alias("c")))
        )

    start = F.struct(_NONE().alias("o"), F.lit("").alias("c"))
    packed = F.aggregate(sentences(text), start, step, lambda acc: F.when(acc["c"] == "", acc["o"]).otherwise(F.concat(acc["o"], F.array(acc["c"]))))
    return F.when(text == "", _NONE()).when(F.length(text) <= size, F.array(text)).otherwise(_FULL(packed))


def pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each non-blank line of a document: page_no counts non-blank pages, page_pos all."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda t, i: F.struct((i + 1).alias("page_pos"), t.alias("texto")))
    kept = F.filter(split, lambda p: collapse(p["texto"]) != "")
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(kept).alias("i", "p")).select(*rest, (F.col("i") + 1).alias("page_no"), F.col("p.page_pos").alias("page_pos"), F.col("p.texto").alias("texto"))


def document_rows(docs: DataFrame) -> DataFrame:
    """The engine's documents from (doc_id, text, lang, source): source is the agency, lang the type."""
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.upper(F.trim("source")).alias("orgao"), F.lower(F.trim("lang")).alias("tipo_documento"), "text")


def document_id(path: Column, content_sha256: Column) -> Column:
    return F.sha1(F.concat_ws(":", path, content_sha256).cast("binary"))


def chunks(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of documents with (document_id, orgao, tipo_documento, text), numbered through a document's pages.

    All pages of a document are cut in its own row, so numbering needs no shuffle.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: collapse(t) != "")
    per_page = F.flatten(F.transform(lines, lambda t, i: F.transform(chunk(t, size, overlap), lambda x: F.struct((i + 1).alias("pagina"), x.alias("texto")))))
    rows = docs.select("document_id", "orgao", "tipo_documento", F.posexplode(per_page).alias("i", "c"))
    rows = rows.select("document_id", "orgao", "tipo_documento", F.col("c.pagina").alias("pagina_inicial"), F.col("c.pagina").alias("pagina_final"), (F.col("i") + 1).alias("ordem"), F.col("c.texto").alias("texto"))
    rows = rows.withColumn("hash_texto", F.sha1(F.col("texto").cast("binary")))
    return rows.select(_identity(F.col("hash_texto")).alias("chunk_id"), "*", F.lower("texto").alias("texto_busca"), n_words(F.col("texto")).alias("palavras"), F.length("texto").cast("long").alias("caracteres"))


def _identity(text_hash: Column) -> Column:
    return F.sha1(F.concat_ws(":", "document_id", F.col("pagina_inicial").cast("string"), F.col("ordem").cast("string"), text_hash).cast("binary"))


def packed(rows: DataFrame) -> DataFrame:
    """Chunks without what follows from their texts and places; ids and hashes are more than a third of them, as they can't be compressed."""
    return rows.drop("chunk_id", "hash_texto", "texto_busca", "palavras", "caracteres")


def unpacked(rows: DataFrame) -> DataFrame:
    """The chunks of packed ones."""
    text_hash = F.sha1(F.col("texto").cast("binary"))
    return rows.select(_identity(text_hash).alias("chunk_id"), "*", text_hash.alias("hash_texto"), F.lower("texto").alias("texto_busca"), n_words(F.col("texto")).alias("palavras"), F.length("texto").cast("long").alias("caracteres"))


def document_totals(docs: DataFrame) -> DataFrame:
    """Non-blank pages, words and characters of each document (characters of its non-blank pages, collapsed)."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), collapse), lambda t: t != "")
    total = lambda f: F.aggregate(F.transform("l", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("document_id", lines.alias("l")).select("document_id", F.size("l").cast("long").alias("paginas"), total(n_words).alias("palavras_total"), total(lambda t: F.length(t).cast("long")).alias("caracteres_total"))


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``ordem``, from 1 within ``by``."""
    return rows.withColumn("ordem", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

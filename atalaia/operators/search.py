"""Lexical, semantic and hybrid search over chunks, for any number of questions in one plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.murmur import murmur_bucket
from ..functions.text import index_tokens, query_tokens, rounded, word_tokens
from . import blocks, chunking, scan

#: Questions that may be sent to all tasks; more are joined by a shuffle.
MOST_QUESTIONS = 20_000
#: Distinct terms that a scan of postings is filtered by.
MOST_TERMS = 1000
#: Rows of a search's result that may be sent to all tasks to be joined with chunks.
MOST_FOUND = 200_000
#: Sparse unit vectors (entries of bucket and weight, by bucket) of a text column with so many dimensions.
Embedder = Callable[[Column, int], Column]
QUESTION = "query_id string, pergunta string, orgao string, tipos array<string>"


def questions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(query_id, question, agency or None, types or None) as a DataFrame."""
    if any(not (r[1] or "").strip() for r in rows):
        raise ValueError("a question is empty")
    return spark.createDataFrame(rows, QUESTION)


def small(df: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """With a broadcast hint if ``df`` has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def allowed(chunk_type: str, chunk_agency: str) -> Column:
    """Whether a chunk passes a question's filters; no types and no agency pass all."""
    types = F.col("tipos").isNull() | (F.size("tipos") == 0) | F.array_contains("tipos", F.col(chunk_type))
    return types & (F.col("q_orgao").isNull() | (F.col(chunk_agency) == F.col("q_orgao")))


def query_terms(asked: DataFrame) -> DataFrame:
    """(query_id, q_orgao, tipos, phrase, times): the first 16 tokens of each question as phrases of index tokens."""
    tokens = asked.select("query_id", F.col("orgao").alias("q_orgao"), "tipos", F.explode(F.slice(query_tokens(F.col("pergunta")), 1, K.FTS_TOKENS)).alias("t"))
    return tokens.select("query_id", "q_orgao", "tipos", index_tokens(F.col("t")).alias("phrase")).filter(F.size("phrase") > 0).groupBy("query_id", "q_orgao", "tipos", "phrase").agg(F.count(F.lit(1)).alias("times"))


def postings(chunks: DataFrame, *carried: str) -> DataFrame:
    """(term, chunk_id, orgao, tipo_documento, dl, tf, places): the inverted index; dl are the chunk's tokens, places those of the term from 0.

    A chunk's tokens are sorted in its own row, where each run of equal ones is a posting: nothing is shuffled. ``carried`` columns are kept.
    """
    keys = ["chunk_id", "orgao", "tipo_documento", *carried]

    def runs(s: Column) -> Column:
        """Postings of the sorted tokens: one step for each token, and one for each run."""
        new = lambda i: (i == 1) | (F.get(s, i - 1)["t"] != F.get(s, i - 2)["t"])
        first = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), new)).otherwise(F.array().cast("array<int>"))

        def posting(f: Column, at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(f, k + 1), F.size(s) + 1) - at
            return F.struct(F.get(s, at - 1)["t"].alias("term"), F.size(s).alias("dl"), n.cast("long").alias("tf"), F.transform(F.slice(s, at, n), lambda x: x["i"]).alias("places"))

        return _bound(first, lambda f: F.transform(f, lambda at, k: posting(f, at, k)))

    placed = F.array_sort(F.transform(index_tokens(F.col("texto")), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    return chunks.select(*keys, F.explode(_bound(placed, runs)).alias("p")).select("p.term", *keys, "p.dl", "p.tf", "p.places")


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: with a number of their own and their tokens counted, and without what is made anew from the text."""
    return chunks.drop("texto_busca", "hash_texto").withColumns({"numero": F.monotonically_increasing_id(), "dl": F.size(index_tokens(F.col("texto")))})


def shown(stored: DataFrame) -> DataFrame:
    """Stored chunks with the columns of ``chunking.chunks``."""
    return stored.drop("numero", "dl").withColumns({"texto_busca": F.lower("texto"), "hash_texto": F.sha1(F.col("texto").cast("binary"))})


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """(term, numeros, ends, places): the postings of stored chunks (numero, texto), a row for each term of a batch of chunks.

    ``places`` has the term's places chunk after chunk, ``ends`` where those of each chunk end, less what it would be if each chunk had one. Chunks
    go by their numbers, as their ids would be most of an index; all but the first of a row as the difference from it. So what is stored
    are small numbers, most of ``ends`` the same. Nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(b.column(1)).dictionary_encode()
            if not len(flat):
                continue
            order = np.argsort(flat.indices.to_numpy(), kind="stable")  # of one term by chunk and place
            term, chunk = flat.indices.to_numpy()[order], np.repeat(np.arange(len(length)), length)[order]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length))[order]
            new = np.r_[True, term[1:] != term[:-1]]
            first = np.flatnonzero(new | np.r_[True, chunk[1:] != chunk[:-1]])  # where postings begin
            row = np.flatnonzero(new[first])  # and which of them begin a term
            start = first[row]
            end = np.r_[first[1:], len(flat)] - np.repeat(start, np.diff(np.r_[row, len(first)])) - 1
            lists = lambda at, n, values: pa.ListArray.from_arrays(pa.array(np.r_[at, n].astype(np.int32)), pa.array(values))
            numbers, head = b.column(0).to_numpy()[chunk[first]], np.diff(np.r_[row, len(first)])
            k = np.arange(len(first)) - np.repeat(row, head)  # from the first of its term
            numbers = np.where(k > 0, numbers - np.repeat(numbers[row], head), numbers)
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(term[start])), lists(row, len(first), numbers), lists(row, len(first), (end - k).astype(np.int32)), lists(start, len(flat), place.astype(np.int32))], ["term", "numeros", "ends", "places"])

    return chunks.select("numero", index_tokens(F.col("texto")).alias("t")).mapInArrow(work, "term string, numeros array<long>, ends array<int>, places array<int>")


def numbered_postings(blocks: DataFrame, *by: str) -> DataFrame:
    """(term, by, numero, tf, places) of blocks, a row for each posting. A filter of terms reaches the scan of blocks."""
    each = blocks.select("term", *by, "numeros", "ends", "places", F.posexplode("numeros").alias("k", "numero"))
    number = F.when(F.col("k") > 0, F.get("numeros", F.lit(0)) + F.col("numero")).otherwise(F.col("numero"))
    start = F.coalesce(F.get("ends", F.col("k") - 1) + F.col("k"), F.lit(0))
    tf = F.get("ends", F.col("k")) + F.col("k") + 1 - start
    return each.select("term", *by, number.alias("numero"), tf.cast("long").alias("tf"), F.slice("places", start + 1, tf).alias("places"))


def stored_postings(blocks: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """The rows of postings() from blocks and the stored chunks that they number; numbers hold within ``by``. A filter of terms reaches the scan of blocks."""
    return _with_chunks(numbered_postings(blocks, *by), chunks, *by).select("term", "chunk_id", "orgao", "tipo_documento", "dl", "tf", "places")


def _with_chunks(postings: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """Postings by number with what search needs of their chunks; their ids as bytes, half as long."""
    own = chunks.select(*by, "numero", F.unhex("chunk_id").alias("id"), "orgao", "tipo_documento", "dl")
    return postings.join(own, [*by, "numero"]).withColumn("chunk_id", F.lower(F.hex("id")))


def write_postings(blocks: DataFrame, path: str) -> None:
    """Blocks of postings, each task's sorted by term, so that a scan for terms passes over most pages of each file."""
    blocks.sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(path)


def block_counts(blocks: DataFrame) -> DataFrame:
    """(term, df, cf) of blocks: chunks that hold a term, and its occurrences."""
    return blocks.groupBy("term").agg(F.sum(F.size("numeros")).alias("df"), F.sum(F.size("places")).alias("cf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(index_tokens(F.col("texto")))).alias("avgdl"))


def vectors(chunks: DataFrame, dimensions: int = K.DIMENSIONS, *carried: str, embed: Embedder | None = None) -> DataFrame:
    """(chunk_id, orgao, tipo_documento, vector): the vectors of chunks, hashed ones unless there is another embedder."""
    return chunks.select("chunk_id", "orgao", "tipo_documento", *carried, (embed or embedding)(F.col("texto"), dimensions).alias("vector"))


@dataclass
class Index:
    """What search reads: postings and statistics for the lexical side, vectors for the semantic one, chunks for excerpts alone."""

    chunks: DataFrame
    postings: DataFrame
    corpus_stats: DataFrame
    vectors: DataFrame
    dimensions: int = K.DIMENSIONS
    #: What makes vectors of questions: that which has made those of the chunks.
    embed: Embedder | None = None
    #: Postings by number of chunk, and the stored chunks, each of which is live: what is counted needs no chunk, what is summed by number no exchange.
    numbered: DataFrame | None = None
    stored: DataFrame | None = None
    #: Chunks whose texts the lexical side reads, where no postings are stored.
    texts: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame | Index, dimensions: int | None = K.DIMENSIONS) -> Index:
        """The index of chunks, made anew by every plan that uses it; an index is returned as it is."""
        if isinstance(chunks, Index):
            if dimensions and dimensions != chunks.dimensions:
                raise ValueError(f"the index has vectors of {chunks.dimensions} dimensions")
            return chunks
        n = K.DIMENSIONS if dimensions is None else dimensions
        return cls(chunks, postings(chunks), corpus_stats(chunks), vectors(chunks, n), n)

    @classmethod
    def once(cls, chunks: DataFrame, folder: str, dimensions: int = K.DIMENSIONS) -> Index:
        """The index of chunks that are cut once, to a folder of their own; what search needs of them is made from there by the plans that use them."""
        chunking.packed(chunks).write.option("compression", "zstd").parquet(folder)
        return cls.kept(chunks.sparkSession, folder, dimensions)

    @classmethod
    def kept(cls, spark: SparkSession, folder: str, dimensions: int = K.DIMENSIONS) -> Index:
        """The index of a folder of ``once``."""
        chunks = chunking.unpacked(spark.read.parquet(folder))
        return cls(chunks, postings(chunks), corpus_stats(chunks), vectors(chunks, dimensions), dimensions, texts=chunks)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        """The index that ``sinks.write_index`` has written to a folder."""
        at = lambda k: spark.read.parquet(f"{folder.rstrip('/')}/{k}")
        size = at("vectors").select("dimensions").first()
        return cls._stored(at, at("vectors"), size["dimensions"] if size else K.DIMENSIONS)

    @classmethod
    def lean(cls, spark: SparkSession, folder: str, dimensions: int = K.DIMENSIONS) -> Index:
        """The index of a folder without vectors (``sinks.write_search_index``): hashed ones are made from the chunks by the plans that use them."""
        at = lambda k: spark.read.parquet(f"{folder.rstrip('/')}/{k}")
        return cls._stored(at, vectors(at("chunks"), dimensions), dimensions)

    @classmethod
    def _stored(cls, at: Callable[[str], DataFrame], vectors: DataFrame | None, dimensions: int = K.DIMENSIONS) -> Index:
        chunks, blocks = at("chunks"), at("postings")
        return cls(shown(chunks), stored_postings(blocks, chunks), at("corpus_stats"), vectors, dimensions, None, numbered_postings(blocks), chunks)


def phrase_hits(index: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("chunk_id", "orgao", "tipo_documento", "dl"), own: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(keys, phrase, tf) of postings, where a chunk holds a phrase of the questions.

    Postings are sorted by term: with few terms asked for, the scan passes over all others. A phrase of several terms is met where
    their places follow one another; without such phrases no places are read. ``own`` gives the postings that are left columns of ``keys`` that they lack.
    """
    asked = terms.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("k", "term"))
    known = asked.select("term", (F.size("phrase") > 1).alias("several")).distinct().limit(2 * MOST_TERMS + 1).collect()
    few = len(known) <= 2 * MOST_TERMS

    def met(several: bool) -> DataFrame:
        part = asked.filter((F.size("phrase") > 1) == several)
        if not few:
            return own(index).join(part, "term")
        return own(index.filter(F.col("term").isin([r["term"] for r in known if r["several"] == several]))).join(F.broadcast(part), "term")

    columns = [*keys, "phrase"]
    single = met(False).select(*columns, F.col("tf").cast("long").alias("tf"))
    if few and not any(r["several"] for r in known):
        return single
    starts = F.transform("places", lambda p: p - F.col("k"))
    parts = met(True).groupBy(*columns).agg(F.collect_list(F.struct("k", starts.alias("s"))).alias("all"))  # of a question's terms
    both = F.aggregate(F.slice("all", 2, 1000), F.col("all")[0]["s"], lambda a, x: F.array_intersect(a, x["s"]))
    several = parts.filter(F.size("all") == F.size("phrase")).select(*columns, F.size(both).cast("long").alias("tf")).filter("tf > 0")
    return single.unionByName(several)


def top(scored: DataFrame, limit: int, *order: Column, keys: tuple[str, ...] = ("query_id",), name: str = "posicao") -> DataFrame:
    """The first ``limit`` rows of each key, numbered."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= limit)


def bm25(index: DataFrame | Index, asked: DataFrame, limit: int = K.LEXICAL_LIMIT, by_agency: bool = False) -> DataFrame:
    """(query_id, chunk_id, orgao, score, posicao): best chunks of an index, or of chunks, by BM25, six digits, ties by chunk_id.

    Statistics are those of all chunks; filters hold for hits alone. ``by_agency`` ranks within each agency. Without stored postings the
    texts of chunks are read (``scan``) for as many terms as may be sent to all tasks.
    """
    index, terms = Index.of(index, None), query_terms(asked)
    by = ("query_id", "orgao") if by_agency else ("query_id",)
    if index.texts is not None:
        held = terms.limit(MOST_QUESTIONS + 1).toArrow()
        if held.num_rows <= MOST_QUESTIONS:
            return top(scan.search(index.texts, held, limit, by_agency), limit, F.desc("score"), F.col("chunk_id"), keys=by)
    key: tuple[str, ...] = ()
    if index.numbered is None:
        hits = counted = phrase_hits(index.postings, terms)
    else:
        key = ("numero",)  # by which hits lie after their join with chunks
        hits = phrase_hits(index.numbered, terms, ("numero", "chunk_id", "orgao", "tipo_documento", "dl"), lambda x: _with_chunks(x, index.stored))
        counted = phrase_hits(index.numbered, terms, key)
    df = counted.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "phrase").crossJoin(index.corpus_stats)
    weighted = weighted.withColumn("idf", F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(K.BM25_FLOOR)))
    few = terms.limit(MOST_QUESTIONS + 1).count() <= MOST_QUESTIONS  # as many rows as ``weighted``, without reading chunks
    joined = hits.join(F.broadcast(weighted) if few else weighted, "phrase").filter(allowed("tipo_documento", "orgao"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * ((1 - K.BM25_B) + K.BM25_B * F.col("dl") / F.col("avgdl")))
    scored = joined.groupBy("query_id", *key, "chunk_id", "orgao").agg(rounded(F.sum(part), 6).alias("score")).drop(*key)
    return top(scored, limit, F.desc("score"), F.col("chunk_id"), keys=by)


def like_fallback(chunks: DataFrame, question: str, limit: int = K.LEXICAL_LIMIT) -> DataFrame:
    """Chunks that hold any of a question's first eight tokens as a substring, by chunk_id, score 0."""
    spark = chunks.sparkSession
    tokens = spark.range(1).select(F.slice(query_tokens(F.lit(question)), 1, K.LIKE_TOKENS).alias("t")).first()["t"]
    if not tokens:
        return chunks.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    hit = reduce(or_, [F.contains(F.col("texto_busca"), F.lit(t)) for t in tokens])
    return chunks.filter(hit).orderBy("chunk_id").limit(limit).select("chunk_id", F.lit(0.0).alias("score"))


def bucket(token: Column, dimensions: int) -> Column:
    """Position of a token in the hashed vector."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def _hashed(dimensions: int) -> Callable[[Column], Column]:
    """embedding() of arrays of tokens, a batch at once: each distinct token of a batch is hashed once."""

    @F.arrow_udf("array<struct<bucket:int,weight:double>>")
    def entries(tokens: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(tokens).dictionary_encode()
        hashed = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimensions for t in flat.dictionary.to_pylist()], np.int64)
        key, count = np.unique(np.repeat(np.arange(len(length)), length) * dimensions + hashed[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64), return_counts=True)
        row = key // dimensions
        norm = np.sqrt(np.bincount(row, count * count, len(length)))
        offsets = np.searchsorted(row, np.arange(len(length) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array((key % dimensions).astype(np.int32)), pa.array(count / norm[row])], ["bucket", "weight"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return entries


def embedding(text: Column, dimensions: int = K.DIMENSIONS, place: Callable[[Column, int], Column] = bucket) -> Column:
    """The hashed bag of words as sparse entries (bucket, weight) of unit length; none for a text without words. ``place`` tells a token's bucket; that of ``bucket`` is counted in batches."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    if place is bucket:
        return _hashed(dimensions)(word_tokens(text))
    last = lambda x, i: (i == F.size(x)) | (F.get(x, i) != F.get(x, i - 1))  # noqa: E731  of a run of equal buckets, at place i from 1

    def entries(buckets: Column) -> Column:
        """Runs of the sorted buckets: one step for each token."""
        ends = F.when(F.size(buckets) > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.size(buckets), F.lit(1))), lambda i: last(buckets, i))).otherwise(F.array().cast("array<int>"))
        run = lambda e: F.transform(e, lambda i, k: F.struct(F.get(buckets, i - 1).alias("bucket"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double").alias("c")))
        return _bound(ends, run)

    def unit(counts: Column) -> Column:
        return _bound(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["c"] * x["c"])), lambda norm: F.transform(counts, lambda x: F.struct(x["bucket"].alias("bucket"), (x["c"] / norm).alias("weight"))))

    return _bound(_bound(F.array_sort(F.transform(word_tokens(text), lambda t: place(t, dimensions))), entries), unit)


def murmur_embedding(text: Column, dimensions: int = K.DIMENSIONS) -> Column:
    """embedding() with the buckets of MurmurHash3, to agree with vectors that were made so elsewhere."""
    return embedding(text, dimensions, murmur_bucket)


def batch_embedder(name: str, function: Callable[[pd.Series], np.ndarray]) -> Embedder:
    """An embedder of a function from a batch of texts (null ones as empty) to an array of a row a text, which is sent to the tasks with what it holds.

    Rows are brought to unit length, zeros left out; a row of zeros gives no entries. A row of another size than the index has is an error.
    """

    def embed(text: Column, dimensions: int) -> Column:
        @F.pandas_udf("array<struct<bucket:int,weight:double>>")
        def entries(texts: pd.Series) -> pd.Series:
            rows = np.asarray(function(texts.fillna("")), float).reshape(len(texts), -1) if len(texts) else np.zeros((0, dimensions))
            if rows.shape[1] != dimensions:
                raise ValueError(f"embedder {name} gives {rows.shape[1]} dimensions, not {dimensions}")
            norm = np.sqrt((rows * rows).sum(1, keepdims=True))
            rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
            return pd.Series([[{"bucket": int(i), "weight": float(r[i])} for i in np.flatnonzero(r)] for r in rows])

        return entries(text)

    embed.name = name
    return embed


def semantic(index: DataFrame | Index, asked: DataFrame, limit: int = K.SEMANTIC_LIMIT, dimensions: int | None = None, by_agency: bool = False) -> DataFrame:
    """(query_id, chunk_id, orgao, score, posicao): best chunks of an index, or of chunks, by cosine of hashed vectors, six digits, ties by chunk_id.

    Questions go to every task as a matrix and are multiplied in blocks (``blocks``), so that nothing is shuffled but the best of each
    task; those beyond the size that is sent to tasks are joined by bucket.
    """
    index = Index.of(index, dimensions or (None if isinstance(index, Index) else K.DIMENSIONS))
    q = asked.select("query_id", F.col("orgao").alias("q_orgao"), "tipos", (index.embed or embedding)(F.col("pergunta"), index.dimensions).alias("qv"))
    c = index.vectors.select("chunk_id", "orgao", "tipo_documento", "vector")
    by = ("query_id", "orgao") if by_agency else ("query_id",)
    most = blocks.MOST_CELLS // index.dimensions
    if q.limit(most + 1).count() <= most:
        held = q.toArrow()
        kinds = held.column("tipos").to_pylist()
        if kinds and all(kinds):  # chunks of other types pass no question: their vectors are not made
            c = c.filter(F.col("tipo_documento").isin(sorted({t for ts in kinds for t in ts if t is not None})))
        return top(blocks.search(c, held, index.dimensions, limit, by_agency), limit, F.desc("score"), F.col("chunk_id"), keys=by)
    q = q.select("query_id", "q_orgao", "tipos", F.explode("qv").alias("e")).select("query_id", "q_orgao", "tipos", "e.bucket", F.col("e.weight").alias("qw"))
    c = c.select("chunk_id", "orgao", "tipo_documento", F.explode("vector").alias("e")).select("chunk_id", "orgao", "tipo_documento", "e.bucket", "e.weight")
    joined = c.join(small(q), "bucket").filter(allowed("tipo_documento", "orgao"))
    scored = joined.groupBy("query_id", "chunk_id", "orgao").agg(rounded(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    return top(scored, limit, F.desc("score"), F.col("chunk_id"), keys=by)


def sent_questions(asked: DataFrame) -> blocks.Asked | None:
    """Dense questions (query_id, query) for every task; None if they are more than a matrix of the checked size or have several lengths."""
    if dict(asked.dtypes)["query_id"] not in ("string", "int", "bigint"):
        return None
    first = asked.filter("query is not null").select(F.size("query").alias("n")).first()
    most = blocks.MOST_CELLS // max(first["n"] if first else 1, 1)
    if asked.limit(most + 1).count() > most:
        return None
    rows = blocks.Asked(asked.select("query_id", "query").toArrow())
    return rows if rows.even else None


def dense_cosine(vectors: DataFrame, asked: DataFrame, limit: int, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, posicao): exact cosine of each asked vector (query_id, query) with all vectors.

    Questions of one length go to every task as a matrix and are multiplied in blocks; those beyond its size, and of several lengths, are joined.
    """
    held = sent_questions(asked)
    if held:
        found = blocks.nearest(vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("vector")), held, limit)
        return top(found.withColumnRenamed("id", vector_id), limit, F.desc("score"), F.col(vector_id))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    own, other = vectors.select(vector_id, vector, norm(vector).alias("norm")), asked.select("query_id", "query", norm("query").alias("query_norm"))
    score = F.try_divide(dot(F.col(vector), F.col("query")), F.col("norm") * F.col("query_norm"))
    return top(own.join(small(other)).select("query_id", vector_id, rounded(score, 6).alias("score")), limit, F.desc("score"), F.col(vector_id))


def reciprocal_rank(weight: float, position: Column, k: int = K.RRF_K) -> Column:
    """Weighted reciprocal rank; position 1 scores the weight itself."""
    return F.lit(weight) * F.lit(float(k + 1)) / (F.lit(float(k)) + position)


def fuse(lexical: DataFrame, semantic_hits: DataFrame, top_k: int = K.TOP_K, w_lexical: float = K.WEIGHT_LEXICAL, w_semantic: float = K.WEIGHT_SEMANTIC, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, chunk_id, score, score_lexical, score_semantico, fontes, rank): both lists by the sum of their reciprocal ranks."""
    none = F.lit(None).cast("int")
    both = lexical.select(*keys, "chunk_id", F.col("posicao").alias("lex"), none.alias("sem")).unionByName(semantic_hits.select(*keys, "chunk_id", none.alias("lex"), F.col("posicao").alias("sem")))
    merged = both.groupBy(*keys, "chunk_id").agg(F.min("lex").alias("lex"), F.min("sem").alias("sem"))
    parts = merged.withColumns({"score_lexical": F.coalesce(reciprocal_rank(w_lexical, F.col("lex")), F.lit(0.0)), "score_semantico": F.coalesce(reciprocal_rank(w_semantic, F.col("sem")), F.lit(0.0))})
    sources = F.concat_ws(",", F.when(F.col("lex").isNotNull(), "lexical"), F.when(F.col("sem").isNotNull(), "semantica"))
    scored = parts.withColumns({"score": rounded(F.col("score_lexical") + F.col("score_semantico"), 6), "fontes": F.split(sources, ",")})
    best = top(scored, top_k, F.desc("score"), F.asc_nulls_last("lex"), F.asc_nulls_last("sem"), keys=keys, name="rank")
    return best.select(*keys, "chunk_id", "score", rounded(F.col("score_lexical"), 6).alias("score_lexical"), rounded(F.col("score_semantico"), 6).alias("score_semantico"), "fontes", "rank")


def hybrid(index: DataFrame | Index, asked: DataFrame, top_k: int = K.TOP_K, lexical_limit: int = K.LEXICAL_LIMIT, semantic_limit: int = K.SEMANTIC_LIMIT, dimensions: int | None = K.DIMENSIONS, by_agency: bool = False) -> DataFrame:
    """Hybrid search: both lists fused. Without ``dimensions`` the semantic side is off and the lexical one answers alone."""
    index = Index.of(index, dimensions)
    lex = bm25(index, asked, lexical_limit, by_agency)
    sem = semantic(index, asked, semantic_limit, dimensions, by_agency) if dimensions else lex.limit(0)
    found = fuse(lex, sem, top_k, keys=("query_id", "orgao") if by_agency else ("query_id",))
    return _sent(found, index, asked, top_k, by_agency)


def _sent(found: DataFrame, index: Index, asked: DataFrame, top_k: int, by_agency: bool = False) -> DataFrame:
    """With a broadcast hint if ``found``, top_k rows a question or a question and agency, can't have more than MOST_FOUND rows: chunks that join it stay where they are."""
    most = max(1, MOST_FOUND // max(top_k, 1))
    n = asked.limit(most + 1).count()
    if by_agency and n <= most:
        n *= index.chunks.select("orgao").distinct().limit(most + 1).count()
    return F.broadcast(found) if n <= most else found


def retrieve(spark: SparkSession, folder: str, asked: DataFrame, top_k: int = K.TOP_K, lexical_limit: int = K.LEXICAL_LIMIT, semantic_limit: int = K.SEMANTIC_LIMIT) -> tuple[DataFrame, dict]:
    """Evidence for questions from a stored index, and what was searched how.

    An empty question is an error, and so is an index without chunks or postings. Without vectors the lexical side answers alone, and
    the diagnostics say why: {"lexica": {...}, "semantica": {"enabled": false, "reason": ...}}.
    """
    if not asked.filter(F.coalesce(F.trim("pergunta"), F.lit("")) == "").isEmpty():
        raise ValueError("a question is empty")
    at = lambda k: spark.read.parquet(f"{folder.rstrip('/')}/{k}")
    side, dimensions = {"enabled": True, "limite": semantic_limit}, None
    try:
        index = Index.read(spark, folder)
        dimensions = index.dimensions
    except AnalysisException as e:
        if "/vectors" not in str(e):
            raise
        index = Index._stored(at, None)
        side = {"enabled": False, "reason": "vetores ausentes" if e.getCondition() == "PATH_NOT_FOUND" else str(e).split("\n")[0]}
    lex = bm25(index, asked, lexical_limit)
    sem = semantic(index, asked, semantic_limit, dimensions) if dimensions else lex.limit(0)
    return evidence(_sent(fuse(lex, sem, top_k), index, asked, top_k), index), {"lexica": {"enabled": True, "limite": lexical_limit}, "semantica": side, "top_k": top_k}


def evidence(ranked: DataFrame, chunks: DataFrame | Index) -> DataFrame:
    """Ranked chunks with document, page and excerpt."""
    chunks = chunks.chunks if isinstance(chunks, Index) else chunks
    own = chunks.select("chunk_id", F.col("texto").alias("trecho"), F.col("document_id").alias("documento"), F.col("pagina_inicial").alias("pagina"), "pagina_final", F.col("orgao").alias("orgao_documento"), "tipo_documento")
    return own.join(ranked, "chunk_id")


def evidence_context(found: DataFrame) -> DataFrame:
    """(query_id, contexto): the evidence of each question as numbered, citable blocks, by rank; null values are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    labels = [("Documento", "documento"), ("Órgão", "orgao_documento"), ("Tipo", "tipo_documento"), ("Página", "pagina"), ("Trecho", "trecho")]
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), text(c)) for k, c in labels]))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])  # top_k of them at most
    return found.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("contexto"))


def cited_answer(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, resposta) for every question: its best three excerpts with their sources, or that nothing was found."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    short = F.concat(F.trim(F.substring(text("trecho"), 1, K.EXCERPT)), F.when(F.length(text("trecho")) > K.EXCERPT, "...").otherwise(""))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), short, F.lit(" Fonte: "), text("documento"), F.lit(", página "), text("pagina"), F.lit("."))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    best = found.filter(F.col("rank") <= K.ANSWER_EXCERPTS).groupBy("query_id").agg(F.array_join(lines, "\n").alias("linhas"))
    whole = F.concat(F.lit(K.ANSWER_HEAD), F.col("linhas"), F.lit(K.ANSWER_TAIL))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(whole, F.lit(K.ANSWER_NONE)).alias("resposta"))

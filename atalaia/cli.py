"""Commands: collect, index, search, classify, analyse, reset."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import chunking, classify, collection, keywords, maturity, phrases, search, web
from .sources import readers, sinks
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="atalaia")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build the index from a table of documents, or of PDF files below a folder")
    i.add_argument("--documents", help="Parquet with document_id, orgao, tipo_documento, text")
    i.add_argument("--pdf-root")
    i.add_argument("--out", required=True)
    i.add_argument("--tipos", nargs="*")
    i.add_argument("--orgaos", nargs="*")
    i.add_argument("--max-documents", type=int)
    i.add_argument("--ratio", type=int, default=0, help="files of each agency, 0 for all")
    i.add_argument("--sem-tipo", help="type of PDF files in a layout without types")
    i.add_argument("--incremental", action="store_true", help="upsert by document_id into a versioned index")
    i.add_argument("--max-pages", type=int, default=K.MAX_PAGES)
    i.add_argument("--chunk-size", type=int, default=K.CHUNK_SIZE)
    i.add_argument("--chunk-overlap", type=int, default=K.CHUNK_OVERLAP)
    i.add_argument("--embedding-dimensions", type=int, default=K.DIMENSIONS)
    s = sub.add_parser("search", help="answer a question, or all criteria of a file")
    s.add_argument("pergunta", nargs="?")
    s.add_argument("--usar-criterios", action="store_true")
    c = sub.add_parser("classify", help="label agencies by criteria and write the report")
    for x in (s, c):
        x.add_argument("--index", required=True)
        x.add_argument("--criterios-file")
        x.add_argument("--criterio")
        x.add_argument("--max-criterios", type=int)
        x.add_argument("--orgao", action="append")
        x.add_argument("--tipos", nargs="*")
        x.add_argument("--top-k", type=int, default=K.TOP_K)
    c.add_argument("--max-orgaos", type=int)
    c.add_argument("--min-score-atende", type=float, default=K.MIN_FULL)
    c.add_argument("--min-score-parcial", type=float, default=K.MIN_PARTIAL)
    c.add_argument("--min-keyword-hits", type=int, default=K.MIN_HITS)
    c.add_argument("--manual-sample-size", type=int, default=K.SAMPLE_SIZE)
    c.add_argument("--output-dir", required=True)
    a = sub.add_parser("analyse", help="count keywords, or score maturity")
    a.add_argument("--documents", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--orgao")
    a.add_argument("--keywords-file")
    a.add_argument("--keywords")
    a.add_argument("--only-integrity-plans", action="store_true")
    a.add_argument("--lexico", help="JSON file of the maturity lexicon")
    a.add_argument("--exato", action="store_true", help="read whole pages and count every occurrence")
    o = sub.add_parser("collect", help="document links of fetched pages by agency, and what is still to be collected")
    o.add_argument("--pages", required=True, help="Parquet with page_id, url, html")
    o.add_argument("--registry", required=True, help="JSON object of agencies by acronym")
    o.add_argument("--pdf-root", help="files that are there already")
    o.add_argument("--tipos", nargs="*")
    o.add_argument("--out", required=True)
    r = sub.add_parser("reset", help="drop old versions of a versioned index, or all of it")
    r.add_argument("--index", required=True)
    r.add_argument("--keep", type=int, default=1, help="versions that stay; 0 for none")
    return p


def documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Documents of a Parquet table, or extracted from PDF files; filtered by type and agency."""
    kinds, agencies = readers.document_types(a.tipos), readers.agency_names(a.orgaos)
    if a.pdf_root:
        files = readers.pdf_files(spark, a.pdf_root, a.tipos, a.orgaos, a.sem_tipo, a.ratio)
        if a.max_documents:
            files = files.orderBy("caminho").limit(a.max_documents)
        pages = readers.extracted_pages(files, most=a.max_pages)
        one_line = F.regexp_replace("texto", r"\s+", " ")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", one_line.alias("t")))), lambda x: x["t"]), "\n")
        whole = pages.groupBy("caminho").agg(text.alias("text"))
        return files.join(whole, "caminho").select(chunking.document_id(F.col("caminho"), F.sha2("content", 256)).alias("document_id"), "orgao", "tipo_documento", "text")
    rows = spark.read.parquet(a.documents)
    if a.tipos:
        rows = rows.filter(F.col("tipo_documento").isin(kinds))
    if agencies:
        rows = rows.filter(F.upper(F.trim("orgao")).isin(agencies))
    return rows.orderBy("document_id").limit(a.max_documents) if a.max_documents else rows


def stored(spark: SparkSession, folder: str) -> search.Index | None:
    """The last version of a versioned index; None if the folder has none."""
    held = Store(spark, folder)
    return Store(spark, folder, dimensions=held.manifest()["dimensions"]).read() if held.version() else None


def collect(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Write the links of fetched pages with the agency whose address they are below, and each agency's state."""
    agencies = readers.registry(spark, a.registry)  # of a file's size
    pages = spark.read.parquet(a.pages).select("page_id", "url", "html")
    site = agencies.select("sigla", F.regexp_replace("link", "/+$", "").alias("site")).filter("site <> ''")
    below = F.expr("url = site or startswith(url, site || '/') or startswith(url, site || '?')")
    # Of several addresses that a page is below the longest is its agency's.
    of = pages.select("page_id", "url").join(F.broadcast(site), below).groupBy("page_id", "url").agg(F.max_by("sigla", F.struct(F.length("site"), "sigla")).alias("sigla"))
    links = web.document_links(web.anchors(pages)).join(of.select("page_id", "sigla").distinct(), "page_id")
    links.write.mode("overwrite").json(f"{a.out.rstrip('/')}/links")
    links = spark.read.schema(links.schema).json(f"{a.out.rstrip('/')}/links")
    none = spark.createDataFrame([], "sigla string, tipo string")
    held = readers.pdf_files(spark, a.pdf_root, a.tipos).select(F.col("orgao").alias("sigla"), F.col("tipo_documento").alias("tipo")) if a.pdf_root else none
    state = collection.flow(agencies, held, links.groupBy("sigla").agg(F.count(F.lit(1)).alias("links")), readers.document_types(a.tipos) if a.tipos else None)
    state.write.mode("overwrite").json(f"{a.out.rstrip('/')}/agencias")
    return {"links": links.count(), "agencias": [json.loads(x) for x in state.orderBy("sigla").toJSON().collect()]}  # of the registry's size


def run(spark: SparkSession, argv: list[str] | None = None) -> dict | list:
    """Run a command; returns what it prints."""
    a = parser().parse_args(argv)
    if a.command == "collect":
        return collect(spark, a)
    if a.command == "reset":
        held = Store(spark, a.index)
        gone = held.drop_old(a.keep) if a.keep else held.clear()
        return {"versoes_apagadas": gone, "versao": held.version()}
    if a.command == "index" and a.incremental:
        held = Store(spark, a.out, a.chunk_size, a.chunk_overlap, a.embedding_dimensions)
        return {"versao": held.upsert(documents(spark, a))}
    if a.command == "index":
        return sinks.write_index(documents(spark, a), a.out, a.chunk_size, a.chunk_overlap, a.embedding_dimensions)
    if a.command == "analyse":
        docs = spark.read.parquet(a.documents)
        docs = docs.filter(F.col("orgao") == a.orgao) if a.orgao else docs
        if a.only_integrity_plans:
            out = maturity.document_index(maturity.audited(docs, readers.lexicon(spark, a.lexico) if a.lexico else None))
        else:
            words = readers.keywords(spark, a.keywords_file, a.keywords)
            if not words:
                raise SystemExit("keywords are needed")
            pages = chunking.pages(docs)
            found = phrases.counts_by_page(pages, phrases.listed(spark, words)) if a.exato else keywords.counts_by_page(pages, words)
            out = keywords.percentages(found, docs)
        out.write.mode("overwrite").json(a.out)
        return [json.loads(x) for x in out.limit(20).toJSON().collect()]
    kinds = readers.document_types(a.tipos) if a.tipos else None
    if a.command == "search" and not a.usar_criterios:
        asked = search.questions(spark, [("pergunta", a.pergunta, (a.orgao or [None])[0], kinds)])
    else:
        criteria = classify.criteria_rows(readers.criteria(spark, a.criterios_file), a.criterio, a.max_criterios)
        criteria = criteria.withColumn("tipos", F.array(*map(F.lit, kinds))) if kinds else criteria
        asked = criteria.select(F.col("codigo").alias("query_id"), "pergunta", F.lit((a.orgao or [None])[0]).cast("string").alias("orgao"), "tipos")
    if a.command == "search":
        found = search.evidence(search.hybrid(index, asked, a.top_k), index) if (index := stored(spark, a.index)) else search.retrieve(spark, a.index, asked, a.top_k)[0]
        return [json.loads(x) for x in found.orderBy("query_id", "rank").toJSON().collect()]
    index = stored(spark, a.index) or search.Index.read(spark, a.index)
    agencies = index.chunks.select("orgao").distinct()
    agencies = agencies.filter(F.col("orgao").isin(a.orgao)) if a.orgao else agencies
    agencies = agencies.orderBy("orgao").limit(a.max_orgaos) if a.max_orgaos else agencies
    rows = classify.classify(index, criteria, agencies, a.top_k, a.min_score_atende, a.min_score_parcial, a.min_keyword_hits, dimensions=index.dimensions).persist()
    try:
        return sinks.write_report(rows, a.output_dir, a.manual_sample_size, readers.axis_weights(spark, a.criterios_file))
    finally:
        rows.unpersist()


def main() -> None:
    spark = SparkSession.builder.appName("atalaia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(spark), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()

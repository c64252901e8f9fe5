"""Links of pages, and the bounded crawl over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.links import absolute, any_of, is_pdf, origin, probably_document, same_link, without_fragment
from ..functions.text import collapse, has_year, title_date, title_from_url

_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
_PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, texto): the links of (page_id, url, html) in order."""
    html = F.coalesce("html", F.lit(""))
    hrefs, inner = F.regexp_extract_all(html, F.lit(_ANCHOR), 1), F.regexp_extract_all(html, F.lit(_ANCHOR), 2)
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("i", "a"))
    return rows.select("page_id", "url", (F.col("i") + 1).alias("pos"), "a.href", collapse(F.regexp_replace("a.inner", "<[^>]*>", " ")).alias("texto"))


def document_links(found: DataFrame, kind: str = "cig", pdf_only: bool = True) -> DataFrame:
    """Links that are likely documents (and PDFs), absolute, with a title."""
    rows = found.withColumn("link", absolute(F.col("href"), F.col("url"))).filter(probably_document(F.col("link"), F.col("texto"), kind))
    if pdf_only:
        rows = rows.filter(is_pdf(F.col("link")))
    return rows.select("page_id", "pos", "link", title_from_url(F.col("texto"), F.col("link")).alias("titulo"), title_date(F.col("texto")).alias("data"))


def first_of_same(links: DataFrame, *order: str) -> DataFrame:
    """Of links equal but for case and query the first by ``order``."""
    w = Window.partitionBy("mesmo").orderBy(*order)
    return links.withColumn("mesmo", same_link(F.col("link"))).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def page_scores(found: DataFrame, kind: str = "cig") -> DataFrame:
    """By page: likely documents among its first 300 anchors, whether its path has a keyword, whether it is a hub."""
    href = F.col("href")
    rows = found.filter((F.col("pos") <= K.CRAWL_ANCHORS) & (href != "") & ~F.startswith(href, F.lit("#")))
    rows = rows.withColumn("link", absolute(href, F.col("url")))
    rows = rows.groupBy("page_id", "url").agg(F.count_if(probably_document(F.col("link"), F.col("texto"), kind) & F.col("link").rlike("^https?://")).alias("pdf_score"))
    path = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1))
    return rows.withColumn("palavra", any_of(path, K.HUB_PATHS[kind])).withColumn("hub", F.col("palavra") | (F.col("pdf_score") >= 2))


def crawl(edges: DataFrame, start: str, pages_most: int = K.CRAWL_PAGES, depth_most: int = K.CRAWL_DEPTH) -> DataFrame:
    """(url, depth, ordem): the breadth-first visit from ``start`` over (source, target, pos), in visiting order.

    Pages and depth are budgets of the crawl: at most ``pages_most`` rows, so a level is a small table. Fragments do
    not make another page; a page offers its first 40 links to its own origin that were not visited.
    """
    spark = edges.sparkSession
    links = edges.select(without_fragment(F.col("source")).alias("source"), without_fragment(F.col("target")).alias("target"), "pos").filter(origin(F.col("source")) == origin(F.col("target")))
    visited: list[tuple[str, int, int]] = [(start.split("#")[0], 0, 1)]
    level = list(visited)
    for depth in range(1, depth_most + 1):
        if len(visited) >= pages_most or not level:
            break
        frontier = F.broadcast(spark.createDataFrame([(u, o) for u, _, o in level], "source string, o int"))
        seen = F.broadcast(spark.createDataFrame([(u,) for u, _, _ in visited], "target string"))
        offered = links.join(frontier, "source").join(seen, "target", "left_anti")
        offered = offered.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("pos", "target"))).filter(F.col("n") <= K.CRAWL_OUTLINKS)
        first = offered.groupBy("target").agg(F.min(F.struct("o", "n")).alias("k")).orderBy("k.o", "k.n", "target").limit(pages_most - len(visited))
        level = [(r["target"], depth, len(visited) + i + 1) for i, r in enumerate(first.collect())]
        visited += level
    return spark.createDataFrame(visited, "url string, depth int, ordem int")


def hubs(visited: DataFrame, scores: DataFrame, most: int = K.CRAWL_HUBS) -> DataFrame:
    """The first hubs of a crawl in visiting order."""
    return scores.filter("hub").join(F.broadcast(visited), "url").orderBy("ordem").limit(most).select("url", "depth", "ordem", "pdf_score", "palavra")


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, url, elementos): by page its links in order, each with the paragraph at the same place.

    The shorter list ends both; a page without paragraphs keeps all links, with empty ones. Null html has no links.
    """
    html = F.coalesce("html", F.lit(""))
    plain = lambda c: collapse(F.regexp_replace(c, "<[^>]*>", " "))
    rows = pages.select("page_id", "url", F.regexp_extract_all(html, F.lit(_ANCHOR), 1).alias("h"), F.regexp_extract_all(html, F.lit(_ANCHOR), 2).alias("t"), F.regexp_extract_all(html, F.lit(_PARAGRAPH), 1).alias("p"))
    n = F.when(F.size("p") == 0, F.size("h")).otherwise(F.least(F.size("h"), F.size("p")))
    zipped = F.arrays_zip(F.slice("h", 1, n).alias("h"), F.slice("t", 1, n).alias("t"), F.slice("p", 1, n).alias("p"))
    one = lambda e: F.struct(e["h"].alias("href"), plain(e["t"]).alias("texto"), F.coalesce(plain(e["p"]), F.lit("")).alias("paragrafo"))
    return rows.select("page_id", "url", F.transform(zipped, one).alias("elementos"))


def first_hit(terms: list[str]) -> Column:
    """(achou, href, tem_ano) of the first element whose title or paragraph holds one of the terms; the flag is for a year in its title."""
    low = [t.lower() for t in terms]
    hit = F.try_element_at(F.filter("elementos", lambda e: any_of(F.lower(e["texto"]), low) | any_of(F.lower(e["paragrafo"]), low)), F.lit(1))
    return F.struct(hit.isNotNull().alias("achou"), hit["href"].alias("href"), F.coalesce(has_year(hit["texto"]), F.lit(False)).alias("tem_ano"))


def search_hits(rows: DataFrame, terms: list[str] | None = None, kind: str = "cig") -> DataFrame:
    """By page of ``elements`` its first hit, and whether a title alone holds one of the terms; in the page's own row.

    Without terms they are the usual ones for a ``kind`` of document.
    """
    terms = terms or K.SEARCH_TERMS[kind]
    titles = F.exists("elementos", lambda e: any_of(F.lower(e["texto"]), [t.lower() for t in terms]))
    return rows.select("page_id", first_hit(terms).alias("a"), titles.alias("no_titulo")).select("page_id", "a.*", "no_titulo")


def portal_hits(rows: DataFrame, terms: list[str] | None = None, kind: str = "cig") -> DataFrame:
    """(page_id, termo, achou, href, tem_ano): the first hit of each term, numbered in the order of the search."""
    terms = terms or K.SEARCH_TERMS[kind]
    found = F.array(*[F.struct(F.lit(i).alias("termo"), first_hit([t]).alias("a")) for i, t in enumerate(terms)])
    return rows.select("page_id", F.explode(found).alias("f")).select("page_id", "f.termo", "f.a.*")


def portal_links(hits: DataFrame, by_year: DataFrame, fallback: DataFrame) -> DataFrame:
    """(page_id, link, origem): where a portal's documents are looked for.

    The first term with a hit decides: a title with a year stands for all of ``by_year`` (page_id, link), any other for its own link
    alone; without a hit the hubs of ``fallback`` (page_id, link) are taken.
    """
    first = F.min_by(F.struct("href", "tem_ano"), F.when(F.col("achou"), F.col("termo")))
    decided = hits.groupBy("page_id").agg(first.alias("a")).select("page_id", "a.href", F.when(F.col("a").isNull(), "hub").when(F.col("a.tem_ano"), "ano").otherwise("titulo").alias("origem"))
    listed = by_year.select("page_id", "link", F.lit("ano").alias("origem")).unionByName(fallback.select("page_id", "link", F.lit("hub").alias("origem")))
    own = decided.filter("origem = 'titulo'").select("page_id", F.col("href").alias("link"), "origem")
    return own.unionByName(listed.join(decided.drop("href"), ["page_id", "origem"], "left_semi").select("page_id", "link", "origem"))

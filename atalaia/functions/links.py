"""Rules on links and titles as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def any_of(c: Column, parts: list[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(p)) for p in parts])


def ends_any(c: Column, parts: list[str]) -> Column:
    return reduce(or_, [F.endswith(c, F.lit(p)) for p in parts])


def bare_path(url: Column) -> Column:
    """Lower-cased URL without query, fragment and closing slashes."""
    return F.regexp_replace(F.split(F.split(F.lower(url), r"\?")[0], "#")[0], "/+$", "")


def probably_document(url: Column, text: Column, kind: str) -> Column:
    """Whether a link is likely to lead to a document of a kind (cig, pg, compliance)."""
    u, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    against = K.LINK_TEXT_AGAINST + (K.LINK_TEXT_AGAINST_CIG if kind == "cig" else [])
    general = ~any_of(t, against) & (any_of(u, K.LINK_URL_MARKS) | F.endswith(u, F.lit("-pdf")) | any_of(t, K.LINK_TEXT_MARKS))
    if kind != "cig":
        early = ends_any(bare_path(url), [".pdf", "-pdf", "_pdf"]) | F.contains(u, F.lit(".pdf"))
        early = early | (F.contains(u, F.lit("/documents/")) & any_of(u, K.LINK_EARLY_PATHS))
        general = early | general
    return F.coalesce((url != "") & general, F.lit(False))


def is_pdf(url: Column) -> Column:
    """Whether a URL is that of a PDF, or of a page that stands for one."""
    u, p = F.lower(url), bare_path(url)
    inside = p.rlike(r"^.*?\.pdf(?![\p{L}\p{N}])")
    first_cut = F.substring_index(p, ".pdf", 1)
    after = F.substring(p, F.length(first_cut) + 5, 1)
    plain = F.contains(p, F.lit(".pdf")) & ~after.rlike(r"[\p{L}\p{N}]")
    return F.coalesce((url != "") & (ends_any(p, [".pdf", "-pdf", "_pdf"]) | (inside & plain) | (any_of(u, K.PDF_MARKS) & ends_any(p, K.PDF_ENDINGS))), F.lit(False))


def is_minutes(title: Column) -> Column:
    """Whether a title is that of the minutes of a meeting."""
    t = F.lower(title)
    yes = any_of(t, K.MINUTES_WORDS) | (any_of(t, K.MINUTES_ORDINALS) & title.rlike(r"\p{Nd}"))
    return F.coalesce(~any_of(t, K.MINUTES_AGAINST) & yes, F.lit(False))


def origin(url: Column) -> Column:
    """Scheme and host, null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def absolute(href: Column, base: Column) -> Column:
    """A link as an absolute URL: as it is, with https for //, else from the origin of ``base``; mail, phone and script links stay."""
    h = F.trim(href)
    return (
        F.when(h.rlike("^https?://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h))
        .when(h.rlike("^(mailto|tel|javascript):"), h)
        .when(F.startswith(h, F.lit("/")), F.concat(origin(base), h))
        .otherwise(F.concat(origin(base), F.lit("/"), h))
    )


def without_fragment(url: Column) -> Column:
    return F.split(url, "#")[0]


def same_link(url: Column) -> Column:
    """The key under which links count as the same: lower case, no query."""
    return F.split(F.lower(url), r"\?")[0]


def agency_of_filename(name: Column) -> Column:
    """The first agency one of whose patterns the name holds, else a short prefix before the first _, else OUTROS."""
    low, out = F.lower(name), None
    for agency, patterns in K.AGENCY_PATTERNS.items():
        hit = any_of(low, patterns)
        out = F.when(hit, agency) if out is None else out.when(hit, agency)
    prefix = F.upper(F.split(name, "_")[0])
    return out.when(F.length(prefix) <= 10, prefix).otherwise("OUTROS")


def lookup(c: Column, known: dict[str, str]) -> Column:
    """A value by its name, "" where it is not known."""
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(""))


def named(rows: DataFrame, column: str, known: DataFrame, out: str = "sigla") -> DataFrame:
    """``rows`` with the acronym of the name in a column, from a table (nome, sigla) of any size; "" where it is not known.

    Of a name that the table has twice the least acronym counts; null names are not known.
    """
    table = known.groupBy(F.col("nome").alias("nome_")).agg(F.min("sigla").alias("sigla_"))
    found = rows.join(table, F.col(column) == F.col("nome_"), "left")
    return found.withColumn(out, F.coalesce("sigla_", F.lit(""))).drop("nome_", "sigla_")

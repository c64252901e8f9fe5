"""Text rules as column expressions; everything stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Accented Latin letters and their base letters, by Unicode decomposition.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)

TEXTS = "array<string>"


def collapse(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, the twelve Portuguese accented letters without accents, white space collapsed."""
    return collapse(F.translate(F.lower(F.coalesce(c, F.lit(""))), K.FOLD_FROM, K.FOLD_TO))


def unaccent(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, _ACCENTED, _PLAIN)


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def sentences(c: Column) -> Column:
    """Split after a full stop, exclamation or question mark."""
    return F.split(c, r"(?<=[.!?])\s+")


def index_tokens(c: Column) -> Column:
    """Tokens of the lexical index: lower case, no accents, runs of letters and digits."""
    return F.filter(F.split(unaccent(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Tokens of the embedding: lower case, accents kept, runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), 0)


def query_tokens(c: Column) -> Column:
    """Tokens of a question: three characters or more, hyphens kept, stop words dropped, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b[\w-]{3,}\b"), 0)
    return F.filter(found, lambda t: ~t.isin(K.QUERY_STOP_WORDS))


def printable(c: Column) -> Column:
    """Control and separator characters as blanks."""
    return F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}]", " ")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N} ._]", "_")


def title_from_url(title: Column, url: Column) -> Column:
    """The link's text, else the last path segment decoded with blanks for - and _, else "documento"."""
    path = F.regexp_replace(F.split(F.split(url, r"[?#]")[0], "^[a-z]+://[^/]*")[F.size(F.split(F.split(url, r"[?#]")[0], "^[a-z]+://[^/]*")) - 1], "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    named = F.trim(F.translate(F.coalesce(F.try_url_decode(last), last), "-_", "  "))
    return F.coalesce(F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(named, F.lit("")), F.lit("documento"))


def excerpt(c: Column, limit: int = 420) -> Column:
    """At most ``limit`` characters of collapsed text, with dots where it was cut."""
    t = collapse(c)
    return F.when(F.length(t) > limit, F.concat(F.trim(F.substring(t, 1, limit)), F.lit("..."))).otherwise(t)


#: White space of SQL's patterns, which have no vertical tab in it; a blank line; the blanks that SQL trims.
SPACE = r"[\t\n\f\r ]"
BLANK_LINE = rf"\n{SPACE}*\n"
BLANKS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs")


def without_page_numbers(c: Column) -> Column:
    """Lines that hold a number alone go, then line ends are made alike."""
    return F.regexp_replace(F.regexp_replace(c, rf"\n{SPACE}*[-–]?{SPACE}*\d+{SPACE}*[-–]?{SPACE}*\n", "\n"), r"\r\n?", "\n")


def paragraphs(c: Column, least: int = K.SEGMENT_CHARS) -> Column:
    """Stretches between blank lines, trimmed of blanks of any width, of ``least`` characters or more."""
    return F.filter(F.transform(F.split(without_page_numbers(c), BLANK_LINE), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: F.length(x) >= least)


def title_date(c: Column) -> Column:
    """The first date that one of the ordered patterns finds; null if none does."""
    found = [F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in K.DATE_PATTERNS]
    return F.coalesce(*found)


def has_year(c: Column) -> Column:
    return c.rlike(r"\b20\d{2}\b")


def rounded(c: Column, places: int) -> Column:
    """Half up at ``places`` digits, by the formula that SQL engines share."""
    return F.floor(c * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def two_places(c: Column) -> Column:
    """A number with two digits after the point, "0.00" for what is none; ties go up, as the shortest digits of the number show them."""
    n = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.format_string("%.2f", n)


def dotted(c: Column) -> Column:
    """A whole number with dots between thousands; null is 0."""
    return F.translate(F.format_number(F.coalesce(c, F.lit(0)).cast("decimal(38,0)"), 0), ",", ".")


def booster_names(c: Column) -> Column:
    """Names of boosters without their numbers, by commas in the order given; "-" if there are none."""
    named = F.array_join(F.transform(F.array_compact(c), lambda x: F.regexp_replace(x, "B[1-4]_", "")), ", ")
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("-"))

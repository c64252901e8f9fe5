"""Readers of files; a missing or broken file gives an empty frame where that is the rule."""

from __future__ import annotations

import io
import re
import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.classify import CRITERION
from ..operators.search import small

T = TypeVar("T")


def document_types(types: list[str] | None) -> list[str]:
    """Validated document types; none means all."""
    found = [t.strip().lower() for t in types or [] if t.strip()]
    if bad := [t for t in found if t not in K.DOCUMENT_TYPES]:
        raise ValueError(f"unknown document types: {bad}")
    return found or list(K.DOCUMENT_TYPES)


def agency_names(agencies: list[str] | None) -> list[str]:
    return [a.strip().upper() for a in agencies or [] if a.strip()]


def pdf_files(spark: SparkSession, root: str, types: list[str] | None = None, agencies: list[str] | None = None, untyped: str | None = None, first: int | None = None) -> DataFrame:
    """PDF files below root/<type>/…/<agency>/, with type, agency, name and content; only the types asked for are listed, and no empty files.

    ``untyped`` names the type of files in root/<agency>/, a layout without types, which are left out without it. With ``first``
    only so many files of each type and agency are taken, by name.
    """
    wanted = document_types(types)
    paths = [(f"{root.rstrip('/')}/{t}", t, True) for t in wanted] + ([(f"{root.rstrip('/')}/*/*.[pP][dD][fF]", untyped, False)] if untyped in wanted else [])
    frames = []
    for p, t, deep in paths:
        reader = spark.read.format("binaryFile")
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]") if deep else reader
        try:
            rows = reader.load(p)
        except AnalysisException:  # this type has no folder
            continue
        known = F.element_at(F.split("path", "/"), -2).isin(*K.DOCUMENT_TYPES)
        frames.append((rows if deep else rows.filter(~known)).filter("length > 0").withColumn("tipo", F.lit(t)))
    if not frames:
        return spark.createDataFrame([], "caminho string, tipo_documento string, orgao string, arquivo string, tamanho long, content binary")
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    parts = F.split("path", "/")
    rows = rows.select(F.col("path").alias("caminho"), F.col("tipo").alias("tipo_documento"), F.upper(F.element_at(parts, -2)).alias("orgao"), F.element_at(parts, -1).alias("arquivo"), F.col("length").alias("tamanho"), "content")
    rows = rows.filter(F.col("orgao").isin(agency_names(agencies))) if agency_names(agencies) else rows
    return first_of_agency(rows, first) if first else rows


def first_of_agency(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of each type and agency by name (ties: by path). Names are ranked without contents, which join what is left."""
    ranked = files.select("caminho", "tipo_documento", "orgao", "arquivo").withColumn("n", F.row_number().over(Window.partitionBy("tipo_documento", "orgao").orderBy("arquivo", "caminho")))
    return files.join(small(ranked.filter(F.col("n") <= n).select("caminho")), "caminho", "left_semi")


def catalog(files: DataFrame) -> DataFrame:
    """Sorted file names by type and agency; content is not read."""
    return files.groupBy("tipo_documento", "orgao").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("arquivo")).alias("arquivos"))


def is_pdf_content(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def extracted_pages(files: DataFrame, readers: list[Callable[[bytes, int], list[str]]] | None = None, most: int = K.MAX_PAGES) -> DataFrame:
    """(caminho, page_no, texto) of files by the first reader that finds words; pages are lower-cased, blank ones dropped."""

    def work(batches: Iterator) -> Iterable:
        import pandas as pd

        tried = readers or [r for r in (_pypdf,) if r]
        for b in batches:
            out = []
            for path, content in zip(b["caminho"], b["content"], strict=True):
                for read in tried:
                    try:
                        texts = [t.lower() for t in read(bytes(content), most)]
                    except Exception:  # a reader that can't open a file leaves it to the next
                        continue
                    texts = [t for t in texts if t.strip()]
                    if any(t.split() for t in texts):
                        out += [(path, i + 1, t) for i, t in enumerate(texts)]
                        break
            yield pd.DataFrame(out, columns=["caminho", "page_no", "texto"])

    return files.select("caminho", "content").mapInPandas(work, "caminho string, page_no int, texto string")


def _pypdf(content: bytes, most: int) -> list[str]:
    from pypdf import PdfReader  # optional; without it the next reader is tried

    pages = PdfReader(io.BytesIO(content)).pages
    return [p.extract_text() or "" for p in (pages[:most] if most else pages)]


def cached_pages(files: DataFrame, folder: str, readers: list[Callable[[bytes, int], list[str]]] | None = None, most: int = K.MAX_PAGES) -> DataFrame:
    """``extracted_pages`` through a Parquet cache keyed by a file's content: only contents that the cache lacks are read.

    The cache holds a row with page_no 0 for each content, so a file without words is not tried again; a run that fails leaves the
    cache as it was. Files of equal content are read once; null content has no pages. ``most`` belongs to the key.
    """
    spark = files.sparkSession
    named = files.withColumn("chave", F.concat(F.sha2("content", 256), F.lit(f":{most}")))
    fresh = named.filter("chave is not null").dropDuplicates(["chave"]).select("chave", "content")
    known = _cache(spark, folder)
    if known is not None:
        fresh = fresh.join(known.filter("page_no = 0").select("chave"), "chave", "left_anti")
    pages = extracted_pages(fresh.withColumnRenamed("chave", "caminho"), readers, most).withColumnRenamed("caminho", "chave")
    marks = fresh.select("chave", F.lit(0).alias("page_no"), F.lit("").alias("texto"))
    pages.unionByName(marks).write.mode("append").parquet(folder)
    held = spark.read.schema(_CACHE).parquet(folder).filter("page_no > 0").distinct()  # two runs at once may have written the same
    return named.select("caminho", "chave").join(held, "chave").select("caminho", "page_no", "texto")


_CACHE = "chave string, page_no int, texto string"


def _cache(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def listed_agencies(spark: SparkSession, root: str, types: list[str] | None = None) -> list[str]:
    """The agencies that have a folder with PDF files under any of the types, sorted, each once; contents are not read."""
    return [r["orgao"] for r in pdf_files(spark, root, types).select("orgao").distinct().orderBy("orgao").collect()]


def retried(f: Callable[[], T], attempts: int = 3, base_s: float = 0.5, wait: Callable[[float], None] = time.sleep) -> T:
    """The value of ``f``, called again after 1, 2, 4, ... times ``base_s`` while it fails; the last error is raised. At least one call."""
    for n in range(max(1, attempts) - 1):
        try:
            return f()
        except Exception:
            wait(base_s * 2**n)
    return f()


def keywords(spark: SparkSession, path: str | None = None, typed: str | None = None) -> list[str]:
    """Keywords from a file, one a line, or typed with commas; lower-cased, without blanks and repeats."""
    raw = [r["value"] for r in spark.read.text(path).collect()] if path else (typed or "").split(",")
    return list(dict.fromkeys(k.strip().lower() for k in raw if k.strip()))


def criteria(spark: SparkSession, path: str) -> DataFrame:
    """Criteria of a JSON file: an object with ``criterios``, or a bare list; an object without them has none, anything else is an error."""
    text = spark.read.text(path, wholetext=True)
    given = F.coalesce(F.get_json_object("value", "$.criterios"), F.when(F.get_json_object("value", "$[0]").isNull() & F.ltrim("value").startswith("{"), "[]"), F.col("value"))
    if not text.filter(~F.coalesce(F.ltrim(given).startswith("["), F.lit(False))).isEmpty():
        raise ValueError(f"criteria in {path} are not a list")
    kind = f"array<struct<{CRITERION.replace(' ', ':').replace(',:', ',')}>>"
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.criterios"), kind), F.from_json("value", kind))
    return text.select(F.explode(listed).alias("c")).select("c.*").filter(F.col("codigo").isNotNull())


def axis_weights(spark: SparkSession, path: str) -> dict[str, float] | None:
    """The axes' weights of a criteria file, ``eixos_imga`` with ``peso_eixo`` in percent (none counts as 0); None if it names no axis."""
    kind = "map<string,struct<peso_eixo:double>>"
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.eixos_imga"), kind)).alias("eixo", "e"))
    return {r["eixo"]: (r["peso"] or 0.0) / 100 for r in found.select("eixo", F.col("e.peso_eixo").alias("peso")).collect()} or None  # of the file's size


def lexicon(spark: SparkSession, path: str) -> dict[str, tuple[list[str], list[str], list[str]]]:
    """The maturity lexicon of a JSON file, categories of an axis joined."""
    kind = "array<struct<axis_id:string,axis_name:string,categories:array<struct<category_id:string,terms:array<string>,expressions:array<string>,subsignals:array<string>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("a")).select("a.axis_id", "a.categories").collect()
    join = lambda r, k: [s for c in r["categories"] for s in c[k] or []]
    return {r["axis_id"]: (join(r, "terms"), join(r, "expressions"), join(r, "subsignals")) for r in rows}


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The agency registry of a JSON file: an object by acronym."""
    kind = "map<string,struct<link:string,possui_atas:boolean,possui_repositorio:boolean,link_repo:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("sigla", "r"))
    return rows.select("sigla", "r.*")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; a missing file is an empty frame, rows that do not parse have nulls."""
    try:
        return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("mode", "PERMISSIVE").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def names(spark: SparkSession, path: str) -> DataFrame:
    """(nome, sigla) of a JSON file: an object of acronyms by name, of any size."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("nome", "sigla"))
    return rows.filter("sigla is not null")


#: How dates are written in tables that people have typed.
DATES = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy")


def heading(name: str) -> str:
    """A column's heading on one line."""
    return re.sub(r"\s+", " ", name).strip()


def typed_csv(spark: SparkSession, path: str, kinds: dict[str, str], dates: tuple[str, ...] = DATES) -> DataFrame:
    """A CSV as people leave it: the columns of ``kinds`` by type, ``bruto`` (a map of all cells as they are) and ``motivo``.

    Headings over several lines are named on one, and rows that repeat the headings are dropped. ``kinds`` gives a type by heading: string, date (by the first
    of ``dates`` that fits), long, double or decimal(p,s), numbers with a point or as 1.234,56. A cell that is not empty and does not fit its type is null,
    and motivo says which columns these are; so it does for a row of too few or too many cells, which keeps those it has. A missing file is an
    empty frame, a heading of ``kinds`` that the file lacks an error.
    """
    base = lambda: spark.read.option("multiLine", "true").option("quote", '"').option("escape", '"')
    try:
        top = base().option("header", "true").csv(path).columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", bruto map<string,string>, motivo string")
    found = [heading(c) for c in top]
    if lacking := [k for k in kinds if k not in found]:
        raise ValueError(f"{path} has no column {lacking}")
    schema = ", ".join(f"c{i} string" for i in range(len(top))) + ", odd string"
    rows = base().option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "odd").schema(schema).csv(path)
    clean = lambda i: F.nullif(F.trim(F.regexp_replace(F.coalesce(f"c{i}", F.lit("")), r"\s+", " ")), F.lit(""))
    same = reduce(and_, [clean(i).eqNullSafe(F.lit(c or None)) for i, c in enumerate(found)])
    rows = rows.filter(~same)

    def number(c: Column) -> Column:
        """A number in plain notation: with a comma, points are between thousands."""
        return F.when(F.contains(c, F.lit(",")), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c)

    def value(c: Column, kind: str) -> Column:
        if kind == "string":
            return c
        if kind == "date":
            return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in dates])
        return number(c).try_cast(kind)

    cells = {k: clean(found.index(k)) for k in kinds}
    values = {k: value(cells[k], t) for k, t in kinds.items()}
    bad = F.array_compact(F.array(F.when(F.col("odd").isNotNull(), F.lit("number of cells")), *[F.when(cells[k].isNotNull() & values[k].isNull(), F.lit(k)) for k in kinds]))
    raw = F.map_from_arrays(F.array(*[F.lit(f"{i + 1}: {c}") for i, c in enumerate(found)]), F.array(*[F.col(f"c{i}") for i in range(len(found))]))
    return rows.select(*[v.alias(k) for k, v in values.items()], raw.alias("bruto"), F.nullif(F.array_join(bad, ", "), F.lit("")).alias("motivo"))


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document; missing or broken gives an empty frame."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)

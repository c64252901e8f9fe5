"""A versioned index: keyed upserts by segments and tombstones, published by one rename.

A store is a folder of segments and manifests. A segment holds what one batch has added (documents, chunks, postings, vectors), which live
documents it has dropped, and by how much it changes the frequency of each term. A manifest names the live segments and the batches that have
gone in; it is renamed into place last, under the next number, which fails if another writer was first. So a reader sees a
whole version or the one before, a failed build changes nothing, and a batch that is repeated is known by its number. Files of
old versions stay until ``drop_old``, and searches that began before go on reading them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import chunking, search
from ..streaming import ingest

#: Share of dropped documents from which a store is worth compacting.
STALE = 0.25
#: Repeated ids that may be sent to all tasks.
MOST_REPEATED = 200_000


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Files:
    """The few file operations a store needs, on whatever file system its folder is."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one of this name."""
        draft, place = self.at(f"drafts/{uuid.uuid4().hex}"), self.at(name)
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.mkdirs(place.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(draft, place, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # py4j wraps what the JVM throws
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def last_of(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of rows with one key the last by ``order`` (ties: the greatest row), without that column; null keys are left out.

    Without an order the greatest row by its values is taken: always the same, if not the last. Ids are counted first: whole rows are
    shuffled only where their ids are repeated, or if very many are.
    """
    columns = [c for c in rows.columns if c != order]
    whole = F.struct(*columns).alias("whole")
    rank = F.struct(*([F.col(order)] if order else []), whole)
    rows = rows.filter(F.col(key).isNotNull())
    last = lambda x: x.groupBy(key).agg(F.max(rank).alias("last")).select("last.whole.*")
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    n = repeated.limit(MOST_REPEATED + 1).count()
    if not n:
        return rows.select(*columns)
    if n > MOST_REPEATED:
        return last(rows)
    repeated = F.broadcast(repeated)
    return rows.join(repeated, key, "left_anti").select(*columns).unionByName(last(rows.join(repeated, key, "left_semi")))


class Store:
    """An index of documents (document_id, orgao, tipo_documento, text) that is kept up to date by keys."""

    def __init__(self, spark: SparkSession, folder: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, dimensions: int = K.DIMENSIONS, embed: Callable[[Column, int], Column] | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.size, self.overlap, self.dimensions, self.embed = size, overlap, dimensions, embed or search.embedding
        self.files = Files(spark, self.folder)

    # What there is.

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one if none is named; an empty one before the first."""
        n = self.version() if version is None else version
        return json.loads(self.files.read(f"manifests/{n:020d}.json")) if n else {"version": 0, "segments": [], "batches": {}}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The live rows of documents, chunks or vectors."""
        rows = self._live(name, self.manifest(version)["segments"]).drop("segment")
        return search.shown(rows) if name == "chunks" else rows

    def _rows(self, name: str, segments: list[dict]) -> DataFrame:
        if not segments:
            raise ValueError("the store has no version yet")
        return self.spark.read.parquet(*[f"{self.folder}/segments/{s['id']}/{name}" for s in segments])

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        rows = self._rows(name, segments)
        if len(segments) == 1 or not any(s["dropped"] for s in segments):
            return rows
        gone = self._gone(segments)
        return rows.join(gone, (rows["document_id"] == gone["gone_id"]) & (rows["segment"] < gone["gone_at"]), "left_anti")

    def posting_counts(self, version: int | None = None) -> DataFrame:
        """(term, df, cf) counted from the live postings; blocks without dropped chunks are counted as they are."""
        segments = self.manifest(version)["segments"]
        if not any(s["dropped"] for s in segments):
            return search.block_counts(self._rows("postings", segments))
        return self.read(version).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def _gone(self, segments: list[dict]) -> DataFrame:
        """(gone_id, gone_at): dropped documents with the last segment that dropped them. Sent to all tasks if they are few."""
        dropped = self.spark.read.parquet(*[f"{self.folder}/segments/{s['id']}/dropped" for s in segments if s["dropped"]])
        last = dropped.groupBy(F.col("document_id").alias("gone_id")).agg(F.max("segment").alias("gone_at"))
        return F.broadcast(last) if sum(s["dropped"] for s in segments) <= search.MOST_QUESTIONS else last

    def term_stats(self, version: int | None = None) -> DataFrame:
        """(term, df, cf): chunks that hold a term and its occurrences, from the segments' changes."""
        rows = self.spark.read.parquet(*[f"{self.folder}/segments/{s['id']}/term_delta" for s in self.manifest(version)["segments"]])
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def corpus_stats(self, version: int | None = None) -> DataFrame:
        """One row: live chunks and their mean length in tokens, from the manifest."""
        segments = self.manifest(version)["segments"]
        n, tokens = (sum(s[k] for s in segments) for k in ("chunk_delta", "token_delta"))
        return self.spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")

    def read(self, version: int | None = None) -> search.Index:
        """The index of a version, for ``search``. It does not change with later versions."""
        n = self.version() if version is None else version
        of = self.manifest(n)
        segments = of["segments"]
        if of["dimensions"] != self.dimensions or of["embedder"] != self._embedder():
            raise ValueError(f"the index has vectors of {of['dimensions']} dimensions by {of['embedder']}")
        postings = search.stored_postings(self._rows("postings", segments), self._live("chunks", segments), "segment")
        return search.Index(self.table("chunks", n), postings, self.corpus_stats(n), self.table("vectors", n).drop("document_id"), self.dimensions, self.embed)

    def _embedder(self) -> str:
        return getattr(self.embed, "name", None) or self.embed.__name__

    # Changes.

    def upsert(self, docs: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Add documents or replace those of the same document_id; returns the version there is then.

        Of rows with one id the last by ``order`` counts. ``batch`` is (source, number): if the source's batches have gone in up to
        that number, nothing is done.
        """
        return self._write(last_of(docs, "document_id", order), batch, keep=True)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Drop the documents of (document_id); ids that there are not do no harm."""
        empty = ids.limit(0).select(F.lit("").alias("document_id"), *[F.lit(None).cast("string").alias(c) for c in ("orgao", "tipo_documento", "text")])
        return self._write(empty, batch, keep=True, dropped=ids.select("document_id").distinct())

    def rebuild(self, docs: DataFrame, order: str | None = None) -> int:
        """A version of these documents alone, as if the store were new; batches that have gone in stay known."""
        return self._write(last_of(docs, "document_id", order), None, keep=False)

    def compact(self) -> int:
        """The same documents in one segment, without what has been dropped."""
        return self._write(self.table("documents"), None, keep=False)

    def stale(self) -> bool:
        """Whether compacting is worth it: dropped documents are more than a share of those written."""
        segments = self.manifest()["segments"]
        return sum(s["dropped"] for s in segments) > STALE * sum(s["documents"] for s in segments)

    def _write(self, docs: DataFrame, batch: tuple[str, int] | None, keep: bool, dropped: DataFrame | None = None) -> int:
        was = self.manifest()
        if batch and was["batches"].get(batch[0], -1) >= batch[1]:
            return was["version"]
        number, segment = was["version"] + 1, uuid.uuid4().hex
        at = lambda k: f"{self.folder}/segments/{segment}/{k}"
        put = lambda rows, k: rows.withColumn("segment", F.lit(number)).write.option("compression", "zstd").parquet(at(k))
        get = lambda k: self.spark.read.parquet(at(k))
        put(docs.select("document_id", "orgao", "tipo_documento", "text"), "documents")
        docs = get("documents")
        put(search.numbered(chunking.chunks(docs.drop("segment"), self.size, self.overlap)), "chunks")
        chunks = get("chunks").drop("segment")
        live = self.table("documents", was["version"]).select("document_id") if keep and was["segments"] else docs.limit(0).select("document_id")
        put(live.join(docs.select("document_id") if dropped is None else dropped, "document_id", "left_semi"), "dropped")
        gone = get("dropped").select("document_id")
        search.write_postings(search.posting_blocks(chunks).withColumn("segment", F.lit(number)), at("postings"))
        put(search.vectors(chunks, self.dimensions, "document_id", embed=self.embed), "vectors")
        # Terms that go are those of the dropped documents' chunks, cut into tokens once more; postings of other documents are not read.
        new = search.block_counts(get("postings"))
        counted = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        n_gone, added = gone.count(), counted(chunks)
        sizes = {"chunk_delta": added["n"], "token_delta": added["t"]}
        if n_gone:
            old = self._live("chunks", was["segments"]).join(search.small(gone), "document_id", "left_semi")
            lost = counted(old)
            sizes = {"chunk_delta": sizes["chunk_delta"] - lost["n"], "token_delta": sizes["token_delta"] - lost["t"]}
            less = search.block_counts(search.posting_blocks(old)).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
            new = new.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 or cf <> 0")
        put(new, "term_delta")
        entry = {"id": segment, "number": number, "documents": docs.count(), "dropped": n_gone, **sizes}
        now = {
            "version": number,
            "segments": [*(was["segments"] if keep else []), entry],
            "batches": was["batches"] | ({batch[0]: batch[1]} if batch else {}),
            "dimensions": self.dimensions,
            "embedder": self._embedder(),
            "size": self.size,
            "overlap": self.overlap,
        }
        if was["segments"] and any(was[k] != now[k] for k in ("dimensions", "embedder", "size", "overlap")) and keep:
            raise ValueError("the store was made with other chunks or vectors; rebuild it")
        if not self.files.publish(f"manifests/{number:020d}.json", json.dumps(now)):
            raise Conflict(f"version {number} has been published by another writer")
        return number

    def drop_old(self, keep: int = 2) -> list[int]:
        """Drop all but the last ``keep`` versions and the segments that none of these has; returns the versions dropped.

        Segments that no manifest names, as a failed build leaves them, go too, but for those that may still be written: of the
        running process nothing is known, so call this when no build runs.
        """
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        kept, old = names[-max(keep, 1) :], names[: -max(keep, 1)]
        live = {s["id"] for n in kept for s in json.loads(self.files.read(f"manifests/{n}"))["segments"]}
        for n in old:
            self.files.drop(f"manifests/{n}")
        for s in self.files.names("segments"):
            if s not in live:
                self.files.drop(f"segments/{s}")
        return [int(n.removesuffix(".json")) for n in old]

    def clear(self) -> list[int]:
        """Drop every version and all files; returns the versions dropped. Searches that are under way fail."""
        old = [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json")]
        for name in ("manifests", "segments", "drafts"):
            self.files.drop(name)
        return old

    # Streams.

    def feed(self, stream: DataFrame, source: str, checkpoint: str, rows: Callable[[DataFrame], DataFrame] | None = None, order: str | None = None) -> int:
        """Upsert what has arrived on a stream, a version a batch, then stop; returns the version there is then.

        ``rows`` makes documents of a batch. A batch that Spark repeats after a failure is known by its number and does nothing, so each
        file goes in once, whether it failed before or after its version was published.
        """

        def work(batch: DataFrame, number: int) -> None:
            self.upsert(rows(batch) if rows else batch, order, (source, number))

        ingest.run_once(stream, work, checkpoint)
        return self.version()

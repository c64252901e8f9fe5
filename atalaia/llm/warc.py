"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records; then a skippable frame with
the record index (record id to frame and offset inside the frame), then the skippable frame of the
seekable format: sizes of all frames and a footer. A plain Zstandard reader sees the records alone; a
seeking one reads the footer, the index and a single frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, new_folder, prepare

#: Magic numbers of the seekable Zstandard format: its table's frame, its footer, and a free skippable frame.
TABLE_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Bytes of records at which a frame, and at which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 30
#: Payloads below this size are always kept whole. Equal rows that are written together.
LEAST, SLICE = 1000, 500
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Appends records to a bundle."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.open, self.size, self.written = [], 0, 0

    def add(self, record_id: bytes, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size))
        self.open.append(record)
        self.size += len(record)
        self.written += len(record)
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            packed = self.pack(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self._close_frame()
        index = self.pack(b"".join(struct.pack("<16sIQ", *x) for x in sorted(self.index)))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        frames = [*self.frames, (len(index) + 8, 0)]  # the table lists every frame before it
        table = b"".join(struct.pack("<II", *x) for x in frames)
        footer = struct.pack("<IBI", len(frames), 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


class Bundle:
    """Random access to a bundle."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        table = file.read_at(8 * n, size - 9 - 8 * n)
        sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts, at = [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.sizes = sizes
        self.unpack = zstandard.ZstdDecompressor().decompress
        raw = self.unpack(file.read_at(sizes[-1][0] - 8, self.starts[-1] + 8))
        self.index = [struct.unpack_from("<16sIQ", raw, i) for i in range(0, len(raw), 28)]

    def frame(self, i: int) -> bytes:
        return self.unpack(self.file.read_at(self.sizes[i][0], self.starts[i]), max_output_size=self.sizes[i][1])

    def all(self) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
        """(record id, headers, block) of every record in the index, cut out at its offset; each frame is unpacked once."""
        open_, data = -1, b""
        for rid, frame, offset in sorted(self.index, key=lambda x: x[1:]):
            if frame != open_:
                open_, data = frame, self.frame(frame)
            _, headers, block = next(records(data, offset))
            yield rid, headers, block

    def get(self, record_id: bytes) -> bytes | None:
        """The record of an id, None if the bundle has none."""
        i = bisect_left(self.index, (record_id,))
        if i == len(self.index) or self.index[i][0] != record_id:
            return None
        _, frame, offset = self.index[i]
        return next(records(self.frame(frame), offset))[0]


def records(data: bytes, at: int = 0) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(record, headers, block) of concatenated WARC records, from the one at an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(headers["Content-Length"])
        yield data[at : stop + 4], headers, data[end + 4 : stop]
        at = stop + 4


def record_id(page_id: int | None, digest: str, url: str | None = None) -> bytes:
    """16 bytes from the page's id, payload and url: the id of one of the equal rows."""
    return uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id} {digest} {url}").bytes


def copy_id(bundle: str, place: int) -> bytes:
    """16 bytes from the bundle's name and the record's place in it: the id of all other equal rows."""
    return uuid.uuid5(uuid.NAMESPACE_OID, f"bundle {bundle} {place}").bytes


def record(rid: bytes, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: bytes | None, date: str) -> bytes:
    """A response record, or a revisit record without block if ``refers_to``, the id of a record, is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = b"" if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=rid)}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.UUID(bytes=refers_to)}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of (page_id, url, html) as bundles below ``folder``; returns (uri, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, those with the greatest page_id are responses
    and the others revisit it (of several such rows the one of greatest url); null html counts as an empty payload, null url as about:blank. Rows of a
    repeated page_id each get a record; among payloads that only null ids have, all are responses. Other
    columns are not read. A task that is run again writes new files; the rows returned, which are
    checkpointed, name those that count.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # What is decided needs no payloads; they are dealt once, by page, url and digest, so that no digest gathers them.
    keys = ["page_id", "url", "digest"]
    light = cut(rows.select(*keys, (F.octet_length("payload") >= least).alias("large")).groupBy(*keys, "large").agg(F.count(F.lit(1)).alias("n")))
    best = F.max(F.struct("page_id", F.col("url").isNotNull().alias("named"), "url")).alias("keeper")
    many = cut(light.filter("large and page_id is not null").groupBy("digest").agg(best).select(F.col("digest").alias("of"), "keeper"))
    other = ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    known = light.join(many, F.col("large") & (F.col("digest") == F.col("of")), "left").drop("of")
    told = known.select(*keys, "n", F.when(other & F.col("keeper").isNotNull(), F.col("keeper.page_id")).alias("refers"), F.col("keeper.url").alias("refers_url"))
    told = cut(told.filter("refers is not null or n > 1"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    joined = rows.alias("r").join(told.alias("t"), same, "left").select("r.*", F.coalesce("t.n", F.lit(1)).alias("n"), "t.refers", "t.refers_url")
    single = joined.filter("n = 1").withColumn("at", F.lit(0).cast("long"))
    if not told.filter("n > 1").isEmpty():  # of equal rows one is taken with their number, and slices of it are written wherever they fall
        one = joined.filter("n > 1").groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("payload", "n", "refers", "refers_url")])
        slices = one.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))))
        single = single.unionByName(slices.repartition(*keys, "at").withColumn("n", F.least(F.lit(SLICE), F.col("n") - F.col("at"))))

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        store, root = fs.FileSystem.from_uri(folder)
        writer = uri = None

        def close() -> dict:
            writer.close()
            return {"uri": [uri], "records": [len(writer.index)], "bytes": [writer.written]}

        for b in batches:
            for page_id, url, payload, digest, refers, refers_url, n, at in zip(*(b[c] for c in columns), strict=True):
                to = None if refers is None else record_id(refers, digest, refers_url)
                for i in range(n):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                        uri, writer = f"{folder}/{name}", BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                    # One of equal rows has the id that revisits name, whatever task it is in.
                    rid = copy_id(name, len(writer.index)) if at or i else record_id(page_id, digest, url)
                    writer.add(rid, record(rid, page_id, url, payload, digest, to, date))
                    if writer.written >= BUNDLE_BYTES:
                        yield close()
                        writer = None
        if writer:
            yield close()

    columns = ["page_id", "url", "payload", "digest", "refers", "refers_url", "n", "at"]
    return cut(mapped(single.select(*columns), work, "uri string, records long, bytes long"))


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles named in ``uri``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Records are cut out by the bundles' record indexes. For responses size and digest are taken from the payload itself, for
    revisits from their headers; the page that a revisit refers to is that of the response with the record id which it names.
    """

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            for uri in b["uri"]:
                store, path = fs.FileSystem.from_uri(uri)
                out: dict[str, list] = {k: [] for k in names}
                for rid, h, block in Bundle(store.open_input_file(path)).all():
                    if h["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                    else:
                        size, digest, refers = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), uuid.UUID(h["WARC-Refers-To"].strip("<>")).bytes
                    page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                    for k, v in zip(names, (page, h["WARC-Target-URI"], size, digest, h["WARC-Type"], rid, refers), strict=True):
                        out[k].append(v)
                    if len(out["page_id"]) >= 2000:
                        yield out
                        out = {k: [] for k in names}
                yield out

    prepare(bundles.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id binary, refers binary"
    names = [x.split()[0] for x in schema.split(", ")]
    n = max(1, bundles.count())
    rows = cut(mapped(bundles.select("uri").repartition(n), work, schema))
    target = cut(rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers"]))
    revisits = rows.filter("record_type = 'revisit'").join(target, "refers", "left")
    return rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits).drop("refers", "record_id")


def write_and_read(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """write() to a new folder in the shared place, then read()."""
    return read(write(pages, new_folder(pages.sparkSession, "warc"), least))

"""Token ids as raw binary shards, with a minimal perfect hash from document keys to places.

A shard has two files. ``.ids`` is the ids alone, little-endian, 2 bytes each if the vocabulary allows.
``.idx`` is an .npz-like sequence of named little-endian arrays: the hash's levels (bit sets with ranks), and
by hash slot the start, length and a 32-bit fingerprint of the key, so that a key that is not in the shard
is told apart. A lookup costs a few hash probes and one read, whatever the number of documents.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Parts, cut, gathered, in_ranges, library_tokenizer, mapped, new_folder, prepare

#: Hash bits for each key at a level, and the levels after which the few keys left are kept in a list.
GAMMA, LEVELS = 1.6, 40
END_ID = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def keys_of(doc_ids: np.ndarray, nth: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """64-bit keys of documents: the id, how many rows with that id came before, and whether the id is null."""
    return _mixed(_mixed(doc_ids.astype(np.int64).view(np.uint64)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + missing.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key takes the first level where it alone has its bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks, below = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(below + np.cumsum(ones) - ones)
            below += int(ones.sum())
        self.below = below

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return _mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while left.size and len(levels) < LEVELS:
            n = max(1, int(left.size * GAMMA) // 64 + 1)
            at = cls._place(left, len(levels), n)
            order = np.argsort(at, kind="stable")
            s = at[order]
            alone = np.r_[True, s[1:] != s[:-1]] & np.r_[s[1:] != s[:-1], True]
            words = np.zeros(n, np.uint64)
            np.bitwise_or.at(words, (s[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s[alone] & np.uint64(63)))
            levels.append(words)
            left = left[np.sort(order[~alone])]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has its bit; keys that were not built on may get any slot."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = self._place(keys[todo], level, len(words))
            w, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[w] >> bit & np.uint64(1)).astype(bool)
            w, bit = w[hit], bit[hit]
            out[todo[hit]] = self.ranks[level][w] + np.bitwise_count(words[w] & ((np.uint64(1) << bit) - np.uint64(1)))
            todo = todo[~hit]
        if self.rest.size and todo.size:
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), self.rest.size - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.below + at[hit]
        return out


def index_bytes(doc_ids: np.ndarray, missing: np.ndarray, nth: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """The .idx file of documents in payload order."""
    keys = keys_of(doc_ids, nth, missing)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two document keys share a 64-bit hash")
    h = PerfectHash.build(keys)
    slot = h.slots(keys)
    start, length, mark = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
    start[slot], length[slot], mark[slot] = np.cumsum(lengths) - lengths, lengths, (keys >> np.uint64(32)).astype(np.uint32)
    out = io.BytesIO()
    np.savez(out, width=np.array([width]), doc_id=doc_ids, missing=missing, nth=nth, start=start, length=length, mark=mark, rest=h.rest, **{f"level{i}": x for i, x in enumerate(h.levels)})
    return out.getvalue()


class Shard:
    """Keyed access to a shard by the URI without suffix."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(uri)
        with self.store.open_input_stream(f"{self.path}.idx") as f:
            z = np.load(io.BytesIO(f.read()))
            x = self.arrays = {k: z[k] for k in z.files}
        self.width = int(x["width"][0])
        self.hash = PerfectHash([x[f"level{i}"] for i in range(sum(k.startswith("level") for k in x))], x["rest"])
        self.ids = self.store.open_input_file(f"{self.path}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids; -1 and 0 for keys whose fingerprint is not in the shard."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.arrays["mark"][slot[known]] == (keys[known] >> np.uint64(32)).astype(np.uint32)
        start, length = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        start[known], length[known] = self.arrays["start"][slot[known]], self.arrays["length"][slot[known]]
        return start, length

    def read(self, start: int, length: int) -> np.ndarray:
        return np.frombuffer(self.ids.read_at(length * self.width, start * self.width), f"<u{self.width}")

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of one document, None if the shard has no such key."""
        (start,), (length,) = self.find(keys_of(np.array([doc_id or 0]), np.array([nth]), np.array([doc_id is None])))
        return None if start < 0 else self.read(int(start), int(length))


class Encoder:
    """The tokenizers library, asked once for each word that the cache does not know."""

    def __init__(self, path: str | None, cached: int = 600_000, ordinary: bool = False) -> None:
        """``ordinary``: the strings of special tokens are plain text."""
        self.lib = library_tokenizer(path, ordinary)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token; its letters stand for bytes
        for t, i in vocab.items():
            self.length[i] = len(t)
        special = [] if ordinary else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.encode = Parts(lambda x: self._joined(x, ""), self._inner, self._alone, special, self.kind, cached).encode

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.int64) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(x) for x in ids], np.int64)

    def _inner(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Strings without a blank before, none with white space but the line feed alone and the empty one."""
        usual = [i for i, p in enumerate(strings) if p and p != "\n"]
        rest = [i for i, p in enumerate(strings) if not p or p == "\n"]
        ids, size = self._joined([strings[i] for i in usual], "\n") if usual else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        more, sizes = self._alone([strings[i] for i in rest])
        order = np.argsort(np.array(usual + rest), kind="stable")
        size = np.r_[size, sizes]
        return gathered(np.r_[ids, more], (np.cumsum(size) - size)[order], size[order]), size[order]

    def _joined(self, strings: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """The library gets the strings run together, each the start of a pretoken; its ids are told apart by the tokens' sizes.

        A line feed between two that are not white space is a pretoken of its own.
        """
        found, sizes = [], []
        for i in range(0, len(strings), 5000):
            some = strings[i : i + 5000]
            ids = np.array(self.lib.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, np.int64)
            size = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in some), np.int64, len(some)) + len(between)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size) - len(between)) + 1
            ends[-1] = len(ids)
            starts = np.r_[0, ends[:-1] + len(between)]
            keep = np.ones(len(ids), bool)
            if between:
                keep[ends[:-1]] = False
            found.append(ids[keep]), sizes.append(ends - starts)
        return np.concatenate(found), np.concatenate(sizes)


@lru_cache(2)
def shared_encoder(path: str | None, ordinary: bool = False) -> Encoder:
    """One encoder for all tasks that a worker process runs, so that what it learned is kept."""
    return Encoder(path, ordinary=ordinary)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write (doc_id, text) as shards below ``folder`` in ascending doc_id order; returns (shard, uri, docs, tokens).

    Nulls come first; rows with the same id stand by a hash of their text. Null text counts as empty: its
    document is the end id alone. Other columns are not read. Documents are dealt by ranges of that order, one
    to a task, so shards in order of their numbers hold the corpus in order. A task that is run again writes new
    files; the rows returned, which are checkpointed, name those that count. No rows, no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, n = in_ranges(rows.withColumn("tie", F.xxhash64("text")), "shard")
    dealt = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        at = out = None
        seen: list[pa.Array] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            out.close()
            known = pa.chunked_array(seen)
            missing, ids = known.is_null().to_numpy(), known.fill_null(0).to_numpy()
            lengths = np.concatenate(counts)
            first = np.r_[True, (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])]
            place = np.arange(len(ids))
            nth = place - np.maximum.accumulate(np.where(first, place, 0))
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(index_bytes(ids, missing, nth, lengths, enc.width))
            return pa.RecordBatch.from_pydict({"shard": [at], "uri": [f"{folder}/{name}"], "docs": [len(ids)], "tokens": [int(lengths.sum())]}, schema=kind)

        for b in batches:
            if not b.num_rows:
                continue
            ids, lengths = enc.encode(b.column(2))
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            shard, ends = b.column(0).to_numpy(), np.r_[0, np.cumsum(lengths)]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if shard[i] != at:
                    if out:
                        yield close()
                    at, name, seen, counts = int(shard[i]), f"shard-{shard[i]:05d}-{uuid.uuid4().hex}", [], []
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.ids")
                out.write(ids[ends[i] : ends[j]].tobytes())
                seen.append(b.column(1).slice(i, j - i))
                counts.append(lengths[i:j])
        if out:
            yield close()

    kind = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    return cut(dealt.select("shard", "doc_id", "text").mapInArrow(work, "shard int, uri string, docs long, tokens long"))


def read(spark, shards: DataFrame) -> DataFrame:
    """Every document of write()'s shards, read back through their index: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over 4-byte little-endian ids.
    """
    prepare(spark)
    listed = sorted((r["shard"], r["uri"], r["tokens"]) for r in shards.collect())  # a row for each shard
    base = np.cumsum([0, *(t for _, _, t in listed)]).tolist()
    rows = [(uri, b) for (_, uri, _), b in zip(listed, base, strict=False)]
    places = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            for uri, before in zip(b["uri"], b["base"], strict=True):
                s = Shard(uri)
                x = s.arrays
                for i in range(0, len(x["doc_id"]), 2000):
                    ids, missing, nth = (x[k][i : i + 2000] for k in ("doc_id", "missing", "nth"))
                    start, length = s.find(keys_of(ids, nth, missing))
                    a, z = int(start[0]), int(start[-1] + length[-1])
                    block = s.read(a, z - a).astype("<u4")
                    crc = [zlib.crc32(block[p - a : p - a + n]) for p, n in zip(start.tolist(), length.tolist(), strict=True)]
                    yield {"doc_id": [None if m else d for d, m in zip(ids.tolist(), missing.tolist(), strict=True)], "start": (start + before).tolist(), "n_tokens": length.tolist(), "ids_crc32": crc}

    return mapped(places, work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """write() to a new folder in the shared place, then read()."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_folder(spark, "token-ids"), tokenizer, end_id))

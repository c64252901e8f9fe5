"""Byte-level BPE without running merges: one pass over the prefixes of a pretoken.

For every prefix exactly one last token is possible. An automaton over the vocabulary reports the tokens
that end at each position; the one whose pair with the last token of the prefix before it survives BPE is
stored, and following the stored tokens from the end gives the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRETOKEN, Cache, Parts, prepare, tidied, tokenizer_path


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Decoder:
    """Turns ids of a byte-level BPE file into text."""

    def __init__(self, path: str | None = None) -> None:
        with open(path or tokenizer_path(), encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self._from(spec, {t: bytes(letters[c] for c in t) for t in vocab})

    def _from(self, spec: dict, raw: dict[str, bytes]) -> None:
        vocab, self.added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        by_id = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in vocab.items():
            by_id[i] = raw[t]
        for t, i in self.added.items():
            by_id[i] = t.encode()
        self.raw_size = np.array([len(x) for x in by_id], np.int64)
        self.raw_start, self.raw_bytes = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(by_id), np.uint8)

    def decode_batch(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of several runs of ids, given one after another; special ids stand for their strings."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        data = self.raw_bytes[np.repeat(self.raw_start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.r_[0, ends][np.cumsum(lengths)].tolist() if len(lengths) else []
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special ones included."""
        flat = np.asarray(ids, np.int64)
        return self.decode_batch(flat, np.array([len(flat)]))[0]


class Bpe(Decoder):
    """Encoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str | None = None, cached: int = 600_000) -> None:
        with open(path or tokenizer_path(), encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self._from(spec, raw)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        single = [t for t in vocab if len(raw[t]) == 1]
        # Tokens are numbered in the order in which merges make them; single bytes come first.
        made = single + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(made)}
        self.id = [vocab[t] for t in made]
        self.size = [len(raw[t]) for t in made]
        self.bytes_only = len(single)
        self.parts = [(i, i) for i in range(len(single))] + [(number[a], number[b]) for a, b in merges]
        self.joined = {p: i for i, p in enumerate(self.parts) if i >= len(single)}
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(raw[t].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.fits = Cache(self._fits, 100_000)
        self.cut = regex.compile(PRETOKEN).findall
        runs = lambda x: self._listed([b"".join(map(self._pretoken, [w] if w[1:].isalpha() else self.cut(w))) for w in x])
        self.encode_array = Parts(runs, runs, self._wholes, list(self.added), "<i4", cached).encode

    def _fits(self, pair: int) -> bool:
        """Whether BPE leaves two tokens, as first << 20 | second, apart when it meets their bytes next to each other.

        Merges that made the two are undone, the latest first; whenever the tokens now at the seam have a
        merge of their own that would have come before the one just undone, BPE would have joined them.
        Of equal merges the left one comes first: times are (merge, 0 left, 1 seam, 2 right).
        """
        a, b = pair >> 20, pair & 0xFFFFF
        until = (len(self.id), 0)
        while True:
            seam = self.joined.get((a, b))
            if seam is not None and (seam, 1) < until:
                return False
            if a < self.bytes_only and b < self.bytes_only:
                return True
            if a >= self.bytes_only and (b < self.bytes_only or (a, 0) > (b, 2)):
                until, a = (a, 0), self.parts[a][1]
            else:
                until, b = (b, 2), self.parts[b][0]

    def last_tokens(self, data: str) -> list[int]:
        """For each prefix of ``data`` (a letter a byte), the last token of its encoding; -1 for the empty one."""
        size, fits = self.size, self.fits
        last = [-1] * (len(data) + 1)
        for end, token in self.automaton.iter(data):
            end += 1
            if last[end] < 0:
                before = end - size[token]
                if not before or (last[before] >= 0 and fits[last[before] << 20 | token]):
                    last[end] = token
        return last

    def _pretoken(self, pretoken: str) -> bytes:
        data = pretoken.encode("utf-8").decode("latin-1")
        last, at, back = self.last_tokens(data), len(data), []
        while at:
            back.append(self.id[last[at]])
            at -= self.size[last[at]]
        return np.array(back[::-1], np.int32).tobytes()

    @staticmethod
    def _listed(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(runs), np.int32), np.array([len(x) // 4 for x in runs], np.int64)

    def _wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts cut by the pattern; strings of added tokens are taken out first."""
        known: dict[str, bytes] = {}

        def of(p: str) -> bytes:
            if p not in known:
                known[p] = self._pretoken(p)
            return known[p]

        out = []
        for t in texts:
            parts = self.split.split(t) if self.split else [t]
            out.append(b"".join([np.int32(self.added[x]).tobytes() if i % 2 else b"".join(map(of, self.cut(x))) for i, x in enumerate(parts)]))
        return self._listed(out)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts as the library's encode(text, add_special_tokens=False) has them."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


@lru_cache(2)
def shared_bpe(path: str | None) -> Bpe:
    """One encoder for all tasks that a worker process runs, so that what it learned is kept."""
    return Bpe(path)


@lru_cache(2)
def shared_decoder(path: str | None) -> Decoder:
    return Decoder(path)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids) of (doc_id, text): row by row, no shuffle. Null text counts as empty and gives no ids; other columns are not read."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(tokenizer)
        for b in batches:
            flat, lengths = bpe.encode_array(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(flat, lengths)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(work), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids): the text that the ids stand for. Null ids count as none."""
    prepare(encoded.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_decoder(tokenizer)
        for b in batches:
            ids = b.column(1)
            texts = bpe.decode_batch(ids.flatten().to_numpy().astype(np.int64), ids.value_lengths().fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidied(work), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass: the worker that has encoded a batch decodes its ids too."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(tokenizer)
        for b in batches:
            flat, lengths = bpe.encode_array(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(flat, lengths), pa.array(bpe.decode_batch(flat, lengths), pa.string())], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(work), "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Digest columns of decode()'s or round_trip()'s rows: n_tokens, ids_sha256 over decimal ids joined by commas, decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )

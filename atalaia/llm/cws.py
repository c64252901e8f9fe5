"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-cased words, each weighing 1 + ln(count). For every term and sample slot, two
Gamma(2,1) variates and a uniform one are drawn from the term's hash alone; the term of least sampled
value, with the step its weight was rounded to, is the slot's sample. Two bags agree in a slot with the
probability of their generalised Jaccard similarity (sum of minima over sum of maxima of the weights).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_ranges, mapped, prepare

#: Sample slots of a fingerprint; each is kept as 16 bits, so unlike samples agree once in 65,536.
SLOTS = 128
#: Terms whose variates a worker keeps (SLOTS * 12 bytes each).
CACHED_TERMS = 40_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def gamma_quantiles() -> np.ndarray:
    """The 65,536 quantiles of Gamma(2,1) at the middles of equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    at = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(45):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < at
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.round(high * 2.0**20) / 2.0**20  # alike on every machine


class Sampler:
    """Fingerprints of bags; keeps the variates of terms it has met, up to a bound."""

    def __init__(self, slots: int = SLOTS, cached: int = CACHED_TERMS) -> None:
        self.slots, self.cached = slots, cached
        self.steps = np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.salt = _mixed(self.steps + np.uint64(77))
        quantile = gamma_quantiles()
        self.gamma, self.log_gamma = quantile.astype(np.float32), np.log(quantile).astype(np.float32)
        self.rows: dict[str, int] = {}
        self.hash = np.zeros(cached, np.uint64)
        self.r, self.beta, self.one = (np.zeros((cached, slots), np.float32) for _ in range(3))

    def _draw(self, terms: list[str]) -> None:
        """Put the variates of new terms behind those that are kept: 16 bits of hash for each Gamma one, 32 for the uniform one."""
        n = len(terms)
        new = slice(len(self.rows), len(self.rows) + n)
        digest = xxhash.xxh64_digest
        self.hash[new] = h = np.frombuffer(b"".join([digest(t.encode("utf-8", "surrogatepass")) for t in terms]), "<u8")
        x = _mixed(h[:, None] + self.steps)
        short, r, beta = x.view("<u2").reshape(n, self.slots, 4), self.r[new], self.beta[new]
        np.take(self.gamma, short[:, :, 0], out=r, mode="clip")
        np.multiply(x.view("<u4").reshape(n, self.slots, 2)[:, :, 1], np.float32(2.0**-32 * (1 - 2.0**-23)), out=beta, dtype=np.float32, casting="unsafe")
        np.subtract(self.log_gamma[short[:, :, 1]], r * (1 - beta), out=self.one[new])  # the value at weight 1
        self.rows.update(zip(terms, range(new.start, new.stop), strict=True))

    def _part(self, terms: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least value and 16-bit sample of each slot over some terms."""
        new = [t for t in terms if t not in self.rows]
        if len(self.rows) + len(new) > self.cached:
            self.rows.clear()
            new = terms
        if new:
            self._draw(new)
        at = np.fromiter(map(self.rows.__getitem__, terms), np.int64, len(terms))
        value = self.one[at]
        many = np.flatnonzero(counts > 1)
        step = None
        if many.size:
            r, beta = self.r[at[many]], self.beta[at[many]]
            log_w = np.log1p(np.log(counts[many])).astype(np.float32)[:, None]
            step = np.floor(log_w / r + beta)
            value[many] -= r * step
        won = value.argmin(0)
        t = np.zeros(self.slots, np.uint64)
        if many.size:
            place = np.searchsorted(many, won)
            place[place == many.size] = 0
            t = np.where(many[place] == won, step[place, np.arange(self.slots)], 0).astype(np.uint64)
        sample = _mixed(self.hash[at[won]] + t * np.uint64(0xD6E8FEB86659FD93) + self.salt) >> np.uint64(48)
        return value[won, np.arange(self.slots)], sample

    def fingerprint(self, text: str) -> str:
        """Four hex digits for each slot; a text without words has a fingerprint of its own kind, "" of length 0."""
        bag = Counter(text.lower().split())
        if not bag:
            return ""
        terms, counts = list(bag), np.fromiter(bag.values(), np.float64, len(bag))
        best, out = self._part(terms[: self.cached], counts[: self.cached])
        for i in range(self.cached, len(terms), self.cached):
            value, sample = self._part(terms[i : i + self.cached], counts[i : i + self.cached])
            out, best = np.where(value < best, sample, out), np.minimum(value, best)
        return out.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of the slots that agree: 1 for two texts without words, 0 for one of them."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), ">u2") for v in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, fingerprint) of (doc_id, text): row by row, no shuffle; null text counts as empty."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        s = Sampler(slots)
        for b in batches:
            yield {"doc_id": b["doc_id"], "fingerprint": [s.fingerprint(t or "") for t in b["text"]]}

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def edit_likeness(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Fingerprint each text, the same text edited with the next document's start, and compare.

    Order: doc_id descending, nulls last, rows of one id by a hash of the text; after the last document
    comes the first. Documents are dealt once, by ranges of doc_id; the head of each range is also sent
    to the range before it, so every neighbour is found in one sorted pass over a task's rows. Rows are
    kept as they are, repeated ones too; null text counts as empty; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, n = in_ranges(rows.withColumn("tie", F.xxhash64("text")), "bucket")
    place = F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tie"))
    first = rows.groupBy("bucket").agg(F.max(place).alias("head"))
    heads = sorted(((r["bucket"], *r["head"]) for r in first.collect()), reverse=True)  # a row for each range
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    sent_to = [(bucket, known, doc_id, tie, heads[i - 1][0]) for i, (bucket, known, doc_id, tie) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(sent_to, "h_bucket int, h_known int, h_id long, h_tie long, also int"))  # a row for each range
    same = (F.col("bucket") == F.col("h_bucket")) & (F.coalesce("doc_id", F.lit(0)) == F.col("h_id")) & (F.col("doc_id").isNotNull().cast("int") == F.col("h_known")) & (F.col("tie") == F.col("h_tie"))
    rows = rows.join(table, same, "left")
    own, sent = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("to"), F.lit(1).alias("guest"))
    dealt = rows.select("doc_id", "text", "tie", F.explode(F.filter(F.array(own, sent), lambda x: x["to"].isNotNull())).alias("p")).select("doc_id", "text", "tie", "p.*")
    dealt = dealt.repartitionById(n, "to").sortWithinPartitions("to", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"))

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        s, wait, at = Sampler(slots), None, None  # wait: the document that lacks its next one
        for b in batches:
            out: dict[str, list] = {k: [] for k in NAMES}
            for to, guest, doc_id, text in zip(b["to"], b["guest"], b["doc_id"], b["text"], strict=True):
                if to != at:
                    at, wait = to, None
                if guest and wait is None:
                    continue
                mark = s.fingerprint(text)
                if wait:
                    was, old, old_mark = wait
                    new = edited(old, text)
                    new_mark = s.fingerprint(new)
                    for k, v in zip(NAMES, (was, len(old), hashlib.sha256(new.encode()).hexdigest(), old_mark, new_mark, likeness(old_mark, new_mark), likeness(old_mark, mark)), strict=True):
                        out[k].append(v)
                wait = None if guest else (doc_id, text, mark)
            yield out

    return mapped(dealt.select("to", "guest", "doc_id", "text"), work, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

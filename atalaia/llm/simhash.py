"""SimHash near-duplicates through pivot distance tables.

Fingerprints that differ in at most ``bits`` of 64 agree in at least two of ``bits + 2`` blocks of bits, so
each distinct fingerprint is dealt once for each pair of blocks, by those blocks' values. Within a deal
the distances to many fixed reference fingerprints are tabulated; a pair whose distances to any of them
differ by more than ``bits`` cannot be near (triangle inequality), and what survives is verified. Only
edges that join two parts so far apart are kept, so a group of thousands of copies yields no pair list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, prepare
from .components import components

#: Reference fingerprints: fixed numbers, any would do.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, np.uint64)
#: Members of a deal that are compared in one task; larger deals are split into pairs of parts.
MOST = 8192


def fingerprint(text: str, width: int = 4) -> str:
    """16 hex digits: a bit is 1 if set in over half of the shingles' XXH64 (seed 42).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; shingles are ``width`` words joined by a space,
    repeats counted; fewer words are one shingle; no words give zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return "0" * 16
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, 42).hex()
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False)])
    n = len(hashes) // 8
    total = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        total += np.unpackbits(raw[i : i + 65536], axis=1).sum(0, dtype=np.uint32)
    return np.packbits(total * 2 > n).tobytes().hex()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text), row by row; null text counts as empty."""

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        for b in batches:
            marks = [int(fingerprint(t or "", width), 16) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "fp": [m - (m >> 63 << 64) for m in marks]}

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, fp long")


def linked(fp: np.ndarray, deal: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between near fingerprints of the same deal; rows are sorted by deal. Enough edges to connect all that is near, not all of them.

    Rows are compared with the row 1, 2, 3 ... places further on. What is connected already is not
    compared again, and a lag is passed over rows whose deal reaches that far only.
    """
    size = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1], True])
    end = np.repeat(size[1:], np.diff(size))
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    label, a, b = np.arange(len(fp)), [], []
    live, lag = np.arange(len(fp)), 1
    while True:
        live = live[live + lag < end[live]]
        if not live.size:
            break
        i = live[label[live] != label[live + lag]]
        i = i[np.abs(table[i] - table[i + lag]).max(1, initial=0) <= bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= bits]
        if i.size:
            a.append(i), b.append(i + lag)
            while True:  # hook the greater root to the lesser, then flatten
                x, y = label[i], label[i + lag]
                apart = x != y
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
                while (flat := label[label] != label).any():
                    label[flat] = label[label[flat]]
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``bits`` of each other."""
    blocks = bits + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(blocks)]
    keys = [(F.shiftleft(part[i], 16).bitwiseOR(part[j]) * 64 + n).alias(f"k{n}") for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("deal"))
    large = cut(dealt.groupBy("deal").count().filter(F.col("count") > MOST).select("deal", F.ceil(F.col("count") / MOST).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = dealt.withColumn("pair", F.lit(0))
    else:  # every pair of a large deal's parts meets somewhere, each in a deal of its own
        own = F.pmod(F.xxhash64("fp"), "parts").cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
        dealt = dealt.join(large, "deal", "left").withColumn("pair", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("parts")
    dealt = dealt.repartition("deal", "pair").sortWithinPartitions("deal", "pair")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def edges(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            a, b = linked(fp.view(np.uint64), key, bits)
            return pa.RecordBatch.from_pydict({"a": fp[a], "b": fp[b]})

        def close(upto: int | None) -> pa.RecordBatch:
            fp, deal, pair = (x[:upto] for x in held)
            new = np.r_[True, (deal[1:] != deal[:-1]) | (pair[1:] != pair[:-1])] if len(fp) else np.zeros(0, bool)
            return edges(fp, np.cumsum(new))

        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate(held)]
            last = np.flatnonzero((held[1] != held[1][-1]) | (held[2] != held[2][-1])) if len(held[0]) else []
            if len(last):
                yield close(last[-1] + 1)
                held = [x[last[-1] + 1 :] for x in held]
        yield close(None)

    return dealt.select("fp", "deal", F.col("pair").cast("long")).mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text).

    component_id is the least doc_id reachable over links of at most ``bits`` differing bits. Null text
    counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows
    stay; a null doc_id keeps its row and takes its component's least id (null if it has none). Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    marks = cut(fingerprints(docs, width))
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = cut(components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp"))
    # Tables of their own, so that Spark can split joins in which one label or fingerprint has very many rows.
    nodes = cut(nodes.join(label, "fp", "left"))
    whole = cut(nodes.filter("label is not null").groupBy("label").agg(F.min("least").alias("component_id")))
    of = nodes.filter("label is not null").join(whole, "label").select("fp", "component_id")
    of = cut(of.unionByName(nodes.filter("label is null").select("fp", F.col("least").alias("component_id"))))
    return marks.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

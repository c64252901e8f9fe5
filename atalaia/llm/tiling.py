"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the phrases of five words they share. Each pair that shares one
is tiled: the longest common runs of unmarked words are marked first, found by hashing all unmarked runs of
a search length that falls in steps (running Karp-Rabin). The share of an item's words under tiles is
its coverage; as tiles may stand in any order, a passage that was shuffled is found too.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, prepare, tidied
from .seeds import Seeds, plain_words
from .suffix import Words, runs

#: Words of a seed, which is also the shortest tile, and the coverage from which a document counts as contaminated.
SEED, COVERAGE = 5, 0.6
#: Words of the benchmark up to which it is sent to all tasks as a whole (8 bytes each); beyond, seeds are joined by a shuffle.
MOST_WORDS = 500_000


_RUNNING = Words()


#: Pairs of places that are looked at together.
PAIRS = 1 << 20


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles of two sequences of word hashes."""
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]
    out: list[tuple[int, int, int]] = []
    search = max(least, min(len(item), len(doc)) // 2)

    def unmarked(side: int, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of ``n`` free words, and the running hash of each: one step of a prefix sum a place, whatever ``n`` is."""
        taken = np.cumsum(np.r_[0, ~free[side]])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if len(words) >= n else np.zeros(0, np.int64)
        return at, _RUNNING.phrases(words, n)[at]

    while True:
        (left, key), (right, sought) = unmarked(0, item, search), unmarked(1, doc, search)
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        low, high = np.searchsorted(key, sought, "left"), np.searchsorted(key, sought, "right")
        found: list[tuple[int, int, int]] = []
        longest = 0
        hits = np.flatnonzero(high > low)
        for some in np.split(hits, np.flatnonzero(np.diff(np.cumsum((high - low)[hits]) // PAIRS)) + 1):
            count = (high - low)[some]
            there = np.repeat(right[some], count)
            here = left[np.repeat(low[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            # What continues a match that starts earlier goes, all pairs at once: words repeated many times make very many of them.
            first = ~((here > 0) & (there > 0) & (item[here - 1] == doc[there - 1]) & free[0][here - 1] & free[1][there - 1])
            for i, j in zip(here[first].tolist(), there[first].tolist(), strict=True):
                n = 0  # from the first word on: equal hashes are not taken for equal words
                while i + n < len(item) and j + n < len(doc) and free[0][i + n] and free[1][j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= search:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * search:
            search = longest
            continue
        queue = [(-n, i, j) for n, i, j in found]
        heapify(queue)
        while queue:
            n, i, j = heappop(queue)
            open_ = free[0][i : i - n] & free[1][j : j - n]
            if open_.all():
                free[0][i : i - n] = free[1][j : j - n] = False
                out.append((i, j, -n))
            else:  # what other tiles have left of the match waits for its turn
                for a, z in zip(*runs(open_), strict=True):
                    if z - a >= search:
                        heappush(queue, (int(a - z), i + int(a), j + int(a)))
        if search == least:
            return out
        search = max(least, search // 2)


def coverage(item: np.ndarray, doc: np.ndarray, at: np.ndarray, least: int = SEED) -> tuple[float, int]:
    """Share of ``item`` under tiles, and their number; ``at``: where seeds of the item stand in ``doc``. An item of fewer words is matched whole."""
    least = min(least, len(item))
    near = np.zeros(len(doc) + 1, np.int64)
    np.add.at(near, at, 1)
    np.add.at(near, np.minimum(at + least, len(doc)), -1)
    a, z = runs(np.cumsum(near[:-1]) > 0)
    gap = np.zeros(1, np.uint64)  # no word hashes to it but by chance; a tile across would not be one in the document
    parts = [x for s, e in zip(a, z, strict=True) for x in (doc[s:e], gap)]
    found = tiles(item, np.concatenate(parts), least) if parts else []
    return sum(n for _, _, n in found) / len(item), len(found)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): the benchmark's items, words as hashes; items without words are left out."""

    def work(batches: Iterator[dict]) -> Iterable[dict]:
        w = Words()
        for b in batches:
            words = [w.numbers(plain_words(t or "")).view(np.int64) for t in b["text"]]
            keep = [(i, x) for i, x in zip(b["item_id"], words, strict=True) if len(x)]
            yield {"item_id": [i for i, _ in keep], "words": [x for _, x in keep]}

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    return mapped(rows, work, "item_id long, words array<long>").distinct()


def _best(found: list[tuple[float, int, int]], threshold: float) -> tuple[int | None, float, int, int]:
    """(item, coverage, tiles, items at the threshold) from (coverage, item, tiles) of a document's items."""
    if not found:
        return None, 0.0, 0, 0
    share, item, n = min(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    return item, share, n, sum(x[0] >= threshold for x in found)


_RESULT = "item_id long, coverage double, tiles int, n_items int, contaminated int"


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = SEED) -> DataFrame:
    """One row for each row of (doc_id, text): doc_id, the benchmark item it covers most, and its share.

    Columns: doc_id, item_id (null if no seed is shared; of equal shares the least, nulls last), coverage (of that item's
    words), tiles, n_items (items covered at least to ``threshold``), contaminated (1 if any), rest (a struct of the
    row's other columns, text included). Null text counts as empty and shares nothing; items with fewer
    than ``least`` words are found where they stand as a whole, items without words nowhere; a null item_id is an
    item like others; of items of one id the one of greatest share counts, then of fewest tiles; repeated rows stay.
    """
    prepare(docs.sparkSession)
    items = cut(_items(benchmark))
    size = items.agg(F.sum(F.size("words"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("rest"))
    if size <= MOST_WORDS:
        return _sent(rows, items, threshold, least)
    return _joined(rows, items, threshold, least)


def _sent(rows: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """With the benchmark, whose size was checked, in every task: documents stay where they are."""
    got = sorted(((r["item_id"], r["words"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(([i for i, _ in got], [np.array(x, np.int64).view(np.uint64) for _, x in got])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = pickle.loads(sent.value)
        w = Words()
        by_size = _by_size(texts, least)
        seeds = [(np.array(of), Seeds([texts[i] for i in of], k, w)) for k, of in by_size.items()]
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                doc = w.numbers(plain_words(t or ""))
                found = []
                for of, some in seeds:
                    at, item, _ = some.hits(doc)
                    found += [(*coverage(texts[of[i]], doc, at[item == i], least), ids[of[i]]) for i in np.unique(item).tolist()]
                out.append(_best([(c, i, n) for c, n, i in found], threshold))
            yield _batch(b, out)

    return rows.mapInArrow(tidied(work), _schema(rows))


def _by_size(texts: list[np.ndarray], least: int) -> dict[int, list[int]]:
    """Numbers of the items by the words of their seeds: ``least``, or all words of a shorter item."""
    out: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        out.setdefault(min(least, len(t)), []).append(i)
    return out


def _batch(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    item, share, n, many = zip(*out, strict=True) if out else ((), (), (), ())
    arrays = [b.column(0), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(many, pa.int32()), pa.array([int(x > 0) for x in many], pa.int32()), b.column(2)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "coverage", "tiles", "n_items", "contaminated", "rest"])


def _schema(rows: DataFrame) -> str:
    return f"doc_id long, {_RESULT}, rest {dict(rows.dtypes)['rest']}"


def _joined(rows: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """With a benchmark of any size: seeds are joined by a shuffle, then each pair is tiled on its own."""
    named = rows.withColumn("tie", F.xxhash64("text"))
    w_items = items.withColumn("key", F.xxhash64("item_id", "words"))
    sizes = [r["k"] for r in items.select(F.least(F.size("words"), F.lit(least)).alias("k")).distinct().collect()]  # ``least`` of them at most

    def phrases(batches: Iterator[dict]) -> Iterable[dict]:
        w = Words()
        for b in batches:
            numbers = [w.numbers(plain_words(t or "")) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "tie": b["tie"], "seeds": [np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.phrases(x, k) for k in sizes)])).view(np.int64) for x in numbers]}

    def item_phrases(batches: Iterator[dict]) -> Iterable[dict]:
        w = Words()
        for b in batches:
            yield {"key": b["key"], "seeds": [np.unique(w.phrases(np.array(x, np.int64).view(np.uint64), min(least, len(x)))).view(np.int64) for x in b["words"]]}

    def tile(batches: Iterator[dict]) -> Iterable[dict]:
        w = Words()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "tie", "item_id", "coverage", "tiles")}
            for doc_id, tie, text, item_id, words in zip(b["doc_id"], b["tie"], b["text"], b["item_id"], b["words"], strict=True):
                item, doc = np.array(words, np.int64).view(np.uint64), w.numbers(plain_words(text))
                share, n = coverage(item, doc, Seeds([item], min(least, len(item)), w).hits(doc)[0], least)
                for k, v in zip(out, (doc_id, tie, item_id, share, n), strict=True):
                    out[k].append(v)
            yield out

    left = mapped(named.select("doc_id", "tie", "text"), phrases, "doc_id long, tie long, seeds array<long>").select("doc_id", "tie", F.explode("seeds").alias("seed"))
    right = mapped(w_items.select("key", "words"), item_phrases, "key long, seeds array<long>").select("key", F.explode("seeds").alias("seed"))
    pairs = left.join(right, "seed").select("doc_id", "tie", "key").distinct()
    texts = named.select("doc_id", "tie", "text").dropDuplicates(["doc_id", "tie"])
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"])
    pairs = pairs.join(texts, same(pairs, texts)).select(pairs["doc_id"], pairs["tie"], "text", "key").join(w_items, "key").select("doc_id", "tie", "text", "item_id", "words")
    found = mapped(pairs, tile, "doc_id long, tie long, item_id long, coverage double, tiles int")
    order = F.struct((-F.col("coverage")).alias("c"), F.col("item_id").isNull().alias("last"), F.coalesce("item_id", F.lit(0)).alias("i"), F.col("tiles").alias("t"))
    best = F.min_by(F.struct("item_id", "coverage", "tiles"), order).alias("best")
    best = found.groupBy("doc_id", "tie").agg(best, F.count_if(F.col("coverage") >= threshold).cast("int").alias("n_items"))
    n = F.coalesce(best["n_items"], F.lit(0))
    return named.join(best, same(named, best), "left").select(
        named["doc_id"], "best.item_id", F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("best.tiles", F.lit(0)).alias("tiles"), n.alias("n_items"), (n > 0).cast("int").alias("contaminated"), "rest"
    )

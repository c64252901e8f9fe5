"""Removal of passages of ``window`` words that also stand in a document with a smaller id.

Every window holds a phrase of least hash, its anchor (the first one if several are equal); equal windows hold equal anchors
at equal places. Suffixes that begin at the anchors are enough to find all repeated windows, and those whose
anchor stands in one document only are left out. The suffixes are split into groups by a prefix: the ``phrase`` words of the anchor
and, where such a group has more than GROUP_SUFFIXES suffixes, longer ones (of 30, 45 and all 50 words), for which the suffix begins so
far before the anchor that the windows of a class all hold the prefix. In a group the suffixes are sorted, which with the longest
common prefixes of neighbours is their tree, and so are the words before them, read backwards. A pair of nodes, one of each tree, whose
depths add up to the window or more is a repeat; it is taken as far as the trees go on together. A window that a document has several
times, as in a text of one repeated line, takes part once; its other places follow at the end. Groups by all 50 words need
no tree, as they hold one repeat each, and no memory either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Cache, cut, prepare, tidied

#: Words of a window and of the phrases among which its anchor is chosen.
WINDOW, PHRASE = 50, 10
#: Suffixes up to which a group is held in memory (under 100 words each); greater groups are split by longer prefixes.
GROUP_SUFFIXES = 20_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words and of phrases of words."""

    def __init__(self) -> None:
        self.known = Cache(xxhash.xxh64_digest, 100_000)
        self.up = self.down = np.ones(1, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        return np.frombuffer(b"".join([known[w] for w in words]), np.uint64)

    def phrases(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k consecutive words."""
        n = len(numbers)
        if n < k:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _INVERSE, np.uint64)])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * self.up[:n], out=total[1:])
        return mixed((total[k:] - total[:-k]) * self.down[: n - k + 1])

    def anchors(self, numbers: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window of words, and its place."""
        low, span, reach = self.phrases(numbers, phrase), window - phrase + 1, 1
        at = np.arange(len(low), dtype=np.int32)
        while reach < span:
            step = min(reach, span - reach)
            left = low[:-step] <= low[step:]
            low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
            reach += step
        return low, at

    def fresh(self, numbers: np.ndarray, window: int) -> np.ndarray:
        """Which windows are the first of their words in the document."""
        out = np.zeros(max(0, len(numbers) - window + 1), bool)
        out[np.unique(self.phrases(numbers, window), return_index=True)[1]] = True
        return out

    def prefixes(self, numbers: np.ndarray, window: int, phrase: int, tier: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the prefix that a window's group has in a tier, and the place where the suffix begins."""
        low, at = self.anchors(numbers, window, phrase)
        if not tier:
            return low.view(np.int64), at
        width = widths(window, phrase)[tier]
        before = (at - np.arange(len(at), dtype=np.int32)) // width * width
        at = at - before
        return mixed(self.phrases(numbers, window - width + 1)[at] + before.astype(np.uint64)).view(np.int64), at


def widths(window: int, phrase: int) -> list[int]:
    """By tier, how many of a window's places its group's prefix may begin at; the prefix is by so many words less one shorter than the window."""
    span = window - phrase + 1
    return [span, (span + 1) // 2, (span + 7) // 8, 1]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def subtree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and by place in it how many numbers a row shares with the one before from the start on: a tree of their suffixes."""
    size = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * size}").ravel(), kind="stable") if size else np.arange(len(rows))
    s = rows[order]
    same = s[1:] == s[:-1]
    return order, np.r_[0, np.where(same.all(1), size, same.argmin(1) if size else 0)] if len(s) else np.zeros(0, np.int64)


def nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each row the node of a tree at a depth."""
    order, shared = tree
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeats(group: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which windows also stand in a smaller document: by suffix, and by words before it from 0 on.

    A suffix belongs to a ``group`` and has windows that begin ``first`` to ``last`` words before it; ``right`` are the
    window's size of words from it on, ``left`` those before it, the nearest first. What lies beyond a segment is 0.
    """
    after, before = subtree(np.c_[group.view(np.uint64), right]), subtree(left)
    window, gone = right.shape[1], np.zeros((len(docs), left.shape[1] + 1), bool)
    for n in range(left.shape[1] + 1):
        own = np.flatnonzero((first <= n) & (n <= last))
        if own.size:
            name = nodes(after, 1 + window - n)[own] * (len(docs) + 1) + nodes(before, n)[own]
            node = np.unique(name, return_inverse=True)[1]
            least = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, docs[own])
            gone[own, n] = docs[own] > least[node]
    return gone


def spans_of(segments: list[tuple[int, int, int, int, np.ndarray]], w: Words, window: int, phrase: int, tier: int) -> dict[str, np.ndarray]:
    """(id, tie, a, b) to remove from whole groups of segments (id, tie, start, key, numbers of words)."""
    doc, tie, start, key, words = zip(*segments, strict=True)
    lengths = np.array([len(x) for x in words], np.int64)
    offset = np.cumsum(lengths) - lengths
    # The suffixes of each segment, and how many words before them their windows begin.
    begin, first, last, of = [], [], [], []
    for i, x in enumerate(words):
        at = w.prefixes(x, window, phrase, tier)[1]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        begin.append(at[new]), last.append(at[new] - new), of.append(np.full(len(new), i))
        first.append(at[new] - np.r_[new[1:] - 1, len(at) - 1])
    begin, first, last, of = (np.concatenate(x).astype(np.int64) for x in (begin, first, last, of))
    numbers = np.r_[np.concatenate(words), np.uint64(0)]
    width, end = widths(window, phrase)[tier], lengths[of]

    def matrix(places: np.ndarray) -> np.ndarray:
        return numbers[np.where((places >= 0) & (places < end[:, None]), places + offset[of][:, None], len(numbers) - 1)]

    ids = np.array(doc, np.int64)
    gone = repeats(np.array(key, np.int64)[of], ids[of], first, last, matrix(begin[:, None] + np.arange(window)), matrix(begin[:, None] - np.arange(1, width)))
    # Runs of windows make the spans: ``n`` words before the suffix is one place further back than ``n - 1``.
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    a = np.array(start, np.int64)[of[i]] + begin[i]
    return {"id": ids[of[i]], "tie": np.array(tie, np.int64)[of[i]], "a": a - high + 1, "b": a - low + window}


def _numbers(w: Words, text: str | bytes) -> np.ndarray:
    return w.numbers((text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).split())


def _counted(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct prefixes, and how many suffixes begin with each."""
    new = np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])] if len(at) else np.zeros(0, bool)
    return np.unique(key[new], return_counts=True)


def _marks(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, tie, seq, n, keys, many) of (id, tie, text): a hash of all words, their number, the distinct anchors, the suffixes that begin at each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        for b in batches:
            split = [t.encode("utf-8", "surrogatepass").split() for t in b.column(2).to_pylist()]
            seq = [xxhash.xxh3_128_digest(b" ".join(x)) for x in split]
            numbers = [w.numbers(x) for x in split]
            found = [_counted(*(x[w.fresh(n, window)] for x in w.prefixes(n, window, phrase, 0))) for n in numbers]
            own = [b.column(0), b.column(1), pa.array(seq, pa.binary()), pa.array([len(x) for x in split], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *_lists(found)], ["id", "tie", "seq", "n", "keys", "many"])

    return docs.select("id", "tie", "text").mapInArrow(tidied(work), "id long, tie long, seq binary, n long, keys array<long>, many array<int>")


def _lists(found: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    ends = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*(x[k] for x in found), np.zeros(0, np.int64)]).astype(kind))) for k, kind in enumerate((np.int64, np.int32))]


def _longer(docs: DataFrame, window: int, phrase: int, tier: int) -> DataFrame:
    """(id, tie, keys, many): the distinct prefixes in a tier of windows whose prefix in the tier before is wanted, and the suffixes of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        for b in batches:
            found = []
            for text, wanted in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                numbers = _numbers(w, text)
                some = np.isin(w.prefixes(numbers, window, phrase, tier - 1)[0], wanted.values.to_numpy())
                some &= w.fresh(numbers, window)
                key, at = w.prefixes(numbers, window, phrase, tier)
                found.append(_counted(key[some], at[some]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_lists(found)], ["id", "tie", "keys", "many"])

    return docs.select("id", "tie", "text", "wanted").mapInArrow(tidied(work), "id long, tie long, keys array<long>, many array<int>")


def _segments(docs: DataFrame, window: int, phrase: int, tier: int) -> DataFrame:
    """(id, tie, start, key, words): runs of windows with the same wanted prefix, each window of a document once; in the last tier each window for itself, with a 128-bit hash for words."""
    single = tier == len(widths(window, phrase)) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "tie", "start", "key", "words")}
            for doc_id, tie, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                numbers = w.numbers(words)
                key = w.prefixes(numbers, window, phrase, tier)[0]
                places = np.flatnonzero(np.isin(key, wanted.values.to_numpy()) & w.fresh(numbers, window))
                if not places.size:
                    continue
                new = np.ones(len(places), bool)
                if not single:
                    new[1:] = (np.diff(places) > 1) | (np.diff(key[places]) != 0)
                a, z = places[new], places[np.r_[new[1:], True]] + window
                joined = [b" ".join(words[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                out["words"] += [xxhash.xxh3_128_digest(x) for x in joined] if single else joined
                out["id"] += [doc_id] * len(a)
                out["tie"] += [tie] * len(a)
                out["start"] += a.tolist()
                out["key"] += key[a].tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("words", pa.binary())]))

    return docs.select("id", "tie", "text", "wanted").mapInArrow(tidied(work), "id long, tie long, start long, key long, words binary")


def _grouped_repeats(segments: DataFrame, window: int, phrase: int, tier: int) -> DataFrame:
    """(id, tie, a, b): spans to remove, found in the trees of groups of segments with equal prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= GROUP_SUFFIXES and row[3] != held[-1][3]:
                    yield pa.RecordBatch.from_pydict(spans_of(held, w, window, phrase, tier))
                    held, size = [], 0
                held.append((*row[:4], _numbers(w, row[4])))
                at = w.prefixes(held[-1][4], window, phrase, tier)[1]
                size += 1 + np.count_nonzero(np.diff(at))
        if held:
            yield pa.RecordBatch.from_pydict(spans_of(held, w, window, phrase, tier))

    dealt = segments.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(work), "id long, tie long, a long, b long")


def shared_prefixes(places: DataFrame) -> DataFrame:
    """(id, tie, cold, hot) of (id, tie, keys, many): each document's prefixes that other documents have too, by whether their group fits in memory."""
    each = places.select("id", "tie", F.explode(F.arrays_zip("keys", "many")).alias("x")).select("id", "tie", F.col("x.keys").alias("key"), F.col("x.many").alias("many"))
    groups = cut(each.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("many").alias("all")).filter("lo < hi").select("key", (F.col("all") > GROUP_SUFFIXES).alias("large")))
    lists = [F.collect_set(F.when(x, F.col("key"))).alias(k) for k, x in (("cold", ~F.col("large")), ("hot", F.col("large")))]
    return cut(each.drop("many").join(groups, "key").groupBy("id", "tie").agg(*lists))


def removed_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, tie, spans) for rows of (id, text, tie) of which words are to go; id and text are not null.

    A text that repeats the words of a smaller document as a whole goes without further search, so a group
    of copies takes part once. Of windows with the same words in one document the spans cover the first.
    """
    marks = cut(_marks(docs, window, phrase).filter(F.col("n") >= window))
    first = cut(marks.groupBy("seq").agg(F.min("id").alias("first")))  # a table of its own, so that a skewed join can be split
    known = marks.join(first, "seq")
    spans = known.filter("id > first").select("id", "tie", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    lists = shared_prefixes(cut(known.filter("id = first").select("id", "tie", "keys", "many")))
    last = len(widths(window, phrase)) - 1
    for tier in range(last + 1):
        wanted = lambda name: docs.join(lists.filter(F.size(name) > 0).select("id", "tie", F.col(name).alias("wanted")), ["id", "tie"])  # noqa: B023, E731
        if tier == last:
            both = cut(_segments(wanted("cold").unionByName(wanted("hot")), window, phrase, tier))
            least = cut(both.groupBy("words").agg(F.min("id").alias("least")))
            found = both.join(least, "words").filter("id > least").select("id", "tie", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
        else:
            found = _grouped_repeats(_segments(wanted("cold"), window, phrase, tier), window, phrase, tier)
        spans = spans.unionByName(found)
        if tier == last or lists.filter(F.size("hot") > 0).isEmpty():
            break
        lists = shared_prefixes(cut(_longer(wanted("hot"), window, phrase, tier + 1)))
    return spans.groupBy("id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Remove from each text the words covered by a window whose words also start in a document with a smaller doc_id.

    Returns a row for every row of (doc_id, text): doc_id, text (the kept words joined by a space), n_words, n_removed,
    rest (a struct of the row's columns as they were). Words are ``[^\\x20\\x09-\\x0D]+`` unchanged. Null text counts as empty; a row with
    null doc_id keeps all its words and is no source for others; rows of a repeated doc_id are no source for each
    other. Windows are judged on the input.
    """
    prepare(docs.sparkSession)
    # The id has a name of its own: an alias of the same name is dropped on one side of a join only, and texts would be shuffled twice.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    named = rows.filter("id is not null").withColumn("tie", F.xxhash64("text"))
    spans = removed_spans(named, window, phrase)
    whole = named.join(spans, ["id", "tie"], "left").select("id", "text", "spans", "rest")
    none = rows.filter("id is null").withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")).select("id", "text", "spans", "rest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        for b in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                keep = words
                if spans:
                    hashes = w.phrases(w.numbers(words), window)
                    gone = np.flatnonzero(np.isin(hashes, np.concatenate([hashes[s["a"] : s["b"] - window + 1] for s in spans])))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, gone + window, -1)
                    keep = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                texts.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
                counts.append(len(words))
                removed.append(len(words) - len(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), b.column(3)], ["doc_id", "text", "n_words", "n_removed", "rest"])

    kind = StructType([*StructType.fromDDL("doc_id long, text string, n_words long, n_removed long"), rows.schema["rest"]])
    return whole.unionByName(none).mapInArrow(tidied(work), kind)

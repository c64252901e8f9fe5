"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced character, grouped under frequent forms.

A word is held by its two halves. One edit leaves one half of it whole: as the beginning of the other word or as its end. So
every word is dealt by both its halves to shards, and is sent as a text to be scanned to the (at most four) shards that can
hold a half it begins or ends with. A shard's Aho-Corasick automaton finds its halves in each text; a hit counts at the
beginning (a first half) or the end (a second half) only, and between words whose lengths differ by one at most. What is left of the two
words goes through the same rule: words of one half are kept by the halves of their rest, again and again, until few
are left, which are compared. So a half that very many words share costs no comparison of all of them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, shuffle_partitions

#: A run may lose a character if its hash is divisible by this; least length and occurrences of a word; how much more frequent a form is.
DAMAGE, LENGTH, TIMES, RATIO = 97, 5, 3, 2
#: Distinct words that a task counts before it hands them on, held rows of a shard, and words of a half up to which they are compared at once.
HELD, SHARD, FEW = 200_000, 40_000, 6
#: Rows (held or scanned) of one half from which they are dealt by the halves of their rests.
HOT = 20_000

#: Each byte of Latin-1 as itself, A-Z lowered, or a blank if no run has it.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lowered, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_PLAIN).split()


def damaged(run: bytes, start: int, every: int = DAMAGE) -> bytes:
    """A run without one character if the CRC-32 of it in UTF-8, begun with ``start``, is divisible by ``every``; with 0 none is."""
    if not every:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def counts(docs: DataFrame, least: int = LENGTH, times: int = TIMES, every: int = DAMAGE) -> DataFrame:
    """(word, n) of all words of ``least`` characters and ``times`` occurrences at least. A document's equal runs are damaged alike, so they are counted first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32(b"%s:" % (b"%d" % doc.as_py() if doc.is_valid else b""))
                for run, n in Counter(runs(text.as_py())).items():
                    if len(word := damaged(run, start, every)) >= least:
                        held[word] += n
                        if len(held) >= HELD:
                            yield out()
                            held.clear()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def halves(a: int, b: int, size: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """What is known of a word of ``size`` characters if its first ``a`` and last ``b`` are: more, by the first or the second half of the rest."""
    rest = size - a - b
    return (a + rest // 2, b), (a, b + rest - rest // 2)


def may(a: int, b: int, size: int) -> set[tuple[int, int]]:
    """halves() of the words that one of ``size`` characters may be near to."""
    return {x for n in (size - 1, size, size + 1) if n - a - b > 0 for x in halves(a, b, n) if sum(x) <= size}


def key(word: str, a: int, b: int) -> int:
    """A number for the first ``a`` and the last ``b`` characters."""
    mark = xxhash.xxh64_intdigest(f"{a}:{b}:{word[:a]}\0{word[len(word) - b :]}".encode(), 12)
    return mark - (mark >> 63 << 64)


def one_edit(u: str, v: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = next((i for i, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), len(u))
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def path(u: str, v: str, steps: int) -> tuple[int, int]:
    """The halves of ``u`` by which it meets ``v`` after so many steps: the first half wherever it fits, so that a pair is met once."""
    a = b = 0
    for _ in range(steps):
        (c, _), second = halves(a, b, len(u))
        a, b = (c, b) if c + b <= len(v) and u[:c] == v[:c] else second
    return a, b


class Held:
    """Words of one half, kept by the halves of their rests once they are more than a few."""

    def __init__(self, a: int, b: int, steps: int) -> None:
        self.a, self.b, self.steps, self.words, self.by = a, b, steps, [], None

    def add(self, word: str) -> None:
        if self.by is not None:
            self._deal(word)
            return
        self.words.append(word)
        if len(self.words) > FEW:
            self.by, words, self.words = {}, self.words, []
            for w in words:
                self._deal(w)

    def _deal(self, word: str) -> None:
        if len(word) - self.a - self.b <= 1:  # one character, in which all of them differ
            self.words.append(word)
            return
        for a, b in halves(self.a, self.b, len(word)):
            at = (a, b, word[self.a : a], word[len(word) - b : len(word) - self.b])
            if at not in self.by:
                self.by[at] = Held(a, b, self.steps + 1)
            self.by[at].add(word)

    def near(self, v: str) -> Iterator[str]:
        """The words one edit from ``v`` which meet it here; each of those held is found once."""
        for u in self.words:
            if abs(len(u) - len(v)) <= 1 and one_edit(u, v) and path(u, v, self.steps) == (self.a, self.b):
                yield u
        for a, b in may(self.a, self.b, len(v)) if self.by else ():
            if below := self.by.get((a, b, v[self.a : a], v[len(v) - b : len(v) - self.b])):
                yield from below.near(v)


def shard(held: list[tuple[str, int, int, int]]) -> ahocorasick.Automaton:
    """The automaton over the known parts of (word, a, b, steps): by each beginning or end, the words that it is known of.

    Words of which both ends are known are kept by their beginning, or their end if nothing else is known.
    """
    parts: dict[str, dict[tuple[int, int, str, int], Held]] = defaultdict(dict)
    for word, a, b, steps in held:
        part = word[:a] or word[len(word) - b :]
        at = (a, b, word[len(word) - b :], steps)
        if at not in parts[part]:
            parts[part][at] = Held(a, b, steps)
        parts[part][at].add(word)
    automaton = ahocorasick.Automaton()
    for part, of in parts.items():
        automaton.add_word(part, (len(part), of))
    automaton.make_automaton()
    return automaton


def scanned(automaton: ahocorasick.Automaton, v: str, a: int, b: int) -> Iterator[str]:
    """Words of a shard that are one edit from ``v`` and meet it by its first ``a`` and last ``b`` characters."""
    tail = v[len(v) - b :]
    for end, (size, of) in automaton.iter(v):
        if end + 1 == size == a or (not a and size == b and end + 1 == len(v)):  # a beginning, or an end
            for (c, d, known, _), words in of.items():
                if (c, d) == (a, b) and known == tail:
                    yield from words.near(v)


def dealt(rows: DataFrame, first: bool) -> DataFrame:
    """(key, role, word, n, a, b, steps): words to hold (role 0) and to scan (role 1), one step of halving on.

    ``rows`` are words with n, or with ``first`` false rows of this same shape.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                word, n, was, roles = r["word"], r["n"], (r.get("a", 0), r.get("b", 0)), ((0, 1) if first else (r["role"],))
                for role in roles:
                    ways = may(*was, len(word)) if role else halves(*was, len(word)) if len(word) - sum(was) > 1 else ()
                    out += [(key(word, a, b), role, word, n, a, b, r.get("steps", 0) + 1) for a, b in ways]
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 50_000], strict=True), kinds, strict=True)], names)

    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["key", "role", "word", "n", "a", "b", "steps"]
    return rows.mapInArrow(work, "key long, role int, word string, n long, a int, b int, steps int")


def found(rows: DataFrame, shards: int) -> DataFrame:
    """(word, n_near, form, form_n) of scanned words, by shard: how many held words are near, and the most frequent of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, automaton, number, out = None, [], None, {}, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["word", "n_near", "form", "form_n"])

        for batch in batches:
            for of, role, word, n, a, b, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    now, held, automaton, number = of, [], None, {}
                if not role:  # those that are held come first
                    held.append((word, a, b, steps))
                    number[word] = n
                elif held:
                    automaton = automaton or shard(held)
                    count, best = 0, (0, "")
                    for u in scanned(automaton, word, a, b):
                        count += 1
                        best = min(best, (-number[u], u))
                    if count:
                        out.append((word, count, best[1], -best[0]))
                        if len(out) >= 10_000:
                            yield made()
                            out = []
        if out:
            yield made()

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    rows = rows.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "role").select("shard", "role", "word", "n", "a", "b", "steps")
    return rows.mapInArrow(work, "word string, n_near long, form string, form_n long")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for the words of (word, n) that have a near one: how many, and the most frequent (ties: the smallest).

    Halves of very many words are dealt once more, by the halves of what is left of them; where one character is left there are
    no more words than characters.
    """
    rows, all_found = cut(dealt(words.select("word", "n"), True)), None
    while True:
        rest = F.when(F.col("role") == 0, F.length("word") - F.col("a") - F.col("b"))
        many = rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("held"), F.count(F.lit(1)).alias("rows"), F.min(rest).alias("rest"))
        hot = cut(many.filter((F.col("rows") > HOT) & ((F.col("held") == 0) | (F.col("rest") > 1))).select("key", (F.col("held") > 0).alias("live")))
        done = hot.isEmpty()
        now = rows if done else rows.join(hot, "key", "left_anti")
        part = cut(found(now, max(1, rows.filter("role = 0").count() // SHARD, shuffle_partitions(words.sparkSession))))
        all_found = part if all_found is None else all_found.unionByName(part)
        if done:
            break
        rows = cut(dealt(rows.join(hot.filter("live").select("key"), "key", "left_semi"), False))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return all_found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of (word, form), by doubling; chains end, as each form is more frequent than the word."""
    now = cut(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def group(docs: DataFrame, least: int = LENGTH, times: int = TIMES, every: int = DAMAGE, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts of (doc_id, text), one row a word.

    A word's form is its most frequent near word if that has at least ``ratio`` times its occurrences; its root the end of the forms from it
    on, itself if it has none. Of every distinct run of a document, one of ``every`` by hash loses a character first (0: none does). Null
    text counts as empty, a null doc_id as no digits; repeated rows count as often as they occur; no other columns are read.
    """
    prepare(docs.sparkSession)
    words = cut(counts(docs, least, times, every))
    both = cut(words.join(near(words), "word", "left"))
    kept = F.col("form_n") >= ratio * F.col("n")
    both = both.select("word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("form_n")).alias("form_n"))
    return both.join(roots(both), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

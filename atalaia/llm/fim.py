"""Fill-in-middle: a text's middle moved to its end, cut by ranks of units (lines, words or characters).

One Aho-Corasick automaton over the characters at which the class of a unit can change and over the sentinels is run along a
text. Its events are sparse; what lies between two of them (a gap) holds a number of units that follows from its length: one
for lines and words, one for each code point where units are characters. So a table of the places where units begin and of the units
before them is enough to find where the unit of any rank begins, and the text is never cut into all its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import prepare

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What the hash of a document starts with, texts in a hundred that are transformed, and those of them with the suffix first.
SEED, RATE, SPM = 7, 100, 50
#: Characters at which the class changes, by kind of unit: a line ends with its line feed; words and runs of white space alternate.
CHANGES = {"line": "\n", "word": " \t\n\x0b\f\r", "char": ""}


class Scanner:
    """The automaton over class-changing characters and sentinels."""

    def __init__(self, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS) -> None:
        if unit not in CHANGES:
            raise ValueError(f"unit must be one of {', '.join(CHANGES)}")
        if len(set(sentinels)) < 3 or any(len(s) < 2 or set(s) & set(CHANGES[unit]) for s in sentinels):
            raise ValueError("sentinels must differ, have two characters at least and none that ends a unit")
        if any(a[i:] == b[: len(a) - i] for a in sentinels for b in sentinels for i in range(1, len(a))) or any(a != b and a in b for a in sentinels for b in sentinels):
            raise ValueError("sentinels must not overlap")
        self.unit, self.sentinels = unit, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in CHANGES[unit]:
            self.automaton.add_word(c, 0)
        for s in sentinels:
            self.automaton.add_word(s, len(s))
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of class-changing characters, and where sentinels begin."""
        found = np.array([(end, size) for end, size in self.automaton.iter(text)], np.int64).reshape(-1, 2)
        marks = found[found[:, 1] > 0]
        return found[found[:, 1] == 0, 0], marks[:, 0] - marks[:, 1] + 1

    def units(self, text: str) -> Units:
        changes, marks = self.events(text)
        if self.unit == "char":
            return Units(np.zeros(1, np.int64), np.zeros(1, np.int64), 1, len(text), len(text), len(marks) > 0)
        if self.unit == "line":
            starts = np.r_[0, changes + 1]
        else:  # a gap is a word, a run of events is white space
            starts = np.r_[0, changes[np.diff(changes, prepend=-2) > 1], changes[np.diff(changes, append=len(text) + 1) > 1] + 1]
            starts = np.unique(starts)
        starts = starts[starts < len(text)]
        return Units(starts, np.arange(len(starts)), 0, len(starts), len(text), len(marks) > 0)


@dataclass
class Units:
    """Places from which units are counted and the units before each; ``width`` characters a unit after a place (0: one unit up to the next place)."""

    at: np.ndarray
    before: np.ndarray
    width: int
    n: int
    size: int
    marked: bool

    def start(self, rank: int) -> int:
        """Where the unit of a rank from 0 begins; the text's end for rank n."""
        if rank >= self.n:
            return self.size
        i = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.at[i] + (rank - self.before[i]) * self.width)


def draws(key: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits from the hash of ``seed:key``; a null key counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def arranged(text: str, drawn: list[int], scanner: Scanner, rate: int = RATE, spm: int = SPM) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form, characters of the prefix, of the middle) of one text."""
    units = scanner.units(text)
    a, b = sorted(h % (units.n + 1) for h in drawn[:2])
    if not text or units.marked or drawn[2] % 100 >= rate:
        return text, units.n, "plain", None, None
    p, m = units.start(a), units.start(b)
    before, after, last = scanner.sentinels
    if drawn[3] % 100 < spm:
        return f"{after}{text[m:]}{before}{text[:p]}{last}{text[p:m]}", units.n, "spm", p, m - p
    return f"{before}{text[:p]}{after}{text[m:]}{last}{text[p:m]}", units.n, "psm", p, m - p


def rebuilt(output: str, form: str, scanner: Scanner) -> str:
    """The text that an output of a form was made of. Pieces hold no sentinel, so the first of each kind is the one put in."""
    if form == "plain":
        return output
    marks, sizes = scanner.events(output)[1], {s: len(s) for s in scanner.sentinels}
    at = {s: i for i in map(int, marks) for s in scanner.sentinels if output.startswith(s, i)}
    if len(marks) != 3 or len(at) != 3:
        raise ValueError("not an output of this form")
    order = sorted(at, key=at.get)
    ends = [at[s] for s in order[1:]] + [len(output)]
    piece = {s: output[at[s] + sizes[s] : end] for s, end in zip(order, ends, strict=True)}
    before, after, last = scanner.sentinels
    return piece[before] + piece[last] + piece[after]


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of (doc_id, text).

    A text is cut before the units of two ranks that follow from its doc_id, and written as prefix, suffix, middle (psm) or
    suffix, prefix, middle (spm), each after its sentinel. Form is plain, and the output the text itself, where the text is empty or null,
    holds a sentinel, or falls outside ``rate`` of 100 texts. n are its units. Rows are worked on where they lie: repeated rows
    give repeated rows, a null doc_id counts as no digits, no columns but these two are read.
    """
    prepare(docs.sparkSession)
    Scanner(unit, sentinels)  # wrong arguments are an error here
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        for b in batches:
            made = [arranged(t.as_py(), h.as_py(), scanner, rate, spm) for t, h in zip(b.column(1), b.column(2), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            output, *rest = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *rest, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.withColumn("drawn", draws(F.col("doc_id"), seed)).mapInArrow(work, schema)


def restore(rows: DataFrame, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` with restored, the text that each output of a form was made of. A null output or form gives null."""
    prepare(rows.sparkSession)
    own = rows.columns.index("output"), rows.columns.index("form")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        for b in batches:
            both = zip(b.column(own[0]), b.column(own[1]), strict=True)
            texts = [rebuilt(o.as_py(), f.as_py(), scanner) if o.is_valid and f.is_valid else None for o, f in both]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "restored"])

    return rows.mapInArrow(work, StructType([*rows.schema, StructField("restored", StringType())]))


def digests(rows: DataFrame) -> DataFrame:
    """What transform() and restore() gave, with digests in place of texts."""
    texts = ("output", "restored")
    return rows.withColumns({f"{c}_sha256": F.sha2(F.col(c).cast("binary"), 256) for c in texts}).drop(*texts)

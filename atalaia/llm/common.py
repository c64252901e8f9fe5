"""What the operators share: the shared folder, Arrow batches, range buckets and tokenised pieces."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import uuid
import zipfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts go to Python, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


#: Checkpoints after which the driver's garbage is collected.
GARBAGE = 6


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, for the whole session, and see that there is a checkpoint folder (the cluster's, else our own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context: they need not find it where the driver does."""
    sc = spark.sparkContext
    if getattr(sc, "_atalaia_shipped", False):
        return
    root, held = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    uri = new_folder(spark, "code")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/atalaia.zip", compression=None) as out:
        out.write(held.getvalue())
    sc.addPyFile(f"{uri}/atalaia.zip")
    sc._atalaia_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share: spark.checkpoint.dir, or on a single machine a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file:///tmp/checkpoints/atalaia-{os.getpid()}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a folder of its own below the shared one; not made yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: computed once, survives the loss of executors.

    Now and then the driver collects its garbage, so that Spark deletes the shuffle files of plans that no longer exist; an
    operator of many rounds would else keep them all to its end.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    sc._atalaia_cuts = getattr(sc, "_atalaia_cuts", 0) + 1
    if sc._atalaia_cuts % GARBAGE == 0:
        sc._jvm.System.gc()
    return out


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a partition, after which what it has freed goes back to the system: a worker lives on, and would else keep what its largest task took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def mapped(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over batches as dicts of Python lists; ``work`` is given the iterator of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for b in batches:
                if b.num_rows:
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in work(columns()):
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    kinds = to_arrow_schema(spark_schema)
    return df.mapInArrow(tidied(run), spark_schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input, as the plan tells them, from which more ranges are made than there are shuffle partitions.
RANGE_BYTES = 128 << 20


def range_number(df: DataFrame) -> int:
    """Ranges to deal ``df`` by: the shuffle partitions, more for inputs whose size the plan knows to be greater."""
    size, least = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), shuffle_partitions(df.sparkSession)
    return max(least, min(size // RANGE_BYTES, 100 * least) if size < 1 << 55 else 0)  # a plan that can't tell gives a number beyond


def split_points(df: DataFrame, key: str, n: int) -> list[tuple[int, int, int]]:
    """At most ``n - 1`` places (not null, key, tie) that cut the order by nulls first, key and tie into about equal ranges.

    Ties are taken as spread evenly over 64 bits, so that a key, or null, with many rows has several ranges.
    """
    if n < 2:
        return []
    held = df.agg(F.count(F.lit(1)).alias("all"), F.count(key).alias("known")).first()
    if not held["all"]:
        return []
    got = [(1, min(int(x), 2**63 - 1)) for x in df.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)] if held["known"] else []
    nulls = held["all"] - held["known"]
    known = round(n * held["known"] / held["all"]) or bool(held["known"])
    got = [got[len(got) * i // known] for i in range(1, known)] if nulls else got
    if nulls:  # as many as fall to the nulls, one of which is the least key of all and cuts nothing
        got = [(0, 0)] * max(1, n - known) + [(1, -(2**63))] * bool(held["known"]) + got
    times = Counter(got)
    points = {(flag, k, -(2**63) + 2**64 * i // m) for (flag, k), m in times.items() for i in range(m)}
    return sorted(points)[bool(nulls) :]


def bucket_of(key: str, points: list[tuple[int, int, int]], tie: str = "tie") -> Column:
    """Number of split points at or below (not null, key, tie), by halving the sorted points."""
    if not points:
        return F.lit(0)
    long = lambda x: "-9223372036854775807L - 1L" if x == -(2**63) else f"{x}L"
    known = f"array({','.join(f'struct({f} as f, {long(k)} as k, {long(t)} as t)' for f, k, t in points)})"
    own = f"struct(int(`{key}` is not null) as f, coalesce(`{key}`, 0L) as k, `{tie}` as t)"
    halve = f"if(a.lo >= a.hi, a, if({known}[(a.lo + a.hi) div 2] <= {own}, struct(int((a.lo + a.hi) div 2 + 1) as lo, a.hi as hi), struct(a.lo as lo, int((a.lo + a.hi) div 2) as hi)))"
    return F.expr(f"aggregate(sequence(1, {len(points).bit_length() + 1}), struct(0 as lo, {len(points)} as hi), (a, i) -> {halve}, a -> a.lo)")


def in_ranges(rows: DataFrame, name: str, key: str = "doc_id") -> tuple[DataFrame, int]:
    """``rows``, which have a column tie, with the number of their range in the order by nulls first, ``key`` and tie; and how many ranges there are."""
    points = split_points(rows, key, range_number(rows))
    return rows.withColumn(name, bucket_of(key, points)), len(points) + 1


#: Characters that the tokenizer's pattern calls white space, and the pattern of byte-level BPE over them.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


class Cache(dict):
    """A dict of two generations that computes what it lacks; at most twice ``most`` entries are held, none of a longer string than LONG."""

    def __init__(self, compute: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if isinstance(key, int) or len(key) <= LONG:
            self[key] = value
        return value


#: Words that the pattern surely cuts as the library does: Latin letters, then ASCII signs but the apostrophe, once more after a line feed.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@\\[-`{-~"
COMPOSED = rf"^(?P<a>[{_LETTERS}]+)(?P<b>[{_SIGNS}]*)(?:(?P<c>\n)(?P<d>[{_LETTERS}]+)(?P<e>[{_SIGNS}]*))?$"
#: Bytes of texts that are looked up together, and bytes of the longest strings that are kept.
SLICE_BYTES, LONG = 16 << 20, 64


def gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of a table that begin at ``start`` and are ``size`` long, one after another."""
    ends = np.cumsum(size)
    return table[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Parts:
    """Ids of whole texts from the ids of their words, most of which are known from texts before.

    A single blank between two characters that are not white space always starts a pretoken, so a text can
    be cut at its blanks. The distinct words of a slice are cut into strings on their own (a word, its signs, a line feed), the distinct ones of
    these are looked up among the last ``cached`` of at most LONG bytes, and ids are gathered by place; all of it on Arrow arrays, without a
    step for each word. A word that is empty or has white space at an end stands for a run of white space: its text is encoded as a whole.
    """

    def __init__(self, starts: Callable, inner: Callable, wholes: Callable, special: list[str], kind: str, cached: int = 600_000) -> None:
        """Functions from strings to ids, one after another, and how many each has: ``starts`` for words with a blank before each,
        ``inner`` for strings without, ``wholes`` for texts. ``special`` are strings that the tokenizer takes out first; ``kind`` is the type of an id."""
        self.starts, self.inner, self.wholes, self.special, self.kind, self.cached = starts, inner, wholes, special, np.dtype(kind), cached
        self.known, self.table, self.size = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _strings(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where in it each of the distinct strings has its ids and how many."""
        at = pc.fill_null(pc.index_in(strings, value_set=self.known), -1).to_numpy()
        lack = np.flatnonzero(at < 0)
        new = strings.take(pa.array(lack))
        blank = pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
        table, size, places = [self.table], [self.size], np.zeros(len(lack), np.int64)
        for make, some in ((self.starts, np.flatnonzero(blank)), (self.inner, np.flatnonzero(~blank))):
            if len(some):
                ids, sizes = make(new.take(pa.array(some)).to_pylist())
                places[some] = sum(map(len, size)) + np.arange(len(some))
                table.append(ids.astype(self.kind)), size.append(sizes)
        at = at.astype(np.int64)
        at[lack] = places
        table, size = np.concatenate(table), np.concatenate(size)
        start = np.cumsum(size) - size
        if len(lack):
            short = np.flatnonzero(pc.binary_length(strings).to_numpy(zero_copy_only=False) <= LONG)[: self.cached]
            unseen = np.ones(len(self.known), bool)
            unseen[at[at < len(unseen)]] = False
            old = np.flatnonzero(unseen)[: self.cached - len(short)]
            keep = np.r_[at[short], old]
            self.known = pa.concat_arrays([strings.take(pa.array(short)), self.known.take(pa.array(old))])
            self.table, self.size = gathered(table, start[keep], size[keep]), size[keep]
        return table, start[at], size[at]

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words with a blank before each, one after another; how many each has; which stand for runs of white space."""
        spaces = np.zeros(len(words), bool)
        odd = np.flatnonzero(~pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False))
        some = words.take(pa.array(odd))
        spaces[odd] = pc.match_substring_regex(some, rf"^$|^[{_SPACE}]|[{_SPACE}]$").to_numpy(zero_copy_only=False)
        found = pc.extract_regex(some, COMPOSED)
        made = odd[found.is_valid().to_numpy(zero_copy_only=False)]
        found = found.drop_null()
        single = np.ones(len(words), bool)
        single[made] = False
        columns = [pc.fill_null(found.field(i), "") for i in range(5)]
        blank = lambda x: pc.binary_join_element_wise("", x, " ")
        whole = np.flatnonzero(single & ~spaces)
        strings = pa.concat_arrays([blank(words.take(pa.array(whole))), blank(columns[0]), *columns[1:], pa.array([""])]).dictionary_encode()
        codes = strings.indices.to_numpy()
        places = np.full((len(words), 5), codes[-1], np.int32)
        places[whole, 0] = codes[: len(whole)]
        places[made] = codes[len(whole) : -1].reshape(5, -1).T
        table, start, size = self._strings(strings.dictionary)
        places = places.ravel()
        return gathered(table, start[places], size[places]), size[places].reshape(-1, 5).sum(1), spaces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        done, i = [(np.zeros(0, self.kind), np.zeros(0, np.int64))], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
            done.append(self._encode(texts.slice(i, j - i)))
            i = j
        ids, counts = zip(*done, strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        flat, at = lists.flatten(), (at - at[0])[:-1]
        words, heads = flat.dictionary_encode(), flat.take(pa.array(at)).dictionary_encode()
        table, size, spaces = self._words(words.dictionary)
        codes = words.indices.to_numpy().copy()
        codes[at] = len(size) + heads.indices.to_numpy()
        whole = pc.match_substring_regex(heads.dictionary, rf"[{_SPACE}]$").to_numpy(zero_copy_only=False)
        head_ids, head_size = self.wholes(heads.dictionary.to_pylist())
        table, size, spaces = np.concatenate([table, head_ids.astype(self.kind)]), np.concatenate([size, head_size]), np.r_[spaces, whole]
        whole = np.logical_or.reduceat(spaces[codes], at) if spaces.any() else np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        start, size = (np.cumsum(size) - size).astype(np.int32), size.astype(np.int32)
        ids, counts = gathered(table, start[codes], size[codes]), np.add.reduceat(size[codes], at, dtype=np.int64)
        if whole.any():
            some = np.flatnonzero(whole)
            new, sizes = self.wholes(texts.take(pa.array(some)).to_pylist())
            start, size = np.cumsum(counts) - counts, counts.copy()
            start[some], size[some] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids, counts = gathered(np.concatenate([ids, new.astype(self.kind)]), start, size), size
        return ids, counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; resolved where it is used, as each executor has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def library_tokenizer(path: str | None, ordinary: bool = False):
    """The tokenizers library's tokenizer without truncation or padding; ``ordinary``: special strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or tokenizer_path())
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = ordinary
    return t



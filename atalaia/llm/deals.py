"""Links between sets that meet in deals: pairs offered, sifted and verified, however large a deal is.

A set is dealt by each of its bands, so sets meet where they have a band in common. Small deals offer all their pairs, large ones
each member's neighbour only. What is offered is sifted by the sets' sketches and verified on their members. Then the members of large deals that are not
all connected meet once more, with their sets: pairs that are not connected and that their sketches can't rule out are verified where they
meet, and only links that connect come out. So no group yields a pair list. A deal of more than MOST members or BYTES of sets
is cut into parts, each pair of which meets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied
from .components import components
from .shingling import alike, bands, shingles

#: Members up to which a deal offers all its pairs at once; members and bytes of sets beyond which it is cut into parts.
SMALL, MOST, BYTES = 16, 4096, 64 << 20
#: Texts to verify (16 bytes each) up to which their names are sent to all tasks; beyond, texts are joined by a shuffle.
MOST_SENT = 500_000


class Sift(Protocol):
    """What rules out pairs by the sketches of sets; ``num / den`` is the least likeness of a link."""

    num: int
    den: int

    def open(self, sketches: list[bytes], group: np.ndarray, size: np.ndarray) -> Any:
        """The sketches of a deal, made ready to be compared; ``group`` is the number of each one's label, ``size`` each label's members."""

    def rest(self, held: Any, n: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
        """Those of ``j`` that may be linked with ``i``."""

    def pairs(self, x: list[bytes], y: list[bytes], n: np.ndarray) -> np.ndarray:
        """Which pairs may be linked; ``n`` are the members of both together."""


def fit(n: np.ndarray, m: np.ndarray, sift: Sift) -> np.ndarray:
    """False where sets of ``n`` and ``m`` members can't be alike."""
    return np.minimum(n, m) * sift.den >= np.maximum(n, m) * sift.num


def dealt(sets: DataFrame, sketch: str, size: int, rows: int) -> DataFrame:
    """(deal, key, n): each set of (key, n, ``sketch``) by each band of ``rows`` in the sketch's first ``size`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                deals = bands([x[:size] for x in b.column(2).to_pylist()], rows)
                times = deals.shape[1]
                yield pa.RecordBatch.from_pydict({"deal": deals.ravel(), "key": np.repeat(b.column(0).to_numpy(), times), "n": np.repeat(b.column(1).to_numpy(), times)})

    return sets.select("key", "n", sketch).mapInArrow(tidied(work), "deal long, key long, n int")


def runs(batches: Iterator[pa.RecordBatch], *of: str) -> Iterator[dict[str, np.ndarray]]:
    """Rows by whole runs of equal ``of``, several runs at once; batches are joined once, when their run has ended."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        if held and any(held[-1][k][-1] != new[k][0] for k in of):
            yield {n: np.concatenate([x[n] for x in held]) for n in new}
            held = []
        last = np.flatnonzero(np.logical_or.reduce([new[k] != new[k][-1] for k in of]))
        if len(last):
            at = last[-1] + 1
            held.append({n: x[:at] for n, x in new.items()})
            yield {n: np.concatenate([x[n] for x in held]) for n in new}
            held = []
            new = {n: x[at:] for n, x in new.items()}
        held.append(new)
    if held:
        yield {n: np.concatenate([x[n] for x in held]) for n in held[0]}


def starts(x: dict[str, np.ndarray], *of: str) -> np.ndarray:
    """Where runs begin, and the end."""
    new = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in of])
    return np.r_[0, np.flatnonzero(new) + 1, len(x[of[0]])]


def offers(rows: DataFrame, sift: Sift) -> DataFrame:
    """(a, b, large) of (deal, key, n): pairs of keys to verify, or where large has a number the members b of a large deal a, and how many elements each has."""
    many = cut(rows.groupBy("deal").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("deal", F.ceil(F.col("n") / MOST).cast("int").alias("parts")))
    if many.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:  # neighbours are those of a part
        rows = rows.join(many, "deal", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key"), "parts").cast("int") + 1, F.lit(0))).drop("parts")
    small = SMALL

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, "deal", "part"):
            at = starts(x, "deal", "part")
            count, key, n = np.diff(at), x["key"], x["n"].astype(np.int64)
            end, large = np.repeat(at[1:], count), np.repeat((count > small) | (x["part"][at[:-1]] > 0), count)
            i = np.arange(len(key))
            for lag in range(1, small):
                i = i[(i + lag < end[i]) & (~large[i] | (lag == 1))]
                if not i.size:
                    break
                j = i[fit(n[i], n[i + lag], sift)]
                if j.size:
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(key[j], key[j + lag]), "b": np.maximum(key[j], key[j + lag]), "large": pa.nulls(len(j), pa.int64())})
            if large.any():
                yield pa.RecordBatch.from_pydict({"a": x["deal"][large], "b": key[large], "large": n[large]})

    # By key, so that neighbours are the same in all deals of one group.
    return rows.repartition("deal", "part").sortWithinPartitions("deal", "part", "key").mapInArrow(tidied(work), "a long, b long, large long")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``others`` shares with ``one``; all are sorted and none is empty."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)


def rest(large: DataFrame, label: DataFrame, docs: DataFrame, sets: DataFrame, sift: Sift) -> DataFrame:
    """(a, b): links that connect those members of large deals (a, b, large) which have different labels (node, label) but are linked."""
    named = large.select(F.col("a").alias("deal"), F.col("b").alias("key"), F.col("large").alias("n")).join(label.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("label", F.coalesce("label", "key"))
    several = named.groupBy("deal").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("count"), F.sum(F.col("n") * 8).alias("bytes")).filter("lo < hi")
    parts = F.greatest(F.ceil(F.col("count") / MOST), F.ceil(F.col("bytes") / BYTES)).cast("int")
    named = cut(named.join(several.select("deal", parts.alias("parts")), "deal"))
    made = members(named.select("key").distinct(), docs, sets)
    own = F.pmod(F.xxhash64("key"), "parts").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    named = named.withColumns({"own": own, "pair": F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(pairs))}).drop("parts", "n")
    named = named.join(sets.select("key", "fp").join(made, "key"), "key").select("deal", "pair", "own", "key", "label", "fp", "members")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, "deal", "pair"):
            at = starts(x, "deal", "pair")
            for p, q in zip(at[:-1], at[1:], strict=True):
                key, of, own = x["key"][p:q], x["label"][p:q].copy(), x["own"][p:q]
                if (of == of[0]).all():
                    continue
                whole = [np.frombuffer(v, np.uint64) for v in x["members"][p:q]]
                n = np.array([len(v) for v in whole])
                apart = own[0] != own[-1]  # two parts: members of one of them meet elsewhere
                _, back, count = np.unique(of, return_inverse=True, return_counts=True)
                held, a, b = sift.open(list(x["fp"][p:q]), back, count), [], []
                few = np.flatnonzero(back != count.argmax())  # each pair of labels has one that is not the greatest
                turn = np.full(q - p, len(few))
                turn[few] = np.arange(len(few))
                for k, i in enumerate(few):
                    j = np.flatnonzero((of != of[i]) & (turn > k) & (own != own[i] if apart else True))
                    j = sift.rest(held, n, i, j[fit(n[i], n[j], sift)])
                    if not j.size:
                        continue
                    both = overlaps(whole[i], [whole[m] for m in j])
                    j = j[both * sift.den >= sift.num * (n[i] + n[j] - both)]
                    for m in j:
                        if of[m] != of[i]:
                            a.append(key[i]), b.append(key[m])
                            of[of == of[m]] = of[i]
                if a:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return named.repartition("deal", "pair").sortWithinPartitions("deal", "pair", "own", "key").mapInArrow(tidied(work), "a long, b long")


def sifted(pairs: DataFrame, sets: DataFrame, sift: Sift) -> DataFrame:
    """Distinct (a, b) that their sketches can't rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select([0, 1]).filter(pa.array(sift.pairs(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_numpy())))

    x, y = (sets.select(F.col("key").alias(k), F.col("fp").alias(f"fp_{k}"), F.col("n").cast("long").alias(f"n_{k}")) for k in "ab")
    both = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "fp_a", "fp_b", F.col("n_a") + F.col("n_b"))
    return both.mapInArrow(tidied(work), "a long, b long")


def members(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, members) of distinct keys: their sets, made anew from the texts that ``sets`` (key, mark) names, from a checkpoint."""
    wanted = cut(keys.join(sets.select("key", "mark"), "key").select("mark", F.col("key").alias("of")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the wanted sets those that the task has made already
        for b in batches:
            names = b.column(0).to_pylist()
            new = [i for i, k in enumerate(names) if not (k in seen or seen.add(k))]
            yield pa.RecordBatch.from_pydict({"key": [names[i] for i in new], "members": [shingles(b.column(1)[i].as_py()).tobytes() for i in new]}, schema=kind)

    kind = pa.schema([("key", pa.int64()), ("members", pa.binary())])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Marks are joined first, ids only: texts that are not wanted don't leave their place unless the wanted ones outgrow a broadcast.
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("mark"))
    found = (rows.join(F.broadcast(wanted), "mark") if wanted.count() <= MOST_SENT else rows.join(wanted, "mark")).select("of", "text")
    return cut(found.mapInArrow(tidied(work), "key long, members binary").dropDuplicates(["key"]))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, sift: Sift) -> DataFrame:
    """Those of (a, b), each once, whose sets are alike. ``sets`` has key, mark, n and fp."""
    pairs = cut(sifted(pairs, sets, sift))
    made = members(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, sets)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(i)] for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array([alike(v, w, sift.num, sift.den) for v, w in zip(x, y, strict=True)], pa.bool_()))

    both = pairs.join(made.select(F.col("key").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(made.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(tidied(check), "a long, b long"))


def labels(deals: DataFrame, docs: DataFrame, sets: DataFrame, sift: Sift) -> DataFrame:
    """(node, label) of the keys that are linked with others: the least key reachable. ``sets``: key, mark (of a text of ``docs``), n, fp."""
    found = cut(offers(deals, sift))
    label = cut(components(verified(found.filter("large is null").select("a", "b"), docs, sets, sift)))
    large = found.filter("large is not null")
    if large.isEmpty():
        return label
    known = label.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return cut(components(known.unionByName(cut(rest(large, label, docs, sets, sift)))))

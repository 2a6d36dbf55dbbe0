"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that stays in one shard.  The aim is a fixed number
of shards of near equal bytes: best-fit decreasing fills bins of one capacity,
and the smallest capacity whose packing needs no more than that number of
bins is found by bisection.  Open bins stand in a balanced tree ordered by
remaining capacity, so the tightest bin that takes a group is one descent.

At scale the packing has two levels.  With unit = total / (shards * FINE):

* groups of at least one unit - at most ``shards * FINE`` of them, since
  their bytes add up to no more than the total - are items of their own;
* smaller groups are packed best-fit decreasing into bins of one unit, in
  tasks that each hold an equal hash range of the groups; each bin is an item.
  All but one bin of a task are at least half full, so there are at most
  ``2 * shards * FINE`` of them plus one for each task.

Only these items go to the driver, where the second level packs them.  A
shard exceeds the mean by a few units at most, unless one group alone exceeds
a shard: it stays whole, and the others share what is left.

Defined cases: a null text counts one byte, has crc32 0 and stands in a group
with empty texts; repeated rows are separate rows of one group; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import prepare
from tagweave.workers import ship_by_value

#: Units per shard: a shard's bytes differ from the mean by a few of them.
FINE = 1024
#: Rows that one task numbers together.
SLOT_ROWS = 20_000


class CapacityTree:
    """AA tree of ``(remaining, bin)`` keys: insert, and take the least key >= bound."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key: tuple) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, t, key):
        if t is None:
            return [key, 1, None, None]
        if key < t[0]:
            t[2] = self._insert(t[2], key)
        else:
            t[3] = self._insert(t[3], key)
        return self._split(self._skew(t))

    def take(self, bound: int):
        """Remove and return the smallest key whose remaining capacity is >= ``bound``."""
        best, t = None, self.root
        while t:
            if t[0][0] >= bound:
                best, t = t[0], t[2]
            else:
                t = t[3]
        if best is not None:
            self.root = self._remove(self.root, best)
        return best

    def _remove(self, t, key):
        if t is None:
            return None
        if key < t[0]:
            t[2] = self._remove(t[2], key)
        elif t[0] < key:
            t[3] = self._remove(t[3], key)
        elif t[2] is None and t[3] is None:
            return None
        elif t[2] is None:
            heir = t[3]
            while heir[2]:
                heir = heir[2]
            t[0] = heir[0]
            t[3] = self._remove(t[3], heir[0])
        else:
            heir = t[2]
            while heir[3]:
                heir = heir[3]
            t[0] = heir[0]
            t[2] = self._remove(t[2], heir[0])
        least = 1 + min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0)
        if least < t[1]:
            t[1] = least
            if t[3] and t[3][1] > least:
                t[3][1] = least
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t


class BestFit:
    """Best fit into bins of one capacity; a larger item gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.tree = capacity, 0, CapacityTree()

    def place(self, size: int) -> int:
        found = self.tree.take(size)
        if found is None:
            found = (max(self.capacity, size), self.bins)
            self.bins += 1
        remaining, at = found[0] - size, found[1]
        if remaining > 0:
            self.tree.insert((remaining, at))
        return at


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; ``None`` if more than ``most`` bins are needed."""
    fit, bins = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = fit.place(sizes[i])
        if most is not None and fit.bins > most:
            return None
    return bins


def tightest(sizes: list[int], shards: int) -> list[int]:
    """Best-fit decreasing at (nearly) the smallest capacity that needs at most ``shards`` bins."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    high, found = low, best_fit_decreasing(sizes, low, shards)
    step = max(1, low >> 12)
    while found is None:
        low, high = high, high + step
        step *= 2
        found = best_fit_decreasing(sizes, high, shards)
    while high - low > max(1, high >> 16):
        middle = (low + high) // 2
        bins = best_fit_decreasing(sizes, middle, shards)
        if bins is None:
            low = middle
        else:
            high, found = middle, bins
    return found


def _unit_bins(unit: int):
    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive by falling size."""
        fit, base = BestFit(unit), TaskContext.get().partitionId() << 32
        for pdf in batches:
            cells = [base + fit.place(size) for size in pdf["bytes"].tolist()]
            yield pd.DataFrame({"digest": pdf["digest"], "bytes": pdf["bytes"], "cell": cells})

    return pack


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``(digest, shard)`` for ``groups (digest, bytes)``."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit = max(1, total // (shards * FINE))
    cells = (
        groups.select("digest", "bytes")
        .filter(F.col("bytes") < unit)
        .repartition("digest")
        .sortWithinPartitions(F.desc("bytes"), "digest")
        .mapInPandas(_unit_bins(unit), "digest binary, bytes long, cell long")
        .checkpoint()
    )
    large = groups.filter(F.col("bytes") >= unit).select("digest", "bytes").orderBy("digest").collect()
    small = cells.groupBy("cell").agg(F.sum("bytes").alias("bytes")).orderBy("cell").collect()
    bins = tightest([r["bytes"] for r in large] + [r["bytes"] for r in small], shards)
    spark = groups.sparkSession
    by_group = spark.createDataFrame(
        [(bytes(r["digest"]), b) for r, b in zip(large, bins)], "digest binary, shard int"
    )
    by_cell = spark.createDataFrame(
        [(r["cell"], b) for r, b in zip(small, bins[len(large) :])], "cell long, shard int"
    )
    return (
        cells.join(F.broadcast(by_cell), "cell").select("digest", "shard").unionByName(by_group)
    )


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    prepare(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    ).checkpoint()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = rows.join(shard_groups(groups, shards), "digest")
    buckets = max(1, rows.count() // SLOT_ROWS)
    placed = placed.select(
        "rid", "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("bucket"),
    ).checkpoint()
    before = (
        placed.groupBy("shard", "bucket")
        .count()
        .select(
            "shard",
            "bucket",
            (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("base"),
        )
    )
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid"))
    return (
        placed.withColumn("place", place)
        .join(before, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


ship_by_value(__name__)

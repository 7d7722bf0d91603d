"""Sharding by best-fit decreasing: groups of equal texts, the largest first, into the tightest bin.

A group (all rows of one text) is never divided. Groups are sorted by their bytes; one that takes a
real part of a shard is an item of its own, smaller ones that follow each other in the order are
tied into bundles of a bounded size, so that the number of items depends on the shards and not on
the rows. The items, largest first, enter the bin with the least remaining capacity that still
holds them, found in a balanced tree over the remaining capacities.

The texts are read once, for size, checksum and digest; all later shuffles carry some fifty bytes a
row. A group with a third of all rows is one row of the aggregation; its rows are joined to it as
a skewed join and are counted out by partition, so no task holds the group.

Defined cases: a null text counts as the empty text and groups with it. Repeated rows are each
placed. More shards than items leave the last shards empty. An empty table gives an empty result.
Other columns than id and text are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakework.llm.common import digest, stored, table

ROW_OVERHEAD = 8
FINE = 16  # every sixteenth bundle is made of sixteen small ones, which fill the last gaps


class CapacityTree:
    """A treap over (remaining capacity, bin): insert, and take the least that is large enough."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._random = random.Random(7)

    def insert(self, key: tuple[int, int]) -> None:
        self._root = self._put(self._root, [key, self._random.random(), None, None])

    def _put(self, node: list | None, new: list) -> list:
        if node is None:
            return new
        if new[1] < node[1]:
            new[2], new[3] = self._split(node, new[0])
            return new
        side = 2 if new[0] < node[0] else 3
        node[side] = self._put(node[side], new)
        return node

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def take_ceiling(self, size: int) -> tuple[int, int] | None:
        """Remove and give the least key of at least ``size``."""
        low, rest = self._split(self._root, (size, -1))
        if rest is None:
            self._root = low
            return None
        parent, node = None, rest
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            rest = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(low, rest)
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of every size (given in falling order); None if more than ``most`` bins are needed."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_ceiling(size)
        if found is None:
            if size > capacity:
                raise ValueError(f"an item of {size} bytes does not fit into {capacity}")
            if most is not None and bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        tree.insert((found[0] - size, found[1]))
    return out


def fill_shards(sizes: Sequence[int], shards: int) -> list[int]:
    """Bins 0 to ``shards`` - 1 for sizes in falling order, at the least capacity that suffices.

    An item above the fair share of what is left gets a shard of its own, so that the rest stays even.
    """
    own, left, total = 0, shards, sum(sizes)
    while own < len(sizes) and left > 1 and sizes[own] * left > total:
        total -= sizes[own]
        own, left = own + 1, left - 1
    rest = sizes[own:]
    if not rest:
        return list(range(own))
    low = max(-(-total // left), rest[0])
    step = max(1, low // 1000)
    high = low
    while (found := best_fit_decreasing(rest, high, left)) is None:
        low, high = high + 1, high + step
        step *= 2
    while low < high:
        middle = (low + high) // 2
        attempt = best_fit_decreasing(rest, middle, left)
        if attempt is None:
            low = middle + 1
        else:
            high, found = middle, attempt
    return [*range(own), *(own + b for b in found)]


def _bundle(piece: float):
    """Number the bundles of groups that arrive in falling order of their size, per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, singles = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("group_size")).to_numpy(zero_copy_only=False)
            small = sizes < piece
            ahead = done + np.cumsum(np.where(small, sizes, 0)) - np.where(small, sizes, 0)
            done = int(ahead[-1] + (sizes[-1] if small[-1] else 0)) if len(sizes) else done
            coarse = np.floor(ahead / piece).astype(np.int64)
            fine = np.where(coarse % FINE == FINE - 1, np.floor(ahead % piece / piece * FINE).astype(np.int64), 0)
            number = 2 * (coarse * FINE + np.minimum(fine, FINE - 1))
            alone = 2 * (singles + np.cumsum(~small)) + 1
            singles += int((~small).sum())
            item = (part << 40) + np.where(small, number, alone)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(item, pa.int64())], [*batch.schema.names, "item"])

    return run


def _count_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each shard within the partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        place = np.empty(len(shard), np.int64)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            place[own] = seen.get(int(s), 0) + np.arange(len(own))
            seen[int(s)] = seen.get(int(s), 0) + len(own)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), part), pa.int32()), pa.array(place, pa.int64())],
            [*batch.schema.names, "part", "place"],
        )


def shard_documents(
    docs: DataFrame, shards: int | None = 24, capacity: int | None = None, grain: int = 256, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    With ``capacity``, as few shards of that many bytes as best-fit finds; otherwise ``shards`` of
    sizes that are as even as the groups allow. ``grain`` is how many items make up a shard: the
    driver packs about ``2 * grain`` items a shard, plus one for each range partition, so take a
    small one where a capacity asks for very many shards.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{id_column}`"), (F.octet_length(content) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"), digest(text).alias("digest"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("group_size"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    share = capacity or max(1, total // shards)
    piece = max(1.0, share / grain)
    ordered = groups.repartitionByRange(F.desc("group_size"), "digest").sortWithinPartitions(F.desc("group_size"), "digest")
    bundled = stored(ordered.mapInArrow(_bundle(piece), ordered.select("*", F.lit(None).cast("long").alias("item")).schema), "shard-items")
    items = bundled.groupBy("item").agg(F.sum("group_size").alias("size")).toPandas()
    items = items.sort_values(["size", "item"], ascending=[False, True])
    sizes = [int(s) for s in items["size"]]
    bins = best_fit_decreasing(sizes, capacity) if capacity else fill_shards(sizes, shards)
    placed = spark.createDataFrame(list(zip(map(int, items["item"]), bins)), "item long, shard int")
    # At most 2 * grain items a shard and one a partition, so this side has a bound.
    by_digest = bundled.join(F.broadcast(placed), "item").select("digest", "shard")
    joined = rows.join(by_digest, "digest").drop("digest")
    counted = stored(joined.mapInArrow(_count_out, joined.select("*", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("place")).schema), "shard-places")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return counted.join(starts, ["shard", "part"]).select(
        F.col(f"`{id_column}`"), "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

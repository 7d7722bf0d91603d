"""N-gram Jaccard join: documents that share enough shingles, found by T-occurrence search.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100. The search has two steps, both exact.

Step 1 finds which documents may meet at all. All shingles have one global order, by hash. Of n
shingles, the first n - T + t are taken, T being the least overlap with any partner: partners
share t of these at least. The taken shingles form inverted lists, each counted over all
documents. A document stays if at least t of its taken shingles stand in another document too;
of those it keeps the c - t + 1 rarest, one of which every partner must share. Documents that share
a kept shingle belong to one candidate group. A list names only its least document to the others,
so the number of rows stays that of the postings and no list is ever paired out.

Step 2 searches each group by T-occurrence (DivideSkip) over all shingles of the whole texts: per
document, its short inverted lists are merged through a heap that skips ahead where too few of
them agree, and for what is met often enough to reach the overlap together with the long lists,
the long ones are probed by binary search. Groups
too large for a task are dealt out in parts that all hold some common documents; what is not
joined through these is searched against all parts.

Lists that are longer than any fair share (seen in a sketch of all lists) are counted by an
aggregate with map-side sums; all others by a window. Exact copies are reduced to one document
before step 1, the largest groups of them by a broadcast table of at most 100,000 rows, smaller
ones in the search itself.

Defined cases: words are runs of bytes outside space and U+0009 to U+000D, A-Z lower-cased. A text
with fewer words than a shingle is one shingle. A null text or one without words has an empty set,
links with nothing and is its own component. Repeated rows are in one component. A row with a
null id is returned with a null component. An empty table gives an empty result. Columns other
than id and text are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakework.llm.common import digest, free_name, slices, stored, table, text_bytes, window_hashes, word_hashes
from lakework.llm.components import Forest, connected_components

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SKETCH_BITS = 18
SKETCH_SEGMENTS = 64
COPY_GROUPS = 100_000
GROUP_SHINGLES = 100_000
LEAST_SHARED = 32
_FILLED = "[^\\x20\\x09-\\x0D]"
_MU = 0.0085  # weight of a long list's length in choosing how many to probe


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, whole texts in slices of bounded size."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1] - offsets[first]
        hashes, rows, _, _ = word_hashes(_LOWER[data[offsets[first] : offsets[last]]], own, SEPARATOR)
        starts = np.searchsorted(rows, np.arange(last - first + 1))
        full = window_hashes(hashes, size)
        for row in range(last - first):
            a, b = int(starts[row]), int(starts[row + 1])
            if b - a >= size:
                yield first + row, np.unique(full[a : b - size + 1])
            elif b > a:
                yield first + row, window_hashes(hashes[a:b], b - a)
            else:
                yield first + row, np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _shared(n: int, percent: int) -> int:
    """t for a set of n: as many as the plain prefix has, in small sets more; it grows with n."""
    least = least_overlap(n, percent)
    return min(least, max(n - least + 1, LEAST_SHARED))


def taken(n: int, percent: int) -> tuple[int, int]:
    """(how many of n shingles are taken, how many of them any partner shares)."""
    if n == 0:
        return 0, 0
    # A partner has at least the least overlap as its size, and t grows with the size.
    return min(n, n - least_overlap(n, percent) + _shared(n, percent)), _shared(least_overlap(n, percent), percent)


def _sketch(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            some = [s[: taken(len(s), percent)[0]] for _, s in shingle_sets(batch.column(batch.schema.get_field_index("text")), size)]
            if some:
                counts += np.bincount(_bucket(np.concatenate(some)), minlength=len(counts))
        parts = np.split(counts, SKETCH_SEGMENTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SEGMENTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "counts"])

    return run


def _bucket(hashes: np.ndarray) -> np.ndarray:
    # Taken shingles have low hashes, so the low bits are those that spread.
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _add_sketches(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in rows["counts"].to_pylist())
    return pa.table({"segment": rows["segment"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def hot_buckets(docs: DataFrame, size: int, percent: int, least: int) -> np.ndarray:
    """Which buckets of the sketch hold more postings than ``least`` and than four times the mean."""
    rows = docs.mapInArrow(_sketch(size, percent), "segment int, counts binary").groupBy("segment").applyInArrow(_add_sketches, "segment int, counts binary")
    counts = np.zeros((SKETCH_SEGMENTS, (1 << SKETCH_BITS) // SKETCH_SEGMENTS), np.int64)
    for row in rows.collect():  # SKETCH_SEGMENTS rows of a fixed size
        counts[row["segment"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.ravel()
    return counts > max(least, 4 * counts.mean())


def _postings(size: int, percent: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            rows, hashes, lengths = [], [], []
            for row, found in shingle_sets(batch.column(batch.schema.get_field_index("text")), size):
                n = taken(len(found), percent)[0]
                rows.append(np.full(n, row))
                hashes.append(found[:n])
                lengths.append(np.full(n, len(found), np.int32))
                if len(rows) >= 2048 or row == batch.num_rows - 1:
                    at, h = np.concatenate(rows), np.concatenate(hashes)
                    if len(h):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.view(np.int64)), pa.array(ids[at]), pa.array(np.concatenate(lengths)), pa.array(hot.value[_bucket(h)])],
                            ["h", "id", "n", "hot"],
                        )
                    rows, hashes, lengths = [], [], []

    return run


class GroupIndex:
    """The inverted lists of some documents, ordered by set size, and the T-occurrence search in them."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), int(ids[i])))
        self.ids, self.sets, self.percent = ids[order], [sets[i] for i in order], percent
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        owner = np.repeat(np.arange(len(order)), self.sizes)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        by_hash = np.argsort(every, kind="stable")
        every, self.docs = every[by_hash], owner[by_hash]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        number = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), len(every))
        # Postings as one sorted key, so that a probe is a binary search.
        self.keys = number * len(order) + self.docs
        own = np.empty(len(every), np.int64)
        own[by_hash] = number
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.lists = [own[a:b] for a, b in zip(ends, ends[1:])]
        self.posted = self.docs.tolist()

    def merge_skip(self, lists: np.ndarray, x: int, need: int) -> dict[int, int]:
        """Documents before ``x`` that at least ``need`` of the lists hold, with their counts.

        A heap holds the head of every list. Where too few heads are equal, all but the last
        list that matters jump to the next head by binary search.
        """
        posted, place, ends, heap, counts = self.posted, {}, {}, [], {}
        for n, (a, b) in enumerate(zip(self.starts[lists].tolist(), self.starts[lists + 1].tolist())):
            if posted[a] < x:
                place[n], ends[n] = a, bisect_left(posted, x, a, b)
                heap.append((posted[a], n))
        heapify(heap)
        while len(heap) >= need:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heappop(heap)[1])
            if len(popped) >= need:
                counts[top] = len(popped)
                goal = top + 1
            else:
                while heap and len(popped) < need - 1:
                    popped.append(heappop(heap)[1])
                if not heap:
                    break
                goal = heap[0][0]
            for n in popped:
                at = place[n] = bisect_left(posted, goal, place[n], ends[n])
                if at < ends[n]:
                    heappush(heap, (posted[at], n))
        return counts

    def edges(self) -> list[tuple[int, int]]:
        """Links that join what belongs together: pairs already joined are not tested again."""
        n, found, forest = len(self.ids), [], Forest(len(self.ids))
        for x in range(n):
            size = int(self.sizes[x])
            least = least_overlap(size, self.percent)
            lists = self.lists[x]
            lengths = self.starts[lists + 1] - self.starts[lists]
            lists, lengths = lists[lengths > 1], lengths[lengths > 1]
            if size == 0 or len(lists) < least:
                continue
            order = np.argsort(lengths, kind="stable")
            lists, lengths = lists[order], lengths[order]
            n_long = min(least - 1, int(least / (_MU * math.log2(max(2, int(lengths[-1]))) + 1)))
            short, probed = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
            counts = self.merge_skip(short, x, least - n_long)
            for y in sorted(counts, key=lambda y: (-counts[y], y)):
                if self.sizes[y] < least or forest.find(x) == forest.find(y):
                    continue
                keys = probed * n + y
                place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                overlap = counts[y] + int((self.keys[place] == keys).sum())
                if 100 * overlap >= self.percent * (size + int(self.sizes[y]) - overlap):
                    forest.union(x, y)
                    found.append((int(self.ids[x]), int(self.ids[y])))
        return found


def _search(size: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        column = rows["text"].combine_chunks()
        column = column.cast(pa.large_string())
        sets = [s for _, s in shingle_sets(column, size)]
        edges = GroupIndex(rows["id"].to_numpy(), sets, percent).edges()
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _count_shingles(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for row, found in shingle_sets(batch.column(batch.schema.get_field_index("text")), size):
                sizes[row] = len(found)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes)], [*names, "n_shingles"])

    return run


def candidate_groups(docs: DataFrame, size: int, percent: int, hot_list: int) -> DataFrame:
    """(node, component) of the documents (id, text) that share a kept shingle with another; step 1."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_buckets(docs.select("text"), size, percent, hot_list))
    postings = docs.mapInArrow(_postings(size, percent, hot), "h long, id long, n int, hot boolean")
    counted = postings.where(~F.col("hot")).withColumn("df", F.count("*").over(Window.partitionBy("h")))
    if hot.value.any():
        summed = postings.where("hot").groupBy("h").agg(F.count("*").alias("df")).hint("rebalance")
        counted = counted.unionByName(postings.where("hot").join(summed, "h"))
    # t of the least partner, as taken() has it.
    size_y = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    least = F.floor((F.lit(percent) * size_y + 99) / 100)
    need = F.least(least, F.greatest(size_y - least + 1, F.lit(LEAST_SHARED)))
    shared = counted.where("df > 1").drop("hot")
    by_id = Window.partitionBy("id")
    kept = (
        shared.withColumn("c", F.count("*").over(by_id)).withColumn("place", F.row_number().over(by_id.orderBy("df", "h")))
        .where((F.col("c") >= need) & (F.col("place") <= F.col("c") - need + 1)).select("h", "id")
    )
    kept = stored(kept, "jaccard-kept")
    first = kept.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first").hint("rebalance")
    return connected_components(kept.join(first, "h").where("id > first").select("id", "first").distinct(), "id", "first")


def linked_components(docs: DataFrame, size: int = 5, percent: int = 80, hot_list: int = 20_000, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(node, component) of the documents (id, text; ids not null) that link with another one."""
    groups = stored(candidate_groups(docs, size, percent, hot_list).withColumnRenamed("node", "id"), "jaccard-groups")
    # Members grow with the documents, so they are merged at any size and never broadcast.
    members = docs.join(groups.hint("merge"), "id").select("id", "component", "text")
    weight = F.octet_length("text") / 6 + 1  # about one shingle for six bytes
    members = stored(members.withColumn("weight", weight.cast("long")), "jaccard-members")
    sizes = members.groupBy("component").agg(F.sum("weight").alias("total"), F.count("*").alias("docs"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("total") / group_shingles).cast("int")), "jaccard-sizes")
    small = sizes.where("parts <= 1").agg(F.sum("total")).first()[0] or 0
    bundles = max(1, -(-int(small) // group_shingles))
    # Small groups are bundled; a part of a large one holds its share of documents and some that all parts hold.
    placed = members.join(sizes, "component")
    common = (F.col("id") == F.col("component")) | (F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.expr("docs div 8"))) == 0)
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("parts")).cast("int")
    dealt = placed.select(
        "id", "text", F.when(F.col("parts") > 1, F.col("component")).otherwise(F.lit(-1)).alias("g"),
        F.explode(
            F.when(F.col("parts") <= 1, F.array(F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("int")))
            .when(common, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
        ).alias("part"),
    )
    edges = stored(dealt.groupBy("g", "part").applyInArrow(_search(size, percent), "a long, b long"), "jaccard-edges")
    joined = stored(connected_components(edges), "jaccard-joined")
    rest = _unsettled(members, sizes, joined)
    if rest is None:
        return joined
    more = _across(members, sizes, rest, size, percent, group_shingles)
    return connected_components(edges.unionAll(more))


def _unsettled(members: DataFrame, sizes: DataFrame, joined: DataFrame) -> DataFrame | None:
    """Of groups in several parts, the documents outside the group's largest joined class; None without any."""
    if sizes.where("parts > 1").isEmpty():
        return None
    label = members.join(sizes.where("parts > 1"), "component").join(joined.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left")
    label = stored(label.select("id", "component", "weight", F.coalesce("label", "id").alias("label")), "jaccard-labels")
    largest = label.groupBy("component", "label").count().groupBy("component").agg(F.max(F.struct("count", "label")).alias("top"))
    rest = label.join(largest.select("component", F.col("top.label").alias("top")).hint("rebalance"), "component").where("label <> top").select("id", "component", "weight")
    rest = stored(rest, "jaccard-rest")
    return None if rest.isEmpty() else rest


def _across(members: DataFrame, sizes: DataFrame, rest: DataFrame, size: int, percent: int, group_shingles: int) -> DataFrame:
    """Edges of the unsettled documents, in blocks, against all parts of their group."""
    blocks = rest.groupBy("component").agg(F.ceil(F.sum("weight") / group_shingles).cast("int").alias("blocks"))
    plan = stored(sizes.join(blocks, "component").select("component", "parts", "blocks"), "jaccard-plan")
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.col("blocks")).cast("int")
    all_parts, all_blocks = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    indexed = members.join(plan, "component").select("id", "text", "component", part.alias("part"), F.explode(all_blocks).alias("block"))
    asked = (
        members.join(rest.select("id"), "id").join(plan, "component")
        .select("id", "text", "component", F.explode(all_parts).alias("part"), block.alias("block"), part.alias("own"))
        .where("part <> own").drop("own")
    )
    return stored(indexed.unionAll(asked).groupBy("component", "part", "block").applyInArrow(_search(size, percent), "a long, b long"), "jaccard-edges")


def _largest_copies(marked: DataFrame) -> DataFrame:
    """(digest, rep) of the largest groups of exact copies, at most ``COPY_GROUPS``, each with its least id.

    Groups are tallied by the power of two of their size, and whole powers are taken from the top.
    """
    groups = marked.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    groups = stored(groups.withColumn("power", F.floor(F.log2("copies")).cast("int")), "jaccard-copies")
    tally = {r["power"]: r["count"] for r in groups.groupBy("power").count().collect()}  # at most 63 rows
    least, total = 64, 0
    for power in sorted(tally, reverse=True):
        total += tally[power]
        if total > COPY_GROUPS:
            break
        least = power
    return groups.where(F.col("power") >= least).select("digest", "rep")


def _linked(rows: DataFrame, size: int, percent: int, hot_list: int, group_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest of each row (id, text) with words, copies (digest, rep), linked documents (rep, component))."""
    worded = rows.where(F.col("id").isNotNull() & F.col("text").rlike(_FILLED))
    marked = stored(worded.select("id", digest("text").alias("digest")), "jaccard-digests")
    copies = _largest_copies(marked)
    single = (
        worded.withColumn("digest", digest("text")).join(F.broadcast(copies), "digest", "left")
        .where("rep IS NULL OR rep = id").select("id", "text")
    )
    joined = linked_components(single, size, percent, hot_list, group_shingles).select(F.col("node").alias("rep"), "component")
    return marked, copies, stored(joined, "jaccard-classes")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, hot_list: int = 20_000, group_shingles: int = GROUP_SHINGLES, id_column: str = "doc_id"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the least id reachable by links."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), "text")
    _, copies, joined = _linked(rows, size, percent, hot_list, group_shingles)
    counted = (
        rows.withColumn("digest", digest("text")).mapInArrow(_count_shingles(size, ["id", "digest"]), "id long, digest binary, n_shingles long")
        .join(F.broadcast(copies), "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    )
    out = counted.join(joined, "rep", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


_REPEATED_FROM = 1 << 62  # keys of rows whose id is not theirs alone; they come after all ids below


def _keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The documents with a key that tells rows apart, and whether any key is not the row's id.

    It is the id where no other row has it, and else made of text and id, so that only rows equal
    in both share one.
    """
    own = F.col("doc_id").cast("long")
    shared = docs.groupBy(own.alias("doc_id")).count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(key))
    shared = stored(shared, "jaccard-shared-ids")
    if shared.isEmpty():
        return docs.withColumn(key, own), False
    made = F.xxhash64(digest("text"), own).bitwiseAND(F.lit(_REPEATED_FROM - 1)) + F.lit(_REPEATED_FROM)
    joined = docs.join(shared, own == F.col(key), "left")
    return joined.withColumn(key, F.when(own.isNull() | F.col(key).isNotNull(), made).otherwise(own)), True


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns; rows are judged by their text.

    The row with the least id stays; rows whose id is null or repeats come after the others. Of rows
    equal in text and id one stays; rows of one id but unlike texts are judged apart. Rows without words stay.
    """
    key = free_name(docs, "_key")
    keyed, some_shared = _keyed(docs, key)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed.select(F.col(key).alias("id"), "text")
    marked, copies, joined = _linked(rows, size, percent, 20_000, GROUP_SHINGLES)
    copied = marked.join(F.broadcast(copies), "digest").where("id <> rep").select("id")
    gone = copied.unionAll(joined.where("rep <> component").select("rep")).distinct().select(F.col("id").alias(key))
    # What goes grows with the documents, so it is merged at any size and never broadcast.
    kept = keyed.join(stored(gone, "jaccard-gone").hint("merge"), key, "left_anti")
    if some_shared:
        again = F.coalesce((F.col(key) >= _REPEATED_FROM) & F.col("text").rlike(_FILLED), F.lit(False))
        kept = kept.where(~again).unionAll(kept.where(again).dropDuplicates([key]))
    return kept.select(*names)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), p AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT s.doc_id, len(sh) AS n_shingles, (SELECT min(r) FROM reach WHERE d = s.doc_id) AS component_id FROM s
"""

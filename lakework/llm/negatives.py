"""Hard-negative mining by Kronecker-packed products.

Scores are inner products of vectors of integers. The components of several candidates are made
non-negative by a bias and packed as the fields of one wide integer per component. An anchor's
component multiplies that integer once, the sum over the components holds the scores of all packed
candidates side by side, and masks and shifts unpack them, exact after the bias is taken off. The
wide integer lives in the 53-bit significand of a double, so the sums run as one matrix product; a
field is wide enough for the largest sum, so nothing carries over. Where one field would not fit,
anchors are split into digits, each multiplied on its own.

The anchors are the stated query set and meet all rows once for their positives and once for the
negatives in the positives' bands. Both sides are dealt out as a grid: rows over chunks by a hash
of the row, anchors over blocks of at most ``BLOCK_ANCHORS``, and a cell of the grid scores one
block against one chunk, whose rows stream past the anchors. Only the best few of each cell leave
it. Nothing passes through the driver but counts, and no task grows beyond a chunk.

Defined cases: a row with a null id, label or vector, or a null or non-finite component, takes no
part, nor does one whose squared length in integers is 2^55 or more (its scores times 100 would
leave 64 bits). Vectors of different length have no score; empty ones score 0 with each other. A
row with an anchor's id is not its positive. Equal anchor rows count as one anchor; unequal ones
with one id are mined each for itself. Repeated rows are separate candidates; ties go to the
smaller id. Empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakework.llm.common import stored, table

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
LARGEST = 1 << 55
BLOCK_ANCHORS = 1 << 16
CHUNK_ROWS = 1 << 20
_LEAST_CHUNK = 1 << 11
_TILE = 1 << 10
_SIGNIFICAND = 53
_MOST_TASKS = 1 << 16


class PackedRows:
    """Rows of integers, packed as fields of wide integers; ``fields`` of them share one."""

    def __init__(self, rows: np.ndarray, anchor_range: int) -> None:
        self.n, self.dim = rows.shape
        self.bias = int(rows.min(initial=0))
        biased = rows - self.bias
        self.sums = biased.sum(axis=1)
        largest = max(int(biased.max(initial=0)), 1)
        terms = max(self.dim, 1)
        # The largest digit of an anchor's component with which a field still fits.
        self.digit = max(1, min(anchor_range.bit_length(), _SIGNIFICAND - (largest * terms).bit_length()))
        self.width = (largest * terms * ((1 << self.digit) - 1)).bit_length()
        self.fields = max(1, _SIGNIFICAND // self.width)
        wide = np.zeros((-(-self.n // self.fields), self.dim), np.int64)
        for k in range(self.fields):
            own = biased[k :: self.fields]
            wide[: len(own)] += own << (k * self.width)
        self.wide = wide.astype(np.float64).T.copy()

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products: a row per anchor, a column per packed row."""
        bias = int(anchors.min(initial=0))
        biased = anchors - bias
        found = np.zeros((len(anchors), self.wide.shape[1] * self.fields), np.int64)
        shift = 0
        while shift == 0 or (biased >> shift).any():
            digits = (biased >> shift) & ((1 << self.digit) - 1)
            product = (digits.astype(np.float64) @ self.wide).astype(np.int64)
            for k in range(self.fields):
                found[:, k :: self.fields] += ((product >> (k * self.width)) & ((1 << self.width) - 1)) << shift
            shift += self.digit
        found = found[:, : self.n]
        # (x + bias)(y + bias) over all components, less what the biases add.
        return found + bias * self.sums + self.bias * biased.sum(axis=1)[:, None] + self.dim * bias * self.bias


class Best:
    """The best ``k`` (score, id) of every group, over any number of offers."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min)  # score a row needs once a group is full
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, groups: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Scores of distinct groups (rows) and candidates (columns, ids rising), of which only the allowed count."""
        none = np.iinfo(np.int64).min
        scores = np.where(allowed, scores, none)
        needed = self.least[groups]
        if scores.shape[1] > self.k:
            needed = np.maximum(needed, np.partition(scores, -self.k, axis=1)[:, -self.k])
        wanted = (scores >= needed[:, None]) & (scores > none)
        if wanted.sum() > 4 * self.k * len(groups):  # many equal scores, of which the first ids do
            equal = wanted & (scores == needed[:, None])
            wanted &= ~equal | (np.cumsum(equal, axis=1, dtype=np.int32) <= self.k)
        row, column = np.nonzero(wanted)
        if not len(row):
            return
        group = np.concatenate([self.group, groups[row]])
        score = np.concatenate([self.score, scores[row, column]])
        own = np.concatenate([self.id, ids[column]])
        order = np.lexsort((own, -score, group))
        group, score, own = group[order], score[order], own[order]
        starts = np.searchsorted(group, group)
        place = np.arange(len(group)) - starts
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], own[kept]
        last = place[kept] == self.k - 1
        self.least[self.group[last]] = self.score[last]


_FOUND = "dim int, anchor long, positive int, id long, score long"
_FOUND_NAMES = ["dim", "anchor", "positive", "id", "score"]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class _Cell:
    """One block of anchors against one chunk of rows."""

    def __init__(self, anchors: pa.Table, bands: bool, low: int, high: int, k: int) -> None:
        anchors = anchors.combine_chunks()
        self.dim = anchors["dim"][0].as_py()
        self.keys, self.ids, self.labels = (anchors[c].to_numpy() for c in ("anchor", "id", "label"))
        self.values = _matrix(anchors["v"].combine_chunks(), self.dim)
        self.range = int(self.values.max(initial=0)) - int(self.values.min(initial=0))
        self.bands = None
        if bands:
            lists = anchors["positive_scores"].combine_chunks()
            self.counts = np.asarray(lists.value_lengths())
            positives = lists.flatten().to_numpy()
            self.owner = np.repeat(np.arange(len(self.ids)), self.counts)
            self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
            self.bands = (-((-low * positives) // 100), (high * positives) // 100)
        self.best = Best(len(self.owner) if bands else len(self.ids), k)

    def offer(self, rows: pa.Table) -> None:
        rows = rows.sort_by("id").combine_chunks()
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        packed = PackedRows(_matrix(rows["v"].combine_chunks(), self.dim), self.range)
        for first in range(0, len(self.ids), _TILE):
            at = np.arange(first, min(first + _TILE, len(self.ids)))
            scores = packed.scores(self.values[at])
            same = self.labels[at][:, None] == labels[None, :]
            if self.bands is None:
                self.best.offer(at, scores, same & (self.ids[at][:, None] != ids[None, :]), ids)
                continue
            for number in range(int(self.counts[at].max(initial=0))):
                lines = np.flatnonzero((self.number == number) & (self.owner >= at[0]) & (self.owner <= at[-1]))
                own = self.owner[lines] - first
                inside = (scores[own] >= self.bands[0][lines][:, None]) & (scores[own] <= self.bands[1][lines][:, None])
                self.best.offer(lines, scores[own], inside & ~same[own], ids)

    def result(self) -> pa.RecordBatch:
        best = self.best
        owner = best.group if self.bands is None else self.owner[best.group]
        number = np.zeros(len(owner), np.int32) if self.bands is None else self.number[best.group].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(owner), self.dim), pa.int32()), pa.array(self.keys[owner]), pa.array(number), pa.array(best.id), pa.array(best.score)],
            _FOUND_NAMES,
        )


def _score_cells(bands: bool, low: int, high: int, k: int):
    """Cells stand together and sorted, their anchors first; rows stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "block", "chunk", "side")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(marks)]):
                now = tuple(marks[start][:3])
                if now != key:
                    if cell is not None:
                        yield cell.result()
                    key, anchors, cell = now, [], None
                part = batch.slice(start, stop - start)
                if marks[start][3] == 0:
                    anchors.append(part)
                elif anchors or cell is not None:
                    if cell is None:
                        cell, anchors = _Cell(pa.Table.from_batches(anchors), bands, low, high, k), []
                    for first in range(0, part.num_rows, 4 * _TILE):
                        cell.offer(pa.Table.from_batches([part.slice(first, 4 * _TILE)]))
        if cell is not None:
            yield cell.result()

    return run


def _best(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    ranked = Window.partitionBy(*groups).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | str = "label", id_column: str = "vec_id", column: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the rows of ``vectors``, ``label`` a column or an expression. The
    components are floor(``scale`` * x); a negative's score is at least ``low`` and at most ``high``
    percent of the positive's.
    """
    spark = vectors.sparkSession
    value = F.col(f"`{column}`")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * scale))
    squares = F.aggregate(value, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    told = F.col(label) if isinstance(label, str) else label
    rows = (
        vectors.where(F.col(f"`{id_column}`").isNotNull() & value.isNotNull() & finite)
        .where(squares < float(LARGEST))
        .select(
            F.col(f"`{id_column}`").cast("long").alias("id"), told.cast("long").alias("label"),
            scaled.cast("array<int>").alias("v"), F.size(value).alias("dim"), F.coalesce(anchors, F.lit(False)).alias("asks"),
        )
        .where("label IS NOT NULL")
    )
    rows = stored(rows, "negatives-rows")
    asking = rows.where("asks").select("dim", "id", "label", "v").distinct().withColumn("anchor", F.xxhash64("id", "label", "v"))
    asking = stored(asking, "negatives-anchors")
    n, asked = rows.count(), asking.count()
    blocks = max(1, -(-asked // BLOCK_ANCHORS))
    chunks = max(1, -(-n // CHUNK_ROWS), min(-(-n // _LEAST_CHUNK), 2 * spark.sparkContext.defaultParallelism))

    def scored(asking: DataFrame, bands: bool, k: int) -> DataFrame:
        """The best of every cell of the grid."""
        empty = F.lit(None).cast("array<long>")
        block, chunk = F.pmod("anchor", F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", "label", "v"), F.lit(chunks)).cast("int")
        left = asking.select(
            "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("side"),
            "anchor", "id", "label", "v", (F.col("positive_scores") if bands else empty).alias("positive_scores"),
        )
        right = rows.select(
            "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk"), F.lit(1).alias("side"),
            F.lit(0).cast("long").alias("anchor"), "id", "label", "v", empty.alias("positive_scores"),
        )
        keys = ["dim", "block", "chunk"]
        grid = left.unionAll(right).repartition(min(blocks * chunks, _MOST_TASKS), *keys).sortWithinPartitions(*keys, "side")
        return grid.mapInArrow(_score_cells(bands, low, high, k), _FOUND)

    near = stored(_best(scored(asking, False, positives), ["dim", "anchor"], positives), "negatives-positives")
    lists = near.groupBy("dim", "anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    banded = asking.join(lists, ["dim", "anchor"]).select("*", F.col("p.score").alias("positive_scores"), F.col("p.id").alias("positive_ids"))
    banded = stored(banded.drop("p"), "negatives-bands")
    found = _best(scored(banded, True, negatives), ["dim", "anchor", "positive"], negatives)
    named = banded.select("dim", "anchor", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("positive_ids", "positive_scores")).alias("positive", "p"))
    return found.join(named, ["dim", "anchor", "positive"]).select(
        "anchor_id", F.col("p.positive_ids").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.positive_scores").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

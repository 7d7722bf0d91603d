"""Near duplicates among embeddings by binary codes of random rotations.

Every distinct vector, scaled to length one, is encoded once: rotated by a few random orthogonal
matrices, and the signs are kept, packed to bits. The code stands for a direction, the signs
turned back; the cosine between it and the vector is stored with the code as its correction
factor. The cosine of two codes' directions, divided by both factors, estimates that of the
vectors without bias. How far it can be off is certain: a factor is the cosine of the angle by
which the direction misses its vector, so two vectors within the threshold's angle have directions
within that angle and both their misses. Only codes travel to find what may link. Raw vectors
follow for those alone that have a pair within the bound, and such pairs are computed anew in
double precision, so no reported link depends on an estimate.

Candidates come from an exact cover, so no link is lost. Every vector is at home in the cell of the
nearest of a few sampled pivots. Two vectors within the threshold's angle of each other differ by no
more than that angle in their distance to any pivot, so each visits every other cell whose pivot is
at most twice the angle farther than its own; the two meet in the bucket of their cells, and only
there. Where distances to the pivots hardly differ, as among random vectors of many dimensions, this
compares all codes. A cell above four times ``BUCKET_ROWS`` is dealt out over parts, so none is ever
cut off and no task holds one whole.

Equal vectors are one class with a count from the start; links to and among copies are counted.

Defined cases: a vector that is null, empty or zero, or holds a null or non-finite number, links
with nothing and is its own component. Vectors of different length do not link. Repeated rows with
one id count as separate vectors. A row with a null id is returned, but neither links nor counts.
An empty table gives an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import stored, table
from lakework.llm.components import Forest, connected_components

BUCKET_ROWS = 8192
PIVOTS = 4096
CODE_BITS = 6  # for each dimension
_TILE = 512
_MOST_TASKS = 1 << 16
_SLACK = 1e-5
_ANGLE_SLACK = 1e-3


def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrices one above the other, scaled so that a unit vector stays one."""
    random = np.random.default_rng([seed, dim])
    stack = []
    for _ in range(max(1, -(-bits // dim))):
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        stack.append(q * np.sign(np.diag(r)))
    return (np.concatenate(stack) / math.sqrt(len(stack))).astype(np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(codes: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The unit vectors that packed codes stand for."""
    signs = np.unpackbits(codes, axis=1, count=rotation.shape[0]).astype(np.float32) * 2 - 1
    turned = signs @ rotation
    return turned / np.maximum(np.sqrt((turned * turned).sum(axis=1, keepdims=True)), np.float32(1e-30))


def encode(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of unit vectors and their correction factors, the cosines of direction and vector."""
    codes = np.packbits(unit.astype(np.float32) @ rotation.T >= 0, axis=1)
    return codes, (directions(codes, rotation) * unit).sum(axis=1)


def estimates(direction: np.ndarray, factor: np.ndarray, other: np.ndarray, other_factor: np.ndarray) -> np.ndarray:
    """Estimates of the cosines of vectors from their codes' directions and factors."""
    return (direction @ other.T) / (factor[:, None] * other_factor[None, :])


def bounded(direction: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices; where a row of the first times one of the second is not below -slack, the pair may reach ``threshold``.

    The product is the cosine of the directions less that of the widest angle between them, that of
    the threshold and both misses. Rows that leave no bound with the widest miss here pass with all.
    """
    miss = np.arccos(np.clip(factor.astype(np.float64), -1, 1)) + _SLACK
    wide = math.acos(max(-1.0, min(1.0, threshold))) + miss
    held = wide + miss.max(initial=0) <= math.pi
    left = np.concatenate([direction, -np.cos(wide)[:, None], np.sin(wide)[:, None]], axis=1)
    right = np.concatenate([direction, np.cos(miss)[:, None], np.sin(miss)[:, None]], axis=1)
    left[~held] = 0
    return left.astype(np.float32), right.astype(np.float32)


class Bucket:
    """The codes of one bucket, by side; ``side`` parts it in two of which only pairs across count, one value means all pairs."""

    def __init__(self, codes: np.ndarray, factor: np.ndarray, side: np.ndarray, rotation: np.ndarray, threshold: float) -> None:
        self.order = np.argsort(side, kind="stable")
        side = side[self.order]
        self.both = bool(side[0] != side[-1])
        self.split = int(np.searchsorted(side, side[-1])) if self.both else len(side)
        self.left, self.right = bounded(directions(codes[self.order], rotation), factor[self.order], threshold)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``order`` of the pairs that the bound leaves, a tile at a time."""
        for first in range(0, self.split, _TILE):
            last = min(self.split, first + _TILE)
            start = self.split if self.both else first
            a, b = np.nonzero(self.left[first:last] @ self.right[start:].T >= -_SLACK)
            a, b = a + first, b + start
            yield (a, b) if self.both else (a[a < b], b[a < b])


def link_bucket(bucket: Bucket, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each class in this bucket (counting copies), and edges that span the links found."""
    n = len(ids)
    ids, copies, unit = ids[bucket.order], copies[bucket.order], unit_rows(raw[bucket.order])
    links, forest, edges = np.zeros(n, np.int64), Forest(n), []
    for a, b in bucket.pairs():
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            near = (unit[x] * unit[y]).sum(axis=1) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            edges += [(int(ids[i]), int(ids[j])) for i, j in zip(x.tolist(), y.tolist()) if forest.union(i, j)]
    back = np.empty(n, np.int64)
    back[bucket.order] = links
    return back, edges


def visited_cells(unit: np.ndarray, pivots: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of every unit vector, mask of the cells in which it may have links, its own among them)."""
    if pivots is None:
        return np.zeros(len(unit), np.int64), np.ones((len(unit), 1), bool)
    angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    home = angles.argmin(axis=1)
    widest = angles[np.arange(len(unit)), home] + 2 * math.acos(max(-1.0, min(1.0, threshold))) + _ANGLE_SLACK
    return home, angles <= widest[:, None]


def _vector_batches(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dimension, rows, their vectors as a matrix) of every batch, in parts of 1024 rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            column = part.column(part.schema.get_field_index("v"))
            lengths = np.diff(np.asarray(column.offsets))
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for dim in map(int, np.unique(lengths)):
                rows = np.flatnonzero(lengths == dim)
                yield dim, part.take(pa.array(rows)), values[(ends[rows][:, None] + np.arange(dim)[None, :])].astype(dtype)


def _code_bits(dim: int) -> int:
    return max(64, CODE_BITS * dim)


def _encode_batches(dtype: str, pivots: dict[int, np.ndarray], threshold: float):
    """Every class once: its dimension, home, code and factor, and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for dim, part, raw in _vector_batches(batches, dtype):
            if dim not in known:
                known[dim] = rotations(dim, _code_bits(dim))
            unit = unit_rows(raw)
            codes, factor = encode(unit, known[dim])
            home, mask = visited_cells(unit, pivots.get(dim), threshold)
            ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32()))
            kept = (part.column(part.schema.get_field_index(c)) for c in ("rep", "cls", "copies"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(raw), dim), pa.int32()), pa.array(home, pa.int32()), cells, *kept,
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor, pa.float64())],
                ["dim", "home", "cells", "rep", "cls", "copies", "code", "factor"],
            )

    return run


_KEY = ("dim", "low", "high")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Buckets stand together and sorted; each is given as soon as its last row has come, if it can hold a pair."""

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        side = rows["side"].to_numpy()
        if rows.num_rows > 1 and (rows["low"][0] == rows["high"][0] or side.min() != side.max()):
            yield rows

    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _KEY], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
            key = tuple(keys[start])
            if held and key != held_key:
                yield from whole(held)
                held = []
            held.append(batch.slice(start, stop - start))
            held_key = key
    if held:
        yield from whole(held)


class _Codes:
    """Reads buckets from tables of codes, with the rotations it has made."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.known = threshold, {}

    def bucket(self, rows: pa.Table) -> Bucket:
        dim = rows["dim"][0].as_py()
        if dim not in self.known:
            self.known[dim] = rotations(dim, _code_bits(dim))
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        return Bucket(codes, rows["factor"].to_numpy(), rows["side"].to_numpy(), self.known[dim], self.threshold)


def _near_batches(threshold: float):
    """Of every bucket the rows that have a pair within the bound; no pair leaves the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(threshold)
        for rows in _buckets(batches):
            bucket = codes.bucket(rows)
            near = np.zeros(rows.num_rows, bool)
            for a, b in bucket.pairs():
                near[a], near[b] = True, True
            yield from rows.take(pa.array(np.sort(bucket.order[near]))).to_batches()

    return run


def _link_batches(dtype: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(threshold)
        for rows in _buckets(batches):
            ids, vectors = rows["rep"].to_numpy(), rows["v"].combine_chunks()
            raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(rows.num_rows, -1)
            links, edges = link_bucket(codes.bucket(rows), ids, rows["copies"].to_numpy(), raw, threshold)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.nulls(len(hit), pa.int64()), pa.array(links[hit])], ["a", "b", "links"]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64()), pa.array([0] * len(edges), pa.int64())],
                    ["a", "b", "links"],
                )

    return run


def _pivots_wanted(n: int, parallelism: int) -> int:
    """Pivots enough for buckets of a bounded size, and for twice as many buckets as tasks run at once."""
    least = math.ceil((math.sqrt(1 + 16 * parallelism) - 1) / 2)
    return min(PIVOTS, max(1, min(least, n // 64), -(-n // (2 * BUCKET_ROWS))))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; see the module for the method and the defined cases."""
    kind = vectors.schema[column].dataType.elementType.typeName()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v"))
    if kind not in ("float", "double"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    classes = stored(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("cls", F.xxhash64("v")), "vector-classes")
    n = classes.count()
    wanted = _pivots_wanted(n, vectors.sparkSession.sparkContext.defaultParallelism)
    sampled: dict[int, list[list[float]]] = {}
    for row in classes.orderBy(F.xxhash64("v", "rep"), "rep").select("v").limit(wanted).collect():  # at most PIVOTS
        sampled.setdefault(len(row["v"]), []).append(row["v"])
    pivots = {dim: unit_rows(np.array(v)) for dim, v in sampled.items()}
    coded = classes.mapInArrow(
        _encode_batches(dtype, pivots, threshold), "dim int, home int, cells array<int>, rep long, cls long, copies long, code binary, factor double"
    )
    coded = stored(coded, "vector-codes")
    homes = coded.groupBy("dim", "home").count()
    large = stored(homes.where(F.col("count") > 4 * BUCKET_ROWS).withColumn("parts", F.ceil(F.col("count") / (2 * BUCKET_ROWS))), "vector-cells")
    parts = large.select("dim", "home", "parts"), large.select("dim", F.col("home").alias("cell"), F.col("parts").alias("others"))
    keyed = coded.withColumn("cell", F.explode("cells")).drop("cells")
    parted = keyed.withColumn("parts", F.lit(1)).withColumn("others", F.lit(1))
    if not large.isEmpty():
        parted = keyed.join(parts[0], ["dim", "home"], "left").join(parts[1], ["dim", "cell"], "left")
        parted = parted.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "others")})
    # A part of a cell is the cell's number times 2 ** 32 and the number of the part.
    number = lambda cell, part: F.shiftleft(F.col(cell).cast("long"), 32) + part
    parted = parted.withColumn("side", number("home", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    parted = parted.withColumn("other", number("cell", F.col("other")))
    met = parted.select("dim", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "cls", "copies", "code", "factor")
    # Few buckets may be much work, so their number, not their bytes, tells how many tasks there are.
    tasks = min(_MOST_TASKS, 3 * wanted * (wanted + 1) // 2)
    dealt = met.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY)
    near = stored(dealt.mapInArrow(_near_batches(threshold), met.schema), "vector-near")
    raw = near.join(classes.select("rep", "cls", "v"), ["rep", "cls"]).repartition(tasks, *_KEY).sortWithinPartitions(*_KEY)
    found = stored(raw.mapInArrow(_link_batches(dtype, threshold), "a long, b long, links long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("b IS NOT NULL"))
    told = (
        classes.drop("cls").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    # Written, so that the join below has an exchange on either side and a common vector can be split.
    joined = good.select("id", "v").join(stored(told, "vector-told"), "v").select(
        "id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id")
    )
    out = joined.unionAll(rows.where(~F.col("usable")).select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, edges.y FROM reach JOIN edges ON edges.x = reach.r),
found AS (SELECT vec_id, (SELECT count(*) FROM edges WHERE x = vec_id) AS n_links, (SELECT min(r) FROM reach WHERE d = vec_id) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

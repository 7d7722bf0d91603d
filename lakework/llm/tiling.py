"""Benchmark decontamination: greedy string tiling of every document against the benchmark items.

Karp-Rabin hashes of runs of ``min_match`` tokens are the seeds. A document and an item that share
seeds are tiled: matches are extended along their diagonals, the longest match whose tokens are
all free is marked again and again, and one that is partly taken is cut to its free stretches. The
share of an item's tokens that tiles cover does not depend on their order, so passages that were
reordered or interrupted are caught.

Tokens are runs of ASCII letters, digits and non-ASCII characters other than white space and
punctuation, lower-cased; a script that sets no spaces gives one token a phrase. The benchmark is
the stated query set: it goes to the executors in blocks of a bounded size (``block_bytes``), one
pass over the documents for each block, so its size is never a limit.

Defined cases: a null text has no tokens. An item shorter than ``min_match`` tokens matches only a
document that has its tokens and no others; one without tokens matches nothing. An item with a null
id is not in the pairs, but judges documents in ``keep_uncontaminated``. Repeated rows and items are reported row by row.
Ties between matches go to the earlier one in the document, then in the item. Empty tables give
an empty result. Other columns than id and text are not read by the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import slices, stored, table, text_bytes, window_hashes, word_hashes

MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
PROBED = 4  # places of a block that a seed may stand in and be probed in any case
CHAIN = 4  # blocks of items that one job of keep_uncontaminated asks for

_OTHER_SEPARATORS = "[\u0085\\p{Z}\\p{P}]"
SEPARATOR = np.ones(256, bool)
for _first, _last in ((48, 58), (97, 123), (128, 256)):
    SEPARATOR[_first:_last] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and the row of each token."""
    texts = pc.utf8_lower(texts)
    wide = pc.invert(pc.string_is_ascii(texts)).fill_null(False)
    if wide.true_count:
        texts = pc.replace_with_mask(texts, wide, pc.replace_substring_regex(texts.filter(wide), _OTHER_SEPARATORS, " "))
    data, offsets = text_bytes(texts)
    hashes, rows, _, _ = word_hashes(data, offsets, SEPARATOR)
    return hashes, rows


def greedy_tiles(doc: np.ndarray, item: np.ndarray, seeds: Sequence[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length) from the seeds' positions (document, item)."""
    pairs = np.array(sorted(set(seeds), key=lambda s: (s[0] - s[1], s[0])), np.int64).reshape(-1, 2)
    if not len(pairs):
        return []
    diagonal = pairs[:, 0] - pairs[:, 1]
    new = np.ones(len(pairs), bool)
    new[1:] = (np.diff(diagonal) != 0) | (np.diff(pairs[:, 0]) != 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(pairs)))
    matches = [(-(int(n) + width - 1), int(pairs[f, 0]), int(pairs[f, 1])) for f, n in zip(first, run)]
    heapq.heapify(matches)
    doc_taken: set[int] = set()
    item_free = np.ones(len(item), bool)
    tiles = []
    while matches and item_free.any():
        length, i, j = heapq.heappop(matches)
        length = -length
        free = item_free[j : j + length].copy()
        if doc_taken:
            free &= np.fromiter((i + k not in doc_taken for k in range(length)), bool, length)
        if free.all():
            tiles.append((i, j, length))
            doc_taken.update(range(i, i + length))
            item_free[j : j + length] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= width:
                heapq.heappush(matches, (-int(b - a), i + int(a), j + int(a)))
    return tiles


class SeedIndex:
    """The seeds of a block of items, as sorted arrays behind a small bit table.

    An item is probed through its rare seeds only. Seeds that many items share are left out as long
    as all that are left out cover less of the item than the threshold asks for: a document that
    reaches the threshold then holds a probed seed as well, and a stem that is common to thousands of
    items is never paired out.
    """

    def __init__(self, ids: pa.Array | Sequence[int], texts: pa.Array | Sequence[str | None], min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> None:
        self.ids = ids if isinstance(ids, pa.Array) else pa.array(list(ids), pa.int64())
        self.min_match, self.threshold, n = min_match, threshold, len(self.ids)
        texts = texts if isinstance(texts, pa.Array) else pa.array([t or "" for t in texts], pa.large_string())
        parts = [(first, *tokens(texts.slice(first, last - first))) for first, last in slices(text_bytes(texts)[1])]
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
        rows = np.concatenate([np.zeros(0, np.int64), *(p[2] + p[0] for p in parts)])
        self.starts = np.searchsorted(rows, np.arange(n + 1))
        self.sizes = np.diff(self.starts)
        at = np.arange(max(0, len(self.tokens) - min_match + 1))
        at = at[rows[at] == rows[at + min_match - 1]] if len(at) else at
        seeds = window_hashes(self.tokens, min_match)[at]
        owner = rows[at].astype(np.int32)
        order = np.argsort(seeds, kind="stable")
        seeds = seeds[order]
        new = np.ones(len(seeds), bool)
        new[1:] = seeds[1:] != seeds[:-1]
        ends = np.append(np.flatnonzero(new), len(seeds))
        shared = np.empty(len(seeds), np.int32)  # in how many places of the block each seed stands
        shared[order] = np.repeat(np.diff(ends), np.diff(ends))
        left_out = self._left_out(at, owner, shared)
        # What the seeds that are not probed cover of every item.
        self.hidden = self._covered(at[left_out], owner[left_out])
        probed = order[~left_out[order]]
        self.keys = seeds[~left_out[order]]
        self.item, self.place = owner[probed], (at[probed] - self.starts[owner[probed]]).astype(np.int32)
        self.bits = np.zeros(1 << max(10, (4 * len(self.keys)).bit_length()), bool)
        self.shift = np.uint64(64 - (len(self.bits).bit_length() - 1))
        self.bits[self.keys >> self.shift] = True
        short = np.flatnonzero((self.sizes > 0) & (self.sizes < min_match))
        self.short: dict[tuple[int, int], list[int]] = {}
        for i in short.tolist():
            self.short.setdefault(_whole(self.item_tokens(i)), []).append(i)

    def _covered(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many tokens of each item the seeds at the token positions ``at`` cover."""
        steps = np.bincount(at, minlength=len(self.tokens) + 1) - np.bincount(at + self.min_match, minlength=len(self.tokens) + 1)[: len(self.tokens) + 1]
        inside = np.concatenate([[0], np.cumsum(np.cumsum(steps[: len(self.tokens)]) > 0)])
        return inside[self.starts[1:]] - inside[self.starts[:-1]]

    def _left_out(self, at: np.ndarray, owner: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Which seeds need no probe: per item all above the least count that leaves less than the threshold uncovered."""
        left_out, settled = np.zeros(len(at), bool), np.zeros(len(self.sizes), bool)
        bound = PROBED
        while not settled.all() and (shared > bound).any():
            over = shared > bound
            fits = self._covered(at[over], owner[over]) < self.threshold * self.sizes
            own = fits & ~settled
            left_out |= over & own[owner]
            settled |= fits
            bound *= 4
        return left_out

    def item_tokens(self, n: int) -> np.ndarray:
        return self.tokens[self.starts[n] : self.starts[n + 1]]

    def candidates(self, seeds: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) of the pairs whose probed seeds may reach the threshold, with what the others could cover."""
        maybe = at[self.bits[seeds[at] >> self.shift]]
        low = np.searchsorted(self.keys, seeds[maybe], side="left")
        count = np.searchsorted(self.keys, seeds[maybe], side="right") - low
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            return []
        entry = np.arange(ends[-1]) + np.repeat(low - ends + count, count)
        pair = np.repeat(rows[maybe], count).astype(np.int64) * len(self.sizes) + self.item[entry]
        # Each place of an item counts once, however often the document repeats it.
        places = np.lexsort((self.place[entry], pair))
        pair, place = pair[places], self.place[entry][places]
        first = np.ones(len(pair), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
        pairs, hits = np.unique(pair[first], return_counts=True)
        item = pairs % len(self.sizes)
        able = hits * self.min_match + self.hidden[item] >= self.threshold * self.sizes[item]
        return [(int(p) // len(self.sizes), int(p) % len(self.sizes)) for p in pairs[able]]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item number, tiles) of every pair that reaches the threshold."""
        hashes, rows = tokens(texts)
        starts = np.searchsorted(rows, np.arange(len(texts) + 1))
        if self.short:
            for row in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < self.min_match)).tolist():
                own = hashes[starts[row] : starts[row + 1]]
                for n in self.short.get(_whole(own), ()):
                    yield row, n, [(0, 0, len(own))]
        seeds = window_hashes(hashes, self.min_match)
        if not len(seeds) or not len(self.keys):
            return
        at = np.arange(len(seeds))
        at = at[rows[at] == rows[at + self.min_match - 1]]
        seen, order, ordered = -1, at, seeds
        for row, n in self.candidates(seeds, at, rows):
            if row != seen:
                own = seeds[starts[row] : starts[row + 1] - self.min_match + 1]
                seen, order = row, np.argsort(own, kind="stable")
                ordered = own[order]
            item = self.item_tokens(n)
            wanted = window_hashes(item, self.min_match)
            low = np.searchsorted(ordered, wanted, side="left")
            count = np.searchsorted(ordered, wanted, side="right") - low
            reach = np.zeros(len(item) + 1, np.int64)
            np.add.at(reach, np.flatnonzero(count), 1)
            np.add.at(reach, np.flatnonzero(count) + self.min_match, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < self.threshold * len(item):
                continue
            ends = np.cumsum(count)
            places = order[np.arange(ends[-1]) + np.repeat(low - ends + count, count)]
            pairs = zip(places.tolist(), np.repeat(np.arange(len(wanted)), count).tolist())
            tiles = greedy_tiles(hashes[starts[row] : starts[row + 1]], item, list(pairs), self.min_match)
            if sum(t[2] for t in tiles) >= self.threshold * len(item):
                yield row, n, tiles


def _whole(own: np.ndarray) -> tuple[int, int]:
    return len(own), int(window_hashes(own, len(own))[0])


_FOUND = (
    ("item_id", "long", pa.int64()), ("item_tokens", "long", pa.int64()), ("matched_tokens", "long", pa.int64()),
    ("n_tiles", "long", pa.int64()), ("longest_tile", "long", pa.int64()), ("coverage", "double", pa.float64()),
    ("tiles", "array<struct<doc_token:bigint,item_token:bigint,length:bigint>>",
     pa.list_(pa.struct([("doc_token", pa.int64()), ("item_token", pa.int64()), ("length", pa.int64())]))),
)


def _blocks(benchmark: DataFrame, block_bytes: int, unnamed: bool = False) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The items in blocks of about ``block_bytes``, those with a null id if ``unnamed``; a block at a time is on the driver."""
    items = benchmark.where(F.lit(unnamed) | F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if rows.num_rows:
            rows = rows.combine_chunks()
            yield rows["item_id"].chunk(0), rows["text"].chunk(0)


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
    block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id",
) -> DataFrame:
    """One row per document and item of which tiles cover at least ``threshold``, with the tiles."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_column}`"), "text")
    schema = source.select(F.col(f"`{id_column}`"), *(F.lit(None).cast(kind).alias(name) for name, kind, _ in _FOUND)).schema
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(SeedIndex(ids, texts, min_match, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                column, keys = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index(id_column))
                _, offsets = text_bytes(column)
                for first, last in slices(offsets):
                    owner, rows = [], []
                    for row, n, tiles in index.search(column.slice(first, last - first)):
                        owner.append(first + row)
                        size, matched = int(index.sizes[n]), sum(t[2] for t in tiles)
                        listed = [{"doc_token": i, "item_token": j, "length": k} for i, j, k in tiles]
                        rows.append((index.ids[n].as_py(), size, matched, len(tiles), max(t[2] for t in tiles), matched / size, listed))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(owner, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(_FOUND))],
                            [id_column, *(n for n, _, _ in _FOUND)],
                        )

        out = out.unionAll(source.mapInArrow(run, schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no item contaminates, with their own columns. Rows are judged by their text, not by id.

    Blocks of items follow each other in one pass; beyond ``CHAIN`` of them what is left is written in between.
    """
    kept = docs
    for k, (ids, texts) in enumerate(_blocks(benchmark, block_bytes, unnamed=True)):
        if k and k % CHAIN == 0:
            kept = stored(kept, "uncontaminated")
        shared = docs.sparkSession.sparkContext.broadcast(SeedIndex(ids, texts, threshold=threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("text"))
                clean = np.ones(batch.num_rows, bool)
                _, offsets = text_bytes(column)
                for first, last in slices(offsets):
                    for row, _, _ in shared.value.search(column.slice(first, last - first)):
                        clean[first + row] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

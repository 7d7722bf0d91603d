"""Ranked lexical search over impact lists by the Best Position Algorithm.

A document's score for an item is a sum of impacts, one per term of the item that it holds. In a
block of documents every term has an impact list, its documents by falling impact. For an item the
lists are read in parallel from the top. A document met for the first time is looked up in every
other list by direct access, which gives its whole score and marks the positions it holds. The best
position of a list is the last one up to which all positions are seen; as direct accesses count, it
runs ahead of the last position read. The sum of the impacts at the best positions bounds every
document not met, and reading stops as soon as it lies strictly below the kth score, so that ties
at the kth place are all seen.

Spark holds the work: one pass counts terms and writes, per document, its length and the terms that
occur in the items with their counts; document frequencies are aggregated from that; a second pass
ranks blocks of documents, bounded by documents and by postings, and hands its kth scores on to the
next block of its task. Tasks send their k best per item to two ranked shuffles. The items are the
stated query set; they go out in blocks of ``block_bytes``, each with its own passes.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased;
terms are told apart by 64-bit hashes. The score is the contract's: integer weights from document
frequencies, counts saturated by the document's length against the mean.

Defined cases: a null, empty or term-free text has no score and does not count as a document. An
item without terms has no rows. Repeated rows are separate documents; each row of the items is
ranked for itself, also where ids repeat or are null. Equal scores go by rising id, null ids last.
Empty tables give an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakework.llm.common import slices, stored, table, text_bytes, word_hashes

TOP = 20
BLOCK_BYTES = 4 << 20
BLOCK_DOCUMENTS = 1 << 15
BLOCK_POSTINGS = 1 << 22
_FIRST_READ = 32

SEPARATOR = np.ones(256, bool)
for _first, _last in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    SEPARATOR[_first:_last] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and the row of each."""
    data, offsets = text_bytes(texts)
    hashes, rows, _, _ = word_hashes(_LOWER[data], offsets, SEPARATOR)
    return hashes, rows


class Items:
    """The terms of a block of items: the distinct ones, and per item its own with repeats."""

    def __init__(self, texts: pa.Array) -> None:
        hashes, rows = terms(texts)
        self.keys, numbers = np.unique(hashes, return_inverse=True)
        ends = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.items = [np.unique(numbers[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]


def count_terms(keys: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats; row, number and count of those among ``keys``)."""
    hashes, rows = terms(texts)
    lengths = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    if not len(keys) or not len(hashes):
        none = np.zeros(0, np.int64)
        return lengths, none, none, none
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    pairs, counts = np.unique(rows[hit] * len(keys) + at[hit], return_counts=True)
    return lengths, pairs // len(keys), pairs % len(keys), counts


class ImpactLists:
    """The impact lists of a block: per term its documents by number, and the order by falling impact."""

    def __init__(self, documents: int, numbers: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        self.documents = documents
        by_term = np.lexsort((docs, numbers))
        self.docs, self.impacts = docs[by_term], impacts[by_term]
        self.bounds = np.searchsorted(numbers[by_term], np.arange(n_terms + 1))
        self._orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents by number, their impacts, the order by falling impact, the position of each in it)."""
        own = slice(self.bounds[term], self.bounds[term + 1])
        if term not in self._orders:
            order = np.argsort(-self.impacts[own], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self._orders[term] = order, place
        return self.docs[own], self.impacts[own], *self._orders[term]


class Ranking:
    """The k best (score, named, id) so far: highest score, then least id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.unnamed, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        own = np.flatnonzero((score > 0) & (score >= self.kth))
        if not len(own):
            return
        score, unnamed, ids = (np.concatenate([a, b[own]]) for a, b in ((self.score, score), (self.unnamed, unnamed), (self.id, ids)))
        best = np.lexsort((ids, unnamed, -score))[: self.k]
        self.score, self.unnamed, self.id = score[best], unnamed[best], ids[best]


def best_positions(lists: ImpactLists, numbers: np.ndarray, repeats: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, ranking: Ranking) -> int:
    """Bring the block's documents into ``ranking``; returns the number of sorted accesses."""
    own = [(*lists.list_of(int(t)), int(q)) for t, q in zip(numbers, repeats) if lists.bounds[t] < lists.bounds[t + 1]]
    met = np.zeros(lists.documents, bool)
    seen = [np.zeros(len(docs), bool) for docs, *_ in own]
    best = [0] * len(own)  # positions before it are all seen
    depth, step, read = 0, _FIRST_READ, 0
    while own:
        heads = [docs[order[depth : depth + step]] for docs, _, order, _, _ in own]
        read += sum(map(len, heads))
        new = np.unique(np.concatenate(heads))
        new = new[~met[new]]
        met[new] = True
        score = np.zeros(len(new), np.int64)
        for (docs, impacts, _, place, repeat), mark in zip(own, seen):
            at = np.minimum(np.searchsorted(docs, new), len(docs) - 1)
            held = docs[at] == new
            score[held] += repeat * impacts[at[held]]
            mark[place[at[held]]] = True
        ranking.add(score, unnamed[new], ids[new])
        depth += step
        bound = 0
        for i, ((_, impacts, order, _, repeat), mark) in enumerate(zip(own, seen)):
            gap = np.flatnonzero(~mark[best[i] :][: 4 * step + depth])
            best[i] = best[i] + int(gap[0]) if len(gap) else min(len(mark), best[i] + 4 * step + depth)
            if best[i] < len(mark):
                bound += repeat * int(impacts[order[best[i] - 1]])
        if bound < ranking.kth or bound == 0:
            break
        step *= 2
    return read


def _impacts(weights: np.ndarray, n_docs: int, all_terms: int, length: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    m = 100 - 25 + (25 * length * n_docs) // all_terms
    return weights[numbers] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))


def _index(source: DataFrame, keys: np.ndarray, id_column: str) -> DataFrame:
    """(id, n, terms, counts) of every document that has a term; only the terms among ``keys`` are listed."""
    schema = source.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("array<int>").alias("terms"), F.lit(None).cast("array<int>").alias("counts"),
    ).schema
    shared = source.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, column = batch.column(0).cast(pa.int64()), batch.column(1)
            _, offsets = text_bytes(column)
            for first, last in slices(offsets):
                lengths, rows, numbers, counts = count_terms(shared.value, column.slice(first, last - first))
                ends = pa.array(np.searchsorted(rows, np.arange(last - first + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (numbers, counts))
                part = pa.RecordBatch.from_arrays([names.slice(first, last - first), pa.array(lengths), *lists], ["id", "n", "terms", "counts"])
                yield part.filter(pa.array(lengths > 0))

    return source.mapInArrow(run, schema)


_RANKED = "item int, part int, id long, score long"


def _rank_blocks(shared, k: int):
    """Rank the documents of a task block by block, and give its k best per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, all_terms = shared.value
        rankings = [Ranking(k) for _ in items]
        held: list[pa.RecordBatch] = []
        documents = postings = 0

        def rank() -> None:
            nonlocal documents, postings
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows["terms"].combine_chunks()
            sizes = np.asarray(lists.value_lengths())
            docs = np.repeat(np.arange(len(sizes)), sizes)
            numbers, counts = (x.flatten().to_numpy().astype(np.int64) for x in (lists, rows["counts"].combine_chunks()))
            length = rows["n"].to_numpy()
            unnamed = rows["id"].is_null().to_numpy()
            ids = rows["id"].fill_null(0).to_numpy()
            found = ImpactLists(len(sizes), numbers, docs, _impacts(weights, n_docs, all_terms, length[docs], numbers, counts), len(weights))
            for (own, repeats), ranking in zip(items, rankings):
                best_positions(found, own, repeats, ids, unnamed, ranking)
            held.clear()
            documents = postings = 0

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                held.append(part)
                documents += part.num_rows
                postings += len(part.column(2).flatten())
                if documents >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                    rank()
        if held:
            rank()
        part = TaskContext.get().partitionId()
        for item, ranking in enumerate(rankings):
            n = len(ranking.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, item), pa.int32()), pa.array(np.full(n, part), pa.int32()),
                     pa.array(ranking.id, mask=ranking.unnamed), pa.array(ranking.score)],
                    ["item", "part", "id", "score"],
                )

    return run


def _item_blocks(items: DataFrame, item_column: str, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_bytes``; a block at a time is on the driver."""
    items = items.select(F.col(f"`{item_column}`").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        if rows.num_rows:
            yield rows


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", item_column: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, id, score) of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_column}`"), F.col("`text`"))
    kind = items.schema[item_column].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, `{id_column}` long, score long")
    for block in _item_blocks(items, item_column, block_bytes):
        asked = Items(block["text"].combine_chunks())
        index = stored(_index(source, asked.keys, id_column), "search-index")
        n_docs, all_terms = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        held = np.zeros(len(asked.keys), np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one per term of the block
            held[row["term"]] = row["count"]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((asked.items, weights, n_docs, all_terms))
        ranked = index.mapInArrow(_rank_blocks(shared, k), _RANKED)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        some = Window.partitionBy("item", F.expr("part div 256")).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(block.num_rows), pa.int32()), "item_id": block["item_id"]}))
        out = out.unionAll(ranked.join(names, "item").select("item_id", "rank", F.col("id").alias(id_column), "score"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

"""Packing of token sequences: non-negative least squares over length combinations, then greedy.

A document's ids (with the closing id) are cut into full windows, a body that is a multiple of a
bin, and a tail shorter than a bin. Bodies have few lengths, so their histogram is small at any
number of documents. Combinations of few lengths that fill a window exactly are enumerated; least
squares under x >= 0 finds how often to use each so that the histogram is met; the counts are
rounded down, and what is left, with all tails, is packed greedily by repeated patterns, largest
length first. Every sequence is thus a pattern and a repeat number, and the k-th piece of a length
finds its place by k alone: no row of documents passes through the driver.

Defined cases: a null text is the empty text, which is one piece with the closing id only.
Repeated rows and ids are packed row by row. An empty table gives an empty result. Other columns
than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakework.llm.common import range_hashes, slices, stored, table, text_bytes

WINDOW = 4096
BIN = 64
CLOSING_ID = 2
TOKENIZER = "word_bpe_49k.json"

# Byte classes of simple texts: white space, letter, number, other; the second byte of a character counts as its first.
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _NUMBER
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[ord("'")] = _ODD  # it may begin a contraction
_CLASS[0xC2], _CLASS[0xC3] = _OTHER, _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# After 0xC2: signs that are neither letter, number, space nor format. After 0xC3: all but two signs.
_AFTER_C2 = np.isin(np.arange(256), [*range(0xA1, 0xC0)]) & ~np.isin(np.arange(256), [0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
_AFTER_C3 = np.isin(np.arange(256), [*range(0x80, 0xC0)]) & ~np.isin(np.arange(256), [0x97, 0xB7])
# Texts with contractions take the same way word by word, in the range of Latin-1.
_BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
_WORD_LETTER, _WORD_NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_WORD_LETTER}]+|[{_WORD_NUMBER}]|[^\t\n\r {_WORD_LETTER}{_WORD_NUMBER}]+")


class WordEncoder:
    """Ids of a tokenizer that splits into words before its merges; known words are looked up.

    Simple texts are split, lower-cased and hashed as byte arrays, many at a time, and their
    words found in a table by 64-bit hash. The tokenizer sees each new word once. Texts with
    contractions go word by word, all others to the tokenizer whole.
    """

    def __init__(self, path: str, most_words: int = 350_000) -> None:
        from tokenizers import Tokenizer

        self._tokenizer, self._most = Tokenizer.from_file(path), most_words
        self._slots = 1 << max(10, (6 * most_words).bit_length())
        self._forget()

    def _forget(self) -> None:
        self._table = np.zeros(self._slots, np.int32)  # word number by hash, 0: none
        self._hashes, self._starts, self._lengths = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._pool, self._used, self._n = np.zeros(1 << 14, np.uint32), 0, 1

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        n, new = self._n, len(words)
        while n + new > len(self._starts):
            self._hashes, self._starts, self._lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self._hashes, self._starts, self._lengths))
        # White space ends a word for the tokenizer, so that one call can take all words.
        encoded = self._tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        lengths = np.bincount(np.array(encoded.word_ids, np.int64), minlength=new)
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used : self._used + len(ids)] = ids
        self._lengths[n : n + new] = lengths
        self._starts[n : n + new] = self._used + np.cumsum(lengths) - lengths
        self._hashes[n : n + new] = hashes
        mask, table = self._slots - 1, self._table
        for number, slot in enumerate((hashes & np.uint64(mask)).tolist(), n):
            while table[slot]:
                slot = (slot + 1) & mask
            table[slot] = number
        self._used, self._n = self._used + len(ids), n + new

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for what is not known; open addressing, one step for all at a time."""
        mask = self._slots - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        number = self._table[slot]
        open_ = np.flatnonzero((number != 0) & (self._hashes[number] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            number[open_] = self._table[slot[open_]]
            open_ = open_[(number[open_] != 0) & (self._hashes[number[open_]] != hashes[open_])]
        return number

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        data, offsets = text_bytes(column)
        for first, last in slices(offsets):
            own = offsets[first : last + 1] - offsets[first]
            part = data[offsets[first] : offsets[last]]
            odd = self._odd_texts(part, own)
            ids, ends = self._encode_simple(part, own, odd)
            for i in range(last - first):
                yield self._encode_text(part[own[i] : own[i + 1]].tobytes().decode()) if odd[i] else ids[ends[i] : ends[i + 1]]

    def _odd_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kind = _CLASS[data]
        bad = kind == _ODD
        for lead, fine in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
            at = np.flatnonzero(data[:-1] == lead)
            good = at[fine[data[at + 1]]]
            bad[at], bad[good + 1] = True, False
            bad[good] = False
        bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        return np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) > 0

    def _encode_simple(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all simple texts, one after the other, and where those of each text end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        follows = np.flatnonzero(data >= 0x80)
        follows = follows[(data[follows] & 0xC0) == 0x80]
        kind[follows] = kind[follows - 1]
        if odd.any():
            kind[np.repeat(odd, np.diff(offsets))] = _SPACE
        low = _LOWER[data]
        capital = follows[(data[follows - 1] == 0xC3) & (data[follows] <= 0x9E)]
        low[capital] += 32
        begins = np.empty(len(data), bool)
        begins[0], begins[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        hashes = range_hashes(low, starts, ends)
        number = self._find(hashes)
        missing = np.flatnonzero(number == 0)
        if len(missing):
            if self._n > self._most:
                self._forget()
                missing = np.arange(len(hashes))
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self._learn([low[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())], new)
            number = self._find(hashes)
        lengths = self._lengths[number]
        last = np.cumsum(lengths)
        total = int(last[-1]) if len(last) else 0
        ids = self._pool[np.repeat(self._starts[number] - last + lengths, lengths) + np.arange(total)]
        return ids, np.append(0, last)[np.searchsorted(starts, offsets)]

    def _encode_text(self, text: str) -> np.ndarray:
        if "<|" in text or _BEYOND.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = [w.encode() for w in _WORD.findall(text.lower())]
        if not words:
            return np.zeros(0, np.uint32)
        ends = np.cumsum([len(w) for w in words])
        hashes = range_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
        number = self._find(hashes)
        missing = np.flatnonzero(number == 0)
        if len(missing):
            if self._n > self._most:
                self._forget()
                missing = np.arange(len(hashes))
            new, at = np.unique(hashes[missing], return_index=True)
            self._learn([words[i].decode() for i in missing[at]], new)
            number = self._find(hashes)
        return np.concatenate([self._pool[s : s + n] for s, n in zip(self._starts[number], self._lengths[number])])


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker; its words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(n: int, window: int = WINDOW, bin_size: int = BIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full windows, body, tail."""
    pieces = [(s, window) for s in range(0, n - n % window, window)]
    at, rest = n - n % window, n % window
    body = rest - rest % bin_size
    if body:
        pieces.append((at, body))
    if rest % bin_size:
        pieces.append((at + body, rest % bin_size))
    return pieces


def combinations(units: int) -> list[dict[int, int]]:
    """Fillings of ``units`` by one or two lengths with repeats, or by three different lengths once each."""
    found: dict[tuple, dict[int, int]] = {}
    for a in range(1, units):
        for i in range(1, units // a + 1):
            rest = units - a * i
            if rest == 0:
                found[((a, i),)] = {a: i}
            for b in range(1, min(a, rest + 1)):
                if rest % b == 0:
                    found[((a, i), (b, rest // b))] = {a: i, b: rest // b}
        for b in range(1, min(a, units - a)):
            c = units - a - b
            if 0 < c < b:
                found[(a, b, c)] = {a: 1, b: 1, c: 1}
    return list(found.values())


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares of ``a @ x = b`` under x >= 0, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= slack:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            trial = np.zeros_like(x)
            trial[own] = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if trial[own].min() > 0:
                x = trial
                break
            falling = own[trial[own] <= 0]
            gap = x[falling] - trial[falling]
            step = float(np.min(np.where(gap > 0, x[falling] / np.where(gap > 0, gap, 1), 0)))
            x = x + step * (trial - x)
            active[own[x[own] <= slack]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_patterns(histogram: Mapping[int, int], window: int = WINDOW, bin_size: int = BIN) -> list[tuple[dict[int, int], int]]:
    """(how often each length stands in a sequence, number of such sequences); every piece is placed once."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan: list[tuple[dict[int, int], int]] = []
    if left.get(window):
        plan.append(({window: 1}, left.pop(window)))
    units = window // bin_size
    bodies = {length // bin_size: n for length, n in left.items() if length >= bin_size}
    if bodies:
        ways = [w for w in combinations(units) if all(k in bodies for k in w)]
        if ways:
            lengths = sorted(bodies)
            a = np.zeros((len(lengths), len(ways)))
            for j, way in enumerate(ways):
                for k, m in way.items():
                    a[lengths.index(k), j] = m
            x = nnls(a, np.array([bodies[k] for k in lengths], float))
            for j in np.argsort(-x, kind="stable"):
                times = min([int(x[j] + 1e-6), *(left.get(k * bin_size, 0) // m for k, m in ways[j].items())])
                if times > 0:
                    plan.append(({k * bin_size: m for k, m in ways[j].items()}, times))
                    for k, m in ways[j].items():
                        left[k * bin_size] -= m * times
    left = {k: n for k, n in left.items() if n}
    while left:
        pattern, room = {}, window
        for length in sorted(left, reverse=True):
            if m := min(left[length], room // length):
                pattern[length] = m
                room -= m * length
        times = min(left[k] // m for k, m in pattern.items())
        plan.append((pattern, times))
        left = {k: n - pattern.get(k, 0) * times for k, n in left.items() if n > pattern.get(k, 0) * times}
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, sequence of that rank, offset) in rising rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, m in pattern.items():
            for _ in range(m):
                found.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
                ranks[length] = ranks.get(length, 0) + times
                offset += length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


_PIECES = (
    ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("doc_tokens", pa.int64(), "long"),
    ("part", pa.int32(), "int"), ("rank", pa.int64(), "long"), ("ids", pa.list_(pa.int32()), "array<int>"),
)


def _cut_documents(path: str, id_column: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), {}, encoder_of(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                rows, owner = [], []
                for i, ids in enumerate(encoder.encode(some.column(some.schema.get_field_index("text")))):
                    ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                    for start, length in cut(len(ids)):
                        own = ids[start : start + length]
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        owner.append(i)
                        rows.append((start, length, zlib.crc32(own.tobytes()), len(ids), part, rank, own.astype(np.int32) if with_ids else None))
                columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(_PIECES) if with_ids or k < 6]
                key = some.column(some.schema.get_field_index(id_column)).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, *columns], [id_column, *(n for n, _, _ in _PIECES[: len(columns)])])

    return run


def _place(table_of: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            length, rank = get("length"), get("rank")
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                own, rows = np.flatnonzero(length == one), table_of[int(one)]
                at = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                sequence[own] = rows[at, 1] + rank[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = False, id_column: str = "doc_id") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_column}`"), "text")
    kept = _PIECES if with_ids else _PIECES[:6]
    schema = docs.select(F.col(f"`{id_column}`"), *(F.lit(None).cast(kind).alias(name) for name, _, kind in kept)).schema
    pieces = stored(docs.mapInArrow(_cut_documents(tokenizer_path, id_column, with_ids), schema), "pack-pieces")
    by_part = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(by_part.select("length", "part", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "pack-ranks")
    # Lengths are at most window / bin + bin, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table_of = spark.sparkContext.broadcast(slots(plan_patterns(histogram)))
    ranked = pieces.join(first.drop("count"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "part")
    placed_schema = ranked.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).schema

    def run(batches):
        return _place(table_of.value)(batches)

    placed = ranked.mapInArrow(run, placed_schema)
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return placed.select(*(F.col(f"`{n}`") for n in names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

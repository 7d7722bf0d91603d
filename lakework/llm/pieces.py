"""SentencePiece encoding and decoding through a table of distinct chunks.

A space is written as the marker U+2581. Where no piece of a model holds a marker behind another
character, no merge ever crosses from a word into the markers before the next one, so a text falls
into chunks (a run of markers and the word behind it) that are segmented independently. Every
worker keeps a table of the distinct chunks it has met: a new chunk is segmented once, by the
library, and the ids of a text are the table's ids joined by position with numpy. Decoding is the
same join over a table of the pieces' bytes.

The table is bounded by ``table_bytes``; beyond it, it starts anew, which costs time and changes
nothing. A model must leave texts as they are (no normalisation, spaces kept, one marker in front
of a text), have a piece for the lone marker and none that crosses one; another model is refused.

Defined cases: a null or empty text has no ids and decodes to the empty text. U+2581 in a text is
taken as a space, as the library does. A text without spaces is one chunk, of any length. Repeated
rows and rows with a null id are encoded like others; empty tables give empty results; further
columns are not read by :func:`encode_documents` and kept by :func:`decode_ids`. Null or empty ids
decode to the empty text, a null id among ids raises, bytes that are no UTF-8 decode as the library
does it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import free_name, slices, table, text_bytes

MODEL = "piece_bpe_32k.model"
TABLE_BYTES = 48 << 20
_ENTRY_BYTES = 200
_LONG = 1 << 20
_MARKER = "▁"
_CHUNK = re.compile(" +[^ ]*")


@functools.lru_cache(maxsize=4)
def processor(path: str):
    """The library's processor of a model, if its chunks are independent."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{_MARKER}]{_MARKER}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError(f"{path} has pieces that cross a whitespace marker")
    if model.piece_to_id(_MARKER) == model.unk_id():
        raise ValueError(f"{path} has no piece for a lone marker")
    for text in ("a", " a", "a  b ", "\ta\n", "①Ａ"):
        if model.normalize(text) != (_MARKER + text).replace(" ", _MARKER):
            raise ValueError(f"{path} changes texts before it segments them")
    return model


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class ChunkTable:
    """Distinct chunks by number, with their ids in one pool."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES) -> None:
        self.model, self.table_bytes = processor(path), table_bytes
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.size = 0
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        # The library puts the first marker in front itself, but not in front of nothing.
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        lone = [self.model.piece_to_id(_MARKER)]
        found = [lone if c == " " else ids for c, ids in zip(chunks, found)]
        return found

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """The ids of the chunks one after the other, as (ids, ids per chunk)."""
        numbers = self.numbers
        new = [c for c in dict.fromkeys(chunks) if c not in numbers]
        if new:
            found = self._segment(new)
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
            lengths = np.array([len(ids) for ids in found], np.int64)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, np.array([i for ids in found for i in ids], np.int32)])
            self.size += sum(map(len, new)) + _ENTRY_BYTES * len(new)
        at = np.fromiter(map(numbers.__getitem__, chunks), np.int64, len(chunks))
        lengths = self.lengths[at]
        ids = self.pool[ranges(self.starts[at], lengths)]
        if self.size > self.table_bytes:
            self._clear()
        return ids, lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets of the texts among them."""
        ids, sizes, chunks, counts = [], [], [], []

        def flush() -> None:
            if chunks:
                own, lengths = self.look_up(chunks)
                ids.append(own)
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]
                sizes.extend(np.diff(ends).tolist())
            else:
                sizes.extend([0] * len(counts))
            chunks.clear()
            counts.clear()

        for text in texts:
            marked = " " + text.replace(_MARKER, " ") if text else ""
            if len(marked) < _LONG:
                own = _CHUNK.findall(marked)
                chunks += own
                counts.append(len(own))
                continue
            flush()
            some, total = (m.group() for m in _CHUNK.finditer(marked)), 0
            while part := list(islice(some, 1 << 17)):
                own, _ = self.look_up(part)
                ids.append(own)
                total += len(own)
            sizes.append(total)
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


class PieceTable:
    """The bytes of every piece, in one pool."""

    def __init__(self, path: str) -> None:
        model = self.model = processor(path)
        pieces = []
        self.silent = np.zeros(model.get_piece_size(), bool)
        self.marked = np.zeros(model.get_piece_size(), bool)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                pieces.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                pieces.append(model.decode([i]).encode())
            else:
                self.marked[i] = piece.startswith(_MARKER)
                pieces.append(piece.replace(_MARKER, " ").encode())
            self.silent[i] = model.is_control(i)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of rows of ids; the marker that stands in front of a text goes."""
        starts, lengths = self.starts[ids], self.lengths[ids]
        told = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(told, offsets[:-1])
        has = first < len(told)
        at = told[first[has]]
        at = at[(at < offsets[1:][has]) & self.marked[ids[at]]]
        starts[at] += 1
        lengths[at] -= 1
        data = self.pool[ranges(starts, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        inside = ends[:-1][ends[:-1] < ends[1:]]
        try:
            data.tobytes().decode()
            broken = bool((data[inside] & 0xC0 == 0x80).any())
        except UnicodeDecodeError:
            broken = True
        if broken:
            return pa.array([self._text(ids[a:b], data[c:d]) for a, b, c, d in zip(offsets, offsets[1:], ends, ends[1:])], pa.large_string())
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))

    def _text(self, ids: np.ndarray, data: np.ndarray) -> str:
        try:
            return data.tobytes().decode()
        except UnicodeDecodeError:
            return self.model.decode(ids.tolist())


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


_tables: dict[tuple[str, int], ChunkTable] = {}


def _chunk_table(path: str, table_bytes: int) -> ChunkTable:
    """The table of this worker, which later tasks go on with."""
    if (path, table_bytes) not in _tables:
        _tables[path, table_bytes] = ChunkTable(path, table_bytes)
    return _tables[path, table_bytes]


def _model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    processor(path)  # refuse an unfit model before any task runs
    return path


def encode_documents(
    docs: DataFrame, model_path: str | None = None, with_text: bool = False, id_column: str = "doc_id", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """(id, ids) of every row, with ``decoded``, the text that the ids give, if asked for."""
    path = _model_path(model_path)
    source = docs.select(F.col(f"`{id_column}`"), F.col("`text`"))
    added = [F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")][: 1 + with_text]
    schema = source.select(F.col(f"`{id_column}`"), *added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunk_table(path, table_bytes)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            _, bounds = text_bytes(column)
            for first, last in slices(bounds):
                ids, offsets = chunks.encode(column.slice(first, last - first).to_pylist())
                columns = [keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if with_text:
                    columns.append(piece_table(path).decode(ids, offsets).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"][: len(columns)])

    return source.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str | None = None, column: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in a further column; where ``to`` is taken, underscores are added."""
    path, to = _model_path(model_path), free_name(rows, to)
    place = rows.columns.index(column)
    source = rows.withColumn(column, F.col(f"`{column}`").cast("array<int>"))
    schema = source.withColumn(to, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(place)
                lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                values = lists.flatten()
                if values.null_count:
                    raise ValueError("a null id cannot be decoded")
                ids = values.to_numpy(zero_copy_only=False)
                if len(ids) and not (0 <= ids.min() and ids.max() < len(piece_table(path).lengths)):
                    raise ValueError("an id is outside the model")
                text = piece_table(path).decode(ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], [*part.schema.names, to])

    return source.mapInArrow(run, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), with_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

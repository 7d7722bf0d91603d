import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lakework.llm.pieces import ChunkTable, decode_ids, encode_documents, op13_sentencepiece, piece_table

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def of_table(texts, **options):
    ids, offsets = ChunkTable(PATH, **options).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


TEXTS = [
    "", " ", "  ", "   ", "a", " a", "a ", "a  ", "a  b", "▁", "▁a", "a▁b", "a\0b", "\n\n", "\t x ", "é", "ﬁ ½", "﻿a",
    "<s> </s><unk> <0x41>", "　x", "\U0001f600 \U0001f600", "x" * 5000, "word " * 3000, "漢字" * 700, " ▁ ▁ a",
]


def test_ids_and_texts_are_the_librarys():
    assert of_table(TEXTS) == LIBRARY.encode(TEXTS)
    ids, offsets = ChunkTable(PATH).encode([*TEXTS, None])
    assert piece_table(PATH).decode(ids, offsets).to_pylist() == [*LIBRARY.decode(LIBRARY.encode(TEXTS)), ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the▁ \n\t.,1é漢\U0001f600"), max_size=40) | st.text(max_size=20), min_size=1, max_size=6))
def test_any_texts(texts):
    assert of_table(texts) == LIBRARY.encode(texts)
    ids, offsets = ChunkTable(PATH).encode(texts)
    assert piece_table(PATH).decode(ids, offsets).to_pylist() == LIBRARY.decode(LIBRARY.encode(texts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 270) | st.integers(0, 31999), max_size=12), min_size=1, max_size=5))
def test_any_ids(rows):
    offsets = np.cumsum([0, *map(len, rows)])
    flat = np.array([i for ids in rows for i in ids], np.int64)
    assert piece_table(PATH).decode(flat, offsets).to_pylist() == [LIBRARY.decode(ids) if ids else "" for ids in rows]


def test_small_tables_start_anew_with_the_same_ids():
    texts = [f"w{i} w{i + 1} same same" for i in range(200)]
    assert of_table(texts, table_bytes=500) == LIBRARY.encode(texts)


def test_texts_longer_than_a_block():
    text = ("lorem ipsum  dolor\n" * 70_000) + "x" * 100
    assert len(text) > 1 << 20
    assert of_table(["a b", text, "", "c"]) == LIBRARY.encode(["a b", text, "", "c"])


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    table, asked = ChunkTable(PATH), []
    segment = table._segment
    monkeypatch.setattr(table, "_segment", lambda chunks: asked.extend(chunks) or segment(chunks))
    table.encode(["the cat the dog", "the dog"])
    table.encode(["the cat"])
    assert sorted(asked) == [" cat", " dog", " the"]


def test_a_model_that_changes_texts_is_refused(monkeypatch):
    from lakework.llm import pieces

    class Folding:
        def __init__(self, model_file):
            self.inner = LIBRARY

        def get_piece_size(self):
            return 3

        def id_to_piece(self, i):
            return ["a", "b", self.crossing][i]

        def piece_to_id(self, piece):
            return 1

        def unk_id(self):
            return 0

        def normalize(self, text):
            return text.lower()

    for piece, said in (("x▁y", "cross"), ("x", "changes")):
        Folding.crossing = piece
        monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
        with pytest.raises(ValueError, match=said):
            pieces.processor.__wrapped__("other.model")


def test_odd_rows(odd_documents, documents, spark):
    rows = encode_documents(odd_documents, with_text=True).collect()
    assert len(rows) == odd_documents.count()
    for row, text in zip(rows, [r["text"] for r in odd_documents.collect()]):
        assert row["ids"] == LIBRARY.encode(text or "") and row["decoded"] == (text or "")
    assert encode_documents(documents([])).collect() == []
    more = spark.createDataFrame([(1, [264, 287], "x"), (2, None, "y"), (3, [], "z")], "k int, ids array<bigint>, decoded string")
    assert [tuple(r) for r in decode_ids(more).collect()] == [(1, [264, 287], "x", "a b"), (2, None, "y", ""), (3, [], "z", "")]
    with pytest.raises(Exception, match="outside the model"):
        decode_ids(spark.createDataFrame([([32000],)], "ids array<int>")).collect()


def test_query_equals_the_library(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op13_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = LIBRARY.encode(doc["text"] or "")
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

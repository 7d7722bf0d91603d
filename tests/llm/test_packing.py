import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakework.llm.packing import CLOSING_ID, TOKENIZER, WINDOW, WordEncoder, combinations, cut, nnls, pack_documents, plan_patterns, slots

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_words_give_the_tokenizers_ids(plain):
    texts = [
        "", "It's we'll don't 'twas they're I'm I'd", "É À µ ² ½ ªº _a_b 12 345 'S ''s", "<|endoftext|> a <|startoftext|>", "<| a", "x\x0by\x1cz\x85w\xa0v",
        "œuf Ünï “q” Σς İ ﬁ", "tab\tnew\n\n line \r\n end", "a" * 5000, "### %%% &&&--==", "漢字 \U0001f600 é", "naïve co-operate 3.14!!", "\xad soft",
    ]
    rng = random.Random(4)
    alphabet = "abcdeéÈßùñ 'sltm.,-_#0123²½ABCÀ\n\t"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    texts += ["".join(rng.choice("abéÈßùÑÿÞ 12.,-¿¡«»×÷ªµ²A\n") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    encoder = WordEncoder(PATH, most_words=200)
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_every_length():
    for n in (1, 63, 64, 65, 4095, 4096, 4097, 8192, 12_345):
        pieces = cut(n)
        assert [s for s, _ in pieces] == np.cumsum([0, *(length for _, length in pieces)])[:-1].tolist()
        assert sum(length for _, length in pieces) == n


def test_combinations_fill_the_window():
    ways = combinations(64)
    assert all(sum(k * m for k, m in w.items()) == 64 for w in ways)
    assert {63: 1, 1: 1} in ways and {16: 4} in ways and {30: 1, 20: 1, 14: 1} in ways


def test_least_squares_stays_non_negative_and_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((8, 14)), rng.random(8) * 10
        x = nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert x.min() >= 0 and gradient.max() < 1e-5 and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-5
    a = rng.random((6, 10))
    true = np.maximum(0, rng.standard_normal(10))
    assert np.allclose(a @ nnls(a, a @ true), a @ true, atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    histogram = {}
    for n in np.concatenate([rng.lognormal(5.5 + seed / 2, 1, 4000).astype(int) + 1]):
        for _, length in cut(int(n)):
            histogram[length] = histogram.get(length, 0) + 1
    plan = plan_patterns(histogram)
    used = {}
    for pattern, times in plan:
        assert times > 0 and sum(k * m for k, m in pattern.items()) <= WINDOW
        for k, m in pattern.items():
            used[k] = used.get(k, 0) + m * times
    assert used == histogram
    sequences = sum(t for _, t in plan)
    assert sum(k * n for k, n in histogram.items()) >= 0.99 * (sequences - 1) * WINDOW
    for rows in slots(plan).values():
        assert (np.diff(rows[:, 0]) > 0).all()
    assert plan_patterns({}) == []
    assert plan_patterns({4032: 5}) == [({4032: 1}, 5)]


def test_documents_come_back_from_their_sequences(odd_documents, plain):
    docs = odd_documents
    rows = pack_documents(docs, with_ids=True).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    ids = {k: plain.encode(v[0] or "", add_special_tokens=False).ids + [CLOSING_ID] for k, v in texts.items()}
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(got) == set(ids)
    for k, pieces in got.items():
        assert sum(p["length"] for p in pieces) == len(ids[k]) * len(texts[k])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        ends = np.cumsum([0, *(n for _, n in own)])
        assert [o for o, _ in own] == ends[:-1].tolist() and ends[-1] <= WINDOW
    assert pack_documents(docs.limit(0)).count() == 0


def test_padding_over_the_given_documents(spark, sf_dir):
    rows = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = rows.groupBy("sequence_id").agg({"length": "sum"}).toPandas()["sum(length)"]
    assert sums.max() <= WINDOW and sums.sum() >= 0.97 * len(sums) * WINDOW

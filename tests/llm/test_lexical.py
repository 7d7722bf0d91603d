import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakework.llm import lexical
from lakework.llm.lexical import ImpactLists, Ranking, best_positions, lexical_search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, every = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // every
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in split(text) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzZ09 .,-_é漢É\x7f\n'"), max_size=15), min_size=1, max_size=5))
def test_terms_are_those_of_the_expression(texts):
    hashes, rows = terms(pa.array(texts))
    known = {}
    expected = [(row, word) for row, text in enumerate(texts) for word in split(text)]
    assert rows.tolist() == [row for row, _ in expected]
    for h, (_, word) in zip(hashes.tolist(), expected):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def lists_of(impacts):
    """ImpactLists and the whole scores of a documents x terms matrix of impacts, 0 for absent."""
    docs, numbers = np.nonzero(impacts)
    return ImpactLists(len(impacts), numbers, docs, impacts[docs, numbers], impacts.shape[1])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 8), st.integers(1, 25), st.sampled_from([2, 5, 1000]), st.integers(0, 1 << 30))
def test_best_positions_find_the_highest_scores(n, n_terms, k, spread, seed):
    rng = np.random.default_rng(seed)
    impacts = rng.integers(1, spread, (n, n_terms)) * (rng.random((n, n_terms)) < rng.random(n_terms))
    repeats, ids = rng.integers(1, 4, n_terms), rng.permutation(n)
    ranking = Ranking(k)
    best_positions(lists_of(impacts), np.arange(n_terms), repeats, ids, np.zeros(n, bool), ranking)
    expected = sorted((-int(s), int(i)) for s, i in zip(impacts @ repeats, ids) if s > 0)[:k]
    assert list(zip((-ranking.score).tolist(), ranking.id.tolist())) == expected


def test_reading_stops_early_and_strictly_below_the_kth():
    rng = np.random.default_rng(1)
    impacts = np.sort(rng.integers(1, 1000, (20_000, 1)), axis=0)[::-1] + rng.integers(0, 50, (20_000, 6))
    ids, none = np.arange(20_000), np.zeros(20_000, bool)
    ranking = Ranking(20)
    assert best_positions(lists_of(impacts), np.arange(6), np.ones(6, int), ids, none, ranking) < 20_000
    # With what an earlier block has found, the next one is left at once.
    again = Ranking(20)
    again.add(ranking.score * 2, ranking.unnamed, ranking.id)
    assert best_positions(lists_of(impacts), np.arange(6), np.ones(6, int), ids, none, again) == 6 * lexical._FIRST_READ
    # All documents tie: reading must go on until the least ids are met.
    equal, ranking = np.full((5000, 3), 7), Ranking(20)
    best_positions(lists_of(equal), np.arange(3), np.ones(3, int), ids[:5000][::-1], none[:5000], ranking)
    assert ranking.id.tolist() == list(range(20)) and set(ranking.score.tolist()) == {21}


def test_direct_accesses_move_the_best_position():
    # Both lists hold the same head in opposite order, so the positions read meet in the middle.
    n = 4 * lexical._FIRST_READ
    impacts = np.full((2 * n, 2), 1)
    impacts[:n, 0], impacts[:n, 1] = np.arange(n) + 1000, 2000 - np.arange(n)
    ranking = Ranking(5)
    read = best_positions(lists_of(impacts), np.arange(2), np.ones(2, int), np.arange(2 * n), np.zeros(2 * n, bool), ranking)
    assert read < 2 * 2 * n and ranking.score.tolist() == sorted(impacts.sum(axis=1).tolist())[::-1][:5]


@pytest.mark.parametrize("documents_a_block", [1 << 15, 30])
def test_against_brute_force(spark, documents, monkeypatch, documents_a_block):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", documents_a_block)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(80)] + ["Ünï", "ÜNÏ", "漢字"]
    weights = 1 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    docs = [(int(i), draw(rng.integers(1, 120))) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]
    items = [(i, draw(12)) for i in range(15)] + [(50, "w0 w0 W0, w1"), (51, "nowhere"), (52, None), (53, "")]
    assert found(lexical_search(documents(docs), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_odd_rows(spark, odd_documents, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    items = [(1, "one two w5"), (None, "three ONE"), (1, "één 漢字"), (2, None)]
    named = spark.createDataFrame(items, ITEMS)
    clash = odd_documents.withColumn("item_id", odd_documents.doc_id).withColumn("score", odd_documents.text)
    got = found(lexical_search(clash, named.withColumn("rank", named.text)))
    assert got == brute(rows, items) and any(r[0] is None for r in got) and any(r[2] is None for r in got)
    assert found(lexical_search(odd_documents, named, block_bytes=20)) == got
    assert lexical_search(documents([]), named).collect() == []
    assert lexical_search(odd_documents, spark.createDataFrame([], ITEMS)).collect() == []
    assert lexical_search(documents([(1, "..."), (2, None)]), named).collect() == []

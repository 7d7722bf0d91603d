import random
import zlib

import pytest

from lakework.llm.sharding import CapacityTree, best_fit_decreasing, fill_shards, shard_documents


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for size in sizes:
        fits = [(r, b) for b, r in enumerate(left) if r >= size]
        if not fits:
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        b = min(fits)[1]
        left[b] -= size
        out.append(b)
    return out


def test_tree_gives_the_least_key_that_suffices():
    rng = random.Random(2)
    tree, kept = CapacityTree(), []
    for _ in range(2000):
        if rng.random() < 0.6:
            key = (rng.randint(0, 300), len(kept))
            kept.append(key)
            tree.insert(key)
        else:
            size = rng.randint(0, 320)
            fits = [k for k in kept if k[0] >= size and k is not None]
            want = min(fits) if fits else None
            assert tree.take_ceiling(size) == want
            if want:
                kept[kept.index(want)] = (-1, -1)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_the_plain_form(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    assert best_fit_decreasing(sizes, 137) == plain_best_fit(sizes, 137)
    assert best_fit_decreasing(sizes, 137, most=3) is None
    with pytest.raises(ValueError, match="does not fit"):
        best_fit_decreasing([10], 5)


def test_shards_are_even_and_a_huge_group_stands_alone():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 1000) for _ in range(3000)), reverse=True)
    for own in ([], [5_000_000]):
        bins = fill_shards(own + sizes, 24)
        sums = [0] * 24
        for b, s in zip(bins, own + sizes):
            sums[b] += s
        rest = sums[len(own) :]
        assert max(rest) <= 1.005 * min(rest)
    assert fill_shards([], 24) == [] and fill_shards([5, 3], 24) == [0, 1]


def check(rows, docs, shards):
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((d or 0) for d, _ in docs)
    seen, by_text = {}, {}
    texts = dict(docs)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        seen.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault(data, set()).add(r["shard"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_groups_stay_together_and_slots_have_no_gap(documents):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randint(0, 400) if i % 3 else "the same text " * 4) for i in range(600)]
    rows = shard_documents(documents(docs), shards=6, grain=8).collect()
    check(rows, docs, 6)
    sums = {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) <= 1.3 * min(sums.values())


def test_fixed_capacity_uses_few_shards(documents):
    rng = random.Random(5)
    docs = [(i, chr(97 + i % 26) * rng.randint(1, 300)) for i in range(500)]
    rows = shard_documents(documents(docs), capacity=2000).collect()
    sums = {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) <= 2000 and len(sums) <= -(-sum(sums.values()) // 2000) + 2


def test_odd_rows(odd_documents):
    rows = shard_documents(odd_documents, shards=3).collect()
    assert len(rows) == odd_documents.count()
    assert len({r["shard"] for r in rows if r["size"] == 8}) == 1
    assert shard_documents(odd_documents.limit(0)).count() == 0

import random
import re

import numpy as np
import pytest

from lakework.llm.jaccard import GroupIndex, jaccard_components, keep_one_of_each, taken
from lakework.llm.components import connected_components


def brute(rows, size, percent):
    """{id: (set size, component)} by comparing every pair."""
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        sets[i] = grams or ({tuple(words)} if words else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_base=12, copies=6):
    """Texts with near copies at all distances, a passage that many share, exact copies and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    texts += [texts[0], texts[0], "a b", "A B", "solo", "", " \n", "x y z", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "size", "percent", "hot", "part"), [(1, 4, 85, 20_000, 100_000), (2, 5, 80, 2, 100), (3, 4, 85, 3, 150), (4, 2, 50, 2, 100)])
def test_components_equal_brute_force(documents, seed, size, percent, hot, part):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(rows), size, percent, hot, part).collect()}
    assert got == brute(rows, size, percent)


def test_one_large_group_in_many_parts(documents):
    """Near copies that are far apart from each other, joined only through chains, dealt over many parts."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(80):
        text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(rows), 4, 85, 10, 200).collect()}
    assert got == brute(rows, 4, 85)


def test_local_search_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(40)]
    edges = GroupIndex(np.arange(40), sets, 85).edges()
    linked = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert all((max(e), min(e)) in linked for e in edges)
    classes = list(range(40))
    for a, b in edges:
        x, y = classes[a], classes[b]
        classes = [min(x, y) if c in (x, y) else c for c in classes]
    assert all(classes[i] == classes[j] for i, j in linked)


def test_merge_with_skips_counts_like_a_plain_merge():
    rng = np.random.default_rng(12)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 30))).astype(np.uint64)) for _ in range(25)]
        index = GroupIndex(np.arange(25), sets, 80)
        x = int(rng.integers(1, 25))
        lists = rng.permutation(index.lists[x])[: int(rng.integers(1, 30))]
        plain = np.bincount(np.concatenate([index.docs[index.starts[i] : index.starts[i + 1]] for i in lists]), minlength=25)[:x]
        for need in (1, 2, 3, 5):
            assert index.merge_skip(lists, x, need) == {y: int(c) for y, c in enumerate(plain) if c >= need}


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_taken_shingles_hold_what_partners_share(percent):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = set(rng.choice(1000, n, replace=False).tolist())
        y = set(x)
        while True:
            z = set(y)
            if rng.random() < 0.5 and z:
                z.discard(int(rng.choice(sorted(z))))
            else:
                z.add(int(rng.integers(1000, 2000)))
            if not z or 100 * len(x & z) < percent * len(x | z):
                break
            y = z
            if rng.random() < 0.2:
                break
        (lx, need_x), (ly, need_y) = taken(len(x), percent), taken(len(y), percent)
        assert len(set(sorted(x)[:lx]) & set(sorted(y)[:ly])) >= max(need_x, need_y)


def test_copies_beyond_the_table_are_found_by_the_search(documents, monkeypatch):
    monkeypatch.setattr("lakework.llm.jaccard.COPY_GROUPS", 1)
    rows = [(i, f"many copies of text one {'x ' * 9}") for i in range(20)] + [(i, f"two of this text here {'y ' * 9}") for i in (30, 31)] + [(40, "alone it stands")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_odd_rows(odd_documents, spark):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(odd_documents).collect()}
    assert rows == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 2, None), (5, 59996, 5), (6, 1, 6)}
    assert jaccard_components(odd_documents.limit(0)).count() == 0
    kept = keep_one_of_each(odd_documents)
    assert kept.count() == odd_documents.distinct().count() and kept.columns == odd_documents.columns
    assert kept.schema == odd_documents.schema


def test_clashing_columns_pass_through(spark):
    docs = spark.sql("SELECT id AS doc_id, 'same words here again and again' AS text, id AS h, id AS digest, id AS component FROM range(4)")
    kept = keep_one_of_each(docs)
    assert [tuple(r) for r in kept.collect()] == [(0, "same words here again and again", 0, 0, 0)]


def test_connected_components(spark):
    rng = random.Random(1)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((500, i) for i in range(501, 560)), (900, 900), (1000, 1001), (1001, 1000)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got)
    assert got == {**{i: 0 for i in range(200)}, **{i: 500 for i in range(500, 560)}, 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

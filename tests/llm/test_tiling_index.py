"""The seed index of benchmark decontamination: common stems, many items, memory."""

import random
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from lakework.llm import tiling

STEM = "which of the following statements is true about the"


def plain_pairs(docs, items, threshold):
    """Pairs of documents and items by tiling each with each."""
    found = {}
    for row, doc in enumerate(docs):
        d = tiling.tokens(pa.array([doc]))[0]
        for n, item in enumerate(items):
            i = tiling.tokens(pa.array([item]))[0]
            if len(i) < tiling.MIN_MATCH:
                if len(i) and len(i) == len(d) and (i == d).all():
                    found[row, n] = len(i)
                continue
            w = tiling.MIN_MATCH
            seeds = [(a, b) for a in range(len(d) - w + 1) for b in range(len(i) - w + 1) if (d[a : a + w] == i[b : b + w]).all()]
            covered = sum(t[2] for t in tiling.greedy_tiles(d, i, seeds, w))
            if covered and covered >= threshold * len(i):
                found[row, n] = covered
    return found


@pytest.mark.parametrize(("seed", "threshold"), [(0, 0.5), (1, 0.5), (2, 0.3), (3, 0.9), (4, 0.7)])
def test_rare_seeds_find_all_pairs(monkeypatch, seed, threshold):
    monkeypatch.setattr(tiling, "PROBED", 1)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [f"{STEM} {some(rng.randint(2, 14))}" for _ in range(25)] + [some(rng.randint(1, 20)) for _ in range(10)]
    items += [items[0], items[1], STEM, "", "w1 w2", "w1 w2", "x x x x x x x x x"]
    docs = [f"{some(5)} {item} {some(5)}" for item in items[:12]]
    for item in items[12:30]:
        parts = item.split()
        cut = rng.randrange(len(parts) + 1)
        docs.append(" ".join([*parts[cut:], some(3), *parts[:cut]]))
        docs.append(" ".join(parts[: rng.randrange(len(parts) + 1)]) + " " + some(8))
    docs += ["w1 w2", "w1 w2 w3", "", "x " * 40, f"{STEM} {some(4)} {STEM}"]
    index = tiling.SeedIndex(range(len(items)), items, threshold=threshold)
    got = {(row, n): sum(t[2] for t in tiles) for row, n, tiles in index.search(pa.array(docs))}
    assert got == plain_pairs(docs, items, threshold) and len(got) > 20


def timed(index, texts):
    best = 9e9
    for _ in range(3):
        start = time.perf_counter()
        found = list(index.search(texts))
        best = min(best, time.perf_counter() - start)
    return best, found


def test_a_common_stem_costs_little():
    rng = np.random.default_rng(1)
    tails = [" ".join(f"t{k}" for k in rng.integers(0, 5000, 12)) for _ in range(8000)]
    texts = pa.array([" ".join(f"d{k}" for k in rng.integers(0, 5000, 200)) + f" {STEM} x" for _ in range(200)])
    with_stem, found = timed(tiling.SeedIndex(range(8000), [f"{STEM} {t}" for t in tails]), texts)
    without, none = timed(tiling.SeedIndex(range(8000), [f"{' '.join(f'u{i}_{k}' for k in range(9))} {t}" for i, t in enumerate(tails)]), texts)
    assert found == none == []
    assert with_stem < 2 * without + 0.05


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from lakework.llm import tiling
rng = np.random.default_rng(2)
words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(50_000)])
texts = pa.array([" ".join(words[rng.integers(0, len(words), 40)]) for _ in range({rows})])
tiling.SeedIndex([1], ["a b c d e"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = tiling.SeedIndex(pa.array(range(len(texts))), texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, texts.nbytes / 2**20, sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) / 2**20)
"""


def test_a_block_of_items_fits_the_driver():
    rows = tiling.BLOCK_BYTES // 250
    root = str(tiling.__file__).rsplit("/lakework/", 1)[0]
    out = subprocess.run([sys.executable, "-c", MEMORY.format(root=root, rows=rows)], capture_output=True, text=True, check=True).stdout
    peak, size, kept = map(float, out.split())
    assert size > 0.8 * tiling.BLOCK_BYTES / 2**20
    assert kept < 60 and peak < 200, (peak, kept)


def test_blocks_beyond_a_chain_are_all_asked(documents, spark):
    words = [f"{a}{b} {b}{a} {a}x{b} {b}y{a} end" for a in "abcdef" for b in "ghij"]
    items = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(None, "five words of no name")], "item_id long, text string")
    docs = documents([*((i, f"say {w}") for i, w in enumerate(words)), (99, "clean text that nobody asked for"), (98, "five words of no name")])
    docs = docs.withColumn("item_id", docs.doc_id).withColumn("coverage", docs.text)
    kept = tiling.keep_uncontaminated(docs, items, block_bytes=60)
    assert [r["doc_id"] for r in kept.collect()] == [99] and kept.schema == docs.schema
    assert tiling.contaminated_pairs(docs, items, block_bytes=200).count() == len(words)

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakework.llm import negatives
from lakework.llm.negatives import Best, PackedRows, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 9), st.integers(1, 40), st.integers(1, 20), st.integers(0, 26), st.integers(0, 26), st.integers(0, 1 << 30))
def test_packed_scores_are_exact(dim, n, asked, row_bits, anchor_bits, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-(1 << row_bits), (1 << row_bits) + 1, (n, dim))
    anchors = rng.integers(-(1 << anchor_bits), (1 << anchor_bits) + 1, (asked, dim))
    packed = PackedRows(rows, int(anchors.max(initial=0)) - int(anchors.min(initial=0)))
    assert (packed.scores(anchors) == anchors @ rows.T).all()


def test_small_components_share_a_wide_integer():
    rows = np.random.default_rng(1).integers(-150, 150, (101, 64))
    packed = PackedRows(rows, 300)
    assert packed.fields == 2 and packed.wide.shape == (64, 51) and packed.wide.max() < 1 << 53
    extreme = np.full((3, 64), 1 << 24)
    packed = PackedRows(extreme, 1 << 25)
    assert packed.fields == 1 and (packed.scores(-extreme) == -extreme @ extreme.T).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(0, 1 << 30))
def test_best_over_several_offers(k, seed):
    rng = np.random.default_rng(seed)
    best, seen = Best(5, k), [[] for _ in range(5)]
    for _ in range(4):
        groups = np.flatnonzero(rng.random(5) < 0.7)
        ids = np.sort(rng.integers(0, 60, 30))
        scores = rng.integers(-3, 3, (len(groups), 30))
        allowed = rng.random((len(groups), 30)) < 0.8
        best.offer(groups, scores, allowed, ids)
        for line, g in enumerate(groups):
            seen[g] += [(-int(s), int(i)) for s, i, ok in zip(scores[line], ids, allowed[line]) if ok]
    for g in range(5):
        own = best.group == g
        assert list(zip((-best.score[own]).tolist(), best.id[own].tolist())) == sorted(seen[g])[:k]


def brute(rows, asks, scale=256):
    """Expected rows from (id, vector, label) of rows that take part."""
    rows = [(i, np.floor(scale * np.array(v, np.float64)).astype(int), lab) for i, v, lab in rows]
    out = []
    for a, v, label in rows:
        if not asks(a):
            continue
        near = [(-int(v @ w), i, m) for i, w, m in rows if len(w) == len(v) and i != a]
        for p, i, m in sorted(n for n in near if n[2] == label)[:5]:
            inside = sorted((n, j) for n, j, o in near if o != label and 30 * -p <= 100 * -n <= 90 * -p)[:10]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(inside)]
    return sorted(out)


def found(df):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("chunk", "block"), [(1 << 20, 1 << 16), (40, 3)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) + np.repeat(rng.standard_normal((10, 12)), 30, axis=0)
    x[200:240] = x[200]  # one common vector
    labels = rng.integers(0, 3, 300)
    rows = [(i, v.astype(np.float32).tolist(), int(m)) for i, (v, m) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows, lambda i: i % 20 == 0)
    assert len(expected) > 200
    assert found(hard_negatives(df, F.col("vec_id") % 20 == 0)) == expected


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.5, 0.2], 2), (2, [0.5, 0.2], 2), (3, [0.5, 0.1], None), (4, None, 2),
        (5, [0.5, None], 2), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (None, [0.5, 0.2], 2), (8, [0.5, 0.2, 0.1], 2),
        (9, [], 1), (100, [], 1), (101, [1e30, 0.0], 2), (102, [0.9, 0.3], 1),
    ]
    wide = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", anchor long").withColumn("score", F.lit("x"))
    used = [r for r in rows if r[0] in (0, 1, 2, 8, 9, 100, 102)]
    got = found(hard_negatives(wide, F.col("vec_id") % 100 == 0))
    assert got == brute(used, lambda i: i % 100 == 0) and {r[3] for r in got} == {2}
    assert [r[2] for r in got if r[:2] == (0, 1)] == [1, 2]  # the repeated row is a candidate of its own
    twice = hard_negatives(wide.unionAll(wide.where("vec_id = 0")), F.col("vec_id") == 0)
    assert found(twice) == [r for r in got if r[0] == 0]
    empty = hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)
    assert empty.collect() == [] and [f.dataType.simpleString() for f in empty.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert found(hard_negatives(wide, F.lit(False))) == []


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * 10_000).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(hard_negatives(df, F.col("vec_id") % 7 == 0)) == brute(rows, lambda i: i % 7 == 0)

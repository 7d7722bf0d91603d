import numpy as np
import pytest

from lakework.llm.vectors import _pivots_wanted, bounded, directions, encode, estimates, near_duplicates, rotations, unit_rows


def brute(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while True:
        least = np.where(near, component[None, :], len(x)).min(1)
        new = np.minimum(component, least)
        if (new == component).all():
            return near.sum(1), component
        component = new


def clustered(seed, n=400, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n - 8, 8):
        x[i + 1 : i + 4] = x[i] + rng.standard_normal((3, dim)) * rng.uniform(0.02, 0.35)
        x[i + 4] = x[i]
        x[i + 5] = 3.5 * x[i]
    return x.astype(np.float32)


@pytest.mark.parametrize(("dim", "bits"), [(64, 384), (64, 64), (3, 64), (1, 64), (200, 1200)])
def test_estimates_are_unbiased_and_bounds_hold(dim, bits):
    rng = np.random.default_rng(2)
    unit = unit_rows(rng.standard_normal((300, dim)))
    unit[1::2] = unit_rows(unit[::2] + rng.standard_normal((150, dim)) * 0.04)
    rotation = rotations(dim, bits)
    codes, factor = encode(unit, rotation)
    assert codes.shape == (300, -(-len(rotation) // 8)) and codes.dtype == np.uint8
    turned = directions(codes, rotation)
    true = unit @ unit.T
    if dim == 64 and bits > 64:
        far = true < 0.5
        assert abs((estimates(turned, factor, turned, factor) - true)[far].mean()) < 0.003
    for threshold in (0.5, 0.9, 0.95, 0.999):
        left, right = bounded(turned, factor, threshold)
        passed = left @ right.T >= -1e-5
        assert passed[true >= threshold].all()
        if dim == 64 and bits > 64 and threshold >= 0.9:
            assert passed[true < 0.5].mean() < 1e-3


def test_links_equal_brute_force(spark):
    x = clustered(4)
    rows = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    links, component = brute(x.astype(float))
    assert [r["n_links"] for r in rows] == links.tolist() and [r["component_id"] for r in rows] == component.tolist()
    assert links.sum() > 0 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_each_class_is_encoded_once_and_little_is_shipped(spark, monkeypatch):
    from lakework.llm import vectors

    written = {}
    monkeypatch.setattr(vectors, "stored", lambda df, purpose, keep=vectors.stored: written.setdefault(purpose, keep(df, purpose)))
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    x[1000:1100] = x[:100]
    near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    codes = written["vector-codes"].collect()
    assert len(codes) == 1900 and {len(r["code"]) for r in codes} == {48}
    assert "v" not in written["vector-codes"].columns and written["vector-near"].count() == 0  # nothing but codes travels


def test_buckets_in_parts_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr("lakework.llm.vectors.BUCKET_ROWS", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((1, 16)) + rng.standard_normal((120, 16)) * 0.01, rng.standard_normal((50, 16))]).astype(np.float32)
    rows = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    links, component = brute(x.astype(float))
    assert [r["n_links"] for r in rows] == links.tolist() and [r["component_id"] for r in rows] == component.tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, -0.0])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "vec_id AS rep", "1 AS copies")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in near_duplicates(frame).collect())
    assert got == sorted([(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 3, 7), (7, 3, 7), (8, 3, 7), (11, 3, 7), (0, 0, None)])
    assert near_duplicates(frame.limit(0)).count() == 0


def test_pivots_bound_the_buckets():
    assert [_pivots_wanted(n, 8) for n in (10, 1000, 100_000, 10_000_000, 10**9)] == [1, 6, 7, 611, 4096]


def test_no_link_is_lost_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((1500, 64))
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([x, 0.9501 * x + np.sqrt(1 - 0.9501**2) * away])
    rows = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    links, component = brute(both)
    assert [r["n_links"] for r in rows] == links.tolist() and [r["component_id"] for r in rows] == component.tolist()
    assert links.min() >= 1

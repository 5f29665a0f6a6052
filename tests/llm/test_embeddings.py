import math

import numpy as np
import pytest

from ledgerloom.llm import embeddings


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 12)):
                out.append((rng.permutation(base) if rng.random() < 0.2 else base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4]), label))
    rows = [([float(np.float32(x)) for x in v], label) for v, label in out]
    rows += [(None, 0), ([0.0] * 16, 0), ([], 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] * 16, 0), ([None] + [1.0] * 15, 0), ([1.0] * 8, 0), ([1.0] * 8, 0), ([2.0] * 8, 0), ([1.0] * 16, 0)]
    return [(3 * i, v, label) for i, (v, label) in enumerate(rows)] + [(0, *rows[0]), (None, *rows[0])]


def brute(rows, similarity=0.93):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, parent = [0] * len(rows), {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (a, v, k) in enumerate(rows):
        for q, (b, w, m) in enumerate(rows[:p]):
            if a is not None and b is not None and k == m and k is not None and good(v) and good(w) and len(v) == len(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= similarity:
                    n[p] += 1
                    n[q] += 1
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return sorted(((i, n[p], root(i)) for p, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block, bucket", [(1024, 16), (2, 1)])
def test_links_equal_brute_force(spark, block, bucket):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, keys string, n int").repartition(3)
    got = embeddings.classes(df, block=block, bucket=bucket).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_many_equal_and_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, base.tolist() if i % 3 == 0 else (base + rng.standard_normal(8) * 0.01).tolist(), 5) for i in range(150)]
    got = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_empty(spark):
    assert embeddings.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tables_bound_the_probability_to_miss_a_link():
    p = 1 - math.acos(0.93) / math.pi
    for bits in (6, 10, 20):
        assert (1 - p**bits) ** embeddings.tables(0.93, bits) <= embeddings.MISS


def test_very_large_and_very_small_doubles(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        base = rng.standard_normal(12)
        for scale in (1.0, 1e200, 1e-200, 1e-307, 1e306):
            rows.append((base + rng.standard_normal(12) * rng.choice([0.0, 0.2, 0.4])) * scale)
    scaled = [(i, (v / np.abs(v).max()).tolist(), 1) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = embeddings.classes(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(scaled)
    assert max(r.n_links for r in got) >= 3

import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import minhash


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    """Least id reachable of every id, by comparing all rows with all."""
    rows = [(d, sets_of(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in parent}


def chains(seed=3):
    """Families of near copies, each a few words from another one, in chains and about a centre."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 60, 200]))]
        member = base
        for _ in range(rng.randrange(1, 14)):
            member = list(rng.choice([base, member]))
            for _ in range(rng.randrange(0, 4)):
                member[rng.randrange(len(member))] = word()
            out.append(" ".join(member))
    out += ["", None, "   ", "one", "ONE", "one two", "one  two", "É x y", "é x y", "z " * 50, "z " * 51]
    rng.shuffle(out)
    rows = [(2 * i + 1, t) for i, t in enumerate(out)]
    return rows + [(1, rows[0][1]), (1, "a text of its own here"), (None, rows[0][1]), (None, None), (5, "L " + " ".join(f"v{i}" for i in range(40_000)))]


@pytest.mark.parametrize("k, num, den, block", [(3, 85, 100, 1024), (5, 80, 100, 2)])
def test_components_equal_brute_force(spark, k, num, den, block):
    rows = chains()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, band int").repartition(3)
    got = minhash.classes(docs, words=k, num=num, den=den, block=block).collect()
    want = brute(rows, k, num, den)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=repr) == sorted(((d, len(sets_of(t, k))) for d, t in rows), key=repr)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty(spark):
    assert minhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_similarity_and_always_fill():
    sketch, rng = minhash.Sketcher(128), np.random.default_rng(1)
    errors = []
    for n in (1, 2, 7, 128, 5000):
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = sketch(a[: n + n // 2]), sketch(a[n // 2 :])
        assert (x != np.iinfo(np.uint64).max).all()
        errors.append(np.mean(x == y) - len(set(a[: n + n // 2]) & set(a[n // 2 :])) / len(set(a)))
    assert max(map(abs, errors)) < 0.2


def test_bands_bound_the_probability_to_miss_a_link():
    for num in (70, 80, 85, 95):
        b = minhash.bands(num, 100)
        assert (1 - (num / 100) ** minhash.ROWS) ** b <= minhash.MISS < (1 - (num / 100) ** minhash.ROWS) ** (b - 1)


def test_pairs_in_blocks_meet_once(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm import blocks

    data = [("a", i, i % 7 == 0) for i in range(200)] + [("b", 1000 + i, False) for i in range(5)]
    rows = spark.createDataFrame([(k, i, not m, 205 if k == "z" else (200 if k == "a" else 5), 171 if k == "a" else 5) for k, i, m in data], "key string, id long, major boolean, n long, n_major long")

    def pairs(batches):
        import pyarrow as pa

        for t, starts, sides in blocks.units(batches):
            ids = t.column("id").to_numpy()
            for i, j in blocks.pairs_within(starts, sides):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    for major, block in ((None, 16), ("major", 16), (None, 1000)):
        got = blocks.dealt(rows, ["key"], "n", "id", block, ["id"], major, "n_major" if major else None).mapInArrow(pairs, "a long, b long")
        got = defaultdict(int, {(r.a, r.b): r["count"] for r in got.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")).collect()})
        assert set(got.values()) == {1}
        minor = {i for k, i, m in data if m}
        for k, i, _ in data:
            for q, j, _ in data:
                if i < j and k == q and (major is None or i in minor or j in minor):
                    assert (i, j) in got


def test_a_column_of_the_copies_name_stays(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "a"), (2, text.upper(), "b"), (3, "other words are here", "c"), (None, text, "d")], "doc_id long, text string, _GONE string")
    assert sorted(map(repr, map(tuple, minhash.dedup(docs).collect()))) == sorted(map(repr, [(1, text, "a"), (3, "other words are here", "c"), (None, text, "d")]))

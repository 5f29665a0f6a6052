import random
from collections import defaultdict

import pytest

from ledgerloom.llm import mixing


def shares(sizes, weights, factor, most):
    """The contract, literally: share by weight, stop, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, target = factor * sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
        if not open_:
            return target


def rows(n=600):
    rng = random.Random(2)
    out = [(None, "a b", None), (1, None, "b"), (2, "", "b"), (3, "w " * 9000, "c"), (4, " x\x0b y\x1c", "É"), (4, " x\x0b y\x1c", "É"), (4, "other", "É")]
    return out + [(10 + i, "w " * rng.randrange(1, 80), rng.choice(["hot", "hot", "hot", "s1", "s2", "s3", None, "z"])) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [mixing.CHUNK_ROWS, 3])
def test_targets_and_bounds(spark, chunk_rows):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(3)
    plan = mixing.plan(docs, chunk_rows=chunk_rows)
    got = plan.collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows():
        n = len((text or "").encode().split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = shares(sizes, (5, 2, 1), 1.5, 2)
    name = {("n" if s is None else "s" + s): s for s in sizes}
    taken = defaultdict(int)
    for r in got:
        s = name[r._key]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 2
        taken[s] += r.copies * r._size
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2 * largest[s], s
    assert sorted(map(repr, got)) == sorted(map(repr, plan.collect()))
    again = mixing.plan(docs.repartition(2), chunk_rows=chunk_rows)
    key = lambda r: repr((r._id, r._key, r._size, r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_mix_repeats_whole_rows(spark):
    data = [(*r, "k", i) for i, r in enumerate(rows(80))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _key string, copies int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = mixing.plan(docs)
    assert out.count() == plan.groupBy().sum("copies").first()[0]
    assert {r.copies for r in out.collect()} <= set(range(len(data)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], docs.schema)
    assert [(r._size, r.target, r.copies) for r in mixing.plan(none).collect()] == [(0, 0.0, 0)] * 2


def test_cuts_change_nothing(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 13 + i % 2 * 20), "ab"[i % 3 == 0]) for i in range(500)], "doc_id long, text string, source string")
    taken = lambda n: sorted((r._id, r.copies) for r in mixing.plan(docs, chunk_rows=n).collect())
    assert taken(3) == taken(40) == taken(mixing.CHUNK_ROWS)


def test_hot_entries_and_rows_that_differ_elsewhere(spark):
    """A third of all rows are one document, others share id and text and differ in a column that is a map."""
    data = [(7, "a b c", "s", 1, {"k": 1})] * 200 + [(None, "n%d" % (i % 3), "s", i, None) for i in range(100)] + [(8, "x y", "t", i, {"k": i}) for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _hash int, `a.b` map<string, int>").repartition(5)
    for chunk_rows in (mixing.CHUNK_ROWS, 5):
        plan = mixing.plan(docs, chunk_rows=chunk_rows).collect()
        assert len(plan) == len(data) and {r.copies for r in plan} <= {0, 1, 2}
        out = [sorted(map(repr, mixing.mix(d, chunk_rows=chunk_rows).collect())) for d in (docs, docs.repartition(2))]
        assert out[0] == out[1] and len(out[0]) == sum(r.copies for r in plan)
        assert set(out[0]) <= set(map(repr, docs.collect()))

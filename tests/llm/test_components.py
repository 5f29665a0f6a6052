import random

import pytest

from ledgerloom.llm.components import components


def brute(links):
    parent = {v: v for link in links for v in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {v: root(v) for link in links if link[0] != link[1] for v in link}


@pytest.mark.parametrize("kind", ["path", "star", "random", "odd"])
def test_equal_brute_force(spark, kind):
    rng = random.Random(1)
    ids = rng.sample(range(10**12), 120)
    links = {
        "path": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:]],
        "random": [tuple(rng.sample(ids, 2)) for _ in range(90)],
        "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3), (7, 7)],
    }[kind]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_differ_when_they_are_computed_again(spark):
    """A forest may come out otherwise each time; the components may not."""
    from pyspark.sql import functions as F

    n = 60
    # a path, of which each run gives every link in one of two equivalent forms
    again = spark.range(1, n).select(F.when(F.rand() < 0.5, F.lit(0)).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {r.component for r in components(again).collect()} == {0}

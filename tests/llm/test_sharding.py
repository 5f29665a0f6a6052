from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgerloom.llm.common import publish
from ledgerloom.llm.sharding import Store

SCHEMA = "doc_id long, text string, path string, tier int"


def batch(spark, first, n):
    return spark.createDataFrame([(i, "text %d " % i * (i % 7), None, 1) for i in range(first, first + n)], SCHEMA).repartition(2)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}", batch(spark, 0, 1).schema, target_bytes=40_000, arrival_rows=20)


def test_arrivals_merge_and_nothing_is_lost(spark, store):
    everything = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "", "x", 2), (2, "y" * 500_000, "p", 0)], SCHEMA)
    assert store.version() == -1 and store.read().count() == 0 and store.located().count() == 0
    for k in range(4):
        more = batch(spark, 100 * k, 90)
        assert store.append(more) == k
        everything = everything.unionByName(more)
    store.append(everything.limit(0))
    store.append(spark.createDataFrame(everything.take(4), everything.schema))
    before = store.version()
    small = store.manifest().count()
    want = rows(everything)
    assert rows(store.read()) == want
    after = store.compact()
    shards = store.manifest()
    assert after > before and shards.count() < small and rows(store.read()) == want
    assert shards.groupBy().sum("n_rows").first()[0] == everything.count()
    sizes = [r for r in shards.where("bytes * 2 < 40000").groupBy("tier").count().collect() if r["count"] >= store.fan]
    assert not sizes
    assert rows(store.read(before)) == want  # the versions before stay readable
    assert store.vacuum(after, 0) > 0 and rows(store.read()) == want
    assert store.compact() == after
    located = store.located()
    assert located.count() == everything.count() and located.select("path").distinct().count() == shards.count()


def test_of_two_writers_of_a_version_one_starts_again(spark, store):
    store.append(batch(spark, 0, 10))
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda k: store.append(batch(spark, 100 * k, 10)), (1, 2, 3)))
    assert sorted(versions) == [1, 2, 3] and store.read().count() == 40


def test_publishing_never_replaces(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(1).write.parquet(f"file://{tmp_path}/{name}")
    assert publish(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/to/x")
    assert not publish(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/to/x")
    assert (tmp_path / "b").exists() and not (tmp_path / "a").exists()


def test_vacuum_leaves_what_a_writer_has_not_committed_yet(spark, store, monkeypatch):
    store.append(batch(spark, 0, 50))
    commit, ran = Store._commit, []

    def late(self, manifest, on):
        if not ran:
            ran.append(Store(spark, self.root, self.schema).vacuum(on))  # another process cleans up between data and manifest
        return commit(self, manifest, on)

    monkeypatch.setattr(Store, "_commit", late)
    store.append(batch(spark, 100, 50))
    assert ran == [0] and store.read().count() == 100
    # and one that is listed before a manifest names its data
    monkeypatch.undo()
    manifest, added = Store.manifest, []

    def during(self, version=None):
        if not added:
            added.append(1)
            store.append(batch(spark, 200, 50))
        return manifest(self, version)

    monkeypatch.setattr(Store, "manifest", during)
    store.vacuum(0, 0)
    monkeypatch.undo()
    assert store.read().count() == 150
    spark.range(3).write.parquet(f"{store.root}/staged/left")
    assert store.vacuum(0) == 0 and store.vacuum(0, 0) == 0 and store.read().count() == 150
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/staged/left"))


def brute_tiers(sizes, target, fan, smallest):
    """Numbers of shards by (tier, final) that compaction may leave: no open tier is full."""
    import math

    tier = lambda b: max(0, math.floor(math.log(max(b, 1) / smallest) / math.log(fan)))
    out = {}
    for b in sizes:
        if b * 2 < target:
            out[tier(b)] = out.get(tier(b), 0) + 1
    return out


def test_compaction_against_plain_lists(spark, store):
    """Every version holds the rows of a plain list, and each compaction rewrites full tiers only."""
    from ledgerloom.llm import sharding

    plain = []
    for k in range(7):
        more = [(i, "text %d " % i * (i % 9), None, k) for i in range(1000 * k, 1000 * k + 10 + 37 * k)]
        plain += more
        store.append(spark.createDataFrame(more, SCHEMA).repartition(1 + k % 3))
        before = {r.path: r for r in store.manifest().collect()}
        full = {t for t, n in brute_tiers([r.bytes for r in before.values()], store.target_bytes, store.fan, sharding.SMALLEST).items() if n >= store.fan}
        store.compact()
        after = {r.path: r for r in store.manifest().collect()}
        assert sorted(map(repr, map(tuple, store.read().collect()))) == sorted(map(repr, plain))
        assert sum(r.n_rows for r in after.values()) == len(plain)
        for path, r in before.items():
            if r.bytes * 2 >= store.target_bytes:
                assert path in after  # final shards stay
            elif not full:
                assert path in after
        assert all(sum(r.tier == t and r.bytes * 2 < store.target_bytes for r in after.values()) < store.fan for t in range(20))

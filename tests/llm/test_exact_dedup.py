import hashlib
import random
from collections import defaultdict

import pytest

from ledgerloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").encode().lower()].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "a b"), (9, "a b"), (None, "only"), (None, "only"), (None, "É")]


def made(n=400):
    rng = random.Random(1)
    return ROWS + [(100 + i, rng.choice(["hot text", "t%d" % rng.randrange(60), "T%d" % rng.randrange(60)]) * rng.randrange(1, 4)) for i in range(n)]


@pytest.mark.parametrize("fold_bytes, table_bytes, levels", [(exact_dedup.FOLD_BYTES, exact_dedup.TABLE_BYTES, exact_dedup.LEVELS), (3000, 20_000, 4), (1, 10_000, 4), (3000, 20_000, 1)])
def test_equals_brute_force_at_any_table_size(spark, fold_bytes, table_bytes, levels):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_dedup.assign(docs, fold_bytes=fold_bytes, table_bytes=table_bytes, levels=levels).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_dedup_carries_all_columns_and_keeps_one_row_a_text(spark):
    rows = [(d, t, "g", [1, None], k) for k, (d, t) in enumerate(made(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_key string, n array<int>, body long")
    kept = exact_dedup.dedup(docs, fold_bytes=2000)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    texts = [(r.text or "").encode().lower() for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").encode().lower() for _, t in made(50)})
    assert {repr(r) for r in kept.collect()} <= {repr(r) for r in docs.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.assign(docs).count() == 0
    assert exact_dedup.dedup(docs).count() == 0

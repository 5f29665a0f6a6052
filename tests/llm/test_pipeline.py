"""The pipeline on a small table against a brute-force version of its stages."""

from collections import defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from ledgerloom.llm import minhash, mixing, pieces, quality
from tests.llm.test_minhash import brute, chains
from tests.llm.test_mixing import shares
from tests.llm.test_quality import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs, labels = corpus(260)
    rows = docs + [(1000 + i, t) for i, (_, t) in enumerate(chains())] + [(3000, docs[3][1].upper()), (3001, docs[3][1])]
    rows = [(d, t, "en", ["a", "a", "b", None][k % 4], None if t is None else len(t)) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{top}/labels.parquet")
    return f"file://{top}", rows


def test_stages_and_result_equal_brute_force(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = [r for r in rows if quality.votes(model, quality.terms([(r[1] or "").encode()]).astype(float))[0] >= 0.3]
    assert 0 < len(good) < len(rows)
    by = defaultdict(list)
    for r in good:
        by[(r[1] or "").encode().lower()].append(r)
    single = [max(v, key=lambda r: r[0]) for v in by.values()]
    assert len(single) < len(good)
    near = brute([(r[0], r[1]) for r in single], minhash.WORDS, *minhash.SIMILARITY)
    kept = [r for r in single if near[r[0]] == r[0]]
    assert len(kept) < len(single)
    # the stages, one by one
    stage = dict(corpus_pipeline.STAGES)
    got = stage["quality"](spark, docs, sf_dir)
    assert got.schema == docs.schema and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, good))
    got = stage["exact_dedup"](spark, spark.createDataFrame(good, SCHEMA), sf_dir)
    assert got.dtypes == docs.dtypes and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, single))
    got = stage["near_dedup"](spark, spark.createDataFrame(single, SCHEMA), sf_dir)
    assert got.dtypes == docs.dtypes and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, kept))
    # the whole
    size = lambda r: len((r[1] or "").encode().split())
    sizes = defaultdict(int)
    for r in kept:
        sizes[r[3]] += size(r)
    want = shares(sizes, mixing.WEIGHTS, mixing.FACTOR, mixing.MOST)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    text = {r[0]: r for r in kept}
    taken, copies = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        row = text[r.doc_id]
        taken[row[3]] += size(row)
        copies[r.doc_id] += 1
        assert r.n_tokens == len(lib.encode(row[1] or ""))
    assert max(copies.values()) <= mixing.MOST
    for source, n in taken.items():
        largest = max(size(r) for r in kept if r[3] == source)
        assert abs(n - want[source]) <= 2 * largest


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

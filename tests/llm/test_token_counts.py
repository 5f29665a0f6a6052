import base64
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import tiktoken

from ledgerloom.llm import token_counts as tc

DOCS = "doc_id long, text string, source string, lang string, n_tokens long"


def encoding():
    with open(tc.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def totals(rows):
    out, plain = defaultdict(lambda: [0, 0, 0]), encoding()
    for _, text, source, lang, _ in rows:
        sums = out[(source, lang)]
        for k, n in enumerate((1, len(plain.encode_ordinary(text or "")), len((text or "").encode()))):
            sums[k] += n
    return {k: tuple(v) for k, v in out.items()}


def got(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


ROWS = [(1, "Hello <|endoftext|> world", "a", "en", 0), (1, "Hello <|endoftext|> world", "a", "en", 0), (2, None, "a", None, 0), (None, "", None, "en", 0), (3, "é\n\n  x" * 20_000, "b", "fr", 0), (4, "one two", "a", "en", 7)]


def test_inserts_deletes_and_revisions(spark, tmp_path):
    rollup = tc.Rollup(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame(ROWS, DOCS)
    assert got(rollup) == {}
    assert rollup.commit("b1", tc.inserts(tc.counted(docs)))
    assert got(rollup) == totals(ROWS)
    assert not rollup.commit("b1", tc.inserts(tc.counted(docs)))
    assert got(rollup) == totals(ROWS)
    assert rollup.commit("empty", tc.inserts(tc.counted(docs.limit(0))))
    one = spark.createDataFrame(ROWS[4:5], DOCS)
    assert rollup.commit("b2", tc.deletes(tc.counted(one)))
    assert rollup.fold() and not rollup.commit("b2", tc.deletes(tc.counted(one)))
    gone = got(rollup)
    assert gone.pop(("b", "fr")) == (0, 0, 0) and gone == totals(ROWS[:4] + ROWS[5:])
    new = (4, "one two three", "c", "en", 7)
    assert rollup.commit("b3", tc.revisions(tc.counted(spark.createDataFrame(ROWS[5:], DOCS)), tc.counted(spark.createDataFrame([new], DOCS))))
    now = got(rollup)
    assert now.pop(("b", "fr")) == (0, 0, 0) and now == totals([*ROWS[:4], new])
    assert rollup.fold() and got(rollup)[("c", "en")] == now[("c", "en")]


def test_a_batch_sent_by_several_writers_counts_once(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: tc.Rollup(spark, f"file://{tmp_path}").commit("same", tc.inserts(tc.counted(docs))), range(3)))
    assert sorted(done) == [False, False, True]
    assert got(tc.Rollup(spark, f"file://{tmp_path}")) == totals(ROWS)


def test_the_query_commits_signed_batches_over_all_documents(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    sums, commit = {}, tc.Rollup.commit

    def seen(self, batch_id, changes):
        sums.setdefault(batch_id, changes.groupBy().sum("n_docs", "n_tokens").first()[:])
        return commit(self, batch_id, changes)

    monkeypatch.setattr(tc.Rollup, "commit", seen)
    rows = {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in tc.op9_token_counts(spark, str(tmp_path)).collect()}
    assert rows == totals(ROWS)
    assert sums["documents"][0] == len(ROWS) and sums["deleted"] == tuple(-x for x in sums["documents"]) and sums["again"] == sums["documents"]
    assert sums["revised"][0] == 0 < sums["revised"][1] == -sums["restored"][1]


def test_a_batch_that_is_committed_while_a_fold_runs_counts_once(spark, tmp_path, monkeypatch):
    rollup = tc.Rollup(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame(ROWS, DOCS)
    rollup.commit("one", tc.inserts(tc.counted(docs)))
    total = tc.Rollup._total

    def late(self, fold, beside):
        out = total(self, fold, beside)
        tc.Rollup(spark, f"file://{tmp_path}").commit("two", tc.inserts(tc.counted(docs)))
        return out

    for meanwhile in (True, False):
        if meanwhile:
            monkeypatch.setattr(tc.Rollup, "_total", late)
        assert rollup.fold()
        monkeypatch.undo()
        assert got(rollup) == {k: tuple(2 * x for x in v) for k, v in totals(ROWS).items()}
    assert rollup.vacuum(0) == 2 and got(rollup) == {k: tuple(2 * x for x in v) for k, v in totals(ROWS).items()}
    assert not rollup.commit("two", tc.inserts(tc.counted(docs))) and rollup.vacuum(0) == 0
    assert rollup.commit("three", tc.deletes(tc.counted(docs))) and rollup.fold() and got(rollup) == totals(ROWS)

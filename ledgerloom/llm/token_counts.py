"""Token counts as rollups that are maintained by signed deltas.

A *change* is an insert (+1 document, +n tokens), a delete (-1, -n) or a revision (0, new - old) of
a document. A batch of changes is summed by source, language and tokenizer version, beginning map
side, and committed under its id: the sums are staged and moved to ``batches/<id>`` in one step that
fails if that id has been committed. So a batch that is sent again, by a retry, a lost driver or two
writers, counts once, and readers see all of it or nothing. Totals are sums of sums. *Fold* puts the
totals and ids of the batches that it has listed into one table, in the same one-step way: what is
committed meanwhile is in neither, and counts beside it. *Vacuum* empties folded batches of a certain age.
So the sums that are read do not grow with the number of batches; their names do, and are listed on the
driver: one a batch, since a folded id is still known.

Counts are exact, from byte-pair merges of whole texts; null texts have no tokens. Sources and
languages may be null and are groups of their own. Rows are counted as often as they come: ids do
not matter here, and of repeated rows each counts. Groups whose documents and tokens have all gone
stay with zeros. An empty batch commits and changes nothing. Columns of other names do not matter.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import ages, children, drop_path, publish, shared_path, table, trimmed

VERSION = "byte_bpe_50k"
KEPT_SECONDS = 86_400.0
GROUP = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_bytes long"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", ranks_path: str | None = None, pattern: str | None = None, version: str = VERSION) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, version, n_tokens, n_bytes."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks_path or default_ranks(), "rb") as f:
        lines = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(3)]
            tokens = pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64())
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([version] * len(texts), pa.string()), tokens, sizes], ["doc_id", "source", "lang", "version", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, source string, lang string, version string, n_tokens long, n_bytes long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed sums of both sides: a document that changes its group leaves one and enters the other."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _sums(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(*GROUP).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))

    def _fold(self) -> int:
        return max((int(v) for v in children(self.spark, f"{self.root}/folds")), default=-1)

    def _folded(self, fold: int) -> DataFrame:
        if fold < 0:
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.schema("id string").parquet(f"{self.root}/folds/{fold:010d}/ids")

    def _base(self, fold: int) -> DataFrame:
        if fold < 0:
            return self.spark.createDataFrame([], _DELTA)
        return self.spark.read.schema(_DELTA).parquet(f"{self.root}/folds/{fold:010d}/sums")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing added, if its id has been committed."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError("a batch id is made of letters, digits, _, . and -")
        if batch_id in children(self.spark, f"{self.root}/batches"):
            return False
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self._sums(changes.select(*GROUP, *SUMS)).write.parquet(staged)
        done = publish(self.spark, staged, f"{self.root}/batches/{batch_id}")
        if not done:
            drop_path(self.spark, staged)
        return done

    def batches(self) -> list[str]:
        return children(self.spark, f"{self.root}/batches")

    def _listed(self) -> tuple[int, set[str], list[str]]:
        """The last fold, the ids in it, and the committed ones beside it."""
        fold = self._fold()
        known = {r.id for r in self._folded(fold).collect()}
        return fold, known, [b for b in self.batches() if b not in known]

    def _total(self, fold: int, beside: list[str]) -> DataFrame:
        rows = self._base(fold)
        if beside:
            rows = rows.unionByName(self.spark.read.schema(_DELTA).parquet(*(f"{self.root}/batches/{b}" for b in beside)))
        return self._sums(rows)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_bytes over all committed batches."""
        fold, _, beside = self._listed()
        return self._total(fold, beside)

    def fold(self) -> bool:
        """Keep the totals of all batches as one table; False if another writer has been faster."""
        fold, known, beside = self._listed()
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self._total(fold, beside).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(i,) for i in sorted(known.union(beside))], "id string").coalesce(1).write.parquet(f"{staged}/ids")
        done = publish(self.spark, staged, f"{self.root}/folds/{fold + 1:010d}")
        if not done:
            drop_path(self.spark, staged)
        return done

    def vacuum(self, older_than: float = KEPT_SECONDS) -> int:
        """Empty the batches of the newest fold older than ``older_than`` seconds, and drop the folds before it and old staged files; how many batches.

        Readers that began on an earlier fold must be done by that age. The empty directories keep the ids known.
        """
        old = [int(v) for v, age in ages(self.spark, f"{self.root}/folds").items() if age >= older_than]
        emptied = 0
        for b in (r.id for r in self._folded(max(old)).collect()) if old else ():
            files = children(self.spark, f"{self.root}/batches/{b}")
            for f in files:
                drop_path(self.spark, f"{self.root}/batches/{b}/{f}")
            emptied += bool(files)
        for v in sorted(old)[:-1]:
            drop_path(self.spark, f"{self.root}/folds/{v:010d}")
        for d, age in ages(self.spark, f"{self.root}/staged").items():
            if age >= older_than:
                drop_path(self.spark, f"{self.root}/staged/{d}")
        return emptied


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents have been inserted, revised and revised back, deleted and inserted again, by batches that are sent twice."""
    rollup, path = Rollup(spark, shared_path(spark, "token-counts")), shared_path(spark, "counted")
    docs = table(spark, sf_dir, "documents")
    for name, rows in (("old", docs), ("new", docs.withColumn("text", F.concat("text", F.lit("\n"), F.upper("text"))))):
        counted(rows).write.parquet(f"{path}/{name}")
    old, new = (spark.read.schema("doc_id long, " + _DELTA.replace("n_docs long, ", "")).parquet(f"{path}/{name}") for name in ("old", "new"))
    for batch_id, changes in (("documents", inserts(old)), ("revised", revisions(old, new)), ("restored", revisions(new, old)), ("deleted", deletes(old)), ("again", inserts(old))):
        rollup.commit(batch_id, changes)
        rollup.commit(batch_id, changes)
        if batch_id == "revised":
            rollup.fold()
    rollup.fold()
    return rollup.totals()

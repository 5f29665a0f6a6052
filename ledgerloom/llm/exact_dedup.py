"""Exact deduplication by Grace hashing.

1. *Fold* (map side, one pass over the input): each task folds equal texts in a hash table with
   open addressing that compares complete content (CPython's ``dict`` on the bytes is one). The
   table is bounded: at ``fold_bytes`` of content it is emitted and begun anew. A text that a third
   of all rows share therefore leaves a task a few times, not once a row. Every row leaves as
   (row, group of this task); only one row of each local group carries its content. The rows are
   written to the shared folder: these are the spill files of the Grace partitioning.
2. *Partition*: local groups are dealt to buckets by a hash of the content. A bucket whose
   distinct content exceeds ``table_bytes`` is dealt again by another, independent hash, until
   every bucket fits. The recursion works on hashes and sizes alone, in DataFrames; the content
   moves once, to its final bucket. Several copies of one content count once, since a table holds
   one of them, so a bucket that cannot be split further holds a single text. There are as many
   partitions as buckets, up to ``MOST_PARTITIONS``, so a task's share does not grow with the input.
3. *Build*: bucket after bucket, a task streams the content into the open-addressing table and
   compares complete content; a hash alone never makes two texts equal. Buckets that the last
   level leaves too full, which independent hashes make next to impossible, are grouped by their
   complete content in Spark, which sorts and spills instead.
4. The rows of step 1 learn their group's result by a join on the local group's key. Its keys have
   at most as many rows as one table of one task, so no key is hot.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
the row with the largest id stays (null ids are the smallest); of rows that also share the id,
exactly one stays. Empty tables give empty results; very long texts are whole and may make up a
bucket by themselves; other columns are carried untouched, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, drop_path, shared_path, table, trimmed

FOLD_BYTES = 32 << 20
TABLE_BYTES = 32 << 20
LEVELS = 4
MOST_PARTITIONS = 50_000
FAN = 64
BROADCAST_BUCKETS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASHES = [f"h{i}" for i in range(LEVELS)]
_FOLDED = "row_key long, id long, group_key long, sha string, n_bytes long, n long, " + ", ".join(f"{h} long" for h in _HASHES)
_FOLDED_PA = pa.schema([("row_key", pa.int64()), ("id", pa.int64()), ("group_key", pa.int64()), ("sha", pa.string()), ("n_bytes", pa.int64()), ("n", pa.int64()), *((h, pa.int64()) for h in _HASHES)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fold(carried: str | None, fold_bytes: int):
    """Batches of (id, text), or of (id, row struct) with the text's name in ``carried``, to folded rows.

    The row that stays carries ``body``: its text in normal form, or its struct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        made = 0  # rows and groups so far
        groups: dict[bytes, int] = {}
        held = 0
        rows: list[tuple] = []  # (row_key, id, group number)
        best: list[list] = []  # per group: (id is known, id, row_key) of the row that stays, count, body
        kinds: pa.DataType | None = None

        def emit() -> Iterator[pa.RecordBatch]:
            texts = list(groups)
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            out: dict[str, list] = {n: [] for n in _FOLDED_PA.names}
            bodies: list = []

            def batch() -> pa.RecordBatch:
                arrays = [pa.array(out[f.name], f.type) for f in _FOLDED_PA]
                if carried is not None:
                    arrays.append(pa.concat_arrays([pa.nulls(1, kinds) if b is None else b for b in bodies]))
                else:
                    arrays.append(pa.array(bodies, pa.binary()).cast(pa.string()))
                for column in (*out.values(), bodies):
                    column.clear()
                return pa.RecordBatch.from_arrays(arrays, [*_FOLDED_PA.names, "body"])

            written = 0
            for key, doc, k in rows:
                (_, _, group_key), n, body = best[k]
                head = group_key == key
                text = texts[k] if head else b""
                written += len(text)
                values = [key, doc, group_key, shas[k], *([len(text), n] if head else [None, None])]
                values += [_signed(xxhash.xxh3_64_intdigest(text, seed=i + 1)) if head else None for i in range(LEVELS)]
                for column, value in zip(out.values(), values):
                    column.append(value)
                bodies.append(body if head else None)
                if len(bodies) == 4096 or written > 16 << 20:
                    yield batch()
                    written = 0
            if bodies:
                yield batch()

        for batch in batches:
            body = batch.column(1) if carried is not None else None
            kinds = body.type if carried is not None else None
            texts = batch.column(1) if carried is None else pc.struct_field(body, carried).cast(pa.string()).cast(pa.binary())
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
                content = (text.as_py() or b"").lower()  # on bytes: A-Z only
                key = base + made
                made += 1
                rank = (doc is not None, doc or 0, key)
                at = groups.get(content)
                if at is None:
                    at = groups[content] = len(best)
                    best.append([rank, 1, content if carried is None else body.take(pa.array([k]))])
                    held += len(content) * (1 if carried is None else 2) + 200
                else:
                    known = best[at]
                    known[1] += 1
                    if rank > known[0]:
                        known[0] = rank
                        if carried is not None:
                            known[2] = body.take(pa.array([k]))
                rows.append((key, doc, at))
                held += 120
                if held >= fold_bytes:
                    yield from emit()
                    groups, rows, best, held = {}, [], [], 0
        if rows:
            yield from emit()

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, with whole texts: one open-addressing table a bucket."""
    bucket, groups, members, best = None, {}, [], []

    def emit() -> Iterator[pa.RecordBatch]:
        for start in range(0, len(members), 50_000):
            part = members[start : start + 50_000]
            of = [best[k] for _, k in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in part], pa.int64()), pa.array([b[0][1] if b[0][0] else None for b in of], pa.int64()), pa.array([b[0][2] for b in of], pa.int64()), pa.array([b[1] for b in of], pa.int64())],
                ["group_key", "keep_id", "keep_row", "group_size"],
            )

    for batch in batches:
        for b, key, top, n, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
            if b != bucket:
                yield from emit()
                bucket, groups, members, best = b, {}, [], []
            content = (text.as_py() or b"").lower()
            rank = (top is not None, top or 0, key)
            at = groups.get(content)
            if at is None:
                at = groups[content] = len(best)
                best.append([rank, n])
            else:
                best[at] = [max(best[at][0], rank), best[at][1] + n]
            members.append((key, at))
    yield from emit()


class _Buckets(NamedTuple):
    first: int  # buckets of the first level
    over: list[DataFrame]  # for each further level, the buckets dealt again
    rest: DataFrame | None  # buckets that the last level leaves too full
    final: int  # all buckets, about


def _levels(heads: DataFrame, table_bytes: int, levels: int) -> _Buckets:
    open_ = cut(heads.groupBy(*_HASHES).agg(F.max(F.col("n_bytes") + 200).alias("bytes")))  # one of equal contents counts
    n = total = max(1, -(-2 * (open_.agg(F.sum("bytes")).first()[0] or 0) // table_bytes))
    open_ = open_.withColumn("bucket", F.pmod(F.col("h0"), F.lit(n)).cast("string"))
    over: list[DataFrame] = []
    for level in range(1, levels + 1):
        sizes = open_.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("texts"))
        full = cut(sizes.where((F.col("bytes") > table_bytes) & (F.col("texts") > 1)).select("bucket", F.lit(True).alias("over")))
        several = full.count()
        if not several:
            return _Buckets(n, over, None, total)
        if level == levels:
            return _Buckets(n, over, full.select("bucket"), total)
        over.append(full)
        total += several * FAN
        open_ = _split(open_.join(full, "bucket"), level)


def _split(rows: DataFrame, level: int) -> DataFrame:
    again = F.concat_ws(".", "bucket", F.pmod(F.col(f"h{level}"), F.lit(FAN)))
    return rows.withColumn("bucket", F.when(F.col("over"), again).otherwise(F.col("bucket"))).drop("over")


def _deal(rows: DataFrame, n: int, over: list[DataFrame]) -> DataFrame:
    """``rows`` with their final bucket. Lists of full buckets are broadcast up to BROADCAST_BUCKETS."""
    rows = rows.withColumn("bucket", F.pmod(F.col("h0"), F.lit(n)).cast("string"))
    for level, full in enumerate(over, 1):
        small = full.count() <= BROADCAST_BUCKETS
        rows = _split(rows.join(F.broadcast(full) if small else full, "bucket", "left"), level)
    return rows


def _sorted_out(rows: DataFrame) -> DataFrame:
    """What ``_build`` gives, by Spark's grouping of the complete content."""
    rows = rows.select("group_key", "id", "n", F.translate(F.col("content").cast("string"), _UPPER, _UPPER.lower()).alias("low"))
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), F.col("group_key").alias("row"))).alias("best")
    groups = rows.groupBy("low").agg(best, F.sum("n").alias("group_size"))
    return rows.select("group_key", "low").join(groups, "low").select("group_key", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def _run(docs: DataFrame, id_col: str, text_col: str, carried: bool, fold_bytes: int, table_bytes: int, levels: int, finish) -> DataFrame:
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.struct("*").alias("body") if carried else F.col(text_col).cast("binary").alias("text"))
    schema = T._parse_datatype_string(_FOLDED)
    schema = T.StructType([*schema.fields, T.StructField("body", docs.schema if carried else T.StringType())])
    path = shared_path(spark, "grace")
    narrow.mapInArrow(trimmed(_fold(text_col if carried else None, fold_bytes)), schema).write.parquet(path)
    spilled = spark.read.schema(schema).parquet(path)
    heads = spilled.where("n is not null")
    text = F.col("body")[text_col] if carried else F.col("body")
    buckets = _levels(heads.select("n_bytes", *_HASHES), table_bytes, levels)
    dealt = _deal(heads.select("group_key", "id", "n", text.cast("binary").alias("content"), *_HASHES), buckets.first, buckets.over)
    dealt = dealt.select("bucket", "group_key", "id", "n", "content")
    fits = dealt if buckets.rest is None else dealt.join(buckets.rest, "bucket", "left_anti")
    partitions = min(buckets.final, MOST_PARTITIONS)
    # first buckets lie one by one; those dealt again by hash
    at = F.when(F.contains("bucket", F.lit(".")), F.pmod(F.xxhash64("bucket"), F.lit(partitions))).otherwise(F.pmod(F.col("bucket").try_cast("long"), F.lit(partitions))).cast("int")
    fits = fits.repartitionById(partitions, at).sortWithinPartitions("bucket")
    found = fits.mapInArrow(trimmed(_build), "group_key long, keep_id long, keep_row long, group_size long")
    if buckets.rest is not None:
        found = found.unionByName(_sorted_out(dealt.join(buckets.rest, "bucket", "left_semi")))
    return finish(spilled, cut(found), path)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_bytes: int = FOLD_BYTES, table_bytes: int = TABLE_BYTES, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""

    def finish(spilled: DataFrame, found: DataFrame, path: str) -> DataFrame:
        joined = spilled.select("row_key", "id", "group_key", "sha").join(found, "group_key")
        out = cut(joined.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")))
        drop_path(docs.sparkSession, path)
        return out

    return _run(docs, id_col, text_col, False, fold_bytes, table_bytes, levels, finish)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_bytes: int = FOLD_BYTES, table_bytes: int = TABLE_BYTES, levels: int = LEVELS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The result reads the written partition files, which stay in the shared folder with it.
    """

    def finish(spilled: DataFrame, found: DataFrame, path: str) -> DataFrame:
        stay = found.where(F.col("group_key") == F.col("keep_row")).select(F.col("keep_row").alias("row_key"))
        return spilled.where("n is not null").select("row_key", "body").join(stay, "row_key").select("body.*")

    return _run(docs, id_col, text_col, True, fold_bytes, table_bytes, levels, finish)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

"""Pairs inside buckets, dealt out in blocks of bounded size and compared in vectors.

A bucket of up to ``block`` rows is one unit. A larger one is cut into blocks by a hash, and each
pair of its blocks is a unit of its own, so no task ever holds more than two blocks of a bucket,
however many rows share a key. Units are made of pairs of rows but emit none of their own accord.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows gathered before whole units are handed on; pairs of indices handed on at once.
GATHERED, PAIRS = 8192, 20_000

def dealt(rows: DataFrame, key: list[str], n: str, by: str, block: int, keep: list[str], major: str | None = None, n_major: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``rows``, repeated for each unit they belong to, with ``_unit``, ``_check`` and ``_side``, sorted by unit.

    ``n`` is the number of rows of the bucket, null where it is known to be ``block`` at most; ``by`` is a
    column whose hash cuts it into blocks. ``major`` marks rows (``n_major`` of the bucket's) that need not
    meet one another: blocks of them meet blocks of the others only, so a bucket costs its other rows times all its rows.
    """
    count = lambda c: F.ceil(c / F.lit(block)).cast("int")
    is_major = F.col(major) if major else F.lit(False)
    majors = F.col(n_major) if n_major else F.lit(0)
    minor_blocks, major_blocks = F.greatest(F.lit(1), count(F.col(n) - majors)), count(majors)
    out = rows.withColumns({"_a": minor_blocks, "_b": major_blocks, "_major": is_major, "_whole": F.coalesce(F.col(n) <= block, F.lit(True))})
    out = out.withColumn("_mine", F.pmod(F.xxhash64(F.lit(11), by), F.when(F.col("_major"), F.col("_b")).otherwise(F.col("_a"))).cast("int"))
    unit = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"), side.cast("int").alias("side"))
    mine = F.col("_mine")
    each = lambda blocks: F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)
    with_minors = F.transform(each(F.col("_a")), lambda k: unit("m", F.least(mine, k), F.greatest(mine, k), F.when(mine == k, 0).when(mine < k, 1).otherwise(2)))
    with_majors = F.when(F.col("_b") > 0, F.transform(each(F.col("_b")), lambda k: unit("x", mine, k, F.lit(1)))).otherwise(F.slice(with_minors, 1, 0))
    as_major = F.transform(each(F.col("_a")), lambda k: unit("x", k, mine, F.lit(2)))
    alone = F.array(unit("w", F.lit(0), F.lit(0), F.lit(0)))
    out = out.withColumn("_u", F.explode(F.when(F.col("_whole"), alone).when(F.col("_major"), as_major).otherwise(F.concat(with_minors, with_majors))))
    name = [*key, "_u.kind", "_u.low", "_u.high"]
    # 128 bits stand for the unit, so that two units are never taken for one
    out = out.select(*keep, F.xxhash64(*name).alias("_unit"), F.xxhash64(F.lit(7), *name).alias("_check"), F.col("_u.side").alias("_side"))
    return out.repartition(F.col("_unit")).sortWithinPartitions("_unit", "_check")


def array_of(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def matrix(lists: pa.ListArray) -> np.ndarray:
    """A row a list; shorter lists end in zeros."""
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def units(batches: Iterator[pa.RecordBatch], gathered: int = GATHERED) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole units: a table of rows, the first row of each unit (and the end), and the sides."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table, codes: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
        return t.combine_chunks(), starts, t.column("_side").to_numpy()

    def codes_of(t: pa.Table) -> np.ndarray:
        a, b = t.column("_unit").to_numpy(), t.column("_check").to_numpy()
        return np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))

    for batch in batches:
        for start in range(0, len(batch), gathered):
            held.append(batch.slice(start, gathered))
            if sum(map(len, held)) < gathered:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            codes = codes_of(t)
            last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if codes[0] != codes[-1] else 0
            if last:
                yield out(t.slice(0, last), codes[:last])
            held = t.slice(last).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if len(t):
            yield out(t, codes_of(t))


def pairs_within(starts: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of every pair of a unit, of different sides in a unit of two blocks, in bounded pieces."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    small = np.repeat(sizes <= 64, sizes)
    row = np.arange(len(end))
    gathered: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def crossing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = (sides[i] == 0) | (sides[i] != sides[j])
        return i[use], j[use]

    for d in range(1, min(64, int(sizes.max(initial=0)))):
        i = row[small & (row + d < end)]
        if not len(i):
            break
        gathered.append(crossing(i, i + d))
        n += len(gathered[-1][0])
        if n > PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*gathered))
            gathered, n = [], 0
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a <= 64:
            continue
        step = max(1, PAIRS // int(b - a))
        for first in range(int(a), int(b), step):
            i, j = np.triu_indices(min(step, int(b) - first), 1, int(b) - first)
            gathered.append(crossing(i + first, j + first))
            n += len(gathered[-1][0])
            if n > PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*gathered))
                gathered, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*gathered))

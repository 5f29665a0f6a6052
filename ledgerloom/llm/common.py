"""What the operators of this subpackage share: shared-folder state, column hygiene, ids.

Everything an operator keeps between jobs goes through ``cut`` (a reliable checkpoint) or
``shared_path`` (a written table), both below the folder in ``spark.checkpoint.dir``. No file
leaves a task by any other way, so a lost executor costs a recomputation and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import checkpoint_dir, cut, shared_path  # noqa: F401

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, wherever the shared folder is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``f``, after whose last batch the Python worker gives back the memory that it no longer uses.

    Workers outlive tasks and stages, and what one stage has freed would count against the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table of its own in the shared folder, and its path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Move a finished directory to ``target`` in one step; False, and nothing moved, if that exists."""
    jvm = spark._jvm
    hadoop, conf = jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, to = hadoop.Path(staged), hadoop.Path(target)
    to.getFileSystem(conf).mkdirs(to.getParent())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(source.toUri(), conf).rename(source, to, none)
    except Py4JJavaError as e:
        if to.getFileSystem(conf).exists(to):
            return False
        raise e
    return True


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory; none if it does not exist."""
    return sorted(ages(spark, path))


def ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a directory with the seconds since each was changed; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}

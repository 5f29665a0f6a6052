"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) take the weights in turn and share ``factor``
times all words. A target stops at ``most`` times its source's words; what is above is shared
again by weight among the others until none is above. Sorted by stop over weight, the stopped
sources are a prefix, so two running sums over the table of sources give the common level.

Sampling: within a source every document is expected ``target / source words`` times. The
documents are lined up by size, the expected copies are summed along the line, one random offset
for the source is added, and a document is emitted once for every integer that its stretch of
the sum crosses. So it is taken floor or ceiling of its expectation times, and the source's words
differ from its target by about its largest document at most.

Rows with equal ids, sources and texts are one *entry* with their number; it is counted before it is
dealt, so it may be a third of all rows. The line of entries, by size class, size and hash of id and
text, is never one task's: it is cut into chunks by size and, where a size of a source has more
entries than ``chunk_rows``, by the first digits of the hash, so that cuts change no place. An entry's
place is its place in its chunk plus the rows of the chunks before it, which a running sum over the
table of chunks gives. Rows of an entry take the places that it has, one each.

Null texts and texts without words have size 0 and take 0 words. Null sources are one source. Null ids
are told apart by their texts. An empty table gives an empty result. Very long texts are whole. Other
columns do not matter to ``plan``; ``mix`` carries them, whatever they are called, and tells rows apart
that differ in them only. Reruns agree, since the line and the offsets depend on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut, n_words, table

WEIGHTS = (5, 2, 1)
FACTOR = 1.5
MOST = 2
SEED = "mix"
CHUNK_ROWS = 10_000
BROADCAST_KEYS = 200_000


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per source of (``_source``, ``_size``): ``_key``, source_size, target, rate and offset."""
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("_source").asc_nulls_last())
    by_stop = W.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    cycle = F.array(*(F.lit(w) for w in weights))
    s = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)).withColumn("stop", F.lit(most) * F.col("source_size"))
    s = s.withColumn("stopped", F.coalesce(F.sum("stop").over(by_stop), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(by_stop), F.lit(0)))
    s = s.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.lit(factor) * F.col("all_size") - F.col("stopped")) / (F.col("all_weight") - F.col("spent")))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("spent", "level")))
    s = s.withColumn("level", first.over(everything)["level"])
    target = F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), _key(F.col("_source"))).cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    return s.select(
        _key(F.col("_source")).alias("_key"), "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"),
    )


def _entries(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    """Columns of the entry of each row: _id, _source, _size, _hash, and _more for what ``whole`` rows hold besides."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    columns = [F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(text).alias("_size")]
    more = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if _unhashable(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema)) if whole else F.lit(0).cast("long")
    mark = F.md5(F.concat_ws(":", id_, F.md5(text.cast("binary"))).cast("binary"))
    return docs.select(*columns, mark.alias("_hash"), more.alias("_more"), *([F.struct("*").alias("_row")] if whole else []))


def _unhashable(t: T.DataType) -> bool:
    return any(k in t.simpleString() for k in ("map<", "variant"))


_ENTRY = ["_id", "_source", "_size", "_hash", "_more"]


def _placed(entries: DataFrame, weights: tuple[int, ...], factor: float, most: int, seed: str, chunk_rows: int) -> DataFrame:
    """Per entry of (_ENTRY, n): _key, source_size, target, rate, offset and _before, the rows in line before it."""
    digits = F.col("_size").cast("string")
    line = entries.select("*", _key(F.col("_source")).alias("_key"), (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("_class"))
    largest = line.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    width = 0
    while largest > chunk_rows * 16**width:
        width += 1
    line = line.withColumn("_part", F.substring("_hash", 1, width))
    chunk = ["_key", "_class", "_size", "_part"]
    before = W.partitionBy("_key").orderBy("_class", "_size", "_part").rowsBetween(W.unboundedPreceding, -1)
    chunks = line.groupBy(*chunk).agg(F.sum("n").alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    sized = entries.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("_size"))
    chunks = chunks.join(targets(sized, weights, factor, most, seed), "_key")
    inside = W.partitionBy(*chunk).orderBy("_hash", "_more", "_id").rowsBetween(W.unboundedPreceding, -1)
    placed = line.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(chunks, chunk)
    return placed.withColumn("_before", F.col("_start") + F.col("_inside"))


def _crossed(before, to):
    """Integers that the stretch of the sum from ``before`` to ``to`` rows crosses."""
    return (F.floor(to * F.col("rate") + F.col("offset")) - F.floor(before * F.col("rate") + F.col("offset"))).cast("long")


def _each(rows: DataFrame, n: str, turn: str) -> DataFrame:
    """Every row ``n`` times, with its turn from 1; a hundred thousand at a time are held."""
    step = 100_000
    rows = rows.where(F.col(n) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long"))))
    return rows.withColumn(turn, F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + step, F.col(n))))).drop("_from")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST, seed: str = SEED, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row of ``docs``: _id, _size, _key (of the source), source_size, target, copies."""
    entries = cut(_entries(docs, id_col, text_col, source_col, False).groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("n")))
    rows = _each(_placed(entries, weights, factor, most, seed, chunk_rows), "n", "_turn")
    to = F.col("_before") + F.col("_turn")
    return rows.select("_id", "_size", "_key", "source_size", "target", _crossed(to - 1, to).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: int = MOST, seed: str = SEED, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The mix: rows of ``docs`` with all their columns, each as often as the plan takes it.

    The plan is made on narrow rows; whole rows are dealt once, to meet the number of their copies. Rows
    that are equal in every column are one there, and its copies are theirs together.
    """
    rows = _entries(docs, id_col, text_col, source_col, True)
    entries = cut(rows.drop("_row").groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("n")))
    taken = _placed(entries, weights, factor, most, seed, chunk_rows)
    taken = cut(taken.select("_hash", "_more", "_key", "n", _crossed(F.col("_before"), F.col("_before") + F.col("n")).alias("copies")).where("copies > 0"))
    on = ["_hash", "_more", "_key"]
    wide = rows.select("_row", "_hash", "_more", _key(F.col("_source")).alias("_key"))
    found = wide.join(taken.where("n = 1"), on).select("_row", "copies")
    several = taken.where("n > 1")
    if number := several.count():
        # they are few or hot, and folded before they are dealt; their keys are broadcast up to BROADCAST_KEYS
        keys = several.select(*on)
        folded = wide.join(F.broadcast(keys) if number <= BROADCAST_KEYS else keys, on, "left_semi").groupBy(*on).agg(F.first("_row").alias("_row"))
        found = found.unionByName(folded.join(several, on).select("_row", "copies"))
    return _each(found, "copies", "_turn").select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("_size")).alias("taken")
    return plan(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS stop FROM sums
), levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(stop) OVER before, 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY stop::DOUBLE / weight, place) AS turn
  FROM weighed WINDOW before AS (ORDER BY stop::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT level AS height FROM levels WHERE level * weight <= stop ORDER BY turn LIMIT 1
), goals AS (
  SELECT source, source_size, least(CAST(stop AS DOUBLE), height * weight) AS target,
    ('0x' || substr(md5('mix' || coalesce('s' || source, 'n')), 1, 4))::BIGINT / 65536.0::DOUBLE AS shift
  FROM levels, common
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.shift,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY len(CAST(s.size AS VARCHAR)) * 100 + CAST(substr(CAST(s.size AS VARCHAR), 1, 2) AS INT),
      s.size, md5(concat_ws(':', coalesce(CAST(s.doc_id AS VARCHAR), ''), s.mark))) AS place
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(place * rate + shift) - floor((place - 1) * rate + shift) AS BIGINT) * size AS taken
FROM placed
"""

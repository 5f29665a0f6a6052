"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Every table holds the signs of a vector's products with ``bits`` random hyperplanes. The number of
bits follows from the largest group of vectors that are compared (about ``bucket`` unrelated ones
share a key, as many as cost about what one more table costs); the number of tables is the least for which a pair at the threshold meets in none
with probability ``miss`` (1e-6), so misses are as rare at every size.

First only ids and signs are dealt to the buckets. A row goes on where it meets another one whose
signs over all tables differ in few enough places (seven standard deviations beyond what the
threshold leads to expect); there the vectors follow, in blocks, and cosines are computed in double
precision, of vectors scaled by their largest component, so that no size of finite numbers overflows or vanishes. A pair that meets in several tables counts in the first of them. What leaves a unit
are numbers of links of each vector and a spanning forest, never all pairs.

Vectors are compared when labels are equal and not null, and only with vectors of their length.
Vectors that are null, empty or zero, or hold nulls or values that are not finite, link with
nothing. Equal vectors of a label are one class, counted with its size. Rows that share an id are
vectors of their own with one component. Rows without an id take part in nothing: n_links is 0,
component_id null, kept true. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.blocks import array_of, dealt, matrix, pairs_within, units
from ledgerloom.llm.common import cut, table, trimmed
from ledgerloom.llm.components import components

SIMILARITY, MISS = 0.93, 1e-6
BUCKET, BLOCK, SEED = 128, 1024, 1
LEAST_PLANES = 256
BROADCAST_BUCKETS = 100_000


def tables(similarity: float, bits: int, miss: float = MISS) -> int:
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows over their largest component, as doubles."""
    v = v.astype(np.float64)
    return v / np.abs(v).max(1, keepdims=True)


def _signs(bits: int, n_tables: int, seed: int):
    """(vec, label, vector, copies) with ``keys`` (one of ``bits`` bits a table) and ``signs`` (all bits)."""
    n = max(bits * n_tables, LEAST_PLANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                lists = batch.column("vector")
                sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                begins = np.cumsum(sizes) - sizes
                up = np.zeros((len(batch), n), bool)
                for size in np.unique(sizes):
                    of = np.flatnonzero(sizes == size)
                    if size not in planes:
                        planes[size] = np.random.default_rng(seed).standard_normal((n, size)).T
                    up[of] = _scaled(flat[begins[of][:, None] + np.arange(size)]) @ planes[size] > 0
                keys = (up[:, : bits * n_tables].reshape(-1, n_tables, bits) @ weights).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * n_tables, pa.int32()), pa.array(keys.ravel()))
                signs = pa.array([x.tobytes() for x in np.packbits(up, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, keys, signs], ["vec", "label", "vector", "copies", "keys", "signs"])

    return run


def _words(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    width = len(raw[0])
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(np.pad(flat, ((0, 0), (0, -width % 8)))).view(np.uint64)


def _near(most: int):
    """Units of signs to the rows that meet a row whose signs are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sides in units(batches):
            words = _words(rows.column("signs"))
            hit = np.zeros(len(words), bool)
            for i, j in pairs_within(starts, sides):
                near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= most
                hit[i[near]] = True
                hit[j[near]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows.column(n).to_numpy()[hit]) for n in ("vec", "place")], ["vec", "place"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Labels of n rows joined by pairs: rows with one label, and only they, are connected."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(similarity: float):
    """Units of vectors to (vec, n links, other): counts of each row, and a link to its tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sides in units(batches):
            v = _scaled(matrix(array_of(rows, "vector")))
            length = np.sqrt(np.einsum("ij,ij->i", v, v))
            v = v / length[:, None]
            place, copies = rows.column("place").to_numpy(), rows.column("copies").to_numpy()
            keys = matrix(array_of(rows, "keys"))
            count = np.zeros(len(rows), np.int64)
            linked: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in pairs_within(starts, sides):
                near = np.einsum("ij,ij->i", v[i], v[j]) >= similarity
                i, j = i[near], j[near]
                first = (keys[i] == keys[j]).argmax(1) == place[i]
                np.add.at(count, i[first], copies[j[first]])
                np.add.at(count, j[first], copies[i[first]])
                linked.append((i[first], j[first]))
            if not count.any():
                continue
            i, j = (np.concatenate(x) for x in zip(*linked))
            root = _forest(i, j, len(rows))
            vec = rows.column("vec").to_numpy()
            out = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(vec[out]), pa.array(count[out]), pa.array(vec[root[out]])], ["vec", "n", "other"])

    return run


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, miss: float = MISS, bucket: int = BUCKET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per row of ``vectors``: id, n_links, component_id (least id reachable), kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    # 128 bits stand for a label and a vector
    rows = rows.withColumn("usable", usable)
    rows = rows.select("id", "label", "vector", "usable", *(F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "vector")).alias(f"mark{k}") for k in (1, 2)))
    marks = ["mark1", "mark2"]
    thin_rows = cut(rows.select("id", "usable", *marks))
    # equal vectors are one class with a number of its own, since ids may be shared
    heads = thin_rows.where("usable").groupBy(*marks).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    heads = cut(heads.select(F.monotonically_increasing_id().alias("vec"), "id", "copies", *marks))
    signed = rows.where("usable").select("id", "label", "vector", *marks).join(heads, [*marks, "id"]).dropDuplicates(["vec"]).select("vec", "label", "vector", "copies")
    signed = cut(signed)
    sizes = signed.groupBy("label", F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 1
    bits = min(24, max(6, math.ceil(math.log2(max(1, largest / bucket)))))
    n_tables = tables(similarity, bits, miss)
    schema = T.StructType([*signed.schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType())), T.StructField("signs", T.BinaryType())])
    hashed = cut(signed.mapInArrow(trimmed(_signs(bits, n_tables, seed)), schema))
    thin = hashed.select("vec", "label", F.size("vector").alias("length"), "signs", F.posexplode("keys").alias("place", "key"))
    key = ["label", "length", "place", "key"]
    # only buckets of over a block are known by their size; their list is broadcast up to BROADCAST_BUCKETS
    large = cut(thin.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    q = math.acos(similarity) / math.pi
    planes = max(bits * n_tables, LEAST_PLANES)
    most = math.ceil(planes * q + 7 * math.sqrt(planes * q * (1 - q)))
    near = dealt(thin.join(large, key, "left"), key, "n", "vec", block, ["vec", "place", "signs"]).mapInArrow(trimmed(_near(most)), "vec long, place int").distinct()
    wide = near.join(hashed, "vec").select("vec", "label", F.size("vector").alias("length"), "place", F.element_at("keys", F.col("place") + 1).alias("key"), "vector", "copies", "keys")
    wide = dealt(wide.join(large, key, "left"), key, "n", "vec", block, ["vec", "place", "vector", "copies", "keys"])
    links = cut(wide.mapInArrow(trimmed(_links(similarity)), "vec long, n long, other long"))
    named = heads.select("vec", "id")
    counts = links.groupBy("vec").agg(F.sum("n").alias("n"))
    edges = links.where("vec <> other").select("vec", "other").distinct().join(named.select("vec", F.col("id").alias("a")), "vec").join(named.select(F.col("vec").alias("other"), F.col("id").alias("b")), "other").select("a", "b")
    # members of the classes
    numbers = cut(heads.join(counts, "vec", "left").select(*marks, F.col("id").alias("head"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    members = cut(thin_rows.where("usable").join(numbers, marks).select("id", "head", "n_links"))
    found = components(edges.unionByName(members.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b"))))
    out = members.select("id", "n_links").unionByName(thin_rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links")))
    component = F.coalesce("component", "id")
    return out.join(found, "id", "left").select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
nearest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(n.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(n.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN nearest n ON n.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

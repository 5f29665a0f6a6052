"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

*Sketch.* A document's set holds the distinct runs of ``words`` words (the whole sequence as one
with fewer words). Its sketch has t coordinates. In round i < t every element is thrown into a
random coordinate with the value i + a random fraction; in round t + j every element is thrown
into coordinate j. A coordinate keeps its least value, and the rounds end when none is empty: they
are over after about (t log t) / size rounds, after 2t at most, so every coordinate fills. The
share of equal coordinates of two sketches is concentrated about the sets' similarity.

*Bands.* ``rows`` coordinates make a band; the number of bands is the least for which a pair at the
threshold shares no band with probability ``miss`` (1e-6), at every input size.

*Links* are confirmed on full sets. Documents with equal word sequences are one class throughout.
In each bucket first every class is tried against the least class (a star, not all pairs), and
connected components are formed of the confirmed links. What a star may have lost lies in buckets
that still hold several components: there, in blocks, every pair of different components whose
sketches do not exclude the threshold (by seven standard deviations) and whose set sizes allow it
meets in the first bucket that the two share, and is verified on full sets unless its components
have been joined before. What leaves a block is a forest of links. No pair is capped or dropped;
pairs inside a component need no test, since they can change no component.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Documents without words have n_shingles
0 and link with nothing, null texts likewise. Rows with one id are one document's: they are linked.
Rows without an id link with nothing; their component_id is null and they are kept. Texts are read
whole. Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import array_of, dealt, matrix, pairs_within, units
from ledgerloom.llm.common import cut, drop_path, shared_path, table, trimmed, unused
from ledgerloom.llm.components import components
from ledgerloom.llm.words import parts, words

WORDS, SIMILARITY = 5, (80, 100)
ROWS, MISS = 6, 1e-6
BLOCK = 1024
BROADCAST_IDS = 1_000_000

_U = np.uint64
# Fixed values of a 64-bit mixing function.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _M1
    z = (z ^ (z >> _U(27))) * _M2
    return z ^ (z >> _U(31))


def bands(num: int, den: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (num / den) ** rows))


def _digest(tokens: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(tokens)).digest()[:16]


class Shingler:
    """Hash sets of word runs."""

    def __init__(self, words: int):
        self.words = words
        self.factors = _mix(np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of a text's words."""
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, _U(k))
        for i in range(k):
            total = _mix(total + h[i : i + n] * self.factors[i])
        return np.unique(total)


class Sketcher:
    def __init__(self, t: int, seed: int = 1):
        self.t = t
        self.seeds = _mix(np.arange(1, 2 * t + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed << 32))

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        """Round << 32 | fraction of each coordinate."""
        t, n = self.t, len(elements)
        out = np.full(t, np.iinfo(np.uint64).max, _U)
        at, step = 0, max(1, 4096 // n)
        empty = True
        while empty and at < 2 * t:
            rounds = np.arange(at, min(2 * t, at + step), dtype=_U)
            z = _mix(elements[None, :] ^ self.seeds[at : at + len(rounds), None])
            value = (rounds[:, None] << _U(32)) | (z & _U(0xFFFFFFFF))
            into = np.where(rounds[:, None] < t, ((z >> _U(32)) * _U(t)) >> _U(32), rounds[:, None] - _U(t)) if at + step > t else ((z >> _U(32)) * _U(t)) >> _U(32)
            np.minimum.at(out, into.astype(np.int64).ravel(), value.ravel())
            at += len(rounds)
            empty = (out == np.iinfo(np.uint64).max).any()
        return out


def _words(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of each text and their hashes; a few texts at a time are held."""
    for part in parts(texts):
        w = words([t or b"" for t in part])
        for text, a, b in zip(part, w.docs, w.docs[1:]):
            yield (text or b"").lower().split(), w.hashes[a:b]


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, n_bands: int, rows: int) -> DataFrame:
    """Per row: doc, n_shingles, digest (of the word sequence), bands, sketch (a byte a coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch = Shingler(width), Sketcher(n_bands * rows)
        salt = _mix(np.arange(1, n_bands + 1, dtype=_U))
        for batch in batches:
            sizes, digests, keys, bytes_ = [], [], [], []
            for tokens, hashes in _words(batch.column(1)):
                if not tokens:
                    sizes.append(0)
                    digests.append(None)
                    keys.append(None)
                    bytes_.append(None)
                    continue
                elements = shingle(hashes)
                s = _mix(sketch(elements))
                key = salt
                for column in s.reshape(n_bands, rows).T:
                    key = _mix(key + column)
                sizes.append(len(elements))
                digests.append(_digest(tokens))
                keys.append(key.view(np.int64))
                bytes_.append((s & _U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
                ["doc", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).mapInArrow(trimmed(run), "doc long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, hashes): the full sets of the wanted (cls, doc, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            keys, sets, held = [], [], 0
            for cls, digest, (tokens, words_) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _words(batch.column(2))):
                if _digest(tokens) != digest:  # another text of the same id
                    continue
                keys.append(cls)
                sets.append(shingle(words_).view(np.int64))
                held += len(sets[-1])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "hashes"])
                    keys, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "hashes"])

    return texts.join(wanted, "doc").select("cls", "digest", "text").mapInArrow(trimmed(run), "cls long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("a_set"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("b_set"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    union = F.size("a_set").cast("long") + F.size("b_set") - F.col("common")
    return both.withColumn("common", common).where(den * F.col("common") >= num * union).select("a", "b").distinct()


class _Apart:
    """Pairs of a unit's rows that may be similar, are in different components and meet here first."""

    def __init__(self, num: int, den: int, t: int):
        s = num / den
        p = s + (1 - s) / 256  # equal bytes of unequal values count too
        self.num, self.den, self.t = num, den, t
        self.least = math.floor(t * p - 7 * math.sqrt(t * p * (1 - p)))

    def __call__(self, rows: pa.Table, starts: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, equal coordinates), in bounded pieces."""
        comp, size, key = (rows.column(n).to_numpy() for n in ("component", "n_shingles", "key"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, self.t)
        bands_ = matrix(array_of(rows, "bands"))
        for i, j in pairs_within(starts, sides):
            near = (comp[i] != comp[j]) & (self.den * np.minimum(size[i], size[j]) >= self.num * np.maximum(size[i], size[j]))
            i, j = i[near], j[near]
            equal = (sketch[i] == sketch[j]).sum(1)
            near = equal >= self.least
            i, j, equal = i[near], j[near], equal[near]
            if len(i):
                first = (bands_[i] == bands_[j]).argmax(1)
                here = bands_[i, first] == key[i]
                yield i[here], j[here], equal[here]


def _active(apart: _Apart):
    """Units of sketches to the rows (cls, key) of such a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sides in units(batches):
            hit = np.zeros(len(rows), bool)
            for i, j, _ in apart(rows, starts, sides):
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows.column(n).to_numpy()[hit]) for n in ("cls", "key")], ["cls", "key"])

    return run


def _joined(apart: _Apart):
    """Units of full sets to links (a, b) that join their components: a forest, not all links."""
    num, den = apart.num, apart.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sides in units(batches, 1024):
            cls, comp = rows.column("cls").to_pylist(), rows.column("component").to_pylist()
            hashes, sets = array_of(rows, "hashes"), {}
            above = {c: c for c in comp}

            def root(c: int, above: dict = above) -> int:
                while above[c] != c:
                    above[c] = c = above[above[c]]
                return c

            def members(k: int, sets: dict = sets, hashes: pa.Array = hashes) -> set:
                if k not in sets:
                    sets[k] = set(hashes[k].values.to_numpy().tolist())
                return sets[k]

            a, b = [], []
            for i, j, equal in apart(rows, starts, sides):
                order = np.argsort(-equal, kind="stable")  # the likeliest first: the more are joined, the fewer are left
                for p, q in zip(i[order].tolist(), j[order].tolist()):
                    x, y = root(comp[p]), root(comp[q])
                    if x == y:
                        continue
                    s, u = members(p), members(q)
                    common = len(s & u)
                    if den * common >= num * (len(s) + len(u) - common):
                        above[max(x, y)] = min(x, y)
                        a.append(cls[p])
                        b.append(cls[q])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = SIMILARITY[0], den: int = SIMILARITY[1], rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (least id reachable), kept.

    Two documents are linked when den * |intersection| >= num * |union| of their sets.
    """
    n_bands = bands(num, den, rows, miss)
    apart = _Apart(num, den, n_bands * rows)
    # the wide table of sketches goes as soon as the classes have theirs
    path = shared_path(docs.sparkSession, "sketches")
    made = _sketches(docs, id_col, text_col, words, n_bands, rows)
    made.write.parquet(path)
    wide = docs.sparkSession.read.schema(made.schema).parquet(path)
    sketched = cut(wide.select("doc", "n_shingles", "digest"))
    with_words = sketched.where("doc is not null and n_shingles > 0")
    # copies: the least document stands for its word sequence, and the two are a class
    heads = cut(with_words.groupBy("digest").agg(F.min("doc").alias("doc")))
    own = wide.join(heads, ["digest", "doc"]).dropDuplicates(["digest", "doc"])
    own = cut(own.select(F.monotonically_increasing_id().alias("cls"), "doc", "digest", "n_shingles", "bands", "sketch"))
    drop_path(docs.sparkSession, path)
    thin = own.select("cls", "n_shingles")
    # buckets with several classes, and their stars
    keyed = own.select("cls", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = cut(stars.drop("n"))  # tables of their own can be joined with a hot key split
    in_buckets = cut(keyed.join(stars, "key").select("cls", "key", "least"))
    met = in_buckets.select("cls").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    sets = cut(_sets(texts, own.select("cls", "doc", "digest").join(met, "cls", "left_semi"), words))
    tried = in_buckets.where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    tried = tried.join(thin.select(F.col("cls").alias("a"), F.col("n_shingles").alias("a_size")), "a").join(thin.select(F.col("cls").alias("b"), F.col("n_shingles").alias("b_size")), "b")
    tried = tried.where(den * F.least("a_size", "b_size") >= num * F.greatest("a_size", "b_size")).select("a", "b")
    confirmed = cut(_verified(tried, sets, num, den))
    found = components(confirmed)
    # what is left: buckets with several components
    labelled = in_buckets.select("cls", "key").join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    held = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("several")).where("several > 1")
    mixed = cut(mixed.select("key", "n", F.col("most.n").alias("n_most"), F.col("most.component").alias("most")))
    left = cut(labelled.join(mixed, "key").select("cls", "key", "component", "n", "n_most", (F.col("component") == F.col("most")).alias("in_most")))
    how = lambda *more: (["key"], "n", "cls", block, ["cls", "key", "component", "n_shingles", "bands", "sketch", *more], "in_most", "n_most")
    sketches = own.select("cls", "n_shingles", "bands", "sketch")
    active = cut(dealt(left.join(sketches, "cls"), *how()).mapInArrow(trimmed(_active(apart)), "cls long, key long").distinct())
    wide = left.join(active, ["cls", "key"]).join(sketches, "cls").join(sets.dropDuplicates(["cls"]), "cls")
    joined = dealt(wide, *how("hashes")).mapInArrow(trimmed(_joined(apart)), "a long, b long")
    links = confirmed.unionByName(joined)
    names = own.select("cls", "doc")
    links = links.join(names.select(F.col("cls").alias("a"), F.col("doc").alias("x")), "a").join(names.select(F.col("cls").alias("b"), F.col("doc").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = with_words.select("digest", F.col("doc").alias("b")).join(heads.withColumnRenamed("doc", "a"), "digest").where("a <> b").select("a", "b")
    found = components(links.unionByName(same))
    out = sketched.select("doc", "n_shingles").join(found.withColumnRenamed("id", "doc"), "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Up to BROADCAST_IDS ids of dropped documents are broadcast; more are dealt out with the texts.
    """
    name = unused(docs, "_gone")
    gone = cut(classes(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct())
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM tokens
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
nearest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept
FROM sets s LEFT JOIN nearest l ON l.a = s.doc_id
"""

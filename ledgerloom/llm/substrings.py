"""Repeated passages by sliding sentence spans.

A sentence ends after . ! ? , ; or : before white space, or at a line's end, and keeps the white space
after it; cut this finely, a passage that begins and ends amid a writer's sentences still holds whole
ones. From every sentence a *run* goes on over ``run`` sentences, or fewer once they have over
``over`` words; into a sentence runs of fewer come likewise. Every run of every document is hashed, over its words, lower-cased (A-Z only).

Runs are joined globally, and those that occur in two documents or more are looked at: a document's
runs that only itself repeats are left alone. The join tells each later run its first occurrence, and what a
document has several times the first document that has it as often. Where
runs of a document follow one another as they do in that first document, they make one *stretch*.
A stretch of over ``over`` words is a repeated span at once: so are copies, which hold nearly all of
them. A shorter one goes by an exact check: it is followed, word by word, into the sentences beside it
as long as the first document goes on likewise, on either side up to the number of words that it lacks,
and is a repeated span if that makes over ``over`` words.
Sentences all of whose words lie in repeated spans are removed. The first document, by (id, text), keeps
its passage, and of sentences at a passage's ends that go on in words of their own nothing is removed.
A passage thus stays if no run lies in it: one with fewer than ``run`` whole sentences that have not
over ``over`` words. Runs are told apart by 96 bits, words in the exact check by 64.

With ``whole``, as the query has it, no passage stays. Instead of by words beside short stretches, what
the long ones leave goes by *windows*, every ``over`` + 1 words in a row: one that any earlier document
has, wherever and however often, is a repeated span. A *gram* is a third of a window, and a window goes by
the least hash of its grams, the same wherever the window is. Windows in one long stretch need no look: an
earlier document has them, so they are nobody's first. Of the others the grams that two documents have are
joined globally, then the windows that go by them, by 96 bits, each to the first document that has it.
Words in repeated spans that follow one another are a passage; one in which no whole sentence lies loses
its words alone, and the sentences that they are of count as removed.

Neighbours of a run are known by one byte for each eighth of the words that it lacks, on both
sides; most short stretches end there. Texts are read again for the others only. Fixed-size bitmaps of
``BITS`` bits keep rows that nothing is for out of the joins, or let some of them in, which costs time
only; they are broadcast and do not grow. No key is hot in one task: what is grouped is summed before
it is dealt, and joins are between a unique side and one that Spark can split.

Null texts stay null and have no sentences. Rows without an id come after all others. Rows with the
same id and the same text are one document, so none of them repeats the other; with one id and
different texts they are documents of their own. Of texts that repeat one another, ties in the id
included, the least (id, hash of the text) is the first. A document whose every sentence is covered
becomes ''. Long texts are whole. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_path, table, trimmed, written
from ledgerloom.llm.words import CHUNK, Sums, Words, words

RUN, OVER = 3, 50
BITS = 1 << 25

_END = re.compile(rb"[.!?,;:]+\s+|\n\s*")
_U = np.uint64


def sentences(text: bytes) -> list[bytes]:
    """Pieces that make up the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


# -- runs, in vectors


class Runs(NamedTuple):
    text: np.ndarray  # number of the text
    first: np.ndarray  # first word, and the end, among those of all texts
    end: np.ndarray


def runs(w: Words, run: int, over: int) -> Runs:
    end = np.flatnonzero(w.ends) + 1
    first = np.concatenate(([0], end))[:-1]
    text = np.searchsorted(w.docs, first, "right") - 1
    at = np.arange(len(end))
    last = np.minimum(at + run - 1, np.searchsorted(end, first + over + 1))
    ok = last < len(end)
    ok[ok] = text[last[ok]] == text[ok]
    begins, lasts = at[ok], last[ok]
    # into a sentence too, where fewer than ``run`` have the words
    back = np.searchsorted(first, end - over - 1, "right") - 1
    ok = back > at - run + 1
    ok[ok] = (back[ok] >= 0) & (text[back[ok]] == text[ok]) & (last[back[ok]] != at[ok])
    begins, lasts = np.append(begins, back[ok]), np.append(lasts, at[ok])
    order = np.lexsort((lasts, begins))
    begins, lasts = begins[order], lasts[order]
    return Runs(text[begins], first[begins], end[lasts])


# -- windows, in vectors


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of each ``n`` values in a row, the first of equal ones."""
    at, held = np.arange(len(x)), 1
    while held < n:
        more = min(held, n - held)
        a, b = at[:-more], at[more:]
        at, held = np.where(x[b] < x[a], b, a), held + more
    return at


class Windows(NamedTuple):
    text: np.ndarray  # number of the text
    first: np.ndarray  # first word among those of all texts
    gram: np.ndarray  # hash that it goes by


def windows(w: Words, over: int) -> Windows:
    size, n = over + 1, (over + 3) // 3
    starts = max(0, len(w.hashes) - size + 1)
    text = np.repeat(np.arange(len(w.docs) - 1), np.diff(w.docs))[:starts]
    first = np.flatnonzero(np.arange(starts) + size <= w.docs[text + 1])
    if not len(first):
        return Windows(text[:0], first, np.zeros(0, np.int64))
    begins = np.arange(len(w.hashes) - n + 1)
    grams = Sums(w.hashes, 1)(begins, begins + n)
    return Windows(text[first], first, grams[_least(grams, size - n + 1)[first]].view(np.int64))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> 6) & (BITS // 64 - 1), h & 63


def _bitmap(keys: DataFrame, name: str):
    """A broadcast bitmap of a column of hashes: ``BITS`` bits, whatever the size of the input."""
    h = F.col(name)
    found = keys.groupBy(F.shiftright(h, 6).bitwiseAND(F.lit(BITS // 64 - 1)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def _is_in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bit = _bits(h)
    return (bitmap[word] >> bit & 1).astype(bool)


# -- documents


def _marks(ids: list[int | None], texts: list[bytes]) -> np.ndarray:
    """Hash of each row's id, or of having none, and text."""
    return np.array([xxhash.xxh3_64_intdigest(t, 1 if i is None else hash((2, i)) & 0xFFFFFFFFFFFFFFFF) for i, t in zip(ids, texts)], _U).view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[bytes | None]]]:
    """Ids and texts of rows, about ``CHUNK`` bytes at a time."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(t.as_py())
        held += len(texts[-1] or b"") + 1
        if held > CHUNK:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_OF = {"none": pa.bool_(), "doc": pa.int64(), "mark": pa.int64()}


def _whose(ids: list[int | None], marks: np.ndarray, of: np.ndarray) -> list[pa.Array]:
    none = np.array([i is None for i in ids], bool)
    doc = np.array([i or 0 for i in ids], np.int64)
    return [pa.array(none[of]), pa.array(doc[of]), pa.array(marks[of])]


def _hashes(run: int, over: int):
    """(h, mark) of all runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                texts = [t or b"" for t in texts]
                w = words(texts)
                r = runs(w, run, over)
                h = Sums(w.hashes, 0)(r.first, r.end).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(_marks(ids, texts)[r.text])], ["h", "mark"])

    return each


_RUNS = "h long, h2 int, turn int, none boolean, doc long, mark long, first int, n int, before long, after long"


def _reach(lacks: np.ndarray, k: int) -> np.ndarray:
    """Words that byte ``k`` is for, of eight, of so many that a run lacks."""
    return -(-lacks * (k + 1) // 8)


def _neighbours(lacks: np.ndarray, hashed, room: np.ndarray) -> np.ndarray:
    """Eight bytes: hashes of a run's next words, 0 where the text has no more."""
    out = np.zeros(len(lacks), _U)
    for k in range(8):
        d = _reach(lacks, k)
        there = d <= room
        out |= np.where(there, hashed(np.where(there, d, 0)) % _U(255) + _U(1), _U(0)) << _U(8 * k)
    return out


def _turns(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each text has had the run before."""
    order = np.lexsort((h, text))  # stable
    new = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1]))))[: len(h)]
    out = np.zeros(len(h), np.int32)
    out[order] = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    return out


def _repeated(run: int, over: int, bitmap):
    """Runs whose bit is set, with the hashes of their neighbours."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                texts = [t or b"" for t in texts]
                w = words(texts)
                one = Sums(w.hashes, 0)
                r = runs(w, run, over)
                h = one(r.first, r.end).view(np.int64)
                keep = _is_in(bitmap.value, h)
                h, (text, first, end) = h[keep], (x[keep] for x in r)
                two = Sums(w.hashes, 1)
                low, high = w.docs[text], w.docs[text + 1]
                lacks = np.maximum(0, over + 1 - (end - first))
                before = _neighbours(lacks, lambda d: two(first - d, first), first - low)  # noqa: B023
                after = _neighbours(lacks, lambda d: two(end, end + d), high - end)  # noqa: B023
                h2 = (two(first, end) >> _U(32)).astype(np.uint32).view(np.int32)
                arrays = [pa.array(h), pa.array(h2), pa.array(_turns(text, h)), *_whose(ids, _marks(ids, texts), text), pa.array((first - low).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(before.view(np.int64)), pa.array(after.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "h2", "turn", *_OF, "first", "n", "before", "after"])

    return each


def _most(lacks: np.ndarray, mine: np.ndarray, its: np.ndarray) -> np.ndarray:
    """The most words that two runs can have in common on one side."""
    mine, its = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in (mine, its))
    differ = (mine != its) | (mine == 0)
    k = differ.argmax(1)
    return np.where(differ.any(1), -(-lacks * (k + 1) // 8) - 1, lacks).clip(0)


_STRETCHES = "none boolean, doc long, mark long, first int, n int, first_none boolean, first_doc long, first_mark long, first_place int, sure boolean"


def _stretches(over: int):
    """Later runs, in order of their documents, to stretches that have over ``over`` words (``sure``) or may have."""
    same = ("none", "doc", "mark", "first_none", "first_doc", "first_mark")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            first, n, *sides = (t.column(c).to_numpy() for c in ("first", "n", "before", "first_before", "after", "first_after"))
            lacks = np.maximum(0, over + 1 - n).astype(np.int64)
            ends = np.append(starts[1:], len(t)) - 1
            length = first[ends] + n[ends] - first[starts]
            sure = length > over
            may = length + _most(lacks[starts], *(x[starts] for x in sides[:2])) + _most(lacks[ends], *(x[ends] for x in sides[2:])) > over
            use = sure | may
            rows = t.take(pa.array(starts[use])).combine_chunks()
            columns = {c: rows.column(c) for c in (*same[:3], "first")} | {"n": pa.array(length[use].astype(np.int32))} | {c: rows.column(c) for c in (*same[3:], "first_place")} | {"sure": pa.array(sure[use])}
            return pa.table(columns).combine_chunks().to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            if not len(t):
                continue
            first, n = t.column("first").to_numpy(), t.column("n").to_numpy()
            shift = t.column("first_place").to_numpy() - first
            new = (shift[1:] != shift[:-1]) | (first[1:] > (first + n)[:-1])
            for c in same:
                x = t.column(c).to_numpy()
                new |= x[1:] != x[:-1]
            starts = np.flatnonzero(np.concatenate(([True], new)))
            held = t.slice(starts[-1])
            if len(starts) > 1:
                yield from out(t.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from out(held, np.zeros(1, np.int64))

    return each


_BESIDE = "none boolean, doc long, mark long, first int, n int, `left` array<long>, `right` array<long>"


def _beside(over: int):
    """Of (text, none, doc, mark, spans): the words before, the nearest first, and after each span, as many as it lacks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *who, spans in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                x = words([text.as_py()]).hashes.view(np.int64)
                at = [(p["first"], p["n"]) for p in spans]
                left = [x[max(0, f + n - over - 1) : f][::-1] for f, n in at]
                right = [x[f + n : f + over + 1] for f, n in at]
                arrays = [*(pa.array([v] * len(at), t) for v, t in zip(who, _OF.values())), *(pa.array([p[k] for p in at], pa.int32()) for k in (0, 1)), *(pa.array(v, pa.list_(pa.int64())) for v in (left, right))]
                yield pa.RecordBatch.from_arrays(arrays, [*_OF, "first", "n", "left", "right"])

    return each


def _followed(over: int):
    """Of (none, doc, mark, first, n, left, right, first_left, first_right): the stretches that grow to over ``over`` words."""

    def common(a: pa.Scalar, b: pa.Scalar) -> int:
        a, b = (v.values.to_numpy() for v in (a, b))
        k = min(len(a), len(b))
        differ = a[:k] != b[:k]
        return int(differ.argmax()) if differ.any() else k

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4))
            left, right = (np.array([common(a, b) for a, b in zip(batch.column(k), batch.column(k + 2))], np.int64) for k in (5, 6))
            use = pa.array(left + n + right > over)
            arrays = [*(batch.column(k) for k in range(3)), pa.array((first - left).astype(np.int32)), pa.array((left + n + right).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*_OF, "first", "n"]).filter(use)

    return each


def _open(over: int, marks: np.ndarray, texts: list[bytes], spans: pa.Array | None = None) -> pa.RecordBatch:
    """(h, mark) of the grams that windows outside of the spans go by."""
    w = words(texts)
    v = windows(w, over)
    if spans is not None:
        count = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        first, n = (spans.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        first = first + np.repeat(w.docs[:-1], count)
        edges = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + n - over, -1)
        v = Windows(*(x[np.cumsum(edges)[v.first] == 0] for x in v))
    new = np.concatenate(([True], (v.gram[1:] != v.gram[:-1]) | (v.text[1:] != v.text[:-1])))[: len(v.gram)]
    return pa.RecordBatch.from_arrays([pa.array(v.gram[new]), pa.array(marks[v.text[new]])], ["h", "mark"])


def _open_untouched(over: int, bitmap):
    """Of (id, text): the open grams of rows whose bit is not set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                texts = [t or b"" for t in texts]
                marks = _marks(ids, texts)
                of = np.flatnonzero(~_is_in(bitmap.value, marks))
                if len(of):
                    yield _open(over, marks[of], [texts[k] for k in of])

    return each


def _open_touched(over: int):
    """Of (mark, text, spans): the open grams."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for marks, texts in _chunks(batch):
                yield _open(over, np.array(marks, np.int64), [t or b"" for t in texts], batch.column(2).slice(at, len(texts)))
                at += len(texts)

    return each


def _listed(over: int, bitmap):
    """Each text's different windows that go by a gram whose bit is set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                texts = [t or b"" for t in texts]
                w = words(texts)
                v = windows(w, over)
                keep = _is_in(bitmap.value, v.gram)
                text, first = v.text[keep], v.first[keep]
                h = Sums(w.hashes, 0)(first, first + over + 1).view(np.int64)
                order = np.lexsort((h, text))
                text, first, h = text[order], first[order], h[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[: len(h)]
                text, first, h = text[new], first[new], h[new]
                h2 = (Sums(w.hashes, 1)(first, first + over + 1) >> _U(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), *_whose(ids, _marks(ids, texts), text)], ["h", "h2", *_OF])

    return each


# -- the operator


def _inside(total: int, spans: np.ndarray) -> np.ndarray:
    """Whether each of so many words is in one of the spans (first word, number)."""
    edges = np.zeros(total + 1, np.int64)
    first, n = spans.T
    np.add.at(edges, first, 1)
    np.add.at(edges, first + n, -1)
    return np.cumsum(edges)[:total] > 0


def covered_sentences(counts: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Sentences, of so many words, all of whose words are in spans (first word, number)."""
    return _all_inside(counts, _inside(sum(counts), np.array(spans, np.int64)))


def _all_inside(counts: list[int], inside: np.ndarray) -> list[int]:
    out, at = [], 0
    for i, k in enumerate(counts):
        # without words of its own, a piece goes with the words beside it
        here = inside[at : at + k] if k else inside[max(0, at - 1) : at + 1]
        if len(here) and here.all():
            out.append(i)
        at += k
    return out


_WORD = re.compile(rb"\S+\s*")


def _shortened(parts: list[bytes], spans: np.ndarray) -> tuple[list[bytes], int]:
    """Sentences without the passages, and how many of them lose words."""
    counts = [len(p.split()) for p in parts]
    inside = _inside(sum(counts), spans)
    covered = set(_all_inside(counts, inside))
    begins = np.cumsum([0, *counts])
    gone = np.zeros(len(inside), bool)
    for i in covered:
        gone[begins[i] : begins[i + 1]] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        if not gone[a:b].any():
            gone[a:b] = True
    out, n = [], len(covered)
    for i, p in enumerate(parts):
        here = gone[begins[i] : begins[i + 1]]
        if i in covered:
            continue
        if here.any():
            found = list(_WORD.finditer(p))
            p = p[: found[0].start()] + b"".join([m[0] for m, g in zip(found, here) if not g])
            n += 1
        out.append(p)
    return out, n


_OUT = "id long, text string, n_sentences long, n_removed long"


def _cleaned(ids: list[int | None], rows: list[tuple[bytes | None, list[tuple[int, int]]]]) -> pa.RecordBatch:
    texts, total, gone = [], [], []
    for raw, spans in rows:
        parts = sentences(raw) if raw else []
        covered = set(covered_sentences([len(p.split()) for p in parts], spans)) if spans else ()
        total.append(len(parts))
        gone.append(len(covered))
        texts.append(b"".join([s for i, s in enumerate(parts) if i not in covered]) if covered else raw)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["id", "text", "n_sentences", "n_removed"])


def _untouched(bitmap):
    """Rows whose bit is not set, finished."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                out = ~_is_in(bitmap.value, _marks(ids, [t or b"" for t in texts]))
                if out.any():
                    yield _cleaned([i for i, o in zip(ids, out) if o], [(t, []) for t, o in zip(texts, out) if o])

    return each


def _touched(bitmap):
    """(id, text, none, doc, mark) of rows whose bit is set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                marks = _marks(ids, [t or b"" for t in texts])
                of = np.flatnonzero(_is_in(bitmap.value, marks))
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in of], pa.int64()), pa.array([texts[k] for k in of], pa.binary()), *_whose(ids, marks, of)], ["id", "text", *_OF])

    return each


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, spans = batch.column(0).to_pylist(), batch.column(2)
        for at in range(0, len(ids), 500):
            rows = [(t.as_py(), [(p["first"], p["n"]) for p in s.as_py() or ()]) for t, s in zip(batch.column(1).slice(at, 500), spans.slice(at, 500))]
            yield _cleaned(ids[at : at + 500], rows)


def _without_all(over: int):
    """Of (id, text, spans, windows): rows without the passages that spans and windows make."""

    def found(texts: list[bytes], hashes: list[np.ndarray]) -> list[np.ndarray]:
        """Spans of the windows of each text that are among its hashes."""
        w = words(texts)
        v = windows(w, over)
        h = Sums(w.hashes, 0)(v.first, v.first + over + 1).view(np.int64)
        at = np.searchsorted(v.text, np.arange(len(texts) + 1))
        firsts = [v.first[a:b][np.isin(h[a:b], mine)] - low for a, b, mine, low in zip(at, at[1:], hashes, w.docs)]
        return [np.stack([f, np.full(len(f), over + 1)], 1) for f in firsts]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, raw in _chunks(batch):
                spans, hashes = (batch.column(k).slice(at, len(ids)) for k in (2, 3))
                at += len(ids)
                spans = [np.array([(p["first"], p["n"]) for p in s.as_py() or ()], np.int64).reshape(-1, 2) for s in spans]
                of = [k for k in range(len(ids)) if hashes[k].is_valid]
                for k, more in zip(of, found([raw[k] or b"" for k in of], [hashes[k].values.to_numpy() for k in of])):
                    spans[k] = np.concatenate([spans[k], more])
                texts, total, gone = [], [], []
                for t, s in zip(raw, spans):
                    parts = sentences(t) if t else []
                    left, n = _shortened(parts, s) if len(s) else (parts, 0)
                    texts.append(b"".join(left) if n else t)
                    total.append(len(parts))
                    gone.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["id", "text", "n_sentences", "n_removed"])

    return each


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, over: int = OVER, whole: bool = False) -> DataFrame:
    """Per row of ``docs``: id, text without the sentences of repeated passages, n_sentences, n_removed.

    With ``whole`` of all repeated passages, else of those in which runs lie.
    """
    if run < 1 or over < 1:
        raise ValueError("a run has 1 sentence at least, a passage over 1 word")
    spark, paths = docs.sparkSession, []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        paths.append(path)
        return out

    who = F.struct(*_OF)
    key = ["h", "h2", "turn"]
    several = texts.mapInArrow(trimmed(_hashes(run, over)), "h long, mark long").groupBy("h").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("h")
    several = kept(several, "several")  # a table of its own, so that a hot run can be split in the join
    found = texts.mapInArrow(trimmed(_repeated(run, over, _bitmap(several, "h"))), _RUNS).join(several, "h", "left_semi")
    found = kept(found, "runs")
    place = F.struct(*_OF, "first")
    its = [f"first_{c}" for c in _OF]
    firsts = found.groupBy(*key).agg(F.min(F.struct(*_OF, "first", "before", "after")).alias("least"), F.max(who).alias("most"))
    firsts = firsts.select(*key, *(F.col(f"least.{c}").alias(f"first_{c}") for c in (*_OF, "before", "after")), F.col("least.first").alias("first_place"), "most")
    earlier = F.struct(*(F.col(f"first_{c}").alias(c) for c in _OF))
    firsts = kept(firsts.where(earlier < F.col("most")).drop("most"), "firsts")
    later = found.join(firsts, key).where(who > earlier).select(*_OF, "first", "n", "before", "after", *its, "first_before", "first_after", "first_place")
    sorted_ = later.repartition("doc", "mark").sortWithinPartitions(*_OF, "first", "n")
    told = kept(sorted_.mapInArrow(trimmed(_stretches(over)), _STRETCHES), "stretches")
    sure = told.where("sure").select(*_OF, "first", "n")
    spans = F.collect_set(F.struct("first", "n")).alias("spans")
    touched_row = "id long, text binary, none boolean, doc long, mark long"

    if whole:
        long_ = kept(sure.groupBy(*_OF).agg(spans), "long")
        bitmap = _bitmap(long_, "mark")
        grams = texts.mapInArrow(trimmed(_touched(bitmap)), touched_row).join(long_, list(_OF), "left").select("mark", "text", "spans").mapInArrow(trimmed(_open_touched(over)), "h long, mark long")
        grams = grams.unionByName(texts.mapInArrow(trimmed(_open_untouched(over, bitmap)), "h long, mark long"))
        grams = kept(grams.groupBy("h").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("h"), "grams")
        listed = kept(texts.mapInArrow(trimmed(_listed(over, _bitmap(grams, "h"))), "h long, h2 int, none boolean, doc long, mark long"), "windows")
        least = kept(listed.groupBy("h", "h2").agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least < most").drop("most"), "least")
        had = listed.join(least, ["h", "h2"]).where(who > F.col("least")).groupBy(*_OF).agg(F.collect_set("h").alias("windows"))
        covered = kept(long_.join(had, list(_OF), "full"), "covered")
        bitmap = _bitmap(covered, "mark")
        for path in paths[:-1]:
            drop_path(spark, path)
        touched = texts.mapInArrow(trimmed(_touched(bitmap)), touched_row)
        touched = touched.join(covered, list(_OF), "left").select("id", "text", "spans", "windows").mapInArrow(trimmed(_without_all(over)), _OUT)
        return touched.unionByName(texts.mapInArrow(trimmed(_untouched(bitmap)), _OUT)).withColumnsRenamed({"id": id_col, "text": text_col})

    # the exact check of what is left
    open_ = told.where("not sure")
    there = [F.col(c).alias(d) for c, d in zip((*its, "first_place"), (*_OF, "first"))]
    asked = open_.select(*_OF, "first", "n").unionByName(open_.select(*there, "n")).distinct().groupBy(*_OF).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    asked = kept(asked, "asked")
    some = texts.mapInArrow(trimmed(_touched(_bitmap(asked, "mark"))), touched_row)
    beside = some.join(asked, list(_OF)).dropDuplicates(list(_OF)).select("text", *_OF, "spans").mapInArrow(trimmed(_beside(over)), _BESIDE)
    beside = kept(beside, "beside")
    first_beside = beside.select(*(F.col(c).alias(f"first_{c}") for c in _OF), F.col("first").alias("first_place"), "n", F.col("left").alias("first_left"), F.col("right").alias("first_right"))
    pairs = open_.join(beside, [*_OF, "first", "n"]).join(first_beside, [*its, "first_place", "n"])
    followed = pairs.select(*_OF, "first", "n", "left", "right", "first_left", "first_right").mapInArrow(trimmed(_followed(over)), "none boolean, doc long, mark long, first int, n int")
    covered = kept(sure.unionByName(followed).groupBy(*_OF).agg(spans), "covered")
    bitmap = _bitmap(covered, "mark")
    for path in paths[:-1]:
        drop_path(spark, path)
    touched = texts.mapInArrow(trimmed(_touched(bitmap)), touched_row)
    touched = touched.join(covered, list(_OF), "left").select("id", "text", "spans").mapInArrow(trimmed(_without), _OUT)
    return touched.unionByName(texts.mapInArrow(trimmed(_untouched(bitmap)), _OUT)).withColumnsRenamed({"id": id_col, "text": text_col})


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"), whole=True)

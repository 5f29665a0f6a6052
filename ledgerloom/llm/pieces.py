"""SentencePiece encoding with source offsets, and decoding.

Normalisation walks the text once. At each position the longest prefix that the model's compiled
character map knows is replaced; any other character stands for itself. The map's root tells the
bytes that a known prefix can begin with, and stretches without any are taken over whole. Every byte
of the normalised text remembers the byte of the source that it came from, so each piece is
projected to the span of original bytes that it stands for. Every text takes this way, whatever the model.

A normalised text falls into units: a run of word marks with the characters up to the next run.
No piece of a supported model has a word mark after another character, so pair merges never cross
the border of two units, and a unit's pieces do not depend on its neighbours. Units are therefore
looked up in a table of bounded bytes; the library merges those that are not in it, many at a time.
Units of over ``LONGEST_UNIT`` bytes are merged whole and never kept. A worker process parses the
model once, and empties the table after each task.

Supported are BPE models with byte fallback, without user-defined symbols, with word marks as
prefixes; others raise ValueError. Null and empty texts have no pieces and decode to ''. Texts are
taken whole, whatever their length. Every row is encoded by itself, so repeated rows and ids give
repeated results and nulls in the id stay. An empty table gives an empty result. Columns are taken by
position after a projection to id and text, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, trimmed

MARK = "▁"
_MARK = MARK.encode()
#: The word mark inside normalised bytes here: a byte that UTF-8 never has.
_ONE = b"\xff"
#: Bytes of a task's table of units, as estimated, whose older half goes when it is full; bytes of the longest unit in it.
TABLE_BYTES, LONGEST_UNIT = 64 << 20, 256
#: Estimated bytes of a table's entry beside its unit and ids.
_ENTRY = 200

# Fixed values of the serialised model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, b[i : i + n]
        i += n


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 and the replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.out = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
            self.out = blob[4 + n :]

    def first_bytes(self) -> bytes:
        """The bytes that a known prefix can begin with."""
        if not self.units:
            return b""
        base = self._child(self.units[0])
        return bytes(c for c in range(1, 256) if (base ^ c) < len(self.units) and self.units[base ^ c] & 0x800000FF == c)

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at ``at`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.out.index(b"\0", found[1])
        return found[0], self.out[found[1] : end]


class Encoding(NamedTuple):
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Encoder:
    """One model, in one process."""

    def __init__(self, model: bytes, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("a model with a denormaliser is not supported")
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or USER_DEFINED in self.kinds:
            raise ValueError("only BPE models with byte fallback, prefix word marks and no user-defined symbols are supported")
        if any(_MARK in p.lstrip(_MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL and _MARK in p):
            raise ValueError("a piece has a word mark after another character")
        if _MARK not in self.pieces:
            raise ValueError("the word mark is not a piece")
        self.mark = self.pieces.index(_MARK)
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("a model that keeps spaces is not supported")
        self.bytes_at = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [str(i) for i in range(len(self.pieces))]
        plain = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        self.surfaces = [plain.get(k, p.replace(_MARK, b" ")) if k != BYTE else bytes([self.bytes_at[i]]) for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        #: Normalised bytes of each piece, and the byte of a byte piece (else -1).
        self.sizes = np.array([len(p.replace(_MARK, _ONE)) for p in self.pieces], np.int64)
        self.byte_of = np.array([self.bytes_at.get(i, -1) for i in range(len(self.pieces))], np.int16)
        self.kind = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<i4")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held, self.table_bytes = 0, table_bytes
        self.unit = re.compile(rb"\xff+[^\xff]*|^[^\xff]+")
        self.set_map(CharMap(norm.get(2, b"")))

    def set_map(self, map_: CharMap) -> None:
        """Take ``map_``; stops are where a known prefix may begin, and word marks of the text's own."""
        self.map = map_
        self.stops = re.compile(b"|".join([re.escape(_MARK), *([b"[" + re.escape(first) + b"]"] if (first := map_.first_bytes()) else [])]))

    def forget(self) -> None:
        """Empty the table."""
        self.known, self.old, self.held = {}, {}, 0

    # -- normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, a word mark as one byte, and for each of them (and the end) the source byte it came from."""
        made, source, at, begun = [], [], 0, 0

        def take(to: int) -> None:
            if to > begun:
                made.append(text[begun:to])
                source.append(np.arange(begun, to))

        while stop := self.stops.search(text, at):
            i = stop.start()
            hit = self.map.longest(text, i)
            size, piece = hit or (_width(text[i]), b"")
            if hit is None and text.startswith(_MARK, i):
                hit, piece = True, _ONE
            if hit:
                take(i)
                begun = i + size
                made.append(piece.replace(_MARK, _ONE))
                source.append(np.full(len(made[-1]), i))
            at = i + size
        take(len(text))
        out, to_source, end = b"".join(made), np.concatenate([*source, np.zeros(0, np.int64)]), len(text)
        if self.squeeze and out:
            byte = np.frombuffer(out, np.uint8)
            space = byte == 0x20
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            keep[0] &= not space[0]
            # at the end, marks of the text's own go as well
            last = len(byte) - len(out.rstrip(b" \xff"))
            if last:
                keep[-last:], end = False, int(to_source[-last])
            out, to_source = byte[keep].tobytes(), to_source[keep]
        out = out.replace(b" ", _ONE)
        if not out:
            return b"", np.array([len(text)])
        if self.prefix:
            out, to_source = _ONE + out, np.concatenate((to_source[:1], to_source))
        return out, np.append(to_source, end)

    # -- units

    def _merged(self, units: list[bytes]) -> list[bytes]:
        """Ids of units, by the library."""
        texts = [(u[1:] if self.prefix else u).replace(_ONE, b" ") for u in units]
        # the library gives an empty text no mark
        ids = [x or [self.mark] for x in self.library.encode(texts, num_threads=1)]
        ends = np.cumsum([0, *map(len, ids)]) * self.kind.itemsize
        flat = np.fromiter(chain.from_iterable(ids), self.kind, ends[-1] // self.kind.itemsize).tobytes()
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def units_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of normalised texts, as bytes."""
        found = [self.unit.findall(t) for t in texts]
        units = set().union(*found)
        if self.held > self.table_bytes // 2:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, todo = self.known, self.old, []
        for unit in units.difference(known):
            ids = old.get(unit)
            if ids is None:
                todo.append(unit)
            else:
                known[unit] = ids
                self.held += _ENTRY + len(unit) + len(ids)
        long_units: dict[bytes, bytes] = {}
        for unit, ids in zip(todo, self._merged(todo)):
            if len(unit) > LONGEST_UNIT:
                long_units[unit] = ids
            else:
                known[unit] = ids
                self.held += _ENTRY + len(unit) + len(ids)
        if long_units:
            return [b"".join([known[u] if u in known else long_units[u] for u in t]) for t in found]
        return [b"".join([known[u] for u in t]) for t in found]

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece; of the bytes of a character, the last stands for all of it."""
        sizes, byte = self.sizes[ids], self.byte_of[ids]
        if (byte >= 0).any():
            goes_on = (byte >= 0x80) & (byte < 0xC0)
            lead = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(ids))))
            last = np.append(~goes_on[1:], True)
            sizes = np.where(byte < 0, sizes, np.where(last, np.arange(len(ids)) - lead + 1, 0))
        return sizes

    def encode(self, texts: list[bytes | None]) -> Iterator[Encoding]:
        normal = [self.normalise(t or b"") for t in texts]
        for (made, to_source), raw in zip(normal, self.units_of([made for made, _ in normal])):
            ids = np.frombuffer(raw, self.kind)
            ends = self._sizes(ids).cumsum()
            if len(made) != (ends[-1] if len(ends) else 0):
                raise ValueError("pieces do not make up the normalised text")
            begins = to_source[np.concatenate((np.zeros(min(1, len(ends)), ends.dtype), ends[:-1]))]
            yield Encoding(ids, begins.astype("<i4"), to_source[ends].astype("<i4"))

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, bytes characters, and the prefix mark goes."""
        if not len(ids):
            return ""
        if not self.squeeze and self.kinds[ids[0]] == NORMAL:
            joined = b"".join(map(self.surfaces.__getitem__, ids))
            if self.prefix and self.pieces[ids[0]].startswith(_MARK):
                joined = joined[1:]
            try:
                return joined.decode()
            except UnicodeDecodeError:  # broken characters, which the slow way replaces
                pass
        out, run = [], bytearray()
        first = True
        for i in ids:
            if i in self.bytes_at:
                run.append(self.bytes_at[i])
                first = False
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
                first = False
                continue
            piece = self.pieces[i].decode()
            if first and (self.prefix or self.squeeze):
                piece = piece.lstrip(MARK) if self.squeeze else piece.removeprefix(MARK)
                first = self.squeeze and not piece
            out.append(piece.replace(MARK, " "))
        return "".join(out) + _characters(bytes(run))


def _width(first: int) -> int:
    """Bytes of the character that begins with this byte."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _characters(b: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is not part of a character."""
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        return b[: e.start].decode() + "�" + _characters(b[e.start + 1 :])


def _model_bytes(model_path: str | None) -> bytes:
    with open(model_path or default_model(), "rb") as f:
        return f.read()


_TEXTS = 1 << 19
_encoders: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """The encoder of this process, for one model at a time."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _each(encoder: Encoder, texts: pa.Array) -> Iterator[Encoding]:
    """Encodings in order, a few megabytes of text at a time."""
    part, held = [], 0
    for x in texts:
        t = x.as_py()
        part.append(t)
        held += len(t or b"")
        if held >= _TEXTS:
            yield from encoder.encode(part)
            part, held = [], 0
    yield from encoder.encode(part)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row: id, ids, and the begin and end byte of each piece's span in the source."""
    model = _model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            at, out, held = 0, [], 0
            for e in _each(encoder, batch.column(1)):
                out.append(e)
                held += len(e.ids)
                if held > 1 << 20:
                    yield _encoded(batch.column(0).slice(at, len(out)), out)
                    at, out, held = at + len(out), [], 0
            yield _encoded(batch.column(0).slice(at, len(out)), out)
        encoder.forget()

    def _encoded(keys: pa.Array, out: list[Encoding]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array([e[k].astype(np.int32) for e in out], pa.list_(pa.int32())) for k in range(3))], ["id", "ids", "begins", "ends"])

    return _narrow(docs, id_col, text_col).mapInArrow(trimmed(run), "id long, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """Per row: id and the decoded text."""
    model = _model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "id long, text string").withColumnRenamed("id", id_col)


_DIGESTS = {"id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "spans_sha256": pa.string(), "source_bytes": pa.int64()}


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 and source_bytes.

    Spans are digested as 32-bit little-endian numbers, the begin and the end of each piece in turn;
    source_bytes is the end of the last one. Encoding and decoding share one pass, so neither ids nor spans are written.
    """
    model = _model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in _DIGESTS]
            for e in _each(encoder, batch.column(1)):
                ids = e.ids.tolist()
                spans = np.stack((e.begins, e.ends), 1).tobytes()
                values = (len(ids), sha(",".join(map(encoder.names.__getitem__, ids)).encode()), sha(encoder.decode(ids).encode()), sha(spans), int(e.ends[-1]) if ids else 0)
                for column, value in zip(out[1:], values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in list(zip(out, _DIGESTS.values()))[1:])], list(_DIGESTS))
        encoder.forget()

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, source_bytes long"
    return _narrow(docs, id_col, text_col).mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

"""Hashes of the words of texts, many texts at a time and without a table of words.

Words are runs of bytes other than ASCII white space, lower-cased (A-Z only), as ``bytes.lower().split()`` gives them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20

_U = np.uint64
_BORDER = re.compile(rb"[ \t\n\x0b\x0c\r][^ \t\n\x0b\x0c\r]")


def mixed(h: np.ndarray) -> np.ndarray:
    # multipliers are fixed values of a 64-bit mixing function
    h = (h ^ h >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(29)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(32)


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_STOP = np.isin(np.arange(256), list(b".!?,;:"))
_BYTE = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(_U) + _U(1))
_BYTE[_BLANK] = 0
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        x = np.full(max(4096, 2 * n), base, _U)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


class Words(NamedTuple):
    hashes: np.ndarray
    ends: np.ndarray  # whether a sentence ends with the word
    docs: np.ndarray  # first word of each text, and the end


def _hashed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, whether . ! ? , ; : or a line end follows them, and the first word of each piece."""
    b = np.frombuffer(b" ".join([*pieces, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in pieces)])
    blank = _BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, bool), np.zeros(len(pieces), np.int64)
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    following = np.append(starts[1:], len(b))
    size = ends - starts
    place = np.arange(starts[0], len(b)) - np.repeat(starts, following - starts)
    weight = mixed(np.arange(1, size.max() + 2, dtype=_U) * _U(_BASES[0])) | _U(1)
    h = np.add.reduceat(_BYTE[b[starts[0] :]] * weight[np.minimum(place, size.max())], starts - starts[0])
    lines = np.cumsum(b == 10)
    stop = _STOP[b[ends - 1]] | (lines[following - 1] > lines[ends - 1])
    return mixed(h + size.astype(_U)), stop, np.searchsorted(starts, begins[:-1])


def words(texts: list[bytes]) -> Words:
    """The words of texts, one after another; of long texts ``CHUNK`` bytes at a time are worked on."""
    pieces, first_piece = [], []
    for t in texts:
        first_piece.append(len(pieces))
        at = 0
        while len(t) - at > CHUNK and (m := _BORDER.search(t, at + CHUNK)):
            pieces.append(t[at : m.end() - 1])
            at = m.end() - 1
        pieces.append(t[at:])
    hashes, ends, firsts, n, at = [np.zeros(0, _U)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], 0, 0
    while at < len(pieces):
        to, held = at + 1, len(pieces[at])
        while to < len(pieces) and held + len(pieces[to]) < CHUNK:
            held += len(pieces[to]) + 1
            to += 1
        h, stop, first = _hashed(pieces[at:to])
        hashes.append(h)
        ends.append(stop)
        firsts.append(first + n)
        n, at = n + len(h), to
    docs = np.append(np.concatenate(firsts)[np.array(first_piece, np.int64)], n)
    ends = np.concatenate(ends)
    ends[docs[1:][docs[1:] > docs[:-1]] - 1] = True
    return Words(np.concatenate(hashes), ends, docs)


def parts(texts: pa.Array, most: int = 256) -> Iterator[list[bytes | None]]:
    """Texts in order, up to ``most`` or about ``CHUNK`` bytes at a time."""
    part, held = [], 0
    for t in texts:
        part.append(t.as_py())
        held += len(part[-1] or b"")
        if len(part) == most or held > CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


class Sums:
    """Hashes of stretches of words: sums of powers, modulo 2**64."""

    def __init__(self, x: np.ndarray, which: int):
        self.base = _BASES[which]
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(x * _power(self.base, len(x)), out=self.sums[1:])
        self.back = _power(pow(self.base, -1, 1 << 64), len(x) + 1)

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(_U))

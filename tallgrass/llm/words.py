"""Words of many texts at once: numpy finds word bounds in Arrow's text buffers and hashes every word to 64 bits.

A chunk holds a few megabytes of whole texts, so memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _bytes_where(wanted) -> np.ndarray:
    return np.array([wanted(b) for b in range(256)], dtype=bool)


def _letter_values(seed: int, fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the value of each in a word's hash; with fold, A-Z count as a-z."""

    in_word: np.ndarray
    values: np.ndarray


def alphabet(in_word, fold: bool) -> Alphabet:
    return Alphabet(_bytes_where(in_word), _letter_values(20, fold))


#: Words are runs of anything but ASCII blanks.
BLANK_SPLIT = alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, fold=False)
BLANK_SPLIT_FOLDED = alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, fold=True)
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
ALNUM_FOLDED = alphabet(lambda b: b >= 0x80 or chr(b).isalnum(), fold=True)

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """The words of the texts first .. first+texts-1 of a batch. Byte offsets count from the start of `data`."""

    first: int
    data: np.ndarray
    text_at: np.ndarray  # byte offset of each text, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    lo: np.ndarray  # index of each text's first word
    hi: np.ndarray  # one past its last

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.hi - self.lo)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        lo = start[a]
        b = max(a + 1, int(np.searchsorted(end, lo + _PIECE, "right")))
        n = int(end[b - 1] - lo)
        up, down = _powers(max(n + 1, _PIECE + 1))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data[lo : lo + n]] * up[:n], out=sums[1:])
        out[a:b] = (sums[end[a:b] - lo] - sums[start[a:b] - lo]) * down[start[a:b] - lo]
        a = b
    return mixed(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def chunked(column: pa.Array, letters: Alphabet, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    data, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, len(column))
        at = offsets[first : last + 1]
        part, at = data[at[0] : at[-1]], at - at[0]
        inside = letters.in_word[part]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        starts[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        del starts, ends, inside
        yield Words(first, part, at, start, end, _hashes(part, start, end, letters.values), np.searchsorted(start, at[:-1]), np.searchsorted(start, at[1:]))
        first = last


def run_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive words, text bounds ignored."""
    n = max(0, len(h) - k + 1)
    out = h[:n] + _U(salt)
    for j in range(1, k):
        out = mixed(out * _U(_BASE) + h[j : j + n])
    return out


def text_hashes(w: Words) -> np.ndarray:
    """64 bits of each whole text, blanks included."""
    size = w.text_at[1:] - w.text_at[:-1]
    full = np.flatnonzero(size > 0)
    out = np.zeros(len(size), dtype=np.uint64)
    out[full] = _hashes(w.data, w.text_at[:-1][full], w.text_at[1:][full], _letter_values(21, False))
    return out


def hashes_of(raw: bytes, letters: Alphabet) -> np.ndarray:
    """Word hashes of one text."""
    inside = letters.in_word[np.frombuffer(raw, np.uint8)].view(np.int8)
    bound = np.diff(np.concatenate((np.zeros(1, np.int8), inside, np.zeros(1, np.int8))))
    return _hashes(np.frombuffer(raw, np.uint8), np.flatnonzero(bound == 1), np.flatnonzero(bound == -1), letters.values)

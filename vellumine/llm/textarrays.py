"""Vectorised word hashing over Arrow text batches.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 continuation bytes never fall in that
set, so bytes suffice. A word's identity is a 64-bit polynomial hash with random byte values and a
final mix; sequence hashes are polynomials over word hashes, from prefix sums modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE, _SEQ = U(0x9E3779B97F4A7C15), (U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5))
_grown: dict[int, np.ndarray] = {}
#: Bytes of text hashed at a time; a longer document is one chunk of its own.
CHUNK = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """``base ** (0 .. n-1)`` modulo 2**64."""
    have = _grown.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            _grown[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def chunks(text: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them); null counts as empty."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        part = data[off[a] : off[b]]
        yield a, b, LOWER[part] if lower else part, off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word start bytes, index of each row's first word, with the total at the end)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = SPACE[data]
    head = ~gap
    head[1:] &= gap[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    head[inner] |= ~gap[inner]
    starts = np.flatnonzero(head)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, U), starts, first
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if at is None:
        at = np.zeros(len(data), np.int64)
        at[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[data] * powers(int(_BASE), int(at.max()) + 1)[at]
    value[gap] = 0
    return mix(np.add.reduceat(value, starts)), starts, first


def sequence_hashes(word: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each position; windows may cross rows, callers mask those."""
    if len(word) < n:
        return np.zeros(0, U)
    base = int(_SEQ[which])
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(word) + 1, U)
    np.cumsum((word if not which else mix(word + U(which))) * powers(base, len(word)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(inverse, len(word) - n + 1))


def within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the ``n``-word window from each position stays in one row."""
    if total < n:
        return np.zeros(0, bool)
    row_end = np.repeat(first[1:], np.diff(first))
    return np.arange(total - n + 1) + n <= row_end[: total - n + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def row_of(first: np.ndarray) -> np.ndarray:
    """The row that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

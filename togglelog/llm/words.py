"""Words, word hashes and hashes of word sequences, as numpy arrays.

A word is a run of characters other than space and U+0009 to U+000D. These are exactly the
characters at which `bytes.split()` splits, and no byte of a longer UTF-8 sequence is one of them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import Any

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

# Multiplier of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(BASE, -1, 1 << 64)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as this Python worker, over all its tasks."""
    box = sys.__dict__.setdefault("_togglelog_kept", {})
    if name not in box:
        box[name] = make()
    return box[name]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _spread(count: int, salt: int) -> np.ndarray:
    """`count` fixed 64-bit values without pattern."""
    data = (blake2b(i.to_bytes(4, "little"), digest_size=8, key=bytes([salt])).digest() for i in range(count))
    return np.frombuffer(b"".join(data), np.uint64)


_BYTE_VALUES = _spread(256, 1)


def text_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text; none of a null text. `lower` changes A-Z only."""
    if text is None:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a text, without making the words: polynomials over their bytes."""
    if text is None:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(data.lower() if lower else data, np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[::2]
    first = np.cumsum(lengths) - lengths
    data = data[inside]
    place = np.arange(len(data)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE_VALUES[data] * powers[place], first) + lengths.astype(np.uint64))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 values), by doubling."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    done, h = 0, np.zeros(len(word_hashes) + 1, np.uint64)
    power, width = word_hashes, 1
    while True:
        if n & width:
            # append `width` more words to what has been hashed
            shifted = power[done:]
            size = min(len(h), len(shifted))
            h = h[:size] * np.uint64(pow(BASE, width, 1 << 64)) + shifted[:size]
            done += width
        if done == n:
            return mixed(h[:count])
        power = power[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + power[width:]
        width *= 2


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start up to each end."""
    n = len(word_hashes)
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        for k, base in enumerate((BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    up, down = _POWERS
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hashes * up[:n], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h ^ mixed((ends - starts).astype(np.uint64)))


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut record batches to at most `rows` rows, which bounds what is at hand at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return h.view(np.int64)

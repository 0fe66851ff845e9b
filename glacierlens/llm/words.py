"""Words of UTF-8 texts and their 64-bit fingerprints, for whole batches at a time.

A word is a run of bytes other than the six ASCII white-space characters.  A
fingerprint is a polynomial of random byte values modulo 2**64, mixed with the
word's length; prefix sums give those of all words of a buffer at once.  Modulo a
power of two, long words of few letters can be built that no such polynomial tells
apart, so a word of more than ``LONG`` bytes has 64 bits of a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
# bytes of text that are handled at a time; a longer text is handled alone
BUFFER = 1 << 21
# bytes of a word that the polynomial is trusted with
LONG = 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of a sequence (so far ``a``) that goes on with ``b``."""
    return mix(a * U(_BASE) + mix(b))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, 1 << 64))
        done += more
    return out


_kept: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if n > BUFFER:
        return _powers(base, n)
    if base not in _kept or len(_kept[base]) < n:
        # a reused worker keeps them, so no more than its buffers need
        _kept[base] = _powers(base, min(BUFFER, 1 << n.bit_length()))
    return _kept[base][:n]


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[0::2], turns[1::2]


def fingerprints(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of each word."""
    starts, ends = bounds(data)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[np.frombuffer(data, np.uint8)] * _power(_BASE, n), out=sums[1:])
    inverse = _power(_INVERSE, n)
    prints = (sums[ends] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint64)
    prints = mix(prints + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        prints[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, ends, prints


def runs(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[int, int]]:
    """First and end of consecutive texts that fill a buffer together."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) + 1 > size:
            yield first, i
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def buffers(column, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of consecutive rows of an Arrow string column that fill a buffer together.

    Only one buffer's texts are Python objects at a time.
    """
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, total = 0, 0
    for i, length in enumerate(lengths):
        if i > first and total + length + 1 > size:
            yield first, utf8(column.slice(first, i - first))
            first, total = i, 0
        total += length + 1
    if first < len(lengths):
        yield first, utf8(column.slice(first))


def word_counts(starts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Number of words of each joined text."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(np.searchsorted(starts, ends), prepend=0)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

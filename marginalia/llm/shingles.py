"""Word shingles of whole texts as 64-bit hashes, their signatures and exact set comparison, in numpy.

Words are runs of bytes other than space and TAB..CR, with A-Z in lower case. A shingle is SHINGLE words in a row; a
text with fewer words is one shingle, and one without words has none. The hash of a shingle is a polynomial over the
bytes of its words and one separator after each, taken from running sums over the text, then mixed; one pass of array
operations hashes a batch of texts, however many words they have.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed at once; a longer text is hashed in pieces that overlap by SHINGLE - 1 words.
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for x in (_BASE, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POW, _INV = _powers(1 << 16)


def _grown(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(1 << (n - 1).bit_length())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all runs of ``window`` words; starts and ends of the words in raw."""
    sizes = ends - starts + 1  # with the separator
    to = np.cumsum(sizes)
    n = int(to[-1])
    _grown(n + 1)
    at = np.repeat(starts - (to - sizes), sizes) + np.arange(n)
    letters = _BYTE[_LOWER[raw[np.minimum(at, len(raw) - 1)]]]
    letters[to - 1] = _BYTE[32]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters * _POW[:n], out=sums[1:])
    first = (to - sizes)[: len(to) - window + 1]
    last = to[window - 1 :]
    return _mix((sums[last] - sums[first]) * _INV[first] + (last - first).astype(np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    if len(text) <= PIECE:
        return _set_of(np.frombuffer(text, np.uint8))
    # cut at white space; each piece starts SHINGLE - 1 words before the last one ended
    raw = np.frombuffer(text, np.uint8)
    starts, ends = _word_bounds(raw)
    if len(starts) <= SHINGLE:
        return _set_of(raw)
    found, lo = [], 0
    while True:
        hi = max(int(np.searchsorted(starts, starts[lo] + PIECE)), lo + SHINGLE)
        hi = min(hi, len(starts))
        base = int(starts[lo])
        found.append(np.unique(_hashed(raw[base : int(ends[hi - 1])], starts[lo:hi] - base, ends[lo:hi] - base, SHINGLE)))
        if hi == len(starts):
            return np.unique(np.concatenate(found))
        lo = hi - SHINGLE + 1


def _set_of(raw: np.ndarray) -> np.ndarray:
    starts, ends = _word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(_hashed(raw, starts, ends, min(SHINGLE, len(starts))))


def shingle_sets(texts: list[bytes]):
    """shingle_set() of each text."""
    batch, size = [], 0
    for text in texts:
        if size and size + len(text) > PIECE:
            yield from _batch_sets(batch)
            batch, size = [], 0
        if len(text) > PIECE // 4:
            yield from _batch_sets(batch)
            batch, size = [], 0
            yield shingle_set(text)
        else:
            batch.append(text)
            size += len(text) + 1
    yield from _batch_sets(batch)


def _batch_sets(texts: list[bytes]):
    """Of short texts together: the words of all, and only the windows that stay within one."""
    if not texts:
        return
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = _word_bounds(raw)
    after = np.cumsum([len(x) + 1 for x in texts])
    until = np.searchsorted(starts, after)
    hashes = _hashed(raw, starts, ends, SHINGLE) if len(starts) >= SHINGLE else np.zeros(0, np.uint64)
    lo = 0
    for text, hi in zip(texts, until.tolist()):
        if hi - lo >= SHINGLE:
            yield np.unique(hashes[lo : hi - SHINGLE + 1])
        else:
            yield _set_of(np.frombuffer(text, np.uint8))
        lo = hi


def set_key(hashes: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class MinHash:
    """``size`` minima of a set under random maps of 32-bit values, as 16 bits each."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mul = rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)
        self.xor = rng.integers(0, 2**32, size, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), 2**32 - 1, np.uint32)
        values = (hashes >> np.uint64(16)).astype(np.uint32)
        for k in range(0, len(values), 2048):
            np.minimum(low, ((values[None, k : k + 2048] ^ self.xor[:, None]) * self.mul[:, None]).min(1), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())

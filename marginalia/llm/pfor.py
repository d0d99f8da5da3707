"""Patched frame-of-reference blocks of unsigned 32-bit ids, and files of them.

A block holds up to BLOCK ids: the block's minimum is subtracted, the rest is packed at a width taken from a
percentile of the block's bit lengths (of PERCENTILES, the one that makes the block smallest), and ids too wide for
it are kept whole in an exception list. Layout of a block, little-endian: minimum u32, width u8, exceptions u8, ids
u16; width * BLOCK / 8 bytes, in which lane j (of LANES) packs the ids j, j + LANES, ... into 32-bit words; positions
of exceptions u8 each; their values (less the minimum) u32 each.

A file: HEAD; blocks; u64 start of each block; doc ids i64, null flags u8 and numbers of ids u64 of each document;
FOOT. Documents follow each other without regard to blocks; their starts are sums of the numbers before.
"""

from __future__ import annotations

import struct

import numpy as np

LANES, BLOCK = 8, 256
PERCENTILES = (0.9, 0.95, 0.98, 1.0)
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sHH8x")
FOOT = struct.Struct("<QQQQ4s")
_HEADER = np.dtype([("base", "<u4"), ("width", "u1"), ("n_exc", "u1"), ("n", "<u2")])


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed blocks of the ids, and the byte offset of each."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return b"", np.zeros(0, np.int64)
    full = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    values = full.reshape(n_blocks, BLOCK)
    base = values.min(1)
    rest = values - base[:, None]
    widest = int(rest.max()).bit_length()
    wider = np.stack([(rest >> w != 0).sum(1) if w < 32 else np.zeros(n_blocks, np.int64) for w in range(widest + 1)])
    widths = np.stack([np.argmax(wider <= int((1 - p) * BLOCK + 1e-9), axis=0) for p in PERCENTILES])
    sizes = 32 * widths + 5 * np.take_along_axis(wider, widths, 0)
    best = np.argmin(sizes, axis=0)
    width = widths[best, np.arange(n_blocks)]
    n_exc = wider[width, np.arange(n_blocks)]
    size = _HEADER.itemsize + 32 * width + 5 * n_exc
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    header = np.zeros(n_blocks, _HEADER)
    header["base"], header["width"], header["n_exc"], header["n"] = base, width, n_exc, BLOCK
    header["n"][-1] = len(ids) - (n_blocks - 1) * BLOCK
    out[starts[:, None] + np.arange(_HEADER.itemsize)] = header.view(np.uint8).reshape(n_blocks, -1)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            out[(starts[rows] + _HEADER.itemsize)[:, None] + np.arange(32 * w)] = _pack(rest[rows], int(w)).view(np.uint8).reshape(len(rows), -1)
    row, col = np.nonzero(rest >> np.minimum(width, 31).astype(np.uint32)[:, None] * (width < 32)[:, None]) if n_exc.any() else (np.zeros(0, np.int64),) * 2
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
        at = starts[row] + _HEADER.itemsize + 32 * width[row]
        out[at + nth] = col
        out[(at + n_exc[row] + 4 * nth)[:, None] + np.arange(4)] = rest[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts


def _pack(rest: np.ndarray, w: int) -> np.ndarray:
    lanes = (rest & np.uint32((1 << w) - 1)).reshape(len(rest), 32, LANES)
    out = np.zeros((len(rest), w, LANES), np.uint32)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out


def _unpack(packed: np.ndarray, w: int) -> np.ndarray:
    words = packed.reshape(-1, w, LANES)
    out = np.empty((len(words), 32, LANES), np.uint32)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        x = words[:, word] >> np.uint32(shift)
        if shift + w > 32:
            x = x | words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & np.uint32((1 << w) - 1)
    return out.reshape(-1, BLOCK)


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these offsets of data (u8)."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    header = data[starts[:, None] + np.arange(_HEADER.itemsize)].copy().view(_HEADER).reshape(-1)
    width, n_exc = header["width"].astype(np.int64), header["n_exc"].astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            packed = data[(starts[rows] + _HEADER.itemsize)[:, None] + np.arange(32 * w)].copy().view("<u4")
            rest[rows] = _unpack(packed, int(w))
    row = np.repeat(np.arange(len(starts)), n_exc)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
        at = starts[row] + _HEADER.itemsize + 32 * width[row]
        rest[row, data[at + nth]] = data[(at + n_exc[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    out = rest + header["base"][:, None]
    return out.reshape(-1) if (header["n"] == BLOCK).all() else out[np.arange(BLOCK) < header["n"][:, None]]


class Writer:
    """One file, written as ids come; only the ids of an unfinished block are held back."""

    def __init__(self, file):
        self.file, self.at, self.held = file, HEAD.size, np.zeros(0, np.uint32)
        self.starts, self.doc_ids, self.nulls, self.counts, self.n_ids = [], [], [], [], 0
        file.write(HEAD.pack(MAGIC, 1, BLOCK))

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += [x or 0 for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.counts.append(counts)
        self.n_ids += len(ids)
        ids = np.concatenate([self.held, ids.astype(np.uint32)])
        cut = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:cut])
        self.held = ids[cut:]

    def _blocks(self, ids: np.ndarray) -> None:
        data, starts = encode_blocks(ids)
        self.starts.append(starts + self.at)
        self.at += len(data)
        self.file.write(data)

    def close(self) -> tuple[int, int]:
        """Writes what is left; returns the numbers of documents and ids."""
        self._blocks(self.held)
        starts = np.concatenate(self.starts).astype("<u8")
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)]).astype("<u8")
        for x in (starts, np.array(self.doc_ids, "<i8"), np.array(self.nulls, np.uint8), counts):
            self.file.write(x.tobytes())
        self.file.write(FOOT.pack(len(starts), len(counts), self.n_ids, self.at, MAGIC))
        self.file.close()
        return len(counts), self.n_ids


class Reader:
    """A whole file in memory; read() decodes the blocks it needs only."""

    def __init__(self, content: bytes):
        self.data = np.frombuffer(content, np.uint8)
        if len(content) < HEAD.size + FOOT.size or content[:4] != MAGIC or content[-4:] != MAGIC:
            raise ValueError("not a whole file of patched frame-of-reference blocks")
        n_blocks, n_docs, self.n_ids, at, _ = FOOT.unpack(content[-FOOT.size :])
        if at + 8 * n_blocks + 17 * n_docs + FOOT.size != len(content):
            raise ValueError("the index of the file does not fit its length")
        self.starts = np.frombuffer(content, "<u8", n_blocks, at)
        at += 8 * n_blocks
        self.doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        self.nulls = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.doc_starts = np.cumsum(self.counts) - self.counts

    def read(self, start: int, n: int) -> np.ndarray:
        first = start // BLOCK
        ids = decode_blocks(self.data, self.starts[first : -(-(start + n) // BLOCK)])
        return ids[start - first * BLOCK : start - first * BLOCK + n]

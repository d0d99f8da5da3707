"""Exact token ids and counts by way of pieces of text that a tokenizer encodes independently of their neighbours.

A table in each Python worker maps pieces it has met to their ids (or counts); only pieces new to the worker go
through the tokenizer, in batches. Tables are bounded in entries and in bytes; a full one keeps the pieces that it met
first, without long ones.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's table, and those it keeps when it is full.
MAX_PIECES, KEPT_PIECES = 500_000, 200_000
#: Bytes of a worker's pieces and ids, and the longest piece that a full table keeps.
MAX_HELD, LONGEST = 64 << 20, 128
#: Pieces that go through the tokenizer as one text.
GROUP = 64
SPECIAL = b"<|endoftext|>"
_MARKS = (b".", b",", b";", b":", b"!", b"?")
#: Bytes of text worked on at once.
SLICE = 1 << 20

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class Pieces(dict):
    """piece -> number; a new piece gets the next number and waits for resolve()."""

    def __init__(self, path: str, known: tuple[list, list] = ((), ()), ids: bool = True, spell=None, separator: str = SPECIAL.decode()):
        self.path, self.ids, self.spell = path, ids, spell or spelled
        self.separator, self.separator_id = separator, tokenizer(path).token_to_id(separator)
        self.new: list = []
        # 32 bits are enough for what is bounded by MAX_HELD and the ids of one text
        self.flat, self.sizes, self.starts = array("I"), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.held = 0
        self.update(zip(known[0], range(len(known[0]))))
        self.room()
        self.sizes[: len(self)] = known[1]

    def room(self) -> None:
        while len(self.sizes) < len(self):
            self.sizes, self.starts = np.concatenate([self.sizes] * 2), np.concatenate([self.starts] * 2)

    def shrink(self) -> None:
        """Keep the pieces met first: frequent ones come early."""
        kept = [x for x in islice(self, KEPT_PIECES) if len(x) <= LONGEST]
        codes = np.fromiter(map(self.__getitem__, kept), np.int64, len(kept))
        ids, sizes = self.gather(codes)
        self.clear()
        self.update(zip(kept, range(len(kept))))
        self.held, self.flat = sum(map(len, kept)), array("I")
        if len(kept):
            self.put(np.arange(len(kept)), sizes, ids)

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n

    def put(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.sizes[codes] = sizes
        if self.ids:
            self.starts[codes] = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def at(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of the pieces lie, one after the other."""
        ends = np.cumsum(sizes)
        at = np.repeat((self.starts[codes] - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return at

    def resolve(self) -> None:
        """New words go through the tokenizer in batches, between separators that it takes as special tokens. A word
        with a mark after it has the ids of the word and then those of the mark."""
        new, self.new = self.new, []
        words, made = [], []
        spaced_mark = self.spell is spelled
        for x in new:
            if isinstance(x, bytes) and x[-1:] in _MARKS and x[-2:-1].isalpha():
                made.append((self[x], self[x[:-1]], self[x[-1:].decode() if spaced_mark else x[-1:]]))
            else:
                words.append(x)
        words += self.new
        self.new = []
        self.held += sum(map(len, words))
        self.room()
        plain, odd = [], []
        for x in words:
            (plain if len(x) <= LONGEST and (b"<" if isinstance(x, bytes) else "<") not in x else odd).append(x)
        encode = tokenizer(self.path).encode_batch_fast
        for x in odd:  # one by one, as each may be very long
            ids = encode([self.spell(x)], add_special_tokens=False)[0].ids
            self.put(np.array([self[x]]), np.array([len(ids)]), np.array(ids, np.uint32))
        for k in range(0, len(plain), GROUP * GROUP):
            part = plain[k : k + GROUP * GROUP]
            texts = list(map(self.spell, part))
            joined = [self.separator.join([*texts[i : i + GROUP], ""]) for i in range(0, len(texts), GROUP)]
            ids = np.array(list(chain.from_iterable(e.ids for e in encode(joined, add_special_tokens=False))), np.int64)
            ends = np.flatnonzero(ids == self.separator_id)
            sizes = np.diff(ends, prepend=-1) - 1
            self.put(np.fromiter(map(self.__getitem__, part), np.int64, len(part)), sizes, ids[ids != self.separator_id])
        if made:
            codes, word, mark = np.array(made, np.int64).T
            parts = np.stack([word, mark], 1).reshape(-1)
            sizes = self.sizes[parts]
            ids = np.frombuffer(self.flat, np.uint32)[self.at(parts, sizes)] if self.ids else np.zeros(0, np.uint32)
            self.put(codes, sizes.reshape(-1, 2).sum(1), ids)

    def codes(self, pieces: list) -> np.ndarray:
        if len(self) > MAX_PIECES or self.held + 4 * len(self.flat) > MAX_HELD:
            self.shrink()
        codes = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            self.resolve()
        return codes

    def encode(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has (ids are empty if the table keeps counts only)."""
        return self.gather(self.codes(pieces))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[codes]
        if not self.ids or not len(codes) or not len(self.flat):
            return np.zeros(0, np.uint32), sizes
        return np.frombuffer(self.flat, np.uint32)[self.at(codes, sizes)], sizes


def spelled(piece: bytes | str) -> str:
    """str: as it stands. bytes: after a space, unless it starts with a line feed."""
    if isinstance(piece, str):
        return piece
    return piece.decode() if piece[:1] == b"\n" else " " + piece.decode()


#: Unicode White_Space besides space and line feed, as UTF-8.
_ODD = [b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_TIGHT = [b"  ", b" \n", b"\n\n\n", b"\n\n "]
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BEFORE = re.compile(f" (?=[^{_SPACES}])")


def spaced(text: bytes) -> list[bytes | str]:
    """Pieces for byte-level BPE whose pattern takes one space with the word after it: the text cut before each
    space that a character other than white space follows, and, where that is as exact, before line feeds."""
    if SPECIAL in text:
        return [text.decode()]
    if any(x in text for x in _TIGHT) or text[-1:] == b" " or text[-2:] == b"\n\n" or any(x in text for x in _ODD):
        first, *rest = _BEFORE.split(text.decode())
        return [first, *(x.encode() for x in rest)] if first else [x.encode() for x in rest]
    first, *rest = text.replace(b"\n", b" \n").split(b" ")
    return [first.decode(), *rest] if first else rest


def slices(texts, limit: int = SLICE):
    """Lists of positions and texts (null: empty), of about ``limit`` bytes together."""
    at, held, size = [], [], 0
    for i, x in enumerate(texts):
        x = x or b""
        at.append(i)
        held.append(x)
        size += len(x)
        if size >= limit:
            yield at, held
            at, held, size = [], [], 0
    if at:
        yield at, held


def encode_texts(table: Pieces, cut, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the number of ids of each."""
    cuts = [cut(x) for x in texts]
    ids, sizes = table.encode(list(chain.from_iterable(cuts)))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.cumsum([0, *map(len, cuts)])
    return ids, np.diff(ends[at])


def text_slices(texts: pa.Array, limit: int = SLICE):
    """Parts of an array of strings, of about ``limit`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def encode_words(table: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts() for a tokenizer that lower-cases, drops white space and never joins what it separates."""
    texts = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens keep their case
        texts = pc.ascii_lower(texts)
    cuts = pc.ascii_split_whitespace(texts)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(cuts).to_numpy(zero_copy_only=False))])
    own = cuts.flatten().cast(pa.binary()).dictionary_encode()
    del texts, cuts
    codes = table.codes(own.dictionary.to_numpy(zero_copy_only=False).tolist()).astype(np.int32)
    codes = codes[own.indices.to_numpy(zero_copy_only=False)]
    del own
    ids, sizes = table.gather(codes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ids, np.diff(ends[at])

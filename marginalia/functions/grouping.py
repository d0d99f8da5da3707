"""Words of documents grouped by term, for all words of a text at once: in Arrow batches, in parts of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marginalia.functions.stemming import stem

#: Words of a part, unless one document has more; documents of a part; stems that a worker remembers.
PART_WORDS, PART_ROWS, KEPT_STEMS = 1 << 20, 1 << 14, 100_000
_STEMS: dict[str, str] = {}


def stems(words: list[str]) -> list[str]:
    """The first words that a worker meets, so the frequent ones, are stemmed once."""
    out = []
    for w in words:
        made = _STEMS.get(w)
        if made is None:
            made = stem(w)
            if len(_STEMS) < KEPT_STEMS:
                _STEMS[w] = made
        out.append(made)
    return out


def shape(pattern: str, end: str = r"\Z") -> str:
    """The regular expression of a pattern with *. end: the mark of the end of a text, which Java writes as \\z."""
    return r"(?s)\A" + ".*".join(re.escape(p) for p in pattern.split("*")) + end


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents, of about PART_WORDS words."""
    ends, at = offsets(sizes), 0
    while at < len(sizes):
        to = min(at + PART_ROWS, max(at + 1, int(np.searchsorted(ends, ends[at] + PART_WORDS, "right")) - 1))
        yield at, to
        at = to


def _coded(words: pa.Array, stemming: bool) -> tuple[np.ndarray, pa.Array]:
    """A number for each word and the terms that the numbers stand for."""
    coded = words.dictionary_encode()
    numbers, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if stemming:
        again = pa.array(stems(terms.to_pylist()), pa.string()).dictionary_encode()
        numbers, terms = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[numbers], again.dictionary
    return numbers, terms


def grouped(sizes: np.ndarray, words: pa.Array, stemming: bool, wanted=None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts of so many words each: the text and the term of each group, where its positions start, and positions."""
    numbers, terms = _coded(words, stemming)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    at = np.arange(len(numbers), dtype=np.int64)
    if wanted is not None:
        kept = np.array([wanted(t) for t in terms.to_pylist()], bool)[numbers]
        numbers, rows, at = numbers[kept], rows[kept], at[kept]
    # one number for text, term and place, so that sorting numbers sorts them all
    low, mid = max(1, len(words)).bit_length(), max(1, len(terms)).bit_length()
    if len(sizes).bit_length() + mid + low > 63:
        raise OverflowError(f"a part of {len(sizes)} texts and {len(words)} words is too large")
    key = np.sort(((rows << mid) | numbers) << low | at)
    pair, at = key >> low, key & ((1 << low) - 1)
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    text = pair[first] >> mid
    positions = at - offsets(sizes)[:-1][pair >> mid]
    return text, terms.take(pa.array(pair[first] & ((1 << mid) - 1))), first, positions.astype(np.int32)


def lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def by_terms(n_fields: int, stemming: bool, positions: bool, flat: bool, terms: list[str] | None = None, patterns: tuple[str, ...] = ()):
    """For mapInArrow over doc_id, block and ts (an array of words a field). flat: a row a posting, else a row a document.
    terms, patterns: of these terms alone, and those that match a pattern with *."""
    some, shapes = frozenset(terms or ()), [re.compile(shape(x)) for x in patterns]
    wanted = None if terms is None else lambda t: t in some or any(x.search(t) for x in shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("ts").flatten()
            sizes = np.diff(texts.offsets.to_numpy()).astype(np.int64).reshape(-1, n_fields)
            for a, b in parts(sizes.sum(1)):
                part = texts.slice(a * n_fields, (b - a) * n_fields)
                own = sizes[a:b].ravel()
                text, terms, first, places = grouped(own, part.flatten(), stemming, wanted)
                held = lists(np.append(first, len(places)), pa.array(places if positions else np.zeros(len(places), np.int32)))
                ids, blocks = batch.column("doc_id").slice(a, b - a), batch.column("block").slice(a, b - a)
                if flat:
                    doc = pa.array(text // n_fields)
                    tf = np.diff(np.append(first, len(places))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([terms, pa.array((text % n_fields).astype(np.int32)), ids.take(doc), pa.array(tf), pa.array(own[text].astype(np.int32)), held, blocks.take(doc)], ["term", "field_id", "doc_id", "tf", "dl", "positions", "block"])
                else:
                    groups = pa.StructArray.from_arrays([terms, held], ["term", "positions"])
                    by_text = lists(offsets(np.bincount(text, minlength=len(own))), groups)
                    by_doc = np.arange(b - a + 1) * n_fields
                    yield pa.RecordBatch.from_arrays([ids, lists(by_doc, pa.array(own.astype(np.int32))), blocks, lists(by_doc, by_text)], ["doc_id", "dls", "block", "ps"])

    return run

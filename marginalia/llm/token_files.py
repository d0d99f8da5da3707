"""Token ids of documents as files of patched frame-of-reference blocks, in ascending order of doc id.

Rows are dealt out by ranges of (doc id, hash of the text), so neither one id nor equal texts overload a task. Each
task tokenizes its range in order into files of about FILE_BYTES, which it names itself; the names that committed
tasks return form the manifest, a small table of one row per file. Only files of the manifest are read back; ids before
a file are sums over the manifest.

Edge cases: a null text is empty and becomes the end id alone; null doc ids come first; rows that repeat a doc id
follow each other, equal ids in the order of the texts' hashes; an empty table writes no files; strings of special
tokens become their ids, as the library does; a very long text is tokenized whole, its words one by one, and long words
are not kept in the worker's table; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_batches, col, scratch, table, written
from marginalia.llm.pfor import BLOCK, Reader, Writer
from marginalia.llm.pieces import Pieces, encode_words, text_slices
from marginalia.llm.store import content, create, dealt
from marginalia.llm.workers import lean, shared

TOKENIZER, END_ID = "word_bpe_49k.json", 2
FILE_BYTES = 16 << 20
MANIFEST = "path string, part long, nth long, n_docs long, n_ids long"
#: Bytes of text worked on at once.
SLICE = 6 << 20
#: Ids decoded at once.
DECODED = 4096 * BLOCK


as_is = bytes.decode


def _append_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    return (ids, counts) if end_id is None else (np.insert(ids, np.cumsum(counts), end_id), counts + 1)


def _writer(folder: str, tokenizer: str, end_id: int | None, file_bytes: int):
    def run(batches):
        table = shared(f"ids:{tokenizer}", lambda: Pieces(tokenizer, spell=as_is))
        part, own, done, out = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        for batch in lean(batches, tables=True):
            doc_ids = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch.column(1), SLICE):
                if out is None:
                    path = f"{folder}/{part:06d}-{len(done):04d}-{own}.pfor"
                    out = Writer(create(path))
                ids, counts = _append_end(*encode_words(table, texts), end_id)
                out.add(doc_ids[lo : lo + len(texts)], counts, ids)
                if out.at >= file_bytes:
                    done.append((path, part, len(done), *out.close()))
                    out = None
        if out is not None:
            done.append((path, part, len(done), *out.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "nth", "n_docs", "n_ids"), x)) for x in done], pa.schema([("path", pa.string()), *((x, pa.int64()) for x in ("part", "nth", "n_docs", "n_ids"))]))

    return run


def write_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files under folder (a URI all executors reach) and return the manifest with ``before``, the ids of
    all files before. tokenizer: a file of the tokenizers library whose pre-tokenizer drops white space."""
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    key = ["doc_id", "__h"]
    rows = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    with arrow_batches(docs.sparkSession, SLICE):
        files = written(rows.mapInArrow(_writer(folder, tokenizer, end_id, file_bytes), MANIFEST), "manifest")
    # one row per file of many MB: the running sum is over a table far smaller than any index of the corpus
    order = Window.orderBy("part", "nth")
    return files.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))


def _reader(batches):
    for batch in lean(batches):
        for path, before in zip(*(c.to_pylist() for c in batch.columns)):
            file = Reader(content(path))
            crcs = np.zeros(len(file.counts), np.int64)
            for lo, hi in _runs(file.counts):
                ids = file.read(int(file.doc_starts[lo]), int(file.counts[lo:hi].sum())).astype("<u4")
                raw, off = memoryview(ids.tobytes()), 0
                for i in range(lo, hi):
                    n = 4 * int(file.counts[i])
                    crcs[i] = zlib.crc32(raw[off : off + n])
                    off += n
            doc_ids = pa.array(file.doc_ids, pa.int64(), mask=file.nulls)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(file.doc_starts + before), pa.array(file.counts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _runs(counts: np.ndarray):
    """Ranges of documents with about DECODED ids together."""
    lo, held = 0, 0
    for i, n in enumerate(counts):
        held += int(n)
        if held >= DECODED:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(counts):
        yield lo, len(counts)


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files in the manifest: doc_id, start, n_tokens, ids_crc32. A file that is not whole is an
    error: the manifest has files of committed tasks alone."""
    files = manifest.select("path", "before")
    return dealt(files, manifest.count()).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the ids of docs to files in the scratch folder, read them back, and describe each document."""
    import public_tokenizers

    folder = scratch(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, public_tokenizers.path(TOKENIZER)))


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))

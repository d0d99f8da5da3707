"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pre-tokens' lengths, then a
cache in each worker, then the tokenizer. No pre-token is shuffled. The table is fitted on the first SAMPLE_CHARS
characters of at most SAMPLE_DOCS documents, which the driver takes from the first partitions, so its cost is the same
at every size; it decides speed alone, and counts are exact whatever it holds.

Edge cases: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text are taken as the
library does by default; repeated rows are counted each; a very long text is cut into pre-tokens like any other, and
very long pre-tokens are counted one by one and not kept; documents do not compete, so there are no ties; columns of
docs pass through whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import col, table
from marginalia.llm.pieces import Pieces, encode_texts, slices, spaced
from marginalia.llm.workers import lean, shared

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens in the broadcast table, bytes of the longest in it, and what it is fitted on.
FREQUENT, LONGEST = 32_768, 64
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 4_096
MAX_TOKENS = 1024


def _binary(col: pa.Array) -> pa.Array:
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())


def frequent(docs: DataFrame, text: str, path: str) -> tuple[list[bytes], list[int]]:
    """The most frequent pre-tokens of the sample and their numbers of tokens: at most FREQUENT of LONGEST bytes."""
    sample = docs.select(F.substring(col(text), 1, SAMPLE_CHARS).alias("text")).take(SAMPLE_DOCS)
    counts = Counter(chain.from_iterable(spaced((r["text"] or "").encode()) for r in sample))
    ranked = sorted((-n, x) for x, n in counts.items() if isinstance(x, bytes) and len(x) <= LONGEST)
    known = [x for _, x in ranked[:FREQUENT]]
    return known, Pieces(path, ids=False).encode(known)[1].tolist()


def _counter(path: str, known, key: str):
    def run(batches):
        pieces = shared(key, lambda: Pieces(path, known.value, ids=False))
        for batch in lean(batches, tables=True):
            raw = _binary(batch.column(batch.num_columns - 1))
            counts: list[int] = []
            for _, texts in slices(raw.to_pylist()):
                counts += encode_texts(pieces, spaced, texts)[1].tolist()
            sizes = pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``keep`` columns of docs (default: all but the text) with n_bytes, n_tokens and over_limit; a column of docs
    with one of these names gives way. path: a file of the tokenizers library with byte-level BPE."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path))
    # mapInArrow takes no column with a dot in its name
    rows = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(keep)], col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = rows.mapInArrow(_counter(path, known, f"{path}-{known._jbroadcast.id()}"), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep=["doc_id"])

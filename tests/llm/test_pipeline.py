import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from marginalia.llm import token_files
from marginalia.llm.common import written
from tokenizers import Tokenizer

from test_operators import DOCS, ODD, components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()] + ODD
    docs = written(spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS kept", "1 AS node"), "docs")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), "stage")
        assert after.columns == columns, name
        if name == "near duplicates":
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert ids(after) == sorted(d for d, _, c in components(left, corpus_pipeline.NEAR_DUP_PCT) if d == c)
        if name != "mixing":
            assert after.count() < docs.count(), name
        docs = after
    full = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    got = sorted(map(tuple, corpus_pipeline.tokens(spark, docs, SF).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == ids(docs)
    texts, start = {r.doc_id: r.text for r in docs.collect()}, 0
    for doc, at, n, crc in got:
        own = np.array([*full.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        assert (at, n, crc) == (start, len(own), zlib.crc32(own.tobytes()))
        start += n


def test_run_equals_its_stages_and_empty_input(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.collect() == []

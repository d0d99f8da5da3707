import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import pfor, pieces, token_counts, token_files

TEXTS = [
    "The quick brown fox.\n\nJumps over it's lazy dogs\tand 123 <|endoftext|> cats",
    "", None, " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n \nb", "a\n\n\nb", "a\n\n b", "\n\na", "a\n\n", "x\n <|endoftext|>", "déjà vu",
    "é ß 　wide  space end", "<|startoftext|>hi<|endoftext|> THERE", "\x1c a\x1cb \x1d", "naïve café " * 3000, "1234567 'll don't we'RE", "café ́x Å", "  lead", "tail\r\n", "日本語 テキスト。  ",
]


def docs(spark, texts=TEXTS):
    rows = [(i, x, i) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:6], "doc_id long, text string, n_tokens int")


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 3000):
        for high in (1, 2, 1000, 49408, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[::31] = rng.integers(0, 2**32, len(ids[::31]), dtype=np.uint32)
            data, starts = pfor.encode_blocks(ids)
            assert (pfor.decode_blocks(np.frombuffer(data, np.uint8), starts) == ids).all()
    ids = rng.integers(0, 16, 2560, dtype=np.uint32)
    ids[::100] = 40_000  # outliers go to the exception lists and do not widen the blocks
    assert len(pfor.encode_blocks(ids)[0]) < 10 * (8 + 4 * 32 + 5 * 4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_spaced_pieces_match_the_library(name):
    import random

    rng = random.Random(3)
    full = Tokenizer.from_file(public_tokenizers.path(name))
    made = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", ".", "'s", "9", " ", "é", " ", "<|endoftext|>", "Ab"]) for _ in range(30)) for _ in range(800)]
    texts = [x for x in TEXTS if x] + made
    table = pieces.Pieces(public_tokenizers.path(name))
    ids, sizes = pieces.encode_texts(table, pieces.spaced, [x.encode() for x in texts])
    want = full.encode_batch(texts, add_special_tokens=False)
    at = np.cumsum([0, *sizes])
    for i, w in enumerate(want):
        assert ids[at[i] : at[i + 1]].tolist() == w.ids, repr(texts[i])


def test_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs(spark).repartition(3), path, max_tokens=100).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        n = len(full.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((TEXTS[r.doc_id] or "").encode()), n > 100)
    assert token_counts.count_tokens(docs(spark).limit(0), path).collect() == []


def test_token_files(spark):
    full = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    rows = token_files.token_digest(docs(spark).repartition(3)).orderBy("doc_id", "start").collect()
    start = 0
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        ids = np.array([*full.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_digest(docs(spark).limit(0)).collect() == []


def test_null_ids_come_first(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a"), (-5, "c")], "doc_id long, text string")
    assert [r.doc_id for r in token_files.token_digest(df).orderBy("start").collect()] == [None, -5, 1]


def test_files_left_by_lost_attempts_are_not_opened(spark):
    df = docs(spark)
    folder = token_files.scratch(spark, "tokens-test")
    manifest = token_files.write_files(df, folder, public_tokenizers.path(token_files.TOKENIZER))
    good = Path(urlparse(manifest.first().path).path)
    (good.parent / f"cut-{good.name}").write_bytes(good.read_bytes()[:-7])
    assert token_files.read_files(manifest).count() == df.count()
    for n in (7, 30):
        with pytest.raises(ValueError):
            pfor.Reader(good.read_bytes()[:-n])


def test_tables_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "MAX_HELD", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    table, full = pieces.Pieces(path, spell=token_files.as_is), Tokenizer.from_file(path)
    for texts in (["a b c", "x" * 5000], ["some other words, and " + "y" * 300], ["c b a", "x" * 5000, "words"]):
        ids, sizes = pieces.encode_words(table, pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in full.encode(t, add_special_tokens=False).ids]
    table.codes([])
    assert table.held + 4 * len(table.flat) <= 2000 and not any(len(x) > pieces.LONGEST for x in table)


def test_long_texts_without_a_space(spark):
    texts = ["x" * 300_000, "日本" * 50_000, "ab" * 100_000 + " tail"]
    for name, run in (("byte_bpe_50k.json", lambda d, p: token_counts.count_tokens(d, p)), (token_files.TOKENIZER, lambda d, p: token_files.token_digest(d))):
        full = Tokenizer.from_file(public_tokenizers.path(name))
        more = name == token_files.TOKENIZER
        got = {r.doc_id: r.n_tokens - more for r in run(spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "doc_id long, text string, `a.b` int"), public_tokenizers.path(name)).collect()}
        assert got == {i: len(full.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_the_sample_decides_speed_alone(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs(spark), path).collect()}
    monkeypatch.setattr(token_counts, "SAMPLE_DOCS", 1)
    out = token_counts.count_tokens(docs(spark), path)
    assert {(r.doc_id, r.n_tokens) for r in out.collect()} == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()

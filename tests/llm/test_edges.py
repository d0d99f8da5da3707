"""Every operator and stage with nulls, repeated rows, texts without a space, empty tables, and odd column names."""

from collections import Counter

import corpus_pipeline
import pytest
from marginalia.llm import chat, decontaminate, host_rules, line_spread, mixing, near_dups, pseudonyms, token_counts, token_files, warc
from marginalia.llm.common import written

NAMES = ["__i", "__h", "__found", "__row", "__text", "__id", "__host", "__k0", "__on0", "__s", "__salt", "__maybe", "__at", "__bits", "a.b", "at", "row", "node", "hash", "gone", "found", "new", "text_hash", "p", "w", "`q`", "n n"]
LONG = "x" * 5_000_000
GOOD = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, GOOD, "s"), (1, GOOD, "s"), (1, GOOD, "s"), (2, None, None), (3, "", "s"), (None, GOOD + " more", None), (4, LONG, "s"), (5, "mail a@b.org " + GOOD, "t"), (2, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return written(df.selectExpr("*", *[f"{i} AS `{n.replace('`', '``')}`" for i, n in enumerate(NAMES)]), "odd")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 40))), (2, None), (3, ""), (1, "again " * 20)], "item_id long, text string")


KEEPERS = {
    "host_rules.keep_good": lambda spark, df: host_rules.keep_good(df),
    "host_rules.verdicts": lambda spark, df: host_rules.verdicts(df),
    "near_dups": lambda spark, df: near_dups.drop_near_duplicates(df),
    "decontaminate": lambda spark, df: decontaminate.drop_contaminated(df, bench(spark)),
    "mixing": lambda spark, df: mixing.mix(df),
    "line_spread": lambda spark, df: line_spread.remove_boilerplate(df),
    "pseudonyms": lambda spark, df: pseudonyms.pseudonymize(df),
    "token_counts": lambda spark, df: token_counts.count_tokens(df, __import__("public_tokenizers").path(token_counts.TOKENIZER), keep=df.columns),
} | {f"stage {name}": (lambda spark, df, f=f: f(spark, df, "/root/testdata/sf0.001")) for name, f in corpus_pipeline.STAGES[:-1]}


@pytest.mark.parametrize("name", KEEPERS)
def test_other_columns_pass_through(spark, odd, name):
    out = KEEPERS[name](spark, odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    if name.startswith("stage"):
        assert out.columns == odd.columns
    rows = out.collect()
    given = {tuple(r) for r in odd.drop("text").collect()}
    at = out.columns.index("text")
    assert {tuple(r)[:at] + tuple(r)[at + 1 : len(odd.columns)] for r in rows} <= given and rows
    assert KEEPERS[name](spark, odd.limit(0)).collect() == []


def test_results_of_repeated_rows(spark, odd):
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(near_dups.drop_near_duplicates(odd)) == Counter({1: 3, 2: 2, None: 0, 3: 1, 4: 1, 5: 0}) - Counter()
    assert ids(decontaminate.drop_contaminated(odd, bench(spark))) == Counter({2: 2, 3: 1, 4: 1})
    assert len(set(map(tuple, pseudonyms.pseudonymize(odd).where("doc_id = 1").drop("text").collect()))) == 1


def test_readers_of_other_tables(spark, odd):
    pages = odd.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "1 AS `a.b`", "2 AS sha", "3 AS mark", "4 AS __on0")
    got = warc.assemble(warc.read_archives(warc.write_archives(pages, warc.scratch(spark, "odd")), payloads=False)).agg({"n_responses": "sum"}).first()[0]
    assert got == len(ROWS)
    talk = odd.selectExpr("doc_id AS conv_id", "1 AS turn", "source AS role", "text", "1 AS `a.b`", "2 AS said", "3 AS conv", "4 AS n")
    assert chat.rotate(talk).count() == 6
    assert token_files.token_digest(odd).count() == len(ROWS)
    found = decontaminate.contamination(odd, bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1), (5, 1)}

"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token files.

Every stage works on all documents its predecessor kept, and every stage but the last returns the columns of
``documents``. Stages are separated by Parquet in the shared scratch folder, so a lost executor costs at most tasks of
one stage; what a stage has read is removed when the next one's input is written.

Edge cases, for every stage: null texts have no words and go with the quality rules; a null id or host is one of its
own; of documents that tie as near duplicates, the smallest id stays, and fully repeated rows stay or go together;
mixing draws by id, so rows of one id get as many copies each; very long texts are taken whole; an empty table runs
through all stages and gives an empty table; further columns, whatever their names, pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, host_rules, mixing, near_dups, token_files
from marginalia.llm.common import discard, table, written

NEAR_DUP_PCT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, on strict hosts the further rules too, and whose host is not bad."""
    return host_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of 80 % similarity connect."""
    return near_dups.drop_near_duplicates(docs, pct=NEAR_DUP_PCT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, substitutions included."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_digest(docs)


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokens)]

#: SQL can express neither the near duplicates nor the tokens; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs

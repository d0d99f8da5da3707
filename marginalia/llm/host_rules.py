"""Quality rules whose verdict on a document also depends on its host.

Per document, words are runs of characters other than space and TAB..CR. Base rules reject a document for too few
words or for repetition. Further rules (symbols, repeated lines) do not reject by themselves. Failures of any rule are
summed per host, and the rate of each host is shrunk towards all hosts' mean by a beta prior fitted to the hosts
(method of moments). A host whose shrunk rate is more than STRICT_MARGIN above the prior's mean gets the verdict
``strict``: its documents must pass the further rules too. One whose shrunk rate exceeds ``max_host_rate`` is ``bad``
and loses all its documents. So documents that break no rule are lost only with a host that is bad throughout.

Edge cases: a null text has no words; a null host is one host of its own; repeated rows count once each; hosts of equal
rates get equal verdicts; a very long text is taken whole, its windows as numbers; a table without rows gives a table
without rows; other columns pass through, whatever their names; one named like a column of the result gives way to it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import col, row, table, with_small, written
from marginalia.llm.workers import release

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
RESULT = [*(x.split()[0] for x in FEATURES.split(", ")), "base_failed", "kept"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 50, 50, 10, 30
MAX_HOST_RATE, STRICT_MARGIN = 0.9, 0.01
#: Words from which on windows are told apart by numpy, in a few bytes each.
LONG = 20_000


def _covered(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    if len(words) > LONG:
        return _covered_long(words)
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def _covered_long(words: list[bytes]) -> int:
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(words) - WINDOW + 1
    code = ids[:n]
    for k in range(1, WINDOW):
        code = np.unique(code, return_inverse=True)[1] * len(numbers) + ids[k : k + n]
    _, own, counts = np.unique(code, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= counts[own] > 1
    return int(covered.sum())


def text_features(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_bytes, n_symbols, n_dup_lines, n_repeat_words, n_lines of one UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split(None, 1)] if b"\n" in text else ([text] if words else [])
    return len(words), sum(map(len, words)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _covered(words), len(lines)


def _features(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    rows = [text_features(x.as_py()) for x in raw]
    n, word_bytes, *rest = (list(x) for x in zip(*rows)) if rows else ([],) * 6
    chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64()).to_pylist()
    sizes = pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64()).to_pylist()
    # what is not in a word is one byte and one code point each
    word_chars = [c - (s - w) for c, s, w in zip(chars, sizes, word_bytes)]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    out = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, word_chars, *rest)], names=names)
    release()
    return out


#: Column function from a text to a struct of FEATURES.
features = F.arrow_udf(_features, T.StructType([T.StructField(x.split()[0], T.LongType()) for x in FEATURES.split(", ")]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule, of those that count towards the host."""
    return base_failed() | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))


def host_verdicts(scored: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, the shrunk rate, strict and bad. scored has ``host`` and boolean ``__failed``."""
    hosts = written(scored.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("__failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    alpha, beta = beta_prior(m["mean"], m["var"], m["inv"])
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    strict = F.col("shrunk_rate") > alpha / (alpha + beta) * (1 + STRICT_MARGIN)
    return hosts.withColumn("shrunk_rate", shrunk).withColumns({"strict": strict, "bad": F.col("shrunk_rate") > max_host_rate})


def beta_prior(mean: float | None, var: float | None, inv: float | None) -> tuple[float, float]:
    """alpha, beta of a beta distribution with the hosts' mean rate, and their variance less what the binomial
    counts add to it (``inv``: the hosts' mean of 1/n). Bounded to a weight of 1 to 1000 documents."""
    if mean is None:
        return 1.0, 1.0
    spread = mean * (1 - mean)
    between = max(0.0, (var - spread * inv) / (1 - inv) if inv < 1 else 0.0)
    weight = min(1000.0, max(1.0, spread / between - 1 if between > 0 else 1000.0))
    return max(mean * weight, 1e-3), max((1 - mean) * weight, 1e-3)


def _judged(scored: DataFrame, max_host_rate: float) -> DataFrame:
    """scored (__host, base_failed, __failed and more) with kept. Only hosts with a verdict are joined."""
    hosts = host_verdicts(scored, "__host", max_host_rate).where("strict OR bad").select("__host", F.col("bad").alias("__bad"))
    kept = ~F.col("base_failed") & F.when(F.col("__bad"), F.lit(False)).when(F.col("__bad").isNotNull(), ~F.col("__failed")).otherwise(F.lit(True))
    return with_small(scored, hosts, ["__host"]).withColumn("__kept", kept)


def verdicts(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``keep`` columns of docs (default all) with the features, base_failed and kept. Features of all documents are
    written once without the texts; if ``keep`` holds the text, it is read again and not carried through a shuffle."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    inner = docs.select(F.struct(*[col(c).alias(c) for c in keep]).alias("__row"), col(host).alias("__host"), features(col(text)).alias("__f"))
    scored = inner.select("__row", "__host", "__f.*").withColumn("base_failed", base_failed()).withColumn("__failed", rule_failed())
    if text not in keep:
        scored = written(scored, "features")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return _judged(scored, max_host_rate).select("__row.*", *names, "base_failed", F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that verdicts() keeps, with their own columns only."""
    scored = docs.select(row(docs), col(host).alias("__host"), features(col(text)).alias("__f"))
    scored = scored.select("__row", "__host", "__f.*").withColumn("base_failed", base_failed()).withColumn("__failed", rule_failed())
    scored = written(scored.select("__row", "__host", "base_failed", "__failed"), "scored")
    return _judged(scored, max_host_rate).where("__kept").select("__row.*")


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w
), p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
b AS (
  SELECT f.doc_id, source, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM f LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words OR 100 * n_symbols > {MAX_SYMBOL_PCT} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines AS failed
  FROM b
), h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM v GROUP BY source),
m AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS var, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, mean * (1 - mean) AS spread, CASE WHEN inv < 1 THEN greatest(0, (var - mean * (1 - mean) * inv) / (1 - inv)) ELSE 0 END AS btw FROM m),
u AS (SELECT mean, least(1000, greatest(1, CASE WHEN btw > 0 THEN spread / btw - 1 ELSE 1000 END)) AS wt FROM q),
z AS (SELECT h.source, greatest(mean * wt, 0.001) AS alpha, greatest((1 - mean) * wt, 0.001) AS beta, (k + alpha) / (n + alpha + beta) AS rate FROM h, u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT z.rate > {MAX_HOST_RATE} AND NOT (failed AND z.rate > alpha / (alpha + beta) * (1 + {STRICT_MARGIN})) AS kept
FROM v JOIN z ON v.source IS NOT DISTINCT FROM z.source
"""

"""Cross-site boilerplate by the number of distinct sites that show a line.

Each line with a word is known by a 128-bit hash. Sketches of its sites (HyperLogLog) are aggregated per line, first
within tasks and then across; a line whose estimate is clearly below or above ``min_sites`` is decided by it, and lines
near the threshold get an exact count of distinct sites. Lines on min_sites or more sites are removed everywhere.

Texts are not shuffled if the documents with such lines are few enough for a broadcast; beyond that, only those that
may have one are.

Edge cases: a null text stays null; a null site is one site; lines without a word are never counted or removed; a line
on exactly min_sites sites is removed; documents that repeat an id keep each its own text, and fully repeated rows are
treated alike; a very long text is split into its lines, and a very long line is one hash; further columns pass
through, whatever their names (one named n_lines or n_removed gives way); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import col, row, table, with_small, written

MIN_SITES = 5
#: log2 of a sketch's registers (a relative error of 1.04 / 32), and the band around the threshold that is counted.
LG_K, BAND = 10, 0.25
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    rows = docs.select(*more, F.posexplode(F.split(col(text), "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(_HAS_WORD))
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("line"), "line")).drop("line")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on min_sites or more sites."""
    lines = _lines(docs, text, F.coalesce(F.concat(F.lit("="), col(site).cast("string")), F.lit("")).alias("site"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("h1", "h2", F.lit(True).alias("near"))
    pairs = with_small(lines.select("h1", "h2", "site"), near, ["h1", "h2"], "inner").groupBy("h1", "h2", "site").agg(F.first("near").alias("near"))
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without those lines, with n_lines (with a word, before) and n_removed."""
    bad = written(boilerplate(docs, site, text, min_sites), "boilerplate").withColumn("bad", F.lit(True))
    rows = docs.drop(*[c for c in docs.columns if c in ("n_lines", "n_removed")])
    key = F.struct(col(doc_id).alias("id"), F.xxhash64(col(text)).alias("hash")).alias("at")
    hits = with_small(_lines(docs, text, key), bad, ["h1", "h2"], "inner").groupBy("at").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    left = rows.select(row(rows), col(text).alias("__text"), key)
    out = with_small(left, written(hits, "hits"), ["at"], salts=1, sieve=True)
    lines = F.split("__text", "\n", -1)
    # the removed lines are in order: what stands between one and the next stays
    borders = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice(lines, F.element_at(borders, i) + 2, F.element_at(borders, i + 1) - F.element_at(borders, i) - 1))
    kept = F.array_join(F.flatten(between), "\n")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(_HAS_WORD))), F.lit(0))
    shown = [F.when(F.col("gone").isNull(), F.col("__text")).otherwise(kept).alias(c) if c == text else F.col("__row")[c].alias(c) for c in rows.columns]
    return out.select(*shown, F.when(F.col("__text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def op8_line_spread(spark, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_removed")


OP8_SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
b AS (SELECT line FROM w WHERE word GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES}),
g AS (SELECT doc_id, string_agg(w.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL) AS text, count(*) FILTER (word) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_removed
  FROM w LEFT JOIN b ON w.line = b.line GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN g USING (doc_id)
"""

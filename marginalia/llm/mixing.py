"""Mixing sources to target weights: every source gets a word budget, every document whole copies of itself.

``share`` of all words is dealt to the sources by weight; a target stops at ``max_rate`` times its source's size and
the excess goes to the others by weight until none is above (computed in closed form: sources in the order of
cap/weight, the water level from running sums). A document is emitted floor(rate) times, and once more if a hash of
the seed and its id falls below the fraction, so reruns and retried tasks agree.

Edge cases: null text has size 0; null is a source of its own and comes last; a null id hashes as the word null;
rows with one id share one draw, as do fully repeated rows; sources of equal cap by weight come in the order of their
names; a very long text counts its words and draws like any other, so its source misses the target by up to its size;
a source of size 0 has target 0 and its documents are not emitted; an empty table gives an empty table; further
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, col, row, table, with_small, written

WEIGHTS = (3, 1, 2)
SHARE_PCT = 150
MAX_RATE = 2
SEED = "mix-1"
SCALE = float(1 << 52)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights=WEIGHTS, share_pct: int = SHARE_PCT, max_rate: int = MAX_RATE) -> DataFrame:
    """sizes: one row per source with ``source_size``. Adds target (double) and rate. The windows run over one row
    per source, which the aggregation before has made of all documents."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(max_rate).cast("long") * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weights", F.sum("weight").over(everything))
    s = s.withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap")).withColumn("weights_left", F.col("all_weights") - F.sum("weight").over(by_ratio) + F.col("weight"))
    level = (F.col("total") * share_pct / 100.0 - F.col("caps_before")) / F.col("weights_left")
    s = s.withColumn("__level", F.when(level <= F.col("cap") / F.col("weight"), level))
    # the first source whose cap is not reached sets the level, which is also the largest of those that fit
    s = s.withColumn("__level", F.max("__level").over(everything))
    target = F.when(F.col("__level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("__level") * F.col("weight")))
    return s.select(source, "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(doc_id: str, seed: str = SEED) -> Column:
    """Uniform in [0, 1), from the seed and the id alone."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / SCALE


def copies(doc_id: str, rate: str = "rate", seed: str = SEED) -> Column:
    whole = F.floor(F.col(rate))
    return (whole + (draw(doc_id, seed) < F.col(rate) - whole).cast("long")).cast("long")


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """Per document: id, source, size, source_size, target, rate, copies, taken. Texts are read once, for their sizes."""
    sizes = written(docs.select(col(doc_id).alias("doc_id"), col(source).alias("__source"), n_words(text).alias("size")), "sizes")
    by_source = targets(sizes.groupBy("__source").agg(F.sum("size").alias("source_size")), "__source", **how)
    out = with_small(sizes, written(by_source, "targets"), ["__source"])
    return out.withColumn("copies", copies("doc_id")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """docs with every row emitted as often as the plan says (columns unchanged). Two scans and no shuffle of texts."""
    sizes = docs.select(col(source).alias("__source"), n_words(text).alias("size")).groupBy("__source").agg(F.sum("size").alias("source_size"))
    rates = written(targets(sizes, "__source", **how), "targets").select("__source", "rate")
    rows = docs.select(row(docs), col(source).alias("__source"), col(doc_id).alias("__id"))
    rows = with_small(rows, rates, ["__source"]).withColumn("__n", copies("__id").cast("int")).where(F.col("__n") > 0)
    return rows.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {MAX_RATE} * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, sum(cap) OVER o - cap AS before, sum(weight) OVER () - sum(weight) OVER o + weight AS wleft, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(CASE WHEN (total * {SHARE_PCT} / 100.0::DOUBLE - before) / wleft <= cap / weight THEN (total * {SHARE_PCT} / 100.0::DOUBLE - before) / wleft END) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM w, l),
c AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {SCALE:.1f}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

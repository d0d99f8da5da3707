"""Benchmark decontamination by spaced seeds, in SQL functions alone.

Words are runs of letters and digits in lower case, known by 64-bit hashes. Each mask fixes some offsets of a window
and ignores the others; the hash of the fixed words at every position of every document meets the same hashes of the
benchmark. A hit gives a diagonal (the offset between document and item), and up to FLANK words to either side of the
window are compared on it: with at least MIN_WORDS words compared and 0.8 of them equal, the overlap stands,
substitutions and all. If they do not stand as a whole, as where the document has only part of an item, the best of
their stretches of MIN_WORDS words or more with 0.8 equal does.

Documents are scanned once, whatever the size of the benchmark. Its seeds, each once however many items share it, are
broadcast if they are few enough; beyond that positions go through a bitmap of bounded size first, and only those that
may have a seed are shuffled, with the few words around them, salted.

Edge cases: null texts have no words; items shorter than MIN_WORDS words count as a whole, and those shorter than the
shortest mask's window, which are too few words to tell, match nothing (``short_items`` lists them); of stretches that
tie, the shortest and then the first counts; a null id is an id like any other; rows that repeat an id are searched
each and reported together; a very long text is a row for each of its positions with a few numbers each, as is any
other; further columns pass through, whatever their names; an empty table on either side gives no overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import col, fits_broadcast, row, sieved, table, with_small, written

#: 1: the word counts, 0: it is ignored. No run of ones is longer than three words.
MASKS = ("110110101", "1011100101", "11010001011")
FLANK, MIN_WORDS, MIN_SIMILARITY = 8, 13, 0.8
WORDS = r"[\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(col(text)), F.lit(WORDS), 0), lambda w: F.xxhash64(w))


def short_items(benchmark: DataFrame, item_text: str = "text") -> DataFrame:
    """The items (all columns) that have too few words to be found."""
    return benchmark.where(F.coalesce(F.size(words(item_text)), F.lit(0)) < min(map(len, MASKS)))


def _hashes(tokens: Column, at: Column) -> Column:
    """Array of the hashes of all masks at a position (from 0); null where a window does not fit."""
    made = []
    for m, mask in enumerate(MASKS):
        fixed = [F.get(tokens, at + i) for i, c in enumerate(mask) if c == "1"]
        made.append(F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(m), *fixed)))
    return F.array(*made)


def _positions(tokens: Column) -> Column:
    shortest = min(map(len, MASKS))
    return F.explode(F.when(F.size(tokens) >= shortest, F.sequence(F.lit(0), F.size(tokens) - shortest)))


def _best_part(equal: Column, need: Column, min_similarity: float) -> Column:
    """struct(matched, first, length) of the stretch with the most equal words of those with ``need`` words or more and
    min_similarity of them equal, the shortest and then the first of several; null without one."""
    sums = F.aggregate(equal, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def stretches(c: Column) -> Column:
        last = F.size(c) - 1
        ends = lambda a: F.transform(F.sequence(a + need, last), lambda z: F.struct((c[z] - c[a]).alias("m"), (a - z).alias("l"), (-a).alias("f")))
        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), last - need), ends)), lambda x: x["m"] >= -min_similarity * x["l"])

    best = F.array_max(F.transform(F.array(sums), stretches)[0])
    made = lambda x: F.struct(x["m"].alias("matched"), (-x["f"]).alias("first"), (-x["l"]).alias("length"))
    return F.transform(F.filter(F.array(best), lambda x: x.isNotNull()), made)[0]


def seeds_of(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct seeds (seed, hash, back, need, item: the words around the window), and seed with item_id."""
    items = benchmark.select(col(item_id).alias("item_id"), words(item_text).alias("item"))
    rows = items.select("item_id", "item", _positions(F.col("item")).alias("q"))
    rows = rows.select("item_id", "item", "q", F.posexplode(_hashes(F.col("item"), F.col("q"))).alias("mask", "hash")).where("hash IS NOT NULL")
    lo = F.greatest(F.col("q") - FLANK, F.lit(0))
    hi = F.least(F.size("item"), F.col("q") + F.element_at(F.array(*[F.lit(len(m)) for m in MASKS]), F.col("mask") + 1) + FLANK)
    rows = rows.select("hash", "item_id", (F.col("q") - lo).alias("back"), F.least(F.size("item"), F.lit(MIN_WORDS)).alias("need"), F.slice("item", lo + 1, hi - lo).alias("item"))
    rows = written(rows.select(F.xxhash64("hash", "back", "need", "item").alias("seed"), "*"), "seeds")
    return written(rows.drop("item_id").dropDuplicates(["seed"]), "seeds"), rows.select("seed", "item_id").distinct()


def overlaps(docs: DataFrame, seeds: DataFrame, doc_key: list[Column], doc_text: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The columns doc_key with seed, start and length (words) of the compared stretch in the document,
    and matched words: every stretch found, once for each hit."""
    names = [f"__k{i}" for i in range(len(doc_key))]
    rows = docs.select(*[k.alias(n) for n, k in zip(names, doc_key)], words(doc_text).alias("w"))
    rows = rows.select("*", _positions(F.col("w")).alias("p"))
    rows = rows.select("*", F.explode(_hashes(F.col("w"), F.col("p"))).alias("hash"))
    # of the document, a hit needs only the words around its window
    first = F.greatest(F.col("p") - FLANK, F.lit(0))
    near = lambda d, *more: d.select(*names, *more, "hash", "p", first.alias("first"), F.slice("w", first + 1, F.lit(max(map(len, MASKS)) + 2 * FLANK)).alias("w"))
    if fits_broadcast(seeds):
        hits = near(rows.join(F.broadcast(seeds.withColumnRenamed("hash", "seed_hash")), F.col("hash") == F.col("seed_hash")), "seed", "back", "need", "item")
    else:
        maybe = sieved(rows, [F.col("hash")], seeds, [F.col("hash")]).where("__maybe")
        hits = with_small(written(near(maybe), "maybe"), seeds, ["hash"], "inner")
    start = F.col("p") - F.col("back")
    # words of the stretch that lie before the document's first or after its last are not compared
    skip = F.greatest(-start, F.lit(0)).cast("int")
    n = F.least(F.size("item"), F.col("first") + F.size("w") - start).cast("int") - skip
    hits = hits.select(*names, "seed", (start + skip).alias("start"), n.alias("length"), "need", F.slice("w", (start + skip - F.col("first") + 1).cast("int"), n).alias("a"), F.slice("item", skip + 1, n).alias("b"))
    # written, so that the comparison is not pulled into the join, where it would end the generated code and
    # make a row with all words of the document for every position
    hits = written(hits.where(F.col("length") >= F.col("need")), "hits")
    out = hits.withColumn("equal", F.zip_with("a", "b", lambda x, y: (x == y).cast("int"))).drop("a", "b")
    out = out.withColumn("matched", F.aggregate("equal", F.lit(0), lambda s, x: s + x))
    whole = F.col("matched") >= min_similarity * F.col("length")
    # no stretch within has more equal words than the whole
    part = F.when(~whole & (F.col("matched") >= min_similarity * F.col("need")), _best_part(F.col("equal"), F.col("need"), min_similarity))
    out = out.withColumn("part", part).where(whole | F.col("part").isNotNull())
    at = {"start": F.col("start") + F.coalesce(F.col("part.first"), F.lit(0)), "length": F.coalesce(F.col("part.length"), "length"), "matched": F.coalesce(F.col("part.matched"), "matched")}
    return out.withColumns(at).drop("equal", "part", "need")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", **how) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_places (distinct starts of stretches), and
    matched and length of the best stretch."""
    seeds, items = seeds_of(benchmark, item_id, item_text)
    found = overlaps(docs, seeds, [col(doc_id)], doc_text, **how)
    best = F.max(F.struct(F.col("matched").alias("m"), (-F.col("length")).alias("l"))).alias("best")
    # what a seed has found is summed up before its items, which may be many, come in
    found = found.groupBy("__k0", "seed", "start").agg(best).join(items, "seed")
    out = found.groupBy(F.col("__k0").alias("doc_id"), "item_id").agg(F.count_distinct("start").alias("n_places"), F.max("best").alias("best"))
    return out.select("doc_id", "item_id", "n_places", F.col("best.m").cast("long").alias("matched"), (-F.col("best.l")).cast("long").alias("length"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """The documents (all columns) without an overlap. Rows are known by id and a hash of the text."""
    key = F.struct(col(doc_id).alias("id"), F.xxhash64(col(text)).alias("hash"))
    found = overlaps(docs, seeds_of(benchmark, item_id, item_text)[0], [key], text, **how)
    bad = written(found.select(F.col("__k0").alias("at")).distinct(), "contaminated")
    return with_small(docs.select(row(docs), key.alias("at")), bad, ["at"], "left_anti", salts=1, sieve=True).select("__row.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    keys = []
    for m, mask in enumerate(MASKS):
        fixed = " || ' ' || ".join(f"w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
        keys.append(f"SELECT id, p, {m} AS mask, {len(mask)} AS span, {fixed} AS k, w FROM pos_of WHERE p + {len(mask)} <= len(w)")

    def seeds(rows: str) -> str:
        return " UNION ALL ".join(k.replace("pos_of", rows) for k in keys)

    return rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
dp AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM d), ip AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM i),
ds AS ({seeds("dp")}), ins AS ({seeds("ip")}),
h AS (SELECT ds.id AS doc_id, ins.id AS item_id, ds.p AS p, ins.p AS q, ds.span, ds.w AS dw, ins.w AS iw FROM ds JOIN ins ON ds.mask = ins.mask AND ds.k = ins.k),
r AS (SELECT *, least(len(iw), {MIN_WORDS}) AS need, greatest(q - {FLANK}, 0, q - p) AS lo, least(len(iw), q + span + {FLANK}, len(dw) - p + q) AS hi FROM h),
c AS (SELECT DISTINCT doc_id, item_id, need, p - q + lo AS start, list_transform(range(lo, hi), lambda x: (dw[p - q + x + 1] = iw[x + 1])::INT) AS eq FROM r WHERE hi - lo >= need),
m AS (SELECT *, list_sum(eq) AS matched, len(eq) AS length FROM c),
a AS (SELECT *, unnest(range(0, length - need + 1)) AS first FROM m WHERE matched < {MIN_SIMILARITY} * length AND matched >= {MIN_SIMILARITY} * need),
z AS (SELECT *, unnest(range(need, length - first + 1)) AS size FROM a),
s AS (SELECT *, list_sum(eq[first + 1 : first + size]) AS m FROM z),
b AS (SELECT doc_id, item_id, start, eq, need, arg_max({{'first': first, 'size': size, 'm': m}}, [m, -size, -first]) AS x FROM s WHERE m >= {MIN_SIMILARITY} * size GROUP BY ALL),
v AS (SELECT doc_id, item_id, start, length, matched FROM m WHERE matched >= {MIN_SIMILARITY} * length
  UNION ALL SELECT doc_id, item_id, start + x.first, x.size, x.m FROM b)
SELECT doc_id, item_id, count(DISTINCT start) AS n_places, max(matched)::BIGINT AS matched, (arg_min(length, -matched * 1000 + length))::BIGINT AS length
FROM v GROUP BY doc_id, item_id
"""


OP7_SQL = _sql()

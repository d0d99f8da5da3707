"""Matching, ranking and reading of scores over a source of postings.

A query costs one pass over the postings of its terms: document frequencies and the corpus' few sums are read first
(a row per term and field, never more than a query's terms), then every posting meets the query's small table of weights by
a broadcast join and contributions are summed per document, combined before the shuffle. Only documents with a hit
take part.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.errors import SearchError
from marginalia.functions.scoring import idf, term_score
from marginalia.plans import query as Q
from marginalia.sources.postings import Postings, chosen

MAX_PHRASE = 64


@dataclass
class Ranking:
    """Parameters that may change from query to query; those by field take precedence."""

    k1: float = 1.2
    b: float = 0.75
    boosts: dict[str, float] = field(default_factory=dict)
    k1_of: dict[str, float] = field(default_factory=dict)
    b_of: dict[str, float] = field(default_factory=dict)
    phrase_fallback: str = "error"
    #: More terms than this that match a wildcard are an error; None: all of them take part.
    max_expansions: int | None = None

    def __post_init__(self):
        for v in (self.k1, *self.k1_of.values()):
            if not 0 <= v <= 1e30:
                raise SearchError("k1 is out of range")
        for v in (self.b, *self.b_of.values()):
            if not 0 <= v <= 1:
                raise SearchError("b is out of range")
        for v in self.boosts.values():
            if not 0 <= v <= 1e6:
                raise SearchError("boost is out of range")
        if self.phrase_fallback not in ("error", "and"):
            raise SearchError("phrase_fallback is error or and")

    def check(self, fields: list[str]) -> Ranking:
        """Warn of options for fields that are none."""
        for name in dict.fromkeys([*self.boosts, *self.k1_of, *self.b_of]):
            if name not in fields:
                warnings.warn(f'an option names "{name}", which is no field', stacklevel=3)
        return self


def _how(source: Postings, how: Ranking | None) -> Ranking:
    """The query's options, or those that the source has of its own."""
    return (how or Ranking(**source.options)).check(source.fields)


def expand(source: Postings, pattern: str, limit: int = Q.MAX_EXPANSIONS) -> list[str]:
    """Terms of the dictionary that a pattern with * matches; more than limit are an error."""
    head, *_ = pattern.split("*")
    rows = source.vocabulary(head).where(chosen(F.col("term"), [], (pattern,))).limit(limit + 1).collect()
    if len(rows) > limit:
        raise SearchError(f"wildcard pattern matches more than {limit} terms", "54000")
    return sorted(r.term for r in rows)


def resolved(source: Postings, tree, how: Ranking) -> list[Q.Bit]:
    bits = Q.flatten(tree)
    for x in bits:
        if x.leaf.kind == "wildcard":
            if how.max_expansions is not None:
                expand(source, x.leaf.text, how.max_expansions)
            continue
        x.terms = source.analyzer.of(x.leaf.text)
        if x.leaf.kind == "term" and len(x.terms) > 1:
            raise SearchError(f"a term query is one term, not {len(x.terms)}")
        if x.leaf.kind == "phrase":
            if len(x.terms) > MAX_PHRASE:
                raise SearchError(f"a phrase has at most {MAX_PHRASE} words", "54000")
            if not source.store_positions and len(x.terms) > 1 and how.phrase_fallback == "error":
                raise SearchError("the index stores no positions for phrases", "55000")
    return bits


def _near(slots: list[str], at, x: Q.Bit) -> Column:
    """Whether the terms stand in one field within the span. at: term -> its positions there."""
    n = len(slots)
    reach = n - 1 + x.leaf.slop
    if x.leaf.ordered:
        # from each first position on, every word takes the earliest place after the one before
        rest = F.array(*[at(t) for t in slots[1:]])
        walk = lambda p: F.aggregate(rest, p, lambda last, places: F.array_min(F.filter(places, lambda q: q > last)))
        return F.coalesce(F.exists(at(slots[0]), lambda p: F.coalesce(walk(p) - p <= reach, F.lit(False))), F.lit(False))
    times = {t: slots.count(t) for t in slots}
    found = F.lit(False)
    for first in times:
        inside = lambda p: _all([F.size(F.filter(at(t), lambda q: (q >= p) & (q <= p + reach))) >= m for t, m in times.items()])  # noqa: B023, E731
        found = found | F.coalesce(F.exists(at(first), inside), F.lit(False))
    return found


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _weights(source: Postings, entries: list[tuple], found: DataFrame, how: Ranking) -> list[tuple]:
    """For each (label, term, field or None, weight): rows of label, term, field number, weight times boost and idf,
    average length, k1, b, for the fields that have the term. found: postings, or impacts that count them."""
    n = F.sum("n") if "n" in found.columns else F.count(F.lit(1))
    df = {(r.term, r.field_id): r.n for r in found.groupBy("term", "field_id").agg(n.alias("n")).collect()}
    out = []
    for label, t, scope, weight in entries:
        for f, name in enumerate(source.fields):
            if (t, f) in df and scope in (None, name):
                n_docs, average = source.field_stats[f]
                out.append((label, t, f, weight * how.boosts.get(name, 1.0) * idf(n_docs, df[t, f]), float(average), float(how.k1_of.get(name, how.k1)), float(how.b_of.get(name, how.b))))
    return out


WEIGHTS = "w_term string, w_field int, weight double, average double, k1 double, b double"


def _on() -> Column:
    return (F.col("term") == F.col("w_term")) & (F.col("field_id") == F.col("w_field"))


def _value(tf: str = "tf", dl: str = "dl") -> Column:
    return term_score(F.col("weight"), F.col(tf), F.col(dl), F.col("average"), F.col("k1"), F.col("b"))


def _asked(bits: list[Q.Bit]) -> tuple[list[str], tuple[str, ...]]:
    """The terms and the wildcard patterns of a query."""
    return list(dict.fromkeys(t for x in bits for t in x.terms)), tuple(dict.fromkeys(x.leaf.text for x in bits if x.leaf.kind == "wildcard"))


def _prefetch(source: Postings, *queries) -> None:
    """What several queries read comes in one pass."""
    if len(queries) < 2:
        return
    bits = [x for q in queries for x in Q.flatten(Q.parse(q, source.fields))]
    for x in bits:
        x.terms = [] if x.leaf.kind == "wildcard" else source.analyzer.of(x.leaf.text)
    source.prefetch(*_asked(bits))


def _wide(source: Postings, bits: list[Q.Bit], found: DataFrame, how: Ranking | None) -> DataFrame | None:
    """The table of weights of the terms that wildcards match, be they as many as they may; without how, of the terms
    alone."""
    bits = [x for x in bits if x.leaf.kind == "wildcard"]
    if not bits:
        return None
    matched = F.filter(F.array(*[F.when(chosen(F.col("term"), [], (x.leaf.text,)) & (F.lit(True) if x.leaf.field is None else F.col("field_id") == source.fields.index(x.leaf.field)), F.struct(F.lit(x.bit).alias("bit"), F.lit(x.flag).cast("long").alias("flag"), F.lit(0.0 if x.negated else float(x.boost)).alias("by"))) for x in bits]), lambda x: x.isNotNull())
    terms = found.groupBy("term", "field_id").agg(F.count(F.lit(1)).alias("df")).select(F.col("term").alias("w_term"), F.col("field_id").alias("w_field"), "df", F.inline(matched))
    if how is None:
        return terms.select("w_term", "w_field", "bit", "flag")
    of = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("w_field")]
    n_docs = of(n for n, _ in source.field_stats)
    df = F.least("df", n_docs)
    weight = F.col("by") * of(how.boosts.get(name, 1.0) for name in source.fields) * F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return terms.select("bit", "w_term", "w_field", weight.alias("weight"), of(a for _, a in source.field_stats).alias("average"), of(how.k1_of.get(name, how.k1) for name in source.fields).alias("k1"), of(how.b_of.get(name, how.b) for name in source.fields).alias("b"), "flag")


def _nothing(source: Postings, more: str = "") -> DataFrame:
    return SparkSession.active().createDataFrame([], f"doc_id {source.key_type}{more}")


def _evaluated(source: Postings, tree, bits: list[Q.Bit], found: DataFrame, table: DataFrame, wide: DataFrame | None, score: Column | None) -> DataFrame:
    """Documents whose hits fulfil the tree, with their score if asked for. table: w_term, w_field, bit and flag of the
    terms asked for; those of wildcards, which have no bound, come by a join of their own."""
    phrases = [x for x in bits if x.leaf.kind == "phrase" and len(x.terms) > 1]
    exact = [x for x in phrases if source.store_positions]
    kept = found if exact else found.drop("positions")
    hits = [kept.join(F.broadcast(table), _on())] * any(x.terms for x in bits) + [kept.join(t, _on()) for t in [wide] if t is not None]
    hits = reduce(DataFrame.unionByName, hits)
    # words of a phrase without positions must all be there
    more = [F.count_distinct(F.when(F.col("bit") == x.bit, F.col("term"))).alias(f"n{x.bit}") for x in phrases if x not in exact]
    where = {(t, f): f"p{i}" for i, (t, f) in enumerate(dict.fromkeys((t, f) for x in exact for t in x.terms for f in range(len(source.fields)) if x.leaf.field in (None, source.fields[f])))}
    more += [F.first(F.when((F.col("term") == t) & (F.col("field_id") == f), F.col("positions")), ignorenulls=True).alias(c) for (t, f), c in where.items()]
    scores = [] if score is None else [score.alias("score")]
    docs = hits.groupBy("doc_id").agg(F.bit_or("flag").alias("flags"), *scores, *more)
    conditions = []
    for x in bits:
        c = F.col("flags").bitwiseAND(F.lit(x.flag).cast("long")) != 0
        if x in exact:
            c = F.lit(False)
            for f, name in enumerate(source.fields):
                if x.leaf.field in (None, name):
                    c = c | _near(x.terms, lambda t, f=f: F.coalesce(F.col(where[t, f]), F.array().cast("array<int>")), x)
        elif x in phrases:
            c = F.col(f"n{x.bit}") == len(set(x.terms))
        conditions.append(c)
    # a document that no leaf but an excluding one has hit is no match
    some = F.col("flags").bitwiseAND(F.lit(sum(x.flag for x in bits if not x.negated)).cast("long")) != 0
    return docs.where(Q.formula(tree, conditions) & some).select("doc_id", *["score"] * bool(scores))


def ranked(source: Postings, query, how: Ranking | None = None) -> DataFrame:
    """doc_id and score of every document that matches the query, in no order."""
    how = _how(source, how)
    tree = Q.parse(query, source.fields)
    bits = resolved(source, tree, how)
    terms, patterns = _asked(bits)
    if not terms and not patterns:
        return _nothing(source, ", score double")
    found = source.postings(terms, patterns)
    flags = {x.bit: x.flag for x in bits}
    rows = _weights(source, [(x.bit, t, x.leaf.field, 0.0 if x.negated else x.boost) for x in bits for t in x.terms], found, how) if terms else []
    if not rows and not patterns:
        return _nothing(source, ", score double")
    table = found.sparkSession.createDataFrame([(*r, flags[r[0]]) for r in rows], f"bit int, {WEIGHTS}, flag long")
    negated = [x.bit for x in bits if x.negated]
    return _evaluated(source, tree, bits, found, table, _wide(source, bits, found, how), F.sum(F.when(~F.col("bit").isin(negated), _value()) if negated else _value()))


def _matched(source: Postings, query) -> DataFrame:
    """Ids of the documents that match one query: no statistics are read and nothing is scored."""
    tree = Q.parse(query, source.fields)
    bits = resolved(source, tree, Ranking(**source.options))
    terms, patterns = _asked(bits)
    if not terms and not patterns:
        return _nothing(source)
    found = source.postings(terms, patterns)
    if isinstance(tree, Q.Leaf) and (tree.kind != "phrase" or len(bits[0].terms) < 2):
        rows = found if tree.field is None else found.where(F.col("field_id") == source.fields.index(tree.field))
        return rows.select("doc_id").distinct()
    rows = [(t, f, x.bit, x.flag) for x in bits for t in x.terms for f, name in enumerate(source.fields) if x.leaf.field in (None, name)]
    return _evaluated(source, tree, bits, found, found.sparkSession.createDataFrame(rows, "w_term string, w_field int, bit int, flag long"), _wide(source, bits, found, None), None)


def matching(source: Postings, *queries) -> DataFrame:
    """doc_ids that match every query. A null query matches nothing."""
    out = None
    for q in queries:
        one = _matched(source, q) if q is not None else _nothing(source)
        out = one if out is None else out.join(one, "doc_id", "left_semi")
    return out


def top(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """By score, then id; without a score last. With a limit, each task keeps its best and only those meet."""
    rows = rows.orderBy(F.desc_nulls_last("score"), F.asc("doc_id"))
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def search(source: Postings, order_by, where=None, limit: int | None = None, offset: int = 0, how: Ranking | None = None, after: tuple | None = None) -> DataFrame:
    """doc_id, score, distance in the order of the ranking. With ``where`` (a query or several), its matches are the
    result, and those that order_by does not match come last with a null score and infinite distance. ``after``
    continues behind a score (null for those without) and id already shown."""
    filters = [] if where is None else list(where) if isinstance(where, (list, tuple)) else [where]
    same = filters == [order_by]
    _prefetch(source, *[q for q in (order_by, *filters) if q is not None])
    rows = ranked(source, order_by, how) if order_by is not None else None
    if filters and not same:
        kept = matching(source, *filters)
        rows = kept.join(rows, "doc_id", "left") if rows is not None else kept.withColumn("score", F.lit(None).cast("double"))
    if rows is None:
        rows = source.lengths().select("doc_id", F.lit(None).cast("double").alias("score"))
    if after is not None:
        score, last = after
        unscored = F.col("score").isNull()
        later = F.col("doc_id") > last
        rows = rows.where(unscored & later if score is None else unscored | (F.col("score") < score) | (F.col("score") == score) & later)
    return top(rows.withColumn("distance", F.coalesce(-F.col("score"), F.lit(float("inf")))), limit, offset)


def append_top(sources: list[Postings], query, limit: int | None = None, how: Ranking | None = None) -> DataFrame:
    """source (number), doc_id, score: one ranking over several indexes, each scored by statistics of its own."""
    rows = [ranked(x, query, how).select(F.lit(i).alias("source"), "doc_id", "score") for i, x in enumerate(sources)]
    out = reduce(DataFrame.unionByName, rows).orderBy(F.desc("score"), "source", "doc_id")
    return out if limit is None else out.limit(limit)


def matches_text(text: Column, query, analyzer) -> Column:
    """The match as a plain filter, without an index: whether a text shares a term with a query of words."""
    if not isinstance(query, str) or Q.is_json(query):
        raise SearchError("a query tree needs an index", "0A000")
    if query.strip().startswith('"'):
        raise SearchError("a phrase needs an index", "0A000")
    if (m := Q._SCOPE.match(query)) is not None:
        if query[m.end(1) + 1 :].strip().startswith('"'):
            raise SearchError("a phrase needs an index", "0A000")
        raise SearchError(f'a query scoped to "{m[1]}" needs an index', "0A000")
    terms = analyzer.of(query)
    return F.coalesce(F.arrays_overlap(analyzer.terms(text), F.array(*[F.lit(t) for t in terms]).cast("array<string>")), F.lit(False)) if terms else F.lit(False)


def score_by_key(keys: DataFrame, key: str, doc_id: str, *rankings: DataFrame) -> DataFrame:
    """keys (doc_id and a key) with the score of each key in one ranking or several: null where the documents of one
    key, or the rankings, differ in theirs."""
    rows = reduce(DataFrame.unionByName, [r.select("doc_id", "score") for r in rankings])
    scored = keys.select(F.col(doc_id).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.col(key).alias("key")).join(rows, "doc_id")
    return scored.groupBy("key").agg(F.when(F.min("score") == F.max("score"), F.max("score")).alias("score"))


def batch(source: Postings, queries: dict[int, str], k: int, how: Ranking | None = None) -> DataFrame:
    """qid, rank, doc_id, score: the best k of each of many queries. Those of words take one pass over the postings of
    all; phrases and trees, which are conditions besides, take one each."""
    how = _how(source, how)
    trees = {qid: Q.parse(q, source.fields) for qid, q in queries.items()}
    words = {qid: t for qid, t in trees.items() if isinstance(t, Q.Leaf) and t.kind == "match"}
    _prefetch(source, *trees.values())
    entries = [(qid, t, leaf.field, 1.0) for qid, leaf in words.items() for t in source.analyzer.of(leaf.text)]
    parts = [ranked(source, t, how).select(F.lit(qid).cast("long").alias("qid"), "doc_id", "score") for qid, t in trees.items() if qid not in words]
    if entries:
        found = source.postings(list(dict.fromkeys(t for _, t, *_ in entries))).drop("positions")
        table = found.sparkSession.createDataFrame(_weights(source, entries, found, how), f"qid long, {WEIGHTS}")
        parts.append(found.join(F.broadcast(table), _on()).groupBy("qid", "doc_id").agg(F.sum(_value()).alias("score")))
    scored = reduce(DataFrame.unionByName, parts or [_nothing(source, ", qid long, score double")])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def block_impacts(source: Postings, terms: list[str] | None = None) -> DataFrame:
    """term, field_id, block, n, max_tf, min_dl: what bounds the scores in a block from above. An index stores them."""
    return source.impacts(terms)


def pruned_top(source: Postings, words: str, k: int, how: Ranking | None = None) -> DataFrame:
    """The same rows as top(ranked(words), k), from those blocks alone whose bound reaches the k-th score of the
    blocks with the best bounds. Bounds come from the stored impacts; postings are read of the chosen blocks only."""
    how = _how(source, how)
    leaf = Q.parse(words, source.fields)
    if not isinstance(leaf, Q.Leaf) or leaf.kind != "match":
        raise SearchError("pruning is for queries of words", "0A000")
    terms = list(dict.fromkeys(source.analyzer.of(leaf.text)))
    if not terms:
        return top(_nothing(source, ", score double"), k)
    impacts = source.impacts(terms)
    # stored impacts count deleted documents too
    rows = _weights(source, [(0, t, leaf.field, 1.0) for t in source.analyzer.of(leaf.text)], impacts if source.counts_live else source.postings(terms), how)
    if not rows:
        return top(_nothing(source, ", score double"), k)
    table = impacts.sparkSession.createDataFrame(rows, f"label int, {WEIGHTS}").groupBy("w_term", "w_field", "average", "k1", "b").agg(F.sum("weight").alias("weight"))
    bounds = impacts.join(F.broadcast(table), _on()).groupBy("block").agg(F.sum(_value("max_tf", "min_dl")).alias("bound"))
    scored = lambda blocks: source.in_blocks(terms, blocks).join(F.broadcast(table), _on()).groupBy("doc_id").agg(F.sum(_value()).alias("score"))
    best = top(scored(bounds.orderBy(F.desc("bound"), "block").limit(k).select("block")), k).collect()
    floor = best[-1].score if len(best) == k else 0.0
    return top(scored(bounds.where(F.col("bound") >= floor * (1 - 1e-9)).select("block")), k)


def ndcg(rows: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Mean NDCG@k. rows: qid, rank, doc_id; judged: qid, doc_id, gain."""
    gained = rows.where(F.col("rank") <= k).join(judged, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("gain"), "doc_id")
    ideal = judged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("idcg"))
    both = ideal.where("idcg > 0").join(gained, "qid", "left")
    return both.agg(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"), F.count(F.lit(1)).alias("n_queries"))

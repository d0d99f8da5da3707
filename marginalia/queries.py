"""The registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import SearchError
from marginalia.functions.analysis import MAX_TERM_BYTES, STOP_WORDS, Analyzer, analyzer
from marginalia.functions.builders import register
from marginalia.functions.snippets import snippet
from marginalia.operators import search as S
from marginalia.plans import query as Q
from marginalia.sources.postings import Index, Scan

PLAIN = Analyzer(stop_words=False, stemming=False)
ONE, TWO = ["text"], ["source", "text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, fields=ONE, analyzer: Analyzer = PLAIN) -> Scan:
    return Scan(table(spark, sf_dir, "documents"), "doc_id", fields, analyzer)


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "distance", "bound") else c for c in df.columns])


# SQL

def _base(fields=ONE, stop: bool = False, where: str = "true") -> str:
    """CTEs: l (doc_id, f, dl), p (term, f, doc_id, pos), tf, st (n and average length by field)."""
    some = " OR ".join(f"{c} IS NOT NULL" for c in fields)
    words = rf"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: strlen(x) <= {MAX_TERM_BYTES}" + (" AND x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))" if stop else ")")
    arms = " UNION ALL ".join(f"SELECT doc_id, {i} AS f, {words % c} AS w FROM documents WHERE ({some}) AND {where}" for i, c in enumerate(fields))
    n = "count(*)" if len(fields) == 1 else "count(*) FILTER (dl > 0)"
    return f"""WITH w AS ({arms}), l AS (SELECT doc_id, f, len(w)::INT AS dl FROM w),
p AS (SELECT doc_id, f, unnest(w) AS term, (generate_subscripts(w, 1) - 1)::INT AS pos FROM w),
t AS (SELECT term, f, doc_id, count(*)::INT AS tf FROM p GROUP BY ALL),
st AS (SELECT f, {n} AS n, CASE WHEN {n} > 0 THEN sum(dl) / ({n})::DOUBLE ELSE 1.0 END AS av FROM l GROUP BY f),
d AS (SELECT term, f, count(*) AS df FROM t GROUP BY ALL)"""


def _scores(leaves: list[tuple], boosts=(1.0, 1.0), k1: float = 1.2, b: float = 0.75, name: str = "s", negated=()) -> str:
    """CTE of doc_id, score and the set of leaves hit; leaves: (leaf, term, weight, field number or null)."""
    rows = ", ".join(f"({i}, {leaf}, '{term}', {float(weight)}::DOUBLE, {'NULL' if f is None else f}::INT)" for i, (leaf, term, weight, f) in enumerate(leaves))
    bf = "CASE t.f WHEN 0 THEN %r::DOUBLE ELSE %r::DOUBLE END" % boosts
    part = f"q.wt * {bf} * ln(1 + (st.n - least(d.df, st.n) + 0.5) / (least(d.df, st.n) + 0.5)::DOUBLE) * t.tf * {k1 + 1}::DOUBLE / (t.tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l.dl / st.av))"
    gone = f"WHERE q.leaf NOT IN ({', '.join(map(str, negated))})" if negated else "WHERE true"
    return f""", q{name}(i, leaf, term, wt, fld) AS (VALUES {rows}),
{name} AS (SELECT t.doc_id, sum({part}) FILTER ({gone}) AS score, list_distinct(list(q.leaf)) AS leaves
  FROM t JOIN q{name} q ON t.term = q.term AND (q.fld IS NULL OR q.fld = t.f) JOIN st ON st.f = t.f JOIN d ON d.term = t.term AND d.f = t.f JOIN l ON l.doc_id = t.doc_id AND l.f = t.f GROUP BY t.doc_id)"""


def _words(*terms: str, f: int | None = None) -> list[tuple]:
    return [(0, t, 1.0, f) for t in terms]


TAIL = " SELECT doc_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL"


def _top(k: int, offset: int = 0) -> str:
    return f" SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT {k} OFFSET {offset}"


def _has(i: int) -> str:
    return f"list_contains(leaves, {i})"


# queries

def bm25_topk(spark, sf_dir):
    return shown(S.search(docs(spark, sf_dir), "the of with", limit=10).select("doc_id", "score"))


def stemmed_rank(spark, sf_dir):
    return shown(S.search(docs(spark, sf_dir, analyzer=Analyzer()), "ending nations tion with", limit=100).select("doc_id", "score"))


def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(PLAIN.terms(F.col("text")), " ").alias("terms"))


def term_positions(spark, sf_dir):
    return docs(spark, sf_dir).postings().select("term", "doc_id", "tf", "dl", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def doc_lengths(spark, sf_dir):
    return docs(spark, sf_dir, TWO).lengths().select("doc_id", F.posexplode("dls").alias("field_id", "dl"))


def dictionary_df(spark, sf_dir):
    return docs(spark, sf_dir, TWO).postings().groupBy("term", "field_id").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def corpus_stats(spark, sf_dir):
    return docs(spark, sf_dir).lengths().agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.get("dls", F.lit(0)).cast("long")).alias("total_len"))


def field_stats(spark, sf_dir):
    rows = [(i, n, round(a, 9)) for i, (n, a) in enumerate(docs(spark, sf_dir, TWO).field_stats)]
    return spark.createDataFrame(rows, "field_id int, n_docs long, avg_len double")


def filter_off_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.matches_text(F.col("text"), "with of", PLAIN)).select("doc_id")


def _ranked(query, fields=ONE, **how):
    return lambda spark, sf_dir: shown(S.ranked(docs(spark, sf_dir, fields), query, S.Ranking(**how)))


def where_orderby_different(spark, sf_dir):
    out = S.search(docs(spark, sf_dir), order_by="with", where="the")
    return shown(out.select("doc_id", "score"))


def distance_column(spark, sf_dir):
    return shown(S.search(docs(spark, sf_dir), "of with").select("doc_id", "distance"))


def orderby_secondary_key(spark, sf_dir):
    rows = S.ranked(docs(spark, sf_dir), "with")
    return shown(rows.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").orderBy(F.desc("score"), "lang", "doc_id").limit(50))


def match_and_of_keys(spark, sf_dir):
    return S.matching(docs(spark, sf_dir), "the", "with")


def score_by_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown(S.score_by_key(d.withColumn("key", F.concat_ws("-", "lang", F.col("doc_id").cast("string"))), "key", "doc_id", S.ranked(docs(spark, sf_dir), "with of")))


def batch_topk_by_qid(spark, sf_dir):
    return shown(S.batch(docs(spark, sf_dir), {1: "the of", 2: "with", 3: "and with the"}, 5))


def keyset_page2(spark, sf_dir):
    source = docs(spark, sf_dir)
    last = S.search(source, "the of", limit=10).collect()[-1]
    return shown(S.search(source, "the of", limit=10, after=(last.score, last.doc_id)).select("doc_id", "score"))


def snippet_basic(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", snippet(F.col("text"), "with", ["text"], PLAIN, max_chars=80).alias("snippet")).where("snippet IS NOT NULL")


def _halves(spark, sf_dir, seal: bool, key: str = "doc_id", fields=ONE, **how) -> Index:
    """An index of even ids, with odd ids added."""
    d = table(spark, sf_dir, "documents").withColumn("key", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    index = Index.build(d.where("doc_id % 2 = 0"), key, fields, analyzer=PLAIN, **how)
    index.add(d.where("doc_id % 2 = 1"), key, seal_tokens=0 if seal else 1 << 40)
    return index


def segments_equal_single(spark, sf_dir):
    return shown(S.ranked(_halves(spark, sf_dir, True), "of with"))


def pending_visible(spark, sf_dir):
    return shown(S.ranked(_halves(spark, sf_dir, False), "of with"))


def after_seal(spark, sf_dir):
    index = _halves(spark, sf_dir, False)
    index.delete(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"))
    index.seal()
    return shown(S.ranked(index, "of with"))


def key_text(spark, sf_dir):
    return shown(S.search(_halves(spark, sf_dir, False, "key"), "of with", limit=100).select(F.col("doc_id").alias("key"), "score"))


def after_delete_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    index = Index.build(d, "doc_id", ONE, analyzer=PLAIN)
    index.delete(d.where("doc_id % 3 = 0"))
    return shown(S.ranked(index, "of with"))


def after_merge(spark, sf_dir):
    index = _halves(spark, sf_dir, True)
    index.delete(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"))
    index.merge(force=True)
    return index.stats().select("n_docs", "total_len", "n_segments", "n_deletes")


def after_merge_rank(spark, sf_dir):
    index = _halves(spark, sf_dir, True)
    index.delete(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"))
    index.merge(force=True)
    return shown(S.ranked(index, "of with"))


def index_stats(spark, sf_dir):
    stats = _halves(spark, sf_dir, False, k1=0.9, b=0.4).stats()
    return stats.select("n_docs", "total_len", "n_segments", F.col("pending_docs").cast("long").alias("pending_docs"), "k1", "b", F.round("sealed_avg_len", 6).alias("sealed_avg_len"), "n_fields", "key_type")


def segment_totals(spark, sf_dir):
    index = _halves(spark, sf_dir, True)
    index.delete(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"))
    return index.segments().drop("segment")


def empty_build(spark, sf_dir):
    return Index.build(table(spark, sf_dir, "documents").limit(0), "doc_id", TWO, analyzer=PLAIN).stats().select("n_docs", "total_len", "n_segments", "n_fields")


def index_options(spark, sf_dir):
    """Options of the index rank a query that has none."""
    return shown(S.ranked(_halves(spark, sf_dir, True, k1=0.9, b=0.4), HITS))


def pruned_index(spark, sf_dir):
    """From the stored impacts of two segments, with parameters by field."""
    return shown(S.pruned_top(_halves(spark, sf_dir, True, fields=TWO, k1_of={"text": 0.9}, b_of={"text": 0.4}), "text:of with", 10))


def where_pages(spark, sf_dir):
    """Page after page through a WHERE that the ranking matches in part."""
    source, pages, after = docs(spark, sf_dir), [], None
    for page in range(3):
        rows = S.search(source, order_by="hence with", where="src the", limit=350, after=after).select("doc_id", "score").collect()
        pages += [(page, r.doc_id, r.score) for r in rows]
        after = (rows[-1].score, rows[-1].doc_id) if rows else after
    return shown(spark.createDataFrame(pages, "page long, doc_id long, score double"))


def batch_phrases(spark, sf_dir):
    return shown(S.batch(docs(spark, sf_dir), {1: '"of the"', 2: "with", 3: '{"boolean": {"must": [{"term": {"value": "with"}}, {"match": {"terms": "the"}}]}}'}, 5))


def ndcg_of_batch(spark, sf_dir):
    """The gain of a document is 1 if its id is divisible by 3, else 0.25 if by 2."""
    source = docs(spark, sf_dir)
    rows = S.batch(source, {1: "the of", 2: "with"}, 10)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1.0).when(F.col("doc_id") % 2 == 0, 0.25).otherwise(0.0).alias("gain"))
    judged = d.select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("qid"), "doc_id", "gain")
    return S.ndcg(rows, judged).select(F.round("ndcg", 6).alias("ndcg"), "n_queries")


def score_by_lang(spark, sf_dir):
    """Keys that documents share: no score where theirs differ."""
    d = table(spark, sf_dir, "documents").withColumn("key", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(F.col("lang")))
    source = docs(spark, sf_dir)
    return shown(S.score_by_key(d, "key", "doc_id", S.ranked(source, "with of"), S.ranked(source, "with of")))


def append_indexes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = [Scan(d.where(f"doc_id % 2 = {i}"), "doc_id", ONE, PLAIN) for i in (0, 1)]
    return shown(S.append_top(parts, "of with", 50))


def sql_builders(spark, sf_dir):
    register(spark)
    query = spark.sql("SELECT query_boost(2.5D, query_boolean(must => array(query_match('of')), should => array(query_boost(3, query_match('with', 'text'))))) AS q").first().q
    return shown(S.ranked(docs(spark, sf_dir), query))


def error_codes(spark, sf_dir):
    """SQLSTATE of what is refused."""
    source = docs(spark, sf_dir)
    index = Index.build(table(spark, sf_dir, "documents").limit(5), "doc_id", ONE, analyzer=PLAIN)

    def changed(**meta):
        index._publish(**meta)
        return Index(spark, index.path)

    cases = {
        "unknown field": lambda: S.ranked(source, "titel:car"), "open quote": lambda: S.ranked(source, '"red car'), "text after phrase": lambda: S.ranked(source, '"red car" x'), "slop": lambda: S.ranked(source, '"a b"~100001'),
        "unknown node": lambda: S.ranked(source, '{"mach": {}}'), "two words in a term": lambda: S.ranked(source, Q.term("red car")), "short wildcard": lambda: Q.wildcard("a*"),
        "expansions": lambda: S.ranked(source, Q.wildcard("the*"), S.Ranking(max_expansions=0)), "leaves": lambda: S.ranked(source, Q.boolean(should=[Q.match("a")] * 65)), "must_not alone": lambda: Q.boolean(must_not=[Q.match("a")]),
        "tree off index": lambda: S.matches_text(F.col("text"), '{"match": {"terms": "a"}}', PLAIN), "phrase off index": lambda: S.matches_text(F.col("text"), '"a b"', PLAIN), "language": lambda: analyzer("klingon"), "k1": lambda: S.Ranking(k1=-1),
        "key type": lambda: index.add(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id"), "no index": lambda: Index(spark, index.path + "-none"), "no text": lambda: Scan(table(spark, sf_dir, "documents"), "doc_id", ["n_chars"]),
        "other analyzer": lambda: changed(fingerprint="another"), "unknown feature": lambda: changed(features=["later"]), "later version": lambda: changed(min_read=99),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, None))
        except SearchError as e:
            rows.append((name, e.sqlstate))
    return spark.createDataFrame(rows, "refused string, sqlstate string")


ERRORS = {
    "unknown field": "42703", "open quote": "42601", "text after phrase": "42601", "slop": "22023", "unknown node": "22023", "two words in a term": "22023", "short wildcard": "22023", "expansions": "54000", "leaves": "54000", "must_not alone": "22023",
    "tree off index": "0A000", "phrase off index": "0A000", "language": "42704", "k1": "22023", "key type": "42804", "no index": "42P01", "no text": "42804", "other analyzer": "55000", "unknown feature": "0A000", "later version": "0A000",
}


def block_impacts(spark, sf_dir):
    return S.block_impacts(docs(spark, sf_dir), ["the", "of", "with"])


def pruned_topk(spark, sf_dir):
    return shown(S.pruned_top(docs(spark, sf_dir), "the of with", 10))


HITS = "the of with"
PH = {"exact": Q.phrase("of the"), "ordered": Q.phrase("of the", slop=3), "unordered": Q.phrase("of the", slop=3, ordered=False), "three": Q.phrase("of the with", slop=20, ordered=False), "repeated": Q.phrase("the the", slop=20)}
QUERIES = {
    "bm25_topk": bm25_topk, "bm25_full_rank": _ranked(HITS), "bm25_custom_k1b": _ranked(HITS, k1=0.9, b=0.4), "bm25_dup_query_term": _ranked("with with of"),
    "bm25f_two_fields": _ranked("src8 with", TWO), "bm25f_boosted": _ranked("src9 with", TWO, boosts={"source": 5.0}), "bm25f_field_scope": _ranked("text:with", TWO),
    "tokenize_terms": tokenize_terms, "term_positions": term_positions, "doc_lengths": doc_lengths, "dictionary_df": dictionary_df, "corpus_stats": corpus_stats, "field_stats": field_stats,
    "match_any": lambda s, d: S.matching(docs(s, d), HITS), "match_and_of_keys": match_and_of_keys, "match_field_scoped": lambda s, d: S.matching(docs(s, d, TWO), "text:with"), "filter_off_index": filter_off_index,
    "where_orderby_different": where_orderby_different, "orderby_secondary_key": orderby_secondary_key, "distance_column": distance_column,
    "bool_must": _ranked({"boolean": {"must": [{"match": {"terms": "the"}}, {"term": {"value": "with"}}]}}),
    "bool_should": _ranked({"boolean": {"should": [{"match": {"terms": "with"}}, {"match": {"terms": "and"}}]}}),
    "bool_must_not": _ranked({"boolean": {"must": [{"match": {"terms": "the"}}], "must_not": [{"match": {"terms": "with"}}]}}),
    "bool_nested": _ranked({"boolean": {"must": [{"boolean": {"should": [{"match": {"terms": "with"}}, {"match": {"terms": "and"}}]}}, {"match": {"terms": "of"}}]}}),
    "bool_boost": _ranked({"boost": {"weight": 2.5, "query": {"boolean": {"must": [{"match": {"terms": "of"}}], "should": [{"boost": {"weight": 3, "query": {"match": {"terms": "with"}}}}]}}}}),
    "phrase_exact": _ranked(PH["exact"]), "phrase_slop_ordered": _ranked(PH["ordered"]), "phrase_two_term_unordered": _ranked(PH["unordered"]), "phrase_repeated_word": _ranked(PH["repeated"]),
    "wildcard_prefix": _ranked(Q.wildcard("wit*")), "wildcard_infix": _ranked(Q.wildcard("tha*n*")),
    "snippet_basic": snippet_basic, "score_by_key": score_by_key, "batch_topk_by_qid": batch_topk_by_qid, "keyset_page2": keyset_page2,
    "segments_equal_single": segments_equal_single, "after_delete_stats": after_delete_stats, "after_merge": after_merge, "block_impacts": block_impacts, "pruned_topk": pruned_topk,
    "pending_visible": pending_visible, "after_seal": after_seal, "key_text": key_text, "after_merge_rank": after_merge_rank, "index_stats": index_stats, "segment_totals": segment_totals, "empty_build": empty_build, "index_options": index_options, "pruned_index": pruned_index,
    "where_pages": where_pages, "batch_phrases": batch_phrases, "ndcg_of_batch": ndcg_of_batch, "score_by_lang": score_by_lang, "append_indexes": append_indexes, "sql_builders": sql_builders, "error_codes": error_codes,
    "offset_page": lambda s, d: shown(S.search(docs(s, d), HITS, limit=10, offset=5).select("doc_id", "score")), "text_phrase": _ranked('text:"of the"~>3', TWO), "json_text": _ranked('{"boolean": {"must": [{"match": {"terms": "the"}}, {"term": {"value": "with"}}]}}'),
    "phrase_three_unordered": _ranked(PH["three"]), "match_tree": lambda s, d: S.matching(docs(s, d), '{"boolean": {"must": [{"match": {"terms": "the"}}], "must_not": [{"match": {"terms": "with"}}]}}'), "match_phrase": lambda s, d: S.matching(docs(s, d), '"of the"'),
    "stopword_removed_rank": lambda s, d: shown(S.ranked(docs(s, d, analyzer=Analyzer(stemming=False)), "the en tion er")), "stemmed_rank": stemmed_rank,
}

_hits = _words("the", "of", "with")
_alone = _base() + _scores(_words("with", "of"))


def _phrase(leaves, test: str) -> str:
    return _base() + _scores(leaves) + f" SELECT doc_id, round(score, 6) AS score FROM s WHERE doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND {test})"


def _globbed(pattern: str) -> str:
    return _base() + f", v AS (SELECT DISTINCT term FROM t WHERE term LIKE '{pattern}'), " + _scores(_words("x"))[2:].replace("(VALUES (0, 0, 'x', 1.0::DOUBLE, NULL::INT))", "(SELECT row_number() OVER (), 0, term, 1.0::DOUBLE, NULL::INT FROM v)") + TAIL


_THIRD = "doc_id % 3 <> 0"


def _nested(where: str, scores: str, select: str) -> str:
    return f"SELECT * FROM ({_base(where=where)}{scores}{select})"


_join_key = _alone + " SELECT lang || '-' || documents.doc_id AS key, round(score, 6) AS score FROM s JOIN documents USING (doc_id)"
_B = [(0, "the", 1.0, None), (1, "with", 1.0, None)]
ORACLE_SQL = {
    "bm25_topk": _base() + _scores(_hits) + _top(10), "bm25_full_rank": _base() + _scores(_hits) + TAIL, "bm25_custom_k1b": _base() + _scores(_hits, k1=0.9, b=0.4) + TAIL,
    "bm25_dup_query_term": _base() + _scores(_words("with", "with", "of")) + TAIL, "bm25f_two_fields": _base(TWO) + _scores(_words("src8", "with")) + TAIL,
    "bm25f_boosted": _base(TWO) + _scores(_words("src9", "with"), boosts=(5.0, 1.0)) + TAIL, "bm25f_field_scope": _base(TWO) + _scores(_words("with", f=1)) + TAIL,
    "tokenize_terms": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'), ' ') AS terms FROM documents",
    "term_positions": _base() + " SELECT p.term, p.doc_id, count(*) AS tf, any_value(dl) AS dl, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM p JOIN l USING (doc_id, f) GROUP BY p.term, p.doc_id",
    "doc_lengths": _base(TWO) + " SELECT doc_id, f AS field_id, dl FROM l", "dictionary_df": _base(TWO) + " SELECT term, f AS field_id, count(*) AS df, sum(tf)::BIGINT AS n FROM t GROUP BY ALL",
    "corpus_stats": _base() + " SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_len FROM l", "field_stats": _base(TWO) + " SELECT f AS field_id, n AS n_docs, round(av, 9) AS avg_len FROM st",
    "match_any": _base() + " SELECT DISTINCT doc_id FROM t WHERE term IN ('the', 'of', 'with')", "match_and_of_keys": _base() + " SELECT doc_id FROM t WHERE term = 'the' INTERSECT SELECT doc_id FROM t WHERE term = 'with'",
    "match_field_scoped": _base(TWO) + " SELECT DISTINCT doc_id FROM t WHERE term = 'with' AND f = 1", "filter_off_index": _base() + " SELECT DISTINCT doc_id FROM t WHERE term IN ('of', 'with')",
    "where_orderby_different": _base() + _scores(_words("with")) + " SELECT doc_id, round(score, 6) AS score FROM (SELECT DISTINCT doc_id FROM t WHERE term = 'the') LEFT JOIN s USING (doc_id)",
    "orderby_secondary_key": _base() + _scores(_words("with")) + " SELECT doc_id, round(score, 6) AS score, lang FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, lang, doc_id LIMIT 50",
    "distance_column": _alone + " SELECT doc_id, round(-score, 6) AS distance FROM s",
    "bool_must": _base() + _scores(_B) + TAIL + f" AND {_has(0)} AND {_has(1)}", "bool_should": _base() + _scores([(0, "with", 1.0, None), (1, "and", 1.0, None)]) + TAIL,
    "bool_must_not": _base() + _scores(_B, negated=[1]) + TAIL + f" AND {_has(0)} AND NOT {_has(1)}",
    "bool_nested": _base() + _scores([(0, "with", 1.0, None), (1, "and", 1.0, None), (2, "of", 1.0, None)]) + TAIL + f" AND ({_has(0)} OR {_has(1)}) AND {_has(2)}",
    "bool_boost": _base() + _scores([(0, "of", 2.5, None), (1, "with", 7.5, None)]) + TAIL + f" AND {_has(0)}",
    "phrase_exact": _phrase(_words("of", "the"), "a.term = 'of' AND b.term = 'the' AND b.pos = a.pos + 1"),
    "phrase_slop_ordered": _phrase(_words("of", "the"), "a.term = 'of' AND b.term = 'the' AND b.pos > a.pos AND b.pos - a.pos <= 4"),
    "phrase_two_term_unordered": _phrase(_words("of", "the"), "a.term = 'of' AND b.term = 'the' AND abs(b.pos - a.pos) <= 4"),
    "phrase_repeated_word": _phrase(_words("the", "the"), "a.term = 'the' AND b.term = 'the' AND b.pos > a.pos AND b.pos - a.pos <= 21"),
    "wildcard_prefix": _globbed("wit%"), "wildcard_infix": _globbed("tha%n%"), "score_by_key": _join_key,
    "batch_topk_by_qid": _base() + _scores(_words("the", "of"), name="a") + _scores(_words("with"), name="b") + _scores(_words("and", "with", "the"), name="c")
    + " SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT 1 AS qid, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c)) WHERE rank <= 5",
    "keyset_page2": _base() + _scores(_words("the", "of")) + _top(10, 10), "segments_equal_single": _alone + TAIL,
    "pending_visible": _alone + TAIL, "after_seal": _base(where=_THIRD) + _scores(_words("with", "of")) + TAIL, "after_merge_rank": _base(where=_THIRD) + _scores(_words("with", "of")) + TAIL,
    "key_text": _alone + " SELECT 'doc-' || doc_id AS key, round(score, 6) AS score FROM s ORDER BY s.score DESC, key LIMIT 100",
    "index_stats": _base() + " SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_len, 1 AS n_segments, count(*) FILTER (doc_id % 2 = 1) AS pending_docs, 0.9::DOUBLE AS k1, 0.4::DOUBLE AS b, round(sum(dl) FILTER (doc_id % 2 = 0) / count(*) FILTER (doc_id % 2 = 0), 6) AS sealed_avg_len, 1 AS n_fields, 'long' AS key_type FROM l",
    "segment_totals": _base() + ", a AS (SELECT doc_id % 2 AS half, count(*) AS n_docs, count(*) FILTER (doc_id % 3 <> 0) AS n_live, (sum(dl) FILTER (doc_id % 3 <> 0))::BIGINT AS total_len FROM l GROUP BY 1), c AS (SELECT doc_id % 2 AS half, count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM t WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT n_docs, n_live, total_len, n_postings, n_terms FROM a JOIN c USING (half)",
    "empty_build": "SELECT 0::BIGINT AS n_docs, 0::BIGINT AS total_len, 1 AS n_segments, 2 AS n_fields", "index_options": _base() + _scores(_hits, k1=0.9, b=0.4) + TAIL, "pruned_index": _base(TWO) + _scores(_words("of", "with", f=1), k1=0.9, b=0.4) + _top(10),
    "where_pages": _base() + _scores(_words("hence", "with")) + ", m AS (SELECT DISTINCT doc_id FROM t WHERE term IN ('src', 'the')), o AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) - 1 AS n FROM m LEFT JOIN s USING (doc_id)) SELECT n // 350 AS page, doc_id, round(score, 6) AS score FROM o WHERE n < 1050",
    "batch_phrases": _base() + _scores(_words("of", "the"), name="a") + _scores(_words("with"), name="b") + _scores([(0, "with", 1.0, None), (1, "the", 1.0, None)], name="c")
    + " SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT 1 AS qid, * FROM a WHERE doc_id IN (SELECT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term = 'of' AND y.term = 'the' AND y.pos = x.pos + 1) UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c WHERE len(leaves) = 2)) WHERE rank <= 5",
    "ndcg_of_batch": _base() + _scores(_words("the", "of"), name="a") + _scores(_words("with"), name="b")
    + ", g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS gain FROM documents), r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT 1 AS qid, * FROM a UNION ALL SELECT 2, * FROM b)), d1 AS (SELECT qid, sum(gain / log2(rank + 1)) AS dcg FROM r JOIN g USING (doc_id) WHERE rank <= 10 GROUP BY qid), i AS (SELECT sum(gain / log2(k + 1)) AS ideal FROM (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS k FROM g) WHERE k <= 10) SELECT round(avg(dcg / ideal), 6) AS ndcg, count(*) AS n_queries FROM d1, i",
    "score_by_lang": _alone + " SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR ELSE lang END AS key, CASE WHEN min(score) = max(score) THEN round(max(score), 6) END AS score FROM s JOIN documents USING (doc_id) GROUP BY 1",
    "append_indexes": "SELECT source, doc_id, round(score, 6) AS score FROM (" + " UNION ALL ".join(_nested(f"doc_id % 2 = {i}", _scores(_words("with", "of")), f" SELECT {i} AS source, doc_id, score FROM s") for i in (0, 1)) + ") u ORDER BY u.score DESC, source, doc_id LIMIT 50",
    "sql_builders": _base() + _scores([(0, "of", 2.5, None), (1, "with", 7.5, None)]) + TAIL + f" AND {_has(0)}", "error_codes": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ERRORS.items()) + ") AS e(refused, sqlstate)",
    "offset_page": _base() + _scores(_hits) + _top(10, 5), "json_text": _base() + _scores(_B) + TAIL + f" AND {_has(0)} AND {_has(1)}",
    "text_phrase": _base(TWO) + _scores(_words("of", "the", f=1)) + " SELECT doc_id, round(score, 6) AS score FROM s WHERE doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.f = 1 AND b.f = 1 AND a.term = 'of' AND b.term = 'the' AND b.pos > a.pos AND b.pos - a.pos <= 4)",
    "phrase_three_unordered": _base() + _scores(_hits) + " SELECT doc_id, round(score, 6) AS score FROM s WHERE doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'of' AND b.term = 'the' AND abs(a.pos - b.pos) <= 22 JOIN p c ON a.doc_id = c.doc_id AND c.term = 'with' AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 22)",
    "match_tree": _base() + " SELECT doc_id FROM t WHERE term = 'the' EXCEPT SELECT doc_id FROM t WHERE term = 'with'",
    "match_phrase": _base() + " SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'of' AND b.term = 'the' AND b.pos = a.pos + 1",
    "after_delete_stats": _base(where="doc_id % 3 <> 0") + _scores(_words("with", "of")) + TAIL,
    "after_merge": _base(where="doc_id % 3 <> 0") + " SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_len, 1 AS n_segments, 0 AS n_deletes FROM l",
    "block_impacts": _base() + " SELECT term, f AS field_id, doc_id // 128 AS block, count(*) AS n, max(tf) AS max_tf, min(dl) AS min_dl FROM t JOIN l USING (doc_id, f) WHERE term IN ('the', 'of', 'with') GROUP BY ALL",
    "pruned_topk": _base() + _scores(_hits) + _top(10), "stopword_removed_rank": _base(stop=True) + _scores(_words("en", "tion", "er")) + TAIL,
}

"""SQL functions that build queries as JSON text, for use in SQL and in string columns.

    register(spark)
    spark.sql("SELECT query_boolean(must => array(query_match('red car'), query_term('fast', 'title')))")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_OPTIONAL = "CASE WHEN {0} IS NULL THEN '' ELSE concat(',\"{0}\":', {1}) END"


def _text(name: str) -> str:
    """A JSON string: that of an array of it, without the brackets."""
    return f"substr(to_json(array({name})), 2, length(to_json(array({name}))) - 2)"


def _leaf(kind: str, key: str, *more: str) -> str:
    return f"concat('{{\"{kind}\":{{\"{key}\":', {_text(key)}, {_OPTIONAL.format('field', _text('field'))}{''.join(', ' + x for x in more)}, '}}}}')"


def _list(name: str) -> str:
    return f"concat('\"{name}\":[', array_join(coalesce({name}, array()), ','), ']')"


FUNCTIONS = {
    "query_match(terms STRING, field STRING DEFAULT NULL)": _leaf("match", "terms"),
    "query_term(value STRING, field STRING DEFAULT NULL)": _leaf("term", "value"),
    "query_phrase(phrase STRING, field STRING DEFAULT NULL, slop INT DEFAULT 0, ordered BOOLEAN DEFAULT true)": _leaf("phrase", "phrase", "',\"slop\":'", "CAST(slop AS STRING)", "',\"ordered\":'", "CAST(ordered AS STRING)"),
    "query_wildcard(pattern STRING, field STRING DEFAULT NULL)": _leaf("wildcard", "pattern"),
    "query_boolean(must ARRAY<STRING> DEFAULT NULL, should ARRAY<STRING> DEFAULT NULL, must_not ARRAY<STRING> DEFAULT NULL)": f"concat('{{\"boolean\":{{', {_list('must')}, ',', {_list('should')}, ',', {_list('must_not')}, '}}}}')",
    "query_boost(weight DOUBLE, query STRING)": "concat('{\"boost\":{\"weight\":', CAST(weight AS STRING), ',\"query\":', query, '}}')",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")

"""Highlighted excerpts of texts: the window with most hits, then the least span, within a budget of characters."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.errors import SearchError
from marginalia.functions.analysis import _WORDS, Analyzer
from marginalia.plans import query as Q

ELLIPSIS = "…"


def excerpt(text: str | None, is_hit, start: str, end: str, budget: int, escape: bool) -> str | None:
    """is_hit: whether a word of the text is one."""
    words = [m.span() for m in _WORDS.finditer(text or "")]
    hits = [s for s in words if is_hit(text[slice(*s)])]
    if not hits:
        return None
    best, first = (0, 0, 0, 0), 0
    for last in range(len(hits)):
        while first < last and hits[last][1] - hits[first][0] > budget:
            first += 1
        found = (last - first + 1, hits[first][0] - hits[last][1], first, last)
        if found[:2] > best[:2] or not best[0]:
            best = found
    first, last = best[2:]
    lo, hi = hits[first][0], hits[last][1]
    slack = max(0, budget - (hi - lo))
    left = min(lo, slack // 2)
    right = min(len(text) - hi, slack - left)
    left = min(lo, slack - right)
    a, b = lo - left, hi + right
    # edges inside a word move towards the hits
    a = next((e for s, e in words if s < a < e), a) if a else a
    b = next((s for s, e in words if s < b < e), b) if b < len(text) else b
    a, b = min(a, lo), max(b, hi)
    show = (lambda x: html.escape(x, quote=True).replace("&#x27;", "&#39;")) if escape else (lambda x: x)
    out, at = [], a
    for s, e in hits:
        if a <= s and e <= b:
            out += [show(text[at:s]), start, show(text[s:e]), end]
            at = e
    out.append(show(text[at:b]))
    inner = "".join(out)
    return (ELLIPSIS if a else "") + (inner.lstrip() if a else inner) + (ELLIPSIS if b < len(text) else "")


def snippet(text: Column, query, fields: list[str], analyzer: Analyzer = Analyzer(), start: str = "<mark>", end: str = "</mark>", max_chars: int = 300, escape: bool | None = True) -> Column:
    """The excerpt of a text for the query's words and patterns, whatever field they name; null without a hit."""
    if max_chars <= 0:
        raise SearchError("max_chars must be positive")
    leaves = [x.leaf for x in Q.flatten(Q.parse(query, fields)) if not x.negated]
    terms = {t for x in leaves if x.kind != "wildcard" for t in analyzer.of(x.text)}
    globs = [re.compile("(?s)" + ".*".join(map(re.escape, x.text.split("*"))) + r"\Z") for x in leaves if x.kind == "wildcard"]

    def run(texts: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}

        def is_hit(word: str) -> bool:
            if word not in known:
                known[word] = any(t in terms or any(g.match(t) for g in globs) for t in analyzer.of(word))
            return known[word]

        return pa.array([excerpt(x, is_hit, start, end, max_chars, escape is not False) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)

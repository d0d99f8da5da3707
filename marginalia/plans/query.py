"""Queries as trees: builders, JSON, the text syntax, validation, and flattening into leaves.

Text: words (any of them), ``field:`` before them, or a phrase in quotes with ``~n`` (any order) or ``~>n`` behind it.
JSON: one-key objects match, term, phrase, wildcard, boolean, boost.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from difflib import get_close_matches

from marginalia.errors import SearchError

# Limits and names of the query language.
MAX_SLOP, MAX_LEAVES, MAX_NODES, MAX_DEPTH = 100_000, 64, 1024, 32
BOOSTS = (1e-6, 1e6)
MIN_PREFIX, MAX_PATTERN, MAX_STARS, MAX_EXPANSIONS = 3, 256, 8, 1000
KEYS = {
    "match": {"field", "terms"}, "term": {"field", "value"}, "phrase": {"field", "phrase", "slop", "ordered"},
    "wildcard": {"field", "pattern"}, "boolean": {"must", "should", "must_not"}, "boost": {"weight", "query"},
}
REQUIRED = {"match": "terms", "term": "value", "phrase": "phrase", "wildcard": "pattern"}


@dataclass(frozen=True)
class Leaf:
    kind: str
    text: str
    field: str | None = None
    slop: int = 0
    ordered: bool = True


@dataclass(frozen=True)
class Boolean:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


@dataclass(frozen=True)
class Boost:
    weight: float
    query: object


@dataclass
class Bit:
    """A leaf in its tree: the bit that says it matched, its weight, and whether it only excludes."""

    bit: int
    leaf: Leaf
    boost: float
    negated: bool
    terms: list[str] = field(default_factory=list)

    @property
    def flag(self) -> int:
        """The bit in a signed 64-bit integer."""
        return 1 << self.bit if self.bit < 63 else -(1 << 63)


def match(terms: str, field: str | None = None) -> Leaf:
    return Leaf("match", terms, field)


def term(value: str, field: str | None = None) -> Leaf:
    return Leaf("term", value, field)


def phrase(text: str, field: str | None = None, slop: int = 0, ordered: bool = True) -> Leaf:
    if isinstance(slop, bool) or not isinstance(slop, int):
        raise SearchError("slop must be an integer")
    if not 0 <= slop <= MAX_SLOP:
        raise SearchError(f"slop must be between 0 and {MAX_SLOP}")
    return Leaf("phrase", text, field, slop, ordered)


def wildcard(pattern: str, field: str | None = None) -> Leaf:
    low = pattern.lower()
    if "*" not in low:
        raise SearchError("wildcard pattern has no *")
    if len(low.encode()) > MAX_PATTERN:
        raise SearchError("wildcard pattern is too long")
    if low.count("*") > MAX_STARS:
        raise SearchError("wildcard pattern has too many *")
    if len(low.split("*")[0].encode()) < MIN_PREFIX:
        raise SearchError(f"wildcard pattern needs {MIN_PREFIX} bytes before its first *")
    return Leaf("wildcard", low, field)


def boolean(must=(), should=(), must_not=()) -> Boolean:
    if must_not and not must and not should:
        raise SearchError("a boolean query with must_not alone matches nothing to exclude from")
    return Boolean(tuple(must), tuple(should), tuple(must_not))


def boost(weight: float, query) -> Boost:
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not weight > 0:
        raise SearchError("boost weight must be a positive number")
    return Boost(float(weight), query)


def from_json(data: str | dict):
    """A tree from JSON text or its parsed form, with every part checked."""
    nodes = 0

    def made(x, depth: int):
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise SearchError("query tree is too deep or too large", "54001")
        if not isinstance(x, dict) or len(x) != 1:
            raise SearchError("a query node is an object with exactly one key")
        (kind, args), *_ = x.items()
        if kind not in KEYS:
            near = get_close_matches(kind, KEYS, 1)
            raise SearchError(f'unknown query node "{kind}"', hint=f'Did you mean "{near[0]}"?' if near else None)
        if not isinstance(args, dict):
            raise SearchError(f'"{kind}" takes an object')
        for k in args:
            if k not in KEYS[kind]:
                near = get_close_matches(k, KEYS[kind], 1)
                raise SearchError(f'unknown key "{k}" in "{kind}"', hint=f'Did you mean "{near[0]}"?' if near else None)
        if kind == "boost":
            if "query" not in args:
                raise SearchError('"boost" needs a query')
            return boost(args.get("weight"), made(args["query"], depth + 1))
        if kind == "boolean":
            parts = {}
            for k in KEYS[kind]:
                value = args.get(k)
                if value is not None and not isinstance(value, list):
                    raise SearchError(f'"{k}" must be an array')
                if any(v is None for v in value or ()):
                    raise SearchError(f'"{k}" holds a null')
                parts[k] = [made(v, depth + 1) for v in value or ()]
            return boolean(**parts)
        text = args.get(REQUIRED[kind])
        if not isinstance(text, str):
            raise SearchError(f'"{kind}" needs a string "{REQUIRED[kind]}"')
        name = args.get("field")
        if name is not None and not isinstance(name, str):
            raise SearchError('"field" must be a string')
        if kind == "phrase":
            return phrase(text, name, args.get("slop", 0), bool(args.get("ordered", True)))
        return {"match": match, "term": term, "wildcard": wildcard}[kind](text, name)

    return made(json.loads(data) if isinstance(data, str) else data, 1)


_SCOPE = re.compile(r'\s*([^\s":]*):(.?)', re.S)
_PHRASE = re.compile(r'"([^"]*)"(?:~(>?)(\d+))?\s*$', re.S)


def from_text(text: str, fields: list[str]) -> Leaf:
    """The text syntax. A name before a colon that is no field is an error, unless / or a digit follows the colon."""
    name, rest = None, text
    if m := _SCOPE.match(text):
        if m[1] in fields:
            name, rest = m[1], text[m.end(1) + 1 :]
        elif not (m[2] == "/" or m[2].isdigit()):
            raise SearchError(f'unknown search field "{m[1]}"', "42703")
    quoted = rest.strip()
    if not quoted.startswith('"'):
        return match(rest, name)
    if quoted.count('"') < 2:
        raise SearchError("unterminated quote in phrase", "42601")
    m = _PHRASE.match(quoted)
    if not m:
        raise SearchError("unexpected text after phrase", "42601")
    return phrase(m[1], name, int(m[3] or 0), not m[3] or m[2] == ">")


def is_json(text: str) -> bool:
    """Whether a text is that of a JSON object, which stands for a tree and not for words."""
    if not text.lstrip().startswith("{"):
        return False
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def parse(query, fields: list[str]):
    """Text, JSON object or its text, or a tree as it is."""
    if isinstance(query, dict) or isinstance(query, str) and is_json(query):
        tree = from_json(query)
    else:
        tree = from_text(query, fields) if isinstance(query, str) else query
    for x in flatten(tree):
        if x.leaf.field is not None and x.leaf.field not in fields:
            raise SearchError(f'unknown search field "{x.leaf.field}"', "42703")
    return tree


def flatten(tree) -> list[Bit]:
    """The leaves from left to right."""
    out: list[Bit] = []

    def walk(x, weight: float, negated: bool) -> None:
        if isinstance(x, Leaf):
            if len(out) == MAX_LEAVES:
                raise SearchError(f"a query has at most {MAX_LEAVES} leaves", "54000")
            out.append(Bit(len(out), x, weight, negated))
        elif isinstance(x, Boost):
            weight *= x.weight
            if not BOOSTS[0] <= weight <= BOOSTS[1]:
                raise SearchError("boosts multiply to a weight out of range")
            walk(x.query, weight, negated)
        else:
            for part in (*x.must, *x.should):
                walk(part, weight, negated)
            for part in x.must_not:
                walk(part, weight, True)

    walk(tree, 1.0, False)
    return out


def formula(tree, matched: list):
    """The tree as one condition over the leaves' conditions, in the order of flatten()."""
    from pyspark.sql import functions as F

    at = iter(matched)

    def built(x):
        if isinstance(x, Leaf):
            return next(at)
        if isinstance(x, Boost):
            return built(x.query)
        must, should, must_not = ([built(p) for p in part] for part in (x.must, x.should, x.must_not))
        any_of = F.lit(bool(must))
        for c in should:
            any_of = any_of | c
        for c in must:
            any_of = any_of & c
        for c in must_not:
            any_of = any_of & ~c
        return any_of

    return built(tree)

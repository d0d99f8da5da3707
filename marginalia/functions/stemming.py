"""The English stemmer Porter2, written from its published description."""

from __future__ import annotations

import re

# The published special words and suffix classes.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_AFTER = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT_END = re.compile("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    if suffix and _VOWEL.search(w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            return w + "e"
        if _DOUBLE.search(w):
            # a double letter behind a single first vowel stays: add, egg, off
            return w if len(w) == 3 and w[0] in "aeo" else w[:-1]
        if r1 >= len(w) and _SHORT_END.search(w):
            return w + "e"
    return w


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    if not word.isascii():
        return word
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in KEPT_AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    suffix = _longest(w, STEP2)
    if suffix and len(w) - len(suffix) >= r1:
        rest = w[: -len(suffix)]
        if not (suffix == "ogi" and rest[-1:] != "l") and not (suffix == "li" and rest[-1:] not in LI_AFTER):
            w = rest + STEP2[suffix]
    suffix = _longest(w, STEP3)
    if suffix and len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
        w = w[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(w, STEP4)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()

"""Full-text rank by cover density over stemmed positions.

Stemming follows Porter, "An algorithm for suffix stripping" (1980); cover
density follows Clarke, Cormack and Tudhope, "Relevance ranking for one to
three term queries" (2000).  Stems are made as an index is built;
:func:`cover_density` is the plain form of the expression in ``fulltext``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from foliospark.functions.lexicon import STOPWORDS

_VOWEL = "aeiou"
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


#: Longest endings first, and all endings of a step, to pass by words that have none.
_TABLES = tuple((sorted(t, key=lambda x: -len(x[0])), tuple(e for e, _ in t)) for t in (_STEP2, _STEP3))
_LAST = tuple(sorted(_STEP4, key=len, reverse=True))


def _shape(word: str) -> str:
    """Vowels as v, consonants as c; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWEL or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


@lru_cache(maxsize=400_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in _TABLES:
        for end, by in table if w.endswith(ends) else ():
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + by
                break
    for end in _LAST if w.endswith(_LAST) else ():
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def lexemes(text: str) -> list[str]:
    """Stems by position; stopwords keep their place as empty strings."""
    return ["" if t in STOPWORDS else stem(t) for t in re.findall("[a-z0-9_]+", text.lower())]


def cover_density(terms: set[str], places: list[str]) -> float:
    """Sum of shares of the shortest covers of all terms: full for covers no longer than the terms."""
    if not terms:
        return 0.0
    last: dict[str, int] = {}
    score, done = 0.0, -1
    for at, t in enumerate(places):
        if t in terms:
            last[t] = at
            if len(last) == len(terms):
                begin = min(last.values())
                if begin > done:
                    score += min(1.0, len(terms) / (at - begin + 1))
                    done = begin
    return score

"""Porter's suffix-stripping stemmer (M. F. Porter, "An algorithm for suffix
stripping", Program 14(3), 1980), steps 1a-5b as published, for lower-case ASCII
words. Used by the 'english' analyzer on the distinct vocabulary only."""

from __future__ import annotations

# The suffix rules of the published algorithm (suffix, replacement).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]

_STEP2 = sorted(STEP2, key=lambda p: -len(p[0]))
_STEP3 = sorted(STEP3, key=lambda p: -len(p[0]))
_STEP4 = sorted(STEP4, key=len, reverse=True)


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(s: str) -> int:
    """m in [C](VC)^m[V]."""
    n, i, L = 0, 0, len(s)
    while i < L and _cons(s, i):
        i += 1
    while i < L:
        while i < L and not _cons(s, i):
            i += 1
        if i >= L:
            break
        n += 1
        while i < L and _cons(s, i):
            i += 1
    return n


def _has_vowel(s: str) -> bool:
    return any(not _cons(s, i) for i in range(len(s)))


def _double_cons(s: str) -> bool:
    return len(s) >= 2 and s[-1] == s[-2] and _cons(s, len(s) - 1)


def _cvc(s: str) -> bool:
    n = len(s)
    return n >= 3 and _cons(s, n - 3) and not _cons(s, n - 2) and _cons(s, n - 1) and s[-1] not in "wxy"


def _replace(w: str, rules) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: -len(suf)]
            return stem + rep if _measure(stem) > 0 else w
    return w


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif not w.endswith("ss") and w.endswith("s"):
        w = w[:-1]
    # step 1b
    cont = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, cont = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, cont = w[:-3], True
    if cont:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2, 3
    w = _replace(w, _STEP2)
    w = _replace(w, _STEP3)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: -len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or (stem and stem[-1] in "st")):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w

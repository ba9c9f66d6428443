"""Porter stemmer (Porter 1980) with the widely used extensions of the
common open-source implementation: a small irregular-form table, words of
one or two letters left alone, ``ies``/``ied`` on four-letter words, the
y->i rule only after a consonant, ``alli`` handled first in step 2, plus
``fulli`` and ``logi`` rules, and the two-letter vowel-consonant form
counting as *o.

Pure-Python helper: it is applied once per distinct token inside an
Arrow-batched pandas UDF (see ``gradeframe.operators.lexical``).
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
IRREGULAR = {
    "sky": "sky", "skies": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# --------------------------------------------------------- end of fixed values

VOWELS = frozenset("aeiou")


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        c = _cons(stem, i)
        if c and prev_vowel:
            m += 1
        prev_vowel = not c
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    if n >= 3 and _cons(w, n - 3) and not _cons(w, n - 2) and _cons(w, n - 1):
        return w[-1] not in "wxy"
    return n == 2 and not _cons(w, 0) and _cons(w, 1)


def _first_suffix(w: str, rules):
    """The first rule whose suffix ends ``w`` (only that rule may fire)."""
    for suf, rep in rules:
        if w.endswith(suf):
            return suf, rep
    return None


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-2]
    if w.endswith("ss"):
        return w
    if w.endswith("s"):
        return w[:-1]
    return w


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if _m(w[:-3]) > 0 else w
    stem = None
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[:-len(suf)]):
            stem = w[:-len(suf)]
            break
    if stem is None:
        return w
    for suf, rep in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if stem.endswith(suf):
            return stem[:-len(suf)] + rep
    if _double_cons(stem):
        return stem[:-1] if stem[-1] not in "lsz" else stem
    if _m(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _m(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    hit = _first_suffix(w, STEP2)
    if hit is None:
        return w
    suf, rep = hit
    # For "logi" the measure is taken with the "l" kept on the stem.
    stem = w[:-3] if suf == "logi" else w[:-len(suf)]
    if _m(stem) > 0:
        return w[:-len(suf)] + rep
    return w


def _step3(w: str) -> str:
    hit = _first_suffix(w, STEP3)
    if hit and _m(w[:-len(hit[0])]) > 0:
        return w[:-len(hit[0])] + hit[1]
    return w


def _step4(w: str) -> str:
    for suf in STEP4:
        if w.endswith(suf):
            stem = w[:-len(suf)]
            ok = _m(stem) > 1 and (suf != "ion" or stem[-1:] in ("s", "t"))
            return stem if ok else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _m(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w

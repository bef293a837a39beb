"""Porter's suffix stripping (Porter 1980) with the usual published extensions.

A word is described by its letter classes (``c`` and ``v``); every rule is a row of
(suffix, replacement, minimum measure of what stays). Used per distinct token inside Arrow UDFs.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Words that keep or take a given stem.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# The suffix tables of steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)

_SYLLABLES = re.compile("v+c+")


def _classes(word: str) -> str:
    out: list[str] = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(_SYLLABLES.findall(_classes(word)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end (not w, x, y), or a two-letter vowel-consonant word."""
    classes = _classes(word)
    return (classes.endswith("cvc") and word[-1] not in "wxy") or classes == "vc"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _classes(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _classes(word[: -len(s)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_end(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(word: str) -> str:
    rest = word[:-1]
    return rest + "i" if word.endswith("y") and len(rest) > 1 and _classes(rest)[-1] == "c" else word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-2])
    for suffix, new in STEP_2:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if _measure(word[: -len(suffix)]) > 0 else word
    # The published extension measures "logi" words with their "l" kept.
    return word[:-1] if word.endswith("logi") and _measure(word[:-3]) > 0 else word


def _full_suffix(word: str) -> str:
    for suffix, new in STEP_3:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if _measure(word[: -len(suffix)]) > 0 else word
    return word


def _bare_suffix(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            fits = _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st")
            return rest if fits else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        count = _measure(rest)
        if count > 1 or (count == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 17)
def porter_stem(word: str) -> str:
    """Stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _double_suffix, _full_suffix, _bare_suffix, _tidy):
        word = step(word)
    return word

"""Porter's stemmer, in the variant with the usual extensions, by which ROUGE scores are reported."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# A word is [C](VC)^m[V]: y is a vowel after a consonant, and a consonant elsewhere.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
FIRST_VOWELS = f"(?:{CONSONANTS}[aeiouy]|[aeiou])[aeiou]*"
_AT_LEAST_1 = re.compile(f"^{FIRST_VOWELS}{CONSONANTS}")
_JUST_1 = re.compile(f"^{FIRST_VOWELS}{CONSONANTS}(?:{VOWELS})?$")
_AT_LEAST_2 = re.compile(f"^{FIRST_VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}")
_VOWEL = re.compile(f"^{FIRST_VOWELS}")

# Irregular forms, and the suffixes of steps 2, 3 and 4 with what takes their place.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _AT_LEAST_1.match(w[:-3]) else w
    for suffix in ("ed", "ing"):
        s = w.removesuffix(suffix)
        if s != w and _VOWEL.match(s):
            break
    else:
        return w
    if s.endswith(("at", "bl", "iz")):
        return s + "e"
    if len(s) > 1 and s[-1] == s[-2] and not _vowel_at(s, len(s) - 1):
        return s if s[-1] in "lsz" else s[:-1]
    return s + "e" if _JUST_1.match(s) and _short(s) else s


def _vowel_at(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel_at(w, i - 1))


def _short(w: str) -> bool:
    """Does it end in consonant, vowel, consonant other than w, x and y; or is it a vowel and a consonant."""
    if len(w) == 2:
        return _vowel_at(w, 0) and not _vowel_at(w, 1)
    return len(w) > 2 and not _vowel_at(w, len(w) - 3) and _vowel_at(w, len(w) - 2) and not _vowel_at(w, len(w) - 1) and w[-1] not in "wxy"


def _second(w: str) -> str:
    if w.endswith("alli") and _AT_LEAST_1.match(w[:-4]):
        return _second(w[:-2])
    for suffix, new in STEP_2:
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            return s + new if _AT_LEAST_1.match(s) else w
    return w[:-1] if w.endswith("logi") and _AT_LEAST_1.match(w[:-3]) else w


def _third(w: str) -> str:
    for suffix, new in STEP_3:
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            return s + new if _AT_LEAST_1.match(s) else w
    return w


def _fourth(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            return s if _AT_LEAST_2.match(s) and (suffix != "ion" or s[-1] in "st") else w
    return w


def _last(w: str) -> str:
    if w.endswith("e"):
        s = w[:-1]
        if _AT_LEAST_2.match(s) or (_JUST_1.match(s) and not _short(s)):
            w = s
    return w[:-1] if w.endswith("ll") and _AT_LEAST_2.match(w[:-1]) else w


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and not _vowel_at(w, len(w) - 2):
        w = w[:-1] + "i"
    return _last(_fourth(_third(_second(w))))


def token_stem(token: str) -> str:
    """What ROUGE makes of a token: words of more than three characters are stemmed."""
    return porter(token) if len(token) > 3 else token


def with_stems(tokens: DataFrame, token: str, out: str = "stem") -> DataFrame:
    """Rows with the stem of a token column; each distinct token is stemmed once."""
    ship_package(tokens.sparkSession)

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(token_stem)

    known = tokens.select(F.col(token).alias("_token")).where("_token is not null").distinct().select("_token", run("_token").alias(out))
    return tokens.join(known, tokens[token] == known["_token"], "left").drop("_token")

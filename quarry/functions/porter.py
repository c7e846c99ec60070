"""The Porter stemmer (1980), written from the published description of its five steps, as a pandas UDF over distinct words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix rules of the published algorithm, longest first within a step.
STEP2 = (("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """The number of vowel-consonant turns."""
    shape = _shape(stem)
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:], strict=False))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _closed(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with other than ASCII letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ing", "ed"):
            base = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _closed(base)):
                    base += "e"
                elif _double(base) and base[-1] not in "lsz":
                    base = base[:-1]
                word = base
                break
            if word.endswith(end):
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, to in rules:
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + to
                break
    for end in STEP4:
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _closed(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(values: pd.Series) -> pd.Series:
    return values.map(stem, na_action="ignore")


def stemmed(word: Column) -> Column:
    """The stem of each word. Apply it to a dictionary of distinct words, not to every token."""
    return F.pandas_udf(_stems, T.StringType())(word)

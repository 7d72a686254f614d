"""The English analyzer: possessives, stop words and the published Porter2 stemming rules.

Stems are a function of the token alone, so a corpus stems each distinct token of an Arrow batch once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = frozenset("cdeghkmnrt")
# The published exceptions.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
PREFIXES = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for k in range(start + 1, len(w)):
            if w[k] not in VOWELS and w[k - 1] in VOWELS:
                return k + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    """The word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS and w[-1] not in "wxY"


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word[1:] if word[0] == "'" else word
    if w in WHOLE:
        return WHOLE[w]
    # y that stands for a consonant is marked
    chars = list(w)
    for k, c in enumerate(chars):
        if c == "y" and (k == 0 or chars[k - 1] in VOWELS):
            chars[k] = "Y"
    w = "".join(chars)
    r1, r2 = _regions(w)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            cut = len(w) - len(suffix)
            if suffix in ("eed", "eedly"):
                if cut >= r1:
                    w = w[:cut] + "ee"
            elif any(c in VOWELS for c in w[:cut]):
                w = w[:cut]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif len(w) <= r1 and _short_syllable(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for suffix in sorted((*STEP2, "ogi", "li"), key=len, reverse=True):
        if w.endswith(suffix):
            cut = len(w) - len(suffix)
            if cut >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[cut - 1 : cut] == "l" else w
                elif suffix == "li":
                    w = w[:cut] if w[cut - 1 : cut] in LI and cut else w
                else:
                    w = w[:cut] + STEP2[suffix]
            break
    for suffix in sorted((*STEP3, "ative"), key=len, reverse=True):
        if w.endswith(suffix):
            cut = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:cut] if cut >= r2 else w
            elif cut >= r1:
                w = w[:cut] + STEP3[suffix]
            break
    for suffix in sorted((*STEP4, "ion"), key=len, reverse=True):
        if w.endswith(suffix):
            cut = len(w) - len(suffix)
            if cut >= r2 and (suffix != "ion" or w[cut - 1 : cut] in ("s", "t")):
                w = w[:cut]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def analyzed(token: str) -> list[str]:
    """What a raw lower-case token is indexed as."""
    if "가" <= token[-1] <= "힣":
        head = token.rstrip("".join(c for c in token if "가" <= c <= "힣"))
        if head:
            return [token, head, token[len(head) :]]
        return [token, *(token[k : k + 2] for k in range(len(token) - 1))] if len(token) > 2 else [token]
    bare = token[:-2] if token.endswith(("'s", "’s")) else token[:-1] if token.endswith(("'", "’")) else token
    if not bare or bare in X.STOPWORDS:
        return []
    return [bare] if bare.isdigit() else [stem(bare)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _analyzed(tokens: pd.Series) -> pd.Series:
    known: dict[str, list[str]] = {}

    def one(found):
        out: list[str] = []
        for t in found if found is not None else ():
            made = known.get(t)
            if made is None:
                made = known[t] = analyzed(t)
            out.extend(made)
        return out

    return tokens.map(one)


def english_tokens(text: Column) -> Column:
    return _analyzed(X.english_raw_tokens(text))

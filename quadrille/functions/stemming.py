"""Snowball stemming of English and Dutch words, after the published descriptions of both algorithms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English words with stems of their own, and words that step 1b leaves alone.
ENGLISH_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ENGLISH_SAME = "sky news howe atlas cosmos bias andes".split()
ENGLISH_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
# Endings of steps 2, 3 and 4, and what replaces them.
ENGLISH_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ENGLISH_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENGLISH_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_ENGLISH_REGION = re.compile(r".*?[aeiouy][^aeiouy]")
_DUTCH_REGION = re.compile(r".*?[aeiouyè][^aeiouyè]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _region(pattern: re.Pattern, word: str, start: int = 0) -> int:
    found = pattern.match(word, start)
    return found.end() if found else len(word)


@lru_cache(100_000)
def english_stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) < 3 or w in ENGLISH_SAME:
        return w
    if w in ENGLISH_FORMS:
        return ENGLISH_FORMS[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w.removeprefix("'"))
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(_ENGLISH_REGION, w)
    r2 = _region(_ENGLISH_REGION, w, r1)
    w = re.sub(r"'(?:s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in ENGLISH_KEPT:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    w = re.sub(r"(?<=.)(?<![aeiouy])(?<!^)[yY]$", "i", w) if len(w) > 2 else w
    if (end := _longest(w, ENGLISH_STEP2)) and len(w) - len(end) >= r1:
        before = w[: -len(end)][-1:]
        if (end != "ogi" or before == "l") and (end != "li" or before in set("cdeghkmnrt")):
            w = w[: -len(end)] + ENGLISH_STEP2[end]
    if (end := _longest(w, ENGLISH_STEP3)) and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + ENGLISH_STEP3[end]
    if (end := _longest(w, ENGLISH_STEP4)) and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(100_000)
def dutch_stem(word: str) -> str:
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(r"(^|[aeiouyè])y", r"\1Y", w)
    w = re.sub(r"(?<=[aeiouyè])i(?=[aeiouyè])", "I", w)
    r1 = _region(_DUTCH_REGION, w)
    r2 = _region(_DUTCH_REGION, w, r1)
    r1 = max(r1, 3)
    undoubled = lambda s: s[:-1] if s.endswith(("kk", "dd", "tt")) else s
    within = lambda s, end, region: s.endswith(end) and len(s) - len(end) >= region

    def without_en(s: str, end: str) -> str:
        rest = s[: -len(end)]
        return undoubled(rest) if re.search(r"[^aeiouyè]$", rest) and not rest.endswith("gem") else s

    def without_e(s: str) -> str:
        return undoubled(s[:-1]) if within(s, "e", r1) and re.search(r"[^aeiouyè]e$", s) else s

    end = _longest(w, ("heden", "ene", "en", "se", "s"))
    if end and len(w) - len(end) >= r1:
        if end == "heden":
            w = w[:-5] + "heid"
        elif end in ("en", "ene"):
            w = without_en(w, end)
        elif re.search(r"[^aeiouyèj]$", w[: -len(end)]):
            w = w[: -len(end)]
    shorter = without_e(w)
    removed_e, w = shorter != w, shorter
    if within(w, "heid", r2) and w[-5:-4] != "c":
        w = w[:-4]
        w = without_en(w, "en") if within(w, "en", r1) else w
    end = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(w) - len(end) >= r2:
        rest = w[: -len(end)]
        if end in ("end", "ing"):
            w = rest[:-2] if within(rest, "ig", r2) and rest[-3:-2] != "e" else undoubled(rest)
        elif end == "ig":
            w = w if rest.endswith("e") else rest
        elif end == "lijk":
            w = without_e(rest)
        elif end == "baar" or removed_e:
            w = rest
    w = re.sub(r"([^aeiouyè])(aa|ee|oo|uu)([^aeiouyèI])$", lambda m: m[1] + m[2][0] + m[3], w)
    return w.replace("I", "i").replace("Y", "y")


STEMMERS = {"en": english_stem, "nl": dutch_stem}


def stemmed(words: Column, language: str = "en") -> Column:
    """Each word of an array of strings as its stem, in Arrow batches; nulls stay."""
    stem = STEMMERS[language]

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [None if w is None else stem(w) for w in x] for x in batch], dtype="object")

    return F.pandas_udf(run, "array<string>")(words)

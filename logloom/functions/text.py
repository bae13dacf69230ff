"""From text to index terms: tokens, stop words and stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Split at every single space; neighbouring spaces give empty tokens. Case is kept."""
    return F.split(text, " ")


def stop_words(spark: SparkSession) -> list[str]:
    """Spark ML's English list."""
    return list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))


def without_stop_words(terms: Column, stops: list[str]) -> Column:
    """Terms that are not stop words, exactly as written."""
    listed = F.array(*[F.lit(s) for s in stops])
    return F.filter(terms, lambda t: ~F.array_contains(listed, t))


def shipper_tokens(text: Column) -> Column:
    """White space of any kind squeezed and stripped, then split; no empty tokens."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


# --- English stems by the published Porter2 (Snowball English) rules ---

_V = "aeiouy"
# fixed values of the published algorithm
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    after = lambda at: (x.end() + at) if (x := re.search("[aeiouy][^aeiouy]", w[at:])) else len(w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.match(r"^[aeiouy][^aeiouy]$", w))


def stem(word: str) -> str:
    """The stem of one term; terms of two characters or fewer, and capitals, are left alone."""
    w = word
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, by in _STEP2.items():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[:-3].endswith("l"):
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    for s, by in _STEP3.items():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[:-3].endswith(("s", "t")):
            w = w[:-3]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(terms: pd.Series) -> pd.Series:
    """The stems of an array of terms, by batch; null stays null."""
    known: dict[str, str] = {}

    def one(ts):
        return None if ts is None else [None if t is None else (known.get(t) or known.setdefault(t, stem(t))) for t in ts]

    return terms.map(one)


def index_terms(raw: Column, structured: Column, flat: Column, stops: list[str], stemmed: bool = True) -> Column:
    """The terms a line is found by: of a text its tokens, of a JSON object the tokens of all its
    leaves, without stop words, stemmed. Other JSON has none."""
    leaves = F.flatten(F.transform(F.flatten(F.map_values(flat)), tokens))
    t = F.when(structured, F.coalesce(leaves, F.array().cast("array<string>"))).otherwise(tokens(raw))
    t = without_stop_words(t, stops)
    return stems(t) if stemmed else t

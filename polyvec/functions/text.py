"""Tokens of texts: pattern, stop words, stems, truncation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = tuple(
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so such than that the their them then there these they this to was we were what when which who will with you your".split()
)


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, without stop words; none for a null text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    if not stop_words:
        return found
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def shorten(text: Column, words: int) -> Column:
    """The first ``words`` words set off by white space, with ``" ..."`` if there were more."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")
    cut = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(cut, F.lit(" ..."))).otherwise(cut)


def join_title(title: Column, body: Column) -> Column:
    """Title and body joined by ". "; a null or blank title is left out, a null body is empty."""
    body = F.coalesce(body, F.lit(""))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", body).otherwise(F.concat_ws(". ", title, body))


_V = "aeiouy"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_SAME_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": None, "li": None}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": None, "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)

    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _ends_short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def stem(word: str) -> str:
    """The stem of a lower-case English word, by the published Snowball rules."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _SAME_1A:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end.startswith("eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif re.search("[aeiouy]", w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                    w = w[:-1]
                elif r1 >= len(w) and _ends_short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    for end in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ative":
                    w = w[:at] if at >= r2 else w
                else:
                    w = w[:at] + _STEP3[end]
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column) -> Column:
    """Stems of an array of words, by batches; words repeat, so each batch stems a word once."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        return column.map(lambda row: None if row is None else [one(w) for w in row])

    return run(words)

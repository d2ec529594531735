"""English full-text matching: tokens, stop words and the public Snowball English (Porter 2) stemmer."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
#: Words the stemmer treats apart.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | dict.fromkeys("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        found = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
        return found.end() if found else len(w)

    lead = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    r1 = lead or after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w] or w
    # A y that begins a word or follows a vowel is a consonant, written Y meanwhile.
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", w))
    r1, r2 = _regions(w)
    w = re.sub(r"'(?:s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_VOWEL}].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        found = re.search(r"(?:ingly|edly|ing|ed)$", w)
        if found and re.search(f"[{_VOWEL}]", w[: found.start()]):
            w = w[: found.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or re.search(r"[cdeghkmnrt]li$", w)):
                w = w[: -len(end)] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w.endswith(("sion", "tion"))):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str) -> set[str]:
    words = (w.lower() for w in re.findall(r"[^\W_]+(?:'[^\W_]+)*", text))
    return {s for w in words if w not in STOP_WORDS for p in w.split("'") if p and p not in STOP_WORDS for s in (stem(p),)}


def strings(value) -> list[str]:
    """All strings inside a JSON value, keys apart."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = value.values()
    elif not isinstance(value, list):
        return []
    return [s for x in value for s in strings(x)]


def finder(wanted: set[str]) -> re.Pattern:
    """Words that may have one of these stems: stemming keeps the first letter, and of longer stems the first three."""
    heads = sorted({re.escape(w[:3] if len(w) > 3 else w[:1]) for w in wanted})
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(heads)})[^\W_]*", re.IGNORECASE)


def stored_match(stems: Column, term: str) -> Column | bool:
    """matches() on stored stems, without Python."""
    wanted = sorted(lexemes(term))
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), stems)) == 0 if wanted else False


def matches(text: Column, term: str, is_json: bool = False) -> Column | bool:
    """Whether text holds every lexeme of term; a term without lexemes matches nothing.

    Stemming runs in Arrow batches, only on texts in which a word begins like each longer lexeme, and there only on words
    that begin like one.
    """
    wanted = lexemes(term)
    if not wanted:
        return False
    words = finder(wanted)

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return False
            found = words.findall(" ".join(strings(json.loads(t))) if is_json else t)
            return wanted <= {stem(w.lower()) for w in found if w.lower() not in STOP_WORDS}

        return column.map(one).astype(bool)

    likely = [text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){w[:3]}") for w in sorted(wanted) if len(w) > 3 and w[:3].isascii() and w[:3].isalpha()]
    out = F.when(text.isNull(), False)
    for p in likely:
        out = out.when(~p, False)
    return out.otherwise(holds(text))

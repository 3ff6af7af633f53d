"""The English stemming algorithm Porter2, after its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
#: Irregular words, words left alone at once, and words left alone after the first step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": None, "li": None,
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": None}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _after_first_pair(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    found = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
    return start + found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after_first_pair(word, 0)
    return r1, _after_first_pair(word, r1)


def _ends_in_short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in UNCHANGED:
        return word
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):  # step 0
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # Step 1a
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_LATER:
        return w.lower()
    # Step 1b
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{VOWELS}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_in_short_syllable(w):
            w += "e"
    # Step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Step 2
    s = _longest(w, STEP_2)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] in tuple(LI_ENDINGS) else w
        else:
            w = w[: -len(s)] + STEP_2[s]
    # Step 3
    s = _longest(w, STEP_3)
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + STEP_3[s]
    # Step 4
    s = _longest(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    # Step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_in_short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()

"""The engine analyzer: ASCII words that may hold ``- + # .``, without stop words, stemmed.

Which rule applies depends on the neighbours of a symbol, so a text is read once from left to right
over its UTF-8 bytes; bytes beyond ASCII end words.  Rules: a symbol outside a word starts one only
before a letter or digit.  Inside a word it is kept before a letter, digit or symbol; before anything
else, and at the end of the text, it is kept while the word has at most three characters, and else ends
the word without it.  A word that white space or another character ends loses symbols at its end, up to a ``+``
or ``-`` that isn't its only character; at the end of the text nothing is cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzers import ENGINE_STOP_WORDS
from .stemmer import stem

SYMBOLS = frozenset(b"-+#.")
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_STOP = frozenset(ENGINE_STOP_WORDS)


def surface_tokens(text: str) -> list[str]:
    raw, words, word = (text or "").encode(), [], bytearray()
    for i, c in enumerate(raw):
        following = raw[i + 1] if i + 1 < len(raw) else None
        if c in ALNUM:
            word.append(c)
        elif c in SYMBOLS:
            if following in ALNUM or (word and following in SYMBOLS):
                word.append(c)
            elif word and len(word) <= 3:
                word.append(c)
            elif word:
                words.append(bytes(word))
                word.clear()
        elif word:
            while word and word[-1] in SYMBOLS and not (word[-1] in b"+-" and len(word) > 1):
                word.pop()
            if word:
                words.append(bytes(word))
            word.clear()
    if word:
        words.append(bytes(word))
    return [w.decode() for w in words]


def engine_tokens(text: str) -> list[str]:
    return [stem(w.lower()) for w in surface_tokens(text) if w.lower() not in _STOP]


@F.pandas_udf(T.ArrayType(T.StringType()))
def engine_tokens_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: engine_tokens(t or ""))

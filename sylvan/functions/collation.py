"""Sort keys that order text as a dictionary does: letters by their base forms first, then by their marks; white space, punctuation, symbols, digits, letters in this order."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters that have no decomposition, and the base letters they sort with.
BASE = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "þ": "th", "ŋ": "n"}
CLASSES = {"Z": 0, "C": 0, "P": 1, "S": 2, "N": 3, "L": 4}


@lru_cache(65536)
def weights(c: str) -> tuple[tuple, tuple]:
    """Of one letter: what counts first, and what decides between texts that are alike in this."""
    first, second = [], []
    for x in unicodedata.normalize("NFKD", c.casefold() if c not in BASE else c):
        kind = unicodedata.category(x)
        if kind[0] == "M":
            second.append(ord(x))
        elif x in BASE:
            first += [(4, b) for b in BASE[x]]
            second.append(ord(x))
        elif kind == "Nd":
            first.append((3, chr(unicodedata.digit(x))))
        else:
            first.append((CLASSES[kind[0]], x))
    return tuple(first), tuple(second)


def sort_key(text: str) -> tuple:
    first, second = [], []
    for c in text:
        a, b = weights(c)
        first += a
        second.append(b)
    return tuple(first), tuple(second)

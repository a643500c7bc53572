"""Whether text looks wrong by itself, by its characters alone."""

from __future__ import annotations

import re
import unicodedata

_LOST = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]")
#: signs that stand in clean text
_FAIR_SIGNS = set("\u2014\u2013\u2026\xab\xbb\u201e\u201c\u201d\u2018\u2019\u201a\u2022\xb7\xb0\xb1\xd7\xf7\xb5\xbd\xbc\xbe\u20ac\xa3\xa5\xa7\xa9\xae\u2122\u2116\u2192\u2190\u2191\u2193\u2713\u2717\u2264\u2265\u2248\u2260\u221e\xbf\xa1\xaa\xba\xb2\xb3\xb9\u2030\u3001\u3002\u30fb\u300c\u300d\uff08\uff09\uff1a\uff1b\uff01\uff1f\ufeff\u200b")
#: signs that may follow a word's last letter in clean text
_CLOSING = set("\u2026\xbb\u201c\u201d\u201e\u2018\u2019\u201a\u2013\u2014\u2022\xb7")


def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def odd(phrase: str) -> bool:
    """Whether a phrase looks wrong by itself: lost characters, signs within text, scripts mixed or capitals inside a word."""
    if _LOST.search(phrase):
        return True
    for word in phrase.split(" "):
        scripts = set()
        for i, c in enumerate(word):
            if c.isascii():
                if c.isalpha():
                    scripts.add("LATIN")
                continue
            cat = unicodedata.category(c)
            if cat[0] == "L":
                s = script(c)
                scripts.add({"HIRAGANA": "CJK", "KATAKANA": "CJK", "HANGUL": "CJK", "MICRO": "LATIN", "FEMININE": "LATIN", "MASCULINE": "LATIN"}.get(s, s))
            elif cat[0] not in "MN" and c not in _FAIR_SIGNS:
                return True
        letters = [c for c in word if c.isalpha()]
        if "GREEK" in scripts and len(letters) <= 3:
            scripts.discard("GREEK")
        if len(scripts) > 1:
            return True
        if any(a.islower() and b.isupper() and not b.isascii() for a, b in zip(letters, letters[1:])):
            return True
    return False


def telling(phrase: str, garbled: str) -> bool:
    """Whether a sequence cannot be clean text by chance: a sign joined to a letter, unless it may close the word."""
    signs = [c for c in garbled[1:] if c in _FAIR_SIGNS or unicodedata.category(c)[0] not in "LM"]
    if not signs:
        return False
    return garbled[-1] not in _CLOSING or re.search(re.escape(garbled) + r"\w", phrase) is not None

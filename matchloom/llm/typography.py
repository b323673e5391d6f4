"""Texts freed from typography: what looks alike becomes alike."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that are used in place of Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухкмтвніјѕԁոАЕОРСУХКМТВНІЈЅαοενρτυικ",
    "aeopcyxkmtbhijsdnAEOPCYXKMTBHIJSaoevptuik",
)
# Letters that do not decompose into a base letter.
PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d"})
_UNSEEN = re.compile("[­͏​-‏‪-‮⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[a-z0-9]+")
_COMBINING = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)) + "]+")
_REPLACED = LOOKALIKES | PLAIN
_TO_REPLACE = re.compile("[" + "".join(map(chr, _REPLACED)) + "]")


def plain(text: str) -> str:
    """Lower case without accents, ligatures, unseen characters and look-alike letters."""
    if text.isascii():
        return text.lower()
    text = _UNSEEN.sub("", text)
    if _TO_REPLACE.search(text):
        text = text.translate(_REPLACED)
    return _COMBINING.sub("", unicodedata.normalize("NFKD", text)).lower()


def whole_words(text: str) -> str:
    """The text with words that a hyphen breaks at a line's end made whole."""
    return text.replace("-\n", "") if "-\n" in text else text


def words(text: str) -> list[str]:
    """Words of letters a-z and digits of the plain text; words broken by a hyphen at a line's end are whole."""
    return _WORD.findall(whole_words(plain(text)))

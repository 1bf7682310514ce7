"""Words of Indic and Latin text in the forms in which the operators of this subpackage compare them."""

from __future__ import annotations

import re
import unicodedata

_BLOCK = [c for c in range(0x900, 0x980) if not 0x964 <= c <= 0x96F]
TO_DEVANAGARI = {c + 0x180: chr(c) for c in _BLOCK}
#: Zero-width and soft characters.
INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: Letters of the three scripts with their signs; dandas, digits and punctuation part words.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯḀ-ỿऀ-ॣॱ-ॿ]+")
#: Spelling variants that count as one, and signs that count as none.
FOLDS = dict(zip("णषशबळीूईऊैौऐऔँ", "नससवलिुइउेोएओं"))
SKELETON = str.maketrans(FOLDS | {"्": None, "़": None})
_MARKS = re.compile("[̀-ͯ]+")


def plain_words(text: str) -> list[str]:
    """Lower-case words, Gujarati letters as Devanagari ones, without digits and punctuation."""
    return WORD.findall(INVISIBLE.sub("", unicodedata.normalize("NFC", text)).lower().translate(TO_DEVANAGARI))


def folded(word: str) -> str:
    """The word with spelling variants folded and accents dropped."""
    if word.isascii():
        return word
    if word[0] >= "ऀ":
        return word.translate(SKELETON)
    return _MARKS.sub("", unicodedata.normalize("NFD", word))

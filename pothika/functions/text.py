"""Text functions: as Spark expressions, and in Python for the operators that fold over a book."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..fixed_values import DANDAS, DEVANAGARI_BLOCK, FOLD_DROP, FOLD_FROM, FOLD_TO, FURNITURE_KEY, GUJARATI_BLOCK, LETTER, ZERO_WIDTH

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFD}]"
_NOT_KEY = r"[^\x{0900}-\x{0963}\x{0971}-\x{097F}]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. Spark has no such function; the text leaves the JVM only where a sign can compose or decompose."""
    risky = text.rlike(r"[\x{0300}-\x{036F}\x{093C}\x{0ABC}\x{0958}-\x{095F}\x{0929}\x{0931}\x{0934}\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]")
    return F.when(risky, _composed(F.when(risky, text))).otherwise(text)


def gujarati_to_devanagari(text: Column) -> Column:
    return F.translate(text, GUJARATI_BLOCK, DEVANAGARI_BLOCK)


def devanagari_to_gujarati(text: Column) -> Column:
    pairs = [(a, b) for a, b in zip(DEVANAGARI_BLOCK, GUJARATI_BLOCK) if a not in DANDAS]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def script_of(text: Column) -> Column:
    """The script of most letters; '' if neither; Devanagari on a tie."""
    text = F.coalesce(text, F.lit(""))
    guja = F.regexp_count(text, F.lit(r"[\x{0A80}-\x{0AFF}]"))
    deva = F.regexp_count(text, F.lit(r"[\x{0900}-\x{0963}\x{0966}-\x{097F}]"))
    return F.when(guja + deva == 0, "").when(guja > deva, "Gujarati").otherwise("Devanagari")


def light(text: Column) -> Column:
    """Readable text in one script: composed, ASCII digits, one danda spelling, single spaces; line ends stay."""
    out = F.translate(nfc(F.coalesce(text, F.lit(""))), ZERO_WIDTH, "")
    out = F.regexp_replace(out, _CONTROL, " ")
    out = F.translate(gujarati_to_devanagari(out), "०१२३४५६७८९", "0123456789")
    out = F.replace(F.replace(out, F.lit("।।"), F.lit("॥")), F.lit("||"), F.lit("॥"))
    return F.regexp_replace(F.replace(out, F.lit("|"), F.lit("।")), r"[ \t\r\f\x0b]+", " ")


def key_of_light(text: Column) -> Column:
    """Folded Devanagari letters of a text that is light already; made once, so that offsets can't drift."""
    return F.translate(F.translate(F.regexp_replace(text, _NOT_KEY, ""), FOLD_DROP, ""), FOLD_FROM, FOLD_TO)


def key(text: Column) -> Column:
    return key_of_light(light(text))


def without_markup(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\{[^}]*\}", ""), F.lit("#"), F.lit(""))


def segments(text: Column) -> Column:
    """The pieces between ellipses, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\.{3,}|…"), lambda x: F.trim(x)), lambda x: x != "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{2063}]+", " "))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER))


def shortened(text: Column, most: int = 400) -> Column:
    """Text of more than `most` signs cut back to its last space, with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", ""), F.lit(" …")))


def furniture_key(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, FURNITURE_KEY, " "))


def grams(key: Column, n: int = 4) -> Column:
    """All overlapping n-grams, in order."""
    return F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


# ---- the same in Python, for folds over whole books
_LIGHT_TABLE = {ord(c): None for c in ZERO_WIDTH}
_SCRIPT_TABLE = str.maketrans(GUJARATI_BLOCK, DEVANAGARI_BLOCK)
_DIGIT_TABLE = str.maketrans("०१२३४५६७८९", "0123456789")
_KEY_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
_PY_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")
_PY_LETTER = re.compile("[ऀ-ॣ॰-ॿ઀-૥૰-૿A-Za-z]")


def py_light(text: str) -> str:
    t = _PY_CONTROL.sub(" ", unicodedata.normalize("NFC", text or "").translate(_LIGHT_TABLE)).translate(_SCRIPT_TABLE).translate(_DIGIT_TABLE)
    return re.sub("[ \t\r\f\v]+", " ", t.replace("।।", "॥").replace("||", "॥").replace("|", "।"))


def is_key(c: str) -> bool:
    return ("ऀ" <= c <= "ॣ" or "ॱ" <= c <= "ॿ") and c not in FOLD_DROP


def py_key(text: str, is_light: bool = False) -> str:
    return "".join(filter(is_key, text if is_light else py_light(text))).translate(_KEY_TABLE)


def key_places(light_text: str) -> list[int]:
    """Offset in the light text of each letter of its key."""
    return [i for i, c in enumerate(light_text) if is_key(c)]


def py_letters(text: str) -> int:
    return len(_PY_LETTER.findall(text))

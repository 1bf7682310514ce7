"""Problem 1: text that was decoded with the wrong character encoding, wholly or in places.

For every pair (right encoding, wrong encoding) and every character of interest the garbled sequence is
computed beforehand, as are those of a second garbling. An Aho-Corasick automaton over all sequences runs over
each text; of overlapping matches the leftmost longest is taken, and only matched spans are replaced, so right
text beside them stays as it is. The automaton is built once per task, its size depends on the tables here only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 bytes are read by mistake.
WRONG = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-9", "iso8859-15", "mac-roman", "mac-cyrillic", "koi8-r", "koi8-u", "cp437", "cp850", "cp852", "cp866"]
#: Encodings whose garbled text is looked for when it was garbled a second time.
TWICE = ["latin-1", "cp1252", "mac-roman", "cp437", "cp850", "cp1251"]
#: Legacy encodings of Latin text and those they are mistaken for, where the result is two signs or more.
LOST = "�"
#: Characters that the garbled sequences are made of: both scripts, accented Latin, typographic signs.
BLOCKS = [(0x0900, 0x097F), (0x0A80, 0x0AFF), (0x00A0, 0x017F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A8, 0x20BA)]
SINGLES = "™′″∥−、。，　﻿"
#: Leading two bytes of the three of a letter of both scripts: enough to know a sequence whose end is lost.
LEADS = [b"\xe0\xa4", b"\xe0\xa5", b"\xe0\xaa", b"\xe0\xab"]
#: A text without any such character can't hold a garbled sequence: all of them contain one.
SUSPECT = r"[^\x00-\x7Fऀ-ॿ઀-૿–—‘-‟]"


def _read(data: bytes, wrong: str) -> str:
    """data read in the wrong encoding; bytes that it leaves undefined come out as controls, as programs do it."""
    out = []
    for byte in data:
        try:
            out.append(bytes([byte]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


@cache
def garbled_sequences() -> dict[str, str]:
    """Garbled sequence -> right text; a sequence whose letter can't be known -> the replacement character."""
    found: dict[str, str] = {}
    chars = [chr(c) for lo, hi in BLOCKS for c in range(lo, hi + 1)] + list(SINGLES)
    indic = "".join(chr(c) for lo, hi in BLOCKS[:2] for c in range(lo, hi + 1))

    def note(text: str, right: str) -> None:
        if len(text) > 1 and not text.isascii() and not all(c in indic for c in text):
            found.setdefault(text, right)

    for wrong in WRONG:
        for c in chars:
            note(_read(c.encode(), wrong), c)
    for first in TWICE:
        for second in TWICE if first in TWICE[:2] else [first]:
            if second in TWICE[:2] or second == first:
                for c in chars:
                    note(_read(_read(c.encode(), first).encode(), second), c)
    # the ends of letters can be lost: cut off, replaced by a question mark or by the replacement character
    for wrong in WRONG:
        for lead in LEADS:
            for end in (LOST, "?", ""):
                note(_read(lead, wrong) + end, LOST)
    for first in TWICE[:2]:
        for second in TWICE[:2]:
            for lead in LEADS:
                note(_read(_read(lead, first).encode(), second), LOST)
    found[LOST] = LOST
    return found


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for text, right in garbled_sequences().items():
        machine.add_word(text, (len(text), right))
    machine.make_automaton()
    return machine


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, right text) of the garbled sequences of text: leftmost longest, none overlapping."""
    best: dict[int, tuple[int, str]] = {}
    for last, (n, right) in _automaton().iter(text):
        start = last - n + 1
        if start not in best or best[start][0] < n:
            best[start] = (n, right)
    out, free = [], 0
    for start in sorted(best):
        n, right = best[start]
        if start >= free:
            out.append((start, start + n, right))
            free = start + n
    return out


def repair(text: str) -> tuple[str, int, int]:
    """(text with its garbled spans replaced, number of garbled runs, characters lost for good)."""
    found = spans(text)
    if not found:
        return text, 0, 0
    parts, at, runs, lost = [], 0, 0, 0
    for start, end, right in found:
        runs += start > at or not parts
        parts += [text[at:start], right]
        lost += right == LOST
        at = end
    return "".join(parts) + text[at:], runs, lost


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, repaired, runs, lost) of every row whose text holds a garbled run.

    Null, empty and clean texts give no row, repeated rows repeated rows, an empty table none. Lost letters come
    out as the replacement character.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, repaired string, runs int, lost int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *repair(t)) for k, t in zip(batch[key], batch[text])]
            yield pd.DataFrame([r for r in rows if r[2]], columns=[key, "repaired", "runs", "lost"])

    return df.select(key, text).filter(F.col(text).rlike(SUSPECT)).mapInPandas(run, schema)

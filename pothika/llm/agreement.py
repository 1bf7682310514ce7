"""How far two texts agree, word by word: moved parts count as agreeing, misread words in part."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from .words import folded, plain_words

#: Letters that stand for others in both scripts where print is bad, without a change of meaning here.
_READINGS = str.maketrans("ङ", "ड")
_MARKUP = re.compile(r"\{[^}]*\}|#")


@lru_cache(200_000)
def compared_words(text: str) -> tuple[str, ...]:
    """The folded words of a text without editorial markup; () for a text without letters."""
    return tuple(x for w in plain_words(_MARKUP.sub("", text)) if (x := folded(w).translate(_READINGS)))


@lru_cache(500_000)
def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance if it is at most `most`, else most + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    row = list(range(m + 1))
    for i in range(1, n + 1):
        left, row[0] = row[0], i
        for j in range(1, m + 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a[i - 1] != b[j - 1]))
        if min(row) > most:
            return most + 1
    return row[m]


@lru_cache(200_000)
def _places(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(places: dict[str, int], n: int, b: str) -> int:
    """Letters of a longest common subsequence with a word of n letters at these places."""
    full = row = (1 << n) - 1
    for c in b:
        hit = row & places.get(c, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def matched(a: tuple[str, ...], b: tuple[str, ...], need: float = 0) -> tuple[int, int]:
    """(letters, words) of a and b that agree, in any order.

    Equal words are set off first, then each word left of a goes to the most similar one left of b of which at most
    two fifths differ; ties go to the earlier one. What can't reach `need` letters any more is given up as it is then.
    """
    left: dict[str, int] = {}
    for w in b:
        left[w] = left.get(w, 0) + 1
    letters = words = 0
    rest = []
    for w in a:
        if left.get(w):
            left[w] -= 1
            letters += len(w)
            words += 1
        else:
            rest.append(w)
    free = [w for w, n in left.items() for _ in range(n)]
    # a pair has no more letters that agree than the shorter of its words
    hope, open_ = size(rest), size(free)
    for w in rest:
        if letters + min(hope, open_) < need - 1e-6:
            break
        hope -= len(w)
        best, at, n, places = 1 << 30, -1, len(w), _places(w)
        for i, x in enumerate(free):
            longer = n if n > len(x) else len(x)
            most = longer * 2 // 5
            # a distance is no less than what the longer word has beyond the common letters
            if most and longer - _common(places, n, x) <= most and (d := edits(w, x, min(most, best))) <= most and d < best:
                best, at = d, i
        if at >= 0:
            letters += max(0, max(len(w), len(free[at])) - best)
            words += 1
            open_ -= len(free.pop(at))
    return letters, words


def size(words: Iterable[str]) -> int:
    return sum(map(len, words))

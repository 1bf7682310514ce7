"""Problem 2: words divided at line ends, misread characters, running heads and page numbers in text of scanned pages.

1. Lines that the library repeats (problem 6) and garbled lines (problem 1) are set aside.
2. Edge lines of each book are grouped by their words with digits masked: what stands on many pages, or resembles the
   book's name, is a running head. Numbers alone at the edges whose distance to the page's place recurs are page numbers.
3. One pass over the texts gives the words of each line. They are counted over all pages and grouped by a skeleton in which
   confusable glyphs are one. Within a group a form that trusted pages don't support and that a far more frequent form
   explains by confusions may be a misreading of it. Neighbouring words decide at each place: the explaining form that
   stands beside the same neighbours elsewhere comes first, and one that trusted pages lack needs them. A word that
   trusted pages do support is a misreading where between the same two neighbours a similar one is far more usual.
4. Texts are put together again with SQL windows: heads and numbers go, divided words are joined, prose lines run on,
   verse lines stay.

Words, forms and contexts meet the places by joins, of whatever size; only tables whose size was counted go to all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..session import broadcast_if_small, cut, salted_lookup
from . import boilerplate
from .agreement import edits
from .garbled import SUSPECT, spans
from .words import TO_DEVANAGARI, folded

#: Repeated lines that go to all tasks as they are; more come to the pages by a join.
SHIPPED = 100_000
#: A head stands on this share of a book's pages, and on three; a form explains one that is this many times rarer;
#: share of a misreading's places that may be on trusted pages.
HEAD_SHARE, HEAD_PAGES, TIMES, TRUSTED, ENDING_SHARE = 0.05, 3, 5, 0.03, 0.02
#: Signs by which a line end divides a word.
_HYPHENS = "-‐‑¬\u00ad"
_DIVIDED = re.compile(r"[^\W\d_\-‐¬][ऀ-ॣઁ-૥]*[-‐‑¬­]\s*$")
_DIVIDED_WORD = re.compile(r"\S*[^\W\d_\-‐¬][ऀ-ॣઁ-૥]*[-‐‑¬­]\s*\n\s*\S*")
_DIGITS = str.maketrans("०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")
_NUMBER_LINE = re.compile(r"[\s\-–—()\[\]{}.|।॥:*·•~_]*(\d{1,5})[\s\-–—()\[\]{}.|।॥:*·•~_]*")
_VERSE_NUMBER = re.compile(r"\s*(?:[।॥|]+\s*\d+\s*[।॥|]+|\.{2,}\s*\d+\s*\.{2,})\s*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ̀-ͯḀ-ỿऀ-ॣॱ-ॿઁ-૥૰-૿"
_NOT_LETTERS = re.compile(f"[^{_LETTERS}]+")
_SUSPECT = re.compile(SUSPECT)
#: What parts tokens: white space, dandas, brackets, quotation marks, dashes and hyphens, leaders.
_PARTS = re.compile(r"[\s।॥,:()\[\]{}“”\"—–\-‐‑¬…•†‡§©#<>?/\\]+|\.{2,}")
_EDGES = "'‘’`.;!|*~^=+_"

#: Confusable glyphs: each group counts as one. Fixed values, seen in scans of both scripts.
GLYPHS = ["कफ", "तनलळ", "यथपष", "डङदह", "वब", "चज", "खघध", "टढ", "गण", "मभ", "ecoaé", "hb", "rvτ", "il", "nu", "tf"]
#: Foreign signs that stand for a letter or sign, and those letters.
STANDS_FOR = {
    "1": "ािेil", "l": "ािेi", "|": "ाl", "2": "र", "२": "र", "१": "र", "૨": "र", "૧": "र", "f": "ि", "[": "ि", "t": "ी", "'": "ं्ँ", "л": "त",
    "4": "स", "7": "ग", "a": "व", "o": "ल", "q": "प", "H": "म", "h": "म", ";": "ु", "0": "o", "!": "i", "@": "a", "+": "t", "5": "s", "8": "B", "3": "उ", "6": "b", "9": "g",
}
#: Signs confused with each other.
SIGNS = ["ोौा", "ीौ", "ेै", "ुू", "िी"]
#: Pairs of letters read as one or one as a pair.
PAIRS = [("li", "h"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("मा", "स"), ("ii", "u"), ("रव", "ख")]
_SIGN = set("ािीुूृेैोौंँः़्ॉॅ")
_NOISE = set("'`~*.=^;,!|_+\"°¨")


def _classes() -> dict[str, str]:
    """Glyph -> the first of its class; overlapping groups become one class."""
    out: dict[str, str] = {}
    for group in GLYPHS:
        heads = {out[c] for c in group if c in out} | {group[0]}
        head = min(heads)
        for c in [*out]:
            if out[c] in heads:
                out[c] = head
        for c in group:
            out[c] = head
    return out


_CLASS = _classes()
_INDIC, _GUJARATI = re.compile("[ऀ-ॿ]"), re.compile("[અ-૿]")


def _skeleton_map(indic: bool) -> dict[int, str | None]:
    """What each glyph is in a skeleton: its class, nothing for signs and marks; a foreign sign counts as the letter it stands for."""
    out: dict[int, str | None] = {ord(c): h for c, h in _CLASS.items()}
    out |= {ord(c): None for c in _SIGN | _NOISE}
    for c, to in STANDS_FOR.items():
        letter = next((x for x in to if x not in _SIGN and (x >= "ऀ") == indic), None)
        if letter or indic:
            out[ord(c)] = _CLASS.get(letter, letter) if letter else None
    return out


_TO_SKELETON = {True: _skeleton_map(True), False: _skeleton_map(False)}


def skeleton(word: str) -> str:
    """The key under which a word and its misreadings meet. Indic words lose their signs."""
    w = word.translate(TO_DEVANAGARI)
    indic = bool(_INDIC.search(w))
    for a, b in PAIRS:
        if (b >= "ऀ") == indic:
            w = w.replace(a, b)
    # forms of one script explain each other
    return ("ગ" if w != word and _GUJARATI.search(word) else "") + w.translate(_TO_SKELETON[indic])


def _confusable(a: str, b: str) -> bool:
    """Whether a can have been read as b."""
    if b in STANDS_FOR and a in STANDS_FOR[b]:
        return True
    if any(a in g and b in g for g in GLYPHS) or any(a in g and b in g for g in SIGNS):
        return True
    return a in "ािीुूेैोौ" and b in "1l|ft[;'"


def explained(right: str, read: str, most: int) -> bool:
    """Whether `read` comes from `right` by at most `most` confusions: a glyph for a similar one, a sign lost or added,
    a mark inserted, a pair for a letter."""
    a, b = right.translate(TO_DEVANAGARI), read.translate(TO_DEVANAGARI)
    seen = {(0, 0): 0}
    stack = [(0, 0, 0)]
    while stack:
        i, j, c = stack.pop()
        while i < len(a) and j < len(b) and a[i] == b[j]:
            # branch where a doubled glyph could align otherwise
            if c < most and (b[j] in _SIGN or b[j] in _NOISE) and seen.get((i, j + 1), 9) > c + 1:
                seen[i, j + 1] = c + 1
                stack.append((i, j + 1, c + 1))
            i, j = i + 1, j + 1
        if i == len(a) and j == len(b):
            return True
        if c == most:
            continue
        steps = []
        if i < len(a) and j < len(b) and _confusable(a[i], b[j]):
            steps.append((i + 1, j + 1))
        if j < len(b) and (b[j] in _SIGN or b[j] in _NOISE):
            steps.append((i, j + 1))
        if i < len(a) and a[i] in _SIGN:
            steps.append((i + 1, j))
        for x, y in PAIRS:
            if a.startswith(y, i) and b.startswith(x, j):
                steps.append((i + len(y), j + len(x)))
            if a.startswith(x, i) and b.startswith(y, j):
                steps.append((i + len(x), j + len(y)))
        for x, y in steps:
            if seen.get((x, y), 9) > c + 1:
                seen[x, y] = c + 1
                stack.append((x, y, c + 1))
    return False


class _Tokens(dict):
    """Piece of a line -> the word it is, '' for none; kept, as pieces recur."""

    def __missing__(self, piece: str) -> str:
        t = piece.strip(_EDGES)
        if t and not t.isdigit() and t[-1] == "0":
            t = t.rstrip("0").strip(_EDGES)
        if not t or t.isdigit():
            t = ""
        elif not "ऀ" <= t[0] <= "૿":
            t = t.lower()
        if len(self) > 200_000:
            self.clear()
        self[piece] = t
        return t


_token = _Tokens()


def tokens(line: str) -> list[str]:
    """The words of a line, lower case, without punctuation at their edges and refrain marks; numbers are none."""
    return [t for piece in _PARTS.split(line) if (t := _token[piece])]


#: Marks inside a word, put there by misreading.
_INSIDE = re.compile(f"(?<=[{_LETTERS}])['`~*.=^;!|+_२१૨૧0-9]+(?=[{_LETTERS}])")


@lru_cache(20_000)
def _head_words(line: str) -> list[str]:
    """The folded words of an edge line without numbers and brackets, sorted."""
    line = _INSIDE.sub("", line.translate(TO_DEVANAGARI))
    return sorted(folded(w) for w in _NOT_LETTERS.sub(" ", line).lower().split())


def _number_of(line: str) -> int | None:
    m = _NUMBER_LINE.fullmatch(line)
    return int(m[1]) if m else None


#: What can stand before the first letter of a repeated line.
_OUTER = " \t\u00a0\u2000\u2005\u2009\u200b\u202f\u3000\ufeff.,:;!?-–—|•†‡§©#*<>()[]{}“”\"'=+/\\_~0123456789०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯।॥"


class Repeated:
    """The repeated lines of a library, as letters, with their beginnings for a quick look."""

    def __init__(self, letters: set[str]):
        self.known = letters
        self.begins = _Begins(letters)


class _Begins:
    """Whether a line may begin as a repeated one; a sign that is no letter says nothing."""

    def __init__(self, letters: set[str]):
        self.firsts = {x[0] for x in letters if x}

    def __contains__(self, start: str) -> bool:
        return not start or start[0] in self.firsts or not start[0].isalpha()


def letters_of(line: str) -> str:
    return _NOT_LETTERS.sub("", line).lower()


class Page:
    """The lines of a page: which are empty, repeated by the library or garbled, and which stand at its edges.

    edges_only: lines are looked at from both ends, until four of each end are known.
    """

    def __init__(self, text: str, repeated: Repeated | None = None, edges_only: bool = False):
        self.lines = lines = text.split("\n")
        self.garbled: set[int] = set()
        self.repeated: list[int] = []
        suspect = bool(_SUSPECT.search(text))

        def is_body(i: int) -> bool:
            line = lines[i]
            if not line or line.isspace():
                return False
            if repeated and line.lstrip(_OUTER)[:1].lower() in repeated.begins and letters_of(line) in repeated.known:
                self.repeated.append(i)
                return False
            if suspect and _SUSPECT.search(line) and spans(line):
                self.garbled.add(i)
                return False
            return True

        if edges_only:
            first = [i for i, _ in zip((i for i in range(len(lines)) if is_body(i)), range(4))]
            last = [i for i, _ in zip((i for i in range(len(lines) - 1, first[-1] if len(first) == 4 else len(lines), -1) if is_body(i)), range(4))]
            self.body = first + last[::-1]
        else:
            self.body = [i for i in range(len(lines)) if is_body(i)]

    def ends(self) -> tuple[dict[int, int], list[int]]:
        """(numbers that stand alone at the edges, by line; the first and the last other line)."""
        ends = self.body[:2] + self.body[2:][-2:]
        numbers = {i: n for i in ends if (n := _number_of(self.lines[i])) is not None}
        rest = [i for i in self.body[:3] if i not in numbers][:1] + [i for i in self.body[-3:] if i not in numbers][-1:]
        return numbers, [i for i in dict.fromkeys(rest) if len(self.lines[i]) <= 80]


# ---------------------------------------------------------------- tables


Known = Callable[[str, object], Repeated | None]


def _with_repeated(pages: DataFrame, frequent: DataFrame, shipped: int = SHIPPED) -> tuple[DataFrame, Known]:
    """pages with a column `_repeated`, and what gives the repeated lines of a row's library from it.

    They go to all tasks if their counted rows are few; then the column is empty, else it holds the library's lines.
    """
    frequent = cut(frequent.select("library", "letters"))
    if frequent.limit(shipped + 1).count() <= shipped:
        lines: dict[str, set[str]] = {}
        for lib, letters in frequent.collect():
            lines.setdefault(lib, set()).add(letters_of(letters))
        table = pages.sparkSession.sparkContext.broadcast({lib: Repeated(known) for lib, known in lines.items()})
        return pages.withColumn("_repeated", F.lit(None).cast("array<string>")), lambda lib, _: table.value.get(lib)
    # at most (lines of a page / share) lines a library
    joined = salted_lookup(pages, frequent.groupBy("library").agg(F.collect_set("letters").alias("_repeated")), "library", "left")
    kept: dict[str, Repeated | None] = {}

    def known(lib: str, letters: object) -> Repeated | None:
        if lib not in kept:
            if len(kept) > 1000:
                kept.clear()
            kept[lib] = None if letters is None else Repeated({letters_of(x) for x in letters})
        return kept[lib]

    return joined, known


def _edge_rows(pages: DataFrame, known: Known) -> DataFrame:
    """(page_id, book, page, words, last, value): words of an edge line, sorted, its last word and its number; or a number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = []
            for k, book, page, lib, text, repeated in _rows(part, "page_id", "book", "page", "library", "text", "_repeated"):
                p = Page(text, known(lib, repeated), edges_only=True)
                numbers, edges = p.ends()
                for n in numbers.values():
                    rows.append((k, book, page, None, None, n))
                for i in edges:
                    words = _head_words(p.lines[i])
                    if 0 < len(words) <= 8:
                        m = re.findall(r"\d+", p.lines[i].translate(_DIGITS))
                        rows.append((k, book, page, " ".join(words), _last_word(p.lines[i]), int(m[0]) if len(m) == 1 and len(m[0]) < 6 else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [()] * 6, _EDGE)], schema=_EDGE)

    return pages.select("page_id", "book", "page", "library", "text", "_repeated").mapInArrow(run, "page_id bigint, book string, page int, words string, last string, value bigint")


_EDGE = pa.schema([("page_id", pa.int64()), ("book", pa.string()), ("page", pa.int32()), ("words", pa.string()), ("last", pa.string()), ("value", pa.int64())])


def _parts(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut small, which bounds what their texts take as Python strings."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


@lru_cache(20_000)
def _last_word(line: str) -> str | None:
    words = _NOT_LETTERS.sub(" ", _INSIDE.sub("", line.translate(TO_DEVANAGARI))).lower().split()
    return folded(words[-1]) if words else None


def _recurring(edges: DataFrame) -> DataFrame:
    """(book, words, n): words of edge lines that stand on a share of the book's pages, and on HEAD_PAGES."""
    sizes = edges.groupBy("book").agg(F.count_distinct("page_id").alias("pages"))
    votes = edges.filter("words is not null").groupBy("book", "words").agg(F.count_distinct("page").alias("n"))
    return votes.join(sizes, "book").filter(F.col("n") >= F.greatest(F.lit(HEAD_PAGES), HEAD_SHARE * F.col("pages"))).select("book", "words", "n")


def endings_of_heads(edges: DataFrame, recurring: DataFrame) -> set[str]:
    """Last words of heads in ENDING_SHARE of the books with heads, and in three: names of sections end in them too. At most 1 / ENDING_SHARE."""
    lasts = edges.select("book", "words", "last").distinct().join(recurring, ["book", "words"]).select("book", "last").distinct()
    books = recurring.select("book").distinct().count()
    found = lasts.groupBy("last").count().filter(F.col("count") >= max(3, ENDING_SHARE * books))
    return {r[0] for r in found.select("last").collect()}


def heads_of_books(edges: DataFrame, recurring: DataFrame, books: DataFrame | None) -> DataFrame:
    """(book, heads, offsets): words of the running heads of each book, and page number minus place where it recurs.

    A head needs a share of the pages, so a book has at most 2 / HEAD_SHARE of them; so with the offsets, of which
    those of three pages that follow each other count as well.
    """
    sizes = edges.select("book").distinct()
    heads = recurring.groupBy("book").agg(F.collect_list(F.struct("n", "words")).alias("heads"))
    near = W.partitionBy("book", "o").orderBy("page").rangeBetween(-4, 4)
    offsets = (
        edges.filter("value is not null")
        .select("book", "page", (F.col("value") - F.col("page")).alias("o"))
        .distinct()
        .withColumn("near", F.count("*").over(near))
        .filter("near >= 2")
        .groupBy("book", "o")
        .agg(F.count("*").alias("n"))
        .groupBy("book")
        .agg(F.array_sort(F.collect_list("o")).alias("offsets"))
    )
    out = sizes.join(heads, "book", "left").join(offsets, "book", "left")
    if books is not None:
        names = books.filter("book_name is not null").groupBy("book").agg(F.min("book_name").alias("name"))
        return out.join(names, "book", "left").select("book", "heads", "offsets", "name")
    return out.select("book", "heads", "offsets", F.lit(None).cast("string").alias("name"))


def _alike(a: str, b: str) -> bool:
    most = max(len(a), len(b)) * 2 // 5
    return a == b or (most > 0 and edits(a, b, most) <= most)


def is_head(words: list[str], heads: list[list[str]], name: list[str]) -> bool:
    """Whether the words are those of a head or of the book's name, whose last word may differ, but for misreadings."""
    if not words:
        return False
    for known in [*heads, name]:
        if not known or abs(len(words) - len(known)) > 1:
            continue
        free, n = list(known), 0
        for w in words:
            at = next((i for i, x in enumerate(free) if _alike(w, x)), None)
            if at is not None:
                free.pop(at)
                n += 1
        if n == len(known) and len(words) <= len(known) + 1 or n >= 2 and n >= len(known) - 1 and n >= len(words) - 1:
            return True
    return False


def is_section(line: str, endings: set[str], first: bool) -> bool:
    """Whether an edge line is the name of a section: two to four words of which the last ends names of sections.
    At the foot, where a text may end in such a word too, it needs a number or brackets."""
    if any(c in line for c in "।॥,“”\"") or not (first or re.search(r"[\d\[|(]", line)):
        return False
    return _last_word(line) in endings and 2 <= len(_head_words(line)) <= 4


#: Foreign signs inside a word of another script: a misreading whatever the word.
_MIXED = re.compile("[ऀ-ॣઁ-૥][A-Za-zл0-9२१૨૧'`~*.=^;|!\\[]+[ऀ-ॣઁ-૥]|[A-Za-zл२१૨૧][ऀ-ॣઁ-૥]|[A-Za-z][~*=^`@!+0-9]+[A-Za-zÀ-ɏḀ-ỿ]")
_FIRST_TOKEN, _LAST_TOKEN = re.compile(r"^\s*\S+"), re.compile(r"\S+\s*$")
_LINE = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32()), ("trusted", pa.bool_()), ("kinds", pa.list_(pa.string())), ("words", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
LINE = "page_id bigint, line_no int, trusted boolean, kinds array<string>, words string, first int, last int"


def _mixed_inside(line: str, first: bool, ends: bool) -> bool:
    """Whether a foreign sign stands within a word, but for words that are divided at the line's ends."""
    if not _MIXED.search(line):
        return False
    line = _FIRST_TOKEN.sub("", line) if first else line
    return bool(_MIXED.search(_LAST_TOKEN.sub("", line) if ends else line))


def _page_lines(text: str, page: int, repeated: Repeated | None, heads: list[list[str]], name: list[str], offsets: set[int], endings: set[str]) -> Iterator[tuple]:
    """(line, kinds, words, first, last) of the lines that are not empty or garbled; words[first:last + 1] stand whole on the line."""
    p = Page(text, repeated)
    kinds: dict[int, str] = {}
    for i, n in p.ends()[0].items():
        if n - page in offsets or (not offsets and not _VERSE_NUMBER.fullmatch(p.lines[i].translate(_DIGITS))):
            kinds[i] = "page_number"
    body = [i for i in p.body if i not in kinds]
    for i in dict.fromkeys(body[:2] + body[-2:]):
        if len(p.lines[i]) <= 80 and (is_head(_head_words(p.lines[i]), heads, name) or i in (body[0], body[-1]) and is_section(p.lines[i], endings, i == body[0])):
            kinds[i] = "header"
    for i in p.repeated:
        yield i, ["repeated"], [], 0, -1
    for i, kind in kinds.items():
        yield i, [kind], [], 0, -1
    body, before, mixed = [i for i in body if i not in kinds], False, bool(_MIXED.search(text))
    for i in body:
        line = p.lines[i]
        ends = i != body[-1] and line.rstrip()[-1] in _HYPHENS and bool(_DIVIDED.search(line))
        words, own = tokens(line), ["hyphen"] if ends else []
        if mixed and _mixed_inside(line, before, ends):
            own.append("misread")
        if own or words:
            yield i, own, words, int(before), len(words) - 1 - ends
        before = ends


def read_lines(pages: DataFrame, known: Known, endings: set[str]) -> DataFrame:
    """LINE rows of pages (page_id, page, library, source, text, _repeated, heads, offsets, name): the one look at whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, list[str]] = {}
        for part in _parts(batches):
            out: list[list] = [[] for _ in _LINE]
            for k, page, lib, source, text, repeated, heads, offsets, name in _rows(part, "page_id", "page", "library", "source", "text", "_repeated", "heads", "offsets", "name"):
                if name is not None and name not in names:
                    names[name] = _head_words(name)
                heads = [h["words"].split() for h in heads or ()]
                for i, kinds, words, first, last in _page_lines(text, page, known(lib, repeated), heads, names.get(name, []), set(offsets or ()), endings):
                    for column, value in zip(out, (k, i + 1, source == "text", kinds, " ".join(words), first, last)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _LINE)], schema=_LINE)

    return pages.select("page_id", "page", "library", "source", "text", "_repeated", "heads", "offsets", "name").mapInArrow(run, LINE)


def _whole(lines: DataFrame) -> DataFrame:
    """The lines with whole words; no token holds a space."""
    return lines.filter(F.col("last") >= F.col("first")).withColumn("words", F.split("words", " "))


def word_counts(lines: DataFrame) -> DataFrame:
    """(word, n, trusted): how often each word stands on all pages, and on those with a text layer. Divided words don't count."""
    words = _whole(lines).select("trusted", F.explode(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_if("trusted").alias("trusted"))


def misreadings(counts: DataFrame) -> DataFrame:
    """(word, s, doubtful, forms array<struct<cost, n, form, trusted, times>>): words that can be misreadings of frequent forms.

    A doubtful word hardly stands on trusted pages and its forms are TIMES as frequent. The others are usual words, and
    their forms other usual words of one confusion. times: how often the form stands for one of the word.
    """

    @F.pandas_udf("string")
    def skeletons(words: pd.Series) -> pd.Series:
        return words.map(skeleton)

    # cut, else the filter on skeletons goes below the count and every token gets one
    keyed = cut(counts).filter(F.length("word") >= 2).withColumn("s", skeletons("word")).filter("s <> ''")
    keyed = cut(keyed.withColumn("doubtful", F.col("trusted") <= TRUSTED * F.col("n")))
    forms = keyed.filter("n >= 3").select("s", F.col("word").alias("form"), F.col("n").alias("fn"), (F.col("trusted") > 0).alias("ft"), F.col("doubtful").alias("fd"))
    possible = F.when(F.col("doubtful"), F.col("fn") >= TIMES * F.col("n")).otherwise(~F.col("fd") & (F.col("form") != F.col("word")) & (F.least("n", "fn") >= TIMES))
    pairs = salted_lookup(keyed, forms, "s").filter(possible & (F.abs(F.length("form") - F.length("word")) <= 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w, s, n, d, f, fn, ft in zip(*(batch[c] for c in ("word", "s", "n", "doubtful", "form", "fn", "ft"))):
                for most in (1, 2) if d and min(len(w), len(f)) >= 6 else (1,):
                    if explained(f, w, most):
                        rows.append((w, s, d, most, fn, f, ft, fn / n))
                        break
            yield pd.DataFrame(rows, columns=["word", "s", "doubtful", "cost", "n", "form", "trusted", "times"])

    found = pairs.select("word", "s", "n", "doubtful", "form", "fn", "ft").mapInPandas(run, "word string, s string, doubtful boolean, cost int, n bigint, form string, trusted boolean, times double")
    return found.groupBy("word", "s", "doubtful").agg(F.collect_list(F.struct("cost", "n", "form", "trusted", "times")).alias("forms"))


def _places(lines: DataFrame, words: DataFrame, *more: str) -> DataFrame:
    """Places of those of `words` (word, s, ...): page_id, line_no, i, word, what `words` has, and the words before and after, null at the ends."""
    at = F.transform(F.sequence("first", "last"), lambda i: F.struct(i.alias("i"), F.get("words", i).alias("word"), F.when(i > 0, F.get("words", i - 1)).alias("before"), F.get("words", i + 1).alias("after")))
    places = _whole(lines).select("page_id", "line_no", *more, F.inline(at))
    words, small = broadcast_if_small(words, 400)
    return places.join(words, "word") if small else salted_lookup(places, words, "word")


def _context(kind: str, *words: str) -> Column:
    """Key of a context: a word and its forms have the same skeleton, so the same key at the same neighbours."""
    return F.xxhash64(F.lit(kind), *words)


def _sides(places: DataFrame, *keep: str) -> DataFrame:
    """(keep, g): the context with the word before, and that with the word after."""
    return places.select(*keep, F.explode(F.array_compact(F.array(F.when(F.col("before").isNotNull(), _context("l", "before", "s")), F.when(F.col("after").isNotNull(), _context("r", "s", "after"))))).alias("g"))


def doubtful_places(lines: DataFrame, wrong: DataFrame) -> DataFrame:
    """(page_id, line_no, i, word, form): places of doubtful words with the form that stands there.

    Of several forms, or of one that trusted pages lack, those count that trusted pages have or that stand beside the
    same neighbour elsewhere: by neighbours, cost, frequency.
    """
    doubtful = wrong.filter("doubtful").withColumn("sure", (F.size("forms") == 1) & F.col("forms")[0]["trusted"])
    places = cut(_places(lines, doubtful.select("word", "s", "sure", "forms")))
    key = ("page_id", "line_no", "i", "word")
    sure = places.filter("sure").select(*key, F.col("forms")[0]["form"].alias("form"))
    open_ = places.filter(~F.col("sure"))
    asked = cut(_sides(open_, *key, "forms"))
    contexts = cut(asked.select("g").distinct())
    forms = cut(doubtful.filter(~F.col("sure")).select("s", F.explode("forms.form").alias("word")).distinct())
    seen = _sides(_places(lines, forms), "word", "g")
    here, small = broadcast_if_small(contexts, 64)
    seen = (seen.join(here, "g", "left_semi") if small else salted_lookup(seen, here, "g", "left_semi")).distinct()
    each = asked.select(*key, "g", F.explode("forms.form").alias("form"))
    support = each.join(seen.select("g", F.col("word").alias("form")), ["g", "form"]).groupBy(*key, "form").agg(F.count("*").alias("beside"))
    choices = open_.select(*key, F.inline("forms")).join(support, [*key, "form"], "left").withColumn("beside", F.coalesce("beside", F.lit(0))).filter("trusted or beside > 0")
    best = choices.groupBy(*key).agg(F.min_by("form", F.struct(-F.col("beside"), "cost", -F.col("n"), "form")).alias("form"))
    return sure.unionByName(best)


def usual_places(lines: DataFrame, wrong: DataFrame) -> DataFrame:
    """(page_id, line_no, i, word, form): places on untrusted pages of a usual word where, between the words beside it, another usual
    one is TIMES as frequent as it, and as by their frequency."""
    usual = wrong.filter(~F.col("doubtful"))
    words = cut(usual.select("word", "s").union(usual.select(F.explode("forms.form").alias("word"), "s")).distinct())
    between = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), _context("t", "before", "s", "after"))
    counted = _places(lines, words).select("word", between.alias("g")).filter("g is not null").groupBy("g", "word").agg(F.count("*").alias("m"))
    per = counted.groupBy("g").agg(F.collect_list(F.struct("word", "m")).alias("here")).filter("size(here) > 1")
    pairs = per.select("g", F.explode("here").alias("x"), "here").select("g", F.col("x.word").alias("word"), F.col("x.m").alias("own"), F.explode("here").alias("y"))
    pairs = pairs.select("g", "word", "own", F.col("y.word").alias("form"), F.col("y.m").alias("m")).filter((F.col("form") != F.col("word")) & (F.col("m") >= TIMES * F.col("own")))
    forms = usual.select("word", F.inline("forms")).select("word", "form", "n", "times")
    enough = pairs.join(forms, ["word", "form"]).filter(F.col("m") >= TIMES * F.greatest(F.lit(1.0), "times") * F.col("own"))
    decided = cut(enough.groupBy("g", "word").agg(F.min_by("form", F.struct(-F.col("m"), -F.col("n"), "form")).alias("form")))
    at = _places(lines.filter(~F.col("trusted")), decided.join(words, "word", "left_semi").select("word").distinct().join(words, "word")).withColumn("g", between)
    return at.join(decided, ["g", "word"]).select("page_id", "line_no", "i", "word", "form")


def _prepared(pages: DataFrame, books: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(LINE rows, places of misread words)."""
    pages = pages.select("page_id", "book", "page", "library", "source", "text").filter("text is not null and trim(text) <> ''")
    pages = pages.fillna({"page": 0, "book": "", "library": ""})
    pages, known = _with_repeated(pages, boilerplate.frequent_lines(pages, "library", "book", "text"))
    edges = cut(_edge_rows(pages, known))
    recurring = cut(_recurring(edges))
    endings = endings_of_heads(edges, recurring)
    heads, small = broadcast_if_small(cut(heads_of_books(edges, recurring, books)))
    # a book has one row of heads, but may hold a third of the pages
    joined = pages.join(heads, "book", "left") if small else salted_lookup(pages, heads, "book", "left")
    lines = cut(read_lines(joined, known, endings))
    wrong = cut(misreadings(word_counts(lines)))
    return lines, cut(doubtful_places(lines, wrong).unionByName(usual_places(lines, wrong)))


def damaged_lines(pages: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no, kind): lines, from 1 over all lines, that are a `header`, `page_number`, `hyphen` or `misread`.

    Null and blank texts give none; null book, library and page count as one book, none and place 0; a null
    source isn't trusted. Each case comes once, also of repeated rows of a page. An empty table gives none.
    """
    lines, places = _prepared(pages, books)
    by_look = lines.filter(F.size("kinds") > 0).select("page_id", "line_no", F.explode("kinds").alias("kind")).filter("kind <> 'repeated'")
    return by_look.union(places.select("page_id", "line_no", F.lit("misread").alias("kind"))).distinct()


@F.pandas_udf(StringType())
def _put_right(lines: pd.Series, fixes: pd.Series) -> pd.Series:
    """Lines with the words at some of their places exchanged."""

    def one(line: str, own) -> str:
        by_place, words = {f["i"]: f["form"] for f in own}, tokens(line)
        for w in sorted({words[i] for i in by_place if i < len(words)}, key=len, reverse=True):
            each = iter([by_place.get(i) for i, x in enumerate(words) if x == w])
            line = re.sub(rf"(?<![{_LETTERS}]){re.escape(w)}(?![{_LETTERS}])", lambda m: next(each, None) or m[0], line, flags=re.IGNORECASE)
        return line

    return pd.Series([x if own is None else one(x, own) for x, own in zip(lines, fixes)], dtype=object)


def clean_pages(pages: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(page_id, text): each page with text as clean running text or verse, put together by windows over its lines.

    Nulls, blanks and empty tables as in damaged_lines; page_id is unique.
    """
    lines, places = _prepared(pages, books)
    fixes = places.groupBy("page_id", "line_no").agg(F.collect_list(F.struct("i", "form")).alias("fixes"))
    gone = F.arrays_overlap("kinds", F.array(*map(F.lit, ("repeated", "header", "page_number"))))
    marks = lines.filter(F.size("kinds") > 0).select("page_id", "line_no", gone.alias("gone"), F.array_contains("kinds", "hyphen").alias("hyphen"))
    marks = marks.join(fixes, ["page_id", "line_no"], "full").groupBy("page_id").agg(F.collect_list(F.struct("line_no", "gone", "hyphen", "fixes")).alias("marks"))
    texts = pages.filter("text is not null and trim(text) <> ''").select("page_id", "text").join(marks, "page_id", "left")
    rows = texts.select("page_id", F.posexplode(F.split("text", "\n")).alias("at", "line"), "marks")
    rows = rows.select("page_id", (F.col("at") + 1).alias("line_no"), "line", F.get(F.filter("marks", lambda x: x["line_no"] == F.col("at") + 1), F.lit(0)).alias("m"))
    rows = rows.filter(~F.coalesce("m.gone", F.lit(False))).select("page_id", "line_no", "line", F.col("m.fixes").alias("fixes"), F.coalesce("m.hyphen", F.lit(False)).alias("hyphen"))
    right = F.when(F.col("fixes").isNotNull(), _put_right("line", "fixes")).otherwise(F.col("line"))
    rows = rows.withColumn("line", right).drop("fixes")
    order = W.partitionBy("page_id").orderBy("line_no")
    ends = r"(?:[।॥|.,!?…:;०0\d)\]”]|\.{3})\s*$"
    joined = (
        rows.withColumn("before", F.lag("line").over(order))
        .withColumn("divided", F.coalesce(F.lag("hyphen").over(order), F.lit(False)))
        # a line runs on if the one before is long and has no end of a verse or sentence
        .withColumn("glue", F.when(F.col("before").isNull(), "").when(F.col("divided"), "").when((F.length("before") >= 35) & ~F.col("before").rlike(ends) & (F.col("line") != ""), " ").otherwise("\n"))
        .withColumn("part", F.concat("glue", F.when(F.col("hyphen"), F.regexp_replace(F.rtrim("line"), "[-‐‑¬­]$", "")).otherwise(F.col("line"))))
    )
    whole = joined.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("text"))
    return whole.select("page_id", F.regexp_replace(F.trim("text"), "\n{3,}", "\n\n").alias("text"))

"""Problem 6: lines that one source repeats on very many of its documents, found and taken out.

Lines are hashed by their letters and vowel signs. Distinct documents are counted per (source, hash, book) first
and per (source, hash) then, both with map-side sums, so a source with a third of all rows is spread over its
lines. A line that counts stands on a fixed share of its source's documents, so a source has at most
(lines of a document / share) of them: this table is small by proof, and is broadcast if its counted size
says so too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, salted_lookup

#: Share of a source's documents, and its books, on which a line must stand.
SHARE, BOOKS = 0.04, 3
_GUJARATI = "".join(chr(c + 0x180) for c in range(0x900, 0x980) if not 0x964 <= c <= 0x96F)
_DEVANAGARI = "".join(chr(c) for c in range(0x900, 0x980) if not 0x964 <= c <= 0x96F)


def line_letters(line: Column) -> Column:
    """The letters and vowel signs of a line, in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}\p{M}]+", ""))


def one_script(text: Column) -> Column:
    return F.translate(text, _GUJARATI, _DEVANAGARI)


def _lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, line_no (from 1, empty lines count), letters; lines without letters are left out."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.select(*keys, (F.col("i") + 1).alias("line_no"), line_letters(F.col("line")).alias("letters")).filter("letters <> ''")


def frequent_lines(df: DataFrame, source: str, book: str, text: str, share: float = SHARE, books: int = BOOKS) -> DataFrame:
    """(source, h, letters, n, of): lines on at least share of the source's rows and in at least `books` of its books.

    Every row is a document of its own; rows of null source belong to no source, null text counts as a row
    without lines. A null book is no book.
    """
    rows = df.filter(F.col(source).isNotNull())
    totals = rows.groupBy(source).agg(F.count("*").alias("of"))
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_letters), lambda x: x != ""))
    # distinct within a row, and a row is a document: the counts need no second shuffle
    once = rows.filter(F.col(text).isNotNull()).select(source, F.col(book).alias("_book"), F.explode(keys).alias("letters")).withColumn("h", F.xxhash64("letters"))
    per_book = once.groupBy(source, "h", "_book").agg(F.count("*").alias("n"), F.min("letters").alias("letters"))
    per_line = per_book.groupBy(source, "h").agg(F.sum("n").alias("n"), F.count("_book").alias("books"), F.min("letters").alias("letters"))
    return per_line.filter(F.col("books") >= books).join(totals, source).filter(F.col("n") >= share * F.col("of")).select(source, "h", "letters", "n", "of")


def _marked(lines: DataFrame, frequent: DataFrame, source: str) -> DataFrame:
    """The lines that are frequent in their source."""
    table, _ = broadcast_if_small(frequent.select(source, "h").distinct(), 200)
    return lines.withColumn("h", F.xxhash64("letters")).join(table, [source, "h"], "left_semi")


def repeated_lines(df: DataFrame, key: str, source: str, book: str, text: str, share: float = SHARE, books: int = BOOKS) -> DataFrame:
    """(key, line_no) of each line that its source repeats."""
    frequent = cut(frequent_lines(df, source, book, text, share, books))
    return _marked(_lines(df, text, key, source), frequent, source).select(key, "line_no")


def without_lines(df: DataFrame, text: str, source: str, frequent: DataFrame, unify: bool = False) -> DataFrame:
    """df with its text rebuilt without the frequent lines, and `removed`, their number; null text stays null.

    The frequent lines of a source come to its rows as one array, whose size is bounded by (lines of a document / share).
    unify: text is in one script, so the lines are compared in it.
    """
    letters = F.col("letters")
    per_source, small = broadcast_if_small(cut(frequent.groupBy(source).agg(F.collect_set(F.xxhash64(one_script(letters) if unify else letters)).alias("_drop"))))

    def key(line: Column) -> Column:
        return F.xxhash64(one_script(line_letters(line)) if unify else line_letters(line))

    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), key(x)))
    joined = df.join(per_source, source, "left") if small else salted_lookup(df, per_source, source, "left")
    return joined.select(
        *(c for c in df.columns if c != text),
        F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.when(F.col("_drop").isNull() | F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).alias("removed"),
    )

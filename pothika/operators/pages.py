"""Pages: routing by quality, assembly of recognised words, page furniture, printed numbers, books as one text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import FOOTNOTE, NUMBER_LINE, Settings
from ..functions import similarity, text

_INDIC = r"[\x{0900}-\x{0AFF}&&[\p{L}]]"
_BAD = r"[\x{00C0}-\x{02FF}\x{E000}-\x{F8FF}\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"


def indic_ratio(t: Column) -> Column:
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(t, F.lit(_INDIC)) / letters)


def broken_ratio(t: Column) -> Column:
    """Share of signs that well-read text doesn't have among those and the letters; 1 if there are none."""
    bad = F.regexp_count(t, F.lit(_BAD))
    either = F.regexp_count(t, F.lit(rf"{_BAD}|\p{{L}}"))
    return F.when(either == 0, 1.0).otherwise(bad / either)


def routed(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """pages with indic_ratio, broken_ratio, usable and route: text, blank or ocr. Null text is blank, unless the page has images or
    drawings, where the table tells (columns images, drawings): then it is for OCR."""
    t = F.coalesce("text", F.lit(""))
    out = pages.withColumn("indic_ratio", indic_ratio(t)).withColumn("broken_ratio", broken_ratio(t))
    pictures = F.lit(False)
    for c in ("images", "drawings"):
        if c in pages.columns:
            pictures = pictures | (F.coalesce(F.col(c), F.lit(0)) > 0)
    usable = (F.length(F.regexp_replace(t, r"^\s+|\s+$", "")) >= s.min_text_chars) & (F.col("indic_ratio") >= s.min_indic_ratio) & (F.col("broken_ratio") <= s.max_broken_ratio)
    route = F.when(usable & F.lit(not s.force_ocr), "text").when(~t.rlike(r"\S") & ~pictures, "blank").otherwise("ocr")
    return out.withColumn("usable", usable).withColumn("route", route)


def recognised_lines(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, confidence, text) from rows (keys, block, par, line, ord, word, conf): words in their order with spaces, lines with
    line ends; confidence is the mean of those not negative, 0 if none. Blank words count for nothing."""
    whole = words.filter(F.col("word").rlike(r"\S")).withColumn("word", F.trim("word"))
    lines = whole.groupBy(*keys, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("t"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("c"), F.count(F.when(F.col("conf") >= 0, 1)).alias("n"),
    )
    pages = lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"),
        F.bround(F.coalesce(F.sum("c") / F.when(F.sum("n") > 0, F.sum("n")), F.lit(0.0)), 1).alias("confidence"),
    )
    return pages.select(*keys, "confidence", "text")


def latest_reads(pages: DataFrame, order: str) -> DataFrame:
    """One row for each (book, page): the last read, by order and then page_id."""
    w = W.partitionBy("book", "page").orderBy(F.col(order).desc_nulls_last(), F.col("page_id").desc())
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page_lines(pages: DataFrame) -> DataFrame:
    """(book, page, line_no, n_lines, line, at_edge) of the lines that are not blank, light, trimmed of nothing.

    line_no counts from 1. at_edge: among the first two or last two.
    """
    lit = pages.select("book", "page", text.light(F.col("text")).alias("_light"))
    lit = lit.select("book", "page", F.filter(F.split("_light", "\n"), lambda x: x.rlike(r"\S")).alias("_lines"))
    # outer, as the optimizer would test an inner one's array beforehand, and so make the light text three times
    out = lit.select("book", "page", F.posexplode_outer("_lines").alias("i", "line"), F.size("_lines").alias("n_lines")).filter("line is not null")
    return out.select("book", "page", (F.col("i") + 1).alias("line_no"), "n_lines", "line", ((F.col("i") < 2) | (F.col("i") >= F.col("n_lines") - 2)).alias("at_edge"))


def _inner_danda(line: Column) -> Column:
    return F.regexp_replace(line, r"[।. ]+$", "").rlike("[।॥]")


def running_lines(lines: DataFrame, share: float = 0.2) -> DataFrame:
    """(book, line_key, n): keys of short edge lines on a share of the book's pages, on three at least."""
    short = F.trim("line")
    votes = lines.filter("at_edge").filter((F.length(short) <= 60) & ~_inner_danda(short)).select("book", "page", text.furniture_key("line").alias("line_key"))
    counted = votes.filter("line_key <> ''").groupBy("book", "line_key").agg(F.count_distinct("page").alias("n"))
    sizes = lines.groupBy("book").agg(F.count_distinct("page").alias("pages"))
    return counted.join(sizes, "book").filter(F.col("n") >= F.greatest(F.lit(3), share * F.col("pages"))).select("book", "line_key", "n")


def number_candidates(lines: DataFrame) -> DataFrame:
    """(book, page, n): numbers at the beginning or end of short edge lines."""
    short = F.trim("line")
    first = F.regexp_extract(short, r"^[^\p{L}\p{N}_]{0,3}?([0-9]{1,4})[^\p{L}\p{N}_]{0,3}?(?:\s|$)", 1)
    last = F.regexp_extract(short, r"(?:^|\s)[^\p{L}\p{N}_\s]{0,3}([0-9]{1,4})[^\p{L}\p{N}_]{0,3}$", 1)
    at = lines.filter("at_edge").filter(F.length(short) <= 60)
    return at.select("book", "page", F.explode(F.array(first, last)).alias("n")).filter("n <> ''").select("book", "page", F.col("n").cast("int").alias("n")).distinct()


def printed_numbers(lines: DataFrame, share: float = 0.2) -> DataFrame:
    """(book, page, printed): by the distance that most pages agree on, or, before that, by two near pages of the same distance.

    Ties: the distance seen on the earliest page, then the smallest.
    """
    found = number_candidates(lines).withColumn("d", F.col("n") - F.col("page"))
    pages = lines.select("book", "page").distinct()
    sizes = pages.groupBy("book").agg(F.count("*").alias("pages"))
    votes = found.groupBy("book", "d").agg(F.count("*").alias("votes"), F.min("page").alias("first"))
    best = votes.groupBy("book").agg(F.max_by(F.struct("d", "votes"), F.struct("votes", -F.col("first"), -F.col("d"))).alias("b"))
    agreed = best.join(sizes, "book").filter(F.col("b.votes") >= F.greatest(F.lit(3), share * F.col("pages"))).select("book", F.col("b.d").alias("d"))
    near = W.partitionBy("book", "d").orderBy("page").rangeBetween(-4, 4)
    local = found.withColumn("near", F.count("*").over(near) - 1).filter("near >= 2").groupBy("book", "page").agg(F.min("n").alias("local"))
    out = pages.join(agreed, "book", "left").join(local, ["book", "page"], "left")
    whole = F.when(F.col("page") + F.col("d") > 0, F.col("page") + F.col("d"))
    return out.select("book", "page", F.coalesce("local", whole).alias("printed")).filter("printed is not null")


def kept_lines(lines: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lines without page furniture: lone numbers, running heads with the page's number, footnotes at the foot, repeated lines.

    Exact repeats go by a join; what is left at the edges is compared with the book's repeated keys, which are few: each
    needs a share of its pages.
    """
    keys = running_lines(lines, s.header_share).groupBy("book").agg(F.sort_array(F.collect_list("line_key")).alias("keys"))
    short = F.trim("line")
    note = short.rlike(FOOTNOTE)
    edge = (F.col("line_no") <= 2) | (F.col("line_no") > F.col("n_lines") - F.when(note, 3).otherwise(2))
    with_number = (
        F.col("printed").isNotNull() & (F.length(short) <= 60) & ~F.regexp_replace(short, r"[,. ]+$", "").contains(",")
        & F.array_contains(F.regexp_extract_all(short, F.lit(r"(?:^|[^0-9])([0-9]{1,4})(?=[^0-9]|$)"), 1), F.col("printed").cast("string"))
        & short.rlike(r"\p{L}{2}")
    )
    rows = lines.join(printed_numbers(lines, s.header_share), ["book", "page"], "left").join(keys, "book", "left")
    rows = rows.filter(~short.rlike(NUMBER_LINE)).filter(~(edge & (with_number | note)))
    rows = rows.withColumn("k", F.when(edge & (F.length(short) <= 60) & ~_inner_danda(short) & F.col("keys").isNotNull(), text.furniture_key("line")))

    @F.pandas_udf("boolean")
    def repeated(k: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([x is not None and similarity.best_choice(x, list(ks), s.header_similarity) is not None for x, ks in zip(k, keys)])

    same = F.when(F.col("k").isNull(), False).when(F.array_contains("keys", F.col("k")), True)
    fuzzy = F.when(F.col("k").isNotNull(), repeated("k", "keys")).otherwise(False)
    return rows.filter(~F.coalesce(same, fuzzy)).drop("k", "keys")


def page_offsets(lines: DataFrame) -> DataFrame:
    """(book, page, start, chars): where each page begins in its book's text; every line ends with a line end, an empty page with one."""
    per_page = lines.groupBy("book", "page").agg(F.sum(F.length("line") + 1).cast("bigint").alias("chars"))
    before = W.partitionBy("book").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return per_page.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0))).select("book", "page", "start", "chars")


def page_texts(lines: DataFrame) -> DataFrame:
    """(book, page, start, t): the text of each page's lines, and where it begins in its book's text."""
    texts = lines.groupBy("book", "page").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("t")
    )
    return texts.join(page_offsets(lines).select("book", "page", F.col("start").cast("int").alias("start")), ["book", "page"])


def book_texts(texts: DataFrame) -> DataFrame:
    """(book, light, starts) of page_texts: the pages of each book as one text, and (start, page) of each, in order."""
    whole = texts.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", "start", "t"))).alias("ps"))
    return whole.select("book", F.array_join(F.transform("ps", lambda x: x["t"]), "").alias("light"), F.transform("ps", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"))).alias("starts"))

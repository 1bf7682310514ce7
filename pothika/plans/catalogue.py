"""The queries of the library's own operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import similarity, text
from ..operators import content, group, match, pages, report, segment
from ..session import cut
from ..sources import readers
from ..streaming import ingest
from . import run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_lines(pages.latest_reads(_table(spark, sf_dir, "pages"), "read_at"))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, start, t) of the books that the pages make, without page furniture."""
    return cut(run.texts_of_books(cut(_lines(spark, sf_dir))))


def assembled_books(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """(book, light, starts, confidence, spans) of these books."""
    return cut(run.assembled(_table(spark, sf_dir, "pages"), texts if texts is not None else book_pages(spark, sf_dir)))


# ---------------------------------------------------------------- SQL of the text functions


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _light(c: str) -> str:
    out = f"translate(nfc_normalize(coalesce({c}, '')), {_sql(fixed.ZERO_WIDTH)}, '')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{FFFD}}]', ' ', 'g')"
    out = f"translate(translate({out}, {_sql(fixed.GUJARATI_BLOCK)}, {_sql(fixed.DEVANAGARI_BLOCK)}), '०१२३४५६७८९', '0123456789')"
    out = f"replace(replace(replace({out}, '।।', '॥'), '||', '॥'), '|', '।')"
    return rf"regexp_replace({out}, '[ \t\r\f\x0b]+', ' ', 'g')"


def _key(light: str) -> str:
    letters = rf"regexp_replace({light}, '[^\x{{0900}}-\x{{0963}}\x{{0971}}-\x{{097F}}]', '', 'g')"
    return f"translate(translate({letters}, {_sql(fixed.FOLD_DROP)}, ''), {_sql(fixed.FOLD_FROM)}, {_sql(fixed.FOLD_TO)})"


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_sql(pattern)}))"


_READS = "reads AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY read_at DESC NULLS LAST, page_id DESC) = 1)"
_LINES = rf"""{_READS},
split AS (SELECT book, page, list_filter(string_split({_light("text")}, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM reads),
lines AS (SELECT book, page, i AS line_no, len(ls) AS n_lines, ls[i] AS line, i <= 2 OR i > len(ls) - 2 AS at_edge FROM split, generate_series(1, len(ls)) g(i))"""
_FURNITURE = f"trim(regexp_replace(line, {_sql(fixed.FURNITURE_KEY)}, ' ', 'g'), ' ')"
_RUNNING = rf"""
votes AS (SELECT book, {_FURNITURE} AS line_key, count(DISTINCT page) AS n FROM lines WHERE at_edge AND length(trim(line, ' ')) <= 60
  AND NOT regexp_matches(regexp_replace(trim(line, ' '), '[।. ]+$', ''), '[।॥]') GROUP BY ALL),
running AS (SELECT book, line_key, n FROM votes JOIN (SELECT book, count(DISTINCT page) AS pages FROM lines GROUP BY book) USING (book)
  WHERE line_key <> '' AND n >= greatest(3, 0.2 * pages))"""

# ---------------------------------------------------------------- pages


@_query(
    rf"""WITH m AS (SELECT page_id, coalesce(text, '') AS t, {_count("coalesce(text, '')", r"\p{L}")} AS letters,
  {_count("regexp_replace(coalesce(text, ''), '[^\\x{0900}-\\x{0AFF}]', '', 'g')", r"\p{L}")} AS indic,
  {_count("coalesce(text, '')", r"[\x{00C0}-\x{02FF}\x{E000}-\x{F8FF}\x{FFFD}\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]")} AS bad,
  {_count("coalesce(text, '')", r"[\x{00C0}-\x{02FF}\x{E000}-\x{F8FF}\x{FFFD}\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]|\p{L}")} AS either FROM pages),
r AS (SELECT page_id, t, CASE WHEN letters = 0 THEN 0.0::DOUBLE ELSE indic::DOUBLE / letters END AS indic_ratio, CASE WHEN either = 0 THEN 1.0::DOUBLE ELSE bad::DOUBLE / either END AS broken_ratio FROM m)
SELECT page_id, round(indic_ratio, 6) AS indic_ratio, round(broken_ratio, 6) AS broken_ratio,
  CASE WHEN length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) >= 30 AND indic_ratio >= 0.6 AND broken_ratio <= 0.02 THEN 'text' WHEN NOT regexp_matches(t, '\S') THEN 'blank' ELSE 'ocr' END AS route FROM r"""
)
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.routed(_table(spark, sf_dir, "pages")).select("page_id", F.round("indic_ratio", 6).alias("indic_ratio"), F.round("broken_ratio", 6).alias("broken_ratio"), "route")


@_query(
    rf"""SELECT page_id, CASE WHEN g + d = 0 THEN '' WHEN g > d THEN 'Gujarati' ELSE 'Devanagari' END AS script FROM
(SELECT page_id, {_count("coalesce(text, '')", r"[\x{0A80}-\x{0AFF}]")} AS g, {_count("coalesce(text, '')", r"[\x{0900}-\x{0963}\x{0966}-\x{097F}]")} AS d FROM pages)"""
)
def q_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.script_of(F.coalesce("text", F.lit(""))).alias("script"))


@_query(f"WITH l AS (SELECT page_id, {_light('text')} AS light FROM pages) SELECT page_id, md5(light) AS light_md5, md5({_key('light')}) AS key_md5, length({_key('light')}) AS key_length FROM l")
def q_light_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = _table(spark, sf_dir, "pages").select("page_id", text.light(F.col("text")).alias("light"))
    key = text.key_of_light(F.col("light"))
    return lit.select("page_id", F.md5("light").alias("light_md5"), F.md5(key).alias("key_md5"), F.length(key).cast("bigint").alias("key_length"))


@_query(f"SELECT work_id, translate(aadi, {_sql(''.join(c for c in fixed.DEVANAGARI_BLOCK if c not in fixed.DANDAS))}, {_sql(''.join(chr(ord(c) + 0x180) for c in fixed.DEVANAGARI_BLOCK if c not in fixed.DANDAS))}) AS gujarati FROM works WHERE aadi IS NOT NULL")
def q_gujarati(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "works").filter("aadi is not null").select("work_id", text.devanagari_to_gujarati(F.col("aadi")).alias("gujarati"))


@_query(
    r"""SELECT work_id, CASE WHEN length(aadi) <= 60 THEN aadi ELSE concat(regexp_replace(substring(aadi, 1, 60), ' [^ ]*$', ''), ' …') END AS short,
  trim(regexp_replace(aadi, '[\s\x{2063}]+', ' ', 'g'), ' ') AS one_line FROM works WHERE aadi IS NOT NULL"""
)
def q_short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "works").filter("aadi is not null").select("work_id", text.shortened(F.col("aadi"), 60).alias("short"), text.one_line(F.col("aadi")).alias("one_line"))


@_query(f"WITH {_READS} SELECT book, page, page_id FROM reads")
def q_latest_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.latest_reads(_table(spark, sf_dir, "pages"), "read_at").select("book", "page", "page_id")


@_query(
    r"""WITH l AS (SELECT page_id, confidence, i, string_split(text, chr(10))[i] AS line FROM pages, generate_series(1, len(string_split(text, chr(10)))) g(i)),
w AS (SELECT page_id, i, j, trim(string_split(line, ' ')[j], ' ') AS word, CASE WHEN (i + j) % 7 = 0 THEN -1.0 ELSE confidence END AS conf FROM l, generate_series(1, len(string_split(line, ' '))) h(j)),
t AS (SELECT page_id, i, string_agg(word, ' ' ORDER BY j) AS line, sum(conf) FILTER (conf >= 0) AS c, count(*) FILTER (conf >= 0) AS n FROM w WHERE regexp_matches(word, '\S') GROUP BY ALL)
SELECT page_id, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5, sum(n)::BIGINT AS words_read, round_even(coalesce(sum(c) / nullif(sum(n), 0), 0), 1) AS confidence FROM t GROUP BY page_id"""
)
def q_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "pages").select("page_id", "confidence", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    words = lines.select("page_id", "confidence", "i", F.posexplode(F.split("l", " ")).alias("j", "word"))
    conf = F.when((F.col("i") + F.col("j") + 2) % 7 == 0, -1.0).otherwise(F.col("confidence"))
    rows = words.select("page_id", F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("i").alias("line"), F.col("j").alias("ord"), "word", conf.alias("conf"))
    read = rows.filter(F.col("word").rlike(r"\S") & (F.col("conf") >= 0)).groupBy("page_id").agg(F.count("*").alias("words_read"))
    whole = pages.recognised_lines(rows, "page_id").select("page_id", "confidence", F.md5("text").alias("text_md5"))
    return whole.join(read, "page_id", "left").select("page_id", "text_md5", F.coalesce("words_read", F.lit(0)).alias("words_read"), "confidence")


@_query(f"WITH {_LINES} SELECT book, page, line_no::INTEGER AS line_no, n_lines::INTEGER AS n_lines, at_edge, md5(line) AS line_md5 FROM lines")
def q_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("book", "page", "line_no", "n_lines", "at_edge", F.md5("line").alias("line_md5"))


@_query(f"WITH {_LINES}, {_RUNNING} SELECT * FROM running")
def q_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.running_lines(_lines(spark, sf_dir))


_CANDIDATES = r"""
short AS (SELECT book, page, trim(line, ' ') AS s FROM lines WHERE at_edge AND length(trim(line, ' ')) <= 60),
candidates AS (SELECT DISTINCT book, page, n::INTEGER AS n FROM (
  SELECT book, page, regexp_extract(s, '^[^\p{L}\p{N}_]{0,3}?([0-9]{1,4})[^\p{L}\p{N}_]{0,3}?(?:\s|$)', 1) AS n FROM short UNION ALL
  SELECT book, page, regexp_extract(s, '(?:^|\s)[^\p{L}\p{N}_\s]{0,3}([0-9]{1,4})[^\p{L}\p{N}_]{0,3}$', 1) FROM short) WHERE n <> '')"""


_PRINTED = rf"""{_CANDIDATES},
f AS (SELECT *, n - page AS d FROM candidates), p AS (SELECT DISTINCT book, page FROM lines), sz AS (SELECT book, count(*) AS pages FROM p GROUP BY book),
v AS (SELECT book, d, count(*) AS votes, min(page) AS first FROM f GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY book ORDER BY votes DESC, first, d) = 1),
agreed AS (SELECT book, d FROM b JOIN sz USING (book) WHERE votes >= greatest(3, 0.2 * pages)),
near AS (SELECT *, count(*) OVER (PARTITION BY book, d ORDER BY page RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) - 1 AS c FROM f),
own AS (SELECT book, page, min(n) AS n FROM near WHERE c >= 2 GROUP BY ALL),
printed AS (SELECT book, page, printed FROM (SELECT book, page, coalesce(own.n, CASE WHEN page + d > 0 THEN page + d END)::INTEGER AS printed FROM p LEFT JOIN agreed USING (book) LEFT JOIN own USING (book, page)) WHERE printed IS NOT NULL)"""


@_query(f"WITH {_LINES}, {_PRINTED} SELECT book, page, printed FROM printed")
def q_printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.printed_numbers(_lines(spark, sf_dir))


@_query(f"WITH {_LINES}, {_PRINTED} SELECT work_id, s.printed AS book_start, e.printed AS book_end FROM works w LEFT JOIN printed s ON s.book = w.book AND s.page = w.start_page LEFT JOIN printed e ON e.book = w.book AND e.page = w.end_page")
def q_work_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers printed on the first and last page of each work."""
    works = _table(spark, sf_dir, "works").select("work_id", "book", "start_page", "end_page")
    return run.with_printed_pages(works, pages.printed_numbers(cut(_lines(spark, sf_dir)))).select("work_id", "book_start", "book_end")


@_query()
def q_kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.kept_lines(_lines(spark, sf_dir)).select("book", "page", "line_no", "line")


_OFFSETS = """
chars AS (SELECT book, page, sum(length(line) + 1)::BIGINT AS chars FROM lines GROUP BY ALL),
offsets AS (SELECT book, page, coalesce(sum(chars) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, chars FROM chars)"""


@_query(f"WITH {_LINES}, {_OFFSETS} SELECT book, page, start, chars FROM offsets")
def q_book_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_offsets(_lines(spark, sf_dir))


@_query(f"WITH {_LINES}, {_OFFSETS} SELECT w.work_id, o.page FROM works w ASOF JOIN offsets o ON w.book = o.book AND w.span_start >= o.start")
def q_offset_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at which each work begins: works and pages in one order by offset, the last page before each work."""
    at = pages.page_offsets(_lines(spark, sf_dir)).select("book", F.col("start").alias("o"), F.lit(0).alias("kind"), "page", F.lit(None).cast("bigint").alias("work_id"))
    asked = _table(spark, sf_dir, "works").filter("span_start is not null").select("book", F.col("span_start").cast("bigint").alias("o"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page"), "work_id")
    last = F.last("page", ignorenulls=True).over(W.partitionBy("book").orderBy("o", "kind", "page"))
    return at.unionByName(asked).withColumn("page", last).filter("kind = 1 and page is not null").select("work_id", "page")


# ---------------------------------------------------------------- content

_PROSE_SQL = "[" + ", ".join(_sql(w) for w in fixed.PROSE_WORDS) + "]"


@_query(
    rf"""WITH t AS (SELECT page_id, {_light("text")} AS t FROM pages),
m AS (SELECT page_id, t, list_filter(regexp_extract_all(t, {_sql(fixed.DEVA_WORD)}), lambda x: x NOT IN ('।', '॥')) AS words,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 15) AS long FROM t),
c AS (SELECT page_id, len(words) AS words, len(list_filter(words, lambda x: list_contains({_PROSE_SQL}, x))) + {_count("t", fixed.EXPLAINER_CUE)} AS prose,
  len(long) AS n, len(list_filter(long, lambda x: regexp_matches(x, {_sql(fixed.VERSE_END)}))) AS ends FROM m)
SELECT page_id, words::INTEGER AS words, prose::INTEGER AS prose, round(prose / greatest(1, words), 6) AS prose_share, round(CASE WHEN n = 0 THEN 1.0 ELSE ends / n END, 6) AS line_end_share FROM c"""
)
def q_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "pages").select("page_id", text.light(F.col("text")).alias("t"))
    c = F.col("t")
    return t.select("page_id", content.word_count(c).alias("words"), content.prose_words(c).alias("prose"), F.round(content.prose_share(c), 6).alias("prose_share"), F.round(content.line_end_share(c), 6).alias("line_end_share"))


_FILLED = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_DOUBLES = {"short": "length(x) <= 45", "commas": "contains(x, ',')", "listed": f"regexp_matches(x, {_sql(content.LISTED_LINE)})", "bare": "NOT regexp_matches(x, '[,;।॥!?]')", "broken": "ends_with(x, '-')"}


@_query(
    rf"""WITH t AS (SELECT page_id, {_light("text")} AS t FROM pages), l AS (SELECT page_id, t, {_FILLED} AS ls FROM t),
m AS (SELECT *, list_transform(list_filter(list_transform(ls, lambda x: regexp_extract(x, {_sql(content.TAIL_NUMBER)}, 1)), lambda n: n <> ''), lambda n: n::INTEGER) AS tails FROM l)
SELECT page_id, len(ls)::INTEGER AS n_lines, {_count("t", fixed.VERSE_NO)}::INTEGER AS numbers, len(tails) >= 3 AS tailed,
  round(len([i for i in range(1, len(tails)) if tails[i + 1] - tails[i] = 1]) / greatest(1, len(tails) - 1), 6) AS counted,
  coalesce(list_sort(list_transform(ls, lambda x: {_count("x", fixed.DEVA_WORD)}))[len(ls) // 2 + 1], 0)::INTEGER AS median,
  {", ".join(f"round(len(list_filter(ls, lambda x: {v})) / greatest(1, len(ls)), 6) AS {k}" for k, v in _DOUBLES.items())},
  len(list_filter(ls[1:4], lambda x: regexp_matches(x, {_sql(content.COLUMN_LINE)}))) > 0 AS columns FROM m"""
)
def q_page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides whether a page is a contents list."""
    m = content.measured(_table(spark, sf_dir, "pages").select("page_id", text.light(F.col("text")).alias("t")), "t")
    return m.select("page_id", "n_lines", "numbers", "tailed", "median", "columns", *(F.round(c, 6).alias(c) for c in ("counted", *_DOUBLES)))


@_query()
def q_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each page: index, prose or works."""
    t = pages.latest_reads(_table(spark, sf_dir, "pages"), "read_at").select("book", "page", text.light(F.col("text")).alias("t"))
    return content.with_kinds(t).select("book", "page", F.coalesce("kind", F.lit("works")).alias("kind"))


@_query()
def q_excluded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.spans_of_books(assembled_books(spark, sf_dir))


# ---------------------------------------------------------------- segmentation

_MARKS = rf"""t AS (SELECT book, volume, regexp_extract_all(light, {_sql(fixed.MARK_DANDA)}, 1) AS r FROM books),
marks AS (SELECT book, volume, i - 1 AS ord, trim(r[i], ' ') AS raw FROM t, generate_series(1, len(r)) g(i)),
nums AS (SELECT book, volume, ord, raw::INTEGER AS n FROM marks WHERE regexp_matches(raw, '^[0-9]+$')),
lagged AS (SELECT *, lag(n) OVER (PARTITION BY book, volume ORDER BY ord) AS before FROM nums)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _table(spark, sf_dir, "books").select(F.struct("book", "volume").alias("k"), "light")
    return segment.danda_marks(books, "k", "light")


@_query(f"WITH {_MARKS} SELECT book, volume, ord::INTEGER AS ord, raw FROM marks")
def q_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("k.book", "k.volume", "ord", "raw")


@_query(f"WITH {_MARKS} SELECT book, volume, count(*) AS numbers, round(coalesce(sum((before IS NOT NULL AND (n = before + 1 OR n = 1))::INTEGER), 0) / greatest(1, count(*) - 1), 6) AS in_sequence FROM lagged GROUP BY ALL")
def q_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.number_sequence(_marks(spark, sf_dir), "k").select("k.book", "k.volume", "numbers", F.round("in_sequence", 6).alias("in_sequence"))


_BLOCKS = """blocks AS (SELECT book, volume, ord, n, sum(coalesce((before > n AND n <= 2)::INTEGER, 0)) OVER (PARTITION BY book, volume ORDER BY ord) AS block FROM lagged)"""


@_query(f"WITH {_MARKS}, {_BLOCKS} SELECT book, volume, block::BIGINT AS block, ord::INTEGER AS ord, n FROM blocks")
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.numbered_blocks(_marks(spark, sf_dir), "k").select("k.book", "k.volume", "block", "ord", "n")


@_query(
    rf"""WITH {_MARKS},
b AS (SELECT *, sum((before IS NOT NULL AND (n = 1 OR (n = 2 AND before > 2)))::INTEGER) OVER (PARTITION BY book, volume ORDER BY ord) AS run FROM lagged),
p AS (SELECT *, row_number() OVER (PARTITION BY book, volume, run ORDER BY ord) - 1 AS i FROM b),
r AS (SELECT book, volume, run, coalesce(max(n) FILTER (n <= i + 4), count(*)) AS v FROM p GROUP BY ALL)
SELECT book, volume, sum(v)::BIGINT AS verses FROM r GROUP BY ALL"""
)
def q_verse_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = segment.numbered_blocks(_marks(spark, sf_dir), "k")
    return segment.verse_counts(blocks, "k").select("k.book", "k.volume", "verses")


@_query(
    rf"""SELECT page_id, len(list_filter(regexp_split_to_array({_light("text")}, {_sql(fixed.SENTENCE_END)}), lambda x: len(regexp_extract_all(x, {_sql(fixed.LETTER)})) >= 8))::INTEGER AS sentences FROM pages"""
)
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.split(text.light(F.col("text")), fixed.SENTENCE_END)
    return _table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(pieces, lambda x: text.letters(x) >= 8)).alias("sentences"))


@_query(
    rf"""WITH c AS (SELECT page_id, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[0-9]{{1,4}}$'))) AS n, {_count("text", fixed.LETTER)} AS letters FROM pages WHERE text IS NOT NULL)
SELECT page_id, n >= 6 AND n > 0.1 * greatest(1, letters) AS is_list FROM c"""
)
def q_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").filter("text is not null").select("page_id", segment.looks_like_list(F.col("text")).alias("is_list"))


@_query()
def q_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.found_works(assembled_books(spark, sf_dir), _table(spark, sf_dir, "catalog"))


# ---------------------------------------------------------------- matching

_QUERIES_SQL = rf"""
pieces AS (SELECT pos, part, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(l, '\.{{3,}}|…'), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: {_key("x")}), lambda x: x <> '') AS ks FROM
  (SELECT pos, 'aadi' AS part, {_light("replace(regexp_replace(coalesce(opening, ''), '\\{[^}]*\\}', '', 'g'), '#', '')")} AS l FROM catalog UNION ALL
   SELECT pos, 'ant', {_light("replace(regexp_replace(coalesce(closing, ''), '\\{[^}]*\\}', '', 'g'), '#', '')")} FROM catalog)),
queries AS (SELECT pos, part, CASE WHEN part = 'aadi' THEN substring(coalesce(list_filter(ks, lambda x: length(x) >= 15)[1], ks[1], ''), 1, 160)
  ELSE right(coalesce(list_filter(ks, lambda x: length(x) >= 15)[-1], ks[-1], ''), 160) END AS query FROM pieces)"""


@_query(f"WITH {_QUERIES_SQL} SELECT pos, part, query FROM queries")
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.queries(_table(spark, sf_dir, "catalog"))


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "books").select(F.concat_ws("#", "book", "volume").alias("book"), text.key_of_light(F.col("light")).alias("key"))


_GRAMS = f"""keys AS (SELECT concat_ws('#', book, volume) AS book, {_key("light")} AS key FROM books WHERE light IS NOT NULL),
chars AS (SELECT book, string_split_regex(key, '') AS c FROM keys),
grams AS (SELECT book, unnest(range(0, len(c) - 3)) AS p, len(c) AS n, unnest([c[i] || c[i + 1] || c[i + 2] || c[i + 3] for i in range(1, len(c) - 2)]) AS gram FROM chars),
kept AS (SELECT book, gram, list(p) AS places FROM grams GROUP BY book, gram HAVING count(*) <= greatest(50, max(n) // 2000))"""


@_query(f"WITH {_GRAMS} SELECT gram, count(*) AS n FROM grams GROUP BY gram ORDER BY n DESC, gram LIMIT 100")
def q_grams_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent 4-grams of all books."""
    grams = _volumes(spark, sf_dir).select(F.explode(text.grams(F.col("key"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gram").limit(100)


@_query(
    rf"""WITH {_QUERIES_SQL}, {_GRAMS},
asked AS (SELECT pos, part, length(query) - 3 AS g, o - 1 AS off, substring(query, o, 4) AS gram FROM queries, generate_series(1, length(query) - 3) s(o) WHERE length(query) - 3 >= 3),
hits AS (SELECT pos, part, book, g, off, unnest(places) AS p FROM asked JOIN kept USING (gram)),
votes AS (SELECT pos, part, book, floor((p - off) / 24)::BIGINT AS bucket, count(*) AS votes, max(g) AS g FROM hits GROUP BY ALL)
SELECT pos, part, book, bucket, votes, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pos, part, book ORDER BY votes DESC, bucket) AS rank FROM votes WHERE votes >= greatest(3, floor(0.12 * g))) WHERE rank <= 12"""
)
def q_vote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.candidate_regions(match.queries(_table(spark, sf_dir, "catalog")), cut(_volumes(spark, sf_dir)))


@_query()
def q_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.located(_table(spark, sf_dir, "catalog"), book_pages(spark, sf_dir))


@_query()
def q_linked_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works found in the books, linked to the entries located there, with orphans."""
    texts, catalog = book_pages(spark, sf_dir), _table(spark, sf_dir, "catalog")
    books = assembled_books(spark, sf_dir, texts)
    works, occ = cut(run.found_works(books, catalog)), cut(match.located(catalog, texts))
    return match.linked_works(works, occ, segment.spans_of_books(books), catalog, match.page_scripts(_table(spark, sf_dir, "pages")), books)


@_query(
    """SELECT a.work_id, b.work_id AS other FROM works a JOIN works b ON a.book = b.book AND a.work_id <> b.work_id
WHERE greatest(0, least(a.span_end, b.span_end) - greatest(a.span_start, b.span_start)) / greatest(1, a.span_end - a.span_start) >= 0.5 OR (b.span_start >= a.span_start AND b.span_start < a.span_end)"""
)
def q_overlap_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _table(spark, sf_dir, "works").filter("span_start is not null and span_end is not null")
    left = w.select("book", "work_id", F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    right = w.select("book", F.col("work_id").alias("other"), F.col("span_start").alias("os"), F.col("span_end").alias("oe"))
    return match.overlapping(left, right).filter("work_id <> other").select("work_id", "other")


@_query(
    rf"""WITH s AS (SELECT book, page, {_count("coalesce(text, '')", r"[\x{0A80}-\x{0AFF}]")} AS g, {_count("coalesce(text, '')", r"[\x{0900}-\x{0963}\x{0966}-\x{097F}]")} AS d FROM pages),
p AS (SELECT book, page, CASE WHEN g > d THEN 'Gujarati' ELSE 'Devanagari' END AS script FROM s WHERE g + d > 0),
n AS (SELECT work_id, p.script, count(*) AS n FROM works w JOIN p ON p.book = w.book AND p.page BETWEEN w.start_page AND w.end_page GROUP BY ALL)
SELECT work_id, script FROM n QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY n DESC, script) = 1"""
)
def q_range_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _table(spark, sf_dir, "works").select("work_id", "book", "start_page", "end_page")
    return match.range_scripts(works, "work_id", match.page_scripts(_table(spark, sf_dir, "pages")))


@_query("WITH m AS (SELECT id, max(pos) AS pos FROM catalog WHERE id IS NOT NULL GROUP BY id) SELECT a.pos, c.name FROM catalog a JOIN m ON a.id = m.id JOIN catalog c ON c.pos = m.pos")
def q_last_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry with a number, and the name of the last entry of that number, which names all of them."""
    entries = _table(spark, sf_dir, "catalog").filter("id is not null")
    return entries.select("pos", "id").join(match.last_entries(entries), "id").select("pos", "name")


@_query(
    f"""WITH k AS (SELECT work_id, book, start_page, {_key(_light("aadi"))} AS key FROM works),
p AS (SELECT work_id, key, lag(key) OVER (PARTITION BY book ORDER BY start_page, work_id) AS before FROM k),
l AS (SELECT work_id, key, before, list_transform(string_split_regex(key, ''), lambda c: [unicode(c)]) AS a, list_transform(string_split_regex(before, ''), lambda c: unicode(c)) AS b FROM p WHERE before IS NOT NULL),
c AS (SELECT work_id, length(key) AS n, length(before) AS m, CASE WHEN key = '' OR before = '' THEN 0 ELSE list_reduce(list_prepend([0 for x in range(length(before) + 1)], a), lambda r, c:
  list_transform(range(1, len(r) + 1), lambda j: list_max([CASE WHEN i > 1 AND b[i - 1] = c[1] THEN r[i - 1] + 1 ELSE r[i] END for i in range(1, j + 1)])))[-1] END AS common FROM l)
SELECT work_id, round_even(CASE WHEN n + m = 0 THEN 100.0 ELSE 200.0 * common / (n + m) END, 1) AS ratio FROM c"""
)
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of the opening of each work to that of the work before it in its book."""
    before = F.lag("key").over(W.partitionBy("book").orderBy("start_page", "work_id"))
    rows = _table(spark, sf_dir, "works").select("work_id", "book", "start_page", text.key(F.col("aadi")).alias("key")).withColumn("before", before).filter("before is not null")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"work_id": b["work_id"], "ratio": [round(similarity.ratio(x, y), 1) for x, y in zip(b["key"], b["before"])]})

    return rows.select("work_id", "key", "before").mapInPandas(run, "work_id bigint, ratio double")


# ---------------------------------------------------------------- groups and report


@_query(
    rf"""WITH k AS (SELECT work_id, concat(substring({_key(_light("aadi"))}, 1, 120), '|', right({_key(_light("ant"))}, 120)) AS k FROM works),
f AS (SELECT work_id, CASE WHEN length(k) < 12 THEN work_id ELSE min(work_id) OVER (PARTITION BY CASE WHEN length(k) < 12 THEN NULL ELSE k END) END AS root FROM k)
SELECT work_id, dense_rank() OVER (ORDER BY root)::INTEGER AS group_no FROM f"""
)
def q_groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "works").select("work_id", "aadi", "ant", F.lit(None).cast("string").alias("no"))
    return group.groups(rows, ["work_id"], "no", fixed.Settings(duplicate_threshold=100)).select("work_id", "group_no")


@_query()
def q_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "works").select("work_id", "book", "start_page", "aadi", "ant", "kruti_no")
    return group.groups(rows, ["book", "start_page", "work_id"], "kruti_no").select("work_id", "group_no")


def _legible(c: str) -> str:
    return rf"regexp_replace(coalesce({c}::VARCHAR, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


_REPORT = ["group_no", "copy", "book", "book_name", "kruti_no", "name", "aadi", "ant", "start_page", "end_page", "book_start", "book_end", "verses", "script", "match", "match_score", "check", "remarks"]


@_query(
    f"""SELECT work_id, group_no, concat(row_number() OVER (PARTITION BY group_no ORDER BY book NULLS FIRST, coalesce(start_page, 0), work_id), ' of ', count(*) OVER (PARTITION BY group_no)) AS copy,
  book, {_legible("book_name")} AS book_name, coalesce(kruti_no, '') AS kruti_no, coalesce(nullif({_legible("kruti_name")}, ''), {_legible("title")}) AS name, {_legible("aadi")} AS aadi, {_legible("ant")} AS ant,
  coalesce(start_page::VARCHAR, '-') AS start_page, coalesce(end_page::VARCHAR, '-') AS end_page, coalesce(book_start::VARCHAR, '') AS book_start, coalesce(book_end::VARCHAR, '') AS book_end, coalesce(verses::VARCHAR, '') AS verses,
  coalesce(script, '') AS script, coalesce(match, '') AS match, coalesce(match_score::VARCHAR, '') AS match_score,
  CASE WHEN len(coalesce(checks, [])) = 0 THEN 'OK' ELSE array_to_string(checks, '; ') END AS "check", '' AS remarks FROM works"""
)
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(_table(spark, sf_dir, "works"), "work_id").select("work_id", *_REPORT)


@_query()
def q_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the pages and the catalogue: the report."""
    titles = _table(spark, sf_dir, "books").select("book", F.col("book_name").alias("title"))
    return run.report_of_run(cut(run.works_of_run(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "catalog"), titles)))


@_query("SELECT count(*) AS works, count(DISTINCT group_no) AS groups, count(DISTINCT book) AS books, count(*) FILTER (match <> 'New') AS in_catalogue FROM works")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_table(spark, sf_dir, "works"))


# ---------------------------------------------------------------- sources and streams


@_query("SELECT page_id, substring(sha1(concat_ws('|', book, length(text)::VARCHAR, page::VARCHAR, 'tesseract', '300')), 1, 16) AS cache_id FROM pages")
def q_cache_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", readers.cache_id(F.col("book"), F.length("text"), F.col("page"), F.lit("tesseract"), F.lit("300")).alias("cache_id"))


@_query(
    r"""WITH s AS (SELECT DISTINCT book, regexp_replace(book, '(?i)\.pdf$', '') AS stem FROM books),
t AS (SELECT book, stem, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '\s*\(\d+\)$', ''), '^[A-Za-z]\d{4,}[_\- ]+', ''), '_\d{5,}(_.*)?$', ''), '(?i)_(\d+dpi|hr\d*|std|data|h_r|duplicate)$', ''), '[_\-]+', ' ', 'g'), ' ') AS t FROM s)
SELECT book, CASE WHEN t = '' THEN stem ELSE t END AS title FROM t"""
)
def q_book_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "books").select("book").distinct().select("book", readers.book_title(F.col("book")).alias("title"))


@_query("SELECT pos::BIGINT AS pos, trim(id, ' ') AS id, trim(name, ' ') AS name, trim(opening, ' ') AS opening, trim(closing, ' ') AS closing FROM catalog WHERE coalesce(trim(opening, ' '), '') <> '' OR coalesce(trim(closing, ' '), '') <> ''")
def q_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue read by the place of its columns, as no header is one of the known ones."""
    return readers.catalogue(_table(spark, sf_dir, "catalog").select("id", "name", "opening", "closing", "pos"), order=F.col("pos"))


@_query("SELECT library, date_trunc('day', arrived_at)::TIMESTAMP AS day, count(*) AS pages FROM pages WHERE arrived_at IS NOT NULL GROUP BY ALL")
def q_stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken in by a stream that goes on where it stopped, then counted by library and day of arrival."""
    import uuid

    from ..session import delete, shared_dir

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = _table(spark, sf_dir, "pages")
    # a stream reads folders: the table's own, or the one that holds its only file
    single = [p for p in table.inputFiles() if p.endswith("/pages.parquet")]
    stream = ingest.page_stream(spark, sf_dir if single else f"{sf_dir}/pages.parquet", table.schema, only="pages.parquet" if single else "*")
    ingest.ingest(stream, f"{base}/pages", f"{base}/state", ["page_id"])
    counted = cut(ingest.arrivals(spark.read.parquet(f"{base}/pages")).withColumn("day", F.col("day").cast("timestamp_ntz")))
    delete(spark, base)
    return counted

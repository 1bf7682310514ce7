"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, components, encoding, garbled, language, leaks, linkage, lookalikes, nearcopies, scanned


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_repaired(spark, sf_dir).select("page_id")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repaired(_table(spark, sf_dir, "pages"), "page_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.damaged_lines(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "books"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.clean_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "books"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _table(spark, sf_dir, "catalog").withColumn("pos", F.col("pos").cast("bigint"))
    return linkage.linked(catalog, "pos", ("opening", "closing"), _table(spark, sf_dir, "works"), "work_id", ("aadi", "ant"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).select(F.col("pos").cast("int").alias("pos"), "work_id")


def p3_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched work with its best entry: kruti_no is the entry's id, by score and then the order of the list."""
    ids = _table(spark, sf_dir, "catalog").select(F.col("pos").cast("bigint").alias("pos"), F.col("id").alias("kruti_no"))
    best = p3_links(spark, sf_dir).groupBy("work_id").agg(F.max_by(F.struct("pos", "match_score"), F.struct("match_score", -F.col("pos"))).alias("m"))
    return best.select("work_id", "m.pos", "m.match_score").join(ids, "pos").select("work_id", "kruti_no", "match_score", "pos")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copy_pairs(_table(spark, sf_dir, "works"), "work_id", "aadi", "ant").toDF("work_a", "work_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(_table(spark, sf_dir, "works"), "work_id", "aadi", "ant")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_groups(_table(spark, sf_dir, "work_pairs"), "left_work", "right_work").select("group_no", F.col("node").alias("work_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(_table(spark, sf_dir, "pages"), "page_id", "library", "book", "text").withColumn("line_no", F.col("line_no").cast("int"))


def p6_pages_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "library", "book", "text")
    frequent = boilerplate.frequent_lines(pages, "library", "book", "text")
    return boilerplate.without_lines(pages, "text", "library", frequent).select("page_id", "text", "removed")


def p6_books_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent = boilerplate.frequent_lines(_table(spark, sf_dir, "pages"), "library", "book", "text")
    books = _table(spark, sf_dir, "books").select("book", "volume", "library", "light")
    return boilerplate.without_lines(books, "light", "library", frequent, unify=True).select("book", "volume", "light", "removed")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_fields(_table(spark, sf_dir, "works"), "work_id", ["title", "aadi", "ant"])


def p7_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.unified(_table(spark, sf_dir, "works"), "work_id", ["title", "aadi", "ant"]).select("work_id", "field", "one_form")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_runs(spark, sf_dir).select("item_id", "doc_id")


def p9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "benchmark"), "item_id", _table(spark, sf_dir, "documents"), "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(p10_stretches(spark, sf_dir), "doc_id")


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.stretches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "lang_samples"), "doc_id", "text", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_clean, p3_found, p3_links, p3_works, p4_found, p4_classes, p5_found, p6_found, p6_pages_clean, p6_books_clean, p7_found, p7_one_form, p8_ids, p9_found, p9_runs, p10_found, p10_stretches)
}

_FREQUENT = r"""
lines AS (SELECT page_id, library, book, i AS line_no, lower(regexp_replace(string_split(text, chr(10))[i], '[^\p{L}\p{M}]', '', 'g')) AS letters
  FROM pages, generate_series(1, len(string_split(text, chr(10)))) g(i)),
frequent AS (SELECT library, letters FROM (SELECT library, letters, count(DISTINCT page_id) AS n, count(DISTINCT book) AS books FROM lines WHERE letters <> '' GROUP BY ALL) l
  JOIN (SELECT library, count(*) AS total FROM pages GROUP BY library) t USING (library) WHERE books >= 3 AND n >= 0.04 * total)
"""

ORACLES: dict[str, str] = {
    "p5_found": """
WITH RECURSIVE e AS (SELECT left_work AS a, right_work AS b FROM work_pairs WHERE left_work <> right_work UNION SELECT right_work, left_work FROM work_pairs WHERE left_work <> right_work),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT least(node, min(seen)) AS group_no, node AS work_id FROM r GROUP BY node""",
    "p6_found": f"WITH {_FREQUENT} SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM lines SEMI JOIN frequent USING (library, letters)",
}

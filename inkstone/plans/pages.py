"""Queries over pages and their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import letter_tokens, one_line, word_count
from inkstone.operators import lines as L
from inkstone.operators import quality as Q
from inkstone.plans.base import one_line_sql, pages, pages_sql
from inkstone.session import read_table as table


def _size() -> Column:
    """A stand-in for font sizes, which the table of pages does not have."""
    return F.when(F.length("text") % 7 == 0, F.lit(8.0)).otherwise(F.lit(11.0))


def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    quality = Q.text_quality(pages(spark, sf, "text"), table(spark, sf, "lexicon"), ["doc", "page"])
    return quality.select("doc", "page", F.round("quality", 6).alias("quality"), "n_words", "dict_lang")


def page_route(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf, "words_before", "quality_before", "image_coverage")
    d = Q.route(F.col("words_before"), F.col("quality_before"), F.col("image_coverage"))
    return p.select("doc", "page", d["route"].alias("new_route"), d["reason"].alias("new_reason"))


def route_ocr_override(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf, "words_before", "quality_before", "image_coverage", "ocr_quality")
    d = Q.keep_better(Q.route(F.col("words_before"), F.col("quality_before"), F.col("image_coverage")), F.col("quality_before"), F.col("ocr_quality"))
    return p.select("doc", "page", d["route"].alias("new_route"), d["reason"].alias("new_reason"))


def page_report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.document_report(pages(spark, sf, "route", "reason", "quality", "words"))


def page_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return Q.reason_counts(pages(spark, sf, "reason"))


def ocr_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf, "ocr_confidence", "image_coverage")
    return p.groupBy("doc").agg(F.round(F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)), 6).alias("mean_confidence"), F.max("image_coverage").alias("most_coverage"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf, "text").select("doc", "page", F.size(letter_tokens(F.col("text"))).alias("tokens"), word_count(F.col("text")).alias("n_words"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf, "text").select("doc", "page", one_line(F.col("text")).alias("cleaned"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_lines(pages(spark, sf, "text"), _size())


def body_font_mode(spark: SparkSession, sf: str) -> DataFrame:
    return L.body_size(_lines(spark, sf))


def running_heads(spark: SparkSession, sf: str) -> DataFrame:
    return L.running_heads(_lines(spark, sf), 0.2)


def body_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.drop_causes(_lines(spark, sf)).where("cause IS NULL").select("doc", "page", "line_no", "text")


def dropped_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.dropped_lines(_lines(spark, sf))


def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_offsets(pages(spark, sf, "text"))


def _offsets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    starts = L.page_offsets(pages(spark, sf, "text"))
    ends = starts.groupBy("doc").agg(F.max(F.col("start_off") + F.col("length")).alias("total"))
    return ends.select("doc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total"), F.lit(500).cast("bigint"))).alias("off")), starts


def offset_to_page(spark: SparkSession, sf: str) -> DataFrame:
    return L.offset_to_page(*_offsets(spark, sf))


def page_to_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Where every page of a work begins, numbers that are missing in it and one past its end included."""
    starts = L.page_offsets(pages(spark, sf, "text"))
    bounds = starts.groupBy("doc").agg(F.min("page").alias("least"), F.max("page").alias("most"))
    return L.page_to_offset(bounds.select("doc", F.explode(F.sequence("least", F.col("most") + 1)).alias("page")), starts)


def pages_interval_text(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf, "text")
    ranges = p.select("doc", F.col("page").alias("first_page"), (F.col("page") + 1).alias("last_page"))
    return L.range_text(ranges, p)


ALL = (page_quality, page_route, route_ocr_override, page_report, page_reasons, ocr_confidence, token_counts, clean_text, body_font_mode, running_heads, body_lines, dropped_lines, page_offsets, offset_to_page, page_to_offset, pages_interval_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


HYPHEN = r"regexp_replace({}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
TOKENS = rf"regexp_extract_all(lower({HYPHEN.format("coalesce(text, '')")}), '\p{{L}}{{2,}}')"
ROUTE = """CASE WHEN coalesce(words_before, 0) < 20 AND coalesce(image_coverage, 0) >= 0.5 THEN 'ocr' WHEN coalesce(words_before, 0) < 20 THEN 'native'
    WHEN coalesce(quality_before, 0) < 0.85 THEN 'ocr' ELSE 'native' END AS r,
    CASE WHEN coalesce(words_before, 0) < 20 AND coalesce(image_coverage, 0) >= 0.5 THEN 'scan_without_text' WHEN coalesce(words_before, 0) < 20 THEN 'sparse_page'
    WHEN coalesce(quality_before, 0) < 0.85 THEN 'low_quality_text' ELSE 'good_text' END AS why"""
LINES = (
    "WITH "
    + pages_sql("text")
    + """, raw AS (SELECT doc, page, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, trim(unnest(string_split(text, chr(10)))) AS text FROM p WHERE text IS NOT NULL),
l AS (SELECT *, CASE WHEN length(text) % 7 = 0 THEN 8.0::DOUBLE ELSE 11.0::DOUBLE END AS size FROM raw WHERE text <> ''),
sizes AS (SELECT doc, size, sum(length(text)) AS chars, min((page, line_no)) AS first FROM l GROUP BY ALL),
body AS (SELECT doc, size AS body_size FROM sizes QUALIFY row_number() OVER (PARTITION BY doc ORDER BY chars DESC, first) = 1),
edged AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY line_no) <= 2 OR row_number() OVER (PARTITION BY doc, page ORDER BY line_no DESC) <= 2 AS is_edge,
    trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS head FROM l),
totals AS (SELECT doc, count(DISTINCT page) AS n_pages FROM l GROUP BY doc),
heads AS (SELECT doc, head, count(DISTINCT page) AS pages_with, n_pages FROM edged JOIN totals USING (doc) WHERE is_edge GROUP BY doc, head, n_pages),
caused AS (SELECT e.doc, e.page, e.line_no, e.text, CASE WHEN size < body_size * 0.9 THEN 'small_font' WHEN is_edge AND h.head IS NOT NULL THEN 'running_head'
    WHEN regexp_full_match(lower(e.text), '[^\\p{L}_]*|[ivxlcdm]+') THEN 'page_number' END AS cause
    FROM edged e JOIN body USING (doc) LEFT JOIN (SELECT * FROM heads WHERE pages_with > n_pages * 0.3) h ON h.doc = e.doc AND h.head = e.head)
"""
)
OFFSETS = "WITH " + pages_sql("text") + """, o AS (SELECT doc, page, length(coalesce(text, ''))::INT AS length,
    coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_off FROM p)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "page_quality": "WITH " + pages_sql("text") + rf""", t AS (SELECT doc, page, unnest({TOKENS}) AS token FROM p),
            k AS (SELECT DISTINCT lower(trim(lang)) AS lang, lower(word) AS token FROM lexicon WHERE word IS NOT NULL AND lang IS NOT NULL),
            w AS (SELECT doc, page, count(*) AS n_words FROM t GROUP BY ALL),
            n AS (SELECT doc, page, lang, count(*) AS n FROM t JOIN k USING (token) GROUP BY ALL),
            b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, lang) = 1)
            SELECT p.doc, p.page, round(coalesce(n / n_words, 0.0), 6) AS quality, coalesce(n_words, 0) AS n_words, lang AS dict_lang FROM p LEFT JOIN w USING (doc, page) LEFT JOIN b USING (doc, page)""",
        "page_route": "WITH " + pages_sql("words_before", "quality_before", "image_coverage") + f" SELECT doc, page, r AS new_route, why AS new_reason FROM (SELECT doc, page, {ROUTE} FROM p)",
        "route_ocr_override": "WITH "
        + pages_sql("words_before", "quality_before", "image_coverage", "ocr_quality")
        + f""" SELECT doc, page, CASE WHEN stays THEN 'native' ELSE r END AS new_route, CASE WHEN stays THEN 'ocr_not_better' ELSE why END AS new_reason
            FROM (SELECT *, coalesce(why = 'low_quality_text' AND coalesce(ocr_quality, 0) <= quality_before, false) AS stays FROM (SELECT *, {ROUTE} FROM p))""",
        "page_report": "WITH "
        + pages_sql("route", "reason", "quality", "words")
        + """ SELECT doc, count(*) AS pages, count_if(route = 'native')::BIGINT AS native_pages, count_if(route = 'ocr')::BIGINT AS ocr_pages,
            coalesce(floor((2 * sum(round(quality * 1e6)::BIGINT) FILTER (words >= 20) + 1000 * count(quality) FILTER (words >= 20)) / nullif(2000 * count(quality) FILTER (words >= 20), 0)) / 1000, 0.0) AS mean_quality,
            coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (reason = 'ocr_not_better'), '') AS kept_original,
            coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (words >= 20 AND quality < 0.85), '') AS still_low_quality FROM p GROUP BY doc""",
        "page_reasons": "WITH " + pages_sql("reason") + " SELECT doc, reason, count(*) AS n FROM p GROUP BY ALL",
        "ocr_confidence": "WITH " + pages_sql("ocr_confidence", "image_coverage") + " SELECT doc, round(coalesce(avg(ocr_confidence), 0.0), 6) AS mean_confidence, max(image_coverage) AS most_coverage FROM p GROUP BY doc",
        "token_counts": "WITH " + pages_sql("text") + rf" SELECT doc, page, len({TOKENS})::INT AS tokens, len(regexp_extract_all(coalesce(text, ''), '[^\s]+'))::INT AS n_words FROM p",
        "clean_text": "WITH " + pages_sql("text") + " SELECT doc, page, " + one_line_sql("text") + " AS cleaned FROM p",
        "body_font_mode": LINES + "SELECT doc, body_size FROM body",
        "running_heads": LINES + "SELECT doc, head, pages_with FROM heads WHERE pages_with > n_pages * 0.2",
        "body_lines": LINES + "SELECT doc, page, line_no, text FROM caused WHERE cause IS NULL",
        "dropped_lines": LINES + "SELECT doc, cause, count(*) AS n FROM caused WHERE cause IS NOT NULL GROUP BY ALL",
        "page_offsets": OFFSETS + "SELECT * FROM o",
        "offset_to_page": OFFSETS + """, asked AS (SELECT doc, unnest(range(0, max(start_off + length) + 1, 500)) AS off FROM o GROUP BY doc)
            SELECT doc, off, max(page) AS page FROM asked JOIN o USING (doc) WHERE start_off <= off GROUP BY doc, off""",
        "page_to_offset": OFFSETS + """, asked AS (SELECT doc, unnest(range(min(page), max(page) + 2))::INT AS page FROM o GROUP BY doc), last AS (SELECT doc, max(start_off) AS end_off FROM o GROUP BY doc)
            SELECT a.doc, a.page, coalesce(o.start_off, end_off) AS off FROM asked a ASOF LEFT JOIN o ON o.doc = a.doc AND o.page >= a.page LEFT JOIN last ON last.doc = a.doc""",
        "pages_interval_text": "WITH "
        + pages_sql("text")
        + """ SELECT a.doc, a.page AS first_page, a.page + 1 AS last_page,
            substring(coalesce(a.text, '') || chr(10) || coalesce(b.text, ''), 1, 12000) AS text FROM p a LEFT JOIN p b ON b.doc = a.doc AND b.page = a.page + 1""",
    }

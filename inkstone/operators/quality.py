"""Quality of page texts, the route of each page, and reports on documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import letter_tokens
from inkstone.session import cut

# fixed values: thresholds of the routing decision
MIN_WORDS, QUALITY_MIN, IMAGE_COVERAGE = 20, 0.85, 0.5
#: Words of a dictionary that is broadcast, parts of a larger one, and languages of any.
DICTIONARY_ROWS, SALT, MOST_LANGUAGES = 1_000_000, 32, 200
#: Page numbers of a list that are shown on a console.
SHOWN = 15


def text_quality(pages: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", lang: str | None = None) -> DataFrame:
    """``keys, quality, n_words, dict_lang``: the share of a page's tokens that are words of its language in the dictionary (``lang, word``).

    With ``lang`` that language is asked; without, each page is measured by the language that knows most of
    its words (of equals the first by name; null where none knows any). Pages without tokens, null texts
    included, have quality 0 and 0 words. A dictionary of up to ``DICTIONARY_ROWS`` words is broadcast, so that
    a page's counts are made before anything is shuffled; a larger one is joined in salted parts, as few words
    make up most of all tokens.
    """
    words = dictionary.where("word IS NOT NULL AND lang IS NOT NULL").select(F.lower("word").alias("token"), F.lower(F.trim("lang")).alias("lang"))
    if lang is not None:
        words = words.where(F.col("lang") == lang.lower())
    known = cut(words.groupBy("token").agg(F.collect_set("lang").alias("langs")))
    names = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"a dictionary of more than {MOST_LANGUAGES} languages")
    long = pages.select(*keys, F.explode_outer(letter_tokens(F.col(text))).alias("token"))
    if known.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS:
        joined = long.join(F.broadcast(known), "token", "left")
    else:
        salted = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = long.withColumn("_s", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")).join(salted, ["token", "_s"], "left")
    hits = [F.count_if(F.array_contains("langs", n)).alias(f"_k{k}") for k, n in enumerate(names)]
    counted = joined.groupBy(*keys).agg(F.count("token").alias("n_words"), *hits)
    # the most words first, then the least name
    best = F.array_min(F.array(*[F.struct((-F.col(f"_k{k}")).alias("n"), F.lit(n).alias("lang")) for k, n in enumerate(names)])) if names else F.lit(None).cast("struct<n: bigint, lang: string>")
    scored = counted.withColumn("_b", best)
    share = F.when(F.col("n_words") > 0, F.coalesce(-F.col("_b.n"), F.lit(0)) / F.col("n_words")).otherwise(0.0)
    return scored.select(*keys, share.alias("quality"), "n_words", F.when(F.col("_b.n") < 0, F.col("_b.lang")).alias("dict_lang"))


def read_again(pages: DataFrame, ocr: Callable) -> DataFrame:
    """``doc, page, ocr_text, ocr_confidence``: pages read by an OCR provider; the confidence is the mean over lines, 0 without any.

    ``ocr`` is a picklable factory of a function from ``(doc, page)`` to lines ``[(text, confidence)]``, called once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for batch in batches:
            texts, sure = [], []
            for doc, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = read or ocr()
                lines = read(doc, page)
                texts.append("\n".join(t for t, _ in lines))
                sure.append(sum(c for _, c in lines) / len(lines) if lines else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sure, pa.float64())], names=["doc", "page", "ocr_text", "ocr_confidence"])

    return pages.select("doc", "page").mapInArrow(run, "doc string, page int, ocr_text string, ocr_confidence double")


def image_coverage(boxes: Column, page_area: Column) -> Column:
    """The largest image's share of the page, at most 1; ``boxes`` is array<struct<width,height>>; no image gives 0."""
    shares = F.transform(boxes, lambda b: b["width"] * b["height"] / page_area)
    return F.least(F.lit(1.0), F.coalesce(F.array_max(shares), F.lit(0.0)))


def route(n_words: Column, quality: Column, coverage: Column, quality_min: float = QUALITY_MIN) -> Column:
    """``struct<route, reason>`` of a page; nulls count as no words, no quality, no image."""
    few = F.coalesce(n_words, F.lit(0)) < MIN_WORDS
    pair = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    return (
        F.when(few & (F.coalesce(coverage, F.lit(0.0)) >= IMAGE_COVERAGE), pair("ocr", "scan_without_text"))
        .when(few, pair("native", "sparse_page"))
        .when(F.coalesce(quality, F.lit(0.0)) < quality_min, pair("ocr", "low_quality_text"))
        .otherwise(pair("native", "good_text"))
    )


def keep_better(decision: Column, quality_before: Column, ocr_quality: Column, margin: float = 0.0) -> Column:
    """The route after the scan was read again: a text of low quality is kept unless the new one is better by more than ``margin``."""
    stays = (decision["reason"] == "low_quality_text") & (F.coalesce(ocr_quality, F.lit(0.0)) <= quality_before + margin)
    return F.when(stays, F.struct(F.lit("native").alias("route"), F.lit("ocr_not_better").alias("reason"))).otherwise(decision)


def document_report(pages: DataFrame) -> DataFrame:
    """One row a document: pages by route, mean quality of pages with words, pages kept and pages still poor.

    ``pages`` has ``doc, page, route, reason, quality, words``. The mean is over pages of at least
    20 words and 0 where there are none; it is summed in millionths, so that it does not hang on the order.
    """
    wordy = F.col("words") >= MIN_WORDS
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("page")))), ",")
    total, n = F.sum(F.when(wordy, F.round(F.col("quality") * 1e6).cast("bigint"))), F.count(F.when(wordy, F.col("quality")))
    return pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("route") == "native").alias("native_pages"),
        F.count_if(F.col("route") == "ocr").alias("ocr_pages"),
        F.coalesce(F.floor((2 * total + 1000 * n) / F.nullif(2000 * n, F.lit(0))) / 1000, F.lit(0.0)).alias("mean_quality"),
        listed(F.col("reason") == "ocr_not_better").alias("kept_original"),
        listed(wordy & (F.col("quality") < QUALITY_MIN)).alias("still_low_quality"),
    )


def shown(pages: Column, most: int = SHOWN) -> Column:
    """The first page numbers of a list joined by commas, and a sign where more follow."""
    numbers = F.split(pages, ",")
    return F.when(F.size(numbers) > most, F.concat(F.array_join(F.slice(numbers, 1, most), ","), F.lit(",..."))).otherwise(pages)


def reason_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc", "reason").agg(F.count(F.lit(1)).alias("n"))

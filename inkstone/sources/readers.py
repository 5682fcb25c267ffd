"""Readers: documents as pages, JSON lines, trees, the corpus description and vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "doc string, page int, route string, reason string, quality_before double, words_before int, image_coverage double, ocr_quality double, ocr_confidence double, text string, quality double, words int"
CHUNK_SCHEMA = "chunk_id string, doc string, author string, doc_title string, section_id string, section string, path array<string>, path_ids array<string>, part int, parts int, text string, words int, section_summary string, start_page int, end_page int, also_contains array<string>"
QUESTION_SCHEMA = "id string, community bigint, topic string, question string, answer string, type string, authors array<string>, sources array<struct<chunk_id:string,author:string,title:string,section:string,pages:array<int>>>, model string"
CORPUS_SCHEMA = "doc_pos int, doc string, author string, title string, first_page int, last_page int, exclude array<string>"


SPANS = "array<struct<line_no: int, span_no: int, size: double, text: string>>"


def read_documents(spark: SparkSession, folder: str, provider: Callable, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """Pages ``doc, page, text, image_coverage, spans`` of all files, and files that could not be read ``doc, error, head``.

    A provider's page is ``(page, text, image_coverage)`` or has a fourth part, its spans ``(line_no, span_no, size, text)``;
    ``spans`` is null without. One unreadable file does not stop the others; ``head`` shows its first 16 bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    span_type = pa.list_(pa.struct([("line_no", pa.int32()), ("span_no", pa.int32()), ("size", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = provider()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = Path(path).stem
                try:
                    for number, text, coverage, *spans in read(content):
                        rows.append((doc, number, text, coverage, [dict(zip(("line_no", "span_no", "size", "text"), x, strict=True)) for x in spans[0]] if spans else None, None, None))
                except Exception as e:  # noqa: BLE001 - any fault of a file is reported with the file
                    rows.append((doc, None, None, None, None, f"{type(e).__name__}: {e}", content[:16].hex().upper()))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.int32(), pa.string(), pa.float64(), span_type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc", "page", "text", "image_coverage", "spans", "error", "head"])

    read = files.mapInArrow(run, f"doc string, page int, text string, image_coverage double, spans {SPANS}, error string, head string")
    return read.where("error IS NULL").drop("error", "head"), read.where("error IS NOT NULL").select("doc", "error", "head")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines come out with all fields null and are left out, as are blank lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``doc, raw``: one JSON file a tree, named by its work."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))
    return files.select(F.regexp_replace("name", r"\.json$", "").alias("doc"), "raw")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus description: a mapping of works in JSON, or in YAML where PyYAML is installed.

    It is a hand-written file and is read on the driver.
    """
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        parsed = json.loads(text)
    else:
        import yaml

        parsed = yaml.safe_load(text)
    rows = []
    for place, (doc, entry) in enumerate((parsed.get("documents") or {}).items()):
        pages = entry.get("pages") or [None, None]
        rows.append((place, doc, entry.get("author"), entry.get("title"), pages[0], pages[1], entry.get("exclude")))
    return spark.createDataFrame(rows, CORPUS_SCHEMA)


def load_chunks(chunks: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their work's author and title (and ``doc_pos``, its place, where the corpus has one), and works that have no chunks."""
    works = corpus.select("doc", *(["doc_pos"] if "doc_pos" in corpus.columns else []), F.col("author").alias("work_author"), F.col("title").alias("work_title"))
    joined = chunks.join(works, "doc", "left").withColumn("author", F.coalesce("author", "work_author")).withColumn("doc_title", F.coalesce("doc_title", "work_title"))
    return joined.drop("work_author", "work_title"), works.join(chunks.select("doc").distinct(), "doc", "left_anti").select("doc")


def not_cached(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``work`` that the cache does not have yet."""
    return work.join(cache.select(*keys).distinct(), keys, "left_anti")

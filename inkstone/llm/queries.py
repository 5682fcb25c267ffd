"""The queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, mixing, neighbours, responses, scans, sentences, splitting, subjects
from inkstone.session import read_table as table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return responses.defective_pairs(table(spark, sf, "questions"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf, "vectors")).select("vec_a", "vec_b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents")).select("doc_id", "end_pos")


def p4_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized chunks: those that the splitter cuts, known by their second piece."""
    pieces = splitting.split_oversized(table(spark, sf, "chunks"), with_text=False)
    return pieces.where("piece = 1").select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.page_noise(table(spark, sf, "pages"), table(spark, sf, "corpus"), table(spark, sf, "lexicon"))


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf, "pages"), table(spark, sf, "corpus"), table(spark, sf, "lexicon"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(p8_mix(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = subjects.subject_posteriors(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))
    return found.select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by subject."""
    return p9_found(spark, sf).groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_units, p5_found, p5_pieces, p6_found, p6_paragraphs, p7_ids, p8_mix, p8_shares, p9_found, p9_composition)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": r"""SELECT DISTINCT chunk_id FROM chunks
            WHERE chunk_id IS NOT NULL AND len(regexp_extract_all(text, '[^ \t\n\r]+')) > 1500""",
    }

"""Tables without repeated rows, as the queries read them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import SPACE
from inkstone.session import read_table


def unique(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key; repeated rows carry the same content, so any will do."""
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    if not columns:
        return kept.select(*keys).distinct()
    return kept.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns])


def pages(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return unique(read_table(spark, sf, "pages"), ["doc", "page"], list(columns))


def chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return unique(read_table(spark, sf, "chunks"), ["chunk_id"], list(columns))


def questions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return unique(read_table(spark, sf, "questions"), ["id"], list(columns))


def pages_sql(*columns: str) -> str:
    return "p AS (SELECT doc, page" + "".join(f", first({c}) AS {c}" for c in columns) + " FROM pages WHERE doc IS NOT NULL AND page IS NOT NULL GROUP BY doc, page)"


def chunks_sql(*columns: str) -> str:
    return "c AS (SELECT chunk_id" + "".join(f", first({x}) AS {x}" for x in columns) + " FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"


def questions_sql(*columns: str) -> str:
    return "q AS (SELECT id" + "".join(f", first({x}) AS {x}" for x in columns) + " FROM questions WHERE id IS NOT NULL GROUP BY id)"


def one_line_sql(text: str) -> str:
    """``functions.text.one_line`` as DuckDB sees it."""
    whole = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace({whole}, '{SPACE}*\n{SPACE}*', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"

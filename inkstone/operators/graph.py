"""The property graph of works, sections and chunks as node and edge tables, and walks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.order import row_numbers


def section_id(doc: Column, ids: Column, depth: Column) -> Column:
    """The document and the first ``depth`` ids of a path: unique where titles repeat."""
    return F.concat(doc, F.lit("::"), F.array_join(F.slice(ids, F.lit(1), depth), "/"))


def section_rows(chunks: DataFrame) -> DataFrame:
    """One row a section on any chunk's path: ``id, doc, author, title, depth, parent, start_page, end_page, summary``.

    Pages span all chunks below; the summary is the first non-empty one of the section's own chunks
    (by chunk id). ``parent`` is null at the top. Chunks with null or empty paths add nothing.
    """
    paths = chunks.where(F.size("path") > 0).select("chunk_id", "doc", "author", "path", "path_ids", "start_page", "end_page", "section_summary")
    long = paths.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("path"))))
    own = (F.col("depth") == F.size("path")) & (F.coalesce(F.trim("section_summary"), F.lit("")) != "")
    grouped = long.groupBy(section_id(F.col("doc"), F.col("path_ids"), F.col("depth")).alias("id"), "doc", "depth").agg(
        F.min("author").alias("author"),
        F.min(F.element_at("path", F.col("depth"))).alias("title"),
        F.min(F.when(F.col("depth") > 1, section_id(F.col("doc"), F.col("path_ids"), F.col("depth") - 1))).alias("parent"),
        F.min("start_page").alias("start_page"),
        F.max("end_page").alias("end_page"),
        F.min_by(F.when(own, F.col("section_summary")), F.when(own, F.col("chunk_id"))).alias("summary"),
    )
    return grouped.select("id", "doc", "author", "title", "depth", "parent", "start_page", "end_page", "summary")


def edges(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``kind, src, dst``: document or section to section (HAS_SECTION), section to chunk (HAS_CHUNK)."""
    down = sections.select(F.lit("HAS_SECTION").alias("kind"), F.coalesce("parent", "doc").alias("src"), F.col("id").alias("dst"))
    held = chunks.where(F.size("path") > 0).select(F.lit("HAS_CHUNK").alias("kind"), section_id(F.col("doc"), F.col("path_ids"), F.size("path")).alias("src"), F.col("chunk_id").alias("dst"))
    return down.unionByName(held.distinct())


def next_edges(chunks: DataFrame, order: str, bucket: int = 512) -> DataFrame:
    """``a, b``: each chunk and the next one of its document in order.

    The order is cut into buckets of positions; the last chunk of a bucket looks at the first of the next
    one there is, so a long work is not sorted in one task.
    """
    at = chunks.select("doc", "chunk_id", F.col(order).alias("_o")).withColumn("_b", F.floor(F.col("_o") / bucket))
    w = Window.partitionBy("doc", "_b").orderBy("_o", "chunk_id")
    inside = at.withColumn("_n", F.lead("chunk_id").over(w))
    first = at.groupBy("doc", "_b").agg(F.min(F.struct("_o", "chunk_id"))["chunk_id"].alias("_f"))
    ahead = first.select("doc", "_b", F.lead("_f").over(Window.partitionBy("doc").orderBy("_b")).alias("_x"))
    return inside.join(ahead, ["doc", "_b"]).select(F.col("chunk_id").alias("a"), F.coalesce("_n", "_x").alias("b")).where("b IS NOT NULL")


def hops(edge: DataFrame, most: int = 3) -> DataFrame:
    """``a, b, hops``: everything reached from ``a`` along edges in one to ``most`` steps."""
    found = edge.select("a", "b", F.lit(1).alias("hops"))
    level = found
    for n in range(2, most + 1):
        step = edge.select(F.col("a").alias("b"), F.col("b").alias("_c"))
        level = level.join(step, "b").select("a", F.col("_c").alias("b"), F.lit(n).alias("hops"))
        found = found.unionByName(level)
    return found.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def label_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``label, n`` of the named node tables."""
    out = None
    for label, nodes in sorted(tables.items()):
        one = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_keys(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; empty where the key is unique."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contents(sections: DataFrame, bucket: int = 512) -> DataFrame:
    """Sections of the top two levels in reading order: ``doc, line_no, title, depth, start_page`` (null pages count as 0)."""
    top = sections.where("depth <= 2").select("doc", "title", "depth", F.coalesce("start_page", F.lit(0)).alias("start_page"), "id")
    return row_numbers(top, ["doc"], F.floor(F.col("start_page") / bucket), ["start_page", "depth", "id"], "line_no").select("doc", "line_no", "title", "depth", "start_page")


def breadcrumbs(chunks: DataFrame) -> DataFrame:
    """``chunk_id, trail``: the work's title and the titles on the chunk's path, joined by `` > ``."""
    trail = F.concat_ws(" > ", F.coalesce("doc_title", "doc"), F.array_join("path", " > "))
    return chunks.select("chunk_id", trail.alias("trail"))


def below(sections: DataFrame, chunks: DataFrame, prefix: str) -> DataFrame:
    """Chunks anywhere below sections whose title begins with ``prefix`` (case ignored): ``doc, section, chunk_id``."""
    roots = sections.where(F.startswith(F.lower("title"), F.lit(prefix.lower()))).select(F.col("id").alias("root"))
    long = chunks.where(F.size("path") > 0).select("doc", "chunk_id", "path_ids", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("d"))
    long = long.select("doc", "chunk_id", section_id(F.col("doc"), F.col("path_ids"), F.col("d")).alias("root"))
    return long.join(roots, "root").select("doc", F.col("root").alias("section"), "chunk_id").distinct()


def authors_of_keyword(chunks: DataFrame, word: str) -> DataFrame:
    """``author, n``: chunks that contain a word, by author, most first."""
    return chunks.where(F.contains(F.lower("text"), F.lit(word.lower()))).groupBy("author").agg(F.count(F.lit(1)).alias("n"))

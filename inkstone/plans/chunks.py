"""Queries over chunks, their sentences and the graph of works, sections and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import SPACE, word_count
from inkstone.functions.vector import dot, unit, usable
from inkstone.operators import chunking as C
from inkstone.operators import graph as G
from inkstone.operators import nested
from inkstone.operators import tree as T
from inkstone.operators.lines import page_lines, page_offsets
from inkstone.plans.base import chunks, chunks_sql, one_line_sql, pages, unique
from inkstone.plans.steps import chunk_works
from inkstone.providers import HashingEmbedder
from inkstone.session import cut
from inkstone.session import read_table as table
from inkstone.sources.readers import load_chunks, not_cached

MODEL = "lumen-embed-1"


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentences(chunks(spark, sf, "text"), ["chunk_id"]).select("chunk_id", "sent_no", "sentence", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = C.sentences(chunks(spark, sf, "text"), ["chunk_id"])
    return s.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(word_count(F.col("sentence"))).alias("n_words"))


def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentence_windows(C.sentences(chunks(spark, sf, "text"), ["chunk_id"]), ["chunk_id"]).select("chunk_id", "sent_no", "window")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_id, doc, author, unit``: one usable vector of one model a chunk."""
    v = table(spark, sf, "vectors").where((F.col("model") == MODEL) & F.col("chunk_id").isNotNull() & usable(F.col("embedding"), 128))
    one = v.groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return one.join(chunks(spark, sf, "doc", "author"), "chunk_id").where("doc IS NOT NULL").select("chunk_id", "doc", "author", unit(F.col("embedding")).alias("unit"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between neighbouring chunks of a work in reading order."""
    v = cut(_vectors(spark, sf))
    placed = v.select("doc", "chunk_id").join(chunks(spark, sf, "start_page"), "chunk_id").withColumn("start_page", F.coalesce("start_page", F.lit(0)))
    follow = G.next_edges(placed, "start_page")
    first = v.select(F.col("chunk_id").alias("a"), "doc", F.col("unit").alias("ua"))
    second = v.select(F.col("chunk_id").alias("b"), F.col("unit").alias("ub"))
    return follow.join(first, "a").join(second, "b").select("doc", F.col("a").alias("chunk_id"), (1 - dot(F.col("ua"), F.col("ub"))).alias("dist"))


def consecutive_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("doc", "chunk_id", F.round("dist", 6).alias("dist"))


def distance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    limit = C.threshold(_steps(spark, sf))
    return spark.createDataFrame([(limit,)], "threshold double").select(F.round("threshold", 6).alias("threshold"))


def _sentence_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all chunks with their words and the change of topic to the next one."""
    s = C.sentence_windows(C.sentences(chunks(spark, sf, "text"), ["chunk_id"]), ["chunk_id"])
    s = s.withColumn("words", word_count(F.col("sentence")))
    made = C.embed_with(s, ["chunk_id", "sent_no", "words"], "window", HashingEmbedder())
    made = cut(made.withColumn("unit", F.col("embedding").cast("array<double>")))
    d = C.step_distances(made.where("unit IS NOT NULL"), ["chunk_id"], "sent_no", "unit")
    return made.select("chunk_id", "sent_no", "words").join(d, ["chunk_id", "sent_no"], "left")


def semantic_cut(spark: SparkSession, sf: str) -> DataFrame:
    s = cut(_sentence_distances(spark, sf))
    limit = C.threshold(s)
    return C.semantic_chunks(s, float("inf") if limit is None else limit, ["chunk_id"])


def glue_small(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc", "path", "parts", "text").where("doc IS NOT NULL")
    ready = c.select("doc", F.col("chunk_id").alias("ord"), "chunk_id", F.coalesce(F.get("path", F.lit(0)), F.lit("")).alias("chapter"), F.coalesce("parts", F.lit(1)).alias("parts"), word_count(F.col("text")).alias("words"))
    return C.glue_small(ready)


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc", "author", "start_page").where("doc IS NOT NULL")
    return C.chunk_ids(c).select("chunk_id", "ordinal", "new_id")


def chunk_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc", "section_id").where("doc IS NOT NULL")
    return C.part_numbers(c, ["doc", "section_id"], "chunk_id").select("chunk_id", "part_no", "part_count")


def chunk_size_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.size_report(chunks(spark, sf, "doc", "text"), ["doc"])


def find_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every tree, anchored in the text of its work's pages."""
    trees = unique(table(spark, sf, "trees"), ["tree_id"], ["doc", "raw"]).where("doc IS NOT NULL AND raw IS NOT NULL")
    nodes = nested.section_columns(nested.flatten_tree(trees, "tree_id", "raw")).join(trees.select("tree_id", "doc"), "tree_id")
    p = cut(pages(spark, sf, "text").where("doc IS NOT NULL"))
    starts = cut(page_offsets(p))
    n = cut(nodes.select("tree_id", "doc", "node_path", "title", T.sort_key(F.col("node_path")).alias("ord"), F.coalesce("start_index", F.lit(1)).alias("first_page"), F.coalesce("end_index", "start_index", F.lit(1)).alias("last_page")))
    spans = C.section_spans(n, p.join(starts.select("doc", "page", "start_off"), ["doc", "page"]), "tree_id")
    return spans.join(trees.select("tree_id", "doc"), "tree_id").select("tree_id", "doc", "node_path", "start", "end")


def _chunked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The chunking step over pages, the trees and the corpus: of each work the tree with the least id that can be read."""
    trees = table(spark, sf, "trees").where("doc IS NOT NULL")
    owner = trees.groupBy("tree_id").agg(F.min("doc").alias("doc"))
    nodes = nested.section_columns(nested.flatten_tree(trees, "tree_id", "raw")).join(owner, "tree_id")
    nodes = cut(nodes)
    first = nodes.groupBy("doc").agg(F.min("tree_id").alias("tree_id"))
    works = cut(table(spark, sf, "corpus").where("doc IS NOT NULL"))
    made, report, _ = chunk_works(nodes.join(first, ["doc", "tree_id"]).drop("tree_id"), page_lines(pages(spark, sf, "text")), works, HashingEmbedder())
    return made, report


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf)[0]


def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf)[1]


SECTION_COLUMNS = ("doc", "author", "path", "path_ids", "start_page", "end_page", "section_summary")


def _sections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, sf, *SECTION_COLUMNS, "doc_title").where("doc IS NOT NULL")
    return G.section_rows(c), c


def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf)[0]


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges(*_sections(spark, sf))


def section_parents(spark: SparkSession, sf: str) -> DataFrame:
    s, _ = _sections(spark, sf)
    parent = s.select(F.col("id").alias("parent"), F.col("title").alias("parent_title"))
    return s.join(parent, "parent", "left").select("id", "title", F.coalesce("parent_title", "doc").alias("under"))


def graph_next_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _next(spark, sf)


def _next(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "doc", "start_page").where("doc IS NOT NULL")
    return G.next_edges(c.withColumn("start_page", F.coalesce("start_page", F.lit(0))), "start_page")


def next_three_hops(spark: SparkSession, sf: str) -> DataFrame:
    return G.hops(cut(_next(spark, sf)), 3)


def graph_breadcrumb(spark: SparkSession, sf: str) -> DataFrame:
    return G.breadcrumbs(_sections(spark, sf)[1])


def graph_toc(spark: SparkSession, sf: str) -> DataFrame:
    return G.contents(_sections(spark, sf)[0])


def graph_tree_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return G.below(*_sections(spark, sf), "Chapter 1")


def graph_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    s, c = _sections(spark, sf)
    return G.label_counts({"Document": c.select("doc").distinct(), "Section": s, "Chunk": c})


def key_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return G.duplicate_keys(table(spark, sf, "chunks"), ["chunk_id"])


def keyword_author_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.authors_of_keyword(chunks(spark, sf, "author", "text"), "conscience")


def corpus_join(spark: SparkSession, sf: str) -> DataFrame:
    joined, _ = load_chunks(chunks(spark, sf, "doc", "author", "doc_title"), table(spark, sf, "corpus"))
    return joined.groupBy("author", "doc_title").agg(F.count(F.lit(1)).alias("n"))


def works_without_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return load_chunks(chunks(spark, sf, "doc", "author", "doc_title").where("doc IS NOT NULL"), table(spark, sf, "corpus"))[1]


def cache_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose vector of the model is still to be made."""
    done = table(spark, sf, "vectors").where((F.col("model") == MODEL) & F.col("embedding").isNotNull())
    return not_cached(chunks(spark, sf).select("chunk_id"), done, ["chunk_id"])


ALL = (sentence_split, sentence_counts, sentence_windows, consecutive_distance, distance_threshold, semantic_cut, glue_small, chunk_ids, chunk_parts, chunk_size_report, find_titles, chunk_rows, chunk_report, section_rows, graph_edges, section_parents, graph_next_edges, next_three_hops, graph_breadcrumb, graph_toc, graph_tree_chunks, graph_label_counts, key_uniqueness, keyword_author_counts, corpus_join, works_without_chunks, cache_resume)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


#: Sentences with their places; breaks are marked on both sides, as in ``functions.text.sentences``. A mark's closing signs are left out.
SENTENCES = (
    "WITH "
    + chunks_sql("text")
    + rf""", raw AS (SELECT chunk_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '([.!?;:])(["''”’)]*{SPACE}+)(["''“‘(]?[A-Z0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS parts FROM c),
p AS (SELECT chunk_id, (unnest(range(len(parts)::BIGINT)))::INT AS n, unnest(parts) AS part FROM raw),
g AS (SELECT chunk_id, n, CASE WHEN contains(part, chr(2)) THEN strpos(part, chr(2)) - 1 ELSE 0 END AS gap, regexp_replace(part, '^[^' || chr(2) || ']*' || chr(2), '') AS body FROM p),
o AS (SELECT *, (coalesce(sum(gap + length(body)) OVER (PARTITION BY chunk_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap)::INT AS start FROM g),
cl AS (SELECT chunk_id, n, {one_line_sql("body")} AS sentence, start, (start + length(body))::INT AS "end" FROM o),
s AS (SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY n) - 1)::INT AS sent_no, sentence, start, "end" FROM cl WHERE sentence <> '')
"""
)
VECTORS = (
    "WITH "
    + chunks_sql("doc", "author", "start_page")
    + """, v AS (SELECT chunk_id, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM vectors WHERE model = 'lumen-embed-1' AND chunk_id IS NOT NULL AND len(embedding) = 128
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
u AS (SELECT chunk_id, doc, author, start_page, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS unit FROM v JOIN c USING (chunk_id) WHERE doc IS NOT NULL),
d AS (SELECT doc, chunk_id, 1 - list_dot_product(unit, lead(unit) OVER (PARTITION BY doc ORDER BY coalesce(start_page, 0), chunk_id)) AS dist FROM u)
"""
)
SECTIONS = (
    "WITH "
    + chunks_sql(*SECTION_COLUMNS, "doc_title")
    + """, k AS (SELECT * FROM c WHERE doc IS NOT NULL),
long AS (SELECT *, unnest(range(1, len(path)::BIGINT + 1)) AS depth FROM k WHERE len(path) > 0),
keyed AS (SELECT *, doc || '::' || array_to_string(path_ids[1:depth], '/') AS id, CASE WHEN depth > 1 THEN doc || '::' || array_to_string(path_ids[1:depth - 1], '/') END AS par,
    depth = len(path) AND coalesce(trim(section_summary), '') <> '' AS own FROM long),
sec AS (SELECT id, doc, min(author) AS author, min(path[depth]) AS title, depth::INT AS depth, min(par) AS parent, min(start_page) AS start_page, max(end_page) AS end_page,
    arg_min(section_summary, chunk_id) FILTER (own) AS summary FROM keyed GROUP BY id, doc, depth)
"""
)
NEXT = "WITH " + chunks_sql("doc", "start_page") + """, e AS (SELECT chunk_id AS a, lead(chunk_id) OVER (PARTITION BY doc ORDER BY coalesce(start_page, 0), chunk_id) AS b FROM c WHERE doc IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "sentence_split": SENTENCES + "SELECT * FROM s",
        "sentence_counts": SENTENCES + r"SELECT chunk_id, count(*) AS sentences, sum(len(regexp_extract_all(sentence, '[^\s]+')))::BIGINT AS n_words FROM s GROUP BY chunk_id",
        "sentence_windows": SENTENCES + "SELECT chunk_id, sent_no, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS window FROM s WINDOW w AS (PARTITION BY chunk_id ORDER BY sent_no)",
        "consecutive_distance": VECTORS + "SELECT doc, chunk_id, round(dist, 6) AS dist FROM d WHERE dist IS NOT NULL",
        "distance_threshold": VECTORS + "SELECT round(quantile_cont(dist, 0.95), 6) AS threshold FROM d WHERE dist IS NOT NULL",
        "chunk_ids": "WITH " + chunks_sql("doc", "author", "start_page") + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY coalesce(start_page, 0), chunk_id) - 1 AS o FROM c WHERE doc IS NOT NULL) SELECT chunk_id, o::INT AS ordinal, concat_ws('-', lower(author), lpad(o::VARCHAR, greatest(4, length(o::VARCHAR))::INT, '0')) AS new_id FROM n",
        "chunk_parts": "WITH " + chunks_sql("doc", "section_id") + " SELECT chunk_id, (row_number() OVER (PARTITION BY doc, section_id ORDER BY chunk_id))::INT AS part_no, count(*) OVER (PARTITION BY doc, section_id) AS part_count FROM c WHERE doc IS NOT NULL",
        "chunk_size_report": "WITH " + chunks_sql("doc", "text") + r", w AS (SELECT doc, len(regexp_extract_all(coalesce(text, ''), '[^\s]+'))::INT AS w FROM c) SELECT doc, count(*) AS chunks, min(w) AS min_words, trunc(median(w))::INT AS median_words, max(w) AS max_words FROM w GROUP BY doc",
        "section_rows": SECTIONS + "SELECT * FROM sec",
        "graph_edges": SECTIONS + "SELECT 'HAS_SECTION' AS kind, coalesce(parent, doc) AS src, id AS dst FROM sec UNION ALL SELECT DISTINCT 'HAS_CHUNK', doc || '::' || array_to_string(path_ids[1:len(path)], '/'), chunk_id FROM k WHERE len(path) > 0",
        "section_parents": SECTIONS + "SELECT s.id, s.title, coalesce(p.title, s.doc) AS under FROM sec s LEFT JOIN sec p ON p.id = s.parent",
        "graph_next_edges": NEXT + "SELECT a, b FROM e WHERE b IS NOT NULL",
        "next_three_hops": NEXT + ", x AS (SELECT a, b FROM e WHERE b IS NOT NULL) SELECT a, b, 1 AS hops FROM x UNION ALL SELECT x.a, y.b, 2 FROM x JOIN x y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM x JOIN x y ON x.b = y.a JOIN x z ON y.b = z.a",
        "graph_breadcrumb": SECTIONS + "SELECT chunk_id, concat_ws(' > ', coalesce(doc_title, doc), array_to_string(path, ' > ')) AS trail FROM k",
        "graph_toc": SECTIONS + "SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY coalesce(start_page, 0), depth, id))::INT AS line_no, title, depth, coalesce(start_page, 0) AS start_page FROM sec WHERE depth <= 2",
        "graph_tree_chunks": SECTIONS + "SELECT DISTINCT keyed.doc, keyed.id AS section, chunk_id FROM keyed JOIN sec ON sec.id = keyed.id WHERE starts_with(lower(sec.title), 'chapter 1')",
        "graph_label_counts": SECTIONS + "SELECT 'Document' AS label, count(DISTINCT doc) AS n FROM k UNION ALL SELECT 'Section', count(*) FROM sec UNION ALL SELECT 'Chunk', count(*) FROM k",
        "key_uniqueness": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
        "keyword_author_counts": "WITH " + chunks_sql("author", "text") + " SELECT author, count(*) AS n FROM c WHERE contains(lower(text), 'conscience') GROUP BY author",
        "corpus_join": "WITH " + chunks_sql("doc", "author", "doc_title") + " SELECT coalesce(c.author, w.author) AS author, coalesce(doc_title, w.title) AS doc_title, count(*) AS n FROM c LEFT JOIN corpus w USING (doc) GROUP BY ALL",
        "works_without_chunks": "SELECT doc FROM corpus WHERE doc NOT IN (SELECT doc FROM chunks WHERE doc IS NOT NULL)",
        "cache_resume": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE model = 'lumen-embed-1' AND embedding IS NOT NULL AND chunk_id IS NOT NULL)",
    }

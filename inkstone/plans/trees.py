"""Queries over section trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.salvage import clean_summary, model_json
from inkstone.functions.text import word_count
from inkstone.operators import nested
from inkstone.operators import tree as T
from inkstone.plans.base import pages, pages_sql
from inkstone.plans.records import WALK
from inkstone.session import cut
from inkstone.session import read_table as table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All sections with their scalar fields; computed once a query."""
    return cut(nested.section_columns(nested.flatten_tree(table(spark, sf, "trees"), "tree_id", "raw")))


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All sections with their scalar fields, and how each tree was built; records are taken apart once."""
    rows = cut(nested.flatten_records(table(spark, sf, "trees"), "tree_id", "raw").where("table IN ('', 'sections')"))
    sections = rows.where("table = 'sections'").select("tree_id", F.col("row_id").alias("node_path"), F.col("parent_id").alias("parent_path"), "ordinal", "depth", "value")
    return nested.section_columns(sections), T.tree_meta(rows, "tree_id")


def _works(spark: SparkSession, sf: str) -> DataFrame:
    trees = table(spark, sf, "trees").where("tree_id IS NOT NULL").groupBy("tree_id").agg(F.min("doc").alias("doc"))
    return trees.join(table(spark, sf, "corpus"), "doc")


def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_title_path(_nodes(spark, sf), "tree_id").select("tree_id", "node_path", "depth", "title_path")


def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return T.leaves(_nodes(spark, sf), "tree_id").select("tree_id", "node_path")


def tree_outline(spark: SparkSession, sf: str) -> DataFrame:
    return T.outline(_nodes(spark, sf), "tree_id")


def tree_describe(spark: SparkSession, sf: str) -> DataFrame:
    nodes, meta = _records(spark, sf)
    return T.describe(nodes, "tree_id", meta)


def drop_sections(spark: SparkSession, sf: str) -> DataFrame:
    excluded = _works(spark, sf).select("tree_id", F.array_union(F.coalesce("exclude", F.array().cast("array<string>")), F.array(F.lit("preface"))).alias("exclude"))
    return T.drop_sections(_nodes(spark, sf), "tree_id", excluded).select("tree_id", "node_path")


def keep_pages(spark: SparkSession, sf: str) -> DataFrame:
    bounds = _works(spark, sf).select("tree_id", (F.col("first_page") + 2).alias("first_page"), (F.col("last_page") - 10).alias("last_page"))
    return T.keep_pages(_nodes(spark, sf), "tree_id", bounds).select("tree_id", "node_path", "start_index", "end_index")


def collapse_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return T.collapse_single_children(_nodes(spark, sf), "tree_id").select("tree_id", "node_path", "parent")


def accept_flash(spark: SparkSession, sf: str) -> DataFrame:
    nodes, meta = _records(spark, sf)
    trees = table(spark, sf, "trees").where("tree_id IS NOT NULL AND raw IS NOT NULL").select("tree_id").distinct()
    counts = T.leaves(nodes, "tree_id").groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"))
    return T.accept_flash(trees.join(meta.select("tree_id", F.nullif("source", F.lit("llm")).alias("toc_source")), "tree_id", "left"), counts, "tree_id")


def llm_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Trees as a model's raw answers: whether a JSON object with a structure can be found in them, and its source."""
    trees = table(spark, sf, "trees").where("tree_id IS NOT NULL AND raw IS NOT NULL").groupBy("tree_id").agg(F.min("raw").alias("raw"))
    parsed = model_json(F.col("raw"), "structure")
    return trees.select("tree_id", parsed.isNotNull().alias("usable"), F.try_variant_get(parsed, "$.doc_name", "string").alias("doc_name"))


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of sections in the shapes models return them."""
    s = _nodes(spark, sf).where("summary IS NOT NULL").select("tree_id", "node_path", "ordinal", "summary")
    wrapped = F.to_json(F.struct("summary"))
    points = F.to_json(F.struct(F.array(F.col("summary"), F.lit("A second point that says more")).alias("points")))
    k = F.pmod(F.col("tree_id") + F.col("ordinal"), F.lit(6))
    raw = F.when(k == 0, F.col("summary")).when(k == 1, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(k == 2, points).when(k == 3, F.concat(F.substring(wrapped, 1, 60), F.lit("..."))).when(k == 4, F.concat(F.lit("Please provide the text. "), F.col("summary"))).otherwise(F.concat(wrapped, F.lit(",")))
    return s.select("tree_id", "node_path", raw.alias("raw"))


def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf).select("tree_id", "node_path", clean_summary(F.col("raw")).alias("summary"))


def summary_redo(spark: SparkSession, sf: str) -> DataFrame:
    """Sections without a usable summary whose pages have text enough: how much of it a new summary would be made from."""
    works = table(spark, sf, "trees").where("tree_id IS NOT NULL AND doc IS NOT NULL").groupBy("tree_id").agg(F.min("doc").alias("doc"))
    p = pages(spark, sf, "text")
    ends = p.groupBy("doc").agg(F.min("page").alias("least"), F.max("page").alias("most"))
    s = _nodes(spark, sf).where(clean_summary(F.col("summary")).isNull()).where("start_index IS NOT NULL AND end_index >= start_index").join(works, "tree_id").join(ends, "doc")
    # pages a work does not have add line ends only: behind its last page they change nothing, before its first they fill the text at most
    s = s.withColumn("start_index", F.greatest("start_index", F.col("least") - T.REDO_CLIP)).withColumn("end_index", F.least("end_index", "most")).where("end_index >= start_index")
    words = T.page_texts(s, p).select("doc", "first_page", "last_page", word_count(F.col("text")).alias("words")).where(F.col("words") >= 30)
    joined = s.select("tree_id", "node_path", "doc", F.col("start_index").alias("first_page"), F.col("end_index").alias("last_page")).join(words, ["doc", "first_page", "last_page"])
    return joined.select("tree_id", "node_path", "words")


def summary_repair_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = _shaped(spark, sf).withColumn("clean", clean_summary(F.col("raw")))
    status = F.when(F.col("clean").isNull(), "redo").when(F.col("clean") == F.trim("raw"), "ok").otherwise("cleaned")
    return s.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


ALL = (tree_walk, tree_leaves, tree_outline, tree_describe, drop_sections, keep_pages, collapse_dupes, accept_flash, llm_json_parse, json_salvage, summary_redo, summary_repair_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


NODES = (
    WALK.rstrip()
    + """,
n AS (SELECT tree_id, node_path, parent_path, len(string_split(node_path, '/')) - 1 AS depth, trim(v->>'$.title') AS title,
    try_cast(trunc(try_cast(trim(v->>'$.start_index') AS DOUBLE)) AS INT) AS start_index, try_cast(trunc(try_cast(trim(v->>'$.end_index') AS DOUBLE)) AS INT) AS end_index,
    v->>'$.summary' AS summary, list_transform(string_split(node_path, '/'), lambda x: x::INT) AS ord FROM walk),
works AS (SELECT tree_id, corpus.* FROM (SELECT tree_id, min(doc) AS doc FROM trees WHERE tree_id IS NOT NULL GROUP BY tree_id) JOIN corpus USING (doc)),
leaf AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.tree_id = n.tree_id AND m.parent_path = n.node_path))
"""
)


def clean_sql(source: str, columns: str) -> str:
    """CTEs that end in ``cleaned`` (``columns, raw, clean``): ``functions.salvage.clean_summary`` over ``raw`` of ``source``."""
    bare = r"regexp_replace(regexp_replace(raw, '(?m)^[ \t]*```[a-zA-Z]*[ \t]*$|^\s*```[a-zA-Z]*\s|```', '', 'g'), '^\s+|\s+$', '', 'g')"
    inside = r'(?:[^"\\]|\\.)*'
    unescaped = r"""regexp_replace(replace(replace({}, '\n', ' '), '\"', '"'), '\\$', '')"""
    listed = "array_to_string(list_transform({}, lambda p: rtrim(p, '.') || '.'), ' ')"
    return f"""bare_s AS (SELECT {columns}, raw, {bare} AS t FROM {source}),
        told AS (SELECT *, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t, '$.summary') = 'VARCHAR' THEN t->>'$.summary' WHEN json_type(t, '$.points') = 'ARRAY' THEN {listed.format("from_json(t->'$.points', '[\"VARCHAR\"]')")} WHEN json_type(t) = 'ARRAY' THEN {listed.format("from_json(t::JSON, '[\"VARCHAR\"]')")} END END AS parsed,
            regexp_extract(t, '(?s)"summary"\\s*:\\s*"({inside})', 1) AS begun, list_filter(list_transform(regexp_extract_all(t, '(?s)"({inside})"', 1), lambda x: {unescaped.format("x")}), lambda x: length(x) >= 30) AS strings FROM bare_s),
        plain_s AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(t, '^[\\[{{]') THEN coalesce(parsed, CASE WHEN begun <> '' THEN {unescaped.format("begun")} ELSE {listed.format("strings")} END) ELSE t END, '^\\s+|\\s+$', '', 'g') AS plain FROM told),
        cleaned AS (SELECT {columns}, raw, CASE WHEN length(plain) >= 40 AND NOT regexp_matches(plain, '(?i)^(please provide|i need the)') THEN plain END AS clean FROM plain_s)"""


#: Summaries in the shapes models return them, as ``_shaped`` makes them.
SHAPED = (
    NODES.rstrip()
    + r""",
given AS (SELECT tree_id, node_path, ((tree_id + string_split(node_path, '/')[-1]::INT) % 6) AS k, summary, json_object('summary', summary)::VARCHAR AS w FROM n WHERE summary IS NOT NULL),
shaped AS (SELECT tree_id, node_path, CASE k WHEN 0 THEN summary WHEN 1 THEN '```json' || chr(10) || w || chr(10) || '```' WHEN 2 THEN json_object('points', [summary, 'A second point that says more'])::VARCHAR
    WHEN 3 THEN substring(w, 1, 60) || '...' WHEN 4 THEN 'Please provide the text. ' || summary ELSE w || ',' END AS raw FROM given),
"""
    + clean_sql("shaped", "tree_id, node_path")
)
GONE = "NOT EXISTS (SELECT 1 FROM bad b WHERE b.tree_id = n.tree_id AND (n.node_path = b.node_path OR starts_with(n.node_path, b.node_path || '/')))"


def oracle_sql() -> dict[str, str]:
    return {
        "tree_walk": NODES + """SELECT n.tree_id, n.node_path, n.depth::INT AS depth, string_agg(coalesce(a.title, ''), ' > ' ORDER BY a.depth) AS title_path
            FROM n JOIN n a ON a.tree_id = n.tree_id AND (a.node_path = n.node_path OR starts_with(n.node_path, a.node_path || '/')) GROUP BY n.tree_id, n.node_path, n.depth""",
        "tree_leaves": NODES + "SELECT tree_id, node_path FROM leaf",
        "tree_outline": NODES + """SELECT * FROM (SELECT tree_id, (row_number() OVER (PARTITION BY tree_id ORDER BY ord))::INT AS line_no,
            repeat('  ', depth) || coalesce(title, '') || ' (p. ' || coalesce(start_index::VARCHAR, '?') || ')' AS line, count(*) OVER (PARTITION BY tree_id) AS of_lines FROM n WHERE depth < 2) WHERE line_no <= 25""",
        "tree_describe": NODES + """, b AS (SELECT tree_id, count(*) AS leaves, min(end_index - start_index + 1) AS min_pages, median(end_index - start_index + 1) AS median_pages, max(end_index - start_index + 1) AS max_pages FROM leaf GROUP BY tree_id),
            d AS (SELECT tree_id, count(*) AS nodes, max(depth) + 1 AS depth, count_if(coalesce(trim(summary), '') <> '') AS summaries, any_value(leaves) AS leaves, any_value(min_pages) AS min_pages, any_value(median_pages) AS median_pages, any_value(max_pages) AS max_pages FROM n LEFT JOIN b USING (tree_id) GROUP BY tree_id)
            SELECT o.tree_id, coalesce(j->>'$._meta.mode', j->>'$.result._meta.mode') AS mode, coalesce(j->>'$.toc_source', j->>'$.result.toc_source', 'llm') AS source, try_cast(coalesce(j->>'$._meta.seconds', j->>'$.result._meta.seconds') AS DOUBLE) AS seconds,
                coalesce(nodes, 0)::BIGINT AS nodes, coalesce(leaves, 0)::BIGINT AS leaves, coalesce(d.depth, 0)::INT AS depth, coalesce(summaries, 0)::BIGINT AS summaries,
                CASE WHEN nodes IS NULL THEN 0 ELSE min_pages END::INT AS min_pages, CASE WHEN nodes IS NULL THEN 0 ELSE median_pages END::DOUBLE AS median_pages, CASE WHEN nodes IS NULL THEN 0 ELSE max_pages END::INT AS max_pages
            FROM opened o LEFT JOIN d USING (tree_id) WHERE j IS NOT NULL""",
        "drop_sections": NODES + f""", bad AS (SELECT n.tree_id, node_path FROM n JOIN works USING (tree_id)
            WHERE len(list_filter(list_append(coalesce(exclude, []), 'preface'), lambda e: trim(e) <> '' AND starts_with(lower(trim(n.title)), lower(trim(e))))) > 0)
            SELECT tree_id, node_path FROM n WHERE {GONE}""",
        "keep_pages": NODES + f""", known AS (SELECT n.*, w.f, w.l FROM n LEFT JOIN (SELECT tree_id, first_page + 2 AS f, last_page - 10 AS l FROM works) w USING (tree_id)),
            bad AS (SELECT tree_id, node_path FROM known WHERE coalesce(coalesce(end_index, l) < f, false) OR coalesce(coalesce(start_index, f) > l, false))
            SELECT tree_id, node_path, greatest(start_index, f)::INT AS start_index, least(end_index, l)::INT AS end_index FROM known n WHERE {GONE}""",
        "collapse_dupes": NODES + """, alone AS (SELECT tree_id, parent_path FROM n GROUP BY ALL HAVING count(*) = 1),
            kept AS (SELECT tree_id, node_path FROM n WHERE NOT EXISTS (SELECT 1 FROM alone a JOIN n m ON m.tree_id = a.tree_id AND m.node_path = a.parent_path
                WHERE a.tree_id = n.tree_id AND a.parent_path = n.parent_path AND m.start_index IS NOT DISTINCT FROM n.start_index AND m.end_index IS NOT DISTINCT FROM n.end_index))
            SELECT a.tree_id, a.node_path, coalesce(arg_max(b.node_path, length(b.node_path)), '') AS parent FROM kept a LEFT JOIN kept b ON b.tree_id = a.tree_id AND starts_with(a.node_path, b.node_path || '/') GROUP BY ALL""",
        "summary_redo": NODES + ", " + pages_sql("text") + ", told_of AS (SELECT tree_id, node_path, start_index AS f, end_index AS l, summary AS raw FROM n WHERE start_index IS NOT NULL AND end_index >= start_index), " + clean_sql("told_of", "tree_id, node_path, f, l")
        + r""", poor AS (SELECT c.*, t.doc FROM cleaned c JOIN (SELECT tree_id, min(doc) AS doc FROM trees WHERE tree_id IS NOT NULL AND doc IS NOT NULL GROUP BY tree_id) t USING (tree_id) WHERE clean IS NULL),
            ends AS (SELECT doc, min(page) AS least, max(page) AS most FROM p GROUP BY doc),
            s AS (SELECT tree_id, node_path, doc, greatest(f, least - 12000) AS f, least(l, most) AS l FROM poor JOIN ends USING (doc) WHERE least(l, most) >= greatest(f, least - 12000)),
            e AS (SELECT doc, f, l, unnest(range(f, l + 1)) AS page FROM (SELECT DISTINCT doc, f, l FROM s)), x AS (SELECT e.doc, f, l, substring(string_agg(coalesce(text, ''), chr(10) ORDER BY e.page), 1, 12000) AS text FROM e LEFT JOIN p ON p.doc = e.doc AND p.page = e.page GROUP BY ALL),
            w AS (SELECT doc, f, l, len(regexp_extract_all(text, '[^\s]+'))::INT AS words FROM x) SELECT tree_id, node_path, words FROM s JOIN w USING (doc, f, l) WHERE words >= 30""",
        "json_salvage": SHAPED + " SELECT tree_id, node_path, clean AS summary FROM cleaned",
        "summary_repair_counts": SHAPED + " SELECT CASE WHEN clean IS NULL THEN 'redo' WHEN clean = trim(raw) THEN 'ok' ELSE 'cleaned' END AS status, count(*) AS n FROM cleaned GROUP BY 1",
        "llm_json_parse": """WITH r AS (SELECT tree_id, min(raw) AS raw FROM trees WHERE tree_id IS NOT NULL AND raw IS NOT NULL GROUP BY tree_id),
            t AS (SELECT tree_id, regexp_extract(raw, '(?s)\\{.*\\}') AS t FROM r), j AS (SELECT tree_id, CASE WHEN json_valid(t) AND json_exists(t, '$.structure') THEN t::JSON END AS j FROM t)
            SELECT tree_id, j IS NOT NULL AS usable, j->>'$.doc_name' AS doc_name FROM j""",
        "accept_flash": NODES + """, meta AS (SELECT tree_id, coalesce(j->>'$.toc_source', j->>'$.result.toc_source') AS toc_source FROM opened), ln AS (SELECT tree_id, count(*) AS leaves FROM leaf GROUP BY tree_id)
            SELECT tree_id, coalesce(toc_source NOT IN ('pages', 'unreadable'), false) AND coalesce(leaves, 0) >= 3 AS accepted FROM meta LEFT JOIN ln USING (tree_id)""",
    }

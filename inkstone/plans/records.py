"""Queries of problem 2: nested records to related flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import nested
from inkstone.session import cut
from inkstone.session import read_table as table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_tree(table(spark, sf, "trees"), "tree_id", "raw").select("tree_id", "node_path", "parent_path")


def p2_sections(spark: SparkSession, sf: str) -> DataFrame:
    return nested.section_columns(nested.flatten_tree(table(spark, sf, "trees"), "tree_id", "raw"))


def _schema(spark: SparkSession, sf: str) -> DataFrame:
    return nested.infer_schema(nested.record_texts(table(spark, sf, "trees"), "tree_id", "raw"))


def p2_schema(spark: SparkSession, sf: str) -> DataFrame:
    return _schema(spark, sf)


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of every child table with the link to its parent: all array levels of the merged schema."""
    rows = nested.flatten_records(table(spark, sf, "trees"), "tree_id", "raw").where("table <> ''")
    return rows.select("tree_id", "table", "row_id", "parent_table", "parent_id", "ordinal", "depth")


def _child(spark: SparkSession, sf: str, name: str, wanted: dict[str, str]) -> DataFrame:
    schema = cut(_schema(spark, sf))
    rows = nested.flatten_records(table(spark, sf, "trees"), "tree_id", "raw", nested.nested_keys(schema))
    return nested.child_table(rows, "tree_id", name, schema, wanted)


def p2_figures(spark: SparkSession, sf: str) -> DataFrame:
    f = _child(spark, sf, "figures", {"title": "string", "label_text": "string", "start_index": "string"})
    number = nested.whole_number(F.col("start_index").cast("string"))
    return f.select("tree_id", F.col("parent_id").alias("parent_path"), "ordinal", "title", F.col("label_text").alias("label"), number.alias("start_index"))


def p2_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    f = _child(spark, sf, "footnotes", {"mark": "string", "page": "string"})
    number = nested.whole_number(F.col("page").cast("string"))
    return f.select("tree_id", F.col("parent_id").alias("parent_path"), "ordinal", "mark", number.alias("page"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_sections, p2_figures, p2_footnotes, p2_schema, p2_tables)}


#: The unwrapping of a record and the walk over its sections, as DuckDB sees them.
WALK = r"""WITH RECURSIVE bare AS (
    SELECT tree_id, regexp_replace(regexp_replace(min(raw), '^[\x{FEFF}\s]*(```[a-z]*\s*)?', ''), '\s*(```)?\s*$', '') AS t
    FROM trees WHERE raw IS NOT NULL AND tree_id IS NOT NULL GROUP BY tree_id),
once AS (SELECT tree_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM bare),
opened AS (SELECT tree_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM once),
inner1 AS (SELECT tree_id, coalesce(j->'$.result', j) AS j FROM opened),
tops AS (SELECT tree_id, coalesce(j->'$.structure', j) AS j FROM inner1),
walk AS (
    SELECT tree_id, '' AS parent_path, (row_number() OVER (PARTITION BY tree_id ORDER BY pos) - 1)::VARCHAR AS node_path, v
    FROM (SELECT tree_id, unnest(range(json_array_length(j)::BIGINT)) AS pos, unnest(json_extract(j, '$[*]')) AS v FROM tops WHERE json_type(j) = 'ARRAY')
    WHERE json_type(v) = 'OBJECT'
    UNION ALL
    SELECT tree_id, parent_path, parent_path || '/' || (row_number() OVER (PARTITION BY tree_id, parent_path ORDER BY pos) - 1), v
    FROM (SELECT tree_id, node_path AS parent_path, unnest(range(json_array_length(kids)::BIGINT)) AS pos, unnest(json_extract(kids, '$[*]')) AS v
          FROM (SELECT tree_id, node_path, CASE json_type(k) WHEN 'ARRAY' THEN k WHEN 'OBJECT' THEN json_array(k) END AS kids
                FROM (SELECT tree_id, node_path, coalesce(nullif(v->'$.nodes', 'null'), nullif(v->'$.Nodes', 'null'), nullif(v->'$.children', 'null')) AS k FROM walk)))
    WHERE json_type(v) = 'OBJECT')
"""
_WHOLE = "try_cast(trunc(try_cast(trim({}) AS DOUBLE)) AS INT)"
#: Objects and scalars of two further lists of a section, nulls not counted.
_LISTS = (
    WALK.rstrip()
    + """,
held AS (SELECT tree_id, node_path, unnest(['figures', 'footnotes']) AS list_name, unnest([v->'$.figures', v->'$.footnotes']) AS l FROM walk),
items AS (SELECT tree_id, node_path AS parent_path, list_name, unnest(range(json_array_length(l)::BIGINT)) AS pos, unnest(json_extract(l, '$[*]')) AS x FROM (SELECT tree_id, node_path, list_name, CASE json_type(l) WHEN 'ARRAY' THEN l WHEN 'OBJECT' THEN json_array(l) END AS l FROM held)),
numbered AS (SELECT tree_id, parent_path, list_name, x, (row_number() OVER (PARTITION BY tree_id, parent_path, list_name ORDER BY pos) - 1)::INT AS ordinal FROM items WHERE json_type(x) <> 'NULL')
"""
)
#: Every value of a record with the nearest key above it, level by level.
_SCHEMA = (
    WALK[: WALK.index("inner1")].rstrip().rstrip(",")
    + """,
level AS (
    SELECT '' AS owner, NULL::VARCHAR AS key, j AS v FROM opened WHERE j IS NOT NULL
    UNION ALL
    SELECT CASE WHEN key IS NULL THEN owner ELSE key END, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda i: NULL::VARCHAR) END),
        unnest(CASE WHEN json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')) ELSE json_extract(v, '$[*]') END) FROM level WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": WALK + "SELECT tree_id, node_path, parent_path FROM walk",
        "p2_sections": WALK
        + f"""SELECT tree_id, node_path, parent_path, string_split(node_path, '/')[-1]::INT AS ordinal, (len(string_split(node_path, '/')) - 1)::INT AS depth, trim(v->>'$.title') AS title, v->>'$.node_id' AS node_id,
            {_WHOLE.format("v->>'$.start_index'")} AS start_index, {_WHOLE.format("v->>'$.end_index'")} AS end_index, v->>'$.summary' AS summary FROM walk""",
        "p2_figures": _LISTS + f"SELECT tree_id, parent_path, ordinal, x->>'$.title' AS title, x->>'$.label.text' AS label, {_WHOLE.format("x->>'$.start_index'")} AS start_index FROM numbered WHERE list_name = 'figures'",
        "p2_footnotes": _LISTS + f"SELECT tree_id, parent_path, ordinal, x->>'$.mark' AS mark, {_WHOLE.format("x->>'$.page'")} AS page FROM numbered WHERE list_name = 'footnotes'",
        "p2_tables": _LISTS
        + """SELECT tree_id, 'sections' AS "table", node_path AS row_id, CASE WHEN parent_path = '' THEN '' ELSE 'sections' END AS parent_table, parent_path AS parent_id, string_split(node_path, '/')[-1]::INT AS ordinal, (len(string_split(node_path, '/')) - 1)::INT AS depth FROM walk
            UNION ALL SELECT tree_id, list_name, parent_path || '/' || list_name || '/' || ordinal, 'sections', parent_path, ordinal, len(string_split(parent_path, '/'))::INT FROM numbered""",
        "p2_schema": _SCHEMA
        + """SELECT owner, key, CASE json_type(v) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE json_type(v) END AS type, count(*) AS n FROM level WHERE key IS NOT NULL GROUP BY ALL""",
    }

"""Deeply nested semi-structured records to related flat tables (problem 2).

A record is JSON text. A first pass over all records gives one merged schema, recursion folded: which keys
hold arrays, objects and scalars under which key. A second pass takes every record apart level by level:
each array of the merged schema (and each lone object where other records have an array) becomes rows of a
child table that carry the parent row's surrogate key and their own ordinal. Objects that are never arrays
stay columns of their row. No level is limited.

Both passes are narrow: a record is read, its levels are exploded one after the other from a list of open
rows, and nothing but the flat rows leaves the task, so no subtree is written or shuffled whatever the depth.
Recursion of unknown depth is what keeps this out of Catalyst's generators, which would need a join or a
checkpoint of all remaining subtrees for every level.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an envelope around the record list, outermost first; case is ignored.
ENVELOPE_KEYS = ("result", "structure")
#: Names (case ignored) under which a section may hold its child sections, beside those the merged schema shows to recur.
CHILD_KEYS = ("nodes", "children", "sections", "subsections")
#: Distinct entries of a merged schema that the driver reads; more is an error, not a cut.
MOST_ENTRIES = 100_000
#: Name of the table of top rows and of all rows below them through recursive keys.
TOP = "sections"

_EDGE = re.compile(r"^[﻿\s]+|\s+$")
_FENCE = re.compile(r"^```[a-z0-9]*\s*|\s*```$", re.I)


def _bare(text: str) -> str:
    return _FENCE.sub("", _EDGE.sub("", text))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read_json(text: str | None) -> Any:
    """The value of a record; raises ValueError when it cannot be read.

    A byte order mark, a Markdown fence around the text and a JSON string holding JSON are undone. Null, empty
    and broken texts, and nesting beyond what the JSON reader can hold (thousands of levels), cannot be read.
    """
    if text is None:
        raise ValueError("null")
    try:
        value = json.loads(_bare(text), parse_constant=_no_constant)
        return json.loads(_bare(value), parse_constant=_no_constant) if isinstance(value, str) else value
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def kind_of(value: Any) -> str:
    if isinstance(value, dict):
        return "OBJECT"
    if isinstance(value, list):
        return "ARRAY"
    if value is None:
        return "VOID"
    if isinstance(value, bool):
        return "BOOLEAN"
    return "STRING" if isinstance(value, str) else "BIGINT" if isinstance(value, int) else "DOUBLE"


def record_texts(records: DataFrame, key: str, raw: str) -> DataFrame:
    """``record_key, text``: one text a key (the least, where a key comes with several)."""
    return records.where(F.col(key).isNotNull() & F.col(raw).isNotNull()).groupBy(F.col(key).alias("record_key")).agg(F.min(raw).alias("text"))


def infer_schema(texts: DataFrame, text: str = "text") -> DataFrame:
    """One merged schema over all records: ``owner, key, type, n``.

    ``owner`` is the nearest key above ('' at the top); positions in arrays are dropped and a key below an
    equal key counts as the same table, so recursion of any depth has a schema of fixed size. Counts are
    combined within a task before they are shuffled. Unreadable texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                try:
                    open_values = [("", read_json(t))]
                except ValueError:
                    continue
                while open_values:
                    owner, value = open_values.pop()
                    if isinstance(value, dict):
                        for k, v in value.items():
                            counts[owner, k, kind_of(v)] += 1
                            if isinstance(v, (dict, list)):
                                open_values.append((k, v))
                    elif isinstance(value, list):
                        open_values += [(owner, v) for v in value if isinstance(v, (dict, list))]
            if len(counts) > MOST_ENTRIES:
                yield _entries(counts)
        yield _entries(counts)

    found = texts.select(text).mapInArrow(run, "owner string, key string, type string, n bigint")
    return found.groupBy("owner", "key", "type").agg(F.sum("n").alias("n"))


def _entries(counts: Counter) -> pa.RecordBatch:
    safe = lambda s: s.encode("utf-8", "replace").decode()
    owners, keys, kinds = ([safe(k[i]) for k in counts] for i in range(3))
    batch = pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["owner", "key", "type", "n"])
    counts.clear()
    return batch


def nested_keys(schema: DataFrame) -> list[tuple[str, str, str]]:
    """The keys of arrays and objects with their owners; bounded by the schema, not by the records."""
    rows = schema.where("type IN ('ARRAY', 'OBJECT')").select("owner", "key", "type").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError("the merged schema has too many nested keys")
    return [(r["owner"], r["key"], r["type"]) for r in rows]


def array_keys(links: list[tuple[str, str, str]]) -> set[str]:
    return {k for _, k, kind in links if kind == "ARRAY"}


def recursion_keys(links: list[tuple[str, str, str]], names: tuple[str, ...] = CHILD_KEYS) -> tuple[str, ...]:
    """Array keys below which they themselves can come again, and the spellings of ``names`` the schema has, in order of name."""
    below: dict[str, set[str]] = {}
    for owner, key, _ in links:
        below.setdefault(owner, set()).add(key)
    again = set()
    for start in below:
        seen, todo = set(), list(below[start])
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += below.get(k, ())
        if start in seen:
            again.add(start)
    arrays = array_keys(links)
    named = {k for _, k, _ in links if k.lower() in names}
    return tuple(sorted((again & arrays) | named))


def _top_rows(value: Any) -> tuple[list | None, dict]:
    """The list of top rows, and the fields of the envelopes around it; None where the record has no such list."""
    around: dict = {}
    for name in ENVELOPE_KEYS:
        inner = next((v for k, v in value.items() if k.lower() == name and isinstance(v, (dict, list))), None) if isinstance(value, dict) else None
        if inner is not None:
            around |= {k: v for k, v in value.items() if k.lower() != name}
            value = inner
    if isinstance(value, dict):
        # an object that is neither an envelope nor a list is a single top row only if it looks like one
        if value.get("title") is None and value.get("start_index") is None:
            return None, around | value
        value = [value]
    return (value if isinstance(value, list) else None), around


def take_apart(value: Any, arrays: set[str], recursive: tuple[str, ...]) -> Iterator[tuple[str, str, str, str, int, int, dict | Any]]:
    """Rows ``(table, row_id, parent_table, parent_id, ordinal, depth, own fields)`` of one record, parents before children."""
    tops, around = _top_rows(value)
    open_rows: list[tuple] = [("", "", "", "", 0, -1, around)]
    if tops is not None:
        objects = [v for v in tops if isinstance(v, dict)]
        open_rows += [(TOP, str(k), "", "", k, 0, v) for k, v in enumerate(objects)]
    taken = len(open_rows) - 1
    at = 0
    while at < len(open_rows):
        table, row_id, parent_table, parent_id, ordinal, depth, fields = open_rows[at]
        open_rows[at] = ()
        at += 1
        if not isinstance(fields, dict):
            yield table, row_id, parent_table, parent_id, ordinal, depth, fields
            continue
        own: dict = {}
        children: list = []
        lists: list[tuple[str, Any]] = []
        nested = [("", fields, own)]
        while nested:
            prefix, source, target = nested.pop()
            for k, v in source.items():
                if isinstance(v, list) or isinstance(v, dict) and k in arrays:
                    lists.append((prefix + k, v))
                elif isinstance(v, dict):
                    target[k] = {}
                    nested.append((f"{prefix}{k}.", v, target[k]))
                else:
                    target[k] = v
        yield table, row_id, parent_table, parent_id, ordinal, depth, own
        for name, v in sorted(lists, key=lambda x: x[0]):
            # nulls in lists are neither kept nor counted
            items = [x for x in ([v] if isinstance(v, dict) else v) if x is not None]
            if name in recursive:
                children += [x for x in items if isinstance(x, dict)]
            else:
                open_rows += [(name, f"{row_id}/{name}/{n}" if row_id else f"{name}/{n}", table, row_id, n, depth + 1, x) for n, x in enumerate(items)]
        first = taken if not row_id else 0
        open_rows += [(TOP, f"{row_id}/{n}" if row_id else str(n), table, row_id, n, depth + 1, x) for n, x in enumerate(children, first)]


def flatten_records(records: DataFrame, key: str, raw: str, links: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Every array level of every readable record as flat rows of child tables.

    Output: ``key, table, row_id, parent_table, parent_id, ordinal, depth, value``. ``table`` is the array's
    key ('' is the record itself, ``sections`` the top list and all lists that recur below it, dotted names are
    arrays inside objects); ``row_id`` is the surrogate key within the record, ``value`` the row's own fields
    as JSON. Elements that are lists keep their JSON as value. Repeated rows of a key count once; null
    keys, unreadable or empty texts and empty tables give no rows; further columns are not read.
    """
    texts = record_texts(records, key, raw)
    if links is None:
        links = nested_keys(infer_schema(records.select(raw).where(F.col(raw).isNotNull()), raw))
    recursive = recursion_keys(links)
    arrays = array_keys(links) | set(recursive)
    kind = dict(texts.dtypes)["record_key"]
    names = ["table", "row_id", "parent_table", "parent_id", "ordinal", "depth", "value"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            columns: list[list] = [[] for _ in names]
            for row, t in enumerate(batch.column(1).to_pylist()):
                try:
                    value = read_json(t)
                except ValueError:
                    continue
                for *head, fields in take_apart(value, arrays, recursive):
                    owner.append(row)
                    for c, x in zip(columns, head, strict=False):
                        c.append(x.encode("utf-8", "replace").decode() if isinstance(x, str) else x)
                    columns[6].append(json.dumps(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["record_key", *names])

    rows = texts.mapInArrow(run, f"record_key {kind}, table string, row_id string, parent_table string, parent_id string, ordinal int, depth int, value string")
    return rows.withColumnRenamed("record_key", key)


def flatten_tree(records: DataFrame, key: str, raw: str, links: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The rows of the table of sections: ``key, node_path, parent_path, ordinal, depth, value``.

    ``node_path`` (0-based ordinals joined by ``/``) is the section's surrogate key, ``parent_path`` is '' at the top.
    """
    rows = flatten_records(records, key, raw, links).where(F.col("table") == TOP)
    return rows.select(key, F.col("row_id").alias("node_path"), F.col("parent_id").alias("parent_path"), "ordinal", "depth", "value")


def whole_number(text: Column) -> Column:
    """Integers, decimals and numeric strings as int; others give null."""
    number = F.trim(text).try_cast("double")
    return F.when(F.abs(number) < 2.0**31, number.cast("int"))


def section_columns(sections: DataFrame) -> DataFrame:
    """Scalar fields of the section rows; optional and differently typed fields are read leniently."""
    fields = F.from_json("value", "title string, node_id string, start_index string, end_index string, summary string")
    rest = [c for c in sections.columns if c != "value"]
    read = sections.withColumn("_f", fields)
    return read.select(*rest, F.trim("_f.title").alias("title"), F.col("_f.node_id").alias("node_id"), whole_number(F.col("_f.start_index")).alias("start_index"), whole_number(F.col("_f.end_index")).alias("end_index"), F.col("_f.summary").alias("summary"))


#: What a column's types in the merged schema are read as; any other mixture is read as a string.
_COLUMN = {frozenset(["BIGINT"]): "bigint", frozenset(["DOUBLE"]): "double", frozenset(["BIGINT", "DOUBLE"]): "double", frozenset(["BOOLEAN"]): "boolean"}


def child_table(rows: DataFrame, key: str, name: str, schema: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """The child table ``name`` of ``flatten_records`` with a column for every field its merged schema has.

    Objects inside a row give one column a field, named ``outer_inner``. Columns are read by their merged
    types: whole numbers, numbers, truth values, all else as strings; a value of another type is null.
    ``parent_id`` is the parent row's surrogate key, ``ordinal`` the position in the array without nulls.
    ``wanted`` names columns that must be there; those the schema does not have are null.
    """
    entries: dict[str, dict[str, set[str]]] = {}
    for r in schema.select("owner", "key", "type").limit(MOST_ENTRIES).collect():
        entries.setdefault(r["owner"], {}).setdefault(r["key"], set()).add(r["type"])
    columns: list[tuple[str, str, str]] = []

    def add(owner: str, path: str, label: str, above: tuple[str, ...]) -> None:
        for k, kinds in sorted(entries.get(owner, {}).items()):
            if "ARRAY" in kinds:
                continue
            scalars = frozenset(kinds - {"OBJECT", "VOID"})
            if scalars or kinds == {"VOID"}:
                columns.append((f"{path}['{k}']", label + k, _COLUMN.get(scalars, "string")))
            if "OBJECT" in kinds and k not in above:
                add(k, f"{path}['{k}']", f"{label}{k}_", (*above, k))

    add(name.rpartition(".")[2], "$", "", (name,))
    parsed = rows.where(F.col("table") == name).withColumn("_v", F.try_parse_json("value"))
    fields = [F.try_variant_get("_v", F.lit(path), kind).alias(label) for path, label, kind in columns]
    known = {label for _, label, _ in columns}
    fields += [F.lit(None).cast(kind).alias(label) for label, kind in (wanted or {}).items() if label not in known]
    return parsed.select(key, "row_id", "parent_table", "parent_id", "ordinal", *fields)

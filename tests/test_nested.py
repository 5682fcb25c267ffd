import json

from inkstone.operators import nested
from inkstone.operators import tree as T

TREE = {"doc_name": "a", "structure": [{"title": "A", "start_index": 1, "end_index": "3", "nodes": [None, {"title": "A1", "start_index": 2.0, "nodes": {"title": "A11"}}, None, {"title": "A2", "figures": [{"title": "Fig. 1", "label": {"text": "x"}}, None]}]}, None, {"title": "B", "Nodes": None, "children": []}]}
WANT = {("0", ""), ("0/0", "0"), ("0/0/0", "0/0"), ("0/1", "0"), ("1", "")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree_id bigint, raw string, value string, node_path string")


def paths(df):
    return {(r["node_path"], r["parent_path"]) for r in df.collect()}


def test_envelopes_and_spellings(spark):
    text = json.dumps(TREE)
    shapes = [text, "﻿" + text, f"```json\n{text}\n```", json.dumps(text), json.dumps({"result": TREE, "status": "ok"}), json.dumps(TREE["structure"]), json.dumps(TREE, indent=2)]
    df = frame(spark, [(k, s, None, None) for k, s in enumerate(shapes)])
    out = nested.flatten_tree(df, "tree_id", "raw")
    for k in range(len(shapes)):
        assert paths(out.where(f"tree_id = {k}")) == WANT


def test_unreadable_null_repeated_and_empty(spark):
    text = json.dumps(TREE)
    df = frame(spark, [(1, text[:-20], "x", "y"), (2, "", None, None), (3, None, None, None), (None, text, None, None), (4, text, None, None), (4, text, None, None), (5, "null", None, None), (6, "[]", None, None), (7, "5", None, None)])
    out = nested.flatten_tree(df, "tree_id", "raw")
    assert out.count() == len(WANT)
    assert nested.flatten_tree(df.limit(0), "tree_id", "raw").count() == 0


def test_deep_trees_are_followed_to_the_end(spark):
    node = {"title": "x"}
    for _ in range(40):
        node = {"title": "x", "nodes": [node]}
    out = nested.flatten_tree(frame(spark, [(1, json.dumps([node]), None, None)]), "tree_id", "raw")
    assert out.count() == 41


def test_scalars_schema_and_child_tables(spark):
    df = frame(spark, [(1, json.dumps(TREE), None, None)])
    sections = nested.flatten_tree(df, "tree_id", "raw")
    rows = {r["node_path"]: r for r in nested.section_columns(sections).collect()}
    assert (rows["0"]["start_index"], rows["0"]["end_index"]) == (1, 3)
    assert rows["0/0"]["start_index"] == 2 and rows["1"]["start_index"] is None
    schema = nested.infer_schema(nested.record_texts(df, "tree_id", "raw"))
    kinds = {(r["owner"], r["key"], r["type"]) for r in schema.collect()}
    assert ("structure", "nodes", "ARRAY") in kinds and ("nodes", "nodes", "OBJECT") in kinds
    links = nested.nested_keys(schema)
    assert nested.recursion_keys(links) == ("children", "nodes")
    rows = nested.flatten_records(df, "tree_id", "raw", links)
    figures = nested.child_table(rows, "tree_id", "figures", schema, {"caption": "string"}).collect()
    assert [(r["parent_id"], r["ordinal"], r["title"], r["label_text"], r["caption"]) for r in figures] == [("0/1", 0, "Fig. 1", "x", None)]


def test_every_array_level_is_a_child_table(spark):
    record = {"authors": [{"name": "a", "works": [{"year": 1700, "seen": {"in": ["x", None, 5]}}, 7]}, {"name": "b", "parts": [{"parts": [{"n": 1}]}, {"n": 2}]}], "tags": ["t"]}
    rows = nested.flatten_records(frame(spark, [(1, json.dumps(record), None, None)]), "tree_id", "raw").collect()
    got = {(r["table"], r["row_id"], r["parent_table"], r["parent_id"], r["ordinal"]): json.loads(r["value"]) for r in rows}
    assert got[("", "", "", "", 0)] == {}
    assert got[("authors", "authors/0", "", "", 0)] == {"name": "a"} and got[("tags", "tags/0", "", "", 0)] == "t"
    assert got[("works", "authors/0/works/0", "authors", "authors/0", 0)] == {"year": 1700, "seen": {}} and got[("works", "authors/0/works/1", "authors", "authors/0", 1)] == 7
    assert got[("seen.in", "authors/0/works/0/seen.in/1", "works", "authors/0/works/0", 1)] == 5
    # a list that recurs is one table, whatever the depth
    assert {r for r in got if r[0] == "sections"} == {("sections", "authors/1/0", "authors", "authors/1", 0), ("sections", "authors/1/0/0", "sections", "authors/1/0", 0), ("sections", "authors/1/1", "authors", "authors/1", 1)}
    assert len({r["row_id"] for r in rows}) == len(rows)


def test_odd_values_do_not_stop_a_record(spark):
    bad = '[{"title": "\\ud800", "start_index": "NaN", "end_index": 1e300, "nodes": [[1], "x", {"title": 5}]}]'
    out = {r["node_path"]: r for r in nested.section_columns(nested.flatten_tree(frame(spark, [(1, bad, None, None), (2, "[NaN]", None, None), (3, "[" * 50_000, None, None)]), "tree_id", "raw")).collect()}
    assert set(out) == {"0", "0/0"} and out["0"]["start_index"] is None and out["0"]["end_index"] is None and out["0/0"]["title"] == "5"


def nodes(spark, rows):
    return spark.createDataFrame(rows, "doc string, node_path string, parent_path string, depth int, title string, start_index int, end_index int, summary string")


TREE_ROWS = [("d", "0", "", 0, "Preface", 1, 3, None), ("d", "1", "", 0, "Body", 4, 20, "s"), ("d", "1/0", "1", 1, "Same", 4, 20, None), ("d", "1/0/0", "1/0", 2, "Part", 4, 9, None), ("d", "1/0/1", "1/0", 2, "Rest", 10, 20, None), ("d", "2", "", 0, "Index", 21, 22, None)]


def test_cleaning_of_trees(spark):
    n = nodes(spark, TREE_ROWS)
    excluded = spark.createDataFrame([("d", ["pre", " "])], "doc string, exclude array<string>")
    assert {r["node_path"] for r in T.drop_sections(n, "doc", excluded).collect()} == {"1", "1/0", "1/0/0", "1/0/1", "2"}
    bounds = spark.createDataFrame([("d", 5, 12)], "doc string, first_page int, last_page int")
    kept = {r["node_path"]: (r["start_index"], r["end_index"]) for r in T.keep_pages(n, "doc", bounds).collect()}
    assert kept == {"1": (5, 12), "1/0": (5, 12), "1/0/0": (5, 9), "1/0/1": (10, 12)}
    up = {r["node_path"]: r["parent"] for r in T.collapse_single_children(n, "doc").collect()}
    assert up == {"0": "", "1": "", "1/0/0": "1", "1/0/1": "1", "2": ""}
    d = T.describe(n, "doc").first()
    assert (d["nodes"], d["leaves"], d["depth"], d["min_pages"], d["max_pages"], d["summaries"]) == (6, 4, 3, 2, 11, 1)
    assert [r["line"] for r in T.outline(n, "doc").orderBy("line_no").collect()] == ["Preface (p. 1)", "Body (p. 4)", "  Same (p. 4)", "Index (p. 21)"]


def test_duplicated_sections_keep_the_upper_title(spark):
    rows = [("d", "0", "", 0, "PARENT", 1, 9, None), ("d", "0/0", "0", 1, "CHILD", 1, 9, None), ("d", "0/0/0", "0/0", 2, "G1", 1, 4, None), ("d", "0/0/1", "0/0", 2, "G2", 5, 9, None), ("d", "1", "", 0, "A", 3, 3, None), ("d", "1/0", "1", 1, "B", 3, 3, None), ("d", "1/0/0", "1/0", 2, "C", 3, 3, None)]
    got = {r["title"]: r["parent"] for r in T.collapse_single_children(nodes(spark, rows), "doc").collect()}
    assert got == {"PARENT": "", "G1": "0", "G2": "0", "A": ""}


def test_median_pages_of_a_tree_are_not_cut(spark):
    rows = [("d", "0", "", 0, "A", 1, 1, None), ("d", "1", "", 0, "B", 2, 3, None)]
    meta = spark.createDataFrame([("d", "flash", "bookmarks", 1.5), ("e", None, "llm", None)], "doc string, mode string, source string, seconds double")
    got = {r["doc"]: r for r in T.describe(nodes(spark, rows), "doc", meta).collect()}
    assert got["d"]["median_pages"] == 1.5 and got["d"]["mode"] == "flash" and (got["e"]["nodes"], got["e"]["leaves"], got["e"]["depth"], got["e"]["max_pages"]) == (0, 0, 0, 0)


def test_redo_takes_long_sections_and_unusable_summaries(spark, tmp_path):
    from inkstone.plans.trees import summary_redo

    good = "A summary that is long enough to be kept as it is."
    sections = [(1, 6, None), (1, 2, "Please provide the text of the section so that I can summarise it."), (2, 2, "stub"), (1, 2, good), (3, 2_000_000_000, None)]
    raw = json.dumps({"structure": [{"title": "t", "start_index": a, "end_index": b, "summary": s} for a, b, s in sections]})
    spark.createDataFrame([(1, "d", raw)], "tree_id bigint, doc string, raw string").write.parquet(str(tmp_path / "trees.parquet"))
    spark.createDataFrame([("d", n, "word " * 40) for n in range(1, 9)], "doc string, page int, text string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["node_path"]: r["words"] for r in summary_redo(spark, str(tmp_path)).collect()} == {"0": 240, "1": 80, "2": 40, "4": 240}

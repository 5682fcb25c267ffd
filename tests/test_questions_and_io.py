import json

from pyspark.sql import functions as F

from inkstone.operators import evaluation as E
from inkstone.operators import questions as Q
from inkstone.providers import ReplayModel, TextFileReader
from inkstone.sources import readers, sinks
from inkstone.streaming import ingest


def test_question_checks(spark):
    rows = [
        ("", "a", ["P1"], ["A"], ["A", "B"], 4, "empty question or answer"),
        ("What does p1 say?", "a", ["P1"], ["A"], ["A", "B"], 4, "question refers to passages"),
        ("What do Passages say?", "a", ["P1"], ["A"], ["A", "B"], 4, "question refers to passages"),
        ("Why?", "a", ["P9", "x"], ["A"], ["A", "B"], 4, "no valid sources"),
        ("Why?", "a", ["[P1]", "P9"], ["A"], ["A", "B"], 4, "sources do not cover both authors"),
        ("Why?", "a", ["P1", "P3"], ["B", "A"], ["A", "B"], 4, None),
        ("Why?", "a", None, None, ["A", "B"], 4, "no valid sources"),
        (None, None, None, None, None, None, "empty question or answer"),
    ]
    df = spark.createDataFrame(rows, "q string, a string, s array<string>, c array<string>, p array<string>, n int, want string")
    got = Q.question_defect(F.col("q"), F.col("a"), F.col("s"), F.col("c"), F.col("p"), F.col("n"))
    assert df.where(~got.eqNullSafe(F.col("want"))).select("q", got).collect() == []


def test_citations_keep_ten_from_one(spark):
    df = spark.createDataFrame([("x [P2] y P9", ["Hume, p. 1", "Kant, p. 9"]), ("P10 and P1", [f"A, p. {k}" for k in range(1, 11)]), ("none", [])], "a string, c array<string>")
    assert [r[0] for r in df.select(Q.cite(F.col("a"), F.col("c"))).collect()] == ["x [Kant, p. 9] y ", "[A, p. 10] and [A, p. 1]", "none"]


def test_pairs(spark):
    counts = spark.createDataFrame([(1, "Hume", 7), (1, "Mill", 6), (1, "Nietzsche", 3), (2, "Kant", 1)], "community bigint, author string, n bigint")
    got = [(r["a"], r["b"]) for r in Q.choose_pairs(counts).orderBy("position").collect()]
    assert got == [("Hume", "Mill"), ("Hume", "Nietzsche"), ("Mill", "Nietzsche")]
    assert [(r["community"], r["a"], r["b"]) for r in Q.first_pairs(counts).collect()] == [(1, "Hume", "Mill")]


def test_passages_are_cut_at_words(spark):
    df = spark.createDataFrame([("a " * 701,), ("b",), (None,)], "t string")
    got = [r[0] for r in df.select(Q.shorten(F.col("t"))).collect()]
    assert got[0].endswith("a [...]") and got[1] == "b" and got[2] == ""


def test_calls_are_tried_again_and_faults_stay_with_their_row(spark):
    df = spark.createDataFrame([(1, "known"), (2, "other")], "k int, p string")
    got = {r["k"]: (r["raw"], r["error"]) for r in Q.ask(df, ["k"], "p", ReplayModel({"known": "{}"})).collect()}
    assert got[1] == ("{}", None) and got[2][0] is None and got[2][1].startswith("LookupError")


def test_evidence(spark):
    long = "the quick brown fox jumps over"
    rows = [(long, [long], True), (f"{long} ... short", [long], True), (f"{long} … and another piece that is long", [long], False), ("short", ["short"], False), (None, ["x"], False), (long, [], False)]
    squashed = [(e, ["".join(c for c in s if c.isalnum()) for s in src], w) for e, src, w in rows]
    df = spark.createDataFrame(squashed, "e string, s array<string>, want boolean")
    assert df.where(E.evidence_found(F.col("e"), F.col("s")) != F.col("want")).count() == 0


def test_scores(spark):
    claims = spark.createDataFrame([("a", "supported"), ("a", "supported"), ("b", "supported"), ("b", "contradicted"), ("c", "unsure"), ("d", None)], "id string, verdict string")
    got = {r["id"]: (r["n_claims"], r["support"], r["grounded"], r["contradicted"]) for r in E.score_answers(claims).collect()}
    assert got == {"a": (2, 1.0, True, False), "b": (2, 0.5, False, True), "c": (0, 0.0, False, False), "d": (0, 0.0, False, False)}
    report = E.evaluation_report(E.score_answers(claims).withColumn("needs_both", F.col("id") < "b")).first()
    assert (report["answers"], report["grounded_pct"], report["contradicted_pct"]) == (4, 25.0, 25.0)
    assert E.evaluation_report(E.score_answers(claims.limit(0)).withColumn("needs_both", F.lit(True))).first()["grounded_pct"] == 0.0


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe")
    pages, faults = readers.read_documents(spark, str(tmp_path / "in"), TextFileReader(), "*.txt")
    assert {(r["doc"], r["page"], r["text"]) for r in pages.collect()} == {("a", 1, "one"), ("a", 2, "two")}
    assert [(r["doc"], r["error"].split(":")[0], r["head"]) for r in faults.collect()] == [("b", "UnicodeDecodeError", "FFFE")]
    (tmp_path / "corpus.json").write_text(json.dumps({"documents": {"a": {"author": "A", "title": "T", "pages": [2, 9], "exclude": ["X"]}, "b": {}}}))
    corpus = readers.read_corpus(spark, str(tmp_path / "corpus.json"))
    assert {r["doc"]: (r["first_page"], r["exclude"]) for r in corpus.collect()} == {"a": (2, ["X"]), "b": (None, None)}
    sinks.write_json_lines(pages, str(tmp_path / "pages"))
    lines = [x for f in (tmp_path / "pages").glob("*.json") for x in f.read_text().splitlines()]
    (tmp_path / "own").mkdir()
    (tmp_path / "own/p.jsonl").write_text("\n".join([lines[0], "", "{broken", *lines[1:], ""]))
    assert readers.read_json_lines(spark, str(tmp_path / "own"), "doc string, page int, text string").count() == 2
    (tmp_path / "trees").mkdir()
    (tmp_path / "trees/a.json").write_text('{"structure": []}')
    assert [(r["doc"], r["raw"]) for r in readers.read_trees(spark, str(tmp_path / "trees")).collect()] == [("a", '{"structure": []}')]
    sinks.append_cache(corpus.select("doc").limit(1), str(tmp_path / "cache"))
    assert readers.not_cached(corpus, spark.read.parquet(str(tmp_path / "cache")), ["doc"]).count() == 1
    sinks.write_report(corpus, str(tmp_path / "report"))
    assert len([json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "report")).collect()]) == 2
    notes = Q.markdown(corpus, "doc", F.coalesce("title", F.lit("-")), ["doc"])
    sinks.write_markdown(notes, str(tmp_path / "md"))
    edges = spark.createDataFrame([("HAS", "a", "b")], "kind string, src string, dst string")
    sinks.write_graph({"Document": (corpus.select("doc"), ["doc"])}, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/nodes/Document")).count() == 2
    try:
        sinks.write_graph({"Document": (corpus.select("doc").union(corpus.select("doc")), ["doc"])}, edges, str(tmp_path / "graph"))
    except ValueError as e:
        assert "not unique" in str(e)
    else:
        raise AssertionError("a repeated key must be an error")


def test_stream_takes_in_what_is_there(spark, tmp_path):
    rows = [("d", 1, "word " * 30, 0.9, 0.0, "2024-01-01 10:00:00"), ("d", 1, "word " * 30, 0.9, 0.0, "2024-01-01 11:00:00"), ("d", 2, None, 0.0, 0.9, "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "doc string, page int, text string, quality double, image_coverage double, at string").withColumn("loaded_at", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "pages"))
    stream = ingest.page_stream(spark, str(tmp_path / "pages"), df.schema)
    ingest.run_available(ingest.arrivals(ingest.routed(stream)), "arrivals", str(tmp_path / "state"), "complete")
    got = {(str(r["day"])[:10], r["route"]): r["n"] for r in spark.table("arrivals").collect()}
    assert got == {("2024-01-01", "native"): 1, ("2024-01-02", "ocr"): 1}

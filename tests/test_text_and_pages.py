from pyspark.sql import functions as F

from inkstone.functions import salvage
from inkstone.functions import text as X
from inkstone.operators import lines as L
from inkstone.operators import quality as Q


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "vir-\ntue a café 12x", X.letter_tokens(F.col("t"))) == ["virtue", "café"]
    assert one(spark, None, X.letter_tokens(F.col("t"))) == []
    assert one(spark, " a b\n c ", X.word_count(F.col("t"))) == 3
    assert one(spark, None, X.word_count(F.col("t"))) == 0
    cut = lambda t: [tuple(r) for r in one(spark, t, X.sentences(F.col("t")))]
    assert cut('He said "go." Then left.') == [('He said "go.', 0, 12), ("Then left.", 14, 24)]
    assert cut("See [Off. lib. i. Cap. 6.] Now.") == [("See [Off. lib. i. Cap. 6.] Now.", 0, 31)]
    assert cut("A [b. C\nd-\ne.") == [("A [b. C de.", 0, 13)] and cut(None) == [] and cut(" \n ") == []
    # a bracket that is never closed holds nothing together beyond its length
    long = "Open [ " + "word " * 120 + "end. Next one. Last."
    assert [x[0] for x in cut(long)][1:] == ["Next one.", "Last."]
    assert one(spark, " a  b-\nc \n d\te ", X.one_line(F.col("t"))) == "a  bc d\te"
    assert one(spark, "ﬁve Ⅻ", X.squash_compatible(F.col("t"))) == "fivexii"
    assert one(spark, "Page 12 of 300", X.mask_digits(F.col("t"))) == "page # of #"


def test_routing_boundaries(spark):
    rows = [(19, 0.99, 0.5, "ocr", "scan_without_text"), (19, 0.1, 0.49, "native", "sparse_page"), (20, 0.8499, 0.0, "ocr", "low_quality_text"), (20, 0.85, 1.0, "native", "good_text"), (None, None, None, "native", "sparse_page")]
    df = spark.createDataFrame(rows, "w int, q double, c double, r string, why string")
    d = Q.route(F.col("w"), F.col("q"), F.col("c"))
    assert df.where((d["route"] != F.col("r")) | (d["reason"] != F.col("why"))).count() == 0


def test_scan_replaces_text_only_if_better(spark):
    df = spark.createDataFrame([(0.78, 0.78, "ocr_not_better"), (0.78, 0.781, "low_quality_text"), (0.78, None, "ocr_not_better")], "q double, o double, why string")
    d = Q.keep_better(Q.route(F.lit(50), F.col("q"), F.lit(0.0)), F.col("q"), F.col("o"))
    assert df.where(d["reason"] != F.col("why")).count() == 0


def test_quality_of_pages_without_tokens(spark):
    pages = spark.createDataFrame([("d", 1, "good bad"), ("d", 2, None), ("d", 3, ""), ("d", 4, "12 !")], "doc string, page int, text string")
    words = spark.createDataFrame([("en", "Good"), ("de", "good"), ("en", None)], "lang string, word string")
    got = {r["page"]: (r["quality"], r["n_words"]) for r in Q.text_quality(pages, words, ["doc", "page"]).collect()}
    assert got == {1: (0.5, 2), 2: (0.0, 0), 3: (0.0, 0), 4: (0.0, 0)}
    assert Q.text_quality(pages.limit(0), words, ["doc", "page"]).count() == 0


def test_coverage_and_lines_from_spans(spark):
    boxes = spark.sql("select array(named_struct('width', 2.0D, 'height', 3.0D), named_struct('width', 9.0D, 'height', 9.0D)) b, cast(null as array<struct<width:double,height:double>>) n")
    assert boxes.select(Q.image_coverage(F.col("b"), F.lit(10.0)).alias("x"), Q.image_coverage(F.col("n"), F.lit(10.0)).alias("y")).first()[:] == (1.0, 0.0)
    spans = spark.createDataFrame([("d", 1, 0, 0, 10.0, "ab"), ("d", 1, 0, 1, 12.0, "cdef"), ("d", 1, 0, 2, 30.0, "  ")], "doc string, page int, line_no int, span_no int, size double, text string")
    r = L.span_lines(spans, ["doc", "page"]).first()
    assert (r["size"], r["text"]) == (11.5, "abcdef")


def lines_of(spark, pages):
    return L.page_lines(spark.createDataFrame([("d", p, t) for p, t in pages], "doc string, page int, text string"))


def test_heads_are_strictly_more_than_their_share(spark):
    ten = [(p, ("Head 1\n" if p <= 3 else "") + f"body text number {chr(96 + p)}\nsecond line {chr(96 + p)}\nthird {chr(96 + p)}\nfourth {chr(96 + p)}\nlast one {chr(96 + p)}") for p in range(1, 11)]
    assert L.running_heads(lines_of(spark, ten)).count() == 0
    eleven = [(p, "Head 7\n" + t if p == 4 else t) for p, t in ten]
    assert [(r["head"], r["pages_with"]) for r in L.running_heads(lines_of(spark, eleven)).collect()] == [("head #", 4)]


def test_page_numbers_and_small_lines(spark):
    page = "75\n– 12 –\nxxxvi\ncivil\nChapter 1\nbody line goes here"
    others = [(p, f"first {chr(96 + p)} line\nsecond {chr(96 + p)} line") for p in range(2, 6)]
    causes = {r["text"]: r["cause"] for r in L.drop_causes(lines_of(spark, [(1, page), *others])).where("page = 1").collect()}
    assert causes == {"75": "page_number", "– 12 –": "page_number", "xxxvi": "page_number", "civil": "page_number", "Chapter 1": None, "body line goes here": None}


def test_offsets_and_pages(spark):
    pages = spark.createDataFrame([("d", 2, "a" * 9), ("d", 3, "b" * 9), ("d", 4, "c" * 9), ("e", 1, None)], "doc string, page int, text string")
    starts = L.page_offsets(pages, bucket=2)
    assert {(r["doc"], r["page"]): r["start_off"] for r in starts.collect()} == {("d", 2): 0, ("d", 3): 10, ("d", 4): 20, ("e", 1): 0}
    asked = spark.createDataFrame([("d", 9), ("d", 10), ("d", 25)], "doc string, off bigint")
    assert {r["off"]: r["page"] for r in L.offset_to_page(asked, starts, stretch=8).collect()} == {9: 2, 10: 3, 25: 4}
    wanted = spark.createDataFrame([("d", 1), ("d", 3), ("d", 9)], "doc string, page int")
    assert {r["page"]: r["off"] for r in L.page_to_offset(wanted, starts).collect()} == {1: 0, 3: 10, 9: 20}


def test_summaries(spark):
    cases = [
        ('{"points": ["a long enough point one.", "another long point two"]}', "a long enough point one. another long point two."),
        ("Please provide the text of the section so that I can summarise it.", None),
        ("x" * 39, None),
        ('```json\n{"summary": "A summary that is long enough to be kept here."}\n```', "A summary that is long enough to be kept here."),
        ('{"summary": "A summary that is long enough to be kept here." ', "A summary that is long enough to be kept here."),
        ('{"summary": "A summary that is cut in the middle of a sen', "A summary that is cut in the middle of a sen"),
        ('{"note": "A stretch in quotes that is long enough, twice over.", "x": ', "A stretch in quotes that is long enough, twice over."),
        ('["one point of some length", "two points of some length."]', "one point of some length. two points of some length."),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert df.where(~salvage.clean_summary(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


def test_truth_of_json_values(spark):
    cases = [('"false"', True), ("false", False), ("null", False), ("0", False), ("2", True), ('""', False), ("[]", False), ("[0]", True), ("{}", False), (None, False)]
    df = spark.createDataFrame(cases, "j string, want boolean").select(salvage.truthy(F.try_parse_json("j")).alias("got"), "want")
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_text_of_ranges_is_whole_up_to_its_clip(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, None), ("d", 4, "xyz"), ("d", 5, "end")], "doc string, page int, text string")
    ranges = spark.createDataFrame([("d", 1, 5), ("d", 4, 4)], "doc string, first_page int, last_page int")
    whole = "abc\n\n\nxyz\nend"
    for clip in range(1, len(whole) + 3):
        assert {r["first_page"]: r["text"] for r in L.range_text(ranges, pages, clip).collect()} == {1: whole[:clip], 4: "xyz"[:clip]}


def test_interval_text_keeps_both_pages(spark, tmp_path):
    from inkstone.plans.pages import pages_interval_text

    spark.createDataFrame([("d", 1, "a" * 1300), ("d", 2, "b" * 1300)], "doc string, page int, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["first_page"]: r["text"] for r in pages_interval_text(spark, str(tmp_path)).collect()}
    assert got == {1: "a" * 1300 + "\n" + "b" * 1300, 2: "b" * 1300 + "\n"}

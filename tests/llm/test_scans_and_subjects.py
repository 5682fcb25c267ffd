import random

from inkstone.llm import scans as P
from inkstone.llm import subjects as J

WORDS = "the conscience of a man is tested by duty and habit while pride and compassion restrain resentment in every case known to moral worth".split()
PAGES = "doc string, page int, text string, kind string"


def book(pages=40, seed=1):
    rng = random.Random(seed)
    return [("d", p, f"THE OLD BOOK   {p}\n" + "\n".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(25)) + "\n\n– 7 –".replace("7", str(p)), None) for p in range(3, pages)]


def noise(spark, rows, corpus=(("d", "Anon", "The Old Book"),), words=WORDS):
    pages = spark.createDataFrame(rows, PAGES)
    works = spark.createDataFrame(list(corpus), "doc string, author string, title string")
    lexicon = spark.createDataFrame([("en", w) for w in words] + [(None, "x")], "lang string, word string")
    return {(r["page"], r["line_no"], r["kind"]) for r in P.page_noise(pages, works, lexicon).where("doc = 'd'").collect()}


def test_kinds_of_noise(spark):
    special = ("d", 1, "\n".join(["The 0ld Bo0k", "the conscicnce of a man is tested by duty", "while pri de and compassion restrain", "theconscience of a man and com~passion", "in every case known to the con-", "science of a man and to moral re¬", "sentment while duty-", "pride is tested and pride and habit con­", "ii"]), None)
    after = ("d", 2, "THE OLD BOOK   2\nscience of a man\nis tested by duty and hab-\n2", None)
    got = noise(spark, [*book(), special, after, after, ("d", 50, None, None), ("d", 51, "", None), (None, 3, "x", None)])
    first = {(n, k) for p, n, k in got if p == 1}
    assert first == {(0, "running_head"), (1, "misread"), (2, "misread"), (3, "misread"), (4, "hyphen"), (5, "hyphen"), (7, "hyphen"), (8, "page_number")}
    assert {(n, k) for p, n, k in got if p == 2} == {(0, "running_head"), (2, "hyphen"), (3, "page_number")}
    rest = {(k, n) for p, n, k in got if p > 2}
    assert rest == {("running_head", 0), ("page_number", 27)}


def test_empty_tables(spark):
    assert noise(spark, book()[:1][:0] or [("d", 1, None, None)]) == set()
    assert noise(spark, [("d", 1, "hello there", None)], corpus=[("e", None, None)], words=[]) == set()


def test_openings_and_title_pages_are_no_heads(spark):
    rows = book() + [("d", 1, "THE OLD BOOK\n\nby Anon", None), ("d", 60, "CHAPTER II\nOf Pride\n\nthe conscience of a man", None), ("d", 61, "Of Pride\nthe conscience of a man\n\n61", None)]
    got = noise(spark, rows)
    assert {x for x in got if x[0] in (1, 60)} == set()
    assert (61, 0, "running_head") in got and (61, 3, "page_number") in got


def test_page_numbers():
    for line in ("12", "– 12 –", "[l2]", "xiv", "Page v of 132", "p. 2O", "(7)", "  31  "):
        assert P.is_page_number(line), line
    for line in ("", "civil", "mix", "the end", "1758 zusammen.", "I think", "p. 3 and 4"):
        assert not P.is_page_number(line), line


def test_paragraphs_go_on_over_pages(spark):
    a = ("d", 1, "THE OLD BOOK   1\n    the conscicnce of a man is\ntested by du-\nty\n    while pride and com-\n1", None)
    b = ("d", 2, "THE OLD BOOK   2\npassion restrain\nresentment\n\nhabit is known\n2", None)
    pages = spark.createDataFrame([*book(30), a, b, b], PAGES)
    works = spark.createDataFrame([("d", "Anon", "The Old Book")], "doc string, author string, title string")
    lexicon = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    got = [r["text"] for r in P.paragraphs(pages, works, lexicon).where("page < 3").orderBy("page", "piece").collect()]
    assert got[0] == "the conscience of a man is tested by duty"
    assert got[1] == "while pride and compassion restrain resentment"
    assert got[2].startswith("habit is known")


FIELDS = {"law": "judge verdict court statute".split(), "sport": "wrestler trophy referee match".split(), "art": "painter melody fresco theatre".split()}


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(2)
    plain = "the {} of a man is like the {} of the town and the {} in it"
    filler = ["pride", "habit", "duty", "shame", "virtue", "reason"]
    docs, truth, labels = [], {}, []
    for k in range(900):
        own = rng.sample(sorted(FIELDS), rng.choice([0, 1, 1, 1, 2]))
        parts = [plain.format(*(rng.choice(FIELDS[s]) for _ in range(3))) for s in own for _ in range(3)]
        parts += [plain.format(*(rng.choice(filler) for _ in range(3))) for _ in range(3)]
        rng.shuffle(parts)
        docs.append((k, ". ".join(parts) + ".", "x"))
        truth[k] = set(own)
        if k < 300 and own:
            marked = set(own) if rng.random() > 0.05 else {rng.choice(sorted(FIELDS))}
            labels += [(k, s, "r") for s in marked] + [(k, next(iter(marked)), "r2")]
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "the judge of the court.", "x"), docs[400]]
    labels += [(None, "law", "r"), (1, None, "r"), (5000, "law", "r"), (2, "unknown", "r")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    m = spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string")
    s = spark.createDataFrame([(1, "law"), (2, "sport"), (3, "art"), (4, None)], "subject_id int, subject string")
    found = {}
    rows = J.subject_posteriors(d, m, s).collect()
    for r in rows:
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len(rows) == len({(r["doc_id"], r["subject"]) for r in rows})
    held = range(300, 900)
    right = sum(len(truth[k] & found.get(k, set())) for k in held)
    assert right / sum(len(truth[k]) for k in held) > 0.95
    assert right / sum(len(found.get(k, set())) for k in held) > 0.95
    assert 2000 not in found and 2001 not in found and None not in found
    assert J.subject_posteriors(d, m, s.limit(0)).count() == 0
    assert J.subject_posteriors(d.limit(0), m, s).count() == 0


def test_forms_that_are_not_held_count_as_well(spark, monkeypatch):
    rng = random.Random(4)
    counts = {"the": 3000, "meadow": 1500, "lantern": 900, "harvest": 420, "cistern": 260, "violin": 130, "mosaic": 70, "basin": 40, "gravel": 24, "saffron": 22, "thistle": 5}
    # misreadings, of which some are too frequent to be; long s; words run together; torn-off pieces
    counts |= {"mcadow": 100, "meadovv": 200, "1antern": 4, "harve5t": 40, "c1stern": 33, "vio1in": 17, "mosa1c": 3, "ba5in": 5, "grave1": 3, "th1stle": 3}
    counts |= {"baſin": 60, "moſaic": 71, "ſaffron": 30, "harveſt": 3, "ciſtern": 200, "meadowlantern": 25, "harvestcistern": 8, "mosaicviolin": 2, "gravelbasin": 1, "lant": 4, "mead": 14, "arvest": 4, "ern": 8, "x": 160, "z": 149}
    tokens = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(tokens)
    rows = [("d", p, "\n".join(" ".join(["the", *tokens[at + k : at + k + 8]]) for k in range(0, 200, 8)), None) for p, at in enumerate(range(0, len(tokens), 200))]
    pages = spark.createDataFrame(rows, PAGES)
    lexicon = spark.createDataFrame([("en", "thistle")], "lang string, word string")
    corpus = spark.createDataFrame([("d", None, None)], "doc string, author string, title string")
    whole, _ = learned = P.learn(pages, lexicon)
    found = set(P.page_noise(pages, corpus, lexicon, learned).collect())
    for most in (2, 8, 25):
        monkeypatch.setattr(P, "MOST_FORMS", most)
        few, _ = learned = P.learn(pages, lexicon)
        assert set(P.page_noise(pages, corpus, lexicon, learned).collect()) == found
        a, b = whole["en"], few["en"]
        assert len(b.held) <= most + 1 and b.held_from > a.held_from
        for x in [*counts, "bas1n", "moſa1c", "vi0lin", "violinmosaic", "never"]:
            assert (a.right.get(x), a.wrong.get(x), a.mate(x), a.verdict(x), a.repair(x, True), x in a.mates) == (b.right.get(x), b.wrong.get(x), b.mate(x), b.verdict(x), b.repair(x, True), x in b.mates), (most, x)
    assert a.wrong["ciſtern"] == "cistern" and a.wrong["harvestcistern"] == "harvest cistern"
    assert "baſin" in a.right and "vio1in" in a.right and "lant" not in a.right


def test_last_lines_and_misread_lines_are_read_whole(spark):
    plain = "the conscience of a man is tested"
    twice = "\n".join(["pride and lantern and meadow is duty"] * 40)
    marble = "\n".join(["the conscicnce of an old marble statue"] * 6)
    rows = book() + [("d", 1, f"{plain}\n{twice}\n{marble}\n{plain},", None), ("d", 2, f"{plain}\n{plain}\nPride lanternmeadow habit", None), ("d", 60, f"{plain}\nduty of an old marb1e statue\n{plain},", None)]
    got = noise(spark, rows, words=[*WORDS, "old", "an", "statue"])
    assert {(p, n) for p, n, k in got if k == "misread"} == {*((1, k) for k in range(41, 47)), (2, 2), (60, 1)}

from pyspark.sql import functions as F

from inkstone.llm import responses as R

Q = "How do Hume and Kant differ on the relation between habit and duty?"
OTHERS = [
    "The two part ways once duty is at stake. Both agree that habit explains pride.",
    "Hume grants that the will is free in the end, while Kant does not.",
    "Here the argument turns from habit to duty. Hume starts from the will; Kant starts from the law.",
    "Two points matter:\n1. the good will\n2. moral worth",
    "Three points matter:\n- the good will\n- moral worth\n- pride",
]
CASES = [
    (None, "empty"), ("", "empty"), (" ​", "empty"), ("N/A", "empty"), ("<no answer>", "empty"), ("```json\n```", "empty"), ("Answer:", "empty"), ("[Hume, p. 3] [Kant, p. 8]", "empty"), ("…", "empty"), ('{"answer": ""}', "empty"), ("<p></p>", "empty"),
    (Q, "copy"), (Q.lower(), "copy"), (f"> {Q}", "copy"), (f"“{Q[:-1]}” [Hume, p. 4]", "copy"), (f"{Q}\n{Q}", "copy"), (f"The question is: {Q}", "copy"), (f"Question: {Q}", "copy"),
    (f"{Q}\nHume starts from the will.", None), (f"{Q} Duty and habit", "truncated?"),
    ("I'm sorry, but I don't have access to this book.", "refusal"), ("Unfortunately, nothing in the supplied text lets me decide this. Please provide the text.", "refusal"), ("As an assistant, I would rather not take a position on habit.", "refusal"), ("The passages do not contain enough information for an answer.", "refusal"),
    ("I cannot answer, says the hermit in the dialogue, and Kant lets him be silent.", None), ("“I am unable to say more,” the letter ends, and that is an answer too.", None), ("On duty, Hume refuses to follow Kant, because habit is older.", None), ("Sorry is a word Hume never uses.", None),
    ("Hume nennt die Pflicht eine Quelle, aber keinen Beweis. Das ist nicht dasselbe wie die Reue.", "other_language"), ("若没有义务，骄傲只是空话。", "other_language"), ("The draft adds “Was bleibt, wenn die Pflicht verschwindet?” to the old text of the book.", None),
    ("Hume grants that the will is", "truncated"), ("The two part ways once duty is and the", "truncated"), ("Both agree that habit expl", "truncated"), ("It is so. Three points matter:\n1. the good will\n2.", "truncated"), ("It is so. Three points matter:\n1. the good will\n2. moral worth", "truncated"), ("Here the argument turns (cf. vol.", "truncated"), ("It is so. Kant, on the other", "truncated"), ("It is so. The question is (as we saw in the", "truncated"),
    ("Yes, both do", None), ("Only Kant", None), ("The second one, on p. 50", None), ("Mainly the good will", None), ("The good will and moral worth", None), ("No. Neither of them does.", None), ("Two points matter:\n1. pride\n2. duty", None), ("- habit\n- duty", None), ("It is so. [Kant, p. 12]", None),
]


def test_kinds_of_defects(spark):
    cases = [(a, w) for a, w in CASES if w != "truncated?"]
    rows = [(f"q{k}", Q, a, "m", k) for k, (a, _) in enumerate(cases)] + [(f"o{k}", Q, a, "m", k) for k, a in enumerate(OTHERS)]
    rows += [rows[0], (None, Q, None, "m", 1)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, model string, defect int")
    got = {r["id"]: r["defect"] for r in R.defective_pairs(df).collect()}
    wrong = [(a, w, got.get(f"q{k}")) for k, (a, w) in enumerate(cases) if got.get(f"q{k}") != w]
    assert wrong == []
    assert not any(k.startswith("o") for k in got)


def test_other_languages(spark):
    rows = [
        ("a", "Welche Rolle spielt die Datenbank bei Hume, und was sagt Kant dazu?", "Leider reicht das Material für eine Antwort nicht aus."),
        ("b", "Welche Rolle spielt die Datenbank bei Hume, und was sagt Kant dazu?", "Vor allem, wie Hume sagt, der Stolz"),
        ("c", "Quel rôle joue la guilde chez Hume, et qu'en dit Kant ?", "Il m'est impossible de trancher. Merci de fournir le texte."),
        ("d", "遗嘱在Hume的论证中起什么作用，Kant是否同意？", "所给段落没有足够的信息。请提供原文。"),
        ("e", "遗嘱在Hume的论证中起什么作用，Kant是否同意？", "两人都认为骄傲比悔恨更重要。"),
        ("f", None, "Hume nennt die Pflicht eine Quelle."),
        ("g", "", ""),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "id string, question string, answer string, model string")
    assert {r["id"]: r["defect"] for r in R.defective_pairs(df).collect()} == {"a": "refusal", "c": "refusal", "d": "refusal", "g": "empty"}
    assert R.defective_pairs(df.limit(0)).count() == 0


def test_neighbours_in_the_order_over_many_ranges(spark):
    import random

    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    anchors = {t for t in texts if rng.random() < 0.2}
    df = spark.createDataFrame([(t, t in anchors) for t in texts], "text string, anchor boolean")
    got = {r["text"]: (r["before"], r["after"]) for r in R.sorted_neighbours(df, "text", "anchor").collect()}
    order = sorted(anchors)
    for t in texts:
        if t not in anchors:
            assert got[t] == (max((a for a in order if a < t), default=None), min((a for a in order if a > t), default=None))


def test_answers_that_pile_up_at_a_length(spark):
    names = [f"{a}{b}" for a in "BCDFGHJKLMNPRSTVW" for b in ("orin", "alde", "ulno")]
    long = lambda n: (f"{n} speaks of nothing but " + "very " * 60)[:200].rstrip() + "x" * 3
    rows = [(f"l{k}", Q, long(n).ljust(203, "y")[:203], "m") for k, n in enumerate(names)] + [("s", Q, "Only Kant", "m")]
    df = spark.createDataFrame(rows, "id string, question string, answer string, model string")
    assert {r["defect"] for r in R.defective_pairs(df).collect()} == {"truncated"}


UNSEEN_REFUSALS = [
    "I am afraid I cannot give an opinion on that.",
    "Regrettably I'm unable to weigh these two authors against each other.",
    "It is not possible to determine this from two short quotations.",
    "The pages you sent do not mention the topic at all.",
    "None of the passages tells me what she thought of promises.",
    "My apologies, but this lies outside my remit.",
    "I must decline to take sides here.",
    "You had better ask someone who has read the whole work.",
    "I do not have enough material to go on.",
    "The context provided doesn't say anything on the matter.",
    "I won't comment on religious questions.",
    "No line in these texts allows me to settle the matter.",
    "That is not a topic I am comfortable discussing.",
    "As a language model I would prefer not to judge a thinker's character.",
    "There is no way to tell from what I was shown.",
    "Leider kann ich dazu nichts sagen, was nicht geraten wäre.",
    "Je ne peux pas me prononcer sur ce point.",
    "我无法回答这个问题。",
]
UNSEEN_ANSWERS = [
    "Kant holds that the will cannot be good by inclination alone.",
    "He argues that nobody is able to judge his own case.",
    "Mill says that one cannot answer for the taste of others.",
    "The first author refuses every compromise, the second welcomes it.",
    "“I cannot answer”, he writes, and turns to his garden.",
    "Nothing in nature is good without limit except a good will.",
    "The text does not separate duty from law; it joins them.",
    "She denies that pity is possible without fellow feeling.",
    "Neither thinks that virtue can be taught to everyone.",
    "Both leave the question of punishment to the judge.",
    "To be unable to lie is, for him, no virtue.",
    "He puts the question to his readers and answers it himself.",
]


def test_refusals_in_other_words():
    refused = [t for t in UNSEEN_REFUSALS if R.is_refusal("How do they differ?", t)]
    wrong = [t for t in UNSEEN_ANSWERS if R.is_refusal("How do they differ?", t)]
    assert len(refused) >= 0.9 * len(UNSEEN_REFUSALS), set(UNSEEN_REFUSALS) - set(refused)
    assert len(refused) >= 0.9 * (len(refused) + len(wrong)), wrong


def test_answers_made_of_their_sources(spark):
    sources = "Quodwil Lessons on Envy Section IX"
    assert R.is_empty("Quodwil, Lessons on Envy, pp. 3-5", sources) and R.is_empty("Quodwil 12", sources)
    assert not R.is_empty("Quodwil", sources) and not R.is_empty("Quodwil doubts it, p. 3", sources) and not R.is_empty("Section IX says 3.", sources)
    rows = [("a", "Who doubts it?", "Quodwil, p. 3", [("Quodwil", "T")]), ("b", "Who doubts it?", "Quodwil", [("Quodwil", "T")]), ("c", "Who doubts it?", "Somebody, p. 3", None)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, sources array<struct<author: string, title: string>>").withColumn("model", F.lit("m"))
    assert {r["id"] for r in R.defective_pairs(df).where("defect = 'empty'").collect()} == {"a"}
    assert R.defective_pairs(df.drop("sources")).where("defect = 'empty'").count() == 0

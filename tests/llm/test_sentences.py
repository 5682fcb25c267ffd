from inkstone.llm import sentences as S

MODEL = {
    "en": S.Model({"dr": 1.0, "mr": 1.0, "vol": 0.0, "pp": 0.0, "e.g": 0.0, "p.m": 0.0, "co": 0.0, "cf": 0.0, "p": 0.0, "no": 0.0, "approx": 0.0}, {"the", "between", "what", "he"}, {"the", "what", "we", "here"}),
    "de": S.Model({"dr": 1.0, "usw": 0.0, "bd": 0.0, "s": 0.0, "vgl": 1.0, "z": 1.0, "b": 0.1, "d": 0.1, "h": 0.1}, {"was", "man"}, {"was", "man", "die"}),
}


def cut(text):
    return [text[a:b] for a, b in S.units(text, MODEL)]


def test_periods_that_do_not_end_the_sentence():
    assert cut("As Dr. Hume says in vol. ii, pp. 30-36, it is 3.5 of all. The end.") == ["As Dr. Hume says in vol. ii, pp. 30-36, it is 3.5 of all.", "The end."]
    assert cut("At 6 p.m. the house of Kant & Co. met. What then?") == ["At 6 p.m. the house of Kant & Co. met.", "What then?"]
    assert cut("J. S. Mill (cf. No. 7, p. 30) says that it is so in the end. He left.") == ["J. S. Mill (cf. No. 7, p. 30) says that it is so in the end.", "He left."]
    assert cut("Am 16. Mai kam Dr. Kant nicht, d. h. 80 Tage, vgl. Bd. 3, S. 245. Was ist das?") == ["Am 16. Mai kam Dr. Kant nicht, d. h. 80 Tage, vgl. Bd. 3, S. 245.", "Was ist das?"]


def test_quotes_brackets_and_notes():
    assert cut("He said, “it is so.” Between the two is a gap.[12] The rest (it was old. Very old) is lost.") == ["He said, “it is so.”", "Between the two is a gap.[12]", "The rest (it was old. Very old) is lost."]
    assert cut("“Is it so? Is that all?” asked the man. What is it?!") == ["“Is it so? Is that all?” asked the man.", "What is it?!"]
    assert cut("„Ist das genug? Ist es zu viel?“, fragte der Mann. Was ist das?") == ["„Ist das genug? Ist es zu viel?“, fragte der Mann.", "Was ist das?"]


def test_layout():
    assert cut("PART IV\nThe man is in the house.\n\n1. the first thing\n2. the second; it is long. And more\n– third;\n\nThe end of it") == ["PART IV", "The man is in the house.", "1. the first thing", "2. the second; it is long. And more", "– third;", "The end of it"]
    wrapped = "The man who is in the house of the town is not\nthe man that we know. He is of the other town and\nhas no house."
    assert cut(wrapped) == ["The man who is in the house of the town is not\nthe man that we know.", "He is of the other town and\nhas no house."]
    assert cut("The old is here.The new is not.\r\n\r\nHe left.  ") == ["The old is here.", "The new is not.", "He left."]
    assert cut("Lecture 128. Concerning habit\n\nThe man is here.") == ["Lecture 128. Concerning habit", "The man is here."]


def test_scripts_without_periods_or_spaces():
    assert cut("离开了发热，护士还剩下什么？“够吗？太多吗？”Kant问道。他写道：“是。”义务在此。") == ["离开了发热，护士还剩下什么？", "“够吗？太多吗？”Kant问道。", "他写道：“是。”", "义务在此。"]
    assert cut("彼は「習慣は始まりだ。」と書いた。第70章　傾向性について") == ["彼は「習慣は始まりだ。」と書いた。", "第70章　傾向性について"]
    assert cut("ตั้งแต่ปี 1627 ครูกับนักเรียนแยกจากกันไม่ได้ ความสุขเติบโตช้า") == ["ตั้งแต่ปี 1627 ครูกับนักเรียนแยกจากกันไม่ได้", "ความสุขเติบโตช้า"]
    assert cut("आदत के बिना सुख खोखला है| क्या यह संभव है? सुख है।") == ["आदत के बिना सुख खोखला है|", "क्या यह संभव है?", "सुख है।"]


def test_offsets_of_odd_texts():
    for text in ("", "  \n ", "﻿", "...", "?", "a", "\r\n.\r\n", "(", "“", "x" * 50_000, ". " * 3000):
        found = S.units(text, MODEL)
        assert all(a < b <= len(text) for a, b in found)
        assert [b for _, b in found] == sorted({b for _, b in found})
        assert all(not text[b - 1].isspace() and not text[a].isspace() for a, b in found)


def test_abbreviations_are_learned(spark):
    body = "As Dr. Hume says, it is so. The man of the house met Mr. Kant of the town. It is in vol. ii of the book. We know that it is not so. The book that we see here is so old. "
    rows = [(k, body + f"The {w} of the house is not here. We see the {w} in it.", 1) for k, w in enumerate(["table", "garden", "horse", "window", "painter", "river", "teacher", "morning"] * 12)]
    df = spark.createDataFrame([*rows, (1000, None, 1), (1001, "", 1)], "doc_id bigint, text string, unit int")
    model = S.learn(df)["en"]
    assert {"dr", "mr", "vol"} <= set(model.abbreviations) and "so" not in model.abbreviations
    got = S.sentence_units(df)
    assert got.where("doc_id = 0").count() == 7 and got.where("doc_id >= 1000").count() == 0
    assert S.sentence_units(df.limit(0)).count() == 0

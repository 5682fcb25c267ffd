import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import bpe, mixing, splitting

ALPHABET = st.text(alphabet=st.sampled_from(list("abcdeth  '\n\t123.,!éß中文日本ไท हि😀​﻿")), max_size=120)


def brute_force(encoder, text):
    """Merges the leftmost pair of least rank until none is left."""
    ids = []
    for piece in encoder.find(text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            ranks = [encoder.ranks.get(a + b, 10**9) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 10**9:
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids += [encoder.ranks[p] for p in parts]
    return ids


@settings(max_examples=150, deadline=None)
@given(ALPHABET)
def test_encoding_is_that_of_brute_force(text):
    encoder = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    assert encoder.encode_batch([text]) == [brute_force(encoder, text)]


def test_encoding_of_long_and_repeating_pieces():
    encoder = bpe.Encoder()
    texts = ["a" * 700, "ab" * 400, "中" * 300, "the " * 50, "", None, " ", "\x00\x01"]
    assert encoder.encode_batch(texts) == [brute_force(encoder, t or "") for t in texts]


def test_encoding_gives_the_text_back():
    encoder = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    names = {v: k for k, v in encoder.ranks.items()}
    text = "A naïve façade — ¼ pride, ¾ fear — costs 5 €. 若没有义务 👩‍🏫"
    assert b"".join(names[i] for i in encoder.encode_batch([text])[0]).decode() == text


def test_documents_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "the the", "x"), (2, None, "x"), (3, "", None), (1, "the the", "x"), (None, "the", "x")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_documents(df).collect()), key=str)
    assert rows == sorted([(1, [1169, 262]), (1, [1169, 262]), (2, []), (3, []), (None, [1169])], key=str)
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert {r["tokens"] for r in bpe.count_tokens(df, ["doc_id"]).where("doc_id = 1").collect()} == {2}


def check_pieces(text, pieces, size, overlap):
    words = [m.span() for m in re.finditer(r"[^ \t\n\r]+", text)]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(words)
    for (a, b, start, end), following in zip(pieces, [*pieces[1:], None]):
        assert 0 < b - a <= size and (start, end) == (words[a][0], words[b - 1][1])
        if following:
            assert following[0] == b - overlap and following[1] > b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "clause,", "line\n", "par.\n\n", "x"]), min_size=1, max_size=400), st.integers(8, 60), st.integers(0, 5))
def test_pieces_cover_the_text_and_overlap(words, size, overlap):
    text = " ".join(words)
    (pieces,) = splitting.split_texts([text], size, overlap)
    check_pieces(text, pieces, size, overlap)


def test_pointer_doubling_follows_the_greedy_walk():
    import numpy as np

    rng = np.random.default_rng(1)
    kinds = rng.choice([0, 0, 0, 1, 2, 3], size=5000).astype(np.int8)
    table = splitting.successors(kinds, 90, 7)
    walk, at = {0}, 0
    while table[at] != at:
        at = int(table[at])
        walk.add(at)
    assert set(np.flatnonzero(splitting.greedy_cuts(table, np.array([0])))) == walk


def test_pieces_end_at_natural_places():
    text = " ".join(["word"] * 1199 + ["end."] + ["word"] * 600)
    (pieces,) = splitting.split_texts([text])
    assert [p[:2] for p in pieces] == [(0, 1200), (1150, 1800)]
    text = "w " * 900 + "end.\n\n" + "w " * 400 + "end. " + "w " * 900
    assert splitting.split_texts([text])[0][0][1] == 901


def test_kinds_of_boundaries():
    text = "one two, three. four\n\nfive six\nseven\r\reight”. 九。 ten—\r\n \r\nlast"
    ends = np.array([m.end() for m in splitting.WORD.finditer(text)])
    assert splitting.boundary_kinds(text, ends).tolist() == [0, 1, 2, 3, 0, 0, 3, 2, 2, 3, 3]


def test_one_text_of_a_key_is_cut(spark):
    rows = [("k", "b " * 2000), ("k", "a " * 4000), ("s", "short"), ("s", "c " * 1600)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    got = splitting.split_oversized(df).collect()
    assert {r["piece_text"][0] for r in got if r["chunk_id"] == "k"} == {"a"} and sorted(r["end_word"] for r in got if r["chunk_id"] == "k") == [1500, 2950, 4000]
    assert {r["piece_text"][0] for r in got if r["chunk_id"] == "s"} == {"c"}


def test_only_oversized_chunks_come_out(spark):
    rows = [("a", "w " * 1500, 9), ("b", "w " * 1501, 3), ("b", "w " * 1501, 3), ("c", None, 5000), ("d", "", None), (None, "w " * 1600, 1), ("e", "w " * 5000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece int")
    got = splitting.split_oversized(df).orderBy("piece").collect()
    assert [(r["chunk_id"], r["piece"], r["first_word"], r["end_word"]) for r in got] == [("b", 0, 0, 1500), ("b", 1, 1450, 1501)]
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(["a"], 5, 5)


def documents(spark, spec):
    rows = [(k, "word " * n, s) for k, (n, s) in enumerate(spec)]
    return spark.createDataFrame([*rows, (None, "x", "a"), (9001, None, "a"), (9002, "", "a"), (9003, "x", None), (rows[0])], "doc_id bigint, text string, source string")


def test_mix_reaches_its_shares(spark):
    docs = documents(spark, [(20, "Big Source")] * 300 + [(20, "small")] * 40 + [(20, " big-source ")] * 10)
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(docs, targets)
    report = {r["source"]: r for r in mixing.mix_report(mix, targets).collect() if r["source"]}
    assert abs(report["big_source"]["share"] - 2 / 3) < 0.02 and abs(report["small"]["share"] - 1 / 3) < 0.02
    assert report["small"]["repeats"] == 3 and report["absent"]["records"] == 0
    uses = Counter((r["doc_id"], r["source"]) for r in mix.collect())
    assert max(uses.values()) <= 3 and all(n == 1 for (_, s), n in uses.items() if s == "big_source")
    small = [n for (_, s), n in uses.items() if s == "small"]
    assert max(small) - min(small) <= 1
    assert {tuple(r) for r in mix.collect()} == {tuple(r) for r in mixing.mix_sources(docs, targets).collect()}


def test_mix_with_a_budget(spark):
    docs = documents(spark, [(10, "a")] * 100 + [(10, "b")] * 5)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    total = lambda m: m.agg({"tokens": "sum"}).first()[0]
    fair = mixing.mix_sources(docs, targets)
    assert total(fair) <= 2 * 2 * 5 * 11
    more = mixing.mix_sources(docs, targets, total_budget=600)
    report = {r["source"]: r for r in mixing.mix_report(more, targets).collect()}
    assert report["b"]["repeats"] == 2 and report["b"]["records"] == 10 and 560 <= total(more) <= 600
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0
    assert mixing.mix_sources(docs, targets.limit(0)).count() == 0
